"""Elements at given ranks of each group's sorted values, without a group in one task.

Equal values of a group are one row with a count. These rows are dealt out by
ranges of (group, value), so that a group of any size spreads over tasks; the
counts of the ranges tell which range holds a rank, and only those ranges are
looked into. A task holds one range, never a group.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridal.operators.stages import settled

#: A rank from the number of values.
Rank = Callable[[Column], Column]


def nearest(p: float) -> Rank:
    """The place ceil(n p), and the first for p = 0."""
    return lambda n: F.greatest(F.ceil(n * F.lit(p)), F.lit(1))


#: The two middle places; the median is the mean of the values there.
LOW_MIDDLE: Rank = lambda n: F.floor((n + 1) / 2)
HIGH_MIDDLE: Rank = lambda n: F.floor(n / 2) + 1


def same(left: Sequence[str], right: Sequence[str]) -> Column:
    """Equality of columns by place, where null equals null."""
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)], F.lit(True))


def at_ranks(rows: DataFrame, groups: Sequence[str], value: str, ranks: Mapping[str, Rank], weight: str | None = None) -> DataFrame:
    """One row a group with a value: the groups' columns and the values at ``ranks``.

    Null values are left out; a row counts ``weight`` times. Groups may be null;
    without any group columns there is one row, of nulls if there is no value.
    """
    keys = [f"g{i}_" for i in range(len(groups))]
    named = rows.select(*[F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)], F.col(value).alias("v_"), (F.lit(1).cast("long") if weight is None else F.col(weight)).alias("n_"))
    counted = named.filter("v_ IS NOT NULL").groupBy(*keys, "v_").agg(F.sum("n_").alias("n_"))
    ranged = settled(counted.repartitionByRange(*keys, "v_").withColumn("part_", F.spark_partition_id()))

    # One row for each range that has rows of a group: at most as many as ranges and groups together.
    parts = ranged.groupBy(*keys, "part_").agg(F.sum("n_").alias("here_"))
    before = Window.partitionBy(*keys).orderBy("part_")
    parts = parts.withColumn("upto_", F.sum("here_").over(before.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all_", F.sum("here_").over(Window.partitionBy(*keys)))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("all_")).cast("long").alias("rank")) for name, rank in ranks.items()]))
    wanted = parts.withColumn("w_", wanted).filter("w_.rank > upto_ - here_ AND w_.rank <= upto_")
    wanted = settled(wanted.select(*[F.col(k).alias(f"w{k}") for k in keys], F.col("part_").alias("wpart_"), F.col("w_.name").alias("name_"), (F.col("w_.rank") - F.col("upto_") + F.col("here_")).alias("rank_")))

    held = wanted.select(*[f"w{k}" for k in keys], "wpart_").distinct()
    range_of = [f"w{k}" for k in keys] + ["wpart_"]
    looked = ranged.join(held, same([*keys, "part_"], range_of), "left_semi")
    looked = looked.withColumn("upto_", F.sum("n_").over(Window.partitionBy(*keys, "part_").orderBy("v_").rowsBetween(Window.unboundedPreceding, 0)))
    found = wanted.join(looked, same(range_of, [*keys, "part_"])).filter("rank_ > upto_ - n_ AND rank_ <= upto_")
    out = found.groupBy(*keys).agg(*[F.first(F.when(F.col("name_") == name, F.col("v_")), ignorenulls=True).alias(name) for name in ranks])
    return out.select(*[F.col(k).alias(g) for k, g in zip(keys, groups, strict=True)], *ranks)


def with_ranks(sums: DataFrame, found: DataFrame, groups: Sequence[str]) -> DataFrame:
    """``sums`` with the columns of ``found`` for its group; null groups match."""
    keys = [f"h{i}_" for i in range(len(groups))]
    renamed = found.select(*[F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)], *[c for c in found.columns if c not in groups])
    return sums.join(renamed, same(list(groups), keys), "left").drop(*keys)
