"""Ranks over a whole table without sorting it in one task, and sort keys of other languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridal.operators.stages import settled

#: The place of a row within its task is below this in ``monotonically_increasing_id``.
_IN_TASK = (1 << 33) - 1


def global_rank(df: DataFrame, by: list[Column], name: str) -> DataFrame:
    """``df`` with the place (from 1) of each row in the order ``by``; ties in any order.

    Rows are dealt out by ranges of the key and sorted there; only the numbers of
    rows of the ranges, one each, are added up in one place.
    """
    keys = [c.alias(f"by_{i}") for i, c in enumerate(by)]
    names = [f"by_{i}" for i in range(len(by))]
    ranged = df.select("*", *keys).repartitionByRange(*names).sortWithinPartitions(*names).drop(*names)
    placed = settled(ranged.withColumn("part_", F.spark_partition_id()).withColumn("in_part_", F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_TASK))))
    sizes = placed.groupBy("part_").agg(F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part_", before.alias("before_"))
    return placed.join(F.broadcast(starts), "part_").withColumn(name, F.col("before_") + F.col("in_part_") + 1).drop("part_", "in_part_", "before_", "n_")


def script_number(x: Column) -> Column:
    """A text as JavaScript's ``Number`` reads it: blank is 0, hexadecimal is read, anything else is no number."""
    t = F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    whole = F.when(t == "", F.lit(0.0)).when(t.rlike("^0[xX][0-9a-fA-F]+$"), F.conv(F.substring(t, 3, 16), 16, 10).cast("double"))
    plain = F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))
    endless = F.when(t.rlike(r"^[+]?Infinity$"), F.lit(float("inf"))).when(t == "-Infinity", F.lit(float("-inf")))
    return F.when(x.isNotNull(), F.coalesce(whole, plain, endless, F.lit(float("nan"))))


def local_order(x: Column) -> Column:
    """A sort key in the root locale's order, as ``localeCompare`` has it."""
    return F.collate(x, "UNICODE")


def sheet_order(method: Column, sample_id: Column) -> list[Column]:
    """The order of review sheets: by method as people read it, then by the id's number."""
    return [local_order(method), script_number(sample_id)]


def sorted_values(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of ``column``, few, in order."""
    return df.select(column).distinct().orderBy(column)
