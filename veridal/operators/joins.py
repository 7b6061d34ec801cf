"""Joins that must match, and their checks.

A check is part of the plan: it fails the query when it runs, without a job of
its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fail_if(condition: Column, message: str, value: Column) -> Column:
    """``value``, or an error where ``condition`` holds."""
    return F.when(condition, F.raise_error(F.lit(message))).otherwise(value)


def required_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which every left row must find a partner."""
    marked = right.withColumn("found_", F.lit(True))
    joined = left.join(marked, list(keys), "left")
    first = keys[0]
    return joined.withColumn(first, fail_if(F.col("found_").isNull(), f"no partner by {', '.join(keys)}", F.col(first))).drop("found_")


def required_semi(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``left``, whose every row must have its key in ``right``."""
    return required_join(left, right.select(*keys).distinct(), keys)


def unmatched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti")


def unique_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df``, failing if a key stands twice."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("n_", n).withColumn(keys[0], fail_if(F.col("n_") > 1, f"repeated {', '.join(keys)}", F.col(keys[0]))).drop("n_")


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def single_value(df: DataFrame, column: str) -> DataFrame:
    """One row with the only value of ``column`` (null counts as one); more are an error."""
    only = F.count_distinct(F.struct(column)) == 1
    return df.agg(fail_if(~only, f"not exactly one {column}", F.first(column)).alias(column))


def in_every(df: DataFrame, key: str, group: str, groups: Sequence[str]) -> DataFrame:
    """Keys that stand in all of ``groups``; one aggregation, no self joins."""
    return df.filter(F.col(group).isin(*groups)).groupBy(key).agg(F.count_distinct(group).alias("n_")).filter(F.col("n_") == len(set(groups))).select(key)


def intersection(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.intersect(b), frames)


def same_sets(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same elements; repeats do not count."""
    return F.array_sort(F.array_distinct(a)).eqNullSafe(F.array_sort(F.array_distinct(b)))


def wide_merge(base: DataFrame, rows: DataFrame, key: str, group: str, groups: Sequence[str], values: Sequence[str], order: str) -> DataFrame:
    """``base`` with ``<group>_<value>`` columns of each group's last row; blanks where there is none."""
    last = [F.max_by(F.col(v), F.when(F.col(group) == g, F.col(order))).alias(f"{g}_{v}") for g in groups for v in values]
    wide = rows.filter(F.col(group).isin(*groups)).groupBy(key).agg(*last)
    names = [f"{g}_{v}" for g in groups for v in values]
    return base.join(wide, key, "left").select(*base.columns, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in names])


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two frames has, with their side."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
