"""Row filters, unions and counts of the report and merge tools."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridal.functions.text import blank_to_null
from veridal.operators.joins import fail_if

#: The groups in which attributes are reviewed, most important first.
REVIEW_GROUPS = ("critical", "important", "detail")


def query_rows(manifest: DataFrame, flag: str = "is_query") -> DataFrame:
    """Rows whose flag is the text ``1``; ``true``, ``1.0`` and blanks are not."""
    return manifest.filter(F.col(flag).cast("string") == "1")


def of_run(rows: DataFrame, run_id: str, column: str = "run_id") -> DataFrame:
    """The rows of one run; none is an error when the query runs."""
    mine = rows.filter(F.col(column) == run_id)
    n = F.broadcast(mine.agg(F.count("*").alias("n_")))
    some = n.select(fail_if(F.col("n_") == 0, f"no rows of run {run_id}", F.lit(True)).alias("some_"))
    return some.join(mine, F.col("some_"), "left").drop("some_")


def with_prefix(rows: DataFrame, prefix: str, column: str = "key") -> DataFrame:
    return rows.filter(F.col(column).startswith(prefix))


def first_in_order(manifest: DataFrame, n: int, order: str = "position") -> DataFrame:
    """The first ``n`` rows in the manifest's own order; each task keeps no more before they meet."""
    if n < 1:
        raise ValueError("the limit must be at least one")
    return manifest.orderBy(order).limit(n)


def only_fields(values: Column, fields: Sequence[str]) -> Column:
    """The entries of a map whose key is one of ``fields``."""
    return F.map_filter(values, lambda k, _: k.isin(*fields))


def with_files(manifest: DataFrame, files: DataFrame, path: str = "filepath", root: str = "") -> DataFrame:
    """Rows whose file stands among ``files`` (``path`` from a file listing), as ``root/filepath``."""
    there = files.select(F.regexp_replace("path", "^[a-z]+:/*", "/").alias("found_path_")).distinct()
    full = F.concat(F.lit(f"{root.rstrip('/')}/" if root else ""), F.col(path))
    return manifest.join(there, full == F.col("found_path_"), "left_semi")


def require_files(manifest: DataFrame, files: DataFrame, path: str = "filepath", root: str = "") -> DataFrame:
    """``manifest``, whose every row must have its file."""
    there = files.select(F.regexp_replace("path", "^[a-z]+:/*", "/").alias("found_path_")).distinct()
    full = F.concat(F.lit(f"{root.rstrip('/')}/" if root else ""), F.col(path))
    joined = manifest.join(there, full == F.col("found_path_"), "left")
    return joined.withColumn(path, F.when(F.col("found_path_").isNull(), F.raise_error(F.concat(F.lit("no file "), F.col(path)))).otherwise(F.col(path))).drop("found_path_")


def override_counts(overrides: DataFrame, prefix: str) -> DataFrame:
    """Corrections of a method, and the fields that they correct."""
    some = with_prefix(overrides, prefix)
    given = F.coalesce(F.col("caption_given"), F.lit(False)).cast("int") + F.coalesce(F.size("attributes"), F.lit(0))
    return some.agg(F.count("*").alias("corrected_rows"), F.coalesce(F.sum(given), F.lit(0)).cast("long").alias("corrected_fields"))


def matched_updates(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """How many updates find their row, repeated ones included."""
    return updates.join(base.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("matched_rows"))


def union_by_method(frames: Mapping[str, DataFrame], column: str = "method") -> DataFrame:
    """Frames under one another, each marked with its method; columns that one lacks are null."""
    named = [df.withColumn(column, F.lit(m)) for m, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def feedback_of(issues: Column, reasons: Column) -> Column:
    """A critic's issues, then a verifier's reasons as issues."""
    as_issue = lambda r: F.struct(F.lit("verifier").alias("target"), F.trim(r).alias("issue"), F.lit("Correct the unsupported claim.").alias("suggested_correction"))
    return F.concat(issues, F.transform(reasons, as_issue))


def review_form(answers: Column) -> Column:
    """The corrections that a filled review form gives: blank answers are none, ``null`` is an explicit null, any other word is an error."""
    filled = F.map_filter(answers, lambda _, v: blank_to_null(v).isNotNull())
    refused = lambda k, v: F.raise_error(F.concat(F.lit("not a verdict for "), k, F.lit(": "), v)).cast("boolean")
    verdict = lambda v: F.when(v == "true", True).when(v == "false", False)
    return F.transform_values(filled, lambda k, v: F.when(F.trim(v).isin("true", "false", "null"), verdict(F.trim(v))).otherwise(refused(k, v)))


def review_priority(detail: DataFrame, groups: Mapping[str, str], field: str = "field") -> DataFrame:
    """``detail`` with its field's review group and the group's place; unnamed fields are details."""
    group = F.lit(REVIEW_GROUPS[-1])
    for name, g in groups.items():
        group = F.when(F.col(field) == name, g).otherwise(group)
    places = F.array(*[F.lit(g) for g in REVIEW_GROUPS])
    return detail.withColumn("review_group", group).withColumn("review_place", F.array_position(places, F.col("review_group")).cast("int"))


def claims_of(labels: DataFrame, key: str, attributes: str, template: str = "{field}: {label}") -> DataFrame:
    """One claim for each label of a map of label arrays, in the order of field and label; null gives none."""
    flat = labels.select(key, F.explode(attributes).alias("field", "values")).select(key, "field", F.posexplode("values").alias("place", "label"))
    before, after = template.split("{field}", 1)
    between, end = after.split("{label}", 1)
    return flat.withColumn("claim", F.concat(F.lit(before), F.col("field"), F.lit(between), F.col("label"), F.lit(end)))


def claims_agree(top_level: Column, claims: Column) -> Column:
    """Whether the whole is false exactly where some claim is."""
    return (~top_level).eqNullSafe(F.exists(claims, lambda c: F.coalesce(~c, F.lit(False))))
