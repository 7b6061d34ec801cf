"""Human corrections laid over evaluation rows, and the rows of review sheets.

Absent, explicit null and a verdict are three different corrections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridal.functions.text import key_of, mention_text, shown_verdict, tri_state


def explode_overrides(pairs: DataFrame) -> DataFrame:
    """``key``, ``caption_given``, ``caption_correct``, ``attributes`` from ``(key, value)`` rows."""
    return pairs.select("key", F.col("value.caption").isNotNull().alias("caption_given"), F.col("value.caption.is_correct").alias("caption_correct"), F.col("value.attributes").alias("attributes"))


def with_overrides(rows: DataFrame, overrides: DataFrame, method: str = "method", sample: str = "sample_id") -> DataFrame:
    """Every row with its correction, if there is one."""
    named = overrides.select(F.col("key").alias("override_key"), *[F.col(c).alias(f"override_{c}") for c in overrides.columns if c != "key"])
    return rows.join(named, key_of(F.col(method), F.col(sample)) == F.col("override_key"), "left")


def human_caption(given: Column) -> Column:
    """'' unless the reviewer gave true or false."""
    return F.when(given, "true").when(~given, "false").otherwise("")


def human_attribute(attributes: Column, field: Column) -> Column:
    """'' if the reviewer left the field out, 'null' if they set it to null."""
    there = F.coalesce(F.array_contains(F.map_keys(attributes), field), F.lit(False))
    return F.when(there, tri_state(F.try_element_at(attributes, field))).otherwise("")


def upsert(current: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The later row of each key over both."""
    both = current.unionByName(new)
    return both.groupBy(key).agg(F.max_by(F.struct(*[c for c in both.columns if c != key]), F.col(order)).alias("r")).select(key, "r.*")


def lacking_reviews(overrides: DataFrame, reviews: DataFrame) -> DataFrame:
    """Corrections without a review to correct."""
    keys = reviews.select(key_of(F.col("method"), F.col("sample_id")).alias("key")).distinct()
    return overrides.join(keys, "key", "left_anti")


def review_of_sample(reviews: DataFrame, overrides: DataFrame, sample_id: str) -> DataFrame:
    return with_overrides(reviews.filter(F.col("sample_id") == sample_id), overrides)


def caption_sheet(rows: DataFrame) -> DataFrame:
    """A line per review, failures too; ``rows`` from ``with_overrides``."""
    s = F.col("caption_attribute_summary")
    return rows.select(
        "sample_id", "filepath", "status", shown_verdict(F.col("caption_evaluation.is_correct"), F.col("caption_evaluation").isNotNull()).alias("caption_correct"), F.col("caption_evaluation.needs_human_review").alias("needs_review"),
        F.col("prediction.caption").alias("caption"), F.col("prediction.caption_vi").alias("caption_vi"), F.col("caption_evaluation.note").alias("note"),
        *[s[c].alias(c) for c in ("mentioned", "correct", "incorrect", "not_mentioned", "evaluated")],
        "latency_ms", F.col("error.message").alias("error"), human_caption(F.col("override_caption_correct")).alias("human_caption"),
    )


def attribute_sheet(rows: DataFrame) -> DataFrame:
    """A line per field of each successful review."""
    flat = rows.filter("status = 'success'").select("*", F.explode("caption_attribute_evaluation").alias("field", "check"))
    return flat.select(
        "sample_id", "filepath", F.col("prediction.caption").alias("caption"), shown_verdict(F.col("caption_evaluation.is_correct"), F.col("caption_evaluation").isNotNull()).alias("caption_correct"), "field",
        F.col("check.mentioned").alias("mentioned"), F.try_element_at("golden_attributes", "field").alias("golden"), tri_state(F.col("check.is_correct")).alias("correct"),
        mention_text(F.col("check.mentioned"), F.col("check.is_correct")).alias("reading"), F.col("check.note").alias("note"),
        human_attribute(F.col("override_attributes"), F.col("field")).alias("human_verdict"),
    )


def chain_index(items: DataFrame, first: DataFrame, second: DataFrame, key1: str, key2: str) -> DataFrame:
    """Two must-match look-ups in a row; see ``joins.required_join``."""
    from veridal.operators.joins import required_join

    return required_join(required_join(items, first, [key1]), second, [key2])
