"""Tri-state statistics of verdicts: by method, by field, compared between methods.

A verdict is true, false or null (not decided); null leaves the denominator.
Long form has one row per method, sample and field with ``mentioned`` and
``is_correct``, so that every table below is one aggregation of it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridal.functions.text import NO_RATE
from veridal.operators import selection


def verdict_counts(x: Column, prefix: str = "") -> list[Column]:
    return [F.count_if(x).alias(f"{prefix}true"), F.count_if(~x).alias(f"{prefix}false"), F.count_if(x.isNull()).alias(f"{prefix}null")]


def method_summary(rows: DataFrame, group: str, ok: Column, verdict: Column, latency: str) -> DataFrame:
    """Totals, verdicts of successes, and latencies (errors' too) per group."""
    hit = F.when(ok, verdict)
    sums = rows.groupBy(group).agg(
        F.count("*").alias("total"), F.count_if(ok).alias("success"), F.count_if(~ok).alias("errors"),
        F.count_if(hit).alias("n_true"), F.count_if(~hit).alias("n_false"), F.count_if(ok & verdict.isNull()).alias("n_null"),
        F.avg(latency).alias("latency_mean"),
    )
    ranks = {"low_middle": selection.LOW_MIDDLE, "high_middle": selection.HIGH_MIDDLE, "latency_p95": selection.nearest(0.95)}
    out = selection.with_ranks(sums, selection.at_ranks(rows, [group], latency, ranks), [group])
    return out.withColumn("latency_p50", (F.col("low_middle") + F.col("high_middle")) / 2).drop("low_middle", "high_middle")


def error_histogram(rows: DataFrame, group: str, failed: Column, code: Column) -> DataFrame:
    """Failures by code; a null or empty code is ``unknown``."""
    name = F.coalesce(F.nullif(code, F.lit("")), F.lit("unknown"))
    return rows.filter(failed).groupBy(group, name.alias("code")).agg(F.count("*").alias("rows"))


def long_form(rows: DataFrame, keys: Sequence[str], checks: str) -> DataFrame:
    """One row per key and entry of a map of structs (``mentioned``, ``is_correct``, …)."""
    return rows.select(*keys, F.explode(checks).alias("field", "check")).select(*keys, "field", "check.*")


def field_detail(long: DataFrame, groups: Sequence[str], fields: DataFrame) -> DataFrame:
    """Mentioned, correct, incorrect, not mentioned by group and known field; absent ones as 0.

    ``fields`` has ``field`` and ``position``. A mention without verdict counts as incorrect.
    """
    sums = long.groupBy(*groups, "field").agg(
        F.count_if("mentioned").alias("mentioned"),
        F.count_if(F.col("mentioned") & F.coalesce(F.col("is_correct"), F.lit(False))).alias("correct"),
        F.count_if(F.col("mentioned") & ~F.coalesce(F.col("is_correct"), F.lit(False))).alias("incorrect"),
        F.count_if(~F.col("mentioned")).alias("not_mentioned"),
    )
    every = long.select(*groups).distinct().join(F.broadcast(fields.select("field", "position")))
    counts = ["mentioned", "correct", "incorrect", "not_mentioned"]
    return every.join(sums, [*groups, "field"], "left").na.fill(0, counts).select(*groups, "position", "field", *counts)


def row_summary(checks: Column) -> Column:
    """Five counters of an array of structs (``mentioned``, ``is_correct``)."""
    count = lambda f: F.size(F.filter(checks, f))
    return F.struct(
        count(lambda c: c["mentioned"]).alias("mentioned"),
        count(lambda c: ~c["mentioned"]).alias("not_mentioned"),
        count(lambda c: c["is_correct"]).alias("correct"),
        count(lambda c: ~c["is_correct"]).alias("incorrect"),
        count(lambda c: c["is_correct"].isNotNull()).alias("evaluated"),
    )


def rate(correct: Column, incorrect: Column) -> Column:
    return F.try_divide(correct, correct + incorrect)


def coverage(mentioned: Column, rows: Column, fields: int) -> Column:
    return F.try_divide(mentioned, rows * fields)


def extremes(detail: DataFrame, group: str, k: int, least: Column) -> DataFrame:
    """The ``k`` weakest and strongest fields of each group with enough mentions; ties by position."""
    rated = detail.withColumn("rate", rate(F.col("correct"), F.col("incorrect"))).filter(F.col("rate").isNotNull() & (F.col("mentioned") >= least))
    low = F.row_number().over(Window.partitionBy(group).orderBy("rate", "position"))
    high = F.row_number().over(Window.partitionBy(group).orderBy(F.col("rate").desc(), "position"))
    ranked = rated.withColumn("low", low).withColumn("high", high)
    ends = ranked.filter((F.col("low") <= k) | (F.col("high") <= k))
    return ends.select(group, "field", "rate", F.when(F.col("low") <= k, F.col("low")).alias("weakest"), F.when(F.col("high") <= k, F.col("high")).alias("strongest"))


def finding_text(ends: DataFrame, group: str, which: str) -> DataFrame:
    """The fields of one end as text, in rank order."""
    item = F.struct(which, F.concat("field", F.lit(" ("), F.format_number(F.col("rate") * 100, 1), F.lit("%)")).alias("t"))
    return ends.filter(F.col(which).isNotNull()).groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), ", ").alias(which))


def best_and_runner_up(rates: DataFrame, name: str, value: str, position: str) -> DataFrame:
    """The two best; ties by position; a missing rate ranks as -1."""
    place = F.row_number().over(Window.orderBy(F.coalesce(F.col(value), F.lit(-1.0)).desc(), position))
    return rates.withColumn("place", place).filter("place <= 2").select("place", name, value)


#: Conclusions, from the first condition that holds to the last; ``{best}`` stands for the best methods in capitals.
DECISION_TEXTS = {
    "none": "Chưa có dữ liệu để kết luận.",
    "few": "Ít case được mô tả; chỉ tham khảo.",
    "few_of_best": "{best} cao nhất nhưng ít case; chỉ tham khảo.",
    "weak": "Cả ba còn yếu; chưa tự động gán nhãn.",
    "equal": "Ba luồng gần tương đương.",
    "best": "{best} tốt nhất ở thuộc tính này.",
}


def decision(detail: DataFrame, field: str, method: str, position: str, texts: Mapping[str, str] = DECISION_TEXTS) -> DataFrame:
    """What to conclude for each field from methods' ``correct`` and ``incorrect``.

    All best methods are named in order; their support is the most among them.
    """
    said = {k: F.replace(F.lit(t), F.lit("{best}"), F.upper("best")) for k, t in texts.items()}
    support = F.col("correct") + F.col("incorrect")
    d = detail.withColumn("support", support).withColumn("rate", rate(F.col("correct"), F.col("incorrect")))
    top = F.max("rate").over(Window.partitionBy(field))
    d = d.withColumn("top", top).withColumn("is_top", F.col("rate") == F.col("top"))
    out = d.groupBy(field).agg(
        F.max("top").alias("best_rate"), (F.max("rate") - F.min("rate")).alias("gap"), F.max("support").alias("most_support"),
        F.max(F.when(F.col("is_top"), F.col("support"))).alias("best_support"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("is_top"), F.struct(position, method)))), lambda x: x[method]), ", ").alias("best"),
    )
    label = (
        F.when(F.col("best_rate").isNull(), said["none"])
        .when(F.col("most_support") < 10, said["few"])
        .when(F.col("best_support") < 30, said["few_of_best"])
        .when(F.col("best_rate") < 0.60, said["weak"])
        .when(F.col("gap") < 0.05, said["equal"])
        .otherwise(said["best"])
    )
    return out.select(field, "best", "best_rate", "best_support", label.alias("conclusion"))


def by_method(detail: DataFrame, field: str, method: str, methods: Sequence[str], value: Column) -> DataFrame:
    """Methods as columns."""
    return detail.groupBy(field).pivot(method, list(methods)).agg(F.first(value))


def rate_text(correct: Column, incorrect: Column) -> Column:
    """``c/d (r%)``, a dash without a denominator."""
    both = correct + incorrect
    text = F.concat(correct.cast("string"), F.lit("/"), both.cast("string"), F.lit(" ("), F.format_number(F.try_divide(correct * 100, both), 1), F.lit("%)"))
    return F.coalesce(text, F.lit(NO_RATE))


def accuracy_summary(long: DataFrame, groups: Sequence[str], verdict: str, images: int) -> DataFrame:
    """Accuracy and coverage where *not applicable* is right, and what still needs a look.

    ``verdict`` is one of correct, incorrect, not_applicable, not_visible, golden_needs_review.
    """
    n = {v: F.count_if(F.col(verdict) == v) for v in ("correct", "incorrect", "not_applicable", "not_visible", "golden_needs_review")}
    decided = n["correct"] + n["incorrect"] + n["not_applicable"]
    return long.groupBy(*groups).agg(
        F.try_divide(n["correct"] + n["not_applicable"], decided).alias("accuracy"),
        (decided / F.lit(float(images))).alias("coverage"),
        (n["not_visible"] + n["golden_needs_review"]).alias("needs_review"),
    )


def micro_macro(long: DataFrame, sample: str, field: str, right: Column, fields: int) -> DataFrame:
    """Share of right answers over all, mean over fields, and share of samples with all fields right."""
    ok = long.withColumn("ok", right)
    by_field = ok.groupBy(field).agg(F.avg(F.col("ok").cast("double")).alias("a")).agg(F.avg("a").alias("macro"))
    whole = ok.groupBy(sample).agg(F.count_if("ok").alias("n")).agg(F.avg((F.col("n") == fields).cast("double")).alias("exact"))
    micro = ok.agg(F.avg(F.col("ok").cast("double")).alias("micro"))
    return micro.join(F.broadcast(by_field)).join(F.broadcast(whole))


def severity_level(minor: Column, major: Column, useless: Column) -> Column:
    """3 without an error, 2 with small ones, 1 with a great one, 0 if nothing of use is left."""
    return F.when(useless, 0).when(major > 0, 1).when(minor > 0, 2).otherwise(3)
