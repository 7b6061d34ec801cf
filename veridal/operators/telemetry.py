"""Request telemetry: summaries by method and stage, counters of a case, orphans."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridal.operators import selection

TOKENS = ("input_tokens", "output_tokens", "total_tokens")


def benchmark_summary(events: DataFrame, cases: DataFrame) -> DataFrame:
    """Measures by method and stage, and by method with stage ``ALL``.

    Events are first summed by method, stage and latency; everything but the
    distinct calls comes from that, and ``ALL`` from the stages. ``cases``
    (``method``, ``status``) is counted by method; stages repeat those counts. Token
    totals cover requests with usage and are 0 without any. Calls are pairs of
    sample and call id, nulls included.
    """
    used = F.coalesce(F.col("usage_available"), F.lit(False))
    totals = [F.coalesce(F.sum(F.when(used, F.col(t).cast("bigint"))), F.lit(0)).alias(t) for t in TOKENS]
    counts = ["actual_http_requests", "http_retry_requests", "with_usage", *TOKENS]
    by_value = events.groupBy("method", "stage", "latency_ms").agg(
        F.count("*").alias("actual_http_requests"), F.count_if(F.coalesce("http_attempt", F.lit(1)) > 1).alias("http_retry_requests"), F.count_if(used).alias("with_usage"), *totals
    )
    # A stage's null is a stage; ALL is told by a flag.
    once = by_value.withColumn("all_stages", F.lit(False)).unionByName(by_value.withColumn("stage", F.lit(None).cast(dict(by_value.dtypes)["stage"])).withColumn("all_stages", F.lit(True)))
    keys = ["method", "stage", "all_stages"]
    sums = once.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])
    ranks = selection.at_ranks(once, keys, "latency_ms", {"p50_latency_ms": selection.nearest(0.5), "p95_latency_ms": selection.nearest(0.95)}, "actual_http_requests")
    calls = events.select("method", "stage", "sample_id", "logical_call_id").distinct()
    whole = calls.drop("stage").distinct().withColumn("stage", F.lit(None).cast(dict(calls.dtypes)["stage"]))
    calls = calls.withColumn("all_stages", F.lit(False)).unionByName(whole.withColumn("all_stages", F.lit(True))).groupBy(*keys).agg(F.count("*").alias("logical_model_calls"))
    by_case = cases.groupBy("method").agg(F.count("*").alias("submitted_cases"), F.count_if(F.col("status") == "success").alias("successful_cases"))
    out = sums
    for other, on in ((ranks, keys), (calls, keys), (by_case, ["method"])):
        named = other.select(*[F.col(k).alias(f"{k}_") for k in on], *[c for c in other.columns if c not in on])
        same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in on]
        out = out.join(named, reduce(lambda a, b: a & b, same), "left").drop(*[f"{k}_" for k in on])
    out = out.na.fill(0, ["submitted_cases", "successful_cases"])
    return out.select(
        "method", F.when(F.col("all_stages"), "ALL").otherwise(F.col("stage")).alias("stage"), "submitted_cases", "successful_cases",
        (F.col("submitted_cases") - F.col("successful_cases")).alias("error_cases"), "logical_model_calls", "actual_http_requests", "http_retry_requests",
        F.try_divide("actual_http_requests", "successful_cases").alias("requests_per_successful_case"), (F.col("with_usage") * 100 / F.col("actual_http_requests")).alias("usage_coverage"),
        *TOKENS, "p50_latency_ms", "p95_latency_ms",
    )


def case_counters(events: DataFrame, keys: Sequence[str], attempt: Column, failed: Column, prompt: Column, completion: Column) -> DataFrame:
    """Requests, retries, errors and tokens of a case; tokens are null unless some request told them."""
    some = F.count_if(prompt.isNotNull() | completion.isNotNull()) > 0
    return events.groupBy(*keys).agg(
        F.count("*").alias("num_request"), F.count_if(attempt > 1).alias("num_retry"), F.count_if(failed).alias("num_error_request"),
        F.when(some, F.coalesce(F.sum(prompt), F.lit(0))).alias("input_token"), F.when(some, F.coalesce(F.sum(completion), F.lit(0))).alias("output_token"),
    )


def orphan_events(events: DataFrame, cases: DataFrame, keys: Sequence[str]) -> DataFrame:
    return events.join(cases.select(*keys).distinct(), list(keys), "left_anti")


def retry_rate(requests: Column, retries: Column) -> Column:
    return F.try_divide(retries, requests)


def limiter_audit(counted: DataFrame, cap: int, name: str = "in_window") -> DataFrame:
    """Rows at which more requests than ``cap`` stand in the rolling window."""
    return counted.filter(F.col(name) > cap)


def run_summary(rows: DataFrame) -> DataFrame:
    """Inputs, successes, errors, calls and attempts of a run, and the latency of its successes, null without one."""
    ok = F.coalesce(F.col("status") == "success", F.lit(False))
    latency = F.when(ok, F.col("latency_ms"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return rows.agg(
        F.count("*").alias("num_inputs"), F.count_if(ok).alias("success_count"), F.count_if(~ok).alias("error_count"), total("model_calls"), total("http_attempts"),
        F.when(F.count(latency) > 0, F.struct(F.avg(latency).alias("mean"), F.min(latency).alias("min"), F.max(latency).alias("max"))).alias("latency_ms_success"),
    )
