"""Ranks of groups against sorting, and plans that hold no group in one task."""

from __future__ import annotations

import math
import random

import pytest

from veridal.operators import selection, stats, telemetry

RANKS = {"least": selection.nearest(0.0), "low": selection.LOW_MIDDLE, "high": selection.HIGH_MIDDLE, "p95": selection.nearest(0.95), "most": selection.nearest(1.0)}


def brute(rows):
    groups = {}
    for g, h, v, n in rows:
        groups.setdefault((g, h), []).extend([v] * n if v is not None else [])
    out = []
    for key, values in groups.items():
        values.sort()
        n = len(values)
        if n:
            out.append((*key, values[0], values[(n + 1) // 2 - 1], values[n // 2], values[max(1, math.ceil(n * 0.95)) - 1], values[-1]))
    return sorted(out, key=str)


@pytest.mark.parametrize("weight", [None, "n"])
def test_ranks_equal_those_of_sorted_lists(spark, weight):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", None, "c"]), rng.choice([1, None]), rng.choice([None, 1.5, float(rng.randrange(40)), rng.random()]), rng.randrange(1, 4) if weight else 1) for _ in range(900)]
    rows += [("one", 1, 2.0, 1), ("none", 1, None, 1)]
    df = spark.createDataFrame(rows, "g string, h int, v double, n long").repartition(7)
    got = selection.at_ranks(df, ["g", "h"], "v", RANKS, weight)
    assert got.columns == ["g", "h", *RANKS]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_no_rows_and_no_groups(spark):
    empty = spark.createDataFrame([], "g string, v long")
    assert selection.at_ranks(empty, ["g"], "v", RANKS).count() == 0
    assert tuple(selection.at_ranks(empty, [], "v", RANKS).first()) == (None,) * 5
    assert tuple(selection.at_ranks(spark.range(100, 0, -1), [], "id", RANKS).first()) == (1, 50, 51, 95, 100)


def test_one_group_is_spread_over_ranges(spark):
    """One group of 20,000 values: no window or aggregate has them in one partition."""
    df = spark.range(20_000).selectExpr("'g' AS g", "id * 7919 % 20011 AS v", "id AS sample_id")
    plan = selection.at_ranks(df, ["g"], "v", RANKS)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in text and "part_" in text
    values = sorted(r.v for r in df.collect())
    assert plan.first().p95 == values[18999]
    for windows in [line for line in text.splitlines() if "Window [" in line and "v_" in line]:
        assert "part_" in windows


def test_summaries_use_it(spark):
    rows = spark.createDataFrame([("m", True, True, 1.0), ("m", False, None, 4.0), ("m", True, None, 2.0), (None, True, False, 8.0)], "g string, ok boolean, v boolean, ms double")
    got = {r.g: (r.total, r.errors, r.n_true, r.n_null, r.latency_p50, r.latency_p95) for r in stats.method_summary(rows, "g", rows.ok, rows.v, "ms").collect()}
    assert got == {"m": (3, 1, 1, 1, 2.0, 4.0), None: (1, 0, 0, 0, 8.0, 8.0)}
    events = spark.createDataFrame([("m", "s", "1", "c", 1, True, 1, 2, 3, 10.0), ("m", None, "1", "c", 2, None, 1, 2, 3, 30.0)], "method string, stage string, sample_id string, logical_call_id string, http_attempt int, usage_available boolean, input_tokens long, output_tokens long, total_tokens long, latency_ms double")
    out = telemetry.benchmark_summary(events, spark.createDataFrame([("m", "success")], "method string, status string"))
    assert {(r.stage, r.p50_latency_ms, r.p95_latency_ms) for r in out.collect()} == {("s", 10.0, 10.0), (None, 30.0, 30.0), ("ALL", 10.0, 30.0)}
