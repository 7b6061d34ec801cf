"""Workflows over stub models, and streams against their batch twins."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from veridal.operators import latest, stages, telemetry
from veridal.streaming import streams


def echo(name, answer):
    return stages.Stage(name, lambda df: F.concat(F.lit(f"{name}:"), F.coalesce("sample_id", F.lit(""))), lambda prompts: [answer(p) for p in prompts])


def test_a_failed_row_is_kept_and_skips_later_stages(spark):
    rows = spark.createDataFrame([("1",), ("2",)], "sample_id string")
    first = echo("draft", lambda p: "" if p.endswith("2") else "a cap")
    out = {r.sample_id: r for r in stages.flow(rows, [first, echo("translate", lambda p: "vi")]).collect()}
    assert (out["1"].status, out["1"].draft, out["1"].translate) == ("success", "a cap", "vi")
    assert (out["2"].status, out["2"].translate, out["2"].error) == ("error", None, "draft: invalid answer")
    records = stages.prediction_rows(stages.flow(rows, [first]), "g1", "m", "v1", F.col("draft"), F.lit("{}")).collect()
    assert {r.sample_id: r.error and r.error.code for r in records} == {"1": None, "2": "draft"}


def test_observers_are_gathered_in_order(spark):
    rows = spark.createDataFrame([("1",), ("2",)], "sample_id string")
    stage = stages.Stage("observer", lambda df: F.concat("sample_id", F.lit("/"), "focus"), lambda prompts: list(prompts))
    out = stages.fan_out(rows, stage, ["top", "shoes", "bag"]).orderBy("sample_id").collect()
    assert [r.observers for r in out] == [["1/top", "1/shoes", "1/bag"], ["2/top", "2/shoes", "2/bag"]]


def test_rounds_go_on_for_open_rows_only(spark):
    rows = spark.createDataFrame([("1",), ("2",), ("3",)], "sample_id string")
    draft = stages.Stage("draft", lambda df: F.concat("sample_id", F.lit("|"), F.coalesce("feedback", F.lit("-"))), lambda prompts: list(prompts))
    verdict = stages.Stage("verdict", lambda df: F.col("draft"), lambda prompts: ["accept" if p.startswith("1|") or (p.startswith("2|") and "fix" in p) else "reject" for p in prompts])
    out = stages.refine(rows, [draft, verdict], F.col("verdict") == "accept", 3, F.lit("fix"), "rejected_after_max_attempts")
    assert {r.sample_id: (r.workflow_status, r.rounds) for r in out.collect()} == {"1": ("accepted", 1), "2": ("accepted", 2), "3": ("rejected_after_max_attempts", 3)}


def run(df, name, mode, spark, checkpoint):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@pytest.fixture(scope="module")
def event_files(spark, sf_dir, tmp_path_factory):
    path = tmp_path_factory.mktemp("events")
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(4).write.mode("overwrite").parquet(str(path))
    return str(path)


def test_streamed_latest_equals_batch(spark, event_files, tmp_path):
    batch = spark.read.parquet(event_files)
    stream = streams.stream_of(spark, event_files, batch.schema, files_a_batch=1)
    got = run(streams.latest_stream(stream, ["user_id", "event_type"], "event_id", ["value"]), "latest_rows", "complete", spark, tmp_path)
    want = latest.keep_latest(batch, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_streamed_counters_equal_batch(spark, event_files, tmp_path):
    batch = spark.read.parquet(event_files).withColumn("attempt", F.col("event_id") % 3).withColumn("bad", F.col("event_type") == "error")
    stream = streams.stream_of(spark, event_files, spark.read.parquet(event_files).schema, files_a_batch=1)
    stream = stream.withColumn("attempt", F.col("event_id") % 3).withColumn("bad", F.col("event_type") == "error")
    got = run(streams.case_counters_stream(stream, ["user_id"], "attempt", "bad"), "counters", "complete", spark, tmp_path)
    none = F.lit(None).cast("long")
    want = telemetry.case_counters(batch, ["user_id"], F.col("attempt"), F.col("bad"), none, none).select("user_id", "num_request", "num_retry", "num_error_request")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_streamed_sessions_equal_batch(spark, event_files, tmp_path):
    batch = streams.utc(spark.read.parquet(event_files), "ts")
    stream = streams.utc(streams.stream_of(spark, event_files, spark.read.parquet(event_files).schema), "ts")
    got = run(streams.session_counts(stream, "ts", ["user_id"], "30 minutes", "1 day"), "sessions", "complete", spark, tmp_path)
    want = batch.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
