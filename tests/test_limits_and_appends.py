"""The rolling limiter over shuffled chunks and micro-batches, bounded calls, commits that survive a kill, and paths."""

from __future__ import annotations

import json
import posixpath
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from veridal.operators import stages, workflows
from veridal.sources import sinks, tables
from veridal.streaming import streams

SCHEMA = "key string, request_id long, asked_us long"


def brute_plan(rows, cap, window):
    out = []
    for key in {r[0] for r in rows}:
        begun = []
        for asked, request in sorted((r[2], r[1]) for r in rows if r[0] == key):
            at = asked
            while sum(at - window < b <= at for b in begun) >= cap or begun and at < begun[-1]:
                at = max(at + 1 if not begun else begun[-1], min((b + window for b in begun if at - window < b <= at), default=at) if sum(at - window < b <= at for b in begun) >= cap else begun[-1])
            begun.append(at)
            out.append((key, request, asked, at))
    return sorted(out)


@pytest.mark.parametrize("cap", [1, 3])
def test_the_streamed_limiter_equals_brute_force(spark, tmp_path, cap):
    """Rows of a key come in any order within and across micro-batches, but within the lateness."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    rng = random.Random(cap)
    rows = [(rng.choice("aab"), i, 1_000_000 * (1_000 + rng.randrange(0, 240))) for i in range(150)]
    end = [("a", 9_000, 10**6 * 90_000), ("b", 9_001, 10**6 * 90_000)]
    try:
        source = tmp_path / "in"
        source.mkdir()
        batches = [rows[0::3], rows[1::3], rows[2::3], end, [("z", 9_002, 10**6 * 180_000)]]
        for k, part in enumerate(batches):
            (source / f"{k}.json").write_text("".join(json.dumps({"key": a, "request_id": b, "asked_us": c}) + "\n" for a, b, c in part))
            time.sleep(0.02)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source)).withColumn("asked", F.timestamp_micros("asked_us"))
        plan = streams.admission_plan(stream, "asked", cap, seconds=60, late="1 hour")
        q = plan.writeStream.format("memory").queryName(f"plan{cap}").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        got = sorted(tuple(r) for r in spark.table(f"plan{cap}").collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = [r for r in got if r[1] < 9_000]
    assert got == brute_plan(rows, cap, 60_000_000)
    for key in "ab":
        starts = sorted(r[3] for r in got if r[0] == key)
        assert all(b - a >= 60_000_000 for a, b in zip(starts, starts[cap:], strict=False))


def test_bounded_calls_lose_nothing_and_take_no_more_than_they_may():
    taken, open_now, most = [], [], []
    lock = threading.Lock()

    def items():
        for i in range(40):
            taken.append(i)
            yield i

    def work(i):
        with lock:
            open_now.append(i)
            most.append(len(open_now))
        time.sleep(0.001 * (i % 5))
        with lock:
            open_now.remove(i)
        return i

    got, ahead = [], []
    for i in stages.bounded_calls(items(), work, 3):
        got.append(i)
        ahead.append(len(taken) - len(got))
    assert sorted(got) == list(range(40)) and max(most) <= 3 and max(ahead) <= 3
    assert list(stages.bounded_calls([], work, 3)) == [] and list(stages.bounded_calls([7], work, 3)) == [7]
    with pytest.raises(ValueError, match="worker"):
        list(stages.bounded_calls([1], work, 0))
    with pytest.raises(ZeroDivisionError):
        list(stages.bounded_calls([1, 0, 2], lambda x: 1 // x, 2))


def test_a_stage_with_workers_gives_what_one_without_gives(spark):
    rows = spark.range(300).select(F.col("id").cast("string").alias("sample_id"), F.when(F.col("id") % 17 == 0, "before: failed").alias("error")).repartition(3)

    def model(prompts):
        if any(p.endswith("3") for p in prompts):
            raise TimeoutError("no answer")
        return ["" if p.endswith("4") else p + "!" for p in prompts]

    def run(workers):
        stage = stages.Stage("draft", lambda df: F.col("sample_id"), model, workers=workers)
        return sorted((r.sample_id, r.draft, r.error) for r in stages.call(rows, stage).select("sample_id", "draft", "error").collect())

    assert run(1) == run(4)


def test_an_answer_is_held_against_other_columns(spark):
    rows = spark.createDataFrame([("1", "x"), ("2", "y")], "sample_id string, other string")
    stage = stages.Stage("echo", lambda df: F.col("other"), lambda prompts: ["x" for _ in prompts], valid=lambda a, other: a == other, beside=["other"], refused="not the other")
    assert {r.sample_id: r.error for r in stages.call(rows, stage).collect()} == {"1": None, "2": "echo: not the other"}


def test_only_what_failed_is_asked_again():
    asked = []

    def model(prompts):
        asked.append(list(prompts))
        return ["ok" if p == "a" or len(asked) > 1 else "" for p in prompts]

    stage = stages.Stage("s", None, model, attempts=2)
    assert stages._judged(stage, [("a", ()), ("b", ())]) == [("ok", None), ("ok", None)] and asked == [["a", "b"], ["b"]]


QUESTIONS = json.dumps({"questions": [{"id": "1", "target": "bag", "question": "which?"}, {"id": "2", "target": "hat", "question": "any?"}]})
ANSWER = {"question_id": "1", "answer": "a", "evidence": "b", "determinable": False}


def test_questions_as_they_must_be():
    assert workflows.is_questions(QUESTIONS) and workflows.is_questions(QUESTIONS[:-1] + ', "more": 1}')
    one = {"id": "1", "target": "t", "question": "q"}
    for bad in ([], [{**one, "target": " "}], [{**one, "more": "x"}], [{"id": "1", "question": "q"}], [one, one], [{**one, "id": 1}], "x", None):
        assert not workflows.is_questions(json.dumps({"questions": bad}))
    assert not workflows.is_questions("[]") and not workflows.is_questions("no") and not workflows.is_questions("")


def test_answers_as_they_must_be():
    both = [ANSWER, {**ANSWER, "question_id": "2"}]
    assert workflows.is_answers(json.dumps({"answers": both}), QUESTIONS) and workflows.is_answers(json.dumps({"answers": both[::-1] + both}), QUESTIONS)
    for bad in ([ANSWER], [*both, {**ANSWER, "question_id": "3"}], [{**x, "determinable": "yes"} for x in both], [{**x, "evidence": ""} for x in both], [{**x, "more": "x"} for x in both], [{k: v for k, v in x.items() if k != "evidence"} for x in both], None):
        assert not workflows.is_answers(json.dumps({"answers": bad}), QUESTIONS)


def test_a_commit_counts_whole_and_once(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string")
    assert sinks.read_commits(spark, path, "id long, text string").count() == 0
    assert sinks.append_commit(rows, path, "run1") and not sinks.append_commit(rows, path, "run1")
    failing = rows.withColumn("text", F.when(F.col("id") == 2, F.raise_error(F.lit("killed"))).otherwise("b")).repartition(2)
    with pytest.raises(Exception, match="killed"):
        sinks.append_commit(failing, path, "run2")
    (tmp_path / "log" / "run3").mkdir()
    (tmp_path / "log" / "run3" / "part-0").write_text('{"id": 99, "text": "left by a kill"}\n')
    assert sinks.committed_runs(spark, path) == ["run1"]
    assert sinks.append_commit(rows, path, "run3")
    got = sorted((r.id, r.text) for r in sinks.read_commits(spark, path, "id long, text string").collect())
    assert got == [(1, "a"), (1, "a"), (2, None), (2, None)]


def test_a_stream_that_is_killed_appends_each_row_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for k in range(4):
        (source / f"{k}.json").write_text("".join(json.dumps({"id": 10 * k + i}) + "\n" for i in range(10)))
        time.sleep(0.02)
    flag = tmp_path / "mended"

    def stream(breaks):
        rows = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).json(str(source))
        return rows.withColumn("id", F.when((F.col("id") == 25) & F.lit(breaks), F.raise_error(F.lit("killed")).cast("long")).otherwise(F.col("id")))

    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "c")
    with pytest.raises(Exception, match="killed"):
        streams.durable_append(stream(True), out, checkpoint).awaitTermination()
    assert sorted(r.id for r in spark.read.json(out).collect()) == list(range(20)) and not flag.exists()
    for _ in range(2):
        streams.durable_append(stream(False), out, checkpoint).awaitTermination()
        assert sorted(r.id for r in spark.read.json(out).collect()) == list(range(40))


def test_paths_resolve_as_the_standard_library_has_it(spark):
    rng = random.Random(2)
    paths = ["", ".", "/", "//", "///", "..", "/..", "a/..", "a/../..", "//a//b/.", "///a/../../b", "é/./ü"]
    paths += ["/".join(rng.choice(["a", "b", "..", ".", ""]) for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    df = spark.createDataFrame([(p,) for p in paths] + [(None,)], "p string")
    for root in ("/data/root", "/"):
        for r in df.select("p", tables.resolved_path(F.col("p")).alias("x"), tables.stays_below(F.col("p"), root).alias("below")).collect():
            if r.p is None:
                assert r.x is None and r.below is None
                continue
            assert r.x == posixpath.normpath(r.p), r.p
            whole = posixpath.normpath(posixpath.join(root, r.p))
            assert r.below == (whole == root or whole.startswith(root.rstrip("/") + "/")), r.p
