"""Small literal fixtures for the corners where a plausible version goes wrong."""

from __future__ import annotations

import json
import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridal.functions import cells, jsons, scores, text
from veridal.operators import joins, latest, overlay, selection, similarity, stats, taxonomy, telemetry, validate
from veridal.sources import sinks, tables


def one(df, column="x"):
    return [r[column] for r in df.collect()]


def test_latest_is_by_position_after_the_filter(spark):
    rows = spark.createDataFrame([(1, "a", "3", "success"), (2, "a", "3", "error"), (3, "a", "2", "success")], "pos int, key string, version string, status string")
    last = latest.keep_latest(rows, ["key"], "pos", F.col("version") == "3").collect()
    assert [(r.pos, r.status) for r in last] == [(2, "error")]
    assert latest.ever_completed(rows, ["key"], (F.col("version") == "3") & (F.col("status") == "success")).count() == 1


def test_line_positions_order_a_file_of_many_splits(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text("\n".join(json.dumps({"n": i}) for i in range(5000)) + "\n\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        lines = tables.read_json_lines(spark, str(path))
        rows = tables.parse_json_lines(lines, T.StructType([T.StructField("n", T.LongType())])).orderBy("position").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.n for r in rows] == list(range(5000))


def test_bad_lines_are_fatal_or_left_out(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"n": 1}\n[2]\nnot json\n')
    schema = T.StructType([T.StructField("n", T.LongType())])
    lines = tables.read_json_lines(spark, str(path))
    assert tables.parse_json_lines(lines, schema, strict=False).count() == 1
    with pytest.raises(Exception, match="not a JSON object"):
        tables.parse_json_lines(lines, schema).collect()


def test_csv_keeps_its_header_and_quoted_breaks(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('﻿id,note\n1,"two\nlines ""quoted"""\n2,\n', encoding="utf-8")
    df = tables.read_delimited(spark, str(path), ",", ["id"])
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("1", 'two\nlines "quoted"'), ("2", None)]
    assert [r.note for r in sinks.blanks_for_nulls(df).orderBy("id").collect()][1] == ""
    with pytest.raises(tables.DataError):
        tables.read_delimited(spark, str(path), ",", ["absent"])


def test_three_null_like_states(spark):
    df = spark.createDataFrame([("",), ("none",), ("unknown",), ("a|b",), ("b|a",)], "c string").select(cells.decode_cell(F.col("c")).alias("x"), "c")
    assert one(df) == [None, [], ["unknown"], ["a", "b"], ["b", "a"]]
    assert one(df.select(cells.encode_cell(F.col("x")).alias("x"))) == ["", "none", "unknown", "a|b", "b|a"]
    pair = spark.createDataFrame([(["a", "b"], ["b", "a"]), (None, []), (None, None), ([], ["unknown"])], "a array<string>, b array<string>")
    assert one(pair.select(cells.same_answer(F.col("a"), F.col("b")).alias("x"))) == [True, False, True, False]


def test_bad_cells(spark):
    df = spark.createDataFrame([("a|a",), ("none|a",), ("a||b",), ("A",), ("a|b",), ("",)], "c string")
    assert one(df.select(cells.cell_violations(F.col("c"), ["a", "b"]).alias("x"))) == [["repeated"], ["none_mixed"], ["empty_code"], ["domain"], [], []]


def test_strict_json_types(spark):
    values = ['{"v": true}', '{"v": null}', '{"v": "true"}', '{"v": 1}', "{}", "[]", "oops"]
    df = spark.createDataFrame([(v,) for v in values], "t string")
    assert one(df.select(jsons.is_boolean_at(F.col("t"), "$.v", nullable=True).alias("x"))) == [True, True, False, False, False, False, False]
    assert one(df.select(jsons.has_exact_keys(F.col("t"), ["v"]).alias("x"))) == [True] * 4 + [False] * 3


def test_mentions_need_a_verdict_and_others_a_null(spark):
    rows = ['{"mentioned": true, "is_correct": true, "note": ""}', '{"mentioned": true, "is_correct": null, "note": ""}', '{"mentioned": false, "is_correct": null, "note": ""}', '{"mentioned": false, "is_correct": false, "note": ""}', '{"mentioned": false, "note": ""}']
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    assert one(df.select(validate.attribute_check(F.col("t")).alias("x"))) == [[], ["verdict"], [], ["verdict"], ["keys", "verdict"]]


def test_overrides_are_checked(spark):
    good = {"sample_id": "1", "method": "g3", "caption": None, "attributes": {"age": {"is_correct": None}}}
    bad = [{**good, "method": "g9"}, {**good, "caption": {"is_correct": "true"}}, {**good, "attributes": {"x": {"is_correct": True}}}, {**good, "extra": 1}, {**good, "attributes": {"age": {"is_correct": 1}}}]
    df = spark.createDataFrame([(json.dumps(v),) for v in [good, *bad]], "t string")
    assert one(df.select(validate.override(F.col("t"), ["g3", "g4"], ["age"]).alias("x"))) == [[], ["method"], ["caption"], ["attributes"], ["keys"], ["values"]]


def test_percentiles_differ_for_even_numbers(spark):
    for n in (1, 2, 20, 21):
        ranks = {"low": selection.LOW_MIDDLE, "high": selection.HIGH_MIDDLE, "r": selection.nearest(0.5), "q": selection.nearest(0.95)}
        row = selection.at_ranks(spark.range(1, n + 1), [], "id", ranks).first()
        assert ((row.low + row.high) / 2, row.r, row.q) == ((n + 1) / 2, (n + 1) // 2, -(-n * 19 // 20))


def test_rates_without_denominator_are_not_zero(spark):
    df = spark.createDataFrame([(0, 0), (1, 8), (13, 16)], "c long, n long")
    assert one(df.select(text.percent_text(F.col("c"), F.col("n")).alias("x"))) == ["—", "12.5%", "81.2%"]
    assert one(df.select(stats.rate(F.col("c"), F.col("n") - F.col("c")).alias("x")))[0] is None


def test_absent_null_and_given_corrections(spark):
    rows = spark.createDataFrame([("g3", str(i)) for i in range(3)], "method string, sample_id string")
    fixes = spark.createDataFrame([("g3:1", True, {"age": None}), ("g3:2", False, {"age": True})], "key string, caption_correct boolean, attributes map<string,boolean>")
    out = overlay.with_overrides(rows, fixes).orderBy("sample_id").select(overlay.human_caption(F.col("override_caption_correct")).alias("c"), overlay.human_attribute(F.col("override_attributes"), F.lit("age")).alias("a"), overlay.human_attribute(F.col("override_attributes"), F.lit("hat")).alias("h"))
    assert [tuple(r) for r in out.collect()] == [("", "", ""), ("true", "null", ""), ("false", "true", "")]


def test_stage_rows_repeat_the_methods_cases_and_null_calls_count(spark):
    events = spark.createDataFrame([("g3", "a", "1", "x", 1, True, 5.9, None, None, 10.0), ("g3", "b", "1", None, 2, False, 7.0, 1, 1, 30.0), ("g3", "b", "2", None, 1, None, None, None, None, 20.0)],
        "method string, stage string, sample_id string, logical_call_id string, http_attempt int, usage_available boolean, input_tokens double, output_tokens long, total_tokens long, latency_ms double")
    cases = spark.createDataFrame([("g3", "success"), ("g3", "error")], "method string, status string")
    rows = {r.stage: r for r in telemetry.benchmark_summary(events, cases).collect()}
    assert {s: (r.submitted_cases, r.successful_cases, r.logical_model_calls) for s, r in rows.items()} == {"ALL": (2, 1, 3), "a": (2, 1, 1), "b": (2, 1, 2)}
    assert (rows["ALL"].input_tokens, rows["b"].input_tokens, rows["ALL"].http_retry_requests, rows["ALL"].p50_latency_ms) == (5, 0, 1, 20.0)


def test_case_tokens_are_null_without_usage(spark):
    events = spark.createDataFrame([("a", 1, None, None), ("b", 2, 3, None)], "k string, n int, p long, c long")
    out = telemetry.case_counters(events, ["k"], F.col("n"), F.lit(False), F.col("p"), F.col("c")).orderBy("k").collect()
    assert [(r.num_retry, r.input_token, r.output_token) for r in out] == [(0, None, None), (1, 3, 0)]


def test_a_stamp_of_exactly_the_window_is_out(spark):
    rows = spark.createDataFrame([(0.0,), (59.999,), (60.0,)], "s double").select(F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"))
    assert sorted(one(latest.rolling_count(rows, "ts", 60), "in_window")) == [1, 2, 2]


def test_must_match_joins_fail_when_they_run(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(Exception, match="no partner"):
        joins.required_join(left, right, ["k"]).collect()
    with pytest.raises(Exception, match="repeated"):
        joins.unique_by(left.unionByName(left), ["k"]).collect()
    with pytest.raises(Exception, match="not exactly one"):
        joins.single_value(left, "k").collect()


def test_ties_follow_positions(spark):
    d = spark.createDataFrame([("f", "m1", 0, 30, 10), ("f", "m2", 1, 30, 10), ("f", "m3", 2, 3, 1), ("g", "m1", 0, 0, 0)], "field string, method string, position int, correct long, incorrect long")
    out = {r.field: (r.best, r.best_support, r.conclusion) for r in stats.decision(d, "field", "method", "position").collect()}
    assert out == {"f": ("m1, m2, m3", 40, "Ba luồng gần tương đương."), "g": ("", None, "Chưa có dữ liệu để kết luận.")}


def test_taxonomy_tiles_and_labels(spark):
    schema = spark.createDataFrame([(0, "age", "single", ["young_adult", "elderly"]), (1, "bag_color", "multi", ["red", "none_visible"])], "position int, name string, kind string, classes array<string>")
    compiled = taxonomy.compile_attributes(schema, {"age": "weak", "bag_color": "unvalidated"})
    assert [(r.start, r.stop, r.filterable) for r in compiled.orderBy("position").collect()] == [(0, 2, False), (2, 4, True)]
    assert taxonomy.taxonomy_violations(compiled, 2, 4).count() == 0
    assert [(r.name, r.violations) for r in taxonomy.taxonomy_violations(compiled, 2, 5).collect()] == [("*", ["totals"])]
    labels = taxonomy.class_index(compiled, {"young_adult": "Young adult"}, {"bag_color": "{label} bag"}, {"bag_color": {"none_visible"}})
    assert [r.label for r in labels.orderBy("logit_index").collect()] == ["Young adult", "Elderly", "Red bag", "None visible"]
    assert sum(s for _, _, s, _ in taxonomy.ATTRIBUTES) == 200 and len(taxonomy.ATTRIBUTES) == 21


def test_decoding_ties_thresholds_and_overflow(spark):
    slices = taxonomy.slices_of([("a", "single", 3), ("b", "multi", 2)])
    df = spark.createDataFrame([([5.0, 5.0, 1.0, 0.0, -20.0],), ([1e4, -1e4, 0.0, -1e4, -1e4],)], "v array<double>")
    rows = taxonomy.decode(df, "v", slices, 0.5).collect()
    assert [r.a.class_index for r in rows] == [0, 0] and rows[1].a.confidence == 1.0
    assert [[c.class_index for c in r.b] for r in rows] == [[0], []]
    bad = spark.createDataFrame([([1.0, float("nan")],), ([1.0],), ([1.0, 2.0],)], "v array<double>")
    assert one(bad.select(validate.logits(F.col("v"), 2).alias("x"))) == [["finite"], ["size"], []]


def test_boxes(spark):
    def box(*v):
        return spark.range(1).select(scores.box_crop(*[F.lit(x) for x in v]).alias("b")).first().b

    assert (lambda b: (b.right - b.left, b.bottom - b.top))(box(10.4, 10.6, 50.2, 50.9, 100, 100)) == (41, 41)
    assert (lambda b: (b.right - b.left, b.bottom - b.top))(box(0.25, 0.5, 0.75, 1.0, 200, 400)) == (100, 200)
    assert box(5.0, 5.0, 5.0, 9.0, 10, 10) is None and box(float("nan"), 0.0, 1.0, 1.0, 10, 10) is None


def test_canonical_text(spark):
    values = {"Red-Shirt, MAN!": "redshirt man", "t_shirt  a\t\nb": "t shirt a b", "Áo Đỏ": "áo đỏ", "a &amp;amp; b": "a b", "?!.": "", "  x ": "x"}
    df = spark.createDataFrame([(k,) for k in values], "t string")
    assert one(df.select(text.canonical_text(F.col("t")).alias("x"))) == list(values.values())
    assert one(spark.createDataFrame([("caf&eacute;",)], "t string").select(text.unescape_all("t").alias("x"))) == ["café"]
    assert one(spark.createDataFrame([("cafÃ©",), ("café",)], "t string").select(text.repair_mojibake(F.col("t")).alias("x"))) == ["café", "café"]


def test_small_text_functions(spark):
    row = spark.range(1).select(
        text.service_url(F.lit("http://x/")).alias("u"), text.parse_boolean(F.lit(" On ")).alias("b"), text.dotenv_pair(F.lit("A = 'x=y'")).alias("d"), text.mime_type(F.lit("a/b.PNG")).alias("m"),
        text.error_code(F.lit("Bad Answer: no")).alias("e"), scores.retry_delay(F.lit(2), F.lit("99")).alias("r"), scores.retry_delay(F.lit(2), F.lit(None).cast("string")).alias("q"),
    ).first()
    assert (row.u, row.b, tuple(row.d), row.m, row.e, row.r, row.q) == ("http://x/v1", True, ("A", "x=y"), "image/png", "bad_answer", 30.0, 2.0)
    assert [text.column_letters(n) for n in (1, 26, 27, 703)] == ["A", "Z", "AA", "AAA"]


def test_many_queries_meet_all_items_in_blocks(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(3)], "query_id long, vector array<double>")
    items = v.withColumnRenamed("query_id", "item_id")
    assert similarity.top_matches(v, items, 2).count() == 6
    many = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(60)], "query_id long, vector array<double>")
    want = {tuple(r) for r in similarity.top_matches(many, items, 2).collect()}
    assert {tuple(r) for r in similarity.top_matches(many, items, 2, most_queries=25).collect()} == want and len(want) == 120


def test_best_matches_of_ties_and_odd_vectors(spark):
    rng = random.Random(5)
    plain = [[float(rng.randint(-2, 2)) / 3 for _ in range(5)] for _ in range(120)]
    odd = [None, [], [1.0] * 4, [1.0, None, 1.0, 1.0, 1.0], [1e200] * 5, [float("inf"), 1.0, 1.0, 1.0, 1.0], [0.1] * 6]
    rows = list(enumerate(plain + plain[:40] + odd + plain[:3]))
    rng.shuffle(rows)

    def dot(a, b):
        if a is None or b is None or len(a) != len(b) or None in a + b:
            return None
        total = 0.0
        for x, y in zip(a, b, strict=True):
            total += x * y
        return total

    def best(queries, k):
        found = set()
        for q, v in queries:
            scored = sorted(((s is None, s == s, 0.0 if s is None or s != s else -s, i, s) for i, w in rows for s in [dot(v, w)]), key=lambda t: t[:4])  # NaN is the largest
            found |= {(q, i, s, n + 1) for n, (*_, i, s) in enumerate(scored[:k])}
        return {(q, i, str(s), n) for q, i, s, n in found}

    items = spark.createDataFrame(rows, "item_id long, vector array<double>").repartition(3)
    for queries in (rows[:60], [r for r in rows if r[1] in odd], rows[:0]):
        frame = spark.createDataFrame(queries, "query_id long, vector array<double>")
        for k in (1, 4, 400):
            got = similarity.top_matches(frame, items, k, most_queries=25).collect()
            assert len(got) == len(queries) * min(k, len(rows)) and {(r.query_id, r.item_id, str(r.score), r.place) for r in got} == best(queries, k)


def test_matches_take_no_row_a_pair(spark):
    """90 million pairs, too many for a row each in this time."""
    items = spark.range(30_000).select(F.col("id").alias("item_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin(i * F.col("id")).cast("float")).alias("vector"))
    queries = items.filter("item_id % 10 = 0").withColumnRenamed("item_id", "query_id")
    begun = time.perf_counter()
    assert similarity.top_matches(queries, items, 5).count() == 15_000
    assert time.perf_counter() - begun < 45


def test_files_are_replaced_whole(spark, tmp_path):
    target = tmp_path / "out.csv"
    sinks.write_small_csv(spark.createDataFrame([("2", None), ("10", "é")], "id string, v string").orderBy("id"), str(target))
    assert target.read_text(encoding="utf-8") == "﻿id,v\n10,é\n2,\n" or target.read_bytes().decode() == "﻿id,v\r\n10,é\r\n2,\r\n"
    assert [p.name for p in tmp_path.iterdir()] == ["out.csv"]
    sinks.append_json_lines(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).first().value == '{"a":1,"b":null}'
    with pytest.raises(Exception, match="(?i)already exists"):
        sinks.write_new(spark.range(1), str(tmp_path / "log"))
