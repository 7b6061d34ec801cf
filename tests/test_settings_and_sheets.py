"""Settings, workbooks, reports, runs, vectors and sessions: what only the driver sees."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
import zipfile

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from veridal.functions import cells, jsons, settings, text
from veridal.operators import encoders, filters, latest, overlay, reports, stats, telemetry
from veridal.sources import sinks, tables, workbooks

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
FULL = {"VLLM_BASE_URL": "https://h/v1", "VLLM_CLIENT_ID": "i", "VLLM_CLIENT_SECRET": "s", "VLLM_PROJECT_ID": "p"}
G5 = settings.generator("G5", "medium")


# --- settings ---


def test_where_a_setting_comes_from():
    got = settings.load(G5, FULL | {"VLLM_MAX_TOKENS": " 99 ", "VLLM_MODEL": "large"}, "VLLM_MAX_TOKENS=77\n# no\n\nVLLM_MAX_RETRIES = '9'\n", {"VLLM_TIMEOUT_SECONDS": 5, "VLLM_CLIENT_ID": None})
    assert (got["VLLM_MAX_TOKENS"], got["VLLM_MAX_RETRIES"], got["VLLM_TIMEOUT_SECONDS"], got["VLLM_CLIENT_ID"]) == (99, 9, 5.0, "i")
    assert (got["G5_MODEL"], got["VLLM_MAX_REQUESTS_PER_MINUTE"], got["VLLM_ENABLE_THINKING"]) == ("medium", 150, True)


@pytest.mark.parametrize(
    "wrong",
    [{"VLLM_BASE_URL": "h"}, {"VLLM_CLIENT_SECRET": " "}, {"G5_MODEL": ""}, {"VLLM_TIMEOUT_SECONDS": "0"}, {"VLLM_TIMEOUT_SECONDS": "nan"}, {"VLLM_MAX_TOKENS": "63"}, {"VLLM_MAX_TOKENS": "1.5"},
     {"VLLM_MAX_RETRIES": "0"}, {"VLLM_MAX_REQUESTS_PER_MINUTE": "0"}, {"VLLM_ENABLE_THINKING": "perhaps"}, {"VLLM_MAX_TOKENS": ""}],
)
def test_settings_that_are_refused(wrong):
    with pytest.raises(settings.SettingsError):
        settings.load(G5, FULL | wrong)


def test_the_bounds_themselves_are_taken():
    got = settings.load(G5, FULL | {"VLLM_MAX_TOKENS": "64", "VLLM_MAX_RETRIES": "1", "VLLM_TIMEOUT_SECONDS": "0.1", "VLLM_ENABLE_THINKING": "OFF"})
    assert (got["VLLM_MAX_TOKENS"], got["VLLM_MAX_RETRIES"], got["VLLM_ENABLE_THINKING"]) == (64, 1, False)
    judge = settings.load(settings.JUDGE, {"GEMINI_API_KEY": "k", "GEMINI_MAX_RETRIES": "0", "GEMINI_MAX_TOKENS": "256"})
    assert judge["GEMINI_MAX_RETRIES"] == 0
    for wrong in ({"GEMINI_API_KEY": ""}, {"GEMINI_API_KEY": "k", "GEMINI_MAX_TOKENS": "255"}, {"GEMINI_API_KEY": "k", "GEMINI_MAX_RETRIES": "-1"}):
        with pytest.raises(settings.SettingsError):
            settings.load(settings.JUDGE, wrong)


def test_a_settings_file_has_pairs_only():
    assert settings.dotenv("a=1\na = \"x=y\" \n#b=2\n  \nc=") == {"a": "x=y", "c": ""}
    for bad in ("a", "=1", " = 1"):
        with pytest.raises(settings.SettingsError, match="line 2"):
            settings.dotenv(f"x=1\n{bad}")


# --- workbooks ---


def sheet_of(path, n):
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        for name in z.namelist():
            ET.fromstring(z.read(name))
        return ET.fromstring(z.read(f"xl/worksheets/sheet{n}.xml"))


def cells_of(sheet):
    return {c.get("r"): "".join(c.itertext()) for c in sheet.iterfind(".//m:c", NS) if "".join(c.itertext())}


@pytest.fixture(scope="module")
def reviews(spark):
    check = "struct<mentioned: boolean, is_correct: boolean, note: string>"
    schema = f"""method string, sample_id string, filepath string, status string, caption_evaluation struct<is_correct: boolean, needs_human_review: boolean, note: string>,
        prediction struct<caption: string, caption_vi: string>, caption_attribute_evaluation map<string, {check}>, caption_attribute_summary struct<mentioned: int, correct: int, incorrect: int, not_mentioned: int, evaluated: int>,
        golden_attributes map<string, string>, latency_ms double, error struct<message: string>"""
    checks = {"hat": (True, False, "<no>"), "bag": (False, None, "")}
    rows = [(m, s, f"i/{s}", "success", (True, False, "n"), ("c & d", None), checks, (1, 0, 1, 1, 1), {"hat": '"red"'}, 5.0, None) for m, s in (("g4", "10"), ("g4", "9"), ("g3", "2"))]
    rows.append(("g4", "1", "i/1", "error", None, None, None, None, None, None, ("timeout",)))
    fixes = spark.createDataFrame([("g4:9", (False,), {"hat": (None,)})], "key string, caption struct<is_correct: boolean>, attributes map<string, struct<is_correct: boolean>>")
    fixes = fixes.select("key", F.lit(True).alias("caption_given"), F.col("caption.is_correct").alias("caption_correct"), F.transform_values("attributes", lambda _, v: v["is_correct"]).alias("attributes"))
    return overlay.with_overrides(spark.createDataFrame(rows, schema), fixes)


def test_the_evaluation_is_two_styled_sheets(reviews, tmp_path):
    (path,) = workbooks.write_evaluation(reviews, str(tmp_path))
    assert path.endswith("/evaluation_review_v3.xlsx")
    one, two = sheet_of(path, 1), sheet_of(path, 2)
    a, b = cells_of(one), cells_of(two)
    assert (a["F1"], a["A3"], a["B3"], a["C3"]) == ("Tất cả phương pháp — đánh giá caption", "Số mẫu: 4", "Thành công: 3", "Lỗi: 1")
    assert [a[f"A{r}"] for r in range(6, 10)] == ["2", "1", "9", "10"]  # by method, then by number
    assert ("D7" in a, a["D6"], a["P8"], a["O7"], "P6" in a) == (False, "true", "false", "timeout", False)
    hat, bag = sorted((5, 6), key=lambda r: b[f"E{r}"] != "hat")  # a map made from a dict has no order
    assert [b.get(f"{c}{hat}") for c in "AEFGHIJ"] == ["2", "hat", "1", '"red"', "false", "Có nhắc nhưng không khớp nhãn", "<no>"]
    assert (b[f"I{bag}"], b[f"H{bag}"]) == ("Không nhắc (không tính lỗi)", "null")
    assert [b.get(f"K{r}") for r in (7, 8) if b[f"E{r}"] == "hat"] == ["null"]
    assert len([k for k in b if k.startswith("E")]) == 7  # a header and two fields of three
    pane = one.find(".//m:pane", NS)
    assert (pane.get("ySplit"), pane.get("xSplit"), pane.get("topLeftCell")) == ("5", "2", "C6")
    assert one.find(".//m:sheetView", NS).get("showGridLines") == "0"
    assert [r.get("sqref") for r in one.iterfind("m:conditionalFormatting", NS)] == ["D6:D9", "P6:P9"]
    assert [r.get("sqref") for r in two.iterfind("m:conditionalFormatting", NS)] == ["D5:D10", "H5:H10", "K5:K10"]
    assert [f.text for f in one.iterfind(".//m:formula", NS)][:3] == ['"true"', '"false"', '"null"']
    assert [float(c.get("width")) for c in one.iterfind(".//m:col", NS)] == workbooks.CAPTION_WIDTHS
    heights = {r.get("r"): r.get("ht") for r in one.iterfind(".//m:row", NS)}
    assert (heights["5"], heights["6"]) == ("32", "72")
    styles = ET.fromstring(zipfile.ZipFile(path).read("xl/styles.xml"))
    used = {int(c.get("s")) for s in (one, two) for c in s.iterfind(".//m:c", NS)}
    assert max(used) < len(styles.findall("m:cellXfs/m:xf", NS)) and len(styles.findall("m:dxfs/m:dxf", NS)) == 3


def test_a_workbook_a_method_also_without_rows(reviews, tmp_path):
    paths = workbooks.write_evaluation(reviews, str(tmp_path), ["g3", "g4", "g5"])
    assert [p.rsplit("/", 1)[1] for p in paths] == [f"evaluation_review_{m}_v3.xlsx" for m in ("g3", "g4", "g5")]
    assert [cells_of(sheet_of(p, 1))["A3"] for p in paths] == ["Số mẫu: 1", "Số mẫu: 3", "Số mẫu: 0"]
    assert cells_of(sheet_of(paths[0], 1))["F1"].startswith("G3 — ") and not sheet_of(paths[2], 1).findall("m:conditionalFormatting", NS)
    with pytest.raises(ValueError, match="more than 2 rows"):
        workbooks.evaluation_sheets(reviews, "x", most_rows=2)


def test_a_csv_file_becomes_a_workbook(spark, tmp_path):
    source = tmp_path / "merged.csv"
    source.write_text('﻿sample_id,image_path,g3_status,g3_caption\n1,a.jpg,ok,"two\nlines, ""quoted"""\n2,b.jpg,,\n', encoding="utf-8")
    workbooks.csv_to_workbook(spark, str(source), str(tmp_path / "out" / "merged.xlsx"))
    sheet = sheet_of(tmp_path / "out" / "merged.xlsx", 1)
    found = cells_of(sheet)
    assert (found["A1"], found["D2"], found["A3"], "C3" in found) == ("sample_id", 'two\nlines, "quoted"', "2", False)
    assert [float(c.get("width")) for c in sheet.iterfind(".//m:col", NS)] == [10, 48, 12, 42]
    source.write_text("only\n1\n")
    with pytest.raises(tables.DataError):
        workbooks.csv_to_workbook(spark, str(source), str(tmp_path / "x.xlsx"))


def test_cells_hold_what_xml_cannot(tmp_path):
    workbooks.save_workbook({"a&b": workbooks.Sheet(["x"], [("\x00\x0b<&>\ud800",), (True,), (float("nan"),), (None,), (-0.5,)])}, str(tmp_path / "w.xlsx"))
    assert cells_of(sheet_of(tmp_path / "w.xlsx", 1)) == {"A1": "x", "A2": "<&>", "A3": "1", "A4": "nan", "A6": "-0.5"}
    for names in ({}, {"a/b": None}, {"x" * 32: None}, {"A": None, "a": None}):
        with pytest.raises(ValueError):
            workbooks.workbook_bytes(names)


# --- report, runs, vectors ---


def test_the_report_has_all_its_tables(spark):
    checks = {"hat": (True, True), "bag": (False, None)}
    rows = spark.createDataFrame(
        [("g3", "1", "success", None, True, 10.0, checks), ("g3", "2", "error", "timeout", None, None, None), ("g4", "1", "success", None, False, 30.0, {"hat": (True, False), "bag": (False, None)})],
        "method string, sample_id string, status string, error_code string, caption_correct boolean, latency_ms double, checks map<string, struct<mentioned: boolean, is_correct: boolean>>",
    )
    fields = spark.createDataFrame([(0, "hat"), (1, "bag")], "position int, field string")
    corrected = spark.createDataFrame([("g3", 2, 5)], "method string, corrected_rows long, corrected_fields long")
    found = reports.evaluation_tables(rows, fields, ["g3", "g4"], corrected)
    assert {r.method: (r.mentioned, r.correct, r.coverage) for r in found["attributes"].collect()} == {"g3": (1, 1, 0.5), "g4": (1, 0, 0.5)}
    assert [(r.method, r.code, r[2]) for r in found["errors"].collect()] == [("g3", "timeout", 1)]
    compared = {r.field: r for r in found["compared"].collect()}
    assert compared["hat"].g3 == "1/1 (100.0%)" and compared["hat"].g4 == "0/1 (0.0%)" and compared["hat"].conclusion == stats.DECISION_TEXTS["few"]
    page = reports.report_text("Report", found)
    assert page.startswith("# Report\n\n## Summary\n\n| method") and page.endswith("|\n") and page.count("\n## ") == 6


def test_a_run_is_summed_up_last_and_not_overwritten(spark, tmp_path):
    folder = f"file://{tmp_path}/run"
    schema = "id long, status string, model_calls int, http_attempts int, latency_ms double"
    rows = spark.createDataFrame([(1, "success", 1, 2, 8.0), (2, "error", 0, 0, None), (3, None, 1, 4, 9.0)], schema)
    summary = sinks.write_run(rows, folder)
    assert summary == {"num_inputs": 3, "success_count": 1, "error_count": 2, "model_calls": 2, "http_attempts": 6, "latency_ms_success": {"mean": 8.0, "min": 8.0, "max": 8.0}}
    assert json.loads(spark.read.text(f"{folder}/summary").first()[0]) == summary
    with pytest.raises(FileExistsError):
        sinks.write_run(rows.limit(1), folder)
    assert spark.read.text(f"{folder}/predictions").count() == 3
    assert sinks.write_run(rows.filter("id = 2"), folder, overwrite=True)["latency_ms_success"] is None
    assert json.loads(spark.read.text(f"{folder}/summary").first()[0])["num_inputs"] == 1
    with pytest.raises(PySparkException):  # a run that is stopped has rows at most, and no old summary
        sinks.write_run(rows.withColumn("id", F.when(F.col("id") == 3, F.raise_error("stop").cast("long")).otherwise(F.col("id"))), folder, overwrite=True)
    assert not (tmp_path / "run" / "summary").exists()
    empty = telemetry.run_summary(rows.limit(0)).first()
    assert tuple(empty) == (0, 0, 0, 0, 0, None)


def test_vectors_go_to_one_file_in_order(spark, tmp_path):
    rows = spark.range(50).select((49 - F.col("id")).alias("n"), F.array(*[(F.col("id") * k / 3).cast("float") for k in range(4)]).alias("v")).repartition(5)
    path = str(tmp_path / "v.npy")
    assert sinks.write_npy(rows, "v", path, "n") == 50
    found = np.load(path)
    assert found.dtype == np.float32 and np.array_equal(found, np.float32([[(49 - i) * k / 3 for k in range(4)] for i in range(50)]))
    assert sinks.write_npy(rows.limit(0), "v", path, "n") == 0 and np.load(path).shape == (0, 0)
    for bad in (rows.withColumn("v", F.when(F.col("n") == 3, F.array(F.lit(1.0))).otherwise(F.col("v"))), rows.withColumn("v", F.when(F.col("n") > 3, F.col("v")))):
        with pytest.raises(ValueError):
            sinks.write_npy(bad, "v", path, "n")
    with pytest.raises(ValueError):
        sinks.write_npy(rows, "v", path, "n", most_rows=49)


# --- a session over a model file ---


def _proto(*fields):
    """Fields of a protocol buffer: numbers below 128 and bytes."""
    return b"".join(bytes([n << 3, v]) if isinstance(v, int) else bytes([n << 3 | 2, len(v)]) + v for n, v in fields)


@pytest.fixture(scope="module")
def model_file(tmp_path_factory):
    """A model that gives back what it gets: any number of rows of three floats."""
    shape = _proto((1, _proto((2, b"n"))), (1, _proto((1, 3))))
    put = lambda name: _proto((1, name), (2, _proto((1, _proto((1, 1), (2, shape))))))
    graph = _proto((1, _proto((1, b"x"), (2, b"y"), (4, b"Identity"))), (2, b"g"), (11, put(b"x")), (12, put(b"y")))
    path = tmp_path_factory.mktemp("model") / "same.onnx"
    path.write_bytes(_proto((1, 8), (7, graph), (8, _proto((1, b""), (2, 13)))))
    return str(path)


def test_a_model_file_encodes_a_column(spark, model_file):
    wanted = {"x": ("tensor(float)", [None, 3])}
    rows = spark.range(40).select(F.col("id"), F.when(F.col("id") % 7 != 0, F.array(F.col("id").cast("float"), F.lit(3.0), F.lit(4.0))).alias("v")).repartition(3)
    out = encoders.encode(rows, "v", lambda vs: np.float32(vs), lambda: encoders.onnx_session(model_file, "cpu", 1, wanted), batch=4).collect()
    assert len(out) == 40
    for r in out:
        assert r.vector is None if r.v is None else np.allclose(r.vector, np.array(r.v) / np.linalg.norm(r.v), atol=1e-6)


def test_model_files_that_are_refused(model_file, tmp_path):
    bad = tmp_path / "bad.onnx"
    bad.write_bytes(b"no model")
    for refused in (lambda: encoders.onnx_session(str(tmp_path / "none.onnx")), lambda: encoders.onnx_session(str(bad)), lambda: encoders.onnx_session(model_file, threads=0), lambda: encoders.onnx_session(model_file, "cuda"),
                    lambda: encoders.onnx_session(model_file, "cpu", outputs={"y": ("tensor(float16)", [None, 3])}), lambda: encoders.onnx_session(model_file, "cpu", inputs={"z": ("tensor(float)", [None, 3])})):
        with pytest.raises(encoders.EncoderError):
            refused()


# --- logs, forms, JSON ---


def test_both_readers_of_the_log(spark, tmp_path):
    row = lambda **k: json.dumps({"evaluation_schema_version": "3"} | k)
    lines = [row(method="g1", sample_id="7", at=1), row(method="g1", sample_id=7, at=2), row(method="x", sample_id="7", at=3), row(method="g1", at=4), row(method="g1", sample_id=None, at=5), "", row(method="g1", sample_id="7", at=6, evaluation_schema_version=3), row(method=None, sample_id="8", at=7)]
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    read = tables.read_json_lines(spark, str(tmp_path / "log.jsonl"))
    got = lambda df: {(r.method, r.sample_id): json.loads(r.value)["at"] for r in df.collect()}
    assert got(latest.latest_reviews(read, methods=["g1"])) == {("g1", "7"): 1}
    assert got(latest.latest_reviews(read)) == {("g1", "7"): 2, ("x", "7"): 3, ("g1", "undefined"): 4, ("g1", "null"): 5, ("null", "8"): 7}
    (tmp_path / "bad.jsonl").write_text(lines[0] + "\n[1]\n")
    with pytest.raises(PySparkException, match="not a JSON object"):
        latest.latest_reviews(tables.read_json_lines(spark, str(tmp_path / "bad.jsonl"))).collect()


def test_a_form_holds_verdicts_only(spark):
    form = lambda word: spark.range(1).select(filters.review_form(F.create_map(F.lit("hat"), F.lit(word))).alias("f")).first().f
    assert [form(w) for w in (" true", "false ", "null", " ")] == [{"hat": True}, {"hat": False}, {"hat": None}, {}]
    for word in ("yes", "True", "0"):
        with pytest.raises(PySparkException, match="not a verdict for hat"):
            form(word)


def test_flags_as_python_sees_them(spark):
    values = [None, False, True, 0, 0.0, 2, -0.5, "", "false", [], [None], {}, {"a": None}]
    rows = spark.createDataFrame([(json.dumps({"f": v}), bool(v)) for v in values] + [("{}", False)], "t string, want boolean")
    assert rows.filter(jsons.is_truthy(F.col("t"), "$.f") != F.col("want")).collect() == []


def test_json_of_labels_is_that_of_the_standard_library(spark):
    labels = {"źró": 'a"\\\n\tb/', "Z": None, "a": ["tốt", ""], "b": [], "é": " 😀", "": "x"}
    entries = [x for k, v in labels.items() for x in (F.lit(k), text.json_list(F.array(*map(F.lit, v)).cast("array<string>")) if isinstance(v, list) else text.json_string(F.lit(v).cast("string")))]
    got = spark.range(1).select(text.sorted_json(F.create_map(*entries)).alias("x")).first().x
    assert got == json.dumps(labels, ensure_ascii=False, sort_keys=True)


def test_a_tool_keeps_three_states(spark):
    rows = spark.createDataFrame([({"bag": ["a", "b"], "hat": [], "age": None, "top": ["unknown"]},), ({},), (None,)], "a map<string, array<string>>")
    got = [r.x for r in rows.select(cells.tool_attributes(cells.tool_results(F.col("a")), ["age", "bag", "hat", "top"]).alias("x")).collect()]
    none = dict.fromkeys(["age", "bag", "hat", "top"])
    assert got == [none | {"bag": ["a", "b"], "hat": [], "top": ["unknown"]}, none, none]
