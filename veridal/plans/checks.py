"""Queries over validators, review rows, small filters, text forms and workflows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridal.functions import cells, jsons, scores, text
from veridal.operators import filters, joins, latest, overlay, ranks, stats, taxonomy, telemetry, transport, validate, workflows
from veridal.plans.annotations import brand_taxonomy
from veridal.plans.registry import query, table
from veridal.sources import tables


def _names(found: Column) -> Column:
    return F.array_join(F.array_sort(found), ",")


def _flags(**rules: str) -> str:
    """DuckDB: the names of the rules that do not hold, in order."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN NOT ({rules[n]}) THEN '{n}' END" for n in sorted(rules)) + ")"


# --- validators ---

_CAPTION = "CASE WHEN p_partkey % 7 = 0 THEN '  ' WHEN p_partkey % 11 = 0 THEN repeat('x', 501) ELSE p_name END"


def _caption() -> Column:
    key = F.col("p_partkey")
    return F.when(key % 7 == 0, "  ").when(key % 11 == 0, F.repeat(F.lit("x"), 501)).otherwise(F.col("p_name"))


@query(f"""
    SELECT p_partkey, {_flags(keys='p_partkey % 5 <> 0', caption=f'length(trim({_CAPTION})) BETWEEN 1 AND 500')} AS own,
           CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat_ws(',', CASE WHEN p_size > 40 THEN 'attributes.size' END, CASE WHEN p_partkey % 13 = 0 OR p_brand LIKE '%1' THEN 'attributes.tags' END) END AS attributes
    FROM part
""")
def draft_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts with a key too many, a caption of no or too great a length, a size or tag outside its domain, or a tag twice."""
    brands = [f"Brand#{k}" for k in range(100) if k % 10 != 1]
    tags = F.when(F.col("p_partkey") % 13 == 0, F.array("p_brand", "p_brand")).otherwise(F.array("p_brand"))
    attributes = F.to_json(F.struct(F.col("p_size").cast("string").alias("size"), tags.alias("tags")))
    plain = F.concat(F.lit('{"caption": '), F.substr(F.to_json(F.struct(_caption().alias("c"))), F.lit(6)))
    draft = F.concat(F.regexp_replace(plain, r"\}$", ""), F.lit(', "attributes": '), attributes, F.when(F.col("p_partkey") % 5 == 0, ', "more": 1}').otherwise("}"))
    found = validate.draft_annotation(draft, {"size": [str(k) for k in range(41)]}, {"tags": brands})
    inner = F.filter(found, lambda v: v.startswith("attributes."))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 != 0, _names(inner)).otherwise("").alias("attributes"), _names(F.array_except(found, inner)).alias("own"))


@query(f"SELECT p_partkey, {_flags(keys='p_partkey % 3 <> 0', caption=f'p_partkey % 3 <> 0 AND length(trim({_CAPTION})) BETWEEN 1 AND 500')} AS violations FROM part")
def translation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.when(F.col("p_partkey") % 3 == 0, F.to_json(F.struct(_caption().alias("text")))).otherwise(F.to_json(F.struct(_caption().alias("caption"))))
    return table(spark, sf_dir, "part").select("p_partkey", _names(validate.text_answer(answer, "caption")).alias("violations"))


@query(f"SELECT doc_id, {_flags(count='doc_id % 9 <= 6', issue='doc_id % 9 = 0 OR doc_id % 4 <> 0', target='doc_id % 9 = 0 OR length(trim(source)) <= 6')} AS violations FROM documents WHERE source IS NOT NULL")
def issue_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of 0 to 8 issues, some blank, some with too long a target."""
    one = F.struct(F.col("source").alias("target"), F.when(F.col("doc_id") % 4 == 0, " ").otherwise("wrong").alias("issue"), F.lit("fix it").alias("suggested_correction"))
    found = validate.issues(F.array_repeat(one, (F.col("doc_id") % 9).cast("int")), limits={"target": 6, "issue": 180, "suggested_correction": 180})
    return table(spark, sf_dir, "documents").filter("source IS NOT NULL").select("doc_id", _names(found).alias("violations"))


@query(f"SELECT o_orderkey, {_flags(decision=chr(111) + '_orderpriority[1] IN (' + chr(39) + '1' + chr(39) + ', ' + chr(39) + '2' + chr(39) + ')', reasons='o_orderkey % 8 <= 6 AND (o_orderkey % 8 = 0 OR o_orderkey % 5 <> 0)')} AS violations FROM orders")
def verifier_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    decision = F.when(F.substring("o_orderpriority", 1, 1) == "1", "accept").when(F.substring("o_orderpriority", 1, 1) == "2", "reject").otherwise("maybe")
    reasons = F.array_repeat(F.when(F.col("o_orderkey") % 5 == 0, "  ").otherwise("a reason"), (F.col("o_orderkey") % 8).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", _names(validate.verifier_decision(decision, reasons)).alias("violations"))


@query("""
    SELECT conv_id, concat_ws(',', CASE WHEN n % 4 = 0 THEN 'count' END, CASE WHEN conv_id % 3 = 0 AND n % 4 >= 2 THEN 'ids' END, CASE WHEN conv_id % 5 = 0 AND n % 4 > 0 THEN 'items' END) AS questions,
           concat_ws(',', CASE WHEN conv_id % 4 = 0 AND n % 4 > 0 AND NOT (conv_id % 3 = 0 AND n % 4 = 2) THEN 'ids' END, CASE WHEN conv_id % 7 = 0 AND n % 4 > (conv_id % 4 = 0)::INT THEN 'items' END) AS answers
    FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)
""")
def question_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three questions a conversation, some repeated, some without a target; answers that leave one out or say ``yes`` for a boolean."""
    n = table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.count("*") % 4).cast("int").alias("n"))
    c, places = F.col("conv_id"), F.array(F.lit(0), F.lit(1), F.lit(2))
    name = lambda i: F.when(c % 3 == 0, F.floor(i / 2)).otherwise(i).cast("string")
    target = F.when(c % 5 == 0, " ").otherwise("bag")
    questions = F.transform(F.filter(places, lambda i: i < F.col("n")), lambda i: F.struct(name(i).alias("id"), target.alias("target"), F.lit("which?").alias("question")))
    said = F.when(c % 7 == 0, F.lit('"yes"')).otherwise("true")
    answer = lambda i: F.concat(F.lit('{"question_id": "'), name(i), F.lit('", "answer": "a", "evidence": "b", "determinable": '), said, F.lit("}"))
    answers = F.transform(F.filter(places, lambda i: i < F.col("n") - (c % 4 == 0).cast("int")), answer)
    asked = F.to_json(F.struct(questions.alias("questions")))
    told = F.concat(F.lit('{"answers": ['), F.array_join(answers, ", "), F.lit("]}"))
    return n.select("conv_id", _names(validate.question_list(asked)).alias("questions"), _names(validate.answer_list(told, validate.question_ids(asked))).alias("answers"))


@query(f"SELECT l_orderkey, l_linenumber, {_flags(decision='l_returnflag IN (' + repr('A') + ', ' + repr('R') + ')', notes='l_linenumber < 4')} AS violations FROM lineitem")
def comparison_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = F.array(F.lit("a note"), F.when(F.col("l_linenumber") < 4, "more").otherwise("\t"))
    found = validate.comparison(F.col("l_returnflag"), notes, ["A", "R"])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", _names(found).alias("violations"))


@query("""
    SELECT doc_id, concat_ws(',', CASE WHEN n_chars % 3 = 0 THEN 'is_correct' END, CASE WHEN n_chars % 4 = 0 THEN 'keys' END,
                             CASE WHEN n_chars % 5 = 0 THEN 'needs_human_review' END, CASE WHEN n_chars > 400 THEN 'note' END) AS caption,
           CASE WHEN n_chars % 2 = 0 AND n_chars % 3 = 0 OR n_chars % 2 = 1 AND n_chars % 3 <> 0 THEN 'verdict' ELSE '' END AS attribute
    FROM documents
""")
def judge_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's answers as JSON text with wrong types, a key too many, long notes, and verdicts without a mention."""
    n = F.col("n_chars")
    answer = F.concat(
        F.lit('{"is_correct": '), F.when(n % 3 == 0, '"yes"').otherwise("true"), F.lit(', "needs_human_review": '), F.when(n % 5 == 0, "null").otherwise("false"),
        F.when(n % 4 == 0, ', "more": 1').otherwise(""), F.lit(', "note": "'), F.repeat(F.lit("n"), F.least(n, F.lit(500)).cast("int")), F.lit('"}'),
    )
    check = F.concat(F.lit('{"mentioned": '), F.when(n % 2 == 0, "true").otherwise("false"), F.lit(', "is_correct": '), F.when(n % 3 == 0, "null").otherwise("false"), F.lit(', "note": ""}'))
    return table(spark, sf_dir, "documents").select("doc_id", _names(validate.caption_verdict(answer)).alias("caption"), _names(validate.attribute_check(check)).alias("attribute"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'keys' ELSE '' END AS violations FROM events")
def prediction_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    attributes = F.when(F.col("event_id") % 4 == 0, F.to_json(F.struct("user_id"))).otherwise(F.to_json(F.struct("user_id", "event_type")))
    return table(spark, sf_dir, "events").select("event_id", _names(validate.prediction_keys(attributes, ["event_type", "user_id"])).alias("violations"))


@query("""
    SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 7 = 0 THEN 'attributes' END, CASE WHEN doc_id % 5 = 0 THEN 'caption' END, CASE WHEN doc_id % 11 = 0 THEN 'keys' END,
                             CASE WHEN lang NOT IN ('en', 'fr') THEN 'method' END, CASE WHEN doc_id % 3 = 0 THEN 'values' END) AS violations
    FROM documents
""")
def override_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections with an unknown method or field, a caption that is no verdict, a value that is text, a key too many."""
    d = F.col("doc_id")
    body = F.concat(
        F.lit('{"sample_id": "'), d.cast("string"), F.lit('", "method": "'), F.col("lang"), F.lit('", "caption": '),
        F.when(d % 5 == 0, '{"is_correct": null}').when(d % 2 == 0, "null").otherwise('{"is_correct": true}'), F.lit(', "attributes": {"'),
        F.when(d % 7 == 0, "unknown").otherwise("age"), F.lit('": {"is_correct": '), F.when(d % 3 == 0, '"true"').when(d % 4 == 0, "null").otherwise("false"), F.lit("}}"),
        F.when(d % 11 == 0, ', "more": 0}').otherwise("}"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", _names(validate.override(body, ["en", "fr"], ["age", "gender"])).alias("violations"))


@query("SELECT vec_id, concat_ws(',', CASE WHEN vec_id % 3 = 0 THEN 'finite' END, CASE WHEN vec_id % 4 = 0 THEN 'size' END) AS violations FROM embeddings")
def logit_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.when(F.col("vec_id") % 3 == 0, F.transform("embedding", lambda v, i: F.when(i == 5, F.lit(float("nan"))).otherwise(v.cast("double")))).otherwise(F.col("embedding").cast("array<double>"))
    cut = F.when(F.col("vec_id") % 4 == 0, F.slice(broken, 1, 40)).otherwise(broken)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(validate.logits(cut, 64).cast("array<string>"), ",").alias("found")).select("vec_id", F.array_join(F.array_sort(F.split("found", ",")), ",").alias("violations"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'items' ELSE '' END AS violations, p_name || '|' || trim(p_brand) AS kept FROM part")
def string_list_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.array(F.concat(F.lit(" "), F.col("p_name"), F.lit(" \n")), F.when(F.col("p_partkey") % 6 == 0, " ").otherwise(F.col("p_brand")))
    tidy = F.array_join(validate.stripped(F.array(F.concat(F.lit(" "), F.col("p_name"), F.lit(" \n")), F.col("p_brand"))), "|")
    return table(spark, sf_dir, "part").select("p_partkey", _names(validate.string_list(items)).alias("violations"), tidy.alias("kept"))


@query("""
    WITH b AS (SELECT row_number() OVER (ORDER BY p_brand) - 1 AS position, p_brand AS name FROM part GROUP BY p_brand)
    SELECT '*' AS name, 'kind,multi_threshold,schema_version,size' AS violations UNION ALL SELECT '*', 'totals'
    UNION ALL SELECT name, CASE position WHEN 3 THEN 'repeated_class' ELSE 'tiling' END FROM b WHERE position = 3 OR position >= 5
""")
def taxonomy_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document of brands with a wrong kind, a class twice, and an attribute that starts too late, so that those behind it do not tile either."""
    at = F.col("position")
    classes = F.when(at == 3, F.concat(F.slice("classes", 2, 1), F.slice("classes", 2, 1 << 20))).otherwise(F.col("classes"))
    kind = F.when(at == 1, "odd").otherwise(F.col("kind"))
    one = F.struct("position", "name", kind.alias("kind"), (F.col("start") + (at == 5).cast("int")).alias("start"), "stop", classes.alias("classes"))
    attributes = F.array_sort(F.collect_list(one))  # a row a brand
    document = brand_taxonomy(spark, sf_dir).agg(attributes.alias("attributes")).select(
        F.lit("1").alias("schema_version"), F.lit("m").alias("model_version"), F.lit(1.5).alias("multi_threshold"), F.transform("attributes", lambda a: a.dropFields("position")).alias("attributes")
    )
    found = taxonomy.document_violations(document, "2", "m", attributes=3, logits=5)
    return found.select("name", _names(F.col("violations")).alias("violations"))


@query("SELECT o_custkey, count(*) AS rows FROM orders GROUP BY 1 HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.repeated_keys(table(spark, sf_dir, "orders"), ["o_custkey"])


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def unique_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fails if a key stands twice, as it does before the latest rows are taken."""
    rows = latest.keep_latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")
    return joins.unique_by(rows, ["o_custkey"])


@query("SELECT DISTINCT r_name AS version FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey = (SELECT max(n_regionkey) FROM nation)")
def only_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one region of the nations with the greatest key; fails if there are two."""
    nations = table(spark, sf_dir, "nation")
    last = nations.join(F.broadcast(nations.agg(F.max("n_regionkey").alias("n_regionkey"))), "n_regionkey")
    named = joins.required_join(last.withColumnRenamed("n_regionkey", "r_regionkey"), table(spark, sf_dir, "region"), ["r_regionkey"])
    return joins.single_value(named.select(F.col("r_name").alias("version")), "version")


@query("SELECT n_nationkey, n_name, 'left' AS side FROM nation WHERE n_regionkey = 2 UNION ALL SELECT n_nationkey, upper(n_name) || '!', 'right' FROM nation WHERE n_regionkey = 2")
def differing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    other = rows.withColumn("n_name", F.when(F.col("n_regionkey") == 2, F.concat(F.upper("n_name"), F.lit("!"))).otherwise(F.col("n_name")))
    return joins.same_rows(rows.drop("n_regionkey"), other.drop("n_regionkey"))


@query("""
    SELECT p_partkey, cell, concat_ws(',', CASE WHEN cell LIKE '%||%' THEN 'empty_code' END, CASE WHEN cell LIKE 'none|%' THEN 'none_mixed' END, CASE WHEN cell LIKE 'a|a%' THEN 'repeated' END, CASE WHEN cell LIKE '%z' THEN 'domain' END) AS violations
    FROM (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'none' WHEN 2 THEN 'a|b' WHEN 3 THEN 'a||b' WHEN 4 THEN 'none|a' WHEN 5 THEN 'a|a' ELSE 'b|z' END AS cell FROM part)
""")
def cell_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(c) for c in ("", "none", "a|b", "a||b", "none|a", "a|a", "b|z")])
    rows = table(spark, sf_dir, "part").select("p_partkey", F.get(kinds, (F.col("p_partkey") % 7).cast("int")).alias("cell"))
    return rows.withColumn("violations", F.array_join(cells.cell_violations(F.col("cell"), ["a", "b"]), ","))


@query("""
    SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN -1 WHEN 1 THEN 0 ELSE 2 END AS types, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS brand,
           (p_partkey % 3 <> 0)::INT + (p_partkey % 2 = 0)::INT AS results FROM part
""")
def tool_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null, the empty list and labels, through the results of an annotation tool and back; -1 stands for null."""
    k = F.col("p_partkey")
    types = F.when(k % 3 == 1, F.array().cast("array<string>")).when(k % 3 == 2, F.array("p_type", F.concat(F.lit('"'), "p_type")))
    out = cells.tool_results(F.create_map(F.lit("types"), types, F.lit("brand"), F.when(k % 2 == 0, F.array("p_brand"))))
    rows = table(spark, sf_dir, "part").select("p_partkey", out.alias("sent")).withColumn("back", cells.tool_attributes(F.col("sent"), ["brand", "types"]))
    return rows.select("p_partkey", F.coalesce(F.size(F.col("back")["types"]), F.lit(-1)).alias("types"), F.get(F.col("back")["brand"], F.lit(0)).alias("brand"), F.json_array_length("sent").alias("results"))


@query("""
    SELECT event_type, count(*) FILTER (event_id % 9 IN (1, 3, 5, 7)) AS flagged FROM events GROUP BY event_type
""")
def truthy_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What counts as a flag that is set: true, 0.5, a text, a list with something in it."""
    kinds = F.array(*map(F.lit, ("false", "true", "0", "0.5", '""', '"no"', "[]", "[0]", "null")))
    flag = F.concat(F.lit('{"flag": '), F.get(kinds, (F.col("event_id") % 9).cast("int")), F.lit("}"))
    rows = table(spark, sf_dir, "events").select("event_type", flag.alias("row"))
    return rows.groupBy("event_type").agg(F.count_if(jsons.is_truthy(F.col("row"), "$.flag")).alias("flagged"))


_LOG = """FROM (SELECT *, CASE user_id % 3 WHEN 0 THEN 'g1' WHEN 1 THEN 'g2' ELSE 'x' END AS method FROM events) WHERE event_id % 4 <> 0"""


def _log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of reviews: every fourth of another version, every fifth with a number for an id, methods of which one is unknown."""
    user, event = F.col("user_id"), F.col("event_id")
    method = F.when(user % 3 == 0, "g1").when(user % 3 == 1, "g2").otherwise("x")
    sample = F.when(event % 5 == 0, user.cast("string")).otherwise(F.concat(F.lit('"'), user.cast("string"), F.lit('"')))
    version = F.when(event % 4 == 0, "3").otherwise('"3"')
    line = F.concat(F.lit('{"evaluation_schema_version": '), version, F.lit(', "method": "'), method, F.lit('", "sample_id": '), sample, F.lit(', "at": '), event.cast("string"), F.lit("}"))
    return table(spark, sf_dir, "events").select(event.alias("position"), line.alias("value")).withColumn("ok", jsons.is_object(F.col("value")))


@query(f"""
    SELECT method, user_id::VARCHAR AS sample_id, max(event_id) AS at, 'any' AS reader {_LOG} GROUP BY ALL
    UNION ALL SELECT method, user_id::VARCHAR, max(event_id), 'strict' {_LOG} AND event_id % 5 <> 0 AND method <> 'x' GROUP BY ALL
""")
def log_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as both readers take it: any method and ids of any type, or known methods and ids that are text."""
    lines = _log_lines(spark, sf_dir)
    at = F.get_json_object("value", "$.at").cast("long").alias("at")
    read = lambda name, methods: latest.latest_reviews(lines, methods=methods).select("method", "sample_id", at, F.lit(name).alias("reader"))
    return read("any", None).unionByName(read("strict", ["g1", "g2"]))


@query("""
    SELECT doc_id, '{"lang": "' || lang || '", "quality": ' || CASE quality WHEN 1 THEN '["tốt", "a\\"b"]' WHEN 0 THEN '[]' ELSE 'null' END || ', "Ärger": null, "źródło": "' || coalesce(source, '') || '"}' AS golden
    FROM documents LEFT JOIN labels USING (doc_id) WHERE lang IS NOT NULL
""")
def golden_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as they stand in a prompt: keys by code point, blanks after commas, letters as they are."""
    rows = table(spark, sf_dir, "documents").filter("lang IS NOT NULL").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    labels = F.when(F.col("quality") == 1, F.array(F.lit("tốt"), F.lit('a"b'))).when(F.col("quality") == 0, F.array().cast("array<string>"))
    none = F.lit(None).cast("string")
    entries = F.create_map(F.lit("źródło"), text.json_string(F.coalesce("source", F.lit(""))), F.lit("quality"), text.json_list(labels), F.lit("Ärger"), text.json_string(none), F.lit("lang"), text.json_string(F.col("lang")))
    return rows.select("doc_id", text.sorted_json(entries).alias("golden"))


@query("""
    SELECT count(*) AS num_inputs, count(quality) AS success_count, count(*) - count(quality) AS error_count, sum((n_chars > 300)::INT)::BIGINT AS model_calls, sum(n_chars % 3)::BIGINT AS http_attempts,
           round(avg(n_chars) FILTER (quality IS NOT NULL), 6) AS mean_ms, max(n_chars) FILTER (quality IS NOT NULL)::DOUBLE AS most_ms
    FROM documents LEFT JOIN labels USING (doc_id)
""")
def run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    run = rows.select(F.when(F.col("quality").isNotNull(), "success").otherwise("error").alias("status"), (F.col("n_chars") > 300).cast("int").alias("model_calls"), (F.col("n_chars") % 3).alias("http_attempts"), F.col("n_chars").cast("double").alias("latency_ms"))
    found, ms = telemetry.run_summary(run), F.col("latency_ms_success")
    return found.select("num_inputs", "success_count", "error_count", "model_calls", "http_attempts", F.round(ms["mean"], 6).alias("mean_ms"), ms["max"].alias("most_ms"))


# --- review rows ---


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labelled documents as a judge's rows, those with an id divisible by 5 failed, and corrections of every second one."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
    failed = F.col("doc_id") % 5 == 0
    check = lambda c: F.struct((F.col(c) == 1).alias("mentioned"), F.when(F.col(c) == 1, F.col("doc_id") % 2 == 0).alias("is_correct"), F.lit("").alias("note"))
    checks = F.create_map(F.lit("quality"), check("quality"), F.lit("toxic"), check("toxic"))
    done = rows.select(
        F.col("doc_id").cast("string").alias("sample_id"), F.col("lang").alias("method"), F.concat(F.lit("img/"), F.col("doc_id").cast("string")).alias("filepath"), F.when(failed, "error").otherwise("success").alias("status"),
        F.struct((F.col("n_chars") > 500).alias("is_correct"), (F.col("n_chars") < 50).alias("needs_human_review"), F.lit("n").alias("note")).alias("caption_evaluation"),
        F.struct(F.col("source").alias("caption"), F.lit(None).cast("string").alias("caption_vi")).alias("prediction"), checks.alias("caption_attribute_evaluation"), stats.row_summary(F.map_values(checks)).alias("caption_attribute_summary"),
        F.create_map(F.lit("quality"), F.lit("good")).alias("golden_attributes"), F.col("n_chars").cast("double").alias("latency_ms"), F.when(failed, F.struct(F.lit("timeout").alias("message"))).alias("error"),
    )
    fixes = rows.filter("doc_id % 2 = 0").select(text.key_of(F.col("lang"), F.col("doc_id")).alias("key"), F.lit(True).alias("caption_given"), (F.col("quality") == 0).alias("caption_correct"), F.create_map(F.lit("toxic"), F.when(F.col("doc_id") % 4 == 0, True)).alias("attributes"))
    return done, fixes


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.with_overrides(*_judged(spark, sf_dir))


_REVIEWS = "FROM labels JOIN documents USING (doc_id)"


@query(f"""
    SELECT doc_id::VARCHAR AS sample_id, CASE WHEN doc_id % 5 = 0 THEN 'error' ELSE 'success' END AS status, CASE WHEN n_chars > 500 THEN 'true' ELSE 'false' END AS caption_correct, n_chars < 50 AS needs_review,
           coalesce((quality = 1)::INT, 0) + coalesce((toxic = 1)::INT, 0) AS mentioned, CASE WHEN doc_id % 2 = 0 THEN coalesce((quality = 1)::INT, 0) + coalesce((toxic = 1)::INT, 0) ELSE 0 END AS correct,
           CASE WHEN doc_id % 5 = 0 THEN 'timeout' END AS error, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN quality = 0 THEN 'true' ELSE 'false' END ELSE '' END AS human_caption
    {_REVIEWS}
""")
def caption_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.caption_sheet(_reviews(spark, sf_dir)).select("sample_id", "status", "caption_correct", "needs_review", "mentioned", "correct", "error", "human_caption")


@query(f"""
    SELECT doc_id::VARCHAR AS sample_id, field, v = 1 AS mentioned, CASE WHEN field = 'quality' THEN 'good' END AS golden,
           CASE WHEN v <> 1 THEN 'null' WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END AS correct,
           CASE WHEN v <> 1 THEN 'Không nhắc (không tính lỗi)' WHEN doc_id % 2 = 0 THEN 'Có nhắc và khớp nhãn' ELSE 'Có nhắc nhưng không khớp nhãn' END AS reading,
           CASE WHEN field = 'quality' OR doc_id % 2 = 1 THEN '' WHEN doc_id % 4 = 0 THEN 'true' ELSE 'null' END AS human_verdict
    FROM (SELECT doc_id, 'quality' AS field, quality AS v {_REVIEWS} UNION ALL SELECT doc_id, 'toxic', toxic {_REVIEWS}) WHERE doc_id % 5 <> 0
""")
def attribute_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.attribute_sheet(_reviews(spark, sf_dir)).select("sample_id", "field", "mentioned", "golden", "correct", "reading", "human_verdict")


@query("SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections of even events laid over those of odd ones."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return overlay.upsert(rows.filter("event_id % 2 = 1"), rows.filter("event_id % 2 = 0"), "user_id", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT lang || ':' || doc_id AS key FROM documents WHERE doc_id % 3 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def unreviewed_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("method"), F.col("doc_id").cast("string").alias("sample_id"), "doc_id")
    reviews = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")
    return overlay.lacking_reviews(docs.filter("doc_id % 3 = 0").select(text.key_of(F.col("method"), F.col("sample_id")).alias("key")), reviews)


@query(f"SELECT doc_id::VARCHAR AS sample_id, lang AS method, doc_id % 2 = 0 AS corrected {_REVIEWS} WHERE doc_id = (SELECT min(doc_id) FROM labels)")
def one_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    least = table(spark, sf_dir, "labels").agg(F.min("doc_id")).first()[0]
    return overlay.review_of_sample(*_judged(spark, sf_dir), str(least)).select("sample_id", "method", F.col("override_key").isNotNull().alias("corrected"))


# --- filters, unions, counts ---


@query("SELECT c_custkey FROM customer WHERE c_custkey % 4 = 1")
def flagged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flag is the text 1; ``true`` and ``1.0`` are not."""
    flags = F.array(F.lit("0"), F.lit("1"), F.lit("true"), F.lit("1.0"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.get(flags, (F.col("c_custkey") % 4).cast("int")).alias("is_query"))
    return filters.query_rows(rows).select("c_custkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'")
def rows_of_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("run_id"))
    return filters.of_run(rows, "R").select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25")
def first_of_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("position", F.struct("o_orderdate", "o_orderkey"))
    return filters.first_in_order(rows, 25).select("o_orderkey")


@query("""
    SELECT count(*) AS corrected_rows, coalesce(sum((doc_id % 2 = 0)::INT + 1 + (toxic = 1)::INT), 0)::BIGINT AS corrected_fields
    FROM labels JOIN documents USING (doc_id) WHERE lang = 'en'
""")
def override_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    fields = F.when(F.col("toxic") == 1, F.create_map(F.lit("quality"), F.lit(True), F.lit("toxic"), F.lit(False))).otherwise(F.create_map(F.lit("quality"), F.lit(True)))
    return filters.override_counts(rows.select(text.key_of(F.col("lang"), F.col("doc_id")).alias("key"), (F.col("doc_id") % 2 == 0).alias("caption_given"), fields.alias("attributes")), "en:")


@query("SELECT count(*) AS matched_rows FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 20)")
def matched_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey")
    return filters.matched_updates(table(spark, sf_dir, "part").filter("p_size < 20"), updates, "p_partkey")


@query("SELECT c_custkey AS key, 'customer' AS method, c_nationkey AS nation, NULL::DOUBLE AS total FROM customer UNION ALL SELECT o_orderkey, 'orders', NULL, o_totalprice FROM orders")
def united_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("total"))
    return filters.union_by_method({"customer": customers, "orders": orders}).select("key", "method", "nation", "total")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 1 END + 2 AS entries, CASE WHEN doc_id % 4 = 0 THEN 'verifier' ELSE 'bag' END AS first_target, 'Correct the unsupported claim.' AS last_fix FROM documents")
def feedback_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.struct(F.lit("bag").alias("target"), F.lit("wrong").alias("issue"), F.lit("fix").alias("suggested_correction"))
    issues = F.array_repeat(one, F.when(F.col("doc_id") % 4 == 0, 0).otherwise(1))
    found = filters.feedback_of(issues, F.array(F.lit(" a "), F.lit("b")))
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("f")).select("doc_id", F.size("f").alias("entries"), F.get("f", F.lit(0))["target"].alias("first_target"), F.element_at("f", -1)["suggested_correction"].alias("last_fix"))


@query("""
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS given, CASE WHEN quality = 1 THEN 'true' WHEN quality = 0 THEN 'false' ELSE 'null' END AS quality
    FROM documents LEFT JOIN labels USING (doc_id)
""")
def review_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    answer = F.when(F.col("quality") == 1, "true").when(F.col("quality") == 0, " false").otherwise("null")
    form = filters.review_form(F.create_map(F.lit("quality"), answer, F.lit("toxic"), F.when(F.col("doc_id") % 3 == 0, "  ").otherwise("true"), F.lit("age"), F.lit(None).cast("string")))
    return rows.select("doc_id", form.alias("f")).select("doc_id", F.size("f").alias("given"), text.tri_state(F.try_element_at("f", F.lit("quality"))).alias("quality"))


@query("SELECT p_partkey, CASE p_brand WHEN 'Brand#11' THEN 'critical' WHEN 'Brand#12' THEN 'important' ELSE 'detail' END AS review_group, CASE p_brand WHEN 'Brand#11' THEN 1 WHEN 'Brand#12' THEN 2 ELSE 3 END AS review_place FROM part")
def review_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filters.review_priority(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), {"Brand#11": "critical", "Brand#12": "important"}, "p_brand")
    return out.select("p_partkey", "review_group", "review_place")


@query("SELECT p_partkey, 'name is ' || w AS claim, (i - 1)::INT AS place FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part)")
def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.create_map(F.lit("name"), F.split("p_name", " "), F.lit("none"), F.lit(None).cast("array<string>")).alias("attributes"))
    return filters.claims_of(rows, "p_partkey", "attributes", "{field} is {label}").select("p_partkey", "claim", "place")


@query("SELECT o_orderkey, (o_orderkey % 3 <> 0) = (NOT coalesce(bool_or(l_quantity >= 45), false)) AS agree FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def claim_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an order is marked false exactly where one of its lines is."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.col("l_quantity") < 45).alias("claims"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey").select("o_orderkey", filters.claims_agree(F.col("o_orderkey") % 3 != 0, F.col("claims")).alias("agree"))


@query("""
    SELECT s_suppkey, round(CASE s_suppkey % 5 WHEN 0 THEN 0 WHEN 1 THEN s_suppkey WHEN 2 THEN 255 WHEN 3 THEN -s_suppkey / 10.0 END, 6) AS number, s_suppkey % 5 = 4 AS odd FROM supplier
""")
def script_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids as a script language reads them as numbers."""
    key = F.col("s_suppkey").cast("string")
    given = F.get(F.array(F.lit("  "), F.concat(F.lit(" "), key), F.lit("0xFF"), F.concat(F.lit("-"), key, F.lit("e-1")), F.concat(key, F.lit("x"))), (F.col("s_suppkey") % 5).cast("int"))
    n = ranks.script_number(given)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.when(~F.isnan(n), F.round(n, 6)).alias("number"), F.isnan(n).alias("odd"))


@query("SELECT s_suppkey, row_number() OVER (ORDER BY lower(CASE WHEN s_nationkey % 2 = 0 THEN 'a' ELSE 'B' END), s_suppkey) AS place FROM supplier")
def sheet_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places by method in people's order, in which ``a`` comes before ``B``, then by the id's number."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_nationkey") % 2 == 0, "a").otherwise("B").alias("method"))
    return ranks.global_rank(rows, ranks.sheet_order(F.col("method"), F.col("s_suppkey").cast("string")), "place").select("s_suppkey", "place")


@query("SELECT DISTINCT p_brand FROM part")
def sorted_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.sorted_values(table(spark, sf_dir, "part"), "p_brand")


# --- text forms ---


@query("""
    SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '—' ELSE format('{:.1f}%', 100.0 * (p_size % 4) / (p_size % 3 * 4)) END AS share,
           CASE WHEN p_size % 2 = 0 THEN 'N/A' ELSE format('{:.2f}', p_size / 8.0) END AS number
    FROM part
""")
def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", text.percent_text(size % 4, size % 3 * 4).alias("share"), text.number_text(F.when(size % 2 == 1, size / 8.0)).alias("number"))


@query("SELECT p_partkey, CASE WHEN c + i = 0 THEN '—' ELSE c || '/' || (c + i) || ' (' || format('{:.1f}', 100.0 * c / (c + i)) || '%)' END AS rate FROM (SELECT p_partkey, p_size % 3 AS c, p_size % 4 AS i FROM part) WHERE c + i IN (0, 1, 2, 4, 5)")
def rate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 3).alias("c"), (F.col("p_size") % 4).alias("i")).filter((F.col("c") + F.col("i")).isin(0, 1, 2, 4, 5))
    return rows.select("p_partkey", stats.rate_text(F.col("c"), F.col("i")).alias("rate"))


@query("""
    SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'Wears ' || lower(l) || ' shoes' WHEN p_size % 3 = 1 THEN 'None at all' ELSE l END AS label
    FROM (SELECT p_partkey, p_size, upper(p_name[1]) || replace(p_name[2:], '_', ' ') AS l FROM part)
""")
def class_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.get(F.array(F.lit("footwear_type"), F.lit("bag_type"), F.lit("age")), (F.col("p_size") % 3).cast("int"))
    code = F.when(kind == "bag_type", "none").otherwise(F.replace("p_name", F.lit(" "), F.lit("_")))
    label = text.class_label(kind, code, {"none": "None at all"}, {"footwear_type": "Wears {label} shoes"}, {})
    return table(spark, sf_dir, "part").select("p_partkey", label.alias("label"))


@query("""
    SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'request_timed_out' WHEN 1 THEN 'plain' ELSE 'a_b' END AS code, CASE WHEN event_id % 2 = 0 THEN 'timeout' ELSE 'value' END AS of_class,
           'http://h' || (event_id % 5) || '/v1' AS service, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false END AS flag,
           CASE event_id % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/webp' ELSE 'image/jpeg' END AS mime, 'a%20b/' || event_id || '%3F.png' AS path,
           CASE WHEN event_id % 3 = 0 THEN 'KEY' END AS setting, CASE WHEN event_id % 3 = 0 THEN 'v=' || event_id END AS setting_value
    FROM events
""")
def small_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    pick = lambda n, *xs: F.get(F.array(*[F.lit(x) for x in xs]), (e % n).cast("int"))
    line = F.when(e % 3 == 0, F.concat(F.lit(" KEY = 'v="), e.cast("string"), F.lit("' "))).when(e % 3 == 1, "# KEY=1").otherwise("KEY")
    pair = text.dotenv_pair(line)
    return table(spark, sf_dir, "events").select(
        "event_id", text.error_code(pick(3, "Request Timed Out: after 3 s", "plain", "A b:c:d")).alias("code"), text.error_code_of_class(pick(2, "TimeoutError", "ValueError")).alias("of_class"),
        text.service_url(F.concat(F.lit("http://h"), (e % 5).cast("string"), pick(3, "/v1/", "", "//"))).alias("service"), text.parse_boolean(pick(4, " YES", "off", "maybe", "")).alias("flag"),
        text.mime_type(pick(4, "x.PNG", "dir.png/x", "a.webp", "a.jpeg")).alias("mime"), text.url_path(F.concat(F.lit("a b/"), e.cast("string"), F.lit("?.png"))).alias("path"),
        pair["key"].alias("setting"), pair["value"].alias("setting_value"),
    )


@query("SELECT s_suppkey, 'method' || (s_suppkey % 4) AS method, string_agg(n_name, ', ' ORDER BY n_nationkey) AS names FROM supplier JOIN nation ON n_nationkey % 5 = s_suppkey % 5 GROUP BY ALL")
def finding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in rank order, without their rates."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 5).alias("k")).join(F.broadcast(table(spark, sf_dir, "nation").select((F.col("n_nationkey") % 5).alias("k"), "n_nationkey", F.col("n_name").alias("field"))), "k")
    found = stats.finding_text(rows.withColumn("rate", F.lit(0.5)).withColumnRenamed("n_nationkey", "weakest"), "s_suppkey", "weakest")
    return found.select("s_suppkey", F.concat(F.lit("method"), (F.col("s_suppkey") % 4).cast("string")).alias("method"), F.replace("weakest", F.lit(" (50.0%)"), F.lit("")).alias("names"))


@query("""
    SELECT event_id, event_id % 2 = 0 AS is_object, CASE WHEN event_id % 3 <> 2 THEN event_id % 100 END AS prompt_tokens, CASE WHEN event_id % 5 <> 0 THEN '{"a": ' || event_id || '}' END AS content FROM events
""")
def response_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token usage and the message of a service's response; usage that is text and messages that are no object give null."""
    from veridal.functions import jsons

    e = F.col("event_id").cast("string")
    usage = F.when(F.col("event_id") % 3 == 2, F.lit('"many"')).otherwise((F.col("event_id") % 100).cast("string"))
    message = F.when(F.col("event_id") % 5 == 0, F.lit('"text only"')).otherwise(F.concat(F.lit('"{\\"a\\": '), e, F.lit('}"')))
    body = F.concat(F.lit('{"usage": {"prompt_tokens": '), usage, F.lit('}, "choices": [{"message": {"content": '), message, F.lit("}}]}"))
    half = F.when(F.col("event_id") % 2 == 0, body).otherwise(F.lit("[1]"))
    return table(spark, sf_dir, "events").select("event_id", jsons.is_object(half).alias("is_object"), jsons.token_usage(body)["prompt_tokens"].alias("prompt_tokens"), jsons.response_content(body).alias("content"))


@query("""
    SELECT s_suppkey, s_suppkey * 7 + 30 < 1000 - 60 AS valid, printf('%.2f', s_suppkey / 8)::DOUBLE AS rounded, printf('%.2f', s_suppkey / 200)::DOUBLE AS nearest FROM supplier
""")
def token_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eighths are exact and tie; numbers such as 2.675 look like ties and are none."""
    rows, key = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    return rows.select("s_suppkey", scores.token_is_valid(key * 7 + 30, F.lit(1000)).alias("valid"), scores.half_even(key / 8, 2).alias("rounded"), scores.half_even(key / 200, 2).alias("nearest"))


@query("""
    SELECT vec_id, v[1] AS gender, greatest(1 / (1 + exp(v[2] - v[1])), 1 / (1 + exp(v[1] - v[2]))) >= 0.61 AS sure, CASE WHEN v[1] >= v[2] THEN 'Woman' ELSE 'Man' END AS label
    FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
""".replace("v[1] AS gender", "CASE WHEN v[1] >= v[2] THEN 'female' ELSE 'male' END AS gender"))
def prediction_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = taxonomy.slices_of([("gender", "single", 2)])[0]
    found = taxonomy.prediction_map(taxonomy.decode_single(F.col("embedding"), s), s, ["female", "male"], ["Woman", "Man"], "strong", "Gender")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", taxonomy.predictions({"gender": found}).alias("p"))
    one = F.col("p")["gender"]
    return rows.select("vec_id", F.get(one["codes"], F.lit(0)).alias("gender"), (F.get(one["scores"], F.lit(0)) >= 0.61).alias("sure"), F.get(taxonomy.label_map(F.col("p"))["Gender"], F.lit(0)).alias("label"))


# --- workflows over stub models ---

CONTRACT = workflows.Contract({"size": ["small", "great"]}, {"bags": ["a", "b"]})


def _last_number(prompt: str) -> int:
    return int(prompt.rsplit("#", 1)[1].split()[0])


def _annotation(number: int) -> str:
    return json.dumps({"caption": f" caption {number} #{number}", "attributes": {"size": "small" if number % 2 else "great", "bags": ["a"] if number % 3 else None}})


def _annotator(prompts: list[str]) -> list[str]:
    """An agent that fails for numbers divisible by 7 and leaves the contract for those divisible by 11."""
    out = []
    for n in map(_last_number, prompts):
        if n % 7 == 0:
            raise TimeoutError("no answer")
        out.append(json.dumps({"caption": "c", "attributes": {"size": "huge", "bags": []}}) if n % 11 == 0 else _annotation(n))
    return out


def _translator(prompts: list[str]) -> list[str]:
    return [json.dumps({"caption": f"ban dich {_last_number(p)}"}) for p in prompts]


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("sample_id"), F.concat(F.lit("#"), F.col("s_suppkey").cast("string")).alias("image"))


_FLOW = """
    SELECT s_suppkey::VARCHAR AS sample_id, CASE WHEN {bad} THEN 'error' ELSE 'success' END AS status, CASE WHEN NOT ({bad}) THEN 'caption ' || s_suppkey || ' #' || s_suppkey END AS caption,
           CASE WHEN NOT ({bad}) THEN 'ban dich ' || s_suppkey END AS caption_vi, CASE WHEN s_suppkey % 7 = 0 THEN '{agent}: no answer' WHEN s_suppkey % 11 = 0 THEN '{agent}: invalid answer' END AS error{more} FROM supplier
"""
_BAD = "s_suppkey % 7 = 0 OR s_suppkey % 11 = 0"
_SHOWN = ("sample_id", "status", "caption", "caption_vi", "error")


@query(_FLOW.format(bad=_BAD, agent="annotation", more=""))
def direct_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = workflows.direct_annotation(_samples(spark, sf_dir), {"annotation": _annotator, "translation": _translator}, CONTRACT)
    return out.select(*_SHOWN)


def _facts(prompts: list[str]) -> list[str]:
    return [json.dumps({"facts": [f"fact #{_last_number(p)}"], "attributes": json.loads(_annotation(1))["attributes"]}) for p in prompts]


def _analysis(prompts: list[str]) -> list[str]:
    out = []
    for n in map(_last_number, prompts):
        if n % 7 == 0:
            raise TimeoutError("no answer")
        out.append(" " if n % 11 == 0 else f"seen #{n}")
    return out


def _captioner(prompts: list[str]) -> list[str]:
    return [json.dumps({"caption": f"caption {n} #{n}"}) for n in (int(p.rsplit("#", 1)[1].split('"')[0].split()[0]) for p in prompts)]


@query(_FLOW.format(bad=_BAD, agent="visual_analysis", more=""))
def facts_then_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = {"visual_analysis": _analysis, "structured_facts": _facts, "caption": _captioner, "translation": _translator}
    return workflows.facts_then_caption(_samples(spark, sf_dir), models, CONTRACT).select(*_SHOWN)


def _consensus(prompts: list[str]) -> list[str]:
    """The size that most observers saw."""
    out = []
    for p in prompts:
        sizes = [json.loads(line)["attributes"]["size"] for line in p.split("|")[1].splitlines()]
        out.append(json.dumps({"attributes": {"size": max(sorted(set(sizes)), key=sizes.count), "bags": []}}))
    return out


def _observer(prompts: list[str]) -> list[str]:
    out = []
    for p in prompts:
        n = _last_number(p)
        if n % 7 == 0:
            raise TimeoutError("no answer")
        out.append("{}" if n % 11 == 0 else _annotation(n + ("bag" in p)))
    return out


def _size_caption(prompts: list[str]) -> list[str]:
    return [json.dumps({"caption": f"#{int('great' in p)}"}) for p in prompts]


@query(f"""
    SELECT CASE s_suppkey % 10 WHEN 0 THEN NULL WHEN 1 THEN 'same' ELSE s_suppkey::VARCHAR END AS sample_id, CASE WHEN {_BAD} THEN 'error' ELSE 'success' END AS status, CASE WHEN NOT ({_BAD}) THEN '#' || (s_suppkey % 2 = 0)::INT END AS caption,
           CASE WHEN NOT ({_BAD}) THEN 'ban dich ' || (s_suppkey % 2 = 0)::INT END AS caption_vi, CASE WHEN s_suppkey % 7 = 0 THEN 'observer: no answer' WHEN s_suppkey % 11 = 0 THEN 'observer: invalid answer' END AS error FROM supplier
""")
def consensus_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also of rows without an id and of rows that share one."""
    models = {"observer": _observer, "consensus": _consensus, "caption": _size_caption, "translation": _translator}
    prompts = {"observer": "{focus} {image}", "consensus": "{image}|{candidates}"}
    key = F.col("sample_id").cast("long") % 10
    samples = _samples(spark, sf_dir).withColumn("sample_id", F.when(key == 1, "same").when(key != 0, F.col("sample_id")))
    return workflows.consensus_annotation(samples, models, CONTRACT, prompts, focuses=("top", "shoes", "bag")).select(*_SHOWN)


def _critic(prompts: list[str]) -> list[str]:
    return [json.dumps({"issues": [{"target": "size", "issue": "too great", "suggested_correction": "small"}]}) for _ in prompts]


def _verifier(prompts: list[str]) -> list[str]:
    """Accepts at once for numbers of 0 modulo 3, after feedback for 1, never for 2."""
    return [json.dumps({"decision": "accept" if n % 3 == 0 or n % 3 == 1 and "again" in p else "reject", "reasons": [" unsupported "]}) for p, n in ((p, _last_number(p)) for p in prompts)]


def _generator(prompts: list[str]) -> list[str]:
    out = []
    for p in prompts:
        n = int(p.split("#")[1].split()[0])
        if n % 7 == 0:
            raise TimeoutError("no answer")
        out.append("[]" if n % 11 == 0 else _annotation(n).replace("caption ", "again ", 1) if "too great" in p else _annotation(n))
    return out


_ROUNDS = """
    SELECT s_suppkey::VARCHAR AS sample_id, CASE WHEN {bad} THEN 'error' ELSE 'success' END AS status, CASE WHEN NOT ({bad}) THEN CASE WHEN s_suppkey % 3 = 0 THEN 'caption ' ELSE 'again ' END || s_suppkey || ' #' || s_suppkey END AS caption,
           CASE WHEN NOT ({bad}) THEN CASE WHEN s_suppkey % 3 < 2 THEN 'accepted' ELSE '{late}' END END AS workflow_status,
           CASE WHEN NOT ({bad}) THEN CASE WHEN s_suppkey % 3 < 2 THEN '' ELSE '{notes}' END END AS notes FROM supplier
"""


def _round_columns(out: DataFrame) -> DataFrame:
    return out.select("sample_id", "status", "caption", "workflow_status", F.array_join("workflow_notes", "|").alias("notes"))


@query(_ROUNDS.format(bad=_BAD, late="rejected_after_max_attempts", notes="too great|unsupported"))
def critic_verifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = {"generator": _generator, "critic": _critic, "verifier": _verifier, "translation": _translator}
    prompts = {"generator": "{feedback} {image}", "verifier": "{generator} {image}"}
    return _round_columns(workflows.critic_verifier(_samples(spark, sf_dir), models, CONTRACT, prompts))


def _asker(prompts: list[str]) -> list[str]:
    return [json.dumps({"questions": [{"id": "q1", "target": "size", "question": "how great?"}, {"id": "q2", "target": "bags", "question": "which bag?"}]}) for _ in prompts]


#: What this process has been asked, so that an agent can answer better when asked again.
_ASKED: set[str] = set()


def _answerer(prompts: list[str]) -> list[str]:
    """Leaves an answer out: always for numbers divisible by 5, when first asked for 1 modulo 5."""
    out = []
    for p in prompts:
        n = int(p.split("#")[1].split()[0])
        answers = [{"question_id": q, "answer": "too great", "evidence": "seen", "determinable": q == "q1"} for q in ("q2", "q1")]
        out.append(json.dumps({"answers": answers[: 1 if n % 5 == 0 or n % 5 == 1 and p not in _ASKED else 2]}))
        _ASKED.add(p)
    return out


def _comparer(prompts: list[str]) -> list[str]:
    return [json.dumps({"decision": "accept" if n % 3 == 0 or n % 3 == 1 and "again" in p else "refine", "corrections": ["too great"]}) for p, n in ((p, int(p.split("#")[1].split('"')[0])) for p in prompts)]


@query(f"""
    SELECT *, CASE WHEN sample_id::INT % 7 = 0 THEN 'draft_annotation: no answer' WHEN sample_id::INT % 11 = 0 THEN 'draft_annotation: invalid draft' WHEN sample_id::INT % 5 = 0 THEN 'image_answers: incomplete image answers' END AS error
    FROM ({_ROUNDS.format(bad=_BAD + " OR s_suppkey % 5 = 0", late="refine_limit_reached", notes="too great")})
""")
def question_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = {"draft_annotation": _generator, "verification_questions": _asker, "image_answers": _answerer, "comparison": _comparer, "translation": _translator}
    out = workflows.question_refinement(_samples(spark, sf_dir), models, CONTRACT, {"draft_annotation": "{feedback} {image}"})
    return out.select("sample_id", "status", "caption", "workflow_status", F.array_join("workflow_notes", "|").alias("notes"), "error")


def _caption_judge(prompts: list[str]) -> list[str]:
    return _analysis(prompts)


def _attribute_judge(prompts: list[str]) -> list[str]:
    return [json.dumps({"size": {"mentioned": True, "is_correct": n % 2 == 0, "note": ""}, "bags": {"mentioned": False, "is_correct": None, "note": ""}}) for n in map(_last_number, prompts)]


@query(f"""
    SELECT s_suppkey::VARCHAR AS sample_id, CASE WHEN {_BAD} THEN 'error' ELSE 'success' END AS status, CASE WHEN NOT ({_BAD}) THEN 1 END AS mentioned, CASE WHEN NOT ({_BAD}) THEN (s_suppkey % 2 = 0)::INT END AS correct,
           CASE WHEN {_BAD} THEN 'caption_evaluation' END AS code FROM supplier
""")
def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = _samples(spark, sf_dir).withColumn("method", F.lit("g1")).withColumn("caption", F.col("image")).withColumn("golden_attributes", F.lit("{}"))
    prompts = {"caption_evaluation": "{caption}", "attribute_evaluation": "{golden_attributes} {caption}"}
    out = workflows.judge(tasks, {"caption_evaluation": _caption_judge, "attribute_evaluation": _attribute_judge}, lambda t: bool(t.strip()), lambda t: "size" in t, "stub", {"caption": "1"}, prompts)
    return out.select("sample_id", "status", F.col("caption_attribute_summary.mentioned").alias("mentioned"), F.col("caption_attribute_summary.correct").alias("correct"), F.col("error.code").alias("code"))


# --- transport over a scripted service ---


class _Script:
    """A service whose replies a prompt spells: one digit a request, as ``call_outcomes`` says."""

    def __init__(self) -> None:
        self.asked: dict[str, int] = {}

    def __call__(self, url: str, headers: object, body: dict) -> transport.Reply:
        if url.endswith("/oauth/token"):
            return transport.Reply(200, json.dumps({"access_token": "t", "expires_in": 3600}))
        prompt = body["messages"][0]["content"][0]["text"]
        at = self.asked.get(prompt, 0)
        digit = prompt.split("#")[1][at]
        self.asked[prompt] = at + 1
        if digit in "03" or at == 2:
            del self.asked[prompt]
        status = {"1": 429, "2": 401, "3": 400}.get(digit, 200)
        content = '{"fine": true}' if digit == "0" else "no object"
        return transport.Reply(status, json.dumps({"choices": [{"message": {"content": content}}], "usage": {"total_tokens": 7}}), {"Retry-After": "1"})


def _scripted_session() -> transport.Session:
    service = transport.Service("http://service", "stub")
    return transport.session_of(service, lambda s: transport.Session(s, _Script(), sleep=lambda seconds: None, clock=lambda: 0.0))


@query("""
    SELECT event_id, n AS requests, CASE last WHEN 0 THEN NULL WHEN 4 THEN 'response' ELSE 'api' END AS code, (7 * n)::BIGINT AS tokens,
           array_to_string(list_transform([a, b, c][1:n], lambda d: ['success', 'http_429', 'http_401', 'http_400', 'invalid_structured_json'][d + 1]), ',') AS outcomes
    FROM (SELECT *, CASE n WHEN 1 THEN a WHEN 2 THEN b ELSE c END AS last
          FROM (SELECT *, CASE WHEN a IN (0, 3) THEN 1 WHEN b IN (0, 3) THEN 2 ELSE 3 END AS n FROM (SELECT event_id, event_id % 5 AS a, event_id // 5 % 5 AS b, event_id // 25 % 5 AS c FROM events)))
""")
def call_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call an event, whose replies its number spells: 0 an answer, 1 to 3 a status of 429, 401 or 400, 4 no object."""
    events = table(spark, sf_dir, "events").select("event_id")
    digit = lambda k: F.pmod(F.floor(F.col("event_id") / 5**k), F.lit(5)).cast("string")
    prompt = F.concat(F.col("event_id").cast("string"), F.lit("#"), digit(0), digit(1), digit(2))
    done = transport.completions(events, prompt, _scripted_session, "stub", {})
    outcomes = F.transform("requests", lambda r: F.coalesce(r["retry_reason"], r["outcome"]))
    tokens = F.aggregate("requests", F.lit(0).cast("bigint"), lambda n, r: n + r["total_tokens"])
    return done.select("event_id", F.size("requests").alias("requests"), F.col("error.code").alias("code"), tokens.alias("tokens"), F.array_join(outcomes, ",").alias("outcomes"))


@query("""
    SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_brand || '/' || p_type WHEN 1 THEN '../' || p_brand WHEN 2 THEN '/' || p_type WHEN 3 THEN '.' WHEN 4 THEN '//' || p_brand ELSE '../../' || p_type END AS resolved,
           p_partkey % 6 IN (0, 3) AS below
    FROM part
""")
def resolved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with segments that lead nowhere, back, or out of their root."""
    brand, maker, key = F.col("p_brand"), F.col("p_type"), F.col("p_partkey") % 6
    forms = [
        F.concat(F.lit("./"), brand, F.lit("//x/.././"), maker, F.lit("/")), F.concat(maker, F.lit("/../../"), brand), F.concat(F.lit("/../"), brand, F.lit("/../"), maker),
        F.concat(brand, F.lit("/./../")), F.concat(F.lit("//"), brand, F.lit("/.")), F.concat(F.lit(".././"), brand, F.lit("/../../"), maker),
    ]
    path = F.coalesce(*[F.when(key == k, form) for k, form in enumerate(forms)])
    return table(spark, sf_dir, "part").select("p_partkey", tables.resolved_path(path).alias("resolved"), tables.stays_below(path, "/data/root").alias("below"))
