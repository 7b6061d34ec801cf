"""Queries over what is shown of a decoded vector, kept fields, subsets, waits and prediction records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridal.functions import scores
from veridal.operators import filters, stages, taxonomy, validate
from veridal.plans.annotations import SMALL, brand_taxonomy
from veridal.plans.registry import query, table

_GATED = ("body_build", "eyewear")


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')")
def shown_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose attribute is of a tier that is shown; a row an attribute is broadcast."""
    shown = taxonomy.shown_attributes(brand_taxonomy(spark, sf_dir)).select(F.col("name").alias("p_brand"))
    return table(spark, sf_dir, "part").join(F.broadcast(shown), "p_brand", "left_semi").select("p_partkey", "p_brand")


_PARTS = {s.name: f"list_slice(embedding, {s.start + 1}, {s.start + s.size})::DOUBLE[]" for s in SMALL if s.kind == "single"}


@query(" UNION ALL ".join(
    f"SELECT vec_id, '{n}' AS attribute, (list_position(p, list_max(p)) - 1)::INT AS class_index FROM (SELECT vec_id, {p} AS p FROM embeddings)"
    + (" WHERE 1 / list_sum(list_transform(p, lambda v: exp(v - list_max(p)))) >= 0.35" if n in _GATED else "")
    for n, p in _PARTS.items()
))
def gated_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best class of every attribute, without classes of gated attributes that are too unsure."""
    singles = [s for s in SMALL if s.kind == "single"]
    decoded = taxonomy.decode(table(spark, sf_dir, "embeddings"), "embedding", singles)
    rows = F.explode(F.array(*[F.struct(F.lit(s.name).alias("attribute"), F.lit(s.name in _GATED).alias("gated"), F.col(s.name)["class_index"].cast("int").alias("class_index"), F.col(s.name)["confidence"].alias("confidence")) for s in singles]))
    flat = decoded.select("vec_id", rows.alias("r")).select("vec_id", "r.*")
    return flat.filter(taxonomy.passes_gate(F.col("confidence"), F.col("gated"))).select("vec_id", "attribute", "class_index")


@query("""
    SELECT l_orderkey, count(*) AS lines, coalesce(bool_and(l_returnflag IN ('A', 'N')) AND count(DISTINCT l_returnflag) = count(l_returnflag), true) AS holds
    FROM lineitem GROUP BY l_orderkey
""")
def subset_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an order's return flags are distinct and all of a closed set."""
    flags = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.collect_list("l_returnflag").alias("flags"))
    return flags.select("l_orderkey", "lines", validate.multi_value(F.col("flags"), ["A", "N"]).alias("holds"))


@query("SELECT p_partkey, 2 AS fields, p_brand || '|' || p_size AS kept FROM part")
def kept_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute maps without entries beyond the stated fields."""
    given = F.create_map(F.lit("p_type"), "p_type", F.lit("p_size"), F.col("p_size").cast("string"), F.lit("p_brand"), "p_brand", F.lit("p_name"), "p_name")
    kept = filters.only_fields(given, ["p_brand", "p_size", "p_absent"])
    return table(spark, sf_dir, "part").select("p_partkey", F.size(kept).alias("fields"), F.concat_ws("|", kept["p_brand"], kept["p_size"]).alias("kept"))


@query("SELECT event_id, least(1 << (event_id % 7)::INT, 16)::BIGINT AS whole_seconds FROM events")
def judge_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole seconds of a judge's waits; what is random in them stays below half a second."""
    wait = scores.judge_delay(F.col("event_id") % 7)
    return table(spark, sf_dir, "events").select("event_id", F.round(wait - 0.25).cast("long").alias("whole_seconds"))


@query("""
    SELECT c_custkey::VARCHAR AS sample_id, 'direct' AS method, 'stub' AS model_id, 'v1' AS prompt_version, CASE WHEN ok THEN 'success' ELSE 'error' END AS status,
           CASE WHEN ok THEN trim(c_name) END AS caption, CASE WHEN ok THEN c_mktsegment END AS segment,
           CASE WHEN NOT ok THEN 'bad_' || lower(c_mktsegment) END AS code, CASE WHEN NOT ok THEN 'Bad ' || c_mktsegment || ': ' || c_name END AS message
    FROM (SELECT *, c_custkey % 4 <> 0 AS ok FROM customer)
""")
def prediction_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of answered and failed samples, as a method's log holds them."""
    ok = F.col("c_custkey") % 4 != 0
    answered = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("sample_id"), "c_name", "c_mktsegment", F.when(ok, "success").otherwise("error").alias("status"),
        F.when(~ok, F.concat(F.lit("Bad "), "c_mktsegment", F.lit(": "), "c_name")).alias("error"),
    )
    rows = stages.prediction_rows(answered, "direct", "stub", "v1", F.concat(F.lit(" \t"), "c_name", F.lit("\n")), F.create_map(F.lit("segment"), "c_mktsegment"))
    return rows.select("sample_id", "method", "model_id", "prompt_version", "status", "caption", F.col("attributes")["segment"].alias("segment"), "error.code", "error.message")
