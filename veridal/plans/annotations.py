"""Queries over documents, labels, vectors and the star tables: joins, verdicts, decoding, review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridal.functions import cells, jsons, scores, text
from veridal.operators import joins, latest, overlay, ranks, similarity, stats, taxonomy, validate
from veridal.plans.registry import query, table


@query("SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def required_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return joins.required_join(table(spark, sf_dir, "orders"), customers, ["o_custkey"]).select("o_orderkey", "c_mktsegment")


@query("SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)")
def semi_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, each of which must belong to a document; fails where one does not."""
    return joins.required_semi(table(spark, sf_dir, "labels").select("doc_id", "quality"), table(spark, sf_dir, "documents"), ["doc_id"])


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def missing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.unmatched(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id")


@query("SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def chain_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    regions = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return overlay.chain_index(table(spark, sf_dir, "supplier"), nations, regions, "s_nationkey", "n_regionkey").select("s_suppkey", "n_name", "r_name")


@query("SELECT lang, count(*) FILTER (quality = 1) AS n_true, count(*) FILTER (quality = 0) AS n_false, count(*) FILTER (quality IS NULL) AS n_null FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def verdict_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.groupBy("lang").agg(*stats.verdict_counts(F.col("quality") == 1, "n_"))


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of checks per document: quality and toxic, mentioned where a label exists."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    check = lambda c: F.struct(F.col(c).isNotNull().alias("mentioned"), (F.col(c) == 1).alias("is_correct"))
    return rows.withColumn("checks", F.create_map(F.lit("quality"), check("quality"), F.lit("toxic"), check("toxic")))


@query("""
    SELECT doc_id, lang, 'quality' AS field, quality IS NOT NULL AS mentioned, quality = 1 AS is_correct FROM documents LEFT JOIN labels USING (doc_id)
    UNION ALL SELECT doc_id, lang, 'toxic', toxic IS NOT NULL, toxic = 1 FROM documents LEFT JOIN labels USING (doc_id)
""")
def long_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.long_form(checks(spark, sf_dir), ["doc_id", "lang"], "checks")


def _fields(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, "quality"), (1, "toxic"), (2, "style")], "position int, field string")


_DETAIL = """
    WITH l AS (SELECT lang, 'quality' AS field, quality AS v FROM documents LEFT JOIN labels USING (doc_id)
               UNION ALL SELECT lang, 'toxic', toxic FROM documents LEFT JOIN labels USING (doc_id)),
    f AS (SELECT * FROM (VALUES (0, 'quality'), (1, 'toxic'), (2, 'style')) t(position, field)),
    d AS (SELECT g.lang, f.position, f.field, count(*) FILTER (v IS NOT NULL) AS mentioned, count(*) FILTER (v = 1) AS correct,
                 count(*) FILTER (v = 0) AS incorrect, count(*) FILTER (v IS NULL AND l.field IS NOT NULL) AS not_mentioned
          FROM (SELECT DISTINCT lang FROM documents) g CROSS JOIN f LEFT JOIN l ON l.lang = g.lang AND l.field = f.field GROUP BY ALL)
"""


@query(_DETAIL + "SELECT * FROM d")
def field_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.field_detail(long_form(spark, sf_dir), ["lang"], _fields(spark))


@query(_DETAIL + "SELECT lang, round(sum(mentioned) / (count(*) * any_value(n)), 6) AS coverage FROM d JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY 1) USING (lang) GROUP BY lang")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    sums = field_detail(spark, sf_dir).groupBy("lang").agg(F.sum("mentioned").alias("m"))
    return sums.join(rows, "lang").select("lang", F.round(stats.coverage(F.col("m"), F.col("n"), 3), 6).alias("coverage"))


@query("""
    SELECT doc_id, (quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT AS mentioned, (quality IS NULL)::INT + (toxic IS NULL)::INT AS not_mentioned,
           coalesce((quality = 1)::INT, 0) + coalesce((toxic = 1)::INT, 0) AS correct, coalesce((quality = 0)::INT, 0) + coalesce((toxic = 0)::INT, 0) AS incorrect,
           (quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT AS evaluated
    FROM documents LEFT JOIN labels USING (doc_id)
""")
def row_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks(spark, sf_dir).select("doc_id", stats.row_summary(F.map_values("checks")).alias("s")).select("doc_id", "s.*")


@query("SELECT event_type, count(*) AS rows, count(*) FILTER ((value >= 40) = (event_id % 3 > 0)) AS valid FROM events GROUP BY event_type")
def tri_state_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as checks that mention something from a value of 40 and have a verdict for two ids of three."""
    check = F.struct((F.col("value") >= 40).alias("mentioned"), F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 2 == 0).alias("is_correct"))
    rows = table(spark, sf_dir, "events").withColumn("checks", F.create_map(F.lit("only"), check))
    return rows.groupBy("event_type").agg(F.count("*").alias("rows"), F.count_if(validate.tri_state_map(F.col("checks"))).alias("valid"))


def shipping_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ship month as field, line status and flag as method, a low discount as a right verdict."""
    rows = table(spark, sf_dir, "lineitem").withColumn("field", F.month("l_shipdate")).withColumn("method", F.concat("l_returnflag", "l_linestatus"))
    right = (F.col("l_discount") < 0.055) & (F.col("l_quantity") < 40)
    return rows.groupBy("field", "method").agg(F.count_if(right).alias("correct"), F.count_if(~right).alias("incorrect"))


_SHIPPING = """
    WITH d AS (SELECT month(l_shipdate) AS field, l_returnflag || l_linestatus AS method, count(*) FILTER (l_discount < 0.055 AND l_quantity < 40) AS correct,
                      count(*) FILTER (NOT (l_discount < 0.055 AND l_quantity < 40)) AS incorrect FROM lineitem GROUP BY ALL),
    r AS (SELECT *, correct + incorrect AS support, correct / nullif(correct + incorrect, 0) AS rate, max(correct / nullif(correct + incorrect, 0)) OVER (PARTITION BY field) AS top FROM d)
"""


@query(_SHIPPING + """
    SELECT field::INT AS field, best, round(best_rate, 6) AS best_rate, best_support,
           CASE WHEN best_rate IS NULL THEN 'Chưa có dữ liệu để kết luận.' WHEN most < 10 THEN 'Ít case được mô tả; chỉ tham khảo.'
                WHEN best_support < 30 THEN upper(best) || ' cao nhất nhưng ít case; chỉ tham khảo.' WHEN best_rate < 0.60 THEN 'Cả ba còn yếu; chưa tự động gán nhãn.'
                WHEN gap < 0.05 THEN 'Ba luồng gần tương đương.' ELSE upper(best) || ' tốt nhất ở thuộc tính này.' END AS conclusion
    FROM (SELECT field, max(top) AS best_rate, max(rate) - min(rate) AS gap, max(support) AS most, max(support) FILTER (rate = top) AS best_support,
                 string_agg(method, ', ' ORDER BY method) FILTER (rate = top) AS best FROM r GROUP BY field)
""")
def decision_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    detail = shipping_detail(spark, sf_dir).withColumn("position", F.col("method"))
    return stats.decision(detail, "field", "method", "position").withColumn("best_rate", F.round("best_rate", 6))


@query("""
    WITH d AS (SELECT l_returnflag AS g, l_suppkey % 20 AS field, count(*) FILTER (l_discount < 0.055) AS c, count(*) FILTER (l_discount >= 0.055) AS i FROM lineitem GROUP BY ALL),
    r AS (SELECT *, c / (c + i) AS rate FROM d WHERE c + i >= 10),
    k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY rate, field) AS low, row_number() OVER (PARTITION BY g ORDER BY rate DESC, field) AS high FROM r)
    SELECT g, field, round(rate, 6) AS rate, CASE WHEN low <= 3 THEN low::INT END AS weakest, CASE WHEN high <= 3 THEN high::INT END AS strongest FROM k WHERE low <= 3 OR high <= 3
""")
def weak_strong_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.col("l_discount") < 0.055
    detail = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("g"), (F.col("l_suppkey") % 20).alias("field")).agg(F.count_if(low).alias("correct"), F.count_if(~low).alias("incorrect"))
    detail = detail.withColumn("mentioned", F.col("correct") + F.col("incorrect")).withColumn("position", F.col("field"))
    return stats.extremes(detail, "g", 3, F.lit(10)).withColumn("rate", F.round("rate", 6))


@query("""
    WITH w AS (SELECT o_custkey AS c_custkey, max_by(o_orderkey, o_orderkey) FILTER (o_orderstatus = 'F') AS f, max_by(o_orderpriority, o_orderkey) FILTER (o_orderstatus = 'F') AS fp,
                      max_by(o_orderkey, o_orderkey) FILTER (o_orderstatus = 'O') AS o, max_by(o_orderpriority, o_orderkey) FILTER (o_orderstatus = 'O') AS op FROM orders GROUP BY 1)
    SELECT c_custkey, c_name, coalesce(f::VARCHAR, '') AS "F_o_orderkey", coalesce(fp, '') AS "F_o_orderpriority", coalesce(o::VARCHAR, '') AS "O_o_orderkey", coalesce(op, '') AS "O_o_orderpriority"
    FROM customer LEFT JOIN w USING (c_custkey)
""")
def wide_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey").withColumn("place", F.col("o_orderkey"))
    return joins.wide_merge(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), orders, "c_custkey", "o_orderstatus", ["F", "O"], ["o_orderkey", "o_orderpriority"], "place")


def brand_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as attributes, of which every third takes several values; their types are the classes."""
    brands = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("classes"))
    ordered = brands.withColumn("position", F.row_number().over(Window.orderBy("p_brand")) - 1)  # a row a brand
    kind = F.when(F.col("position") % 3 == 2, "multi").otherwise("single")
    schema = ordered.select("position", F.col("p_brand").alias("name"), kind.alias("kind"), "classes")
    return taxonomy.compile_attributes(schema, {"Brand#1": "strong", "Brand#2": "moderate", "Brand#3": "unvalidated"})


_BRANDS = """
    SELECT p_brand AS name, row_number() OVER (ORDER BY p_brand) - 1 AS position, count(DISTINCT p_type) AS size,
           (sum(count(DISTINCT p_type)) OVER (ORDER BY p_brand) - count(DISTINCT p_type))::BIGINT AS start
    FROM part GROUP BY p_brand
"""


@query(f"""
    SELECT name, position::INT AS position, CASE WHEN position % 3 = 2 THEN 'multi' ELSE 'single' END AS kind, start, (start + size)::BIGINT AS stop,
           CASE name WHEN 'Brand#1' THEN 'strong' WHEN 'Brand#2' THEN 'moderate' WHEN 'Brand#3' THEN 'unvalidated' ELSE 'hidden' END AS tier,
           name IN ('Brand#1', 'Brand#2', 'Brand#3') AS filterable, name = 'Brand#2' AS gated
    FROM ({_BRANDS})
""")
def taxonomy_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brand_taxonomy(spark, sf_dir).select("name", "position", "kind", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "tier", "filterable", "gated")


@query(f"""
    WITH b AS ({_BRANDS})
    SELECT l_orderkey, l_linenumber, name AS attribute, (l_suppkey % (SELECT sum(size) + 5 FROM b) - start)::BIGINT AS class_index
    FROM lineitem LEFT JOIN b ON l_suppkey % (SELECT sum(size) + 5 FROM b) BETWEEN start AND start + size - 1
""")
def logit_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attribute and class of a place for every line; some places are beyond the vector."""
    places = brand_taxonomy(spark, sf_dir).select("name", "start", "stop").orderBy("start").collect()  # a row an attribute
    stop = places[-1]["stop"]
    found = taxonomy.place_of(F.col("l_suppkey") % (stop + 5), [p["start"] for p in places], [p["name"] for p in places], stop)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", found.alias("f")).select("l_orderkey", "l_linenumber", "f.attribute", F.col("f.class_index").cast("long").alias("class_index"))


#: Attributes whose classes tile a vector of 64.
SMALL = taxonomy.slices_of([("age", "single", 6), ("gender", "single", 2), ("body_build", "single", 3), ("upper_clothing_type", "single", 25), ("bag_type", "multi", 11), ("headwear", "single", 8), ("eyewear", "single", 4), ("face_mask", "single", 5)])


@query("SELECT vec_id, " + ", ".join(
    f"list_position(p_{s.name}, list_max(p_{s.name})) - 1 AS {s.name}_class, round(1 / list_sum(list_transform(p_{s.name}, lambda v: exp(v - list_max(p_{s.name})))), 6) AS {s.name}_confidence" for s in SMALL if s.kind == "single")
    + " FROM (SELECT vec_id, " + ", ".join(f"list_slice(embedding, {s.start + 1}, {s.start + s.size})::DOUBLE[] AS p_{s.name}" for s in SMALL if s.kind == "single") + " FROM embeddings)")
def decode_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    singles = [s for s in SMALL if s.kind == "single"]
    out = taxonomy.decode(table(spark, sf_dir, "embeddings"), "embedding", singles)
    return out.select("vec_id", *[c for s in singles for c in (F.col(f"{s.name}.class_index").alias(f"{s.name}_class"), F.round(f"{s.name}.confidence", 6).alias(f"{s.name}_confidence"))])


@query("""
    SELECT vec_id, len(list_filter(list_slice(embedding, 37, 47), lambda v: 1 / (1 + exp(-v::DOUBLE)) >= 0.5))::INT AS picked,
           array_to_string(list_filter(range(0, 11), lambda i: 1 / (1 + exp(-embedding[37 + i]::DOUBLE)) >= 0.5), '|') AS classes FROM embeddings
""")
def decode_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    bag = next(s for s in SMALL if s.kind == "multi")
    found = taxonomy.decode_multi(F.col("embedding"), bag, 0.5)
    out = table(spark, sf_dir, "embeddings").select("vec_id", found.alias("found"))
    return out.select("vec_id", F.size("found").alias("picked"), F.array_join(F.transform("found", lambda c: c["class_index"].cast("string")), "|").alias("classes"))


@query("SELECT vec_id, abs(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) <= 0.001 AS is_unit, len(embedding)::INT AS size FROM embeddings")
def unit_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", scores.is_unit(F.col("embedding")).alias("is_unit"), F.size("embedding").alias("size"))


@query("""
    WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS item_id, list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score
               FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0)
    SELECT query_id, item_id, round(score, 6) AS score, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS place FROM s) WHERE place <= 5
""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100 against all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    items = vectors.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    return similarity.top_matches(queries, items, 5).withColumn("score", F.round("score", 6))


_UNESCAPE = "replace(replace(replace(replace(replace(replace(replace(replace({}, '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&#39;', ''''), '&amp;', '&')"


@query("SELECT page_id, md5(trim(regexp_replace(lower(regexp_replace(replace(" + _UNESCAPE.format(_UNESCAPE.format("html")) + ", '_', ' '), '[!-/:-@\\[-`{-~]', '', 'g')), '\\s+', ' ', 'g'))) AS digest FROM pages")
def canonical_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.canonical_text(F.col("html")).cast("binary")).alias("digest"))


@query("""
    WITH c AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 7 = 1 THEN 'none' ELSE replace(p_name, ' ', '|') END AS cell FROM part)
    SELECT p_partkey, CASE cell WHEN '' THEN NULL WHEN 'none' THEN 0 ELSE len(string_split(cell, '|'))::INT END AS codes, cell AS again FROM c
""")
def cell_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey") % 7
    cell = F.when(key == 0, "").when(key == 1, "none").otherwise(F.replace("p_name", F.lit(" "), F.lit("|")))
    out = table(spark, sf_dir, "part").select("p_partkey", cells.decode_cell(cell).alias("v"))
    return out.select("p_partkey", F.when(F.col("v").isNotNull(), F.size("v")).alias("codes"), cells.encode_cell(F.col("v")).alias("again"))


@query("SELECT event_id, json_keys(props) = ['k'] AS exact, json_type(props, '$.k') IN ('BIGINT', 'UBIGINT') AS whole, (props->>'k')::BIGINT AS k FROM events")
def json_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", jsons.has_exact_keys(F.col("props"), ["k"]).alias("exact"), (jsons.kind_at(F.col("props"), "$.k") == "BIGINT").alias("whole"), jsons.number_at(F.col("props"), "$.k").alias("k"))


@query("""
    SELECT p_partkey, concat_ws(',', CASE WHEN p_size > 45 THEN 'size' END, CASE WHEN length(p_name) NOT BETWEEN 1 AND 12 THEN 'name' END, CASE WHEN p_brand NOT IN ('Brand#11', 'Brand#12', 'Brand#13') THEN 'brand' END) AS violations FROM part
""")
def annotation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validate.violations(size=F.col("p_size") <= 45, name=text.length_between(F.col("p_name"), 1, 12), brand=validate.single_value(F.col("p_brand"), ["Brand#11", "Brand#12", "Brand#13"]))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(found, ",").alias("violations"))


_CORRECTED = """
    r AS (SELECT doc_id, lang AS method, doc_id::VARCHAR AS sample_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)),
    o AS (SELECT doc_id, lang, quality = 1 AS cap, CASE WHEN toxic = 1 THEN true END AS att, doc_id % 3 = 0 AS has_att FROM documents JOIN labels USING (doc_id) WHERE doc_id % 2 = 0)
"""


def corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reviews; labels of even ids as corrections, with an attribute correction for ids divisible by three."""
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("method"), F.col("doc_id").cast("string").alias("sample_id"), "doc_id")
    both = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id").filter("doc_id % 2 = 0")
    toxic = F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("toxic"), F.when(F.col("toxic") == 1, True))).otherwise(F.create_map().cast("map<string,boolean>"))
    fixes = both.select(text.key_of(F.col("lang"), F.col("doc_id")).alias("key"), F.lit(True).alias("caption_given"), (F.col("quality") == 1).alias("caption_correct"), toxic.alias("attributes"))
    return overlay.with_overrides(rows, fixes)


@query("WITH " + _CORRECTED + """
    SELECT r.doc_id, CASE WHEN cap THEN 'true' WHEN NOT cap THEN 'false' ELSE '' END AS human_caption,
           CASE WHEN NOT coalesce(has_att, false) THEN '' WHEN att THEN 'true' ELSE 'null' END AS human_toxic
    FROM r LEFT JOIN o ON r.doc_id = o.doc_id AND r.method = o.lang
""")
def overlay_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corrected(spark, sf_dir)
    return rows.select("doc_id", overlay.human_caption(F.col("override_caption_correct")).alias("human_caption"), overlay.human_attribute(F.col("override_attributes"), F.lit("toxic")).alias("human_toxic"))


@query("""
    SELECT doc_id, field, CASE WHEN v IS NULL THEN 'Không nhắc (không tính lỗi)' WHEN v = 1 THEN 'Có nhắc và khớp nhãn' ELSE 'Có nhắc nhưng không khớp nhãn' END AS reading,
           CASE WHEN v = 1 THEN 'true' WHEN v = 0 THEN 'false' ELSE 'null' END AS verdict
    FROM (SELECT doc_id, 'quality' AS field, quality AS v FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT doc_id, 'toxic', toxic FROM documents LEFT JOIN labels USING (doc_id))
""")
def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(spark, sf_dir).select("doc_id", "field", text.mention_text(F.col("mentioned"), F.col("is_correct")).alias("reading"), text.tri_state(F.col("is_correct")).alias("verdict"))


@query("""
    SELECT conv_id, turn, ok AS accepted FROM (SELECT conv_id, turn, ok, row_number() OVER (PARTITION BY conv_id ORDER BY ok DESC, CASE WHEN ok THEN turn ELSE -turn END) AS rn
        FROM (SELECT *, coalesce(role = 'assistant' AND length(text) > 400, false) AS ok FROM conversations)) WHERE rn = 1
""")
def round_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    out = latest.first_accepted_or_last(rows, "conv_id", "turn", (F.col("role") == "assistant") & (F.length("text") > 400))
    return out.select("conv_id", "turn", F.col("accepted_").alias("accepted"))


@query("""
    SELECT conv_id, coalesce(list_sort(list_distinct(list(turn // 2) FILTER (role = 'user'))), []) = coalesce(list_sort(list_distinct(list(turn // 2) FILTER (role = 'assistant'))), []) AS covered
    FROM conversations GROUP BY conv_id
""")
def qa_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = F.floor(F.col("turn") / 2)
    sets = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set(F.when(F.col("role") == "user", pair)).alias("q"), F.collect_set(F.when(F.col("role") == "assistant", pair)).alias("a"))
    return sets.select("conv_id", joins.same_sets(F.col("q"), F.col("a")).alias("covered"))


@query("SELECT conv_id, md5(string_agg(role || ': ' || trim(text), chr(10) ORDER BY turn, role, text)) AS prompt FROM conversations GROUP BY conv_id")
def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    lines = F.transform(turns, lambda t: F.concat(t["role"], F.lit(": "), F.trim(t["text"])))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.md5(F.array_join(lines, "\n").cast("binary")).alias("prompt"))


@query("""
    SELECT lang, round((sum((v = 'correct')::INT) + sum((v = 'not_applicable')::INT)) / nullif(sum((v IN ('correct', 'incorrect', 'not_applicable'))::INT), 0), 6) AS accuracy,
           round(sum((v IN ('correct', 'incorrect', 'not_applicable'))::INT) / 200.0, 6) AS coverage, sum((v IN ('not_visible', 'golden_needs_review'))::INT)::BIGINT AS needs_review
    FROM (SELECT lang, CASE WHEN quality IS NULL AND n_chars < 400 THEN 'not_applicable' WHEN quality IS NULL THEN 'not_visible' WHEN toxic = 1 AND quality = 0 THEN 'golden_needs_review'
                            WHEN quality = 1 THEN 'correct' ELSE 'incorrect' END AS v FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY lang
""")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    v = (
        F.when(F.col("quality").isNull() & (F.col("n_chars") < 400), "not_applicable").when(F.col("quality").isNull(), "not_visible")
        .when((F.col("toxic") == 1) & (F.col("quality") == 0), "golden_needs_review").when(F.col("quality") == 1, "correct").otherwise("incorrect")
    )
    out = stats.accuracy_summary(rows.withColumn("v", v), ["lang"], "v", 200)
    return out.withColumns({c: F.round(c, 6) for c in ("accuracy", "coverage")})


@query("""
    WITH l AS (SELECT doc_id, 'q' AS f, quality = 1 AS ok FROM labels UNION ALL SELECT doc_id, 't', toxic = 0 FROM labels)
    SELECT round(avg(ok::INT), 6) AS micro, round((SELECT avg(a) FROM (SELECT avg(ok::INT) AS a FROM l GROUP BY f)), 6) AS macro,
           round((SELECT avg((n = 2)::INT) FROM (SELECT count(*) FILTER (ok) AS n FROM l GROUP BY doc_id)), 6) AS exact FROM l
""")
def micro_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.explode(F.create_map(F.lit("q"), F.col("quality") == 1, F.lit("t"), F.col("toxic") == 0)).alias("f", "ok")
    out = stats.micro_macro(table(spark, sf_dir, "labels").select("doc_id", pairs), "doc_id", "f", F.col("ok"), 2)
    return out.select(*[F.round(c, 6).alias(c) for c in ("micro", "macro", "exact")])


@query("SELECT doc_id, list_sort(string_split(lang || '|' || source, '|')) = list_sort(string_split(source || '|' || CASE WHEN doc_id % 5 = 0 THEN 'xx' ELSE lang END, '|')) AS same FROM documents")
def auto_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = cells.decode_cell(F.concat_ws("|", "lang", "source"))
    b = cells.decode_cell(F.concat_ws("|", "source", F.when(F.col("doc_id") % 5 == 0, "xx").otherwise(F.col("lang"))))
    return table(spark, sf_dir, "documents").select("doc_id", cells.same_answer(a, b).alias("same"))


@query("SELECT doc_id, CASE WHEN quality = 0 AND toxic = 1 THEN 0 WHEN toxic > 0 THEN 1 WHEN quality = 0 THEN 2 ELSE 3 END AS level FROM labels")
def severity_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    useless = (F.col("quality") == 0) & (F.col("toxic") == 1)
    return table(spark, sf_dir, "labels").select("doc_id", stats.severity_level(1 - F.col("quality"), F.col("toxic"), useless).alias("level"))


@query("""
    SELECT doc_id, round(c, 6) AS confidence, CASE WHEN c IS NULL THEN 'pending' WHEN c >= 0.75 THEN 'accepted' ELSE 'review' END AS decision
    FROM (SELECT doc_id, 0.4 * least(greatest(n_chars / 2000.0, 0), 1) + 0.3 * quality + 0.3 * (1 - toxic) AS c FROM documents LEFT JOIN labels USING (doc_id))
""")
def weighted_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    c = scores.weighted_confidence([F.col("n_chars") / 2000.0, F.col("quality").cast("double"), 1 - F.col("toxic").cast("double")])
    return rows.select("doc_id", c.alias("c")).select("doc_id", F.round("c", 6).alias("confidence"), F.when(F.col("c").isNull(), "pending").when(F.col("c") >= 0.75, "accepted").otherwise("review").alias("decision"))


@query("""
    WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity / 2 - 3 AS x0, l_tax * 100 AS y0, l_quantity * 3 + 0.5 AS x1, l_discount * 900 AS y1 FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN x1 > x0 AND y1 > y0 THEN greatest(0, least(99, floor(x0)))::INT END AS "left", CASE WHEN x1 > x0 AND y1 > y0 THEN greatest(greatest(0, least(99, floor(x0))) + 1, least(100, ceil(x1)))::INT END AS "right",
           CASE WHEN x1 > x0 AND y1 > y0 THEN greatest(0, least(79, floor(y0)))::INT END AS top, CASE WHEN x1 > x0 AND y1 > y0 THEN greatest(greatest(0, least(79, floor(y0))) + 1, least(80, ceil(y1)))::INT END AS bottom
    FROM b WHERE NOT (x0 BETWEEN 0 AND 1 AND y0 BETWEEN 0 AND 1 AND x1 BETWEEN 0 AND 1 AND y1 BETWEEN 0 AND 1)
""")
def box_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 2 - 3).alias("x0"), (F.col("l_tax") * 100).alias("y0"), (F.col("l_quantity") * 3 + 0.5).alias("x1"), (F.col("l_discount") * 900).alias("y1"))
    box = scores.box_crop(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.lit(100), F.lit(80))
    return rows.select("l_orderkey", "l_linenumber", box.alias("b")).select("l_orderkey", "l_linenumber", "b.left", "b.right", "b.top", "b.bottom")


@query("SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey::VARCHAR))::INT AS as_text, (row_number() OVER (ORDER BY c_custkey))::INT AS as_number FROM customer")
def sort_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = ranks.global_rank(table(spark, sf_dir, "customer").select("c_custkey"), [F.col("c_custkey").cast("string")], "as_text")
    out = ranks.global_rank(ids, [F.col("c_custkey")], "as_number")
    return out.select("c_custkey", F.col("as_text").cast("int").alias("as_text"), F.col("as_number").cast("int").alias("as_number"))


@query("SELECT doc_id, sha256(text) AS sha, octet_length(encode(text))::INT AS bytes FROM documents")
def hash_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").alias("bytes"))


@query("SELECT o_orderkey, CASE WHEN total = 0 THEN '—' ELSE part || '/' || total END AS share FROM (SELECT o_orderkey, count(*) FILTER (l_discount > 0.05) AS part, count(l_linenumber) AS total FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)")
def share_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_discount") > 0.05).alias("part"), F.count("*").alias("total"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left").na.fill(0)
    return rows.select("o_orderkey", F.when(F.col("total") == 0, text.NO_RATE).otherwise(F.concat(F.col("part").cast("string"), F.lit("/"), F.col("total").cast("string"))).alias("share"))


@query("SELECT event_type, least(8.0, 0.5 * pow(2, a)) AS delay, s IN (408, 409, 429, 500, 502, 503, 504) AS again, count(*) AS rows FROM (SELECT event_type, event_id % 6 AS a, 400 + event_id % 105 AS s FROM events) GROUP BY ALL")
def retry_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 6).alias("a"), (400 + F.col("event_id") % 105).alias("s"))
    return rows.groupBy("event_type", scores.retry_delay(F.col("a"), F.lit(None).cast("string")).alias("delay"), scores.is_retryable(F.col("s")).alias("again")).agg(F.count("*").alias("rows"))


@query("SELECT p_partkey, upper(p_name[1]) || replace(p_name[2:], '_', ' ') AS label FROM part")
def humanized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.humanize(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("label"))


#: The characters of Windows-1252 for the bytes 0x80 to 0x9F; five bytes have none and stay as they are.
_SPECIAL = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"


def _mangled(x: Column, special: bool) -> Column:
    """UTF-8 read as Latin-1 or as Windows-1252."""
    read = F.decode(F.encode(x, "UTF-8"), "ISO-8859-1")
    return F.translate(read, "".join(map(chr, range(0x80, 0xA0))), _SPECIAL) if special else read


@query("SELECT doc_id, sha256(coalesce(text, '')) AS latin, sha256(coalesce(text, '')) AS windows, sha256(coalesce(text, '')) AS both FROM documents")
def mended_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, mangled in one round of either code page and in two rounds of both, mended."""
    x = F.coalesce("text", F.lit(""))
    forms = {"latin": _mangled(x, False), "windows": _mangled(x, True), "both": _mangled(_mangled(x, True), False)}
    return table(spark, sf_dir, "documents").select("doc_id", *[F.sha2(text.repair_mojibake(form).cast("binary"), 256).alias(name) for name, form in forms.items()])


@query("""
    SELECT page_id, trim(regexp_replace(lower(regexp_replace(replace(t, '_', ' '), '[!-/:-@\\[-`{-~]', '', 'g')), '\\s+', ' ', 'g')) AS canonical
    FROM (SELECT page_id, 'A&B <' || page_id || '> – é_X' AS t FROM pages)
""")
def every_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical text where entities stand twice over, by name and number."""
    shown = F.concat(F.lit("A&amp;amp;B &lt;"), F.col("page_id").cast("string"), F.lit("&gt; &#8211; &eacute;_X"))
    return table(spark, sf_dir, "pages").select("page_id", text.canonical_text(shown, every_entity=True).alias("canonical"))
