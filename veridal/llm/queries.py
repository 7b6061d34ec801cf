"""Queries over the operators of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridal.llm import collocations, exact_dedup, hmm_lm, jaccard_join, line_crf, line_dedup, mixing, packing, prefix_trie, private_data, quality_rules, token_files, url_filter
from veridal.llm.store import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(read_table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(read_table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(read_table(spark, sf_dir, "documents"), least_rate=mixing.LEAST_RATE)


#: Fixed values: (verdict, host, path) of the rules.
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files_round_trip(read_table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_labelled(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.score_documents(read_table(spark, sf_dir, "documents"))


def op9_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.find_private(read_table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeated_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read_table(spark, sf_dir, "conversations"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_ngram_jaccard_join, op2_best_fit_packing, op3_mix_sources, op4_url_filter, op5_token_files, op6_exact_dedup, op7_quality_rules,
    op8_lm_scoring, op9_private_data, op10_quality_classifier, op11_line_dedup, op12_prefix_trie, op13_collocations,
)}

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": """
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
            FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
            FROM words
        ), shingles AS (SELECT doc_id, unnest(s) AS g FROM sets),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM common JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * c >= 80 * (len(x.s) + len(y.s) - c)),
        edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b, root FROM reach JOIN edges ON a = doc_id WHERE root < b)
        SELECT doc_id, any_value(len(s))::BIGINT AS n_shingles, min(root) AS component_id FROM reach JOIN sets USING (doc_id) GROUP BY doc_id
    """,
    "op3_mix_sources": mixing.oracle_sql(),
    "op6_exact_dedup": """
        WITH d AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents
        )
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY t) AS keep_id,
               count(*) OVER (PARTITION BY t) AS group_size,
               row_number() OVER (PARTITION BY t ORDER BY doc_id DESC) = 1 AS kept,
               sha256(t) AS text_sha256
        FROM d
    """,
    "op11_line_dedup": """
        WITH lines AS (
            SELECT doc_id, unnest(s) AS line, unnest(range(len(s))) AS k
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)
        ), keyed AS (
            SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM lines
        ), repeated AS (
            SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
        ), judged AS (SELECT keyed.*, coalesce(doc_id <> last, false) AS gone FROM keyed LEFT JOIN repeated USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY doc_id
    """,
    "op12_prefix_trie": """
        WITH turns AS (
            SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS h,
                   octet_length(encode(coalesce(text, '')))::BIGINT AS bytes, turn
            FROM conversations WHERE conv_id IS NOT NULL
        ), own AS (
            SELECT conv_id, list({'h': h, 'bytes': bytes} ORDER BY turn NULLS FIRST, h) AS t,
                   xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
                       lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384)))) % 9 AS head
            FROM turns GROUP BY conv_id
        ), rebuilt AS (
            SELECT a.conv_id, list_concat(coalesce(b.t[1:a.head], []), a.t[a.head + 1:]) AS t
            FROM own a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5
        ), paths AS (
            SELECT conv_id, len(t) AS len, unnest(range(len(t) + 1)) AS depth, t FROM rebuilt
        ), members AS (
            SELECT conv_id, len, depth, array_to_string(list_transform(t[1:depth], lambda x: x.h), ',') AS path,
                   CASE WHEN depth > 0 THEN array_to_string(list_transform(t[1:depth - 1], lambda x: x.h), ',') END AS above, coalesce(t[depth].bytes, 0) AS bytes
            FROM paths
        ), nodes AS (
            SELECT depth, path, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
                   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len = depth), '')) AS ends_sha256
            FROM members GROUP BY depth, path
        ), children AS (SELECT depth - 1 AS depth, above AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
        full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (depth, path)),
        -- each node with each node of its subtree, through the path of the lower one's least member
        below AS (
            SELECT m.depth, m.path, count(*) FILTER (n.n_children = 0) AS n_leaves, sum((n.n_convs - 1) * n.bytes)::BIGINT AS saved_tokens
            FROM full_nodes n JOIN members m ON m.conv_id = n.conv_id AND m.depth <= n.depth GROUP BY ALL
        )
        SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
        FROM full_nodes f JOIN below USING (depth, path) LEFT JOIN nodes p ON p.depth = f.depth - 1 AND p.path = f.above
    """,
    "op13_collocations": """
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
            FROM documents
        ), words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
        total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
        grams AS (
            SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
            FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, (VALUES (1), (2), (3), (4)) s(size))
        ), counts AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS w, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
        cuts AS (
            SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y
            FROM (SELECT *, unnest(range(1, size)) AS k FROM counts WHERE size > 1)
        ), scored AS (
            SELECT cuts.lang, cuts.phrase, cuts.a, k, f.a AS l, g.a AS r, ((2000000::HUGEINT * cuts.a) // (f.a + g.a))::BIGINT AS score
            FROM cuts JOIN counts f ON f.lang = cuts.lang AND f.phrase = x JOIN counts g ON g.lang = cuts.lang AND g.phrase = y
        ), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        inner_phrases AS (
            SELECT lang, array_to_string(w[i:i + size2 - 1], ' ') AS phrase, max(a) AS around
            FROM (SELECT lang, a, w, size2, unnest(range(1, size - size2 + 2)) AS i FROM counts, (VALUES (2), (3)) s(size2) WHERE size2 < size) GROUP BY ALL
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM best LEFT JOIN inner_phrases USING (lang, phrase) JOIN total USING (lang)
        WHERE around IS NULL OR 100::HUGEINT * around < 80::HUGEINT * a
        QUALIFY rank <= 2000
    """,
}
