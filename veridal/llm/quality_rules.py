"""Quality rules: counts of a text, then a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed to ``BUCKETS`` buckets. Two multinomials are
counted over whole tables: the raw corpus (every document) and the trusted target
(documents that a label marks good and not toxic). A document's ratio is the mean
over its words and pairs of ``log((target + PRIOR) / (raw * share + PRIOR))``, where
``share`` is the target's part of all counts; ``PRIOR`` draws buckets of few counts
towards 0. One at or above the threshold is kept. ``THRESHOLD`` lies below 0, the
ratio of a text that is as frequent in both: labelled good documents are above it
and labelled bad ones below it at two sizes (a test holds this).

The two tables of counts have ``BUCKETS`` rows whatever the corpus, so each document
is scored where it is read. Counts are shuffled, and the texts of labelled documents,
which a Bloom filter of fixed size finds in the scan.

The mean needs no fitting and is the same for every copy of a text. Windows of
three words are compared by a 64-bit hash.

Defined results: null text has no words; it fails the base rules and is not kept;
where no document is trusted every ratio is 0; rows with equal ids are judged one
by one; repeated rows count each time; texts of any length count whole; an empty
table gives an empty table; further columns are not read, whatever their names,
and pass through ``keep_clean``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridal.llm.store import cut, words

BUCKETS = 1 << 16
#: Bits of the filter of labelled ids.
BLOOM_BITS = 1 << 20
THRESHOLD = -0.08
PRIOR = 4.0
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long")


def n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` made once a row, even where the optimiser puts its expression in place of its name."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def windows_of_three(w: Column) -> Column:
    """A hash for each place where three words start."""

    def hashes(w: Column) -> Column:
        n = F.size(w)
        starts = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    return bound(w, hashes)


def repeated_places(hashes: Column) -> Column:
    """Places whose hash stands at another place too, ascending."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return pairs


def with_counts(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` (columns kept) with the base counts; ``words_`` stays for the ratio."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("words_", words(body))
    out = out.withColumn("windows_", windows_of_three(F.col("words_")))
    some = F.size(F.array_distinct("windows_")) < F.size("windows_")
    empty = F.array().cast("array<struct<h:bigint,i:int>>")
    out = out.withColumn("sorted_", F.when(some, repeated_places(F.col("windows_"))).otherwise(empty))

    def repeats(pairs: Column) -> Column:
        same = lambda x, i: x["h"].eqNullSafe(F.get(pairs, i)["h"])
        return F.filter(pairs, lambda x, i: same(x, i + 1) | F.when(i > 0, same(x, i - 1)).otherwise(False))

    out = out.withColumn("places_", F.sort_array(F.transform(bound(F.col("sorted_"), repeats), lambda x: x["i"])))
    covered = F.aggregate(
        "places_",
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        "words_",
        F.size("words_").cast("long").alias("n_words"),
        F.length(F.array_join("words_", "")).cast("long").alias("word_chars"),
        n_symbols(body).alias("n_symbols"),
        n_dup_lines(body).alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
    )


def bucketed(w: Column) -> Column:
    """Buckets of every word and every pair of neighbours."""

    def both(w: Column) -> Column:
        n = F.size(w)
        one = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int"))
        starts = F.when(n >= 2, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))
        two = F.transform(starts, lambda i: F.pmod(F.xxhash64(F.get(w, i), F.get(w, i + 1)), F.lit(BUCKETS)).cast("int"))
        return F.concat(one, two)

    return bound(w, both)


def bucket_counts(texts: DataFrame, name: str) -> DataFrame:
    """``(bucket, <name>)``: occurrences in column ``text``; at most ``BUCKETS`` rows."""
    split = texts.select(words(F.col("text")).alias("w"))  # once a text, not once a word
    each = split.select(F.explode(bucketed(F.col("w"))).alias("bucket"))
    return each.groupBy("bucket").agg(F.count("*").alias(name))


def ratio_table(raw: DataFrame, target: DataFrame) -> DataFrame:
    """One row: an array of ``BUCKETS`` values of ``log(target / raw)``, of columns ``text``."""
    sums = cut(bucket_counts(raw, "raw").join(bucket_counts(target, "target"), "bucket", "left"))
    every = raw.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(sums, "bucket", "left").na.fill(0, ["raw", "target"])  # BUCKETS rows
    ordered = F.sort_array(F.collect_list(F.struct("bucket", "raw", "target")))
    row = full.agg(ordered.alias("all"), F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    # Shrunk towards 0 where a bucket has few counts, which a document outside the target would pay for.
    share = F.col("target") / F.col("raw")
    log_ratio = F.transform("all", lambda x: F.when(F.col("target") > 0, F.log((x["target"] + PRIOR) / (x["raw"] * share + PRIOR))).otherwise(0.0))
    return cut(row.select(log_ratio.alias("ratios_")))


def judged(docs: DataFrame, ratios: DataFrame, threshold: float) -> DataFrame:
    """``docs`` (with ``text``) with the base counts, ``base_failed``, ``ratio`` and ``kept``; ``ratios`` has one row."""
    if not math.isfinite(threshold):
        raise ValueError("the threshold must be a number")
    # One row of BUCKETS numbers.
    table = with_counts(docs, "text").withColumn("buckets_", bucketed(F.col("words_"))).join(F.broadcast(ratios))
    total = F.aggregate("buckets_", F.lit(0.0), lambda a, b: a + F.get(F.col("ratios_"), b))
    table = table.withColumn("ratio", F.when(F.size("buckets_") > 0, total / F.size("buckets_")).otherwise(0.0))
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED_PERCENT)
    out = table.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("ratio") >= threshold))
    return out.drop("words_", "buckets_", "ratios_")


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``text`` of the ``docs`` (``id``, ``text``) that ``labels`` marks good and not toxic.

    Ids grow with the documents and are joined. A filter of ``BLOOM_BITS`` bits,
    which is broadcast, keeps most other texts out of the shuffle as long as the
    labels are few enough for it.
    """
    good = labels.filter("quality = 1 AND coalesce(toxic, 0) = 0").select(F.col("doc_id").alias("good_id")).filter("good_id IS NOT NULL").distinct()
    place = F.pmod(F.xxhash64("good_id"), F.lit(BLOOM_BITS))
    bits = good.select(F.floor(place / 64).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(good_id), {BLOOM_BITS}) % 64 AS int))").alias("bit"))
    bits = bits.groupBy("w").agg(F.bit_or("bit").alias("bits"))  # at most BLOOM_BITS / 64 rows
    every = docs.sparkSession.range(BLOOM_BITS // 64).select(F.col("id").cast("int").alias("w"))
    held = every.join(bits, "w", "left").na.fill(0, ["bits"]).agg(F.sort_array(F.collect_list(F.struct("w", "bits"))).alias("bits_"))
    held = cut(held.select(F.transform("bits_", lambda x: x["bits"]).alias("bits_")))
    at = F.pmod(F.xxhash64(F.col("id").cast(good.dtypes[0][1])), F.lit(BLOOM_BITS))
    maybe = docs.withColumn("at_", at).join(F.broadcast(held)).filter("(shiftright(get(bits_, cast(floor(at_ / 64) AS int)), cast(at_ % 64 AS int)) & 1L) = 1")
    return maybe.select("id", "text").join(good.hint("merge"), F.col("id") == F.col("good_id"), "left_semi").select("text")


def judge_labelled(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, base counts, ``base_failed``, ``ratio``, ``kept``.

    The trusted target are the documents that ``labels`` marks good and not toxic.
    """
    table = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    out = judged(table, ratio_table(table, labelled_texts(table, labels)), threshold)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio"]
    return out.select(F.col("id").alias(id_col), *names)


def keep_clean(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    table = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    return judged(rows, ratio_table(table, labelled_texts(table, labels)), threshold).filter("kept").select("row.*")
