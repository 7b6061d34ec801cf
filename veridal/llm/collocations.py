"""Phrases of frequent words, counted by automata over candidates from sketches.

Texts are lower-cased (A-Z), cut into pieces and words, and written anew as
``" word word word "``, pieces apart by line breaks, so that a phrase between two
delimiters is found only as whole words of one piece.

A sketch a phrase length bounds the counts from above: each phrase adds to one
bucket, so a bucket holds at least the count of each of its phrases. Words come
first; a longer phrase is looked at only where its first and its last words, one
fewer each, are in buckets that reach the threshold. Tasks send the buckets that
they touch; sums are thresholded block by block, and one bit a bucket is
broadcast, which is a bounded size whatever the corpus.

The phrases that all bounds leave open are compiled into Aho-Corasick automata
shard by shard: each shard of texts compiles the candidates that occur in it, at
most ``PATTERNS`` in one automaton, scans itself for all overlapping matches, and
sends its counts, which are summed. The threshold then applies to exact counts: a
too full sketch costs time and never a phrase or a count.

Phrases are told apart within a shard by hashes of 64 bits, elsewhere by their
text. Defined results: null text is empty; null lang is ``und``; rows with
repeated ids count like any others; of equal scores the cut after the fewest
words counts; equal ranks cannot occur, as phrases differ; a text of any length
is read whole; a text without words adds nothing; an empty table gives an empty
table; further columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridal.llm.shingles import byte_hashes, mix
from veridal.llm.store import Scratch, arrow_map, cut

LEAST = 30
MOST_WORDS = 4
TOP = 2000
#: A longer phrase takes this share (percent) of a phrase's count to make it redundant.
COVERED = 80
#: Bytes of text in a shard, about; a longer text is a shard of its own.
SHARD_BYTES = 8 << 20
#: Patterns in an automaton at most.
PATTERNS = 1 << 17
#: Buckets of a sketch: at least as many as half the phrases counted, within these bounds.
FEWEST_BUCKETS, MOST_BUCKETS = 1 << 20, 1 << 30
#: Buckets of a block.
BLOCK_BITS = 20
#: Ranked rows of a lang in one task, about, before the last ranking.
RANKED_ROWS = 1 << 16

#: A-Z fold, a tab is a space, and what ends a piece is a line break.
_WRITTEN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")
_P = np.uint64(0x9E3779B97F4A7C15)


def written(texts: list[bytes]) -> bytes:
    """The texts as words between single spaces, with a line break as a word of its own between pieces."""
    out = b" " + b"\n".join(texts).translate(_WRITTEN).replace(b"\n", b" \n ") + b" "
    while b"  " in out:
        out = out.replace(b"  ", b" ")
    return out


class Phrases:
    """The phrases of a shard in one lang, one length after another.

    ``hashes[i]`` names the phrase of ``size`` words from word ``i`` on; ``live``
    tells where there is one that the sketches so far leave open.
    """

    def __init__(self, raw: bytes, lang: bytes):
        self.raw, self.size = raw, 1
        spaces = np.flatnonzero(np.frombuffer(raw, np.uint8) == 0x20)
        # Between single spaces: a gap before the first and after the last word.
        self.starts, self.ends = spaces[:-1] + 1, spaces[1:]
        seed = byte_hashes(lang, np.array([0]), np.array([len(lang)]))[0] if lang else np.zeros(1, np.uint64)
        self.words = mix(byte_hashes(raw, self.starts, self.ends)[0] ^ (seed + _P))
        self.live = np.frombuffer(raw, np.uint8)[self.starts] != 0x0A
        self.n_words = int(self.live.sum())
        self.hashes = self.words

    def longer(self, open_now: np.ndarray) -> None:
        """Go on to phrases of one word more, whose first and last parts are both open."""
        n = max(0, len(open_now) - 1)
        self.live = open_now[:n] & open_now[1:]
        self.hashes = mix((self.hashes[:n] ^ (self.hashes[:n] >> np.uint64(29))) * _P + self.words[self.size :][:n])
        self.size += 1

    def open(self, bits: np.ndarray) -> np.ndarray:
        """Where a phrase's bucket reaches the threshold."""
        out = self.live.copy()
        at = np.flatnonzero(out)
        bucket = bucket_of(self.hashes[at], len(bits) * 8)
        out[at] = (bits[bucket >> 3] >> (bucket & 7).astype(np.uint8)) & 1 == 1
        return out


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes & np.uint64(buckets - 1)).astype(np.int64)


def _shards(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[tuple[bytes, list[bytes]]]:
    """``(lang, texts)``, each of about ``most_bytes`` at most, or of one text."""
    waiting: dict[bytes, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if size and size + len(text) > most_bytes:
                yield from waiting.items()
                waiting, size = {}, 0
            waiting.setdefault(lang, []).append(text)
            size += len(text)
    yield from waiting.items()


def _opened(shards: Iterator[tuple[bytes, list[bytes]]], sketches: list) -> Iterator[tuple[bytes, Phrases]]:
    """Each shard's phrases, as long as there are sketches and one word more."""
    for lang, texts in shards:
        phrases = Phrases(written(texts), lang)
        for s in sketches:
            phrases.longer(phrases.open(np.frombuffer(s.value, np.uint8)))
        yield lang, phrases


def _counted(rows: DataFrame, sketches: list) -> int:
    """How many phrases the next sketch counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(int(p.live.sum()) for _, p in _opened(_shards(batches, SHARD_BYTES), sketches))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return arrow_map(rows, run, "n long").agg(F.sum("n")).first()[0] or 0


def _sketch(rows: DataFrame, sketches: list, buckets: int, least: int) -> bytes:
    """One bit a bucket: whether the counts of its phrases add up to ``least``."""
    width = np.uint8 if least < 256 else np.uint32

    def touch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, phrases in _opened(_shards(batches, SHARD_BYTES), sketches):
            touched = np.sort(bucket_of(phrases.hashes[phrases.live], buckets).astype(np.uint32))
            first = np.flatnonzero(np.concatenate([[True], touched[1:] != touched[:-1]])) if len(touched) else np.zeros(0, int)
            counts = np.minimum(np.diff(np.append(first, len(touched))), least).astype(width)
            touched = touched[first]
            blocks, at = np.unique(touched >> BLOCK_BITS, return_index=True)
            cuts = [*at.tolist(), len(touched)]
            inside = touched & np.uint32((1 << BLOCK_BITS) - 1)
            parts = [(inside[a:b].tobytes(), counts[a:b].tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(blocks.astype(np.int32)), pa.array([p[0] for p in parts], pa.binary()), pa.array([p[1] for p in parts], pa.binary())], names=["block", "at", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, np.zeros(0)

        def bits() -> pa.RecordBatch:
            full = [] if now is None else [(now, np.packbits(sums >= least, bitorder="little").tobytes())]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in full], pa.int32()), pa.array([x[1] for x in full], pa.binary())], names=["block", "bits"])

        for b in batches:
            for block, at, n in zip(*(b.column(c).to_pylist() for c in ("block", "at", "n")), strict=True):
                if block != now:
                    yield bits()
                    now, sums = block, np.zeros(1 << BLOCK_BITS, np.int64)
                sums[np.frombuffer(at, "<u4")] += np.frombuffer(n, width)
        yield bits()

    touched = arrow_map(rows, touch, "block int, at binary, n binary").repartition("block").sortWithinPartitions("block")
    out = bytearray(buckets // 8)
    step = 1 << (BLOCK_BITS - 3)
    for r in arrow_map(touched, add, "block int, bits binary").toLocalIterator():
        out[r["block"] * step : (r["block"] + 1) * step] = r["bits"]
    return bytes(out)


def _scanned(rows: DataFrame, sketches: list) -> DataFrame:
    """``(lang, words, phrase, n)`` of each shard's candidates; the number of all words at an empty phrase."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _shards(batches, SHARD_BYTES):
            phrases = Phrases(written(texts), lang)
            patterns: list[bytes] = []
            sizes: list[np.ndarray] = []
            for s in sketches:
                now = phrases.open(np.frombuffer(s.value, np.uint8))
                at = np.flatnonzero(now)
                one = at[np.unique(phrases.hashes[at], return_index=True)[1]]
                spans = zip(phrases.starts[one].tolist(), phrases.ends[one + phrases.size - 1].tolist(), strict=True)
                patterns += [phrases.raw[a - 1 : b + 1] for a, b in spans]
                sizes.append(np.full(len(one), phrases.size, np.int32))
                phrases.longer(now)
            counts = _matches(phrases.raw.decode(), patterns, PATTERNS)
            found = [b"", *(p[1:-1] for p in patterns)]
            n = np.concatenate([[phrases.n_words], counts])
            words = np.concatenate([np.zeros(1, np.int32), *sizes])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.binary()), pa.array(words), pa.array(found, pa.binary()), pa.array(n, pa.int64())], names=["lang", "words", "phrase", "n"])

    return arrow_map(rows, scan, "lang binary, words int, phrase binary, n long")


def _matches(text: str, patterns: list[bytes], most: int) -> np.ndarray:
    """How often each pattern occurs in ``text``, overlaps included."""
    counts = np.zeros(len(patterns), np.int64)
    for first in range(0, len(patterns), most):
        some = patterns[first : first + most]
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, p in enumerate(some):
            automaton.add_word(p.decode(), k)
        automaton.make_automaton()
        found = np.fromiter((k for _, k in automaton.iter(text)), np.int32)
        counts[first : first + len(some)] += np.bincount(found, minlength=len(some))
    return counts


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, most_words: int = MOST_WORDS) -> DataFrame:
    """``(lang, words, phrase, n)`` of each phrase of up to ``most_words`` that occurs ``least`` times; the number of all words at an empty phrase."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).cast("binary").alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    sketches: list = []
    for _ in range(most_words):
        half = max(1, _counted(rows, sketches) // 2)
        buckets = min(MOST_BUCKETS, max(FEWEST_BUCKETS, 1 << (half - 1).bit_length()))
        sketches.append(spark.sparkContext.broadcast(_sketch(rows, sketches, buckets, least)))
    sums = _scanned(rows, sketches).groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
    return cut(sums.filter((F.col("n") >= least) | (F.col("words") == 0)))


def _cuts(found: DataFrame, most_words: int) -> DataFrame:
    """Each phrase with each of its cuts: ``k``, ``left`` and ``right``."""
    return found.withColumn("k", F.explode(F.expr("sequence(1, words - 1)"))).select(
        "*", F.expr("array_join(slice(split(phrase, ' '), 1, k), ' ')").alias("left"), F.expr("array_join(slice(split(phrase, ' '), k + 1, words - k), ' ')").alias("right")
    )


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, most_words: int = MOST_WORDS, top: int = TOP) -> DataFrame:
    """The best ``top`` phrases of each lang: lang, rank, phrase, a, l, r, n, score."""
    with Scratch(docs.sparkSession) as scratch:
        counts = phrase_counts(docs, text, lang, least, most_words)
        counts = scratch.keep(counts.select(F.col("lang").cast("string").alias("lang"), "words", F.col("phrase").cast("string").alias("phrase"), F.col("n").alias("a")))
        totals = counts.filter("words = 0").select("lang", F.col("a").alias("n"))
        found = counts.filter("words > 1")

        # The parts of a phrase occur at least as often as it does, so all of them are among the counts.
        parts = counts.filter(f"words BETWEEN 1 AND {most_words - 1}").select("lang", "phrase", "a")
        cuts = _cuts(found, most_words)
        cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"])
        cuts = cuts.join(parts.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"])
        score = F.expr("cast(cast(a AS decimal(30, 0)) * 2000000 div (cast(l AS decimal(30, 0)) + r) AS long)")
        best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("a").alias("a"))

        inner = F.expr(f"""
            filter(flatten(transform(sequence(2, {max(2, most_words - 1)}), s -> transform(sequence(0, greatest(words - s, 0)),
                i -> named_struct('size', s, 'phrase', array_join(slice(split(phrase, ' '), i + 1, s), ' '))))), x -> x.size < words)
        """)
        around = found.filter("words > 2").select("lang", F.explode(inner).alias("inner"), "a").groupBy("lang", F.col("inner.phrase").alias("phrase")).agg(F.max("a").alias("around"))
        left = best.join(around, ["lang", "phrase"], "left").filter(f"around IS NULL OR cast(around AS decimal(30, 0)) * 100 < cast(a AS decimal(30, 0)) * {COVERED}")
        left = scratch.keep(left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))

        order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
        salts = left.count() // RANKED_ROWS + 1
        few = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
        few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
        ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
        return cut(ranked.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
