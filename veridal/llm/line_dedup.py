"""Repeated lines, found through a sharded minimal perfect hash.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased;
it is named by 128 bits. One shuffle of these names, summed up before it, counts
the documents of each and finds the largest id among them. The names that two
documents share at least (others cannot be repeated) are dealt into shards of
about ``SHARD_KEYS``; each gets a minimal perfect hash that gives places in
compact arrays: a fingerprint of 64 bits, the number of documents, and the id of
the document that keeps the line. Documents probe the arrays where they are read,
so neither lines nor texts are joined.

The arrays are broadcast while they are below ``BROADCAST_BYTES``, which is
checked on their sizes before any of them is fetched. A larger index stays where
it is: then names, without texts, go to the arrays of their shard, in groups of
bounded size, and the numbers of the lines to drop come back to the documents.

Defined results: a row is a document, also if ids repeat; null text is one empty
line; a key with fewer than ``least_chars`` code points is never dropped; a line
that a document repeats counts once for it, and all its occurrences go; rows with
the largest id of those that hold a line keep it; a null id is less than any
other; a text of any length is read whole; an empty table gives an empty table;
further columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridal.llm.minimal_hash import MinimalHash
from veridal.llm.store import Scratch, arrow_map, cut, in_slices

LEAST_CHARS = 40
LEAST_DOCS = 5
SHARD_KEYS = 1 << 16
BROADCAST_BYTES = 64 << 20
#: Names that meet the arrays of a shard in one group, about, where the index is not broadcast.
GROUP_KEYS = 1 << 18
#: Names so frequent that each has more than a ``HOT``-th part of all; they are fewer than that.
HOT = 1 << 14

_GAP = b"\x20\x09\x0a\x0b\x0c\x0d"
_INSIDE = bytes(range(0x80, 0xC0))  # bytes that go on a code point


def line_names(lines: list[bytes], least_chars: int) -> tuple[list[int], list[bytes]]:
    """The numbers of the lines with keys that are long enough, and the names of these keys."""
    at, names = [], []
    for k, line in enumerate(lines):
        key = line.strip(_GAP).lower()
        if len(key) >= least_chars and len(key.translate(None, _INSIDE)) >= least_chars:
            at.append(k)
            names.append(hashlib.blake2b(key, digest_size=16).digest())
    return at, names


def _halves(names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(names), "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _shard_of(h2: np.ndarray, shards: int) -> np.ndarray:
    return (h2 >> np.uint64(32)).astype(np.int64) * shards >> 32


def shared_lines(docs: DataFrame, text: str, id_col: str, least_chars: int) -> DataFrame:
    """``(h1, h2, n, last)`` of each key that two documents hold at least: how many do, and the largest id of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in in_slices(batches, "text"):
            where, names = [], []
            for row, t in enumerate(some.column("text").to_pylist()):
                own = set(line_names((t or b"").split(b"\n"), least_chars)[1])
                where += [row] * len(own)
                names += own
            h1, h2 = _halves(names)
            yield pa.RecordBatch.from_arrays([pa.array(h1.view("<i8")), pa.array(h2.view("<i8")), some.column("id").take(pa.array(where, pa.int64()))], names=["h1", "h2", "id"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("binary").alias("text"))
    named = arrow_map(rows, run, f"h1 long, h2 long, id {rows.dtypes[0][1]}")
    return named.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("last")).filter("n > 1")


def build_index(lines: DataFrame, shards: int) -> DataFrame:
    """One row a shard: ``sizes`` and ``words`` of its hash, and by place ``prints``, ``counts`` and ``keeps``."""
    kind = dict(lines.dtypes)["last"]

    def build(table: pa.Table) -> pa.Table:
        h1, h2 = (table.column(c).to_numpy().view("<u8") for c in ("h1", "h2"))
        made = MinimalHash.of(h1, h2)
        order = np.empty(len(h1), np.int64)
        order[made.places(h1, h2)] = np.arange(len(h1))
        counts = np.minimum(table.column("n").to_numpy()[order], np.iinfo("<u4").max).astype("<u4")
        cells = [int(table.column("shard")[0].as_py()), made.sizes.tobytes(), made.words.tobytes(), h1[order].tobytes(), counts.tobytes(), table.column("last").take(pa.array(order)).to_pylist()]
        keeps = pa.list_(table.schema.field("last").type)
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), keeps)
        return pa.table([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], names=["shard", "sizes", "words", "prints", "counts", "keeps"])

    # The same number as _shard_of: the high half of h2, scaled.
    shard = F.expr(f"cast(shiftright(shiftrightunsigned(h2, 32) * {shards}, 32) as int)")
    return lines.withColumn("shard", shard).groupBy("shard").applyInArrow(build, f"shard int, sizes binary, words binary, prints binary, counts binary, keeps array<{kind}>")


class Shard:
    """The arrays of a shard."""

    def __init__(self, sizes: bytes, words: bytes, prints: bytes, counts: bytes, keeps: list):
        self.hash = MinimalHash(np.frombuffer(sizes, "<i8"), np.frombuffer(words, "<u8"))
        self.prints, self.counts, self.keeps = np.frombuffer(prints, "<u8"), np.frombuffer(counts, "<u4"), keeps

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many documents hold each key (0 for a key not indexed), and its place."""
        places = self.hash.places(h1, h2)
        found = places >= 0
        found[found] = self.prints[places[found]] == h1[found]
        counts = np.zeros(len(h1), np.int64)
        counts[found] = self.counts[places[found]]
        return counts, places


def _gone(shard: Shard, h1: np.ndarray, h2: np.ndarray, ids: list, least_docs: int) -> list[int]:
    """Which of the lines, each with its key and the id of its document, are dropped."""
    counts, places = shard.probe(h1, h2)
    return [i for i in np.flatnonzero(counts >= least_docs).tolist() if shard.keeps[places[i]] != ids[i]]


def _without(lines: list[bytes], gone: list[int]) -> bytes:
    if not gone:
        return b"\n".join(lines)
    away = set(gone)
    return b"\n".join(line for k, line in enumerate(lines) if k not in away)


def _result(some: pa.RecordBatch, texts: list[list[bytes]], gone: list[list[int]]) -> pa.RecordBatch:
    kept = [_without(lines, g) for lines, g in zip(texts, gone, strict=True)]
    return pa.RecordBatch.from_arrays(
        [some.column("id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(g) for g in gone], pa.int64()), pa.array(kept, pa.binary())], names=["id", "n_lines", "n_dropped", "text"]
    )


def _probe_here(rows: DataFrame, index: DataFrame, shards: int, least_chars: int, least_docs: int) -> DataFrame:
    """Documents probe a broadcast index where they are read."""
    arrays = {r["shard"]: (r["sizes"], r["words"], r["prints"], r["counts"], r["keeps"]) for r in index.toLocalIterator()}
    sent = rows.sparkSession.sparkContext.broadcast(arrays)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {k: Shard(*(bytes(x) if not isinstance(x, list) else x for x in parts)) for k, parts in sent.value.items()}
        for some in in_slices(batches, "text"):
            ids, texts = some.column("id").to_pylist(), [(t or b"").split(b"\n") for t in some.column("text").to_pylist()]
            owner, line, names = [], [], []
            for row, lines in enumerate(texts):
                at, own = line_names(lines, least_chars)
                owner += [row] * len(at)
                line += at
                names += own
            h1, h2 = _halves(names)
            home = _shard_of(h2, shards)
            gone: list[list[int]] = [[] for _ in texts]
            for k in np.unique(home).tolist():
                if k in index:
                    here = np.flatnonzero(home == k)
                    for i in _gone(index[k], h1[here], h2[here], [ids[owner[j]] for j in here.tolist()], least_docs):
                        gone[owner[here[i]]].append(line[here[i]])
            yield _result(some, texts, gone)

    return arrow_map(rows, run, f"id {rows.dtypes[0][1]}, n_lines long, n_dropped long, text binary")


def _probe_there(rows: DataFrame, lines: DataFrame, index: DataFrame, shards: int, names: int, least_chars: int, least_docs: int) -> DataFrame:
    """Names of lines go to the arrays of their shard, and the numbers of lines to drop come back.

    The most frequent names, ``HOT`` at most, are decided at the documents, so that
    no shard gets much more than its share.
    """
    kind = rows.dtypes[0][1]
    numbered = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    salts = max(1, -(-names // (shards * GROUP_KEYS)))
    frequent = lines.filter((F.col("n") * HOT > names) & (F.col("n") >= least_docs)).toLocalIterator()
    hot = rows.sparkSession.sparkContext.broadcast({(r["h1"] % (1 << 64)).to_bytes(8, "little") + (r["h2"] % (1 << 64)).to_bytes(8, "little"): r["last"] for r in frequent})

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in in_slices(batches, "text"):
            where, line, found = [], [], []
            for row, t in enumerate(some.column("text").to_pylist()):
                for k, name in zip(*line_names((t or b"").split(b"\n"), least_chars), strict=True):
                    if name not in hot.value:
                        where.append(row)
                        line.append(k)
                        found.append(name)
            h1, h2 = _halves(found)
            owner = pa.array(where, pa.int64())
            columns = [pa.array(_shard_of(h2, shards), pa.int32()), pa.array(h1.view("<i8")), pa.array(h2.view("<i8")), some.column("id").take(owner), some.column("row").take(owner), pa.array(line, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "h1", "h2", "id", "row", "line"])

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows or not left.num_rows:
            return left.select(["row", "line"]).slice(0, 0)
        parts = right.select(["sizes", "words", "prints", "counts", "keeps"]).to_pylist()[0]
        h1, h2 = (left.column(c).to_numpy().view("<u8") for c in ("h1", "h2"))
        return left.select(["row", "line"]).take(pa.array(_gone(Shard(**parts), h1, h2, left.column("id").to_pylist(), least_docs), pa.int64()))

    sent = arrow_map(numbered, send, f"shard int, h1 long, h2 long, id {kind}, row long, line int").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    salted = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    hits = sent.groupBy("shard", "salt").cogroup(salted.groupBy("shard", "salt")).applyInArrow(meet, "row long, line int")
    gone = hits.groupBy("row").agg(F.collect_list("line").alias("gone"))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in in_slices(batches, "text"):
            texts = [(t or b"").split(b"\n") for t in some.column("text").to_pylist()]
            gone = [list(g or []) for g in some.column("gone").to_pylist()]
            for mine, lines, own in zip(gone, texts, some.column("id").to_pylist(), strict=True):
                mine += [k for k, name in zip(*line_names(lines, least_chars), strict=True) if name in hot.value and hot.value[name] != own]
            yield _result(some, texts, gone)

    return arrow_map(numbered.join(gone, "row", "left").select("id", "text", "gone"), drop, f"id {kind}, n_lines long, n_dropped long, text binary")


def drop_repeated_lines(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, shard_keys: int = SHARD_KEYS, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_lines`` before, ``n_dropped``, and the ``text`` that is left."""
    if least_docs < 2:
        raise ValueError("a line of one document is not repeated")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("binary").alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        lines = scratch.keep(shared_lines(docs, text, id_col, least_chars))
        size = lines.agg(F.count("*").alias("keys"), F.sum("n").alias("names")).first()
        shards = max(1, -(-size["keys"] // shard_keys))
        index = cut(build_index(lines, shards))
        held = index.agg(F.sum(F.expr("length(sizes) + length(words) + length(prints) + length(counts) + length(cast(keeps as string))"))).first()[0] or 0
        if held <= broadcast_bytes:
            out = _probe_here(rows, index, shards, least_chars, least_docs)
        else:
            out = _probe_there(rows, lines, index, shards, size["names"], least_chars, least_docs)
    return out.select(F.col("id").alias(id_col), "n_lines", "n_dropped", F.col("text").cast("string").alias("text"))
