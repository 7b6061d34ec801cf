"""Token ids as files of range-coded blocks.

A file set is a Parquet table (so that Spark's own readers and committers place
it in any store) whose rows are blocks: ``part`` (files ascend with the ids of
their documents), ``block`` (from 0 in a part), ``first_start`` (ids in the part
before the block) and ``payload``. A payload is a header, a table of the block's
documents (id, or none, and number of ids) and a coded block of
``range_coder``; it is decoded by itself, and its checksums cover table and ids.
A block ends with the first document that brings it to ``block_ids`` ids, so
documents are whole.

There are as many files as ``spark.sql.shuffle.partitions``. Rows of one id are
spread over files by a hash of their texts, so that an id of very many rows
does not end up in one task.

Defined results: null text is an empty document (its end id alone); documents
with equal ids stay separate and adjacent, in the order of their texts' hashes;
null ids come first; ids are cast to long, and one that cannot be cast fails or is
null as the session's ANSI mode says; texts of any length are whole in one block;
further columns, whatever their names, are not read; an empty table gives files
without blocks and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridal.llm.range_coder import decode_block, encode_block
from veridal.llm.store import arrow_map, in_slices, new_path
from veridal.llm.token_ids import default_path, encoder

END = 2
BLOCK_IDS = 1 << 21
_HEAD = struct.Struct("<4sII")
_MAGIC = b"TOKB"
_DOC = np.dtype([("id", "<i8"), ("has_id", "<u1"), ("n", "<u8")])


def pack(ids: list[int | None], lengths: list[int], tokens: np.ndarray, vocabulary: int) -> bytes:
    docs = np.array([(i or 0, i is not None, n) for i, n in zip(ids, lengths, strict=True)], _DOC).tobytes()
    return _HEAD.pack(_MAGIC, len(ids), zlib.crc32(docs)) + docs + encode_block(tokens, vocabulary)


def unpack(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, numbers of ids, and all ids of a block."""
    magic, count, crc = _HEAD.unpack_from(payload)
    raw = payload[_HEAD.size : _HEAD.size + count * _DOC.itemsize]
    if magic != _MAGIC or zlib.crc32(raw) != crc:
        raise ValueError("damaged table of documents")
    docs = np.frombuffer(raw, _DOC)
    tokens = decode_block(payload[_HEAD.size + len(raw) :])
    if docs["n"].sum() != len(tokens):
        raise ValueError("the table of documents does not fit the ids")
    return [int(d["id"]) if d["has_id"] else None for d in docs], docs["n"].astype(np.int64), tokens


def write_token_files(docs: DataFrame, out: str, text: str = "text", id_col: str = "doc_id", tokenizer: str | None = None, end: int = END, block_ids: int = BLOCK_IDS) -> None:
    """Encode every whole text and write the file set ``out``."""
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(path)
        vocabulary = max(enc.library.get_vocab_size(), end + 1)
        tail = np.array([end], enc.width).tobytes()
        ids: list[int | None] = []
        packed: list[bytes] = []
        size, block, start = 0, 0, 0

        def row() -> pa.RecordBatch:
            tokens = enc.ids(b"".join(packed))
            payload = pack(ids, [len(p) // enc.width.itemsize for p in packed], tokens, vocabulary)
            return pa.RecordBatch.from_pydict({"part": [part], "block": [block], "first_start": [start], "n_ids": [len(tokens)], "payload": [payload]}, schema)

        for some in in_slices(batches, "text"):
            for doc, p in zip(some.column("id").to_pylist(), enc.encode(some.column("text").to_pylist()), strict=True):
                ids.append(doc)
                packed.append(p + tail)
                size += len(p) // enc.width.itemsize + 1
                if size >= block_ids:
                    yield row()
                    start, block = start + size, block + 1
                    ids, packed, size = [], [], 0
        if ids:
            yield row()

    schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("first_start", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])
    some = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    ordered = some.repartitionByRange(max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "id", "tie").sortWithinPartitions("id", "tie")
    blocks = arrow_map(ordered.select("id", "text"), run, "part long, block long, first_start long, n_ids long, payload binary")
    blocks.write.option("compression", "uncompressed").parquet(out)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Decode a file set: doc_id, start, n_tokens, ids_crc32, one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, lengths, tokens = unpack(row["payload"])
                ends = np.cumsum(lengths)
                starts = ends - lengths
                crc = [zlib.crc32(tokens[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(starts + (row["first_start"] + row["base"])), pa.array(lengths), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    blocks = spark.read.schema("part long, block long, first_start long, n_ids long, payload binary").parquet(path)
    # One row per file, in one task: the files before each.
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = blocks.join(F.broadcast(base), "part").select("payload", "first_start", "base")
    return arrow_map(placed, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files_round_trip(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Write ``docs`` below the shared folder and read the files back."""
    spark = docs.sparkSession
    out = new_path(spark, "token-files")
    write_token_files(docs, out, text, id_col)
    return read_token_files(spark, out)
