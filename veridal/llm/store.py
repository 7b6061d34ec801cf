"""Shared storage and Arrow helpers used by every operator of this subpackage."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no folder and runs in local mode.
LOCAL_DEFAULT = "file:///tmp/checkpoints"

#: What a word is: a run of anything but ASCII white space.
WORD_GAP = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if found is None and context.getCheckpointDir() is not None:
        found = str(PurePosixPath(context.getCheckpointDir()).parent).replace(":/", ":///", 1)
    if found is None:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = LOCAL_DEFAULT
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used yet."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there.

    The files go when Spark no longer refers to them
    (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables of one operator's call: compact, in the shared folder, and deleted on leaving.

    For intermediate results that nothing reads once the call returns.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.tables = spark, new_path(spark, "scratch"), 0
        self.kept: dict[int, tuple[DataFrame, str]] = {}

    def __enter__(self) -> Scratch:
        return self

    def keep(self, df: DataFrame, large: bool = False) -> DataFrame:
        """Write ``df`` and read it back; behind a ``large`` one, shuffle files may go at once.

        Spark drops shuffle files when the driver's collection of garbage finds
        nothing that refers to them, so that is asked for there.
        """
        self.tables += 1
        out = f"{self.path}/{self.tables}"
        df.write.parquet(out)
        if large:
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
        table = self.spark.read.schema(df.schema).parquet(out)
        self.kept[id(table)] = (table, out)
        return table

    def free(self, *tables: DataFrame) -> None:
        """Delete tables that ``keep`` gave and that nothing reads any more."""
        for table in tables:
            self._delete(self.kept.pop(id(table))[1])

    def __exit__(self, *_: object) -> None:
        self._delete(self.path)

    def _delete(self, path: str) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def own_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def words(text: Column) -> Column:
    """Words of a text as an array, [] for null; native."""
    parts = F.split(F.coalesce(text, F.lit("")), WORD_GAP)
    return F.filter(parts, lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def in_slices(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, cut so that a slice holds about ``most_bytes`` of ``text``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = max(1, batch.column(text).get_total_buffer_size())
        step = max(1, int(batch.num_rows * most_bytes / size))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def sum_blocks(parts: DataFrame, kind: str, total: str) -> DataFrame:
    """Sum arrays held as ``(block int, counts binary)`` by block, from numpy type ``kind`` to ``total``.

    Every task that makes such parts makes each block once, so a part is as large
    as the array, whatever the task has read.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, counts in zip(b.column("block").to_pylist(), b.column("counts").to_pylist(), strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(counts, kind).astype(total)
        yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["block", "counts"])

    return arrow_map(parts.repartition("block"), add, "block int, counts binary")
