"""Exact dedup by a heavy-hitter split.

A Misra-Gries summary of each partition finds the digests that may be frequent;
the summaries add up in a shuffle of at most ``slots`` rows a partition, and at
most ``slots`` digests can hold more than a ``slots``-th part of all rows. Those
are counted exactly (verified), and their winners are broadcast, so that the rows
of a large group are decided where they are read, also if all have one id. All
other digests go through an ordinary shuffle, where no group can hold more than
about a ``slots``-th part of the rows. ``slots`` grows with the rows, so that such a
group stays at about ``MOST_SHUFFLED`` rows whatever the table holds, up to
``MOST_SLOTS`` winners (some 10 MB to broadcast), which is reached at 10^11 rows.

Defined results: null text counts as empty; rows with equal text and equal (or
null) ids are copies like any others, and exactly one row of a group stays; a
null id is less than any other; a text of any length is hashed whole; an empty
table gives an empty table; further columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridal.llm.store import arrow_map, ascii_lower, cut

SLOTS = 1024
#: Bound of what is broadcast, and the rows of one digest that a single task of the shuffle takes.
MOST_SLOTS = 1 << 17
MOST_SHUFFLED = 1 << 20


def digest_of(text: Column) -> Column:
    """SHA-256 of the text's UTF-8 bytes with A-Z lower-cased."""
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256))


def digests(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """``(id, digest, row)`` of every row; ``row`` is another number for each."""
    return docs.select(F.col(id_col).alias("id"), digest_of(F.col(text)).alias("digest"), F.monotonically_increasing_id().alias("row"))


def slots_for(table: DataFrame, most_shuffled: int = MOST_SHUFFLED) -> int:
    """Counters enough that every digest on more than ``most_shuffled`` rows is a heavy one."""
    return max(SLOTS, min(MOST_SLOTS, -(-table.count() // most_shuffled)))


def misra_gries(batches: Iterator[pa.RecordBatch], slots: int) -> Iterator[pa.RecordBatch]:
    """Misra-Gries counters of a partition, and its row count at a null digest.

    A batch is added whole; then the counter that comes after the ``slots``
    largest is taken off from all, which keeps the summary's bound.
    """
    counters: dict[bytes, int] = {}
    rows = 0
    for batch in batches:
        rows += batch.num_rows
        for x in pc.value_counts(batch.column("digest")).to_pylist():
            counters[x["values"]] = counters.get(x["values"], 0) + x["counts"]
        if len(counters) > slots:
            least = sorted(counters.values(), reverse=True)[slots]
            counters = {k: n - least for k, n in counters.items() if n > least}
    yield pa.RecordBatch.from_arrays(
        [pa.array([None, *counters], pa.binary()), pa.array([rows, *counters.values()], pa.int64())], names=["digest", "n"]
    )


def winners(table: DataFrame, slots: int | None = None) -> DataFrame:
    """``(heavy, win, win_row, group_size)`` of every digest on more than a ``slots``-th of the rows.

    At most ``slots`` rows come out, whatever the input: counters never exceed
    the true counts, and the true counts add up to the number of rows. Without
    ``slots``, ``slots_for`` sets them.
    """
    slots = slots or slots_for(table)
    found = arrow_map(table.select("digest"), lambda b: misra_gries(b, slots), "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    found = cut(found)
    rows = F.broadcast(found.filter(F.col("digest").isNull()).select(F.col("n").alias("rows")))
    maybe = found.filter(F.col("digest").isNotNull()).join(rows, F.col("n") * (slots + 1) > F.col("rows")).select("digest")
    best = (
        table.join(F.broadcast(maybe), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.max(F.struct("id", "row")).alias("best"), F.count("*").alias("group_size"))
        .filter("group_size > 1")
    )
    return best.select(F.col("digest").alias("heavy"), F.col("best.id").alias("win"), F.col("best.row").alias("win_row"), "group_size")


def exact_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id", slots: int | None = None) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    table = cut(digests(docs, text, id_col))
    seen = table.join(F.broadcast(winners(table, slots)), F.col("digest") == F.col("heavy"), "left")
    heavy = seen.filter("heavy IS NOT NULL").select("id", "digest", F.col("win").alias("keep_id"), "group_size", (F.col("row") == F.col("win_row")).alias("kept"))
    group = Window.partitionBy("digest")
    rest = (
        seen.filter("heavy IS NULL")
        .withColumn("place", F.row_number().over(group.orderBy(F.col("id").desc_nulls_last(), F.col("row").desc())))
        .select("id", "digest", F.max("id").over(group).alias("keep_id"), F.count("*").over(group).alias("group_size"), (F.col("place") == 1).alias("kept"))
    )
    return heavy.unionByName(rest).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, text: str = "text", id_col: str = "doc_id", slots: int | None = None) -> DataFrame:
    """``docs`` without the copies: of equal texts the row with the largest id stays.

    Copies of a heavy text go where they are read, but for rows with the winner's
    id; of these, one a partition is shuffled. The rows of all other texts are
    shuffled once.
    """
    heavy = winners(cut(digests(docs, text, id_col)), slots)
    packed = docs.select(F.col(id_col).alias("id"), digest_of(F.col(text)).alias("digest"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    seen = packed.join(F.broadcast(heavy.drop("win_row")), F.col("digest") == F.col("heavy"), "left")
    best = seen.filter(F.col("heavy").isNotNull() & F.col("id").eqNullSafe(F.col("win"))).groupBy("digest").agg(F.first("row").alias("row")).select("row")
    place = F.row_number().over(Window.partitionBy("digest").orderBy(F.col("id").desc_nulls_last()))
    rest = seen.filter("heavy IS NULL").withColumn("place", place).filter("place = 1").select("row")
    return best.unionByName(rest).select("row.*")
