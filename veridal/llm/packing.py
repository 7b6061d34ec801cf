"""Best-fit packing after Martello-Toth dominance reduction.

Sizes are at most the capacity, so the instance is a histogram with one count
per size: it has at most ``capacity`` entries whatever the corpus. Reduction and
best fit run on counts and give *runs*: for every size, which ranks go to which
sequences at which offset. Pieces get their rank within their size from counts
per partition, so that no size is gathered in one task.

Defined results: null text is an empty document, which is its end token alone;
rows with repeated ids are packed as documents of their own; an empty table
gives an empty table; a text of any length is cut, into full pieces but for the
first.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridal.llm.store import arrow_map, cut, in_slices
from veridal.llm.token_ids import default_path, encoder

CAPACITY = 1024
END = 2

#: A run: size, first rank, ranks, first sequence, copies of the size in a sequence, offset of the first.
Run = tuple[int, int, int, int, int, int]


def dominant_sets(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Sets that may be fixed without loss, each with how often, and what is left.

    From the largest size down, with the smallest sizes left taken as the fill
    that any further item needs at least:

    * a size that fills a sequence, or that not even the smallest size fits beside, stands alone;
    * two sizes that fill a sequence together dominate any set with the larger one;
    * where no two more items fit beside a size, its largest partner dominates.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    fixed: list[tuple[tuple[int, ...], int]] = []
    for size in sorted(left, reverse=True):
        while left.get(size, 0) > 0:
            n, room = left[size], capacity - size
            small = sorted(s for s in left if left[s] > (s == size))
            if not small or small[0] > room:
                fixed.append(((size,), n if left[size] > 1 and 2 * size > capacity or room == 0 else 1))
            elif room == size and n > 1:
                fixed.append(((size, size), n // 2))
            elif room != size and left.get(room, 0) > 0:
                fixed.append(((size, room), min(n, left[room])))
            else:
                two = small[0] * 2 if left[small[0]] - (small[0] == size) > 1 else sum(small[:2]) if len(small) > 1 else capacity
                partner = max(s for s in small if s <= room)
                if two <= room or partner == size:
                    break
                fixed.append(((size, partner), min(n, left[partner])))
            items, times = fixed[-1]
            for s in items:
                left[s] -= times
                if not left[s]:
                    del left[s]
        # a size that nothing dominates stays for best fit
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing on counts: ``(((size, copies), ...), sequences)``.

    Equal items go to equal sequences alike, so that a step places all it can of
    a size into the sequences with the least sufficient room.
    """
    rooms: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = defaultdict(list)
    done: list[tuple[tuple[tuple[int, int], ...], int]] = []

    def put(content: tuple[tuple[int, int], ...], room: int, size: int, count: int, bins: int) -> None:
        each = room // size
        full, rest = divmod(count, each)
        for copies, n in ((each, full), (rest, 1 if rest else 0), (0, bins - full - (1 if rest else 0))):
            if n:
                rooms[room - copies * size].append(((*content, (size, copies)) if copies else content, n))

    for size in sorted(counts, reverse=True):
        count = counts[size]
        for room in sorted(r for r in rooms if r >= size):
            waiting, rooms[room] = rooms[room], []
            for content, bins in waiting:
                placed = min(count, bins * (room // size))
                if placed:
                    put(content, room, size, placed, bins)
                else:
                    rooms[room].append((content, bins))
                count -= placed
            if not rooms[room]:
                del rooms[room]
        if count:
            put((), capacity, size, count, -(-count // (capacity // size)))
        done += rooms.pop(0, [])
    return done + [x for r in rooms.values() for x in r]


def plan_runs(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Places for all items of a histogram; every sequence's offsets have no gap from 0."""
    fixed, left = dominant_sets(counts, capacity)
    sets: list[tuple[tuple[tuple[int, int], ...], int]] = []
    for items, times in fixed:
        sets.append((tuple((s, items.count(s)) for s in dict.fromkeys(items)), times))
    next_rank: dict[int, int] = defaultdict(int)
    runs: list[Run] = []
    sequence = 0
    for content, times in sets + best_fit(left, capacity):
        offset = 0
        for size, copies in content:
            runs.append((size, next_rank[size], copies * times, sequence, copies, offset))
            next_rank[size] += copies * times
            offset += size * copies
        sequence += times
    return runs


def pieces(docs: DataFrame, text: str, id_col: str, path: str, capacity: int, end: int) -> DataFrame:
    """The pieces of every document with the partition that made them and their rank there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc, seen = encoder(path), [0] * (capacity + 1)
        for some in in_slices(batches, "text"):
            out: list[list[int]] = [[] for _ in range(6)]
            where: list[int] = []
            for row, packed in enumerate(enc.encode(some.column("text").to_pylist())):
                ids = np.append(enc.ids(packed), np.uint32(end)).astype("<u4")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for column, x in zip(out, (k, a, b - a, zlib.crc32(ids[a:b].tobytes()), part, seen[b - a]), strict=True):
                        column.append(x)
                    seen[b - a] += 1
                    where.append(row)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [some.column("id").take(pa.array(where, pa.int64())), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))],
                names=["id", "piece", "start", "length", "ids_crc32", "part", "local_rank"],
            )

    kind = docs.select(id_col).dtypes[0][1]
    return arrow_map(
        docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")),
        run,
        f"id {kind}, piece int, start long, length long, ids_crc32 long, part long, local_rank long",
    )


def best_fit_packing(docs: DataFrame, text: str = "text", id_col: str = "doc_id", tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    table = cut(pieces(docs, text, id_col, tokenizer or default_path(), capacity, end))
    by_part = table.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = cut(by_part.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))))
    # At most one row a size reaches the driver.
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator()}
    runs = np.array(plan_runs(histogram, capacity), np.int64).reshape(-1, 6)
    sent = spark.sparkContext.broadcast(runs[np.lexsort((runs[:, 1], runs[:, 0]))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = sent.value
        most = int(r[:, 1].max(initial=0)) + int(r[:, 2].max(initial=0)) + 1
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            # Sizes and first ranks are both ascending, so one search on their pair finds the run.
            at = _last_at_most(r[:, 0], r[:, 1], length, rank, most)
            k = rank - r[at, 1]
            sequence, offset = r[at, 3] + k // r[at, 4], r[at, 5] + k % r[at, 4] * length
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)],
                names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = table.join(by_part.drop("n"), ["part", "length"]).withColumn("rank", F.col("base") + F.col("local_rank"))
    kind = docs.select(id_col).dtypes[0][1]
    return arrow_map(
        ranked.select("id", "piece", "start", "length", "ids_crc32", "rank"),
        place,
        f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    ).withColumnRenamed("id", id_col)


def _last_at_most(sizes: np.ndarray, firsts: np.ndarray, size: np.ndarray, rank: np.ndarray, most: int) -> np.ndarray:
    """Index of the last ``(sizes, firsts)`` that is at most ``(size, rank)``."""
    if most < (1 << 62) // (int(sizes.max(initial=0)) + 1):
        return np.searchsorted(sizes * most + firsts, size * most + rank, side="right") - 1
    out = np.empty(len(size), np.int64)
    for s in np.unique(size):
        a, b = np.searchsorted(sizes, [s, s + 1])
        mine = size == s
        out[mine] = a + np.searchsorted(firsts[a:b], rank[mine], side="right") - 1
    return out
