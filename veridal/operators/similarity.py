"""Scoring items against a set of queries by the cosine of unit vectors.

Vectors of the queries' length with plain numbers are scored in tasks, many pairs
at once: a matrix product finds the pairs that may be among the best, with a margin
over all that its order of summing can change, and those alone are summed anew from
left to right, as ``scores.dot`` does. Pairs with any other vector (null, of another
length, with null, infinite or huge numbers) are rows that ``scores.dot`` scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from veridal.functions import scores

#: The most queries that are sent to every task.
MOST_QUERIES = 10_000
#: Numbers up to which no sum of products comes near the end of doubles.
_LARGEST = 1e100
#: Pairs that one matrix product scores.
_TILE = 1 << 20


def _plain(vector: str, size: int) -> Column:
    return F.coalesce((F.size(vector) == size) & F.forall(vector, lambda x: F.abs(x) <= F.lit(_LARGEST)), F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _left_to_right(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The dot product of every row of ``a`` with that of ``b``."""
    out = np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        out += x * y
    return out


class _Best:
    """The ``k`` best items of each query so far; ties go to the lesser id."""

    def __init__(self, queries: np.ndarray, k: int, kind: pa.DataType):
        self.queries, self.k = queries, k
        self.norms = np.sqrt((queries**2).sum(1))
        self.query, self.score, self.item = np.zeros(0, np.int64), np.zeros(0), pa.array([], kind)
        self.kth = np.full(len(queries), -np.inf)

    def add(self, ids: pa.Array, vectors: np.ndarray) -> None:
        about = self.queries @ vectors.T
        # Twice the most by which two orders of summing can differ.
        margin = (4 * (vectors.shape[1] + 2) * np.finfo(float).eps * np.sqrt((vectors**2).sum(1)).max() * self.norms + 1e-300)[:, None]
        may = about >= self.kth[:, None] - margin
        if len(ids) > self.k and np.count_nonzero(may) > 4 * self.k * len(may):
            may &= about >= np.partition(about, len(ids) - self.k, axis=1)[:, [len(ids) - self.k]] - margin
        q, x = np.nonzero(may)
        if not len(q):
            return
        score = np.concatenate([_left_to_right(self.queries[q[i : i + _TILE // 8]], vectors[x[i : i + _TILE // 8]]) for i in range(0, len(q), _TILE // 8)])
        held = score >= self.kth[q]
        q, x, score = q[held], x[held], score[held]
        place = np.empty(len(ids), np.int64)
        place[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
        first = self._first(q, score, place[x])
        q, x, score = q[first], x[first], score[first]
        # What was held meets what is new, by the order of their ids.
        query, score, item = np.concatenate([self.query, q]), np.concatenate([self.score, score]), pa.concat_arrays([self.item, ids.take(pa.array(x))])
        place = np.empty(len(item), np.int64)
        place[pc.sort_indices(item, null_placement="at_start").to_numpy()] = np.arange(len(item))
        first = self._first(query, score, place)
        self.query, self.score, self.item = query[first], score[first], item.take(pa.array(first))
        n = np.bincount(self.query, minlength=len(self.kth))
        full = np.flatnonzero(n == self.k)
        self.kth[full] = self.score[np.cumsum(n)[full] - 1]

    def _first(self, query: np.ndarray, score: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where the ``k`` first of each query are, in order."""
        order = np.lexsort((place, -score, query))
        ends = query[order]
        return order[np.arange(len(order)) - np.searchsorted(ends, ends) < self.k]


def _of_plain(queries: DataFrame, items: DataFrame, k: int, query_id: str, item_id: str, vector: str, size: int) -> DataFrame:
    """The ``k`` best items that each task has for each query of a block; all vectors are plain."""
    spark = queries.sparkSession
    block = queries.select(query_id, vector).toArrow()  # one block, of a bounded number of queries
    sent = spark.sparkContext.broadcast((block.column(0).combine_chunks(), _matrix(block.column(1), size)))
    n = block.num_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = sent.value
        best, step = None, max(1, _TILE // max(1, n))
        for b in batches:
            best = best or _Best(matrix, k, b.column(0).type)
            for at in range(0, b.num_rows if n else 0, step):
                some = b.slice(at, step)
                best.add(some.column(0), _matrix(some.column(1), size))
        if best is not None and len(best.query):
            yield pa.RecordBatch.from_arrays([names.take(pa.array(best.query)), best.item, pa.array(best.score)], names=[query_id, item_id, "score"])

    schema = StructType([queries.schema[query_id], items.schema[item_id], StructField("score", DoubleType())])
    # The work is the number of pairs, so items are dealt out anew: a few files may hold them all.
    return items.select(item_id, vector).repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(run, schema)


def _of_block(queries: DataFrame, items: DataFrame, query_id: str, item_id: str, vector: str, most_queries: int) -> DataFrame:
    """Scores of at most ``most_queries`` queries with all ``items``, a row a pair."""
    packed = queries.agg(F.collect_list(F.struct(query_id, F.col(vector).alias("q"))).alias("queries"))
    checked = F.when(F.size("queries") > most_queries, F.raise_error(F.lit("too many queries"))).otherwise(F.col("queries"))
    one = F.broadcast(packed.select(checked.alias("queries")))
    return items.join(one).select(item_id, vector, F.explode("queries").alias("e")).select(F.col(f"e.{query_id}").alias(query_id), item_id, scores.dot(F.col("e.q"), F.col(vector)).alias("score"))


def top_matches(queries: DataFrame, items: DataFrame, k: int, query_id: str = "query_id", item_id: str = "item_id", vector: str = "vector", most_queries: int = MOST_QUERIES) -> DataFrame:
    """The ``k`` best items of each query; ties go to the lesser item id.

    A stated set of queries meets all items where these are read, in blocks of at
    most ``most_queries`` that a hash of the id deals out; each task keeps ``k``
    items a query before the shuffle.
    """
    seen = queries.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("size")).first()
    n, size = seen["n"], seen["size"] or 0
    blocks, fullest = 1, n
    while fullest > most_queries and blocks < 4 * n:  # more blocks until each fits; what cannot be parted fails when it runs
        blocks = max(2 * blocks, -(-4 * n // (3 * most_queries)))
        fullest = queries.groupBy(F.pmod(F.xxhash64(query_id), F.lit(blocks)).alias("b")).count().agg(F.max("count")).first()[0]
    block = F.pmod(F.xxhash64(query_id), F.lit(blocks))
    plain = _plain(vector, size) if size > 0 and fullest <= most_queries else F.lit(False)
    some, found = items.filter(plain), []
    for b in range(blocks):
        mine = queries.filter(block == b)
        pairs = _of_block(mine.filter(plain), items.filter(~plain), query_id, item_id, vector, most_queries).unionByName(_of_block(mine.filter(~plain), items, query_id, item_id, vector, most_queries))
        if size > 0 and fullest <= most_queries:
            pairs = pairs.unionByName(_of_plain(mine.filter(plain), some, k, query_id, item_id, vector, size))
        place = F.row_number().over(Window.partitionBy(query_id).orderBy(F.col("score").desc(), item_id))
        found.append(pairs.withColumn("place", place).filter(F.col("place") <= k))
    return reduce(DataFrame.unionByName, found)
