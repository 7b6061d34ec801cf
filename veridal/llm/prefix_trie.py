"""A trie of the prefixes that conversations share, built level by level.

Turns are ordered by a range partitioning, so that no conversation is gathered in
one task. At each depth the live conversations, which are those that share their
node with another one, are grouped by (node, next turn); the least ``conv_id`` of
a group names the new node. A conversation that is alone in its node has a chain
of nodes for the rest of its turns, which needs no grouping. Then the levels are
joined from the deepest up, and leaves and savings are added up on the way. So
there are as many levels as turns that two conversations share; each costs two
shuffles of the live ones, with sums before the shuffle, and Spark splits the
join's large groups.

Defined results: a null ``turn`` comes first; rows of one conversation with equal
turns are ordered by the SHA-256 of role and text; null role or text is empty;
rows without ``conv_id`` belong to no conversation; repeated rows are turns of
their own; ids are whole numbers and become longs; a text of any length is hashed
whole; an empty table has no node, not even a root; further columns are not
looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridal.llm.store import Scratch, arrow_map, cut

#: Depths whose turns a live conversation carries along.
BLOCK = 8
#: Bytes of ids that one piece of a node's list has, about.
PIECE = 1 << 16
#: The place of a row within its task is below this in ``monotonically_increasing_id``.
_IN_TASK = (1 << 33) - 1
#: The rule of the rebuilt conversations: the heads are shared by ``FAMILY`` ids, and have fewer than ``HEADS`` turns.
FAMILY, HEADS = 5, 9


def ordered_turns(convs: DataFrame, scratch: Scratch) -> DataFrame:
    """``(conv_id, place, turn, bytes)``: places count from 1 in each conversation; ``turn`` is a hash of role and text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = convs.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("at"), digest.alias("turn"), F.octet_length(text).cast("long").alias("bytes"))
    order = ["conv_id", F.col("at").asc_nulls_first(), "turn"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = scratch.keep(ranged.drop("at").withColumn("part", F.spark_partition_id()).withColumn("in_part", F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_TASK))))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = placed.join(F.broadcast(sizes.select("part", before.alias("before"))), "part").withColumn("rank", F.col("before") + F.col("in_part"))
    first = scratch.keep(ranked.groupBy("conv_id").agg(F.min("rank").alias("first")))
    return scratch.keep(ranked.join(first, "conv_id").select("conv_id", (F.col("rank") - F.col("first") + 1).alias("place"), "turn", "bytes"))


def rebuilt_turns(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The turns of all rebuilt conversations, as ``turns`` has them, and ``(conv_id, len)`` of each conversation.

    The head is the first ``crc32(conv_id) % 9`` turns of the conversation
    ``conv_id - conv_id % 5``, as far as it has them; the conversation's own turns
    follow from the next number on.
    """
    own = scratch.keep(turns.groupBy("conv_id").agg(F.count("*").alias("n")))
    convs = own.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("head"))
    of_base = own.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(of_base, "base", "left").withColumn("took", F.least("head", F.coalesce("n_base", F.lit(0))))
    convs = scratch.keep(convs.select("conv_id", "base", "head", "took", (F.col("took") + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("len")))
    tails = turns.join(convs.select("conv_id", "head", "took"), "conv_id").filter("place > head").select("conv_id", (F.col("place") - F.col("head") + F.col("took")).alias("place"), "turn", "bytes")
    bases = turns.filter(F.col("place") < HEADS).withColumnRenamed("conv_id", "base")
    heads = bases.join(convs.select("conv_id", "base", "took"), "base").filter("place <= took").select("conv_id", "place", "turn", "bytes")
    return scratch.keep(heads.unionByName(tails)), convs.select("conv_id", "len")


def _grown(turns: DataFrame, convs: DataFrame, scratch: Scratch) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
    """By depth from 0: shared nodes ``(conv_id, parent, n_convs, bytes)``; nodes of one member; and ``(depth, conv_id, member)`` of members that end in shared nodes."""
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    shared = [scratch.keep(root.select("conv_id", F.lit(None).cast("long").alias("parent"), "n_convs", F.lit(0).cast("long").alias("bytes")))]
    least = shared[0].first()
    alone, ends = [shared[0].limit(0)], []
    live = convs.withColumn("node", F.lit(least["conv_id"] if least else None).cast("long"))
    while True:
        depth = len(shared)
        ends.append(live.filter(F.col("len") == depth - 1).select(F.lit(depth - 1).cast("long").alias("depth"), F.col("node").alias("conv_id"), F.col("conv_id").alias("member")))
        live = live.filter(F.col("len") >= depth)
        if depth % BLOCK == 1:
            ahead = turns.filter(F.col("place").between(depth, depth + BLOCK - 1)).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "turn", "bytes"))).alias("ahead"))
            live = scratch.keep(live.drop("ahead").join(ahead, "conv_id"))
        this = F.element_at("ahead", (depth - 1) % BLOCK + 1)
        live = live.withColumn("turn", this["turn"]).withColumn("bytes", this["bytes"])
        nodes = live.groupBy("node", "turn").agg(F.min("conv_id").alias("least"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"))
        nodes = scratch.keep(nodes)
        level = nodes.select(F.col("least").alias("conv_id"), F.col("node").alias("parent"), "n_convs", "bytes")
        alone.append(level.filter("n_convs = 1"))
        more = nodes.filter("n_convs > 1").select("node", "turn", "least")
        if more.isEmpty():
            return shared, alone, ends
        shared.append(level.filter("n_convs > 1"))
        live = scratch.keep(live.join(more, ["node", "turn"]).select("conv_id", "len", "ahead", F.col("least").alias("node")))


def _rolled_up(shared: list[DataFrame], alone: list[DataFrame], scratch: Scratch) -> DataFrame:
    """The shared nodes with ``n_children``, ``n_leaves`` and ``saved_tokens``, from the deepest level up."""
    done: list[DataFrame] = []
    one = F.lit(1).cast("long")
    for depth in range(len(shared) - 1, -1, -1):
        below = alone[depth + 1].select("parent", one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
        if done:
            below = below.unionByName(done[-1].select("parent", "n_leaves", "saved_tokens"))
        sums = below.groupBy("parent").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
        level = shared[depth].join(sums.withColumnRenamed("parent", "conv_id"), "conv_id", "left")
        saved = (F.col("n_convs") - 1) * F.col("bytes") + F.coalesce("below", F.lit(0))
        level = level.select("conv_id", F.lit(depth).cast("long").alias("depth"), "parent", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", one).alias("n_leaves"), saved.alias("saved_tokens"))
        done.append(scratch.keep(level))
    out = done[0]
    for level in done[1:]:
        out = out.unionByName(level)
    return out


def joined_hashes(ends: DataFrame) -> DataFrame:
    """``(depth, conv_id, ends_sha256)``: SHA-256 of each node's members in ascending order, joined by commas.

    Members are written out into pieces where a range partitioning has sorted
    them; a node's pieces, which are few, then go through one running hash.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, members, size = None, [], 0
        names = ["depth", "conv_id", "first", "piece"]

        def piece() -> pa.RecordBatch:
            cells = (node[0], node[1], members[0], ",".join(map(str, members)).encode())
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=names)

        for b in batches:
            for *own, member in zip(*(b.column(c).to_pylist() for c in ("depth", "conv_id", "member")), strict=True):
                if own != node or size >= PIECE:
                    if members:
                        yield piece()
                    node, members, size = own, [], 0
                members.append(member)
                size += len(str(member)) + 1
        if members:
            yield piece()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, done = None, None, []
        for b in batches:
            for *own, piece in zip(*(b.column(c).to_pylist() for c in ("depth", "conv_id", "piece")), strict=True):
                if own == node:
                    state.update(b",")
                else:
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = own, hashlib.sha256()
                state.update(piece)
            yield _hashes(done)
            done = []
        yield _hashes([(*node, state.hexdigest())] if node else [])

    order = ["depth", "conv_id", "member"]
    pieces = arrow_map(ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order), write, "depth long, conv_id long, first long, piece binary")
    by_node = pieces.repartition("depth", "conv_id").sortWithinPartitions("depth", "conv_id", "first").drop("first")
    return arrow_map(by_node, run, "depth long, conv_id long, ends_sha256 string")


def _hashes(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["depth", "conv_id", "ends_sha256"])


def _hash_of(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def prefix_trie(convs: DataFrame, rebuild: bool = True) -> DataFrame:
    """One row a node of the conversations' trie, with rebuilt heads if ``rebuild``.

    Columns: ``conv_id`` (the least member), ``depth``, ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.
    """
    with Scratch(convs.sparkSession) as scratch:
        turns = ordered_turns(convs, scratch)
        if rebuild:
            turns, lengths = rebuilt_turns(turns, scratch)
        else:
            lengths = scratch.keep(turns.groupBy("conv_id").agg(F.count("*").alias("len")))
        shared, alone, ends = _grown(turns, lengths, scratch)
        nodes = _rolled_up(shared, alone, scratch)
        ended = ends[0]
        for e in ends[1:]:
            ended = ended.unionByName(e)
        nodes = nodes.join(scratch.keep(joined_hashes(ended)), ["depth", "conv_id"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", _hash_of(F.lit(""))))
        starts = alone[0].withColumn("from", F.lit(0).cast("long"))
        for depth, level in enumerate(alone[1:], 1):
            starts = starts.unionByName(level.withColumn("from", F.lit(depth).cast("long")))
        chains = starts.join(lengths, "conv_id").withColumn("depth", F.explode(F.sequence("from", "len")))
        last = F.col("depth") == F.col("len")
        one = F.lit(1).cast("long")
        chains = chains.select(
            "conv_id", "depth", F.when(F.col("depth") == F.col("from"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent"), one.alias("n_convs"), (~last).cast("long").alias("n_children"), one.alias("n_leaves"),
            F.lit(0).cast("long").alias("saved_tokens"), F.when(last, _hash_of(F.col("conv_id").cast("string"))).otherwise(_hash_of(F.lit(""))).alias("ends_sha256"),
        )
        return cut(nodes.unionByName(chains).select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))
