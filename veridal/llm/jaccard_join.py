"""N-gram Jaccard join: a size-aware heavy-light join, exact on shingle sets.

All tokens (shingle hashes) have one order, rarest first by a sketch of fixed
size that counts all documents; any order gives right results, this one keeps
lists short. Sets of a Jaccard similarity of at least 0.8 share at least ``c``
of each one's first ``n - ceil(0.8 n) + c`` tokens. So

* light sets, up to a boundary, enumerate all subsets of two tokens of their
  prefix for ``c = 2``: keys that few other sets have;
* heavy sets, beyond it, enter the inverted lists of the single tokens of their
  prefix for ``c = 1``, and the lists are scanned in sorted runs.

Sets up to 1/0.8 times the boundary are in both, so that no pair is missed. The
boundary minimises the keys to shuffle plus the lists to scan, from the numbers
of sets by size and the mean list length that the sketch gives.

Equal sets are one node. Lists are not expanded into pairs. Each list has a
*pivot*, the set that shares most of its keys, which is the centre of a group of
near copies; every set of a list is compared with the pivot, and is then linked
to it, *near* (a similarity of 0.6 or more) or *far*. As Jaccard distances obey
the triangle inequality, of two sets of a list

* both linked to the pivot are in one component already;
* one linked and one far cannot link;
* two that are not far link only if they share so many tokens of their
  *differences* from the pivot as their sizes tell, at least one: a second index,
  on a prefix of the differences, finds them. Differences are short, and in a
  group of near copies what one copy has changed is seldom what another has.
  Sets of a pivot are classed by how much they differ from it, and the prefix is
  as long as the closest set of the other class asks for, so pages that share a
  template and no more meet in no list;
* lists whose pivot leaves far sets get a new pivot among those, in rounds, as
  long as the pairs that are left outnumber the rows; then those pairs, cut by
  the bound of their places in the lists, are compared as they are.

Lists of two sets go before that if the sets' signatures (numbers of tokens in
``BINS`` bins of the hash) differ by more than linked sets' can.

Every candidate is compared on its whole set; none is dropped. Lists of
frequent keys are cut by the set's hash when they are scanned.

Shingles and sets are named by 64-bit hashes (see ``shingles``).

Defined results: null or wordless texts have an empty set and link with nothing;
a text of 1 to 4 words is one shingle; a text of any length is taken whole; rows
with equal ids are documents of their own; a null id counts as largest; an empty
table gives an empty table; columns besides id and text are neither read nor
clash with any name used here.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridal.llm.components import components
from veridal.llm.shingles import mix, set_id, shingle_sets
from veridal.llm.store import Scratch, arrow_map, cut, in_slices

PERCENT = 80
#: Similarity to the pivot below which a set is far: twice the distance of a link.
NEAR = 2 * PERCENT - 100
SKETCH_BITS = 22
BLOCK = 1 << 16
#: Keys up to which they are broadcast (8 bytes each).
MOST_KEYS = 1 << 20
SALT_ROWS = 50_000
#: Rounds of new pivots, and the pairs a row that a list may leave without one.
ROUNDS = 6
PAIRS_A_ROW = 4
LEVELS = 4
BINS = 128
_LIGHT = np.uint64(0xD1B54A32D192ED03)
_SEEN_AT_MOST = 200_000
LINKED, AT_NEAR, FAR = 0, 1, 2
_LINKED_SETS, _NEAR_SETS = -1, -2
#: Classes of sets by their distance from the pivot, for a distance of all tokens.
CLASSES = 32


def needed(n: int, percent: int = PERCENT) -> int:
    """Least overlap of a set of ``n`` with any set it links with."""
    return (percent * n + 99) // 100


def prefix_length(n: int, c: int, percent: int = PERCENT) -> int:
    return min(n, n - needed(n, percent) + c)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for some in in_slices(batches, "text"):
        yield some, shingle_sets(some.column("text").cast(pa.binary()).to_pylist())


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def signature(tokens: np.ndarray) -> bytes:
    """Numbers of tokens by bin, 255 at most: two sets' differ by no more than the sets do."""
    return np.minimum(np.bincount((tokens & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes()


def _packed(block: np.ndarray) -> bytes:
    """Counts as they are, or their places and values if few are not 0."""
    places = np.flatnonzero(block)
    if len(places) * 4 > len(block):
        return block.tobytes()
    return places.astype("<u2").tobytes() + block[places].tobytes()


def _unpacked(held: bytes) -> np.ndarray:
    if len(held) == BLOCK:
        return np.frombuffer(held, np.uint8).astype(np.int64)
    n = len(held) // 3
    out = np.zeros(BLOCK, np.int64)
    out[np.frombuffer(held, "<u2", n)] = np.frombuffer(held, np.uint8, n, 2 * n)
    return out


def _first_pass(docs: DataFrame) -> DataFrame:
    """Rows ``(key, id, sid, n, sig)`` of documents, and rows ``(block, counts)`` of the sketch."""
    kind = dict(docs.dtypes)["id"]
    names = ["key", "id", "sid", "n", "sig", "block", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int32)
        id_type = None
        for some, sets in _sets(batches):
            id_type = some.schema.field("id").type
            np.add.at(sketch, _bucket(np.concatenate(sets)), 1)
            sids = pa.array([set_id(s) if len(s) else None for s in sets], pa.int64())
            sigs = pa.array([signature(s) if len(s) else None for s in sets], pa.binary())
            rest = (pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary()))
            yield pa.RecordBatch.from_arrays([some.column("key"), some.column("id"), sids, pa.array([len(s) for s in sets], pa.int64()), sigs, *rest], names=names)
        if id_type is not None:
            small = np.minimum(sketch, 255).astype(np.uint8)  # the order needs no more of one task
            blocks = [(k, _packed(small[i : i + BLOCK])) for k, i in enumerate(range(0, len(small), BLOCK))]
            n, nothing, none = len(blocks), pa.nulls(len(blocks), pa.int64()), pa.nulls(len(blocks), pa.binary())
            counts = (pa.array([k for k, _ in blocks], pa.int32()), pa.array([c for _, c in blocks], pa.binary()))
            yield pa.RecordBatch.from_arrays([nothing, pa.nulls(n, id_type), nothing, nothing, none, *counts], names=names)

    return arrow_map(docs, run, f"key long, id {kind}, sid long, n long, sig binary, block int, counts binary")


def _sketch_of(first: DataFrame) -> tuple[np.ndarray, float, float]:
    """Levels of the whole sketch, and the sums of its counts and of their squares.

    A level is ``LEVELS`` times the logarithm of a count, in one byte; the driver
    gets ``2 ** SKETCH_BITS`` bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, held in zip(b.column("block").to_pylist(), b.column("counts").to_pylist(), strict=True):
                sums[block] = sums.get(block, 0) + _unpacked(held)
        for block, counts in sums.items():
            levels = np.floor(LEVELS * np.log2(counts + 1.0)).astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "levels": [levels], "n": [float(counts.sum())], "second": [float((counts.astype(float) ** 2).sum())]})

    total = arrow_map(first.filter("block IS NOT NULL").select("block", "counts").repartition("block"), run, "block int, levels binary, n double, second double")
    levels, n, second = np.zeros(1 << SKETCH_BITS, np.uint8), 0.0, 0.0
    for row in total.collect():  # 2 ** SKETCH_BITS / BLOCK rows
        levels[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(row["levels"], np.uint8)
        n, second = n + row["n"], second + row["second"]
    return levels, n, second


def list_length(n: float, second: float) -> float:
    """Mean length of the list of a token, over all occurrences, from the sketch's second moment."""
    b = float(1 << SKETCH_BITS)
    return max(1.0, (second - n * n / b) / (1 - 1 / b) / n) if n else 1.0


def choose_boundary(sizes: dict[int, int], mean_list: float, percent: int = PERCENT) -> int:
    """The largest light size, by the least total cost.

    A light set costs its pairs of prefix tokens; a heavy one its prefix tokens,
    each with the steps to find its place in a list of the mean length. Sizes
    between the boundary and its reach pay for both.
    """
    light = {n: math.comb(prefix_length(n, 2, percent), 2) for n in sizes}
    heavy = {n: prefix_length(n, 1, percent) * (1 + math.log2(mean_list)) for n in sizes}
    ordered = sorted(sizes)
    best, best_cost = 0, sum(sizes[n] * heavy[n] for n in ordered)
    for x in ordered:
        reach = x * 100 // percent
        cost = sum(sizes[n] * ((light[n] if n <= reach else 0) + (heavy[n] if n > x else 0)) for n in ordered)
        if cost < best_cost:
            best, best_cost = x, cost
    return best


def keys_of(tokens: np.ndarray, boundary: int, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a set whose tokens are in order, the most overlap that each leaves, and the place of its rarest token.

    If a key is the first that two sets share, no more than the smaller of their
    two numbers can be common.
    """
    n = len(tokens)
    keys, most, lead = [], [], []
    if n <= boundary * 100 // percent:
        i, j = np.triu_indices(prefix_length(n, 2, percent), 1)
        keys.append(mix(mix(tokens[i]) * _LIGHT + tokens[j]))
        most.append(n - j + 1)
        lead.append(i)
    if n > boundary:
        p = prefix_length(n, 1, percent)
        keys.append(tokens[:p])
        most.append(n - np.arange(p))
        lead.append(np.arange(p))
    return np.concatenate(keys), np.concatenate(most), np.concatenate(lead)


def _in_order(tokens: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Rarest first; equal levels by value, so that all sets have one order."""
    return tokens[np.argsort(level[_bucket(tokens)], kind="stable")]


def _entries(docs: DataFrame, levels: Broadcast[np.ndarray], boundary: int) -> DataFrame:
    """``(token, salt, sid, n, bound)`` of every set's keys; a partition names a set once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        seen: set[int] = set()
        for _, sets in _sets(batches):
            token, sid, n, bound, rows = [], [], [], [], []
            for s in sets:
                if not len(s) or (name := set_id(s)) in seen:
                    continue
                if len(seen) < _SEEN_AT_MOST:
                    seen.add(name)
                tokens = _in_order(s, level)
                keys, most, lead = keys_of(tokens, boundary)
                token.append(keys)
                bound.append(most)
                rows.append(level[_bucket(tokens[lead])])
                sid.append(np.full(len(keys), name))
                n.append(np.full(len(keys), len(s)))
            if token:
                sid_ = np.concatenate(sid)
                salts = (np.exp2(np.concatenate(rows) / LEVELS) / SALT_ROWS).astype(np.int64) + 1
                salt = np.where(salts > 1, sid_.view(np.uint64) % salts.astype(np.uint64), -1).astype(np.int32)
                columns = (np.concatenate(token).view(np.int64), salt, sid_, np.concatenate(n).astype(np.int32), np.concatenate(bound).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "salt", "sid", "n", "bound"])

    return arrow_map(docs, run, "token long, salt int, sid long, n int, bound int")


def _scan_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of sets that may link, each set once, from rows in the order of token, salt, size and set.

    A list is cut where a size is followed by one that is too large for both to
    link; each part is a list of its own (``token`` tells which), and goes if it
    has one set, or two whose places leave too little. Parts of lists that were
    cut by hash (``salt`` from 0; -1 for whole lists) are shown as they are, as
    their other parts have more. Of a list that goes on in the next batch, two
    sets at most wait.
    """
    names = ["token", "salt", "sid", "n", "bound"]
    waiting: dict[str, np.ndarray] | None = None
    told = False  # whether the one row that waits has been shown
    seg = 0

    def shown(c: dict[str, np.ndarray], first: np.ndarray, complete: bool) -> tuple[np.ndarray, np.ndarray]:
        """Rows to show, and the number of each row's list; of the last list, only if it is complete or has three sets."""
        number = np.cumsum(first) - 1
        at = np.flatnonzero(first)
        size = np.diff(np.append(at, len(first)))
        fine = (size > 2) | (c["salt"][at] >= 0)
        two = at[size == 2]
        least = np.minimum(c["bound"][two], c["bound"][two + 1]).astype(np.int64)
        fine[size == 2] |= least * (100 + PERCENT) >= (c["n"][two].astype(np.int64) + c["n"][two + 1]) * PERCENT
        if told:
            fine[0] = True
        if not complete and size[-1] < 3 and not (told and len(at) == 1):
            fine[-1] = False
        return fine[number], number

    def rows(c: dict[str, np.ndarray], first: np.ndarray, show: np.ndarray) -> pa.RecordBatch:
        start = c["n"][np.flatnonzero(first)][np.cumsum(first) - 1].astype(np.uint64)
        start[: int(np.argmax(np.append(first[1:], True))) + 1] = seg or start[0]
        part = np.where(c["salt"] >= 0, np.uint64(0), start)
        return pa.RecordBatch.from_arrays([pa.array(x[show]) for x in (c["token"] ^ mix(part).view(np.int64), c["sid"], c["n"], c["bound"])], names=["token", "sid", "n", "bound"])

    for b in batches:
        if not b.num_rows:
            continue
        c = {k: b.column(k).to_numpy(zero_copy_only=False) for k in names}
        if waiting is not None:
            c = {k: np.concatenate([waiting[k], c[k]]) for k in names}
        same = (c["token"][1:] == c["token"][:-1]) & (c["salt"][1:] == c["salt"][:-1])
        fresh = np.concatenate([[True], ~same | (c["sid"][1:] != c["sid"][:-1])])
        c, same = {k: x[fresh] for k, x in c.items()}, same[fresh[1:]]
        near = (c["n"][:-1].astype(np.int64) * 100 >= c["n"][1:].astype(np.int64) * PERCENT) | (c["salt"][1:] >= 0)
        first = np.concatenate([[True], ~(same & near)])
        show, number = shown(c, first, False)
        put = show.copy()
        put[0] &= not told
        yield rows(c, first, put)
        # What the next batch needs of the last list.
        last = number == number[-1]
        alone = number[-1] == 0
        if not alone:
            seg = 0
        seg = int(seg or c["n"][last][0])
        told = bool(show[-1])
        waiting = {k: x[-1:] if told else x[last] for k, x in c.items()}
    if waiting is not None and not told:
        first = np.arange(len(waiting["n"])) == 0
        yield rows(waiting, first, shown(waiting, first, True)[0])


def _may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs ``(a, b)`` whose signatures ``sa`` and ``sb`` differ in no more than sets of ``na`` and ``nb`` tokens may that link."""
    for some in batches:
        x, y = (np.frombuffer(b"".join(some.column(c).to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16) for c in ("sa", "sb"))
        sizes = some.column("na").to_numpy() + some.column("nb").to_numpy()
        fit = np.abs(x - y).sum(1, dtype=np.int64) * (100 + PERCENT) <= sizes * (100 - PERCENT)
        yield some.select(["a", "b"]).filter(pa.array(fit))


def _fit_lists(lists: DataFrame, named: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows of lists of two sets or more, with their ``length``, but for pairs that signatures rule out."""
    held = lists.groupBy("token").agg(F.count("*").alias("length"), F.min("sid").alias("a"), F.max("sid").alias("b"))
    held = scratch.keep(held.filter("length > 1"))
    left, right = (named.select(F.col("sid").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}")) for c in "ab")
    pairs = held.filter("length = 2").select("a", "b").distinct().join(left, "a").join(right, "b")
    fit = scratch.keep(arrow_map(pairs, _may_link, "a long, b long"))
    good = held.filter("length > 2").unionByName(held.filter("length = 2").join(fit, ["a", "b"], "left_semi")).select("token", "length")
    return scratch.keep(lists.join(scratch.keep(good), "token"))


def _with_pivot(rows: DataFrame, scratch: Scratch, able: str = "true") -> DataFrame:
    """``rows`` of lists with the set of most ``rank`` of those in their list that are ``able`` to be the pivot.

    The pivots are written first, so that Spark can split a long list in the join.
    """
    pivots = rows.filter(able).groupBy("token").agg(F.min(F.struct((-F.col("rank")).alias("rank"), "sid")).alias("best"))
    return rows.join(scratch.keep(pivots.select("token", F.col("best.sid").alias("pivot"))), "token").select("token", "sid", "n", "bound", "rank", "pivot")


def _listed_sets(docs: DataFrame, lists: DataFrame, named: DataFrame, levels: Broadcast[np.ndarray], scratch: Scratch) -> DataFrame:
    """``(sid, tokens)`` of the sets in ``lists``, tokens in order, from one document of each.

    ``named`` has ``sid`` and the ``key`` of that document. Up to ``MOST_KEYS`` keys
    are broadcast, so that no other text leaves the pass; more are joined with the
    texts.
    """
    keys = scratch.keep(named.join(lists.select("sid").distinct(), "sid", "left_semi").select("key"))
    few = keys.count() <= MOST_KEYS
    if few:
        sent = docs.sparkSession.sparkContext.broadcast(np.sort(keys.toArrow().column("key").to_numpy()))
    else:
        docs = docs.join(keys, "key", "left_semi").select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        for some in in_slices(batches, "text"):
            if few:
                wanted, held = sent.value, some.column("key").to_numpy()
                at = np.minimum(np.searchsorted(wanted, held), max(len(wanted) - 1, 0))
                some = some.filter(pa.array(wanted[at] == held if len(wanted) else np.zeros(len(held), bool)))
            found = [s for s in shingle_sets(some.column("text").cast(pa.binary()).to_pylist()) if len(s)]
            if found:
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([_in_order(s, level) for s in found]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in found], pa.int64()), tokens], names=["sid", "tokens"])

    sets = scratch.keep(arrow_map(docs.select("key", "text"), run, "sid long, tokens array<bigint>"), large=True)
    if few:
        sent.destroy()
    size = sets.agg(F.count("*").alias("rows"), F.count_distinct("sid").alias("sets")).first()
    # Rows that are equal in id and text share a key.
    return sets if size["rows"] == size["sets"] else scratch.keep(sets.groupBy("sid").agg(F.first("tokens").alias("tokens")), large=True)


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` with their sizes and what each has that the other lacks."""
    left = sets.select(F.col("sid").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("sid").alias("b"), F.col("tokens").alias("tb"))
    out = pairs.join(left, "a").join(right, "b")
    return out.select("a", "b", F.size("ta").alias("na"), F.size("tb").alias("nb"), F.array_except("ta", "tb").alias("more"), F.array_except("tb", "ta").alias("less"))


def _within(differ: str, sizes: str, percent: int) -> str:
    """SQL: sets of together ``sizes`` tokens that differ in ``differ`` are similar by ``percent`` at least."""
    return f"({differ}) * {100 + percent} <= ({sizes}) * {100 - percent}"


def _stars(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Every set ``a`` with each pivot ``b`` of its lists: ``na``, ``differ``, ``state``, and what differs if not far.

    ``apart`` has first the tokens that the pivot lacks, then those that only it
    has, both rarest first: one order for all sets of a pivot.
    """
    pairs = rows.filter("sid != pivot").select(F.col("sid").alias("a"), F.col("pivot").alias("b")).distinct()
    differ = F.size("more") + F.size("less")
    state = F.when(F.expr(_within("differ", "na + nb", PERCENT)), LINKED).when(F.expr(_within("differ", "na + nb", NEAR)), AT_NEAR).otherwise(FAR)
    out = _compared(pairs, sets).withColumn("differ", differ).withColumn("state", state)
    return out.select("a", "b", "na", "nb", "differ", "state", F.when(F.col("state") != FAR, F.concat("more", "less")).alias("apart"))


def _differences(stars: DataFrame, scratch: Scratch) -> DataFrame:
    """``(p, token, own, other, a, na, differ, state, at)``: the tokens of each set's difference from its pivot ``p`` by which it may link with a set of class ``other``.

    If ``x`` links with ``s``, and ``s`` is not linked to the pivot ``p``, then the
    differences of both from ``p`` share at least ``(differ(x) + differ(s) -
    (n(x) + n(s)) / 9) / 2`` tokens, which is more than ``4/9 differ(x)``, and more
    than ``(differ(s) - (n(s) + n(p)) / 9) / 2``; the first token that they share
    is then among as many fewer of each one's tokens. The first bound is taken
    with the least that any set of the other class adds to it. Linked sets are one
    class, and to them near ones are, so that a set is not repeated for each class.
    """
    p, q = 100 + PERCENT, 100 - PERCENT
    least = F.expr(f"CASE WHEN state = {LINKED} THEN floor({PERCENT} * differ / {p}) + 1 ELSE greatest(1, ceil(({p} * differ - {q} * (na + nb) + {2 * PERCENT}) / {2 * p})) END")
    near = stars.filter(f"state < {FAR}").withColumn("least", least).withColumn("cost", F.expr(f"cast(differ * {p} - na * {q} AS long)"))
    own = F.when(F.col("state") == LINKED, _LINKED_SETS).otherwise(F.expr(f"cast(floor({CLASSES} * differ / (na + nb)) AS int)"))
    near = near.withColumn("own", own).withColumnRenamed("b", "p")
    classes = near.groupBy("p", "own").agg(F.min("cost").alias("least_cost"))
    every = classes.filter(F.col("own") != _LINKED_SETS).groupBy("p").agg(F.min("least_cost").alias("least_cost")).select("p", F.lit(_NEAR_SETS).alias("other"), "least_cost")
    classes = scratch.keep(classes.withColumnRenamed("own", "other").unionByName(every))
    # Linked sets meet all near ones in one list, near ones meet each other by class.
    linked = F.col("own") == _LINKED_SETS
    rows = near.join(classes, "p").filter(linked == (F.col("other") == _NEAR_SETS))
    rows = rows.withColumn("own", F.when(F.col("other") == _LINKED_SETS, _NEAR_SETS).otherwise(F.col("own")))
    places = F.expr(f"cast(least(differ - least, floor(differ - (cost + least_cost) / {2 * p})) + 1 AS int)")
    rows = rows.withColumn("places", places).filter("places > 0")
    return rows.select("p", "own", "other", "a", "na", "differ", "state", F.posexplode(F.expr("slice(apart, 1, places)")).alias("at", "token"))


def _by_differences(near: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of sets near one pivot, not both linked to it, that their differences leave open."""
    p, q = 100 + PERCENT, 100 - PERCENT
    x, y = (near.select("p", "token", *[F.col(c).alias(f"{c}{k}") for c in ("own", "other", "a", "na", "differ", "state", "at")]) for k in "12")
    y = y.withColumnsRenamed({"own2": "other1", "other2": "own1"})
    room = f"least(differ1 - at1, differ2 - at2) * {2 * p} >= (differ1 + differ2) * {p} - (na1 + na2) * {q}"
    both = x.filter(f"state1 = {AT_NEAR}").join(y, ["p", "token", "own1", "other1"]).filter(f"(state2 = {LINKED} OR a2 < a1) AND {room}")
    return both.select(F.greatest("a1", "a2").alias("a"), F.least("a1", "a2").alias("b")).filter("a != b")


def _by_places(rows: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of a list, one of them far from its pivots and the other not linked to them, that their places leave open."""
    x, y = (rows.select("token", *[F.col(c).alias(f"{c}{k}") for c in ("sid", "n", "bound", "state")]) for k in "12")
    room = f"least(bound1, bound2) * {100 + PERCENT} >= (n1 + n2) * {PERCENT}"
    both = x.filter(f"state1 = {FAR}").join(y, "token").filter(f"sid1 != sid2 AND (state2 < {FAR} OR sid2 < sid1) AND {room}")
    return both.select(F.greatest("sid1", "sid2").alias("a"), F.least("sid1", "sid2").alias("b"))


def _links(docs: DataFrame, first: DataFrame, scratch: Scratch) -> DataFrame:
    """Links between sets that make the same components as all links do."""
    levels, n, second = _sketch_of(first)
    named = scratch.keep(first.filter("sid IS NOT NULL").groupBy("sid").agg(F.min("key").alias("key"), F.min("n").alias("n"), F.first("sig").alias("sig")))
    binned = F.expr("cast(CASE WHEN n < 512 THEN n ELSE floor(exp2(floor(log2(n) * 16) / 16)) END AS long)".replace("exp2(", "power(2, "))
    sizes = {r["size"]: r["c"] for r in named.groupBy(binned.alias("size")).agg(F.count("*").alias("c")).collect()}  # 512 sizes, and 16 for each doubling
    boundary = choose_boundary(sizes, list_length(n, second))
    sent = docs.sparkSession.sparkContext.broadcast(levels)
    entries = _entries(docs, sent, boundary).repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "sid")
    lists = scratch.keep(arrow_map(entries, _scan_lists, "token long, sid long, n int, bound int"), large=True)
    rows = _fit_lists(lists, named, scratch)
    scratch.free(lists)
    sets = _listed_sets(docs, rows, named, sent, scratch)
    sent.destroy()

    stars, rest = _star_rounds(rows, sets, scratch)
    open_pairs = scratch.keep(_by_differences(_differences(stars, scratch)).unionByName(_by_places(rest)).distinct())
    alike = _compared(open_pairs, sets).filter(_within("size(more) + size(less)", "na + nb", PERCENT)).select("a", "b")
    return scratch.keep(stars.filter(f"state = {LINKED}").select("a", "b").unionByName(alike))


def _star_rounds(rows: DataFrame, sets: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The stars of lists, with new pivots for their far sets in rounds; and the rows of lists that have far sets after the last.

    ``rows`` (token, sid, n, bound, length) is a kept table, and is freed.
    """
    # A set that shares many of its keys with many others is central.
    ranks = rows.groupBy("sid").agg((F.sum(F.log2("length")) / F.first("n")).alias("rank"))
    ranked = scratch.keep(rows.select("token", "sid", "n", "bound").join(ranks, "sid"))
    scratch.free(rows)
    rows, stars = _with_pivot(ranked, scratch), None
    for turn in range(ROUNDS):
        star = scratch.keep(_stars(rows, sets))
        stars = star if stars is None else stars.unionByName(star)
        state = star.filter(f"state != {LINKED}").select(F.col("a").alias("sid"), F.col("b").alias("pivot"), "state")
        told = scratch.keep(rows.join(state, ["sid", "pivot"]).drop("pivot"))
        scratch.free(ranked)
        ranked = told
        far = scratch.keep(ranked.groupBy("token").agg(F.sum(F.expr(f"cast(state = {FAR} as long)")).alias("far"), F.count("*").alias("all")).filter("far > 0"))
        rows = ranked.join(far, "token", "left_semi")
        size = far.agg(F.sum(F.col("far") * F.col("all")).alias("pairs"), F.sum("all").alias("rows")).first()
        if (size["pairs"] or 0) <= PAIRS_A_ROW * (size["rows"] or 0) or turn == ROUNDS - 1:
            break
        rows = _with_pivot(rows, scratch, f"state = {FAR}")
    return stars, rows


def _row_key(text: str, id_col: str) -> Column:
    """A hash of id and text: rows that share it are equal in both, so in one group."""
    return F.xxhash64(F.col(id_col), F.col(text))


def _grouped(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``id``, ``n`` shingles, ``root`` (null without shingles)."""
    docs = docs.select(_row_key(text, id_col).alias("key"), F.col(id_col).alias("id"), F.col(text).alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        first = scratch.keep(_first_pass(docs), large=True)
        roots = components(_links(docs, first, scratch))
        table = first.filter("block IS NULL").select("key", "id", "sid", "n")
        named = table.join(roots.withColumnRenamed("node", "sid"), "sid", "left")
        return cut(named.select("key", "id", "n", F.coalesce("root", "sid").alias("root")))


def similar_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id``."""
    named = _grouped(docs, text, id_col)
    # Written first, so that Spark can split a great group of copies in the join.
    least = cut(named.filter("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("least")))
    return named.join(least, "root", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group, one of the least id; every row decides for itself.

    A null id counts as largest. Of rows equal in id and text any one stays.
    """
    keys = _grouped(docs, text, id_col).filter("root IS NOT NULL").groupBy("root", "key").agg(F.min("id").alias("id"), F.count("*").alias("rows"))
    keys = cut(keys)
    chosen = cut(keys.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key")).alias("chosen")).select("root", F.col("chosen.key").alias("chosen")))
    fates = keys.join(chosen, "root").select("key", "rows", (F.col("key") == F.col("chosen")).alias("stays"))
    fates = cut(fates.filter("NOT stays OR rows > 1"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _row_key(text, id_col).alias("key"))
    out = rows.join(fates.select("key"), "key", "left_anti").select("row")
    repeated = fates.filter("stays").select("key")
    if not repeated.isEmpty():
        out = out.unionByName(rows.join(repeated, "key", "left_semi").groupBy("key").agg(F.first("row").alias("row")).select("row"))
    return out.select("row.*")
