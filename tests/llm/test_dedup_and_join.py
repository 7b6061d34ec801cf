from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.conftest import LOWER, words

from veridal.llm import components, exact_dedup, jaccard_join
from veridal.llm.shingles import shingle_sets


def brute_groups(rows):
    """(doc_id, n_shingles, component_id) by comparing all sets that share a shingle."""
    sets = []
    for _, text in rows:
        w = words((text or "").translate(LOWER))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for j, common in Counter(j for g in s for j in holders[g]).items():
            if common * 100 >= 80 * len(s | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
        for g in s:
            holders[g].append(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        if doc is not None:
            least[r] = min(doc, least.get(r, doc))
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def pairs_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def groups(df):
    return sorted((tuple(r) for r in jaccard_join.similar_groups(df).collect()), key=str)


def near_copies(seed, n=60):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 6, 12, 30, 60, 200]))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10_000)}"
        if rng.random() < 0.3:
            w += ["shared"] * 3 + [f"s{k}" for k in range(15)]
        rows.append((i, " ".join(w)))
    return rows


def test_join_equals_brute_force_on_documents(documents):
    assert groups(documents) == brute_groups(pairs_of(documents))


@pytest.mark.parametrize("seed", range(3))
def test_join_equals_brute_force_on_near_copies(spark, seed, monkeypatch):
    rows = near_copies(seed)
    monkeypatch.setattr(jaccard_join, "SALT_ROWS", [50_000, 1, 3][seed])
    monkeypatch.setattr(jaccard_join, "choose_boundary", lambda *_: [0, 20, 1000][seed])
    monkeypatch.setattr(jaccard_join, "MOST_KEYS", [1 << 20, 0, 3][seed])
    rows += rows[:5] + [(None, rows[0][1])] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert groups(df) == brute_groups(rows)


def test_a_group_of_near_copies_is_not_expanded(spark, monkeypatch):
    """Copies under the limit to each other: far fewer pairs are compared than there are, and none is missed."""
    rng = random.Random(5)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randrange(2, 7) if i else 0):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    made, compared = [], jaccard_join._compared
    monkeypatch.setattr(jaccard_join, "_compared", lambda pairs, sets: made.append(pairs.count()) or compared(pairs, sets))
    assert groups(spark.createDataFrame(rows, "doc_id long, text string")) == brute_groups(rows)
    assert sum(made) < len(rows) * (len(rows) - 1) // 8, made


@pytest.mark.parametrize("rounds", [1, 6])
def test_groups_that_share_a_passage(spark, rounds, monkeypatch):
    monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard_join, "PAIRS_A_ROW", 0)
    monkeypatch.setattr(jaccard_join, "_in_order", lambda tokens, _: tokens)  # any order, so that common tokens come first, too
    rng = random.Random(9)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for i in range(120):
        w = [f"g{i % 6}.{k}" for k in range(50)]
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(passage + w)))
    assert groups(spark.createDataFrame(rows, "doc_id long, text string")) == brute_groups(rows)


def test_join_corners(corners, nothing, clashing):
    want = brute_groups(pairs_of(corners))
    got = groups(corners)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    by_id = {g[0]: g[2] for g in got}
    assert by_id[5] == 4 and by_id[8] == 7 and by_id[1] == 1 and by_id[2] == 2 and by_id[None] is None
    assert groups(nothing) == []
    kept = jaccard_join.keep_one_of_each(clashing)
    assert kept.columns == clashing.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 6, 7, 9, 10, 11, 12, None], key=str)


def test_one_row_of_each_group_stays_whatever_the_ids(spark):
    base = {x: [f"{x}{i}" for i in range(80)] for x in "abcdef"}

    def near(x, k):
        return " ".join(base[x][:-k] + [f"new{k}"] * k)

    def plain(x):
        return " ".join(base[x])

    rows = [
        (1, plain("a")), (None, near("a", 1)), (7, near("a", 2)),  # the copies have a null id and 7 ...
        (None, plain("b")), (7, plain("c")), (None, ""), (None, None), (None, None), (7, " "),  # ... and so have rows that are nobody's copies
        (None, plain("d")), (None, near("d", 1)), (None, plain("d")),
        (5, plain("e")), (5, near("e", 1)), (5, plain("e")), (5, plain("f")),
    ]
    out = jaccard_join.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    left = Counter((r.doc_id, r.text) for r in out.collect())
    group_of = {t: x for x in base for t in (plain(x), near(x, 1), near(x, 2))}
    assert Counter((d, group_of.get(t, t)) for d, t in left.elements()) == Counter(
        [(1, "a"), (None, "b"), (7, "c"), (None, ""), (None, None), (None, None), (7, " "), (None, "d"), (5, "e"), (5, "f")]
    )


def test_a_chain_of_links_is_one_group(spark):
    w = [f"t{i}" for i in range(120)]
    rows = [(i, " ".join(w[4 * i : 4 * i + 60])) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert groups(df) == brute_groups(rows) and {g[2] for g in groups(df)} == {0}


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100) if i % 25 != 24] + [(7, 7)], "a long, b long")
    out = {r.node: r.root for r in components.components(links).collect()}
    assert out == {i: i // 25 * 25 for i in range(100) if i % 25}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB é\t\n\x0b\x1cß", max_size=60))
def test_shingle_counts(text):
    w = words(text.translate(LOWER))
    want = len({tuple(w[k : k + 5]) for k in range(len(w) - 4)}) if len(w) >= 5 else bool(w)
    assert len(shingle_sets([b"left alone", text.encode(), None, b""])[1]) == want


def test_signatures_bound_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 1 << 63, rng.integers(1, 600)).astype(np.uint64)) for _ in "ab")
        b = np.unique(np.concatenate([b[: rng.integers(0, 50)], a[: rng.integers(0, len(a) + 1)]]))
        differ = len(np.setxor1d(a, b))
        x, y = (np.frombuffer(jaccard_join.signature(s), np.uint8).astype(int) for s in (a, b))
        assert np.abs(x - y).sum() <= differ


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(0, jaccard_join.BLOCK - 1), st.integers(1, 255), max_size=30), st.booleans())
def test_sketch_blocks_round_trip(counts, full):
    block = np.full(jaccard_join.BLOCK, 3 if full else 0, np.uint8)
    for k, n in counts.items():
        block[k] = n
    assert (jaccard_join._unpacked(jaccard_join._packed(block)) == block).all()


def test_first_common_key_bounds_the_overlap():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = rng.permutation(60)[: rng.integers(1, 40)].astype(np.uint64)
        b = np.unique(np.concatenate([a[: rng.integers(0, len(a) + 1)], rng.integers(0, 60, 5).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        if common * 180 < 80 * (len(a) + len(b)):
            continue
        for boundary in (0, 10, 100):
            (ka, ma, _), (kb, mb, _) = (jaccard_join.keys_of(np.sort(x), boundary) for x in (a, b))
            both = {k: min(int(ma[i]), int(mb[np.flatnonzero(kb == k)[0]])) for i, k in enumerate(ka.tolist()) if k in set(kb.tolist())}
            assert both and max(both.values()) * 180 >= 80 * (len(a) + len(b))


def brute_lists(rows):
    """Of each list of ``(token, salt, n, sid, bound)``: the parts between sizes that cannot link, if they have pairs that can."""
    out, lists = [], defaultdict(dict)
    for r in rows:
        lists[r[:2]][r] = None
    for (_, salt), members in lists.items():
        parts = [[]]
        for r in members:
            if salt < 0 and parts[-1] and parts[-1][-1][2] * 100 < r[2] * 80:
                parts.append([])
            parts[-1].append(r)
        for part in parts:
            if salt >= 0 or len(part) > 2 or len(part) == 2 and min(r[4] for r in part) * 180 >= sum(r[2] for r in part) * 80:
                out += [(r[0], part[0][2] if salt < 0 else 0, *r[2:]) for r in part]
    return out


def test_lists_are_cut_the_same_however_they_arrive():
    rng = np.random.default_rng(0)
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
    for _ in range(300):
        rows = set()
        for _ in range(rng.integers(1, 60)):
            token, sid = int(rng.integers(6)), int(rng.integers(30))
            n = sid * 7 % 37 + 1
            rows.add((token, -1 if token < 4 else int(rng.integers(2)), n, sid, n - sid * token % max(1, n // 3)))
        rows = [r for r in sorted(rows) for _ in range(rng.choice([1, 1, 2, 3]))]
        want = sorted((t ^ int(jaccard_join.mix(np.array([part], np.uint64)).view(np.int64)[0]), sid, n, bound) for t, part, n, sid, bound in brute_lists(rows))
        for cuts in ([], sorted(rng.integers(0, len(rows) + 1, 5).tolist()), list(range(1, len(rows)))):
            parts = [list(zip(*rows[a:b], strict=True)) for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True) if a < b]
            batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(p, kinds, strict=True)], names=["token", "salt", "n", "sid", "bound"]) for p in parts]
            assert sorted(tuple(r.values()) for o in jaccard_join._scan_lists(iter(batches)) for r in o.to_pylist()) == want


def test_boundary_weighs_pairs_against_lists():
    assert jaccard_join.choose_boundary({}, 1.0) == 0
    assert jaccard_join.choose_boundary({10: 5, 400: 5}, 1.0) < jaccard_join.choose_boundary({10: 5, 40: 5, 400: 5}, 1000.0) < 400


def on_one_template(n):
    """Pages that share most of their words and do not link; some have near copies."""
    frame = [f"t{k}" for k in range(167)]
    out = [(i, " ".join(frame + [f"p{i}x{k}" for k in range(33)])) for i in range(n)]
    return out + [(n + i, out[i][1] + " copied") for i in range(0, n, 5)]


def test_pages_on_one_template_form_rows_in_proportion(spark, monkeypatch):
    formed = []
    plain = jaccard_join._by_differences

    def counting(near):
        x = near.filter(f"state = {jaccard_join.AT_NEAR}").select("p", "token", F.col("own").alias("o"), F.col("other").alias("q"))
        formed[-1] += x.join(near.select("p", "token", F.col("other").alias("o"), F.col("own").alias("q")), ["p", "token", "o", "q"]).count() + near.count()
        return plain(near)

    monkeypatch.setattr(jaccard_join, "_by_differences", counting)
    for n in (200, 400):
        rows = on_one_template(n)
        formed.append(0)
        assert groups(spark.createDataFrame(rows, "doc_id long, text string")) == brute_groups(rows)
    assert formed[1] <= 2.6 * max(formed[0], 2_000), formed


# --- exact dedup ---


def brute_exact(rows):
    norm = [(d, (t or "").translate(LOWER)) for d, t in rows]
    members = defaultdict(list)
    for d, t in norm:
        members[t].append(d)
    return sorted(
        ((d, max((x for x in members[t] if x is not None), default=None), len(members[t]), hashlib.sha256(t.encode()).hexdigest()) for d, t in norm), key=str
    )


@pytest.mark.parametrize("slots", [1, 4, 1024])
def test_exact_groups(corners, documents, slots):
    for df in (corners, documents):
        rows = exact_dedup.exact_groups(df, slots=slots).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=str) == brute_exact(pairs_of(df))
        kept = Counter(r.text_sha256 for r in rows if r.kept)
        assert set(kept.values()) == {1} and set(kept) == {r.text_sha256 for r in rows}
        assert all(r.doc_id == r.keep_id for r in rows if r.kept)


def test_one_row_repeated_many_times_is_spread(spark):
    many = spark.range(200_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("the same").alias("text")).repartition(8)
    others = spark.createDataFrame([(1, "the SAME"), (None, "the same"), (2, "x"), (2, "X"), (None, "y")], "doc_id long, text string")
    for df in (many.unionByName(others), many.select(F.lit(None).cast("long").alias("doc_id"), "text").unionByName(others)):
        groups_ = exact_dedup.exact_groups(df)
        assert groups_.filter("kept").count() == 3 and groups_.count() == 200_005
        assert groups_.filter("group_size = 200002").count() == 200_002
        shuffled = groups_.filter(F.col("group_size") == 2).agg(F.count("*")).first()[0]
        assert shuffled == 2
        plan = groups_._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Window") and "heavy" in plan
        assert exact_dedup.drop_copies(df).count() == 3


def test_groups_of_the_shuffle_are_bounded_in_rows(spark, monkeypatch):
    """Counters grow with the table, so that no digest outside the broadcast has more rows than the bound."""
    rows = [(i, f"text {i % 50}" if i < 2000 else f"own {i}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = exact_dedup.digests(docs, "text", "doc_id")
    monkeypatch.setattr(exact_dedup, "SLOTS", 4)
    assert exact_dedup.slots_for(table) == 4 and exact_dedup.slots_for(table, 30) == 200
    monkeypatch.setattr(exact_dedup, "MOST_SLOTS", 150)
    assert exact_dedup.slots_for(table, 30) == 150
    monkeypatch.setattr(exact_dedup, "MOST_SLOTS", 1 << 17)
    assert exact_dedup.winners(table).count() == 0
    assert {r.group_size for r in exact_dedup.winners(table, exact_dedup.slots_for(table, 30)).collect()} == {40}
    monkeypatch.setattr(exact_dedup.slots_for, "__defaults__", (30,))
    got = exact_dedup.exact_groups(docs).collect()
    assert {r.doc_id: r.keep_id for r in got} == {i: 1950 + i % 50 if i < 2000 else i for i, _ in rows}


def test_exact_dedup_keeps_columns_and_one_row_each(clashing, nothing):
    out = exact_dedup.drop_copies(clashing, slots=2)
    assert out.columns == clashing.columns
    assert sorted((r.doc_id for r in out.select("doc_id").collect()), key=str) == sorted([3, 2, 5, 6, 8, 9, None, 10, 11, 12], key=str)
    assert exact_dedup.drop_copies(nothing).count() == 0 and exact_dedup.exact_groups(nothing).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=200), st.integers(1, 8))
def test_misra_gries_finds_every_heavy_digest(values, slots):
    batches = [pa.RecordBatch.from_pydict({"digest": pa.array([str(v).encode() for v in values[i : i + 17]], pa.binary())}) for i in range(0, len(values), 17)]
    out = next(exact_dedup.misra_gries(iter(batches), slots)).to_pydict()
    found = {d: n for d, n in zip(out["digest"], out["n"], strict=True) if d is not None}
    true = Counter(str(v).encode() for v in values)
    assert len(found) <= slots or len(true) <= slots
    assert all(found[d] <= true[d] for d in found)
    assert all(d in found for d, n in true.items() if n * (slots + 1) > len(values))
