from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tests.llm.conftest import LOWER, SCHEMA

from veridal.llm import collocations, line_dedup, prefix_trie
from veridal.llm.minimal_hash import MinimalHash

CONVS = "conv_id long, turn long, role string, text string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.tuples(st.integers(0, (1 << 64) - 1), st.integers(0, 3) | st.integers(0, (1 << 64) - 1)), max_size=300))
def test_minimal_hash_gives_each_key_a_place_of_its_own(keys):
    h1, h2 = (np.array([k[i] for k in keys], np.uint64) for i in (0, 1))
    made = MinimalHash.of(h1, h2)
    assert sorted(made.places(h1, h2).tolist()) == list(range(len(keys)))
    other = made.places(h1 ^ np.uint64(1), h2 ^ np.uint64(5))
    assert ((other >= -1) & (other < max(1, len(keys)))).all()


def test_minimal_hash_is_small_and_refuses_repeats():
    rng = np.random.default_rng(1)
    h1, h2 = (rng.integers(0, 1 << 63, 50_000).astype(np.uint64) for _ in range(2))
    made = MinimalHash.of(h1, h2)
    assert made.sizes.sum() < 4 * len(h1)
    with pytest.raises(ValueError, match="distinct"):
        MinimalHash.of(np.zeros(2, np.uint64), np.zeros(2, np.uint64))


# ---- lines


def brute_lines(rows, least_chars=40, least_docs=5):
    gap = " \t\n\x0b\x0c\r"
    keys = [[line.strip(gap).translate(LOWER) for line in (t or "").split("\n")] for _, t in rows]
    holders = defaultdict(list)
    for k, own in enumerate(keys):
        for key in set(own):
            holders[key].append(k)
    least = lambda d: (d is not None, d or 0)
    out = []
    for (d, t), own in zip(rows, keys, strict=True):
        lines = (t or "").split("\n")
        gone = [len(k) >= least_chars and len(holders[k]) >= least_docs and max((rows[h][0] for h in holders[k]), key=least) != d for k in own]
        kept = "\n".join(line for line, g in zip(lines, gone, strict=True) if not g)
        out.append((d, len(lines), sum(gone), kept))
    return sorted(out, key=str)


def line_rows(seed, n=60):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdeé ") for _ in range(rng.choice([38, 39, 40, 41, 60]))).strip() + rng.choice("xyé") for _ in range(12)]
    dress = [str, str.upper, lambda s: f" \t{s}\r", lambda s: f"\x0b{s} ", lambda s: f" {s}"]
    out = []
    for i in range(n):
        lines = [rng.choice(dress)(rng.choice(pool)) if rng.random() < 0.7 else rng.choice(["", "short", f"own line {i} " * 5]) for _ in range(rng.randrange(0, 9))]
        out.append((rng.choice([i, i, i, 7, None]), rng.choice(["\n".join(lines)] * 9 + [None])))
    return out


@pytest.mark.parametrize("way", [{}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "shard_keys": 3}, {"shard_keys": 2}])
def test_lines_against_brute_force(spark, way):
    for seed in range(2):
        rows = line_rows(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert rows_of(line_dedup.drop_repeated_lines(docs, **way)) == brute_lines(rows)


def test_the_way_of_a_large_index_is_bounded_groups(spark, monkeypatch):
    """With a few names a group and none decided early, many salted groups give the same."""
    monkeypatch.setattr(line_dedup, "GROUP_KEYS", 4)
    monkeypatch.setattr(line_dedup, "HOT", 1)
    rows = line_rows(5, 90)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(line_dedup.drop_repeated_lines(docs, broadcast_bytes=0, shard_keys=4)) == brute_lines(rows)


@pytest.mark.parametrize("way", [{}, {"broadcast_bytes": 0}])
def test_lines_corners(spark, corners, nothing, clashing, documents, way):
    for docs in (corners, clashing, documents, nothing):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        assert rows_of(line_dedup.drop_repeated_lines(docs, **way)) == brute_lines(rows)


def test_lines_with_ids_of_text_and_a_lower_bound(spark):
    rows = [(d, "the same line of more than forty code points\nown " + d) for d in ("a", "b", "c", "d")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.doc_id: (r.n_dropped, r.text) for r in line_dedup.drop_repeated_lines(docs, least_docs=4).collect()}
    assert got == {"a": (1, "own a"), "b": (1, "own b"), "c": (1, "own c"), "d": (0, rows[3][1])}
    with pytest.raises(ValueError, match="repeated"):
        line_dedup.drop_repeated_lines(docs, least_docs=1)


# ---- conversations


def brute_trie(rows, rebuild=True):
    digest = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            r, t = role or "", text or ""
            own[c].append(((turn is not None, turn or 0, digest(r, t)), (r, t)))
    own = {c: [x[1] for x in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    convs = dict(own)
    if rebuild:
        for c, turns in own.items():
            h = zlib.crc32(str(c).encode()) % 9
            convs[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = Counter(p[:-1] for p in members if p)
    out = []
    for p, m in members.items():
        sub = [q for q in members if q[: len(p)] == p]
        leaves = sum(not children[q] for q in sub)
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in sub if q)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves, saved, hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()))
    return sorted(out, key=str)


def conv_rows(seed, n=40):
    rng = random.Random(seed)
    out = []
    for c in rng.sample(range(n), n * 3 // 4):
        for k in range(rng.choice([1, 2, 3, 12, 20])):
            out.append((c, rng.choice([k, k, k, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é", "", None]) if rng.random() < 0.8 else f"own {c} {k}"))
    return out


@pytest.mark.parametrize("rebuild", [True, False])
def test_trie_against_brute_force(spark, rebuild):
    rows = conv_rows(rebuild) + [(None, 1, "user", "a")]
    # Copies of one conversation, deeper than a block of levels, and one of its prefixes.
    rows += [(c, k, "user", f"t{k}") for c in (100, 101, 103) for k in range(19)] + [(105, k, "user", f"t{k}") for k in range(11)]
    convs = spark.createDataFrame(rows, CONVS).repartition(3)
    got = prefix_trie.prefix_trie(convs, rebuild)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert rows_of(got) == brute_trie(rows, rebuild)


def test_trie_of_a_hot_conversation_and_of_copies(spark, monkeypatch):
    """A third of all rows in one conversation; many copies, whose ids make several pieces."""
    monkeypatch.setattr(prefix_trie, "PIECE", 20)
    rows = [(1, k, "user", f"x{k}") for k in range(300)] + [(c, 0, "user", "same") for c in range(5, 300)]
    convs = spark.createDataFrame(rows, CONVS).repartition(5).withColumn("depth", F.lit("clash")).withColumn("node", F.lit("clash"))
    assert rows_of(prefix_trie.prefix_trie(convs, rebuild=False)) == brute_trie(rows, rebuild=False)


def test_trie_corners(spark):
    empty = spark.createDataFrame([], CONVS)
    assert prefix_trie.prefix_trie(empty).count() == 0
    # Conversation 1 loses all its turns where its head is longer than it and 0 is absent: a member of the root only.
    one = [(c, 0, None, None) for c in (1, 2, 3, 4)]
    assert rows_of(prefix_trie.prefix_trie(spark.createDataFrame(one, CONVS))) == brute_trie(one)
    long = [(0, 0, "user", "w " * 300_000), (0, 0, "user", "w " * 300_000), (0, None, "user", "first")]
    assert rows_of(prefix_trie.prefix_trie(spark.createDataFrame(long, CONVS))) == brute_trie(long)


def test_trie_of_the_given_table(spark, sf_dir):
    convs = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert rows_of(prefix_trie.prefix_trie(convs)) == brute_trie([tuple(r) for r in convs.select("conv_id", "turn", "role", "text").collect()])


# ---- phrases


def brute_phrases(rows, least=30, top=2000):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    found = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    covered = set()
    for (lang, w), b in found.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if 100 * b >= 80 * f[lang, w[i : i + k]]:
                    covered.add((lang, w[i : i + k]))
    out = defaultdict(list)
    for (lang, w), a in found.items():
        if (lang, w) not in covered:
            score, _, x, y = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), x, y))
    return sorted(
        ((lang, i, p.decode(), -a, x, y, n[lang], -s) for lang, v in out.items() for i, (s, a, p, x, y) in enumerate(sorted(v)[:top], 1)), key=str
    )


def phrase_rows(seed, n=120):
    rng = random.Random(seed)
    vocab = ["A", "b", "c", "dé", "É", " ", "x-y", "a", "あ"]
    joins = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "\x1c"]
    return [("".join(rng.choice(vocab) + rng.choice(joins) for _ in range(rng.randrange(0, 30))), rng.choice(["en", "en", None, "und", ""])) for _ in range(n)] + [(None, "en"), ("", None), ("no", "fr")]


@pytest.mark.parametrize(("least", "top"), [(2, 2000), (5, 7), (300, 10)])
def test_phrases_against_brute_force(spark, monkeypatch, least, top):
    """Also with full sketches, small shards and small automata."""
    rows = phrase_rows(least)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    want = brute_phrases(rows, least, top)
    assert rows_of(collocations.collocations(docs, least=least, top=top)) == want
    for name, value in (("FEWEST_BUCKETS", 8), ("MOST_BUCKETS", 16), ("BLOCK_BITS", 3), ("SHARD_BYTES", 200), ("PATTERNS", 3), ("RANKED_ROWS", 5)):
        monkeypatch.setattr(collocations, name, value)
    assert rows_of(collocations.collocations(docs, least=least, top=top)) == want


def test_phrases_corners(spark, corners, nothing, clashing):
    for docs in (corners, clashing, nothing):
        rows = [(r.text, r.lang) for r in docs.select("text", "lang").collect()]
        assert rows_of(collocations.collocations(docs)) == brute_phrases(rows)
    assert SCHEMA.startswith("doc_id")


def test_a_bucket_bounds_its_phrases_from_above(spark):
    rows = phrase_rows(9)
    docs = spark.createDataFrame(rows, "text string, lang string")
    exact = {(r.lang.decode(), r.phrase.decode()): r.n for r in collocations.phrase_counts(docs, least=4).collect() if r.words}
    want = {}
    for lang in {la if la is not None else "und" for _, la in rows}:
        f = Counter()
        for text, la in rows:
            if (la if la is not None else "und") == lang:
                for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
                    w = re.findall("[^\x20\x09]+", piece)
                    f.update(" ".join(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
        want |= {(lang, p): a for p, a in f.items() if a >= 4}
    assert exact == want
