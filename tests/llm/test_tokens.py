from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veridal.llm import packing, range_coder, token_files
from veridal.llm.token_ids import TextEncoder, default_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_path())


@pytest.fixture(scope="module")
def small():
    return TextEncoder(default_path(), slot_bits=4)


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab's \n\t\r  \x85\x1c12.,é"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=6))
def test_pieces_give_the_librarys_ids(small, library, texts):
    texts = [*texts, "a <|endoftext|>  b", None, "it's  'll  1,000\n\n\n x"]
    assert [small.ids(p).tolist() for p in small.encode(texts)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("n", [0, 1, 2, 127, 128, 129, 1000, 20_000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50_000, n), np.arange(n) % 7, np.zeros(n, int), np.where(rng.random(n) < 0.9, np.arange(n) % 50, rng.integers(0, 1 << 16, n))):
        block = range_coder.encode_block(ids.astype("<u4"), 1 << 16)
        assert (range_coder.decode_block(block) == ids).all()
    if n >= 1000:
        assert len(range_coder.encode_block(np.arange(n).astype("<u4") % 7, 1 << 16)) < n


def test_damage_is_noticed():
    block = bytearray(token_files.pack([1, None], [3, 2], np.arange(5, dtype="<u4"), 100))
    assert token_files.unpack(bytes(block))[0] == [1, None]
    for at in (14, len(block) - 1):
        bad = bytes(block[:at]) + bytes([block[at] ^ 1]) + bytes(block[at + 1 :])
        with pytest.raises(ValueError, match="damaged|fit"):
            token_files.unpack(bad)


def brute_files(rows, library):
    out, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(ids_of(library, t), "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_files_round_trip(spark, corners, documents, nothing, library, tmp_path, monkeypatch):
    for k, df in enumerate((corners, documents, nothing)):
        out = f"file://{tmp_path}/files{k}"
        token_files.write_token_files(df, out, block_ids=5000)
        got = sorted((tuple(r) for r in token_files.read_token_files(spark, out).collect()), key=lambda r: r[1])
        assert got == brute_files([(r.doc_id, r.text) for r in df.collect()], library)


def test_one_id_of_many_rows_is_spread_over_files(spark, clashing, library, tmp_path):
    rows = [(7 if i % 3 else i, f"text number {i} of many") for i in range(600)]
    out = f"file://{tmp_path}/hot"
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), out, block_ids=200)
    files = spark.read.parquet(out).select("part", "n_ids").collect()
    assert max(Counter({p: sum(r.n_ids for r in files if r.part == p) for p in {r.part for r in files}}).values()) < sum(r.n_ids for r in files) / 3
    got = sorted(token_files.read_token_files(spark, out).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(d for d, _ in rows)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert Counter(r.ids_crc32 for r in got) == Counter(zlib.crc32(np.array(ids_of(library, t), "<u4").tobytes()) for _, t in rows)
    out = f"file://{tmp_path}/clashing"
    token_files.write_token_files(clashing, out)
    got = sorted((tuple(r) for r in token_files.read_token_files(spark, out).collect()), key=lambda r: r[1])
    assert got == brute_files([(r.doc_id, r.text) for r in clashing.collect()], library)


def check_packing(rows, want, capacity):
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        assert 0 < r.length <= capacity
        sequences[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    got = Counter(x for v in docs.values() for x in v)
    assert got == want
    return len(sequences)


def brute_pieces(rows, library, capacity):
    out, total = Counter(), 0
    for _, t in rows:
        ids = np.array(ids_of(library, t), "<u4")
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        out.update((k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
        total += len(ids)
    return out, total


@pytest.mark.parametrize("capacity", [1024, 100])
def test_packing(corners, documents, nothing, library, capacity):
    for df in (corners, documents, nothing):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        want, total = brute_pieces(rows, library, capacity)
        used = check_packing(packing.best_fit_packing(df, capacity=capacity).collect(), want, capacity)
        assert used <= -(-total // capacity) * 1.05 + 2


def places_of(counts, capacity):
    sequences, seen = defaultdict(list), Counter()
    for size, first, n, sequence, copies, offset in packing.plan_runs(counts, capacity):
        assert first == seen[size]
        seen[size] += n
        for k in range(n):
            sequences[sequence + k // copies].append((offset + k % copies * size, size))
    assert seen == Counter({s: n for s, n in counts.items() if n})
    for places in sequences.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at <= capacity
    return len(sequences)


def fewest(items, capacity):
    """Exact, for a few items."""
    best = [len(items)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for i in sorted({r: i for i, r in enumerate(rooms) if r >= items[k]}.values()):
            rooms[i] -= items[k]
            go(k + 1, rooms)
            rooms[i] += items[k]
        go(k + 1, [*rooms, capacity - items[k]])

    go(0, [])
    return best[0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_reduction_loses_nothing(items):
    counts = Counter(items)
    fixed, left = packing.dominant_sets(counts, 20)
    rest = sorted(Counter(left).elements(), reverse=True)
    assert sum(n for _, n in fixed) + fewest(rest, 20) == fewest(sorted(items, reverse=True), 20)
    assert places_of(counts, 20) <= fewest(sorted(items, reverse=True), 20) + 1


def test_best_fit_by_counts_equals_one_by_one():
    rng = np.random.default_rng(3)
    for _ in range(100):
        items = rng.integers(1, 50, rng.integers(0, 80)).tolist()
        rooms: list[int] = []
        for size in sorted(items, reverse=True):
            fits = [r for r in rooms if r >= size]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - size)
            else:
                rooms.append(50 - size)
        assert sum(n for _, n in packing.best_fit(dict(Counter(items)), 50)) == len(rooms)


def test_library_ids_come_back_in_the_order_of_pieces(library):  # noqa: F811
    enc = TextEncoder(default_path(), slot_bits=4)
    pieces = [" one", "\n\n", "two", " \t ", "x" * 90, "  ", " Straße", "é" * 40, " one"]
    ids, sizes = enc._library_ids(pieces)
    want = [library.encode(p, add_special_tokens=False).ids for p in pieces]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    none, nothing = enc._library_ids([])
    assert len(none) == 0 and len(nothing) == 0
