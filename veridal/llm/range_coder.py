"""Adaptive context-mixing range coder for blocks of token ids.

A block is cut into lanes, which are coded in step: step ``t`` codes the
``t``-th id of every lane with one numpy call an operation, from one model that
all lanes of the block share and that learns after every step. Every block starts
from a new model.

Model. Orders 2 and 1 each predict one id for their context, with a confidence.
Whether order 2, order 1 or neither is right is coded with a mix of three
adaptive distributions (by confidence of order 2, of order 1, and by the lane's
last two outcomes), weighted by how well each has done. What neither predicts is
coded by adaptive order-0 counts. Predictions learn after every step; the
distributions are made anew from their counts after each of the first ``EVERY``
steps, then after every ``EVERY``-th. All of it is integer arithmetic, so that any
machine decodes what another has written.

Coder. A carryless range coder with 64-bit state and 16-bit words per lane; the
words of all lanes share one stream, in the order in which the decoder asks.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"CMRC"
_HEAD = struct.Struct("<4sIIIIII")
_TOP, _BOT, _U16 = np.uint64(1 << 48), np.uint64(1 << 32), np.uint64(16)
_MOST_LANES, _LEAST_STEPS = 8192, 128
_HASH_BITS = 20
EVERY = 8
_STEP_0, _LIMIT_0, _LIMIT_FLAG = 24, 1 << 22, 1 << 14
#: Order-0 counts of 1 for every id must fit into their limit.
_MOST_IDS = _LIMIT_0


class _Model:
    """What encoder and decoder both know after every step."""

    def __init__(self, vocabulary: int, lanes: int):
        if vocabulary > _MOST_IDS:
            raise ValueError(f"ids must be below {_MOST_IDS}")
        # Predicted id and, in the lowest three bits, the confidence.
        self.table1, self.table2 = np.zeros(vocabulary, np.int32), np.zeros(1 << _HASH_BITS, np.int32)
        self.count0 = np.ones(vocabulary, np.int64)
        self.flags = [np.ones((n, 3), np.int64) for n in (16, 16, 9)]
        self.weight = np.array([21, 21, 22], np.int64)
        self.score = np.full(3, 1 << 10, np.int64)
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.history, self.flag = np.full(lanes, 8, np.int64), np.full(lanes, 2, np.int64)
        # Every joint context, as the context of each of the three distributions: (sure2, sure1, agree, history).
        joint = np.arange(8 * 8 * 2 * 9)
        history, agree, s1, s2 = joint % 9, joint // 9 % 2, joint // 18 % 8, joint // 144
        self.parts = (s2 * 2 + agree, s1 * 2 + agree, history)
        self.seen, self.literals, self.step = np.zeros(3456, np.int64), [], 0
        self.refresh()

    def refresh(self) -> None:
        mixed = np.ones((1152, 3), np.int64)
        self.single = []
        for counts, part, w in zip(self.flags, self.parts, self.weight, strict=True):
            p = (counts << 10) // counts.sum(1, keepdims=True)
            self.single.append(p)
            mixed += w * p[part]
        ends = np.cumsum(mixed, axis=1)
        self.flag_freq, self.flag_total = mixed.ravel().astype(np.uint64), ends[:, 2].astype(np.uint64)
        self.flag_first, self.flag_second = ends[:, 0].copy(), ends[:, 1].copy()
        self.flag_start = (ends - mixed).ravel().astype(np.uint64)
        self.end0 = np.cumsum(self.count0, dtype=np.int32)
        self.total0 = np.uint64(self.end0[-1])

    def predict(self, n: int) -> None:
        """Predictions for the first ``n`` lanes."""
        self.c1 = self.last[:n]
        self.c2 = (self.before[:n] * 40503 ^ self.last[:n] * 2654435761 >> 7) & ((1 << _HASH_BITS) - 1)
        self.t1, self.t2 = self.table1.take(self.c1), self.table2.take(self.c2)
        self.p1, self.p2 = self.t1 >> 3, self.t2 >> 3
        self.joint = (((self.t2 & 7) << 3 | self.t1 & 7) * 2 + (self.p1 == self.p2)) * 9 + self.history[:n]

    def outcome(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids == self.p2, 0, np.where(ids == self.p1, 1, 2))

    def learn(self, ids: np.ndarray, flag: np.ndarray, k: np.ndarray, literals: np.ndarray) -> None:
        """``k``: the joint context and ``flag`` in one number."""
        n = len(ids)
        self.seen += np.bincount(k, minlength=3456)
        self.literals.append(literals)
        new = (ids << 3).astype(np.int32)
        for table, c, old, p in ((self.table1, self.c1, self.t1, self.p1), (self.table2, self.c2, self.t2, self.p2)):
            s = old & 7
            wrong = np.where(s > 0, old - s + (s >> 1), new)
            table[c] = np.where(p == ids, old + (s < 7), wrong)
        self.history[:n], self.flag[:n] = self.flag[:n] * 3 + flag, flag
        self.before[:n], self.last[:n] = self.last[:n], ids
        self.step += 1
        if self.step < EVERY or self.step % EVERY == 0:
            self.add_up()

    def add_up(self) -> None:
        """Add what was seen since the last time to the counts."""
        seen = self.seen.reshape(8, 8, 2, 9, 3)
        sums = (seen.sum((1, 3)).reshape(16, 3), seen.sum((0, 3)).reshape(16, 3), seen.sum((0, 1, 2)))
        for k, (counts, new, single) in enumerate(zip(self.flags, sums, self.single, strict=True)):
            self.score[k] += (single * new).sum()
            counts += new
            while (big := counts.sum(1) > _LIMIT_FLAG).any():
                counts[big] = (counts[big] + 1) >> 1
        self.weight = 1 + self.score * 61 // self.score.sum()
        while self.score.sum() > 1 << 28:
            self.score = 1 + (self.score >> 1)
        self.count0 += _STEP_0 * np.bincount(np.concatenate(self.literals), minlength=len(self.count0))
        while self.count0.sum() > _LIMIT_0:
            self.count0 = (self.count0 + 1) >> 1
        self.seen[:] = 0
        self.literals = []
        self.refresh()


def _shape(n: int) -> tuple[int, int]:
    """Lanes and steps of a block of ``n`` ids; only the last lane may be short."""
    if not n:
        return 0, 0
    lanes = min(_MOST_LANES, max(1, n // _LEAST_STEPS))
    steps = -(-n // lanes)
    return -(-n // steps), steps


def _grid(ids: np.ndarray, lanes: int, steps: int) -> np.ndarray:
    padded = np.zeros(lanes * steps, np.int64)
    padded[: len(ids)] = ids
    return np.ascontiguousarray(padded.reshape(lanes, steps).T)


def _full(low: np.ndarray, rng: np.ndarray) -> np.ndarray:
    """Places of the lanes that must give up a word."""
    return np.flatnonzero(((low ^ (low + rng)) < _TOP) | (rng < _BOT))


class _Writer:
    def __init__(self, lanes: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.all = np.arange(lanes)
        self.lanes: list[np.ndarray] = []
        self.words: list[np.ndarray] = []

    def put(self, at: np.ndarray | slice, start: np.ndarray, freq: np.ndarray, total: np.ndarray | np.uint64) -> None:
        r = self.range[at] // total
        low, rng = self.low[at] + r * start, r * freq
        go = _full(low, rng)
        while len(go):
            l, g = low[go], rng[go]
            g = np.where((l ^ (l + g)) < _TOP, g, (~l + np.uint64(1)) & (_BOT - np.uint64(1)))
            self.lanes.append(go if isinstance(at, slice) else at[go])
            self.words.append((l >> np.uint64(48)).astype(np.uint16))
            l, g = l << _U16, g << _U16
            low[go], rng[go] = l, g
            go = go[_full(l, g)]
        self.low[at], self.range[at] = low, rng

    def stream(self) -> np.ndarray:
        """All words: four of each lane, then each when the decoder asks."""
        n = len(self.low)
        asked = np.concatenate(self.lanes) if self.lanes else np.zeros(0, np.int64)
        tail = [(self.low >> np.uint64(48 - 16 * k)).astype(np.uint16) for k in range(4)]
        lane = np.concatenate([asked, np.tile(self.all, 4)])
        word = np.concatenate([*self.words, *tail]) if n else np.zeros(0, np.uint16)
        order = np.argsort(lane.astype(np.uint16), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        first = np.searchsorted(lane[order], self.all)
        heads = (first[None, :] + np.arange(4)[:, None]).ravel()
        return word[order][np.concatenate([heads, place[: len(asked)] + 4])]


class _Reader:
    def __init__(self, lanes: int, words: np.ndarray):
        self.words, self.next = words, 4 * lanes
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.code = np.zeros(lanes, np.uint64)
        for k in range(4):
            self.code = self.code << _U16 | words[k * lanes : (k + 1) * lanes].astype(np.uint64)

    def value(self, at: np.ndarray | slice, total: np.ndarray | np.uint64) -> np.ndarray:
        self.r = self.range[at] // total
        return np.minimum((self.code[at] - self.low[at]) // self.r, total - np.uint64(1)).astype(np.int64)

    def took(self, at: np.ndarray | slice, start: np.ndarray, freq: np.ndarray) -> None:
        low, rng, code = self.low[at] + self.r * start, self.r * freq, self.code[at]
        go = _full(low, rng)
        while len(go):
            l, g = low[go], rng[go]
            g = np.where((l ^ (l + g)) < _TOP, g, (~l + np.uint64(1)) & (_BOT - np.uint64(1)))
            new = self.words[self.next : self.next + len(go)].astype(np.uint64)
            self.next += len(go)
            l, g = l << _U16, g << _U16
            low[go], rng[go], code[go] = l, g, code[go] << _U16 | new
            go = go[_full(l, g)]
        self.low[at], self.range[at], self.code[at] = low, rng, code


def encode_block(ids: np.ndarray, vocabulary: int) -> bytes:
    """A block of its own: header, words, both under checksums."""
    lanes, steps = _shape(len(ids))
    grid, out, model = _grid(ids, lanes, steps), _Writer(lanes), _Model(vocabulary, lanes)
    for t in range(steps):
        n = lanes if (lanes - 1) * steps + t < len(ids) else lanes - 1
        now = grid[t, :n]
        model.predict(n)
        flag = model.outcome(now)
        k = model.joint * 3 + flag
        out.put(slice(n), model.flag_start.take(k), model.flag_freq.take(k), model.flag_total.take(model.joint))
        miss = np.flatnonzero(flag == 2)
        literal = now[miss]
        freq = model.count0.take(literal)
        out.put(miss, (model.end0.take(literal) - freq).astype(np.uint64), freq.astype(np.uint64), model.total0)
        model.learn(now, flag, k, literal)
    words = out.stream().astype("<u2").tobytes()
    plain = np.ascontiguousarray(ids, "<u4").tobytes()
    return _HEAD.pack(MAGIC, len(ids), lanes, steps, vocabulary, zlib.crc32(plain), zlib.crc32(words)) + words


def decode_block(block: bytes) -> np.ndarray:
    """The ids of a block; raises ValueError where a checksum does not hold."""
    magic, count, lanes, steps, vocabulary, crc_ids, crc_words = _HEAD.unpack_from(block)
    if magic != MAGIC or zlib.crc32(raw := block[_HEAD.size :]) != crc_words:
        raise ValueError("damaged block")
    source, model = _Reader(lanes, np.frombuffer(raw, "<u2")), _Model(vocabulary, lanes)
    grid = np.zeros((steps, lanes), np.int64)
    for t in range(steps):
        n = lanes if (lanes - 1) * steps + t < count else lanes - 1
        model.predict(n)
        value = source.value(slice(n), model.flag_total.take(model.joint))
        flag = (value >= model.flag_first.take(model.joint)).astype(np.int64)
        flag += value >= model.flag_second.take(model.joint)
        k = model.joint * 3 + flag
        source.took(slice(n), model.flag_start.take(k), model.flag_freq.take(k))
        miss = np.flatnonzero(flag == 2)
        # Searched for in order, which is faster; the lowest 13 bits tell whose value it is.
        sought = np.sort(source.value(miss, model.total0) << 13 | np.arange(len(miss)))
        literal = np.empty(len(miss), np.int64)
        literal[sought & (_MOST_LANES - 1)] = np.searchsorted(model.end0, (sought >> 13).astype(np.int32), side="right")
        freq = model.count0.take(literal)
        source.took(miss, (model.end0.take(literal) - freq).astype(np.uint64), freq.astype(np.uint64))
        now = np.where(flag == 0, model.p2, model.p1)
        now[miss] = literal
        grid[t, :n] = now
        model.learn(now, flag, k, literal)
    ids = np.ascontiguousarray(grid.T).ravel()[:count].astype("<u4")
    if zlib.crc32(ids.tobytes()) != crc_ids:
        raise ValueError("damaged block")
    return ids
