"""Sets of five-word shingles as 64-bit hashes, computed on whole slices of text.

A-Z is lower-cased; words are runs of anything but ASCII white space. A word of up
to 64 bytes is folded in blocks of 8 by a bijection of 64-bit numbers, so words of
one block that are equally long never share a hash, and others do by chance only
(2^-64); longer words, which are rare, are hashed by BLAKE2b. Only those are
touched by Python code.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np

SIZE = 5
#: Bytes of a word or piece beyond which it gets a cryptographic hash.
LONG = 64
_CHUNK = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_FIRST_GAP = re.compile(rb"[\x20\x09-\x0D]")
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads nearby ones."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def byte_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray, seeds: tuple[int, ...] = (0,)) -> list[np.ndarray]:
    """For each seed, 64-bit hashes of the runs ``raw[start:end]``."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = np.frombuffer(raw, np.uint8)
    eights = np.ndarray((len(raw) + 1,), "<u8", padded, 0, (1,))
    sizes = ends - starts
    block = eights[starts] & _MASKS[np.minimum(sizes, 8)]
    length = sizes.astype(np.uint64) * _P
    out = [mix(block ^ (length + np.uint64(seed))) for seed in seeds]
    left = np.flatnonzero((sizes > 8) & (sizes <= LONG))
    at = 8
    while len(left):
        block = eights[starts[left] + at] & _MASKS[np.minimum(sizes[left] - at, 8)]
        for h in out:
            h[left] = mix((h[left] ^ block) + _P)
        at += 8
        left = left[sizes[left] > at]
    long = np.flatnonzero(sizes > LONG)
    for i, s, e in zip(long.tolist(), starts[long].tolist(), ends[long].tolist(), strict=True):
        digest = hashlib.blake2b(raw[s:e], digest_size=8 * len(seeds)).digest()
        for k, h in enumerate(out):
            h[i] = int.from_bytes(digest[8 * k : 8 * k + 8], "little")
    return out


def _hash_words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word."""
    inside = np.concatenate([[False], ~_GAP[np.frombuffer(raw, np.uint8)], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    return byte_hashes(raw, starts, ends)[0], starts, ends


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_hash_words`` in chunks that end between words, so that memory does not follow a long text."""
    parts, at = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    while at < len(raw):
        gap = _FIRST_GAP.search(raw, at + _CHUNK)
        end = gap.start() if gap else len(raw)
        h, s, e = _hash_words(raw[at:end])
        parts.append((h, s + at, e + at))
        at = end
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _fold(parts: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(parts[0]), len(parts), np.uint64)
    for p in parts:
        h = (h ^ (h >> np.uint64(29))) * _P + p
    return mix(h)


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """The distinct shingles of each text, ascending; a text of 1 to 4 words is one shingle."""
    raw = [(t or b"").lower() for t in texts]
    hashes, starts, _ = word_hashes(b"\n".join(raw))
    firsts = np.cumsum([0, *(len(t) + 1 for t in raw)])
    at = np.searchsorted(starts, firsts)
    full = _fold([hashes[k : len(hashes) - SIZE + 1 + k] for k in range(SIZE)]) if len(hashes) >= SIZE else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= SIZE:
            h = np.sort(full[a : b - SIZE + 1])
            out.append(h[np.concatenate([[True], h[1:] != h[:-1]])])
        elif b > a:
            out.append(_fold([hashes[k : k + 1] for k in range(a, b)]))
        else:
            out.append(hashes[:0])
    return out


def set_id(shingles: np.ndarray) -> int:
    """64 bits that name a set."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)
