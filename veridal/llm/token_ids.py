"""Ids of a public tokenizer, exact and fast on one thread.

The byte-level pre-tokenizer never lets a token reach over a boundary between
white space and what follows it, apart from one leading space. A text can so be
cut into pieces (a space, if there is one, and a run of other characters; or
white space) whose ids, put end to end, are the ids of the text. Pieces are cut
and named by two 64-bit hashes, compared in full, with array operations; the
library encodes a piece when its names are not in a table of fixed size, and every
piece of more than 64 bytes. Texts that hold a special token's string or white
space beyond ASCII go to the library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

from veridal.llm.shingles import LONG, byte_hashes

_ODD_SPACE = re.compile("[\x85\xa0  -     　]")
_GROUP = 1 << 20
_SLOT_BITS = 21
_WIDTH = 8
_SEEDS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_AFTER_LETTER = ~_LETTER & ~_GAP & (np.arange(256) < 128)


def piece_starts(a: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where pieces start in bytes ``a`` of texts put end to end (none is empty).

    A run of white space is one piece; if a word follows, the run's last character
    is cut off, and goes with the word if it is a space. Within a word a piece
    starts where an ASCII letter is followed by another kind of ASCII character,
    as runs of letters are tokens of their own.
    """
    gap = _GAP.take(a)
    first = np.zeros(len(a), bool)
    first[text_starts] = True
    before = np.concatenate([[False], gap[:-1]]) & ~first
    word = ~gap & (before | first)
    start = gap & ~before
    alone = word & ~(before & np.concatenate([[False], a[:-1] == 0x20]))
    last = np.concatenate([word[1:] & ~first[1:], [False]]) & gap
    inner = np.concatenate([[False], _LETTER.take(a[:-1])]) & _AFTER_LETTER.take(a)
    return np.flatnonzero(start | alone | last | inner)


class TextEncoder:
    """Encodes texts to ids, packed as ``width`` each.

    The table has ``2 ** slot_bits`` slots; a piece's name fixes its slot, and the
    latest piece of a slot stays. Pieces of more than ``_WIDTH`` ids are not kept.
    """

    def __init__(self, path: str, slot_bits: int = _SLOT_BITS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.width = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.newline = self.library.encode("\n", add_special_tokens=False).ids
        self.mask = np.uint64((1 << slot_bits) - 1)
        # Both names and the packed ids of a slot lie side by side, so that they are fetched at once.
        self.table = np.zeros((1 << slot_bits, 2 + _WIDTH * self.width.itemsize // 8), np.uint64)
        self.lengths = np.zeros(1 << slot_bits, np.uint8)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.width) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _library_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces end to end, and how many each has; words go in one call for many, as a line break before one is a token of its own."""
        is_word = np.array([len(self.newline) == 1 and not p.isspace() for p in pieces], bool)
        words, others = np.flatnonzero(is_word).tolist(), np.flatnonzero(~is_word).tolist()
        alone = self._whole([pieces[i] for i in others])
        joined = self._whole(["\n".join([pieces[i] for i in words[k : k + 256]] + [""]) for k in range(0, len(words), 256)])
        ids = np.concatenate([np.zeros(0, self.width), *joined])
        is_end = ids == self.newline[0]
        ends = np.flatnonzero(is_end)
        if len(ends) != len(words):
            raise ValueError("a piece has a line break's id")
        sizes = np.concatenate([np.diff(ends, prepend=-1) - 1, np.array([len(a) for a in alone], np.int64)])
        flat = np.concatenate([ids[~is_end], *alone])
        if others:  # back to the order of the pieces
            order = np.argsort(words + others)
            at = (np.cumsum(sizes) - sizes)[order]
            sizes = sizes[order]
            flat = flat[np.repeat(at - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))]
        return flat, sizes

    def _group(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of texts that are not empty."""
        raw = b"".join(texts)
        a = np.frombuffer(raw, np.uint8)
        bounds = np.cumsum([0, *map(len, texts)])
        starts = piece_starts(a, bounds[:-1])
        ends = np.append(starts[1:], len(a))
        names = byte_hashes(raw, starts, ends, _SEEDS)
        slot = (names[0] & self.mask).astype(np.int64)
        held = self.table.take(slot, axis=0)
        hit = (held[:, 0] == names[0]) & (held[:, 1] == names[1]) & (ends - starts <= LONG)
        ids, lengths = held[:, 2:].view(self.width), self.lengths.take(slot)
        miss = np.flatnonzero(~hit)
        long: dict[int, np.ndarray] = {}
        if len(miss):
            big = ends[miss] - starts[miss] > LONG
            order = np.lexsort((names[1][miss], names[0][miss]))
            a0, a1 = names[0][miss][order], names[1][miss][order]
            fresh = np.concatenate([[True], (a0[1:] != a0[:-1]) | (a1[1:] != a1[:-1])]) | big[order]
            which = np.empty(len(miss), np.int64)
            which[order] = np.cumsum(fresh) - 1
            at = miss[order[fresh]]
            found, sizes = self._library_ids([raw[s:e].decode("utf-8", "surrogatepass") for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            rows = np.zeros((len(sizes), _WIDTH), self.width)
            short = sizes <= _WIDTH
            kept = short & (ends[at] - starts[at] <= LONG)
            rows[short[:, None] & (np.arange(_WIDTH) < sizes[:, None])] = found[np.repeat(short, sizes)]
            put, into = at[kept], slot[at[kept]]
            self.table[into] = np.concatenate([names[0][put, None], names[1][put, None], rows[kept].view(np.uint64)], axis=1)
            self.lengths[into] = sizes[kept]
            ids[miss], lengths[miss] = rows[which], np.where(short, sizes, 0)[which]
            after, beyond = np.cumsum(sizes), np.flatnonzero(~short[which])
            long = {i: found[after[w] - sizes[w] : after[w]] for i, w in zip(miss[beyond].tolist(), which[beyond].tolist(), strict=True)}
        flat = ids[np.arange(_WIDTH, dtype=np.uint8) < lengths[:, None]]
        lengths = lengths.astype(np.int64)
        place = np.concatenate([[0], np.cumsum(lengths)])
        if long:
            where = sorted(long)
            parts, done = [], 0
            for i in where:
                parts += [flat[done : place[i]], long[i]]
                done = place[i]
                lengths[i] = len(long[i])
            flat = np.concatenate([*parts, flat[done:]])
            place = np.concatenate([[0], np.cumsum(lengths)])
        cut = place[np.searchsorted(starts, bounds)]
        return [flat[x:y].tobytes() for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text; null counts as empty."""
        out: list[bytes] = [b""] * len(texts)
        waiting: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> None:
            for (i, _), packed in zip(waiting, self._group([t for _, t in waiting]) if waiting else [], strict=True):
                out[i] += packed

        for i, text in enumerate(texts):
            if not text:
                continue
            if any(s in text for s in self.special) or not text.isascii() and _ODD_SPACE.search(text):
                out[i] = self._whole([text])[0].tobytes()
                continue
            for part in _parts(text.encode("utf-8", "surrogatepass")):
                waiting.append((i, part))
                size += len(part)
                if size >= _GROUP:
                    flush()
                    waiting, size = [], 0
        flush()
        return out

    def ids(self, packed: bytes) -> np.ndarray:
        return np.frombuffer(packed, self.width).astype("<u4")


def _parts(raw: bytes) -> list[bytes]:
    """A long text in parts of about ``_GROUP`` bytes, cut before a single space between words."""
    out, at = [], 0
    while len(raw) - at > 2 * _GROUP and (m := _BETWEEN.search(raw, at + _GROUP)):
        out.append(raw[at : m.start() + 1])
        at = m.start() + 1
    return [*out, raw[at:]]


_BETWEEN = re.compile(rb"[^\t-\r ] [^\t-\r ]")
_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """The encoder of this worker process; its table outlives the task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
