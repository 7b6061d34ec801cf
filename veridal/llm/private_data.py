"""PII: fixed rules, and spans that a character-level BiLSTM-CRF adds.

The rules find e-mail addresses, IP addresses, card numbers and telephone numbers
by their form, in time that follows the text's length. Their spans in a sample of
about ``SAMPLE`` documents, chosen by a hash, are the labels: at most ``SPANS_EACH``
of each kind and as many windows without any. The tagger learns from ``WINDOWS``
windows that are made of them, as many of each kind, with other digits and letters
put in for those of the span, and a third of the e-mail addresses and telephone
numbers rewritten in ways that the rules do not know (spelled out; without the
country code), so that it learns shape and context rather than the rules.

A fifth of the spans is held out. ``train`` measures how many of these, changed and
rewritten like the others, the tagger finds in their places; under ``LEAST_RECALL``
it fits once more from another start, and the better fit stays, with
a warning if that is still under.

A whole text is covered by windows of ``WINDOW`` characters that overlap by
``OVERLAP``; all are decoded. A span counts from the window in whose middle part
it starts; spans of a kind that touch or overlap over a window's end are joined.
A joined span stays if it has its kind's necessary properties (digits, checksum)
and no rule's span touches it. Rules' spans always stay.

Defined results: null counts as empty, without spans; repeated rows are treated
one by one; texts of any length are covered whole; offsets are code points, ends
exclusive; an empty table gives an empty table; columns besides id and text are not
read, so none can clash; without any span to learn from, the tagger adds none.
"""

from __future__ import annotations

import hashlib
import math
import re
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridal.llm.char_tagger import KINDS, Tagger, best_tags, char_codes, fit, tag_scores
from veridal.llm.store import arrow_map, cut, in_slices

WINDOW, OVERLAP = 256, 48
TRAIN_WINDOW = 128
SAMPLE, SPANS_EACH, WINDOWS = 20_000, 300, 1024
LEAST_RECALL, FITS, HELD_OUT_OF = 0.8, 2, 5
ROUNDS, BATCH, RATE, SEED = 10, 64, 0.03, 7
_LANES = 1024

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# The same matches as without the look behind and the possessive repeats, which keep a long run of digits from being read again from each of them.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
#: What may stand before an @.
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: The characters of a span that the tagger may add, by kind.
_SHAPE = (re.compile(r"[A-Za-z0-9._%+@-]+( [A-Za-z0-9._%+@-]+)*"), re.compile(r"[0-9.]+"), re.compile(r"[0-9][0-9 -]*[0-9]"), re.compile(r"[+(0-9][0-9 ().+-]*[0-9]"))

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _in_a_byte(digits: str) -> bool:
    """Whether a number of any length is at most 255."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def has_properties(kind: int, text: str, a: int, b: int) -> bool:
    """What a span must have to be of its kind, whoever finds it: it stands alone, and its form fits."""
    found = text[a:b]
    if text[a - 1 : a].isalnum() or text[b : b + 1].isalnum() or not _SHAPE[kind].fullmatch(found):
        return False
    digits = _NOT_DIGIT.sub("", found)
    if kind == 0:
        return bool(re.search(r"@|\bat\b", found)) and bool(re.search(r"\.|\bdot\b", found))
    if kind == 1:
        parts = re.findall("[0-9]+", found)
        return len(parts) == 4 and all(map(_in_a_byte, parts))
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15 and (found[0] == "+" or len(found.strip("().- ")) > len(digits))


def _emails(text: str) -> Iterator[Span]:
    """Matches around each @: the same as a search from the left, without retries at every letter."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _EMAIL.match(text, start)):
            yield m.start(), 0, m.end()
            done = m.end()
            at = text.find("@", max(done, at + 1))
        else:
            at = text.find("@", at + 1)


def rule_spans(text: str) -> list[Span]:
    """Leftmost matches that do not overlap within their kind; failing ones are dropped."""
    out = list(_emails(text))
    for m in _IP.finditer(text):
        if all(map(_in_a_byte, m.group().split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def windows_of(length: int) -> list[int]:
    """Starts of the windows that cover a text."""
    return list(range(0, max(1, length - OVERLAP), WINDOW - OVERLAP))


def tag_spans(tags: np.ndarray) -> list[Span]:
    """Spans of one window's tags."""
    out: list[Span] = []
    start, kind = -1, -1
    for i, t in enumerate([*tags.tolist(), 0]):
        if start >= 0 and t != 2 + 2 * kind:
            out.append((start, kind, i))
            start = -1
        if t % 2 == 1:
            start, kind = i, t // 2
    return out


def found_spans(texts: list[str], model: Tagger) -> list[list[Span]]:
    """What the tagger finds in each text, reconciled over its windows."""
    codes = [char_codes(t) for t in texts]
    places = [(i, a) for i, c in enumerate(codes) for a in windows_of(len(c)) if len(c)]
    everything = np.concatenate([*codes, np.zeros(WINDOW, np.uint8)])
    firsts = np.cumsum([0, *map(len, codes)])
    raw: list[list[Span]] = [[] for _ in texts]
    for k in range(0, len(places), _LANES):
        some = places[k : k + _LANES]
        text_of, start = np.array(some).T
        at = start[None, :] + np.arange(WINDOW)[:, None]
        lengths = np.array([len(codes[i]) for i in text_of])
        grid = np.where(at < lengths, everything[np.minimum(at + firsts[text_of], len(everything) - 1)], 0)
        scores = tag_scores(grid, model)
        tags = best_tags(scores, model)
        for g in np.flatnonzero(tags.any(0)).tolist():
            i, base = int(text_of[g]), int(start[g])
            low = 0 if base == 0 else OVERLAP // 2
            high = WINDOW if base + WINDOW >= lengths[g] else WINDOW - OVERLAP // 2
            raw[i] += [(base + a, kind, min(base + b, int(lengths[g]))) for a, kind, b in tag_spans(tags[:, g]) if low <= a < high]
    out = []
    for text, spans in zip(texts, raw, strict=True):
        merged: list[Span] = []
        for a, kind, b in sorted(spans):
            if merged and merged[-1][1] == kind and a <= merged[-1][2]:
                merged[-1] = (merged[-1][0], kind, max(b, merged[-1][2]))
            else:
                merged.append((a, kind, b))
        trimmed = []
        for a, kind, b in merged:
            found = text[a:b]
            a, b = a + len(found) - len(found.lstrip()), b - (len(found) - len(found.rstrip()))
            if a < b and has_properties(kind, text, a, b):
                trimmed.append((a, kind, b))
        out.append(trimmed)
    return out


def all_spans(texts: list[str], model: Tagger | None) -> list[tuple[list[Span], list[Span]]]:
    """Rules' spans and all spans of each text."""
    base = [rule_spans(t) for t in texts]
    extra = found_spans(texts, model) if model else [[] for _ in texts]
    out = []
    for mine, more in zip(base, extra, strict=True):
        taken = np.array([(a, b) for a, _, b in mine] or [(0, 0)])
        out.append((mine, sorted(mine + [s for s in more if not ((taken[:, 0] < s[2]) & (s[0] < taken[:, 1])).any()])))
    return out


def spans_in_place(text: str, key: int) -> list[tuple[int, int, str, str, str]]:
    """``(key, kind, before, found, after)`` of one span of each kind, alone in its window, and of one window without any (kind -1)."""
    rng, spans, out = np.random.default_rng(key & 0xFFFFFFFF), rule_spans(text), []
    for kind in range(len(KINDS)):
        mine = [s for s in spans if s[1] == kind and s[2] - s[0] < TRAIN_WINDOW // 2]
        if mine:
            a, _, b = mine[int(rng.integers(len(mine)))]
            low = max([0, a - TRAIN_WINDOW, *(e for _, _, e in spans if e <= a)])
            high = min([b + TRAIN_WINDOW, *(x for x, _, _ in spans if x >= b)])
            if not any(x < b and a < e for x, k, e in spans if (x, k, e) != (a, kind, b)):
                out.append((key, kind, text[low:a], text[a:b], text[b:high]))
    free = int(rng.integers(0, max(1, len(text) - TRAIN_WINDOW)))
    if not any(a < free + TRAIN_WINDOW and free < b for a, _, b in spans):
        out.append((key, -1, "", "", text[free : free + TRAIN_WINDOW]))
    return out


def changed(found: str, kind: int, rng: np.random.Generator) -> str:
    """A span of the same kind: other digits and letters, and at times a form that the rules do not find.

    It need not pass the checks on numbers, which the tagger does not learn.
    """
    if kind == 1:
        found = ".".join(str(int(x)) for x in rng.integers(0, 256, 4))
    else:
        made = rng.integers(0, 26, len(found)).tolist()
        found = "".join(chr(ord("0") + m % 10) if c.isdigit() else chr(ord("a") + m) if kind == 0 and "a" <= c <= "z" and m % 3 else c for c, m in zip(found, made, strict=True))
    if kind == 0 and rng.random() < 1 / 3:
        return found.replace("@", " at ").replace(".", " dot ")
    if kind == 3 and rng.random() < 1 / 3 and " " in found:
        return found.split(" ", 1)[1]
    return found


def made_windows(places: list[tuple[int, str, str, str]], n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and tags of ``n`` windows, dealt evenly over kinds and over the places of a kind."""
    rng = np.random.default_rng(seed)
    by_kind = [[p for p in places if p[0] == k] for k in range(-1, len(KINDS))]
    by_kind = [x for x in by_kind if x]
    codes, tags = np.zeros((n, TRAIN_WINDOW), np.uint8), np.zeros((n, TRAIN_WINDOW), np.uint8)
    for row in range(n if by_kind else 0):
        some = by_kind[row % len(by_kind)]
        kind, before, found, after = some[row // len(by_kind) % len(some)]
        if kind < 0:
            piece = char_codes(after)[:TRAIN_WINDOW]
        else:
            new = changed(found, kind, rng)
            at = min(len(before), int(rng.integers(0, max(1, TRAIN_WINDOW - len(new)))))
            piece = char_codes(before[len(before) - at :] + new + after)[:TRAIN_WINDOW]
            tags[row, at : at + len(new)] = 2 + 2 * kind
            tags[row, at] = 1 + 2 * kind
        codes[row, : len(piece)] = piece
    return codes, tags


def recall_of(model: Tagger, codes: np.ndarray, tags: np.ndarray) -> float:
    """The share of tagged spans that the model finds to the character."""
    best = best_tags(tag_scores(np.ascontiguousarray(codes.T), model), model).T
    want = [(i, s) for i in range(len(tags)) for s in tag_spans(tags[i])]
    found = {(i, s) for i in range(len(tags)) for s in tag_spans(best[i])}
    return sum(w in found for w in want) / max(1, len(want))


def labelled_places(docs: DataFrame, sample: int = SAMPLE, each: int = SPANS_EACH) -> list[tuple[int, int, str, str, str]]:
    """``spans_in_place`` of about ``sample`` documents, at most ``each`` of a kind, in the order of a hash."""
    share = min(1.0, sample / max(1, docs.count()))
    key = F.xxhash64("id", "text")
    some = docs.select(key.alias("key"), "text").filter(F.pmod("key", F.lit(1 << 20)) < math.ceil(share * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string())
        for some in in_slices(batches, "text"):
            rows = [r for k, t in zip(some.column("key").to_pylist(), some.column("text").to_pylist(), strict=True) for r in spans_in_place(t or "", k)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["key", "kind", "before", "found", "after"])

    places = cut(arrow_map(some, run, "key long, kind int, before string, found string, after string").distinct())
    by_hash = [places.filter(F.col("kind") == k).orderBy("key", "before", "found", "after").limit(each) for k in range(-1, len(KINDS))]
    return [tuple(r) for df in by_hash for r in df.collect()]


def train(docs: DataFrame) -> Tagger | None:
    """Fit on windows made of the rules' spans in a sample of ``docs`` (``id``, ``text``); ``recall`` is that on held-out spans."""
    places = labelled_places(docs)
    if not any(p[1] >= 0 for p in places):
        return None
    apart = [p[1:] for p in places if p[0] % HELD_OUT_OF == 0]
    seen = [p[1:] for p in places if p[0] % HELD_OUT_OF]
    if not any(p[0] >= 0 for p in apart) or not any(p[0] >= 0 for p in seen):  # too few to hold any out
        apart = seen = [p[1:] for p in places]
    codes, tags = made_windows(seen, WINDOWS, SEED)
    check = made_windows(apart, WINDOWS // 4, SEED + 1)
    best: Tagger | None = None
    for k in range(FITS):
        model = fit(codes, tags, ROUNDS, BATCH, RATE, SEED + k)
        model.recall = recall_of(model, *check)
        best = model if best is None or model.recall > best.recall else best
        if best.recall >= LEAST_RECALL:
            return best
    warnings.warn(f"the tagger finds {best.recall:.0%} of held-out spans only", stacklevel=2)
    return best


def find_private(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, numbers of rules' spans by kind, their digest, all spans, and how many the tagger added."""
    table = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(train(table))
    names = ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in in_slices(batches, "text", 2_000_000):
            pairs = all_spans([t or "" for t in some.column("text").to_pylist()], sent.value)
            counts = [pa.array([sum(s[1] == k for s in base) for base, _ in pairs], pa.int64()) for k in range(len(KINDS))]
            added = pa.array([len(every) - len(base) for base, every in pairs], pa.int64())
            sha = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in pairs])
            yield pa.RecordBatch.from_arrays([some.column("id"), *counts, sha, pa.array([joined(every) for _, every in pairs], pa.string()), added], names=names)

    kind = table.dtypes[0][1]
    return arrow_map(table, run, f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long").withColumnRenamed("id", id_col)


def masked(text: str, spans: list[Span]) -> str:
    """``text`` with each span's characters replaced by its kind's name in brackets."""
    out, at = [], 0
    for a, kind, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind]}]"]
            at = b
    return "".join([*out, text[at:]])
