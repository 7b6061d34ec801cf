"""Quality classifier: a linear-chain conditional random field over lines.

Every line has features of its own and of the lines beside it; two states, good
and bad, are linked along the text. Labels are known for documents, so every
line of a labelled document carries its label in training. A document's score is
the mean of its lines' marginal probabilities of being good, from exact forward
and backward recursions, weighted by the lines' words (and one, so that blank
lines count a little).

The model is fitted on at most ``most_documents`` labelled rows of at most
``most_bytes`` each, in the order of a hash of their ids and as far as they have
``most_lines`` lines together, so that the features in the driver are bounded too
(176 bytes a line); everything else covers all rows and whole texts.

Defined results: null counts as empty; an empty text is one blank line and gets
that line's marginal; without labels of both kinds every score is the labels'
smoothed share of good ones; labels that contradict each other for an id are not
used; rows with equal ids are scored one by one, and of these the text of the least
hash is learnt from; ids of any type are compared as text; texts of any length are
scored whole; a score equal to the threshold is good; an empty table gives an empty table;
further columns pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridal.llm.shingles import mix, word_hashes
from veridal.llm.store import arrow_map, in_slices

THRESHOLD = 0.7
MOST_DOCUMENTS = 4000
MOST_BYTES = 20_000
MOST_LINES = 500_000
FOLDS, HELD_OUT = 4, 2
ROUNDS, RATE, RIDGE = 200, 0.2, 3e-5
FIT_TASKS = 16

_SYMBOL, _UPPER, _DIGIT, _MARK, _GAP = range(5)
_KIND = np.full(256, -1, np.int8)
_KIND[list(b"#*$%&|<>")] = _SYMBOL
_KIND[ord("A") : ord("Z") + 1] = _UPPER
_KIND[ord("0") : ord("9") + 1] = _DIGIT
_KIND[list(b"!?")] = _MARK
_KIND[[0x20, *range(0x09, 0x0E)]] = _GAP
OWN = 10
BESIDE = (2, 3, 4, 5, 6, 9)
FEATURES = OWN + 2 * len(BESIDE)


@dataclass(frozen=True)
class Crf:
    """Weights of the good state's features, and scores of starts and steps (bad 0, good 1)."""

    weights: np.ndarray
    start: np.ndarray
    step: np.ndarray
    #: Where set, every score is this.
    constant: float | None = None


def line_features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their numbers of words, and each text's number of lines."""
    raw = [t or b"" for t in texts]
    joined = b"\n".join(raw)
    a = np.frombuffer(joined, np.uint8)
    breaks = np.flatnonzero(a == 0x0A)
    starts = np.concatenate([[0], breaks + 1])
    ends = np.concatenate([breaks, [len(a)]])
    lines = np.array([t.count(b"\n") + 1 for t in raw], np.int64)
    size = np.maximum(ends - starts, 1)
    kind = _KIND[a]

    def count(k: int) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(kind == k)])
        return sums[ends] - sums[starts]

    hashes, at, _ = word_hashes(joined)
    first, last = np.searchsorted(at, starts), np.searchsorted(at, ends)
    n_words = last - first
    line_of = np.repeat(np.arange(len(starts)), n_words)
    own = mix(hashes + line_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(own)
    new = np.concatenate([[True], own[order][1:] != own[order][:-1]]) if len(own) else np.zeros(0, bool)
    distinct = np.bincount(line_of[order][new], minlength=len(starts))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes + np.arange(len(hashes), dtype=np.uint64) - np.repeat(first, n_words).astype(np.uint64)), dtype=np.uint64)])
    text_of = np.repeat(np.arange(len(raw)), lines)
    whole = mix(sums[last] - sums[first] + text_of.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    order = np.lexsort((np.arange(len(whole)), whole))
    repeat = np.zeros(len(whole), bool)
    repeat[order[1:]] = whole[order[1:]] == whole[order[:-1]]
    some = np.maximum(n_words, 1)
    filled = size - np.minimum(size, count(_GAP))
    x = np.zeros((len(starts), FEATURES), np.float64)
    x[:, 0] = 1
    x[:, 1] = np.log1p(n_words) / 5
    x[:, 2] = np.minimum(count(_SYMBOL) / some * 3, 1)
    x[:, 3] = count(_UPPER) / np.maximum(filled, 1) * (n_words > 3)
    x[:, 4] = np.minimum(count(_MARK) / some, 2) / 2
    x[:, 5] = np.maximum(1 - distinct / some - 0.5, 0) * 2 * (n_words > 0)
    x[:, 6] = repeat & (n_words > 0)
    x[:, 7] = count(_DIGIT) / np.maximum(filled, 1)
    x[:, 8] = n_words == 0
    echo = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (line_of[1:] == line_of[:-1])])[: len(hashes)]
    x[:, 9] = np.minimum(np.bincount(line_of, echo, len(starts)) / some * 2, 1)
    firsts = np.concatenate([[0], np.cumsum(lines)[:-1]])
    lasts = np.cumsum(lines) - 1
    beside = x[:, BESIDE]
    k = len(BESIDE)
    x[1:, OWN : OWN + k] = beside[:-1]
    x[firsts, OWN : OWN + k] = 0
    x[:-1, OWN + k :] = beside[1:]
    x[lasts, OWN + k :] = 0
    return x, n_words, lines


def marginals(score: np.ndarray, lines: np.ndarray, crf: Crf) -> tuple[np.ndarray, np.ndarray]:
    """Each line's probabilities (bad, good), and the sums of step probabilities.

    ``score``: the good state's score of every line. All texts are run in step,
    longest first, so that a step touches only the texts that have it.
    """
    order = np.argsort(-lines, kind="stable")
    length = lines[order]
    offset = (np.cumsum(lines) - lines)[order]
    emit = np.exp(np.clip(np.stack([np.zeros(len(score)), score], 1), -60, 60))
    step, start = np.exp(crf.step), np.exp(crf.start)
    forward, out = np.zeros((len(score), 2)), np.zeros((len(score), 2))
    active = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), side="right")
    for t, n in enumerate(active.tolist()):
        at = offset[:n] + t
        f = (start if t == 0 else forward[at - 1] @ step) * emit[at]
        forward[at] = f / f.sum(1, keepdims=True)
    pairs = np.zeros((2, 2))
    back = np.ones((len(length), 2))
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = offset[:n] + t
        g = forward[at] * back[:n]
        out[at] = g / g.sum(1, keepdims=True)
        if t:
            ahead = emit[at] * back[:n]
            both = forward[at - 1][:, :, None] * step * ahead[:, None, :]
            pairs += (both / both.sum((1, 2), keepdims=True)).sum(0)
            b = ahead @ step.T
            back[:n] = b / b.sum(1, keepdims=True)
    return out, pairs


def fit(x: np.ndarray, lines: np.ndarray, good: np.ndarray) -> Crf:
    """The CRF of greatest penalised likelihood, by Adam from zero.

    Each text weighs the same, however many lines it has.
    """
    if len(lines) == 0 or good.all() or not good.any():
        return Crf(np.zeros(FEATURES), np.zeros(2), np.zeros((2, 2)), float((good.sum() + 1) / (len(good) + 2)))
    label = np.repeat(good, lines).astype(np.float64)
    weight = np.repeat(1 / lines, lines) / len(lines)
    firsts = np.cumsum(lines) - lines
    theta, m, v = np.zeros(FEATURES + 6), np.zeros(FEATURES + 6), np.zeros(FEATURES + 6)
    steps_seen = np.array([((lines - 1) * ~good).sum(), ((lines - 1) * good).sum()]) / len(label)
    for k in range(1, ROUNDS + 1):
        crf = Crf(theta[:FEATURES], theta[FEATURES : FEATURES + 2], theta[FEATURES + 2 :].reshape(2, 2))
        p, pairs = marginals(x @ crf.weights, lines, crf)
        grad = np.concatenate([x.T @ (weight * (label - p[:, 1])), np.array([(~good).mean(), good.mean()]) - p[firsts].mean(0), (np.diag(steps_seen) - pairs / len(label)).ravel()])
        grad -= RIDGE * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
    return Crf(theta[:FEATURES], theta[FEATURES : FEATURES + 2], theta[FEATURES + 2 :].reshape(2, 2))


def score_texts(texts: list[bytes | None], crf: Crf) -> np.ndarray:
    if crf.constant is not None:
        return np.full(len(texts), crf.constant)
    x, n_words, lines = line_features(texts)
    p, _ = marginals(x @ crf.weights, lines, crf)
    weight = n_words + 1.0
    text_of = np.repeat(np.arange(len(lines)), lines)
    return np.bincount(text_of, weight * p[:, 1], len(lines)) / np.bincount(text_of, weight, len(lines))


def held_out(id_column: Column) -> Column:
    """The fold that no label is learnt from."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def train(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", most_documents: int = MOST_DOCUMENTS, most_bytes: int = MOST_BYTES, most_lines: int = MOST_LINES) -> Crf:
    """Fit on a bounded sample of labelled rows; only their features reach the driver."""
    one = labels.filter("quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).filter("low = high")
    ids = one.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_documents).select(F.col("doc_id").alias("labelled"), F.col("high").alias("quality"))
    some = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(F.broadcast(ids), F.col("id").cast("string") == F.col("labelled").cast("string")).filter(f"coalesce(octet_length(text), 0) <= {most_bytes}")
    # Of rows with one id the text of the least hash, wherever they lie.
    some = some.groupBy(F.col("labelled").cast("string").alias("key")).agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("one"), F.first("quality").alias("quality")).select("key", "one.text", "quality")
    # At most ``most_documents`` rows of ``most_bytes`` meet in this window's task.
    so_far = Window.orderBy(F.xxhash64("key"), "key").rowsBetween(Window.unboundedPreceding, 0)
    breaks = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))), F.lit(0))
    some = some.withColumn("sum_lines", F.sum(breaks + 1).over(so_far)).filter(F.col("sum_lines") <= most_lines).drop("sum_lines").repartition(FIT_TASKS, "key")
    rows = arrow_map(some, _featured, "key string, quality int, lines long, x binary").orderBy("key").toArrow()
    lines = rows.column("lines").to_numpy()
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), "<f8").reshape(-1, FEATURES)
    return fit(x, lines, rows.column("quality").to_numpy() == 1)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for some in in_slices(batches, "text"):
        x, _, lines = line_features(some.column("text").cast(pa.binary()).to_pylist())
        ends = np.cumsum(lines)
        parts = [x[a:b].astype("<f8").tobytes() for a, b in zip(ends - lines, ends, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [some.column("key"), some.column("quality").cast(pa.int32()), pa.array(lines), pa.array(parts, pa.binary())],
            names=["key", "quality", "lines", "x"],
        )


def _scored(docs: DataFrame, crf: Crf, text: str, key: Column) -> DataFrame:
    """``key`` and ``score`` of every row."""
    frame = docs.select(key.alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in in_slices(batches, "text"):
            scores = score_texts(some.column("text").cast(pa.binary()).to_pylist(), crf)
            yield pa.RecordBatch.from_arrays([some.column("id"), pa.array(scores)], names=["id", "score"])

    return arrow_map(frame, run, f"id {frame.dtypes[0][1]}, score double")


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``score``, ``predicted``."""
    crf = train(docs, labels, text, id_col)
    out = _scored(docs, crf, text, F.col(id_col))
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; no shuffle of texts."""
    crf = train(docs, labels, text, id_col)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in in_slices(batches, "text"):
            keep = score_texts(some.column("text").cast(pa.binary()).to_pylist(), crf) >= threshold
            yield some.select(["row"]).filter(pa.array(keep))

    return packed.mapInArrow(run, packed.select("row").schema).select("row.*")
