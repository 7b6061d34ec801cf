"""LM scoring with a hidden Markov language model.

Words are counted exactly over all training documents. The most frequent ones, a
number that grows with the training tokens (``symbols_for``), are symbols of the
model. Every other word, counted or not, emits the symbol of its *class*, which its
last byte and its length tell, times its add-one share among the class's words that
are no symbols; so states tell rare words apart, and all counts of the corpus reach
the score. A text ends with the symbol *end*.

Baum-Welch runs over segments of at most ``SEGMENT`` symbols of every training
document: each task, of about ``TASK_TOKENS`` tokens however many partitions there
are, adds up its expected counts, the sums are added in a shuffle of arrays of a
fixed size, and the driver gets one such array a round. A text's score is its
exact likelihood by the scaled forward recursion; a long text is cut into parts
whose transfer matrices are multiplied in order.

Counts of the ``KNOWN`` most frequent words are broadcast (ties go by hash); the
remaining words of each text meet their counts in a shuffle, where none is frequent
enough to be a hot key. Words are compared by 64-bit hashes (see ``shingles``).

Defined results: null text counts as empty, that is one end token; without
training documents every count is 0 and the base score is 0 for all; rows with
equal ids are scored one by one; a null id hashes as the empty string; an empty
table gives an empty table; a text of any length is scored whole; columns besides
id and text are not read, so none can clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridal.llm.shingles import mix, word_hashes
from veridal.llm.store import arrow_map, cut, in_slices, sum_blocks

STATES = 8
SYMBOLS = 1 << 14
#: Training tokens for which there are ``SYMBOLS`` symbols; their number goes with the fourth root.
SYMBOLS_AT = 1 << 24
KNOWN = 1 << 17
TASK_TOKENS = 1 << 25
SEGMENT = 512
ROUNDS = 5
FOLDS, HELD_OUT = 7, 2
SEED = 20240101
_END = 0
#: Classes of words: 26 letters, digits, other ASCII and the rest as last byte, by three lengths. Their symbols are 1 to ``CLASSES``.
CLASSES = 87
_LAST = np.full(256, 28)
_LAST[:128] = 27
_LAST[ord("0") : ord("9") + 1] = 26
_LAST[ord("a") : ord("z") + 1] = np.arange(26)
_BATCH = 400_000
_BLOCK = 1 << 13
#: Stands for the end token among word hashes.
END_HASH = int(mix(np.array([0xE0D], np.uint64)).view(np.int64)[0])


@dataclass(frozen=True)
class Hmm:
    """Probabilities; ``start`` of a text and ``middle`` of a later segment."""

    start: np.ndarray
    middle: np.ndarray
    step: np.ndarray
    emit: np.ndarray  # symbols x states


def held_out(id_column: Column) -> Column:
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def symbols_for(tokens: int) -> int:
    """How many words are symbols: a model of a million times the tokens is 32 times as large."""
    return int(SYMBOLS * max(1.0, tokens / SYMBOLS_AT) ** 0.25)


def word_classes(last: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Classes from 1 of words with these last bytes and lengths in bytes."""
    return 1 + 3 * _LAST[last] + (sizes > 4) + (sizes > 8)


def _words_by_text(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and classes of all words, and where each text's words begin."""
    raw = [(t or b"").lower() for t in texts]
    whole = b"\n".join(raw)
    hashes, starts, ends = word_hashes(whole)
    classes = word_classes(np.frombuffer(whole, np.uint8)[ends - 1], ends - starts) if len(ends) else np.zeros(0, np.int64)
    return hashes.view(np.int64), classes, np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in raw)]))


def token_counts(docs: DataFrame) -> DataFrame:
    """``(hash, class, c)`` of every training token; ``docs`` has ``text``. The end token's class is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        texts = 0

        def merged() -> tuple[np.ndarray, ...]:
            keys, first, at = np.unique(np.concatenate([h[0] for h in held]), return_index=True, return_inverse=True)
            return keys, np.concatenate([h[1] for h in held])[first], np.bincount(at, np.concatenate([h[2] for h in held])).astype(np.int64)

        def rows(keys: np.ndarray, classes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(classes, pa.int32()), pa.array(counts)], names=["hash", "class", "c"])

        for some in in_slices(batches, "text"):
            hashes, classes, _ = _words_by_text(some.column("text").cast(pa.binary()).to_pylist())
            texts += some.num_rows
            keys, first, counts = np.unique(hashes, return_index=True, return_counts=True)
            held.append((keys, classes[first], counts))
            if sum(len(h[0]) for h in held) > 2_000_000:
                yield rows(*merged())
                held = []
        if held:
            yield rows(*merged())
        if texts:
            yield rows(np.array([END_HASH]), np.array([0]), np.array([texts]))

    parts = arrow_map(docs.select("text"), run, "hash long, class int, c long")
    return parts.groupBy("hash").agg(F.first("class").alias("class"), F.sum("c").alias("c"))


@dataclass(frozen=True)
class Known:
    """Words by ascending hash, with counts and classes."""

    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray


def most_frequent(counts: DataFrame, most: int) -> Known:
    """The ``most`` most frequent words but for a few: of the words about the least count, as many as fit by hash."""
    level, part = F.floor(F.log2("c") * 256).cast("int"), F.pmod(F.col("hash"), F.lit(4096)).cast("int")
    sizes = sorted(((r["l"], r["n"]) for r in counts.groupBy(level.alias("l")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, last, total = 0, 4095, 0
    for least, n in sizes:
        if total + n > most:
            last = -1
            for p, m in sorted((r["p"], r["n"]) for r in counts.filter(level == least).groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()):
                if total + m > most:
                    break
                total, last = total + m, p
            break
        total += n
    chosen = (level > least) | ((level == least) & (part <= last))
    found = counts.filter(chosen).toArrow()  # at most ``most`` rows
    order = np.argsort(found.column("hash").to_numpy())
    return Known(*(found.column(c).to_numpy().astype(np.int64)[order] for c in ("hash", "c", "class")))


def encode(docs: DataFrame, known: Known, symbol: np.ndarray, symbols: int, end_count: int, class_logs: np.ndarray) -> DataFrame:
    """A row per document: ids, symbols as bytes, sums over known words, and the other words' hashes.

    ``symbol`` has the symbol of each known word. ``log_class`` sums the class
    denominators of words that are no symbols, ``log_mid`` the counts of those
    that are known.
    """
    sent = docs.sparkSession.sparkContext.broadcast((known, symbol))
    kind, width = dict(docs.dtypes)["id"], symbol_type(symbols)
    names = ["row", "id", "held_out", "n_tokens", "n_known", "log_class", "log_known", "log_mid", "symbols", "others"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        known, symbol = sent.value
        logs = np.log10(known.counts + 1.0)
        for some in in_slices(batches, "text"):
            hashes, classes, ends = _words_by_text(some.column("text").cast(pa.binary()).to_pylist())
            at = np.minimum(np.searchsorted(known.hashes, hashes), max(len(known.hashes) - 1, 0))
            hit = known.hashes[at] == hashes if len(known.hashes) else np.zeros(len(hashes), bool)
            code = np.where(hit, symbol[at], classes) if len(symbol) else classes
            log = np.where(hit, logs[at], 0.0) if len(symbol) else np.zeros(len(hashes))
            rare = code <= CLASSES
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (hit, np.where(rare, class_logs[classes], 0.0), log, np.where(rare, log, 0.0))]
            n_hit, by_class, all_logs, mid = (x[ends[1:]] - x[ends[:-1]] for x in sums)
            packed, others = [], []
            code = code.astype(width)
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                packed.append(np.append(code[a:b], width.type(_END)).tobytes())
                others.append(hashes[a:b][~hit[a:b]])
            rows = pa.array(np.arange(row, row + some.num_rows))
            row += some.num_rows
            columns = (pa.array(ends[1:] - ends[:-1] + 1), pa.array(n_hit + (end_count > 0)), pa.array(by_class), pa.array(all_logs + math.log10(end_count + 1)), pa.array(mid))
            yield pa.RecordBatch.from_arrays(
                [rows, some.column("id"), some.column("held_out"), *columns, pa.array(packed, pa.binary()), pa.array(others, pa.list_(pa.int64()))], names=names
            )

    return arrow_map(
        docs.select("id", "held_out", "text"), run,
        f"row long, id {kind}, held_out boolean, n_tokens long, n_known long, log_class double, log_known double, log_mid double, symbols binary, others array<bigint>",
    )


def symbol_type(symbols: int) -> np.dtype:
    return np.dtype("<u2" if symbols <= 1 << 16 else "<u4")


def _lanes(parts: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Batches of sequences, longest first: their numbers, a padded grid by step, and sequences per step."""
    order = sorted(range(len(parts)), key=lambda i: -len(parts[i]))
    at = 0
    while at < len(order):
        longest = max(1, len(parts[order[at]]))
        chosen = order[at : at + max(1, _BATCH // longest)]
        at += len(chosen)
        length = np.array([len(parts[i]) for i in chosen])
        grid = np.zeros((longest, len(chosen)), np.int64)
        for j, i in enumerate(chosen):
            grid[: len(parts[i]), j] = parts[i]
        yield chosen, grid, np.searchsorted(-length, -np.arange(1, longest + 1), side="right")


def expected_counts(texts: list[np.ndarray], hmm: Hmm, total: np.ndarray) -> None:
    """Add a batch's expected counts to ``total``: emissions, steps, starts, middles, in one array."""
    symbols, states = hmm.emit.shape
    emit = total[: symbols * states].reshape(states, symbols)
    step = total[symbols * states :][: states * states].reshape(states, states)
    start, middle = total[-2 * states :].reshape(2, states)
    parts, first = [], []
    for t in texts:
        for a in range(0, len(t), SEGMENT):
            parts.append(t[a : a + SEGMENT])
            first.append(a == 0)
    by_symbol, a_step = hmm.emit.astype(np.float32), hmm.step.astype(np.float32)
    begin = np.stack([hmm.middle, hmm.start]).astype(np.float32)
    for chosen, grid, active in _lanes(parts):
        is_first = np.array([first[i] for i in chosen])
        b = by_symbol[grid]
        for t, n in enumerate(active.tolist()):
            f = (begin[is_first.astype(int)] if t == 0 else b[t - 1, :n] @ a_step) * by_symbol[grid[t, :n]]
            b[t, :n] = f / f.sum(1, keepdims=True)
        back = np.ones(b.shape[1:], np.float32)
        for t in range(len(active) - 1, -1, -1):
            n = active[t]
            gamma = b[t, :n] * back[:n]
            norm = gamma.sum(1, keepdims=True)
            b[t, :n] = gamma / norm
            if t:
                ahead = by_symbol[grid[t, :n]] * back[:n]
                before = b[t - 1, :n]
                reached = before @ a_step
                scale = (reached * ahead).sum(1, keepdims=True)
                step += a_step * (before.T @ (ahead / scale))
                new = ahead @ a_step.T
                back[:n] = new / new.sum(1, keepdims=True)
        start += b[0, is_first].sum(0)
        middle += b[0, ~is_first].sum(0)
        inside = np.arange(grid.shape[1])[None, :] < active[:, None]
        flat, weight = grid[inside], b[inside]
        for k in range(states):
            emit[k] += np.bincount(flat, weight[:, k], symbols)


def log_likelihoods(texts: list[np.ndarray], hmm: Hmm) -> np.ndarray:
    """Natural log likelihood of each symbol sequence (none is empty)."""
    states = len(hmm.start)
    heads = [t[:SEGMENT] for t in texts]
    state, out = np.zeros((len(texts), states)), np.zeros(len(texts))
    for chosen, grid, active in _lanes(heads):
        now, log = np.empty((len(chosen), states)), np.zeros(len(chosen))
        for t, n in enumerate(active.tolist()):
            f = (hmm.start if t == 0 else now[:n] @ hmm.step) * hmm.emit[grid[t, :n]]
            s = f.sum(1)
            log[:n] += np.log(s)
            now[:n] = f / s[:, None]
        state[chosen], out[chosen] = now, log
    tails = [(i, t[a : a + SEGMENT]) for i, t in enumerate(texts) for a in range(SEGMENT, len(t), SEGMENT)]
    matrices, logs = np.zeros((len(tails), states, states)), np.zeros(len(tails))
    for chosen, grid, active in _lanes([t for _, t in tails]):
        now, log = np.tile(np.eye(states), (len(chosen), 1, 1)), np.zeros(len(chosen))
        for t, n in enumerate(active.tolist()):
            f = (now[:n].reshape(-1, states) @ hmm.step).reshape(n, states, states) * hmm.emit[grid[t, :n]][:, None, :]
            s = f.sum((1, 2))
            log[:n] += np.log(s)
            now[:n] = f / s[:, None, None]
        matrices[chosen], logs[chosen] = now, log
    for (i, _), m, log in zip(tails, matrices, logs, strict=True):
        f = state[i] @ m
        out[i] += log + math.log(f.sum())
        state[i] = f / f.sum()
    return out


def first_model(shares: np.ndarray, states: int = STATES) -> Hmm:
    """Every state near the words' shares, apart by fixed noise; states tend to stay."""
    noise = np.random.default_rng(SEED).normal(0, 0.7, (len(shares), states))
    emit = shares[:, None] * np.exp(noise)
    step = np.full((states, states), 0.2 / max(1, states - 1))
    np.fill_diagonal(step, 0.8)
    flat = np.full(states, 1 / states)
    return Hmm(flat, flat, step / step.sum(1, keepdims=True), emit / emit.sum(0))


def next_model(total: np.ndarray, shares: np.ndarray, states: int = STATES) -> Hmm:
    """The model of expected counts, with one count at the words' shares for each state."""
    n = len(shares)
    emit = total[: n * states].reshape(states, n).T + shares[:, None]
    step = total[n * states :][: states * states].reshape(states, states) + 1 / states
    start, middle = total[-2 * states :].reshape(2, states) + 1 / states
    return Hmm(start / start.sum(), middle / middle.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0))


def train(encoded: DataFrame, shares: np.ndarray, rounds: int = ROUNDS, tasks: int = 1 << 20) -> Hmm:
    """Baum-Welch over all rows of ``encoded`` (column ``symbols``), in so many tasks at most."""
    hmm, width = first_model(shares), symbol_type(len(shares))
    size = len(shares) * STATES + STATES * STATES + 2 * STATES
    context, texts = encoded.sparkSession.sparkContext, encoded.select("symbols").coalesce(tasks)
    for _ in range(rounds):
        sent = context.broadcast(hmm)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total, waiting, n = np.zeros(size), [], 0
            for batch in batches:
                for s in batch.column("symbols").to_pylist():
                    waiting.append(np.frombuffer(s, width).astype(np.int64))
                    n += len(waiting[-1])
                    if n > 4 * _BATCH:
                        expected_counts(waiting, sent.value, total)
                        waiting, n = [], 0
            expected_counts(waiting, sent.value, total)
            parts = [(k, total[i : i + _BLOCK]) for k, i in enumerate(range(0, size, _BLOCK))]
            touched = [(k, x.tobytes()) for k, x in parts if x.any()]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in touched], pa.int32()), pa.array([x for _, x in touched], pa.binary())], names=["block", "counts"])

        sums = sum_blocks(arrow_map(texts, run, "block int, counts binary"), "<f8", "<f8")
        total = np.zeros(size)
        for r in sums.collect():  # one array of ``size`` numbers
            total[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(r["counts"], "<f8")
        hmm = next_model(total, shares)
        sent.destroy()
    return hmm


def score_documents(docs: DataFrame, text: str = "text", id_col: str = "doc_id", rounds: int = ROUNDS) -> DataFrame:
    """One row per document: id, ``held_out``, token numbers, ``base_score``, ``score`` (log10)."""
    context = docs.sparkSession.sparkContext
    table = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text).alias("text"))
    counts = cut(token_counts(table.filter("NOT held_out")))
    by_class = {r["class"]: (int(r["n"]), int(r["c"])) for r in counts.groupBy("class").agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()}
    distinct, all_tokens = (sum(v[k] for v in by_class.values()) for k in (0, 1))
    end_count = by_class.get(0, (0, 0))[1]
    words = counts.filter("class > 0")
    known = most_frequent(words, max(KNOWN, 2 * symbols_for(all_tokens)))
    short = most_frequent(words, symbols_for(all_tokens))
    symbol = known.classes.copy()
    symbol[np.searchsorted(known.hashes, short.hashes)] = 1 + CLASSES + np.arange(len(short.hashes))
    rare = np.zeros((1 + CLASSES, 2))  # words and tokens of each class that are no symbols
    for k, held in by_class.items():
        rare[k] = held
    rare[0] = 0
    np.subtract.at(rare, short.classes, np.stack([np.ones(len(short.counts)), short.counts], 1))
    class_logs = np.log10(rare.sum(1) + 1)
    shares = np.concatenate([[end_count], rare[1:, 1], short.counts]) + 0.5
    shares = shares / shares.sum()

    encoded = cut(encode(table, known, symbol, len(shares), end_count, class_logs))
    tasks = max(context.defaultParallelism, -(-all_tokens // TASK_TOKENS))
    sent = context.broadcast(train(encoded.filter("NOT held_out"), shares, rounds, tasks))
    width = symbol_type(len(shares))

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [np.frombuffer(s, width).astype(np.int64) for s in b.column("symbols").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(log_likelihoods(texts, sent.value) / math.log(10))], names=["row", "forward"])

    others = encoded.select("row", F.explode("others").alias("hash")).join(counts.select("hash", "c"), "hash")
    others = others.groupBy("row").agg(F.count("*").alias("n_others"), F.sum(F.log10(F.col("c") + 1)).alias("log_others"))
    slim = encoded.drop("others")
    model = arrow_map(slim.select("row", "symbols"), forward, "row long, forward double")
    joined = slim.drop("symbols").join(model, "row").join(others, "row", "left").na.fill(0, ["n_others", "log_others"])
    return joined.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.col("n_others")).alias("n_known"),
        F.lit(all_tokens).cast("long").alias("train_tokens"),
        (F.col("log_known") + F.col("log_others") - F.col("n_tokens") * math.log10(all_tokens + distinct + 1)).alias("base_score"),
        (F.col("forward") + F.col("log_mid") + F.col("log_others") - F.col("log_class")).alias("score"),
    )
