"""A character-level bidirectional LSTM with a CRF on top, in numpy.

The input tables hold each character's contribution to the gates of either
direction; a linear layer turns both hidden states into tag scores; the CRF's
transitions allow an inside tag after its own kind only, and a begin tag after
*outside* only. All windows of
a batch run in step. Training is by back-propagation through the CRF's
likelihood, both directions and the tables, with Adam.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
HIDDEN = 8
CHARS = 132
_NEVER = np.float32(-1e4)


def char_codes(text: str) -> np.ndarray:
    """One code per code point: ASCII as it is, other letters, digits, spaces and the rest by class."""
    if text.isascii():
        return np.frombuffer(text.encode("ascii"), np.uint8)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.minimum(points, 128).astype(np.uint8)
    far = np.flatnonzero(points >= 128)
    values, at = np.unique(points[far], return_inverse=True)
    kinds = [128 if (c := chr(v)).isalpha() else 129 if c.isnumeric() else 130 if c.isspace() else 131 for v in values.tolist()]
    out[far] = np.array(kinds, np.uint8)[at] if len(far) else 0
    return out


@dataclass
class Tagger:
    table: np.ndarray  # 2 directions x CHARS x 4 HIDDEN (input, forget, output, cell)
    recur: np.ndarray  # 2 x HIDDEN x 4 HIDDEN
    out: np.ndarray  # 2 HIDDEN x TAGS
    bias: np.ndarray  # TAGS
    step: np.ndarray  # TAGS x TAGS
    recall: float = 0.0  # on held-out spans

    def parts(self) -> list[np.ndarray]:
        return [self.table, self.recur, self.out, self.bias, self.step]


def allowed_steps() -> np.ndarray:
    """Outside from any tag, begin from outside, inside from its kind's begin or inside."""
    ok = np.zeros((TAGS, TAGS), bool)
    ok[:, 0] = True
    for begin in range(1, TAGS, 2):
        ok[0, begin] = ok[begin, begin + 1] = ok[begin + 1, begin + 1] = True
    return ok


def new_tagger(seed: int) -> Tagger:
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.3, (2, CHARS, 4 * HIDDEN))
    table[:, :, HIDDEN : 2 * HIDDEN] += 1
    bias = np.full(TAGS, -1.0)
    bias[0] = 2
    parts = (table, rng.normal(0, 0.3, (2, HIDDEN, 4 * HIDDEN)), rng.normal(0, 0.3, (2 * HIDDEN, TAGS)), bias, np.zeros((TAGS, TAGS)))
    return Tagger(*(p.astype(np.float32) for p in parts))


# A sigmoid is half a tanh of half its input, plus a half: one tanh serves all gates.
_HALF = np.concatenate([np.full(3 * HIDDEN, 0.5), np.ones(HIDDEN)]).astype(np.float32)


def hidden_states(codes: np.ndarray, model: Tagger, keep: list | None = None) -> np.ndarray:
    """``codes`` steps x windows -> steps x 2 HIDDEN x windows; ``keep`` gets what training needs.

    Windows are the last axis, so that every gate is a run of memory.
    """
    steps, n = codes.shape
    table = np.ascontiguousarray(np.swapaxes(model.table * _HALF, 1, 2))
    recur = np.ascontiguousarray(np.swapaxes(model.recur * _HALF, 1, 2))
    h, c = np.zeros((2, HIDDEN, n), np.float32), np.zeros((2, HIDDEN, n), np.float32)
    out = np.empty((steps, 2 * HIDDEN, n), np.float32)
    for t in range(steps):
        z = np.matmul(recur, h)
        z[0] += table[0].take(codes[t], axis=1)
        z[1] += table[1].take(codes[steps - 1 - t], axis=1)
        np.tanh(z, out=z)
        z[:, : 3 * HIDDEN] *= 0.5
        z[:, : 3 * HIDDEN] += 0.5
        i, f, o, u = (z[:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
        if keep is not None:
            keep.append((h, c, z))
        c = f * c
        c += i * u
        h = np.tanh(c)
        h *= o
        out[t, :HIDDEN] = h[0]
        out[steps - 1 - t, HIDDEN:] = h[1]
    return out


def tag_scores(codes: np.ndarray, model: Tagger) -> np.ndarray:
    """Steps x TAGS x windows."""
    return np.matmul(model.out.T, hidden_states(codes, model)) + model.bias[:, None]


def best_tags(scores: np.ndarray, model: Tagger) -> np.ndarray:
    """Viterbi tags, steps x windows; starts are scored like steps from outside.

    Only the allowed steps are looked at: outside from any tag, begin from
    outside, inside from its kind's begin or inside.
    """
    step = model.step
    begin, inside = np.arange(1, TAGS, 2), np.arange(2, TAGS, 2)
    to_begin, go_on, stay = step[0, begin][:, None], step[begin, inside][:, None], step[inside, inside][:, None]
    steps, _, n = scores.shape
    best = scores[0] + step[0][:, None]
    best[inside] = _NEVER
    from_begin, left = np.zeros((steps, len(begin), n), bool), np.zeros((steps, n), np.int8)
    for t in range(1, steps):
        out = best + step[:, :1]
        left[t] = out.argmax(0)
        a, b = best[1::2] + go_on, best[2::2] + stay
        np.greater_equal(a, b, out=from_begin[t])
        new = np.empty_like(best)
        new[0] = out.max(0)
        new[1::2] = best[0] + to_begin
        np.maximum(a, b, out=new[2::2])
        new += scores[t]
        best = new
    tags = np.zeros((steps, n), np.int8)
    tags[-1] = best.argmax(0)
    windows = np.arange(n)
    for t in range(steps - 1, 0, -1):
        now = tags[t]
        kind = np.maximum(now - 1, 0) >> 1
        before = np.where(from_begin[t][kind, windows], 1, 2) + 2 * kind
        tags[t - 1] = np.where(now == 0, left[t], np.where(now & 1, 0, before))
    return tags


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


def gradients(codes: np.ndarray, tags: np.ndarray, model: Tagger) -> tuple[float, list[np.ndarray]]:
    """Mean negative log likelihood a window, and its gradients by the model's parts."""
    steps, n = codes.shape
    keep: list = []
    h = np.ascontiguousarray(np.swapaxes(hidden_states(codes, model, keep), 1, 2))
    scores = (h.reshape(-1, 2 * HIDDEN) @ model.out + model.bias).reshape(steps, n, TAGS).astype(np.float64)
    ok = allowed_steps()
    step = np.where(ok, model.step, _NEVER).astype(np.float64)
    alpha = np.empty_like(scores)
    alpha[0] = scores[0] + step[0]
    for t in range(1, steps):
        alpha[t] = _log_sum(alpha[t - 1][:, :, None] + step, 1) + scores[t]
    total = _log_sum(alpha[-1], 1)
    beta = np.zeros((n, TAGS))
    d_scores, d_step = np.empty_like(scores), np.zeros_like(step)
    for t in range(steps - 1, -1, -1):
        d_scores[t] = np.exp(alpha[t] + beta - total[:, None])
        if t:
            ahead = scores[t] + beta
            d_step += np.exp(alpha[t - 1][:, :, None] + step + ahead[:, None, :] - total[:, None, None]).sum(0)
            beta = _log_sum(step + ahead[:, None, :], 2)
    d_step[0] += d_scores[0].sum(0)
    at = np.arange(n)
    gold = sum(scores[t][at, tags[t]].sum() for t in range(steps)) + step[0][tags[0]].sum() + step[tags[:-1], tags[1:]].sum()
    for t in range(steps):
        d_scores[t][at, tags[t]] -= 1
    np.add.at(d_step, (tags[:-1].ravel(), tags[1:].ravel()), -1)
    np.add.at(d_step[0], tags[0], -1)
    d = (d_scores / n).astype(np.float32)
    flat = d.reshape(-1, TAGS)
    d_out, d_bias = h.reshape(-1, 2 * HIDDEN).T @ flat, flat.sum(0)
    d_h = np.ascontiguousarray(np.swapaxes((flat @ model.out.T).reshape(steps, n, 2 * HIDDEN), 1, 2))
    d_table, d_recur = np.zeros_like(model.table), np.zeros_like(model.recur)
    both, every = np.stack([codes, codes[::-1]]), np.arange(CHARS)[:, None]
    dh, dc = np.zeros((2, HIDDEN, n), np.float32), np.zeros((2, HIDDEN, n), np.float32)
    for t in range(steps - 1, -1, -1):
        h0, c0, g = keep[t]
        i, f, o, u = (g[:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
        tanh_c = np.tanh(f * c0 + i * u)
        dh = dh + np.stack([d_h[t, :HIDDEN], d_h[steps - 1 - t, HIDDEN:]])
        dc = dc + dh * o * (1 - tanh_c**2)
        dz = np.concatenate([dc * u * i * (1 - i), dc * c0 * f * (1 - f), dh * tanh_c * o * (1 - o), dc * i * (1 - u**2)], 1)
        dc = dc * f
        dh = np.matmul(model.recur, dz)
        d_recur += np.matmul(h0, np.swapaxes(dz, 1, 2))
        for way in (0, 1):
            d_table[way] += (every == both[way, t]).astype(np.float32) @ dz[way].T
    return float((total.sum() - gold) / n), [d_table, d_recur, d_out, d_bias, np.where(ok, d_step / n, 0).astype(np.float32)]


def fit(codes: np.ndarray, tags: np.ndarray, rounds: int, batch: int, rate: float, seed: int) -> Tagger:
    """Train on windows (windows x steps each) for so many passes."""
    model = new_tagger(seed)
    if not len(codes):
        return model
    rng = np.random.default_rng(seed)
    first = [np.zeros_like(p) for p in model.parts()]
    second = [np.zeros_like(p) for p in model.parts()]
    k, last = 0, rounds * -(-len(codes) // batch)
    for _ in range(rounds):
        order = rng.permutation(len(codes))
        for a in range(0, len(order), batch):
            some = order[a : a + batch]
            _, grads = gradients(np.ascontiguousarray(codes[some].T), tags[some].T.astype(np.int64), model)
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads))
            k += 1
            now = rate * (1 - 0.9 * k / last)
            for p, g, m, v in zip(model.parts(), grads, first, second, strict=True):
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (now * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)).astype(np.float32)
    return model
