from __future__ import annotations

import hashlib
import itertools
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import LOWER, words
from veridal.llm import char_tagger, hmm_lm, line_crf, private_data

# --- language model ---


def tiny_hmm(symbols=4, states=3, seed=0):
    rng = np.random.default_rng(seed)
    norm = lambda a, axis: a / a.sum(axis, keepdims=True)
    return hmm_lm.Hmm(norm(rng.random(states), 0), norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((symbols, states)), 0))


def by_paths(text, hmm, start):
    """Likelihood and expected counts by all paths."""
    k, total = len(start), 0.0
    emit, step, first = np.zeros_like(hmm.emit), np.zeros_like(hmm.step), np.zeros(k)
    for path in itertools.product(range(k), repeat=len(text)):
        p = start[path[0]] * hmm.emit[text[0], path[0]]
        for a, b, x in zip(path, path[1:], text[1:], strict=False):
            p *= hmm.step[a, b] * hmm.emit[x, b]
        total += p
        first[path[0]] += p
        for a, b in zip(path, path[1:], strict=False):
            step[a, b] += p
        for s, x in zip(path, text, strict=True):
            emit[x, s] += p
    return total, emit / total, step / total, first / total


def test_forward_is_the_sum_over_paths(monkeypatch):
    hmm, texts = tiny_hmm(), [np.array(t) for t in ([1], [2, 3, 0], [0, 1, 2, 3, 1, 2, 0], [3, 3, 0, 1, 0])]
    want = [math.log(by_paths(t, hmm, hmm.start)[0]) for t in texts]
    for segment in (512, 2, 3):
        monkeypatch.setattr(hmm_lm, "SEGMENT", segment)
        assert hmm_lm.log_likelihoods(texts, hmm) == pytest.approx(want, abs=1e-12)


def test_baum_welch_counts_are_the_sums_over_paths(monkeypatch):
    hmm, texts = tiny_hmm(seed=1), [np.array(t) for t in ([2, 3, 0], [0, 1, 2, 3, 1, 2, 0], [1])]
    monkeypatch.setattr(hmm_lm, "SEGMENT", 4)
    total = np.zeros(4 * 3 + 9 + 6)
    hmm_lm.expected_counts(texts, hmm, total)
    emit, step, first, middle = np.zeros((4, 3)), np.zeros((3, 3)), np.zeros(3), np.zeros(3)
    for t in texts:
        for a in range(0, len(t), 4):
            _, e, s, f = by_paths(t[a : a + 4], hmm, hmm.middle if a else hmm.start)
            emit, step = emit + e, step + s
            first, middle = (first, middle + f) if a else (first + f, middle)
    assert np.allclose(total, np.concatenate([emit.T.ravel(), step.ravel(), first, middle]), atol=1e-5)


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(0)
    texts = [np.where(np.arange(40) // 20 % 2 == 0, rng.integers(2, 10, 40), rng.integers(10, 18, 40)) for _ in range(30)]
    shares = np.full(18, 1 / 18)
    hmm, scores = hmm_lm.first_model(shares), []
    for _ in range(8):
        scores.append(hmm_lm.log_likelihoods(texts, hmm).sum())
        total = np.zeros(18 * 8 + 64 + 16)
        hmm_lm.expected_counts(texts, hmm, total)
        hmm = hmm_lm.next_model(total, shares)
    assert all(b > a - 1e-3 for a, b in zip(scores, scores[1:], strict=False)) and scores[-1] > scores[0] + 100


def check_base(rows, docs):
    tokens = [(d, [*words((t or "").translate(LOWER)), None]) for d, t in docs]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    c = Counter(w for d, ws in tokens if not held(d) for w in ws)
    n, v = c.total(), len(c)
    want = sorted(((d, held(d), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 4)) for d, ws in tokens), key=str)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows), key=str) == want


@pytest.mark.parametrize("few", [False, True])
def test_lm_scores(documents, few, monkeypatch):
    if few:  # more words than the tables hold
        monkeypatch.setattr(hmm_lm, "KNOWN", 500)
        monkeypatch.setattr(hmm_lm, "SYMBOLS", 100)
    rows = hmm_lm.score_documents(documents, rounds=2).collect()
    check_base(rows, [(r.doc_id, r.text) for r in documents.collect()])
    seen = [r for r in rows if not r.held_out]
    assert sum(r.score for r in seen) > sum(r.base_score for r in seen)


def brute_scores(docs, hmm, symbols_of):
    """The forward recursion word by word, and add-one shares within classes."""
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    c = Counter(w for d, t in docs if not held(d) for w in words((t or "").translate(LOWER)))

    def class_of(w):
        raw = w.encode()
        last = raw[-1]
        group = last - 97 if 97 <= last <= 122 else 26 if 48 <= last <= 57 else 27 if last < 128 else 28
        return 1 + 3 * group + (len(raw) > 4) + (len(raw) > 8)

    rare = Counter()
    for w, n in c.items():
        if w not in symbols_of:
            rare[class_of(w)] += n + 1
    out = []
    for d, t in docs:
        f, log = None, 0.0
        for w in [*words((t or "").translate(LOWER)), None]:
            symbol = 0 if w is None else symbols_of.get(w, class_of(w))
            share = 1.0 if w is None or w in symbols_of else (c[w] + 1) / (rare[class_of(w)] + 1)
            f = (hmm.start if f is None else f @ hmm.step) * hmm.emit[symbol] * share
            log, f = log + math.log10(f.sum()), f / f.sum()
        out.append((d, round(log, 4)))
    return sorted(out, key=str)


def test_lm_scores_equal_a_plain_recursion(spark, documents, monkeypatch):
    monkeypatch.setattr(hmm_lm, "KNOWN", 700)
    monkeypatch.setattr(hmm_lm, "SYMBOLS", 120)
    monkeypatch.setattr(hmm_lm, "SEGMENT", 50)
    learnt, chosen, train, most_frequent = [], [], hmm_lm.train, hmm_lm.most_frequent
    monkeypatch.setattr(hmm_lm, "train", lambda *a: learnt.append(train(*a)) or learnt[-1])
    monkeypatch.setattr(hmm_lm, "most_frequent", lambda *a: chosen.append(most_frequent(*a)) or chosen[-1])
    few = documents.limit(40)
    docs = [(r.doc_id, r.text) for r in few.collect()]
    rows = hmm_lm.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), rounds=2).collect()
    vocabulary = sorted({w for _, t in docs for w in words(t.translate(LOWER))})
    name = dict(zip(vocabulary, hmm_lm.word_hashes(" ".join(vocabulary).encode())[0].view(np.int64).tolist(), strict=True))
    symbol = {h: 1 + hmm_lm.CLASSES + i for i, h in enumerate(chosen[1].hashes.tolist())}
    assert 100 < len(symbol) <= 120
    want = brute_scores(docs, learnt[0], {w: symbol[h] for w, h in name.items() if h in symbol})
    assert {r.doc_id: r.score for r in rows} == pytest.approx(dict(want), abs=1e-2)


def test_lm_ties_at_the_top_leave_symbols(spark):
    text = " ".join(f"w{i}" for i in range(300))
    counts = hmm_lm.token_counts(spark.createDataFrame([(text,)] * 3, "text string"))
    assert 80 <= len(hmm_lm.most_frequent(counts.filter("class > 0"), 100).hashes) <= 100
    assert hmm_lm.symbols_for(10) == hmm_lm.SYMBOLS < hmm_lm.symbols_for(10**9) < hmm_lm.symbols_for(10**13) < 1 << 19


def test_lm_corners(corners, clashing, nothing):
    rows = hmm_lm.score_documents(corners, rounds=1).collect()
    check_base(rows, [(r.doc_id, r.text) for r in corners.collect()])
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert hmm_lm.score_documents(nothing, rounds=1).count() == 0
    again = hmm_lm.score_documents(clashing, rounds=1).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


# --- classifier ---


def test_marginals_are_sums_over_labellings():
    rng = np.random.default_rng(2)
    crf = line_crf.Crf(np.zeros(1), rng.normal(size=2), rng.normal(size=(2, 2)))
    lines, score = np.array([3, 1, 5]), rng.normal(size=9)
    p, pairs = line_crf.marginals(score, lines, crf)
    want, want_pairs, at = np.zeros(9), np.zeros((2, 2)), 0
    for n in lines:
        total, good, steps = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = math.exp(crf.start[y[0]] + sum(score[at + i] * y[i] for i in range(n)) + sum(crf.step[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += w
            good += w * np.array(y)
            for a, b in zip(y, y[1:], strict=False):
                steps[a, b] += w
        want[at : at + n], want_pairs, at = good / total, want_pairs + steps / total, at + n
    assert np.allclose(p[:, 1], want) and np.allclose(pairs, want_pairs)


def test_line_features():
    x, n_words, lines = line_crf.line_features([b"a a b\n\na a b", None, b"##x 1"])
    assert lines.tolist() == [3, 1, 1] and n_words.tolist() == [3, 0, 3, 0, 2]
    assert x[:, 6].tolist() == [0, 0, 1, 0, 0] and x[:, 8].tolist() == [0, 1, 0, 1, 0] and x[:, 2].tolist() == [0, 0, 0, 0, 1]
    assert x[4, 9] == 0 and x[0, 9] > 0


def test_classifier_is_right_on_held_out_labels(documents, labels):
    rows = {r.doc_id: r for r in line_crf.classify(documents, labels).collect()}
    assert len(rows) == documents.count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for d, r in rows.items())
    held = [(rows[r.doc_id].predicted, r.quality) for r in labels.collect() if r.doc_id in rows and rows[r.doc_id].held_out]
    assert len(held) > 10 and sum(p == q for p, q in held) >= 0.9 * len(held)


def test_classifier_corners(corners, clashing, nothing, labels):
    rows = line_crf.classify(corners, labels.filter("false")).collect()
    assert len(rows) == corners.count() and {r.score for r in rows} == {0.5}
    assert line_crf.classify(nothing, labels).count() == 0
    some = labels.sparkSession.createDataFrame([(4, 1), (9, 0), (7, 1), (7, 0), (12, 1), (None, 1)], "doc_id long, quality int")
    kept = line_crf.keep_good(clashing, some, threshold=0.0)
    assert kept.columns == clashing.columns and kept.count() == clashing.count()


def test_scores_equal_marginals_by_recursion(spark, documents, labels):
    crf = line_crf.train(documents, labels)
    texts = ["", "a b c", "x\n\ny ### z\nx", "one two\n" * 9]
    x, n_words, lines = line_crf.line_features([t.encode() for t in texts])
    at, want = 0, []
    for n in lines.tolist():
        good = x[at : at + n] @ crf.weights
        total, marginal = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=n):
            p = math.exp(crf.start[y[0]] + sum(g for g, s in zip(good, y, strict=True) if s) + sum(crf.step[i, j] for i, j in zip(y, y[1:], strict=False)))
            total += p
            marginal += p * np.array(y)
        weight = n_words[at : at + n] + 1.0
        want.append(float((weight * marginal).sum() / weight.sum() / total))
        at += n
    got = line_crf.classify(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string"), labels.filter("false"))
    assert got.count() == len(texts)
    assert line_crf.score_texts([t.encode() for t in texts], crf) == pytest.approx(want, abs=1e-9)


def test_lines_in_the_fit_are_bounded(spark, monkeypatch):
    """Texts of very many lines reach the driver only as far as the bound goes; scores still cover all."""
    rows = [(i, "\n" * 19_000 if i % 2 else f"a good line of words {i}\nand another one") for i in range(1, 41)]
    marks = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    fit = line_crf.fit
    monkeypatch.setattr(line_crf, "fit", lambda x, lines, good: (seen.append(lines.copy()), fit(x, lines, good))[1])
    monkeypatch.setattr(line_crf, "ROUNDS", 3)
    line_crf.train(docs, marks, most_lines=60_000)
    line_crf.train(docs, marks)
    bounded, whole = seen
    assert 0 < bounded.sum() <= 60_000 and set(bounded) <= {2, 19_001}
    assert len(whole) == sum(line_crf_learns(i) for i, _ in rows)
    assert line_crf.classify(docs, marks).count() == len(rows)


def line_crf_learns(i: int) -> bool:
    return zlib.crc32(str(i).encode()) % line_crf.FOLDS != line_crf.HELD_OUT


def test_text_ids_and_repeated_ids_are_learnt_from_alike(spark, documents, labels):
    as_text = documents.withColumn("doc_id", documents.doc_id.cast("string"))
    a, b = (line_crf.train(d, labels) for d in (documents, as_text))
    assert len(a.weights) == len(b.weights) and np.abs(a.weights).max() > 0
    rows = [(i, t) for i in range(40) for t in (f"word {i}\nline", "### ###\n$$$", "other text")]
    marks = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    fits = [line_crf.train(spark.createDataFrame(r, "doc_id long, text string").repartition(n), marks).weights for r, n in ((rows, 1), (rows[::-1], 7))]
    assert np.array_equal(*fits)


# --- personal data ---


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1@.-%+ 0é(9\n", max_size=50))
def test_rules_are_the_patterns(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    want = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    want += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if max(map(int, m.group().split("."))) <= 255]
    want += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m.group())) <= 19 and private_data.luhn(digits(m.group()))]
    want += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m.group())) <= 15]
    assert private_data.rule_spans(text) == sorted(want)


def test_luhn():
    assert private_data.luhn("4539578763621486") and not private_data.luhn("4539578763621487")


def test_tagger_gradients_and_viterbi():
    model = char_tagger.new_tagger(1)
    rng = np.random.default_rng(0)
    codes, tags = rng.integers(0, 128, (5, 3)), np.array([[0, 0, 1], [1, 0, 2], [2, 0, 2], [0, 3, 0], [0, 4, 0]])
    loss, grads = char_tagger.gradients(codes, tags, model)
    for part, grad in zip(model.parts(), grads, strict=True):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        old, sides = part[at], []
        for d in (0.01, -0.01):
            part[at] = old + d
            sides.append(char_tagger.gradients(codes, tags, model)[0])
        part[at] = old
        assert grad[at] == pytest.approx((sides[0] - sides[1]) / 0.02, rel=0.02, abs=1e-3)
    ok = char_tagger.allowed_steps()
    scores = char_tagger.tag_scores(codes[:4], model)
    got = char_tagger.best_tags(scores, model)
    for w in range(3):
        value = lambda y, w=w: sum(scores[t, k, w] for t, k in enumerate(y)) + sum(model.step[a, b] for a, b in zip((0, *y), y, strict=False))
        paths = [y for y in itertools.product(range(9), repeat=4) if all(ok[a, b] for a, b in zip((0, *y), y, strict=False))]
        assert value(got[:, w].tolist()) == pytest.approx(max(map(value, paths)), abs=1e-4)


def test_windows_cover_every_text():
    for n in (0, 1, 255, 256, 257, 5000):
        starts = private_data.windows_of(n)
        assert starts[-1] + private_data.WINDOW >= n
        half = private_data.OVERLAP // 2
        owned = [(a + (half if a else 0), n if a == starts[-1] else a + private_data.WINDOW - half) for a in starts]
        assert all(y[0] == x[1] for x, y in zip(owned, owned[1:], strict=False)) and owned[0][0] == 0


@pytest.fixture(scope="module")
def tagger(documents):
    return private_data.train(documents.select(documents.doc_id.alias("id"), "text"))


def test_tagger_finds_planted_spans_of_other_documents(spark, sf_dir, tagger):
    """Held-out recall by the training's own measure, and of rewritten spans in documents that no label came from."""
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    for model, least in ((tagger, 0.6), (private_data.train(docs.select(docs.doc_id.alias("id"), "text")), private_data.LEAST_RECALL)):
        assert model.recall >= least
        rng = np.random.default_rng(3)
        texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect() if len(r.text) > 400 and not private_data.rule_spans(r.text)][:60]
        planted, found = 0, 0
        for k, t in enumerate(texts):
            new = [f"({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)}", f"ona.{rng.integers(10, 99)} at mail{rng.integers(9)} dot example dot com"][k % 2]
            at = t.rfind(" ", 0, int(rng.integers(50, len(t) - 50))) + 1
            (base, every), = private_data.all_spans([f"{t[:at]}{new} {t[at:]}"], model)
            planted += 1
            found += (at, 3 if k % 2 == 0 else 0, at + len(new)) in every
            assert not base
        assert found >= 0.5 * planted, (found, planted)


def test_spans_do_not_depend_on_windows(documents, tagger):
    """What the tagger finds in a text's middle, it finds wherever that falls on the windows' borders."""
    text = " ".join(r.text for r in documents.orderBy("doc_id").limit(4).collect())
    text = re.sub("[0-9@]", "", text)[:2000]
    new, hits = "+1 (415) 555-0100", 0
    for at in range(0, 620, 31):
        t = f"{text[:at]} {new} {text[at:]}"
        hits += (at + 1, 3, at + 1 + len(new)) in private_data.found_spans([t], tagger)[0]
    assert hits >= 17
    alone = private_data.found_spans([text[:300]], tagger)[0]
    assert private_data.found_spans([text[:300], "", text[:300]], tagger) == [alone, [], alone]


@pytest.mark.parametrize("text", ["1" * 5000 + ".1.1.1", "0" * 5000 + "1.1.1.1", "1" * 1_000_000, "1." * 500_000, "+1" + "(" * 1_000_000, "1 " * 500_000, "a@" * 300_000])
def test_rules_take_linear_time(text):
    begun = time.process_time()
    spans = private_data.rule_spans(text)
    assert time.process_time() - begun < 10
    assert (len(spans) > 0) == (text.startswith("00") or text.startswith("1.1"))


def check_private(rows, docs):
    assert len(rows) == len(docs)
    for r, (d, t) in zip(sorted(rows, key=lambda r: str(r.doc_id)), sorted(docs, key=lambda x: str(x[0])), strict=True):
        base = private_data.rule_spans(t or "")
        joined = ",".join(f"{private_data.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert (r.doc_id, r.base_sha256) == (d, hashlib.sha256(joined.encode()).hexdigest())
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in base) for k in range(4)]
        spans = [s for s in r.spans.split(",") if s]
        assert set(joined.split(",")) - {""} <= set(spans)
        assert spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), private_data.KINDS.index(s.split(":")[0])))


def test_private_data(documents, corners, nothing, tagger, monkeypatch):
    train = private_data.train
    monkeypatch.setattr(private_data, "train", lambda docs: tagger if docs.count() == documents.count() else train(docs))
    for df in (documents, corners):
        rows = private_data.find_private(df).collect()
        check_private(rows, [(r.doc_id, r.text) for r in df.collect()])
        assert all(r.n_added == r.spans.count(":") // 2 - r.n_email - r.n_ip - r.n_card - r.n_phone for r in rows)
    assert private_data.find_private(nothing).count() == 0


def test_private_data_with_clashing_columns(corners, clashing, monkeypatch):
    monkeypatch.setattr(private_data, "train", lambda _: None)
    assert sorted(map(str, private_data.find_private(clashing).collect())) == sorted(map(str, private_data.find_private(corners).collect()))


def test_tagger_learns_forms_that_rules_lack(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9)))
    rows = []
    for i in range(700):
        w = [word() for _ in range(30)]
        w[7] = f"+1 ({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)}"
        w[20] = f"{word()}.{rng.integers(10, 99)}@mail{rng.integers(9)}.example.com"
        rows.append((i, " ".join(w)))
    model = private_data.train(spark.createDataFrame(rows, "id long, text string"))
    text = f"{word()} {word()} (415) 555-0137 {word()} {word()} {word()} jo.ka at mail4 dot example dot com {word()} {word()}"
    found = {text[a:b] for _, every in private_data.all_spans([text], model) for a, _, b in every}
    assert found & {"(415) 555-0137", "jo.ka at mail4 dot example dot com"}
    assert private_data.all_spans(["plain words only, " * 40, ""], model) == [([], []), ([], [])]
    assert private_data.masked("call +1 415 now", [(5, 3, 11)]) == "call [phone] now"
