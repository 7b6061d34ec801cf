from __future__ import annotations

import math
import random
import time
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import words
from veridal.llm import mixing, quality_rules, queries, url_filter

PYTHON_NODES = ("Python", "Pandas", "Arrow")


def hash64(*parts: str) -> int:
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p.encode(), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def no_python(df):
    plan = df._jdf.queryExecution().toString()
    assert not any(n in plan for n in PYTHON_NODES)


# --- quality rules ---


def base_counts(text):
    w, t = words(text), text or ""
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered))


def ratios(docs, trusted):
    raw, target = Counter(), Counter()
    grams = {}
    for d, t in docs.items():
        w = words(t)
        grams[d] = [hash64(x) % quality_rules.BUCKETS for x in w] + [hash64(*p) % quality_rules.BUCKETS for p in zip(w, w[1:], strict=False)]
        raw.update(grams[d])
        if d in trusted:
            target.update(grams[d])
    share = target.total() / max(1, raw.total())
    value = {b: math.log((target[b] + quality_rules.PRIOR) / (raw[b] * share + quality_rules.PRIOR)) if target else 0.0 for b in raw}
    return {d: sum(value[b] for b in g) / len(g) if g else 0.0 for d, g in grams.items()}


def test_quality_rules_equal_brute_force(spark, sf_dir, documents, labels):
    df = queries.op7_quality_rules(spark, sf_dir)
    no_python(df)
    texts = {r.doc_id: r.text for r in documents.collect()}
    trusted = {r.doc_id for r in labels.filter("quality = 1 AND toxic = 0").collect()}
    want = ratios(texts, trusted)
    rows = df.collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = base_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 50 or base[4] * 100 > base[0] * 50)
        assert r.ratio == pytest.approx(want[r.doc_id], abs=1e-9)
        assert r.kept == (not r.base_failed and r.ratio >= quality_rules.THRESHOLD)


def test_quality_rules_tell_labelled_documents_apart(spark, sf_dir):
    for folder in (sf_dir, sf_dir.replace("sf0.001", "sf0.01")):
        docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
        rows = quality_rules.judge_labelled(docs, labels).join(labels, "doc_id").filter("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("double"))).collect()
        kept = {r[0]: r[1] for r in rows}
        assert kept[1] > 0.95 and kept.get(0, 0) < 0.02, (folder, kept)


def test_only_labelled_texts_move(spark, documents, labels):
    table = documents.select(F.col("doc_id").alias("id"), "text")
    good = {r.doc_id for r in labels.filter("quality = 1 AND toxic = 0").collect()}
    texts = quality_rules.labelled_texts(table, labels)
    assert Counter(r.text for r in texts.collect()) == Counter(r.text for r in table.collect() if r.id in good)


def test_quality_rules_corners(corners, clashing, nothing, labels):
    rows = quality_rules.judge_labelled(corners, labels.filter("false")).collect()
    assert len(rows) == corners.count()
    texts = defaultdict(set)
    for r in corners.collect():
        texts[r.doc_id].add(base_counts(r.text))
    assert all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) in texts[r.doc_id] and r.ratio == 0 for r in rows)
    assert quality_rules.judge_labelled(nothing, labels).count() == 0
    assert sorted(map(str, quality_rules.judge_labelled(clashing, labels.filter("false")).collect())) == sorted(map(str, rows))
    kept = quality_rules.keep_clean(clashing, labels.filter("false"))
    assert kept.columns == clashing.columns and kept.count() == sum(r.kept for r in rows)


# --- URL filters ---

RULES = queries.URL_RULES


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    stop = min([i for i in (rest.find(c, end) for c in "?#") if i >= 0], default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:stop]


def rule_for(host, path):
    fits = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fits, key=lambda r: (len(r[1] + r[2]), len(r[1])), default=None)


def keys(url):
    for at in range(1, len(url) + 1):
        for k in range(min(at - 1, url_filter.ORDER) + 1):
            yield at, k, ("context", k, url[at - 1 - k : at - 1]), ("gram", k, url[at - 1 - k : at])


def log_likelihood(url, counts):
    p, total = {}, 0.0
    for at, k, context, gram in keys(url):
        p[at] = (counts[gram] + url_filter.PULL * p.get(at, 1 / url_filter.ALPHABET)) / (counts[context] + url_filter.PULL)
        if k == min(at - 1, url_filter.ORDER):
            total += math.log(min(p[at], 1.0))
    return total


def held_out(url):
    return hash64(url) % url_filter.HELD_OUT_OF == 0


def url_verdicts(urls):
    counts = {"allow": Counter(), "block": Counter()}
    rules = [rule_for(*split_url(u)) for u in urls]
    for u, r in zip(urls, rules, strict=True):
        for _, _, context, gram in keys(u) if r and u and not held_out(u) else ():
            counts[r[0]].update((context, gram))
    score = [(log_likelihood(u, counts["allow"]) - log_likelihood(u, counts["block"])) / len(u) if u else None for u in urls]
    decided = [(s, r[0], held_out(u)) for u, s, r in zip(urls, score, rules, strict=True) if r and s is not None]
    by = {v: [s for s, x, h in decided if x == v and h] or [s for s, x, _ in decided if x == v] for v in counts}
    if not all(by.values()):
        return rules, score, None
    mean = {v: sum(x) / len(x) for v, x in by.items()}
    sd = {v: math.sqrt(sum((s - mean[v]) ** 2 for s in x) / len(x)) + 1e-6 for v, x in by.items()}
    return rules, score, (mean["allow"] * sd["block"] + mean["block"] * sd["allow"]) / (sd["allow"] + sd["block"])


@pytest.mark.parametrize("case", ["pages", "corners", "one class"])
def test_url_filter_equals_brute_force(spark, sf_dir, case):
    if case == "pages":
        df = queries.op4_url_filter(spark, sf_dir)
        urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    else:
        odd = [None, "", "no scheme", "HTTP://A.Example.COM/en/71?x#y", "http://net/de/1", "http://xnet/de/1", "a://b://c", "http://h?q=/en/", "http://org/es/", "x://Ünï.org/ß", "http://example.net/de/8"]
        urls = dict(enumerate(odd if case == "corners" else odd[:3] + ["http://x.org/es/1", "http://y.gov/"]))
        df = url_filter.filter_urls(spark.createDataFrame(list(urls.items()), "page_id long, url string"), RULES)
    no_python(df)
    rules, scores, threshold = url_verdicts(list(urls.values()))
    rows = {r.page_id: r for r in df.collect()}
    assert len(rows) == len(urls)
    for (page, url), rule, score in zip(urls.items(), rules, scores, strict=True):
        r = rows[page]
        assert (r.host, r.path, r.rule) == (*split_url(url), rule and rule[1] + rule[2])
        assert r.score == pytest.approx(score, abs=1e-9) if score is not None else r.score is None
        by_model = "block" if score is not None and threshold is not None and score < threshold else "allow"
        assert r.verdict == (rule[0] if rule else by_model)


@pytest.mark.parametrize("frequent", [0, 40])
def test_url_scores_come_from_exact_counts(spark, monkeypatch, frequent):
    rng = random.Random(1)
    urls = [f"http://{rng.choice(['a.org/es', 'b.net/de', 'c.gov'])}/" + "".join(chr(rng.randrange(33, 1500)) for _ in range(12)) for _ in range(1500)]
    seen = {"allow": Counter(), "block": Counter()}
    orders = [[(k, u[at - 1 - k : at]) for at in range(1, len(u) + 1) for k in range(min(at - 1, url_filter.ORDER) + 1)] for u in urls]
    for u, o in zip(urls, orders, strict=True):
        if (rule := rule_for(*split_url(u))) is not None and not held_out(u):
            seen[rule[0]].update(x for k, g in o for x in ((k, g), (k, g[:-1], "context")))

    def log_of(o, counts):
        p, total = 1 / url_filter.ALPHABET, 0.0
        for (k, g), after in zip(o, [*o[1:], (0, "")], strict=True):
            p = (counts[k, g] + url_filter.PULL * (p if k else 1 / url_filter.ALPHABET)) / (counts[k, g[:-1], "context"] + url_filter.PULL)
            total += math.log(p) if after[0] == 0 else 0.0
        return total

    table = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    scored = url_filter.scored
    monkeypatch.setattr(url_filter, "scored", lambda u, v: scored(u, v, frequent))
    got = {r.page_id: r.score for r in url_filter.filter_urls(table, RULES).collect()}
    assert len({x for o in orders for x in o}) > 1 << 16
    for i, (u, o) in enumerate(zip(urls, orders, strict=True)):
        assert got[i] == pytest.approx((log_of(o, seen["allow"]) - log_of(o, seen["block"])) / len(u), abs=1e-9)


def test_long_and_repeated_urls(spark):
    long = "http://a.net/" + "abcdé" * 40_000
    urls = [long, "http://b.org/es/1", "http://c.net/de/2", long, "http://b.org/es/1"]
    begun = time.perf_counter()
    rows = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), RULES).collect()
    assert time.perf_counter() - begun < 60
    by_url = defaultdict(set)
    for r in rows:
        by_url[urls[r.page_id]].add((r.host, r.rule, r.verdict, r.score))
    assert len(rows) == len(urls) and all(len(x) == 1 for x in by_url.values())


def test_url_filter_keeps_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.org/es/", "x"), (None, None, "y")], "page_id long, url string, blocked_id string")
    out = url_filter.drop_rejected(pages, RULES)
    assert out.columns == pages.columns and [r.blocked_id for r in out.collect()] == ["y"]
    assert url_filter.filter_urls(pages.filter("false"), RULES).count() == 0
    names = ["id", "row", "host", "path", "rule", "verdict", "held_out", "window", "n", "score", "threshold"]
    assert sorted(map(str, url_filter.filter_urls(pages.withColumns({c: F.lit(c) for c in names}), RULES).collect())) == sorted(map(str, url_filter.filter_urls(pages, RULES).collect()))


# --- mixing ---


def test_mixture_equals_its_sql_and_hits_targets(spark, sf_dir):
    df = queries.op3_mix_sources(spark, sf_dir)
    no_python(df)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(mixing.oracle_sql())
    got = [tuple(r) for r in df.select(*want.columns).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want.fetchall()))


def test_mixture_follows_given_targets(spark):
    rows = [(i, "w " * (i % 7 + 1), ["en", "fr"][i % 2], ["a", "b", None][i % 3]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.mixture(docs, targets={"source": {"a": 0.5, "b": 0.25, None: 0.25}, "lang": {"en": 0.9, "fr": 0.1}}, rounds=30)
    total = out.agg(F.sum(F.col("tokens") * F.col("probability"))).first()[0]
    for column, value, share in (("source", "a", 0.5), ("source", None, 0.25), ("lang", "en", 0.9)):
        part = out.filter(F.col(column).eqNullSafe(F.lit(value))).agg(F.sum(F.col("tokens") * F.col("probability"))).first()[0]
        assert part / total == pytest.approx(share, abs=1e-4)
    n, p = out.agg(F.count_if("sampled"), F.sum("probability")).first()
    assert abs(n - p) < 4 * math.sqrt(p) and out.agg(F.max("probability")).first()[0] == 1


def test_mixture_corners(corners, clashing, nothing):
    out = mixing.mixture(corners).collect()
    assert len(out) == corners.count() and all(0 < r.probability <= 1 and r.tokens >= 1 for r in out)
    kept = mixing.sample_mixture(clashing)
    assert kept.columns == clashing.columns
    assert Counter(r.doc_id for r in kept.select("doc_id").collect()) == Counter(r.doc_id for r in out if r.sampled)
    assert mixing.mixture(nothing).count() == 0 and mixing.sample_mixture(nothing).count() == 0


def test_a_stray_row_does_not_empty_the_mixture(spark, sf_dir, documents):
    docs = documents.select("doc_id", "text", "lang", "source")
    stray = docs.unionByName(spark.createDataFrame([(10**9, "one two three four five", "en", None)], docs.schema))

    def kept(df, **how):
        return mixing.mixture(df, **how).agg(F.sum(F.col("tokens") * F.col("probability")) / F.sum("tokens")).first()[0]

    assert kept(stray, least_rate=0.9) == pytest.approx(0.9, abs=1e-4)
    sampled = corpus_pipeline.mix_sources(spark, stray, sf_dir)
    assert sampled.count() > 2 * mixing.sample_mixture(stray).count()
    assert sampled.filter("source IS NULL AND doc_id = 1000000000").count() == 1


def test_rows_with_equal_ids_are_sampled_by_their_own_cells(spark):
    rows = [(i % 41 or None, "w " * (i % 9 + 1), ["en", "fr", None][i % 7 % 3], f"s{int(i**0.5) // 6}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = Counter((r.doc_id, r.source, r.lang, r.tokens) for r in mixing.mixture(docs).filter("sampled").collect())
    assert {r.doc_id for r in mixing.mixture(docs).filter("NOT sampled").collect()} & {d for d, *_ in want}
    assert Counter((r.doc_id, r.source, r.lang, len(words(r.text))) for r in mixing.sample_mixture(docs).collect()) == want


def test_rounds_of_raking_are_not_shuffles(spark):
    """Tasks of a mixture, and so what the driver keeps of them, do not grow with partitions times rounds."""
    held = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    docs = spark.createDataFrame([(i, "x " * (i % 7 + 1), "en" if i % 3 else "fr", "abc"[i % 3]) for i in range(90)], "doc_id long, text string, lang string, source string")
    tracker = spark.sparkContext.statusTracker()
    for k, v in held.items():
        spark.conf.set(k, v)
    spark.sparkContext.setJobGroup("raking", "raking")
    try:
        assert mixing.mixture(docs, rounds=8).count() == 90
        stages = {s for j in tracker.getJobIdsForGroup("raking") for s in tracker.getJobInfo(j).stageIds}
        tasks = sum(info.numTasks for s in stages if (info := tracker.getStageInfo(s)) is not None and info.numCompletedTasks)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert tasks < 8 * 50, tasks
