from __future__ import annotations

from collections import Counter

import corpus_pipeline
from tests.llm.conftest import LOWER
from tests.llm.test_dedup_and_join import brute_groups
from tests.llm.test_tokens import brute_pieces, check_packing, library  # noqa: F401 - a fixture
from veridal.llm import line_crf, mixing, queries


def test_stages_against_brute_force(spark, sf_dir, documents, labels, library, tmp_path):  # noqa: F811
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_copies", "near_copies", "mix_sources", "pack"]
    before, kept = documents, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, sf_dir).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "pack":
            assert after.columns == documents.columns
        kept.append((name, before, after))
        before = after
    rows = {name: ([(r.doc_id, r.text) for r in b.select("doc_id", "text").collect()], a) for name, b, a in kept}

    def ids(df):
        return Counter(r.doc_id for r in df.select("doc_id").collect())

    crf = line_crf.train(documents, labels)
    given, after = rows["quality_classifier"]
    scores = line_crf.score_texts([t.encode() for _, t in given], crf)
    assert ids(after) == Counter(d for (d, _), s in zip(given, scores, strict=True) if s >= line_crf.THRESHOLD)

    given, after = rows["exact_copies"]
    best = {}
    for d, t in given:
        best[t.translate(LOWER)] = max(d, best.get(t.translate(LOWER), d))
    assert ids(after) == Counter(best.values())

    given, after = rows["near_copies"]
    assert ids(after) == Counter(d for d, _, c in brute_groups(given) if d == c)

    given, after = rows["mix_sources"]
    drawn = mixing.mixture(kept[3][1]).filter("sampled")
    assert ids(after) == ids(drawn) and set(ids(after)) < {d for d, _ in given}

    given, after = rows["pack"]
    want, total = brute_pieces(given, library, 1024)
    assert check_packing(after.collect(), want, 1024) <= -(-total // 1024) * 1.02 + 2


def test_run_applies_all_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0


def test_each_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(queries.ORACLES) <= set(queries.QUERIES)
