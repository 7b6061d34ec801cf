"""Words on which a polynomial hash modulo a power of two fails."""

from __future__ import annotations

import pytest
from tests.llm.test_dedup_and_join import brute_groups, groups
from tests.llm.test_models import check_base
from tests.llm.test_tokens import brute_files, brute_pieces, check_packing, library  # noqa: F401 - a fixture

from veridal.llm import hmm_lm, packing, token_files
from veridal.llm.token_ids import TextEncoder, default_path

SWAP = str.maketrans("ab", "ba")


def thue_morse(n: int) -> str:
    word = "a"
    while len(word) < n:
        word += word.translate(SWAP)
    return word[:n]


ROWS = [(2 * k + side, w if side else w.translate(SWAP)) for k, w in enumerate(map(thue_morse, (8, 16, 64, 65, 1024, 2048, 4096, 8192))) for side in (0, 1)]


@pytest.fixture(scope="module")
def twins(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string")


def test_join_tells_them_apart(twins):
    assert groups(twins) == brute_groups(ROWS) and len({g[2] for g in groups(twins)}) == len(ROWS)


def test_ids_are_the_librarys(library):  # noqa: F811
    encoder = TextEncoder(default_path(), slot_bits=6)
    texts = [t for _, t in ROWS] + [" ".join(t for _, t in ROWS)]
    for _ in range(2):
        assert [encoder.ids(p).tolist() for p in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_and_files(spark, twins, library, tmp_path):  # noqa: F811
    want, _ = brute_pieces(ROWS, library, 1024)
    check_packing(packing.best_fit_packing(twins).collect(), want, 1024)
    token_files.write_token_files(twins, f"file://{tmp_path}/files")
    got = sorted((tuple(r) for r in token_files.read_token_files(spark, f"file://{tmp_path}/files").collect()), key=lambda r: r[1])
    assert got == brute_files(ROWS, library)


def test_words_are_counted_apart(twins):
    check_base(hmm_lm.score_documents(twins, rounds=1).collect(), ROWS)
