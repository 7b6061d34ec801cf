"""Encoders over stub sessions and tokenizers, images as arrays, mended text, files with errors, places of the vector."""

from __future__ import annotations

import os
import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridal.functions import text
from veridal.operators import encoders, taxonomy
from veridal.sources import tables


class Tokens:
    """A tokenizer whose ids are letters' places, cut and filled to ``size``."""

    def __init__(self, size=8, end=1, fill=True, pad=0):
        self.size, self.end, self.fill, self.pad = size, end, fill, pad

    def token_to_id(self, token):
        return {"<pad>": self.pad, "<eos>": 1}[token]

    def encode(self, plain):
        ids = [10 + string.ascii_lowercase.find(c) for c in plain][: self.size - 1] + [self.end]
        self.ids = ids + [0] * (self.size - len(ids)) if self.fill else ids
        return self


def test_token_rows():
    got = encoders.token_rows(["A_b!", "  &amp;c&#100; " + "x" * 50], Tokens(), context=8)
    assert got.dtype == np.int64 and got[0].tolist() == [10, 9, 11, 1, 0, 0, 0, 0] and got[1, -1] == 1
    refused = [([], Tokens()), ([3], Tokens()), ([None], Tokens()), (["???"], Tokens()), ([" \t"], Tokens()), (["a"], Tokens(end=7)), (["a"], Tokens(fill=False)), (["a"], Tokens(size=9)), (["a"], Tokens(pad=5))]
    for texts, tokens in refused:
        with pytest.raises(encoders.EncoderError):
            encoders.token_rows(texts, tokens, context=8)


def test_arrays_that_are_images_and_those_that_are_not():
    grey = np.arange(6, dtype=np.uint8).reshape(2, 3)
    assert (encoders.as_rgb(grey) == np.stack([grey] * 3, 2)).all() and (encoders.as_rgb(grey[..., None]) == encoders.as_rgb(grey)).all()
    alpha = np.dstack([grey, grey + 1, grey + 2, grey])
    assert (encoders.as_rgb(alpha) == alpha[..., :3]).all() and encoders.as_rgb(alpha).flags["C_CONTIGUOUS"]
    assert encoders.as_rgb(np.array([[0.0, 0.5, 1.0 + 1e-7]])).tolist() == [[[0] * 3, [128] * 3, [255] * 3]]
    for bad in (np.zeros((2, 2, 2)), np.zeros((2, 2, 5)), np.zeros(4), np.zeros((0, 2, 3), np.uint8), np.zeros((1, 2, 2, 3)), np.zeros((2, 2), np.int32), np.full((2, 2), 255.0), np.full((2, 2), np.nan), np.full((2, 2), -0.1)):
        with pytest.raises(encoders.EncoderError):
            encoders.as_rgb(bad)


def test_the_tower_takes_pixels_of_its_size():
    black = encoders.tower_input(np.zeros((encoders.HEIGHT, encoders.WIDTH, 3), np.uint8))
    assert black.shape == (3, 384, 128) and black.dtype == np.float16 and (black == -1).all()
    with pytest.raises(encoders.EncoderError):
        encoders.tower_input(np.zeros((128, 384, 3), np.uint8))


def test_an_image_fits_by_quality_first_and_then_by_size():
    tried = []

    def encode(most):
        def run(quality, size):
            tried.append((quality, size))
            return b"x" * (size[0] * size[1] * quality // 1000)

        return run(*most) if isinstance(most, tuple) else run

    assert encoders.fit_image(encode(0), (100, 50)) and tried == [(88, (100, 50))]
    tried.clear()
    encoders.fit_image(encode(0), (4000, 2000), most_bytes=20_000)
    assert tried[:6] == [(88, (1280, 640)), (78, (1280, 640)), (68, (1280, 640)), (58, (1280, 640)), (48, (1280, 640)), (48, (1024, 512))]
    assert {q for q, _ in tried[4:]} == {48}
    tried.clear()
    with pytest.raises(encoders.EncoderError):
        encoders.fit_image(encode(0), (1280, 1280), most_bytes=10)
    assert max(tried[-1][1]) <= 224 < max(tried[-2][1])


def test_contracts_devices_and_self_test():
    declared = {"text": ("int64", ["batch", 64]), "mask": ("int64", ["batch", 64])}
    encoders.check_contract(declared, {"text": ("int64", [None, 64]), "mask": ("int64", [None, 64])})
    for bad in ({"text": ("int64", [None, 64])}, {**declared, "text": ("int64", [None, 32])}, {**declared, "text": ("float32", [None, 64])}, {**declared, "text": ("int64", [None])}):
        with pytest.raises(encoders.EncoderError):
            encoders.check_contract(declared, bad)
    both, cpu = ["CUDAExecutionProvider", "CPUExecutionProvider"], ["CPUExecutionProvider"]
    assert [encoders.choose_device(both, d) for d in ("auto", "cpu", "cuda")] == [both, cpu, both] and encoders.choose_device(cpu) == cpu
    for have, wanted in ((cpu, "cuda"), (both, "tpu")):
        with pytest.raises(encoders.EncoderError):
            encoders.choose_device(have, wanted)
    assert encoders.self_test(np.array([0.9, 0.8]), np.array([0.7])) and not encoders.self_test(np.array([0.9, 0.6]), np.array([0.7]))
    assert np.allclose(np.linalg.norm(encoders.unit_rows(np.array([[3.0, 4.0], [1.0, 0.0]])), axis=1), 1)
    for bad in ([[0.0, 0.0]], [[np.nan, 1.0]]):
        with pytest.raises(encoders.EncoderError):
            encoders.unit_rows(np.array(bad))


def test_encoding_crosses_arrow_batches_with_one_session_a_task(spark, tmp_path):
    log = str(tmp_path)

    def session():
        open(f"{log}/session-{os.getpid()}-{random.random()}", "w").close()

        def model(rows):
            open(f"{log}/call-{len(rows)}-{random.random()}", "w").close()
            return np.stack([rows, np.ones(len(rows))], 1)

        return model

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(100, numPartitions=2).select("id", F.when(F.col("id") % 10 != 3, F.col("id").cast("string")).alias("t"), F.lit(1).alias("vector_"))
        got = {r.id: r.vector for r in encoders.encode(df, "t", lambda values: np.array([float(v) for v in values]), session, batch=16).collect()}
        none = encoders.encode(df.filter("t IS NULL"), "t", lambda values: None, session, batch=16).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    names = os.listdir(log)
    assert sum(n.startswith("session") for n in names) == 2
    assert sorted(int(n.split("-")[1]) for n in names if n.startswith("call")) == sorted([16, 16, 13] * 2)
    assert len(got) == 100 and all((got[k] is None) == (k % 10 == 3) for k in got)
    assert all(abs(v[0] / v[1] - k) < 1e-2 * (k + 1) for k, v in got.items() if v) and [r.vector for r in none] == [None] * 10
    short = encoders.encode(df, "t", lambda v: np.array([1.0]), lambda: lambda rows: np.ones((1, 2)), batch=16)
    with pytest.raises(Exception, match="1 vectors for 16 rows"):
        short.collect()


@pytest.mark.parametrize("plain", ["é", "Người mặc áo đỏ", "naïve “quotes” – € 100", "日本語", "😀 a", "ß ü ñ", "plain", ""])
def test_mangled_text_is_mended_however_often(plain):
    pages = {"latin-1": lambda b: b.decode("latin-1"), "cp1252": lambda b: "".join(bytes([x]).decode("cp1252", "replace").replace("�", chr(x)) for x in b)}
    for first in pages.values():
        once = first(plain.encode())
        assert text.unmangled(once) == plain
        for second in pages.values():
            assert text.unmangled(second(once.encode())) == plain and text.unmangled(f"ok {second(once.encode())} ok") == f"ok {plain} ok"


def test_text_that_is_not_mangled_stays():
    for plain in ("Ã", "à la carte", "Â", "«é»", "naïve", "£5", "İstanbul", "ÃÃÃ", "a\x80b"):
        assert text.unmangled(plain) == plain


def test_canonical_forms(spark):
    cases = {"  A_b-C!  ": "a bc", "&amp;lt;x&gt;": "x", "cafÃ©": "café", " a b\n": "a b", "...": "", "&eacute;&#233;": "éé"}
    assert {k: text.canonical_str(k) for k in cases} == cases
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    assert {r.t: r.c for r in df.select("t", text.canonical_text(F.col("t"), every_entity=True).alias("c")).collect()} == {**cases, None: None}


def test_a_file_that_cannot_be_read_is_a_row(spark, tmp_path):
    for name in ("b.bin", "a.bin", "c.bin", "d.txt"):
        (tmp_path / name).write_bytes(name.encode())
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "e.bin").write_bytes(b"e")
    files = tables.read_files_or_errors(spark, str(tmp_path), "*.bin")
    (tmp_path / "b.bin").unlink()
    got = [(os.path.basename(r.path), r.content and bytes(r.content), (r.error or "").split("file:")[0], r.length) for r in files.collect()]
    assert got == [("a.bin", b"a.bin", "", 5), ("b.bin", None, "cannot read ", 5), ("c.bin", b"c.bin", "", 5)]


@pytest.mark.parametrize("sizes", [[1], [3, 1], [6, 2, 3, 25, 15, 16, 15, 5, 7, 13, 11, 15, 8, 4, 5, 8, 6, 3, 5, 12, 16]])
def test_places_of_the_vector(spark, sizes):
    parts = taxonomy.slices_of([(f"a{k}", "single", s) for k, s in enumerate(sizes)])
    want = [(s.name, k) for s in parts for k in range(s.size)]
    found = taxonomy.place_of(F.col("id"), [s.start for s in parts], [s.name for s in parts], len(want))
    got = spark.range(-2, len(want) + 2).select("id", found.alias("f")).orderBy("id").collect()
    assert [r.f and tuple(r.f) for r in got] == [None, None, *want, None, None]
