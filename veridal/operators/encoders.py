"""Image and text encoders as Arrow operators over injected sessions.

A session is made once a task by a factory that the caller passes, so a model file
is read where it is used. Pillow is needed for ``fit_image`` and ``pixels`` only
and is asked for when they are called.
"""

from __future__ import annotations

import io
from collections import deque
from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veridal.functions.text import canonical_str

#: Fixed values of the image tower: size, and mean and deviation of a channel.
HEIGHT, WIDTH, MEAN, DEVIATION = 384, 128, 0.5, 0.5
#: Fixed values of the text tower: ids a text, its end and its filling.
CONTEXT, END_ID, PAD_ID = 64, 1, 0
BATCH = 16
#: Fixed values of images that are sent: bytes, qualities, and the longer side.
MOST_JPEG_BYTES, FIRST_QUALITY, LEAST_QUALITY, MOST_SIDE, LEAST_SIDE = 60_000, 88, 50, 1280, 224

Session = Callable[[np.ndarray], np.ndarray]


class EncoderError(ValueError):
    """Input or output that an encoder refuses."""


#: Channels that an array of pixels may have, and which of them become red, green and blue.
_CHANNELS = {1: [0, 0, 0], 3: [0, 1, 2], 4: [0, 1, 2]}
#: How far floating pixels may leave 0..1 by rounding.
_SLACK = 1e-6


def as_rgb(array: np.ndarray) -> np.ndarray:
    """Pixels as height x width x 3 bytes.

    Taken are grey (also without a channel axis), colour, and colour with alpha,
    which is dropped, as bytes or as floats. Floats mean 0..1: any that lies
    outside or is not a number is refused, as it tells another scale.
    """
    deep = np.atleast_3d(array) if array.ndim == 2 else array
    picked = _CHANNELS.get(deep.shape[-1]) if deep.ndim == 3 else None
    if picked is None or not deep.size:
        raise EncoderError(f"not an image: shape {array.shape}")
    rgb = deep[..., picked]
    if rgb.dtype.kind == "f":
        if not (rgb.min() >= -_SLACK and rgb.max() <= 1 + _SLACK):
            raise EncoderError("floating pixels must lie in 0..1")
        rgb = np.rint(rgb.clip(0, 1) * 255).astype(np.uint8)
    if rgb.dtype != np.uint8:
        raise EncoderError(f"not an image: {array.dtype}")
    return np.ascontiguousarray(rgb)


def tower_input(rgb: np.ndarray) -> np.ndarray:
    """Pixels of the tower's size as a 3 x height x width array of half floats."""
    if rgb.shape != (HEIGHT, WIDTH, 3):
        raise EncoderError(f"resize to {HEIGHT} x {WIDTH} first")
    scaled = (rgb.astype(np.float32) / np.float32(255) - np.float32(MEAN)) / np.float32(DEVIATION)
    return np.ascontiguousarray(scaled.transpose(2, 0, 1), np.float16)


def pixels(data: bytes, box: Sequence[int] | None = None) -> np.ndarray:
    """An image file, upright, cut to a pixel box, resized and scaled for the tower."""
    from PIL import Image, ImageOps

    image = Image.open(io.BytesIO(data))
    image = (ImageOps.exif_transpose(image) or image).convert("RGB")
    image = image if box is None else image.crop(tuple(box))
    return tower_input(np.asarray(image.resize((WIDTH, HEIGHT), Image.Resampling.BICUBIC)))


def fit_image(encode: Callable[[int, tuple[int, int]], bytes], size: tuple[int, int], most_bytes: int = MOST_JPEG_BYTES) -> bytes:
    """The first of ``encode(quality, (width, height))`` that is small enough.

    The longer side starts at ``MOST_SIDE`` at most. Quality goes down to
    ``LEAST_QUALITY`` first and stays there; then both sides shrink by a fifth as
    long as the longer one is over ``LEAST_SIDE``.
    """
    scale = min(1.0, MOST_SIDE / max(size))
    width, height = (max(1, round(v * scale)) for v in size)
    quality = FIRST_QUALITY
    while len(data := encode(quality, (width, height))) > most_bytes:
        if quality > LEAST_QUALITY:
            quality -= 10
        elif max(width, height) > LEAST_SIDE:
            width, height = max(1, width * 4 // 5), max(1, height * 4 // 5)
        else:
            raise EncoderError(f"the image does not fit {most_bytes} bytes")
    return data


def token_rows(texts: Sequence[str], tokenizer: object, context: int = CONTEXT, end_id: int = END_ID, pad_id: int = PAD_ID, canonical: Callable[[str], str] = canonical_str) -> np.ndarray:
    """Ids of the canonical texts, as the tokenizer cuts and fills them.

    Refused are: no texts, what is no text, a text of which nothing is left when
    canonical, ids of another number than ``context``, and ids without ``end_id``,
    which tells that the tokenizer is another one or has cut the end off.
    """
    if not texts:
        raise EncoderError("no texts")
    known = {"<pad>": pad_id, "<eos>": end_id}
    if hasattr(tokenizer, "token_to_id") and {t: tokenizer.token_to_id(t) for t in known} != known:
        raise EncoderError("the tokenizer has other special ids")
    out = np.empty((len(texts), context), np.int64)
    for row, text in zip(out, texts, strict=True):
        if not isinstance(text, str):
            raise EncoderError(f"not a text: {type(text).__name__}")
        plain = canonical(text)
        if not plain:
            raise EncoderError(f"{text!r} is empty when canonical")
        ids = list(tokenizer.encode(plain).ids)
        if len(ids) != context:
            raise EncoderError(f"the tokenizer gave {len(ids)} ids, not {context}")
        if end_id not in ids:
            raise EncoderError(f"the ids of {text!r} have no end")
        row[:] = ids
    return out


def check_contract(declared: Mapping[str, tuple[str, Sequence[int | str]]], wanted: Mapping[str, tuple[str, Sequence[int | None]]]) -> None:
    """That a model's inputs or outputs have these names, types and sizes; None and named sizes are free."""
    if set(declared) != set(wanted):
        raise EncoderError(f"the model has {sorted(declared)}, not {sorted(wanted)}")
    for name, (kind, shape) in wanted.items():
        got_kind, got = declared[name]
        free = len(got) == len(shape) and all(w is None or isinstance(g, str) or g == w for g, w in zip(got, shape, strict=False))
        if got_kind != kind or not free:
            raise EncoderError(f"{name} is {got_kind}{list(got)}, not {kind}{list(shape)}")


def choose_device(available: Sequence[str], wanted: str = "auto") -> list[str]:
    """Execution providers for a device: ``cpu``, ``cuda``, or whichever there is."""
    gpu = "CUDAExecutionProvider" in available
    if wanted not in ("auto", "cpu", "cuda"):
        raise EncoderError(f"no such device: {wanted}")
    if wanted == "cuda" and not gpu:
        raise EncoderError("there is no GPU provider")
    return ["CUDAExecutionProvider", "CPUExecutionProvider"] if gpu and wanted != "cpu" else ["CPUExecutionProvider"]


def onnx_session(path: str, device: str = "auto", threads: int | None = None, inputs: Mapping | None = None, outputs: Mapping | None = None) -> Session:
    """A model file of one input, opened on a device, as a function; its names, types and sizes are checked if given."""
    import onnxruntime

    if not Path(path).is_file():
        raise EncoderError(f"no model at {path}")
    if threads is not None and threads < 1:
        raise EncoderError("a session has one thread at least")
    options = onnxruntime.SessionOptions()
    if threads is not None:
        options.intra_op_num_threads = threads
    providers = choose_device(onnxruntime.get_available_providers(), device)
    try:
        model = onnxruntime.InferenceSession(path, sess_options=options, providers=providers)
    except Exception as e:  # the library has many kinds
        raise EncoderError(f"cannot load {Path(path).name}: {type(e).__name__}: {e}") from e
    for wanted, found in ((inputs, model.get_inputs()), (outputs, model.get_outputs())):
        if wanted is not None:
            check_contract({f.name: (f.type, f.shape) for f in found}, wanted)
    name = model.get_inputs()[0].name
    return lambda array: model.run(None, {name: array})[0]


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; a row that has none, or is not finite, is refused."""
    vectors = np.asarray(vectors, np.float32)
    sizes = np.linalg.norm(vectors, axis=1, keepdims=True)
    if not np.isfinite(vectors).all() or (sizes < 1e-12).any():
        raise EncoderError("the model gave a vector without a direction")
    return vectors / sizes


def _taken(values: Iterator[tuple[list, int, object]], most: int) -> Iterator[list[tuple[list, int, object]]]:
    while some := list(islice(values, most)):
        yield some


def encode(df: DataFrame, column: str, prepare: Callable[[Sequence[object]], np.ndarray], session: Callable[[], Session], batch: int = BATCH, name: str = "vector") -> DataFrame:
    """``df`` with ``name``, the unit vector of ``column``, null for null.

    ``session`` runs once a task, and not for a task without values. ``batch`` rows
    go through the model at a time, also across the Arrow batches they come in;
    only a task's last call may have fewer.
    """
    if batch < 1:
        raise EncoderError("a batch has one row at least")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != name) + f", `{name}` array<float>"
    names = [c for c in df.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: deque[tuple[pa.RecordBatch, list]] = deque()

        def values() -> Iterator[tuple[list, int, object]]:
            for b in batches:
                out: list[list[float] | None] = [None] * b.num_rows
                held.append((b, out))
                yield from ((out, i, v) for i, v in enumerate(b.column(column).to_pylist()) if v is not None)

        def whole(b: pa.RecordBatch, out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out, pa.list_(pa.float32()))], names=[*names, name])

        model: Session | None = None
        for some in _taken(values(), batch):
            model = model or session()
            vectors = unit_rows(model(prepare([v for *_, v in some])))
            if len(vectors) != len(some):
                raise EncoderError(f"{len(vectors)} vectors for {len(some)} rows")
            for (out, i, _), v in zip(some, vectors.tolist(), strict=True):
                out[i] = v
            while held and held[0][1] is not some[-1][0]:  # nothing in these is open any more
                yield whole(*held.popleft())
        while held:
            yield whole(*held.popleft())

    return df.mapInArrow(run, schema)


def self_test(similar: np.ndarray, unrelated: np.ndarray) -> bool:
    """Whether every pair that means the same is closer than every unrelated one."""
    return bool(np.min(similar) > np.max(unrelated))
