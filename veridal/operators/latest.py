"""Append-only logs: the latest row of a key, keys that ever held, ordinals, rolling counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridal.functions import jsons


def keep_latest(df: DataFrame, keys: Sequence[str], order: str | Column, where: Column | None = None) -> DataFrame:
    """The last row of each key by ``order``.

    ``where`` is applied first, so that a row it leaves out never hides another.
    A window with a limit of one row a group: Spark drops older rows before the shuffle.
    """
    rows = df if where is None else df.filter(where)
    place = F.col(order) if isinstance(order, str) else order
    window = Window.partitionBy(*keys).orderBy(place.desc())
    return rows.withColumn("place_", F.row_number().over(window)).filter("place_ = 1").drop("place_")


def ever_completed(df: DataFrame, keys: Sequence[str], done: Column) -> DataFrame:
    """Keys that were done at any time, whatever came later."""
    return df.filter(done).select(*keys).distinct()


def pending(tasks: DataFrame, completed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return tasks.join(completed, list(keys), "left_anti")


def call_ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "ordinal") -> DataFrame:
    """1, 2, 3 … within each key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def rolling_count(df: DataFrame, ts: str, seconds: int, keys: Sequence[str] = (), name: str = "in_window") -> DataFrame:
    """Rows of the key in the last ``seconds``; one that is exactly that old is out."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    frame = Window.partitionBy(*keys).orderBy(micros).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return df.withColumn(name, F.count("*").over(frame))


def first_accepted_or_last(rounds: DataFrame, key: str, order: str, accepted: Column) -> DataFrame:
    """The first accepted round of each key, else its last; ``accepted_`` tells which."""
    ok = F.coalesce(accepted, F.lit(False))
    rank = F.when(ok, F.col(order)).otherwise(-F.col(order))
    window = Window.partitionBy(key).orderBy(ok.desc(), rank.asc())
    return rounds.withColumn("accepted_", ok).withColumn("place_", F.row_number().over(window)).filter("place_ = 1").drop("place_")


def prefix_offsets(df: DataFrame, position: str, size: str, name: str = "start") -> DataFrame:
    """Running sum of the sizes before each row; for dimension tables."""
    window = Window.orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(size).over(window) - F.col(size))


def _text_at(value: Column, name: str) -> Column:
    """What stands under ``name``, as text: ``null`` for a null, ``undefined`` for nothing."""
    path = f"$.{name}"
    return F.coalesce(F.get_json_object(value, path), F.when(jsons.kind_at(value, path) == "VOID", "null"), F.lit("undefined"))


def latest_reviews(lines: DataFrame, version: str = "3", methods: Sequence[str] | None = None) -> DataFrame:
    """``method``, ``sample_id``, ``value`` of the last line of each method and sample.

    ``lines`` from ``tables.read_json_lines``; one that is no object is an error,
    one of another ``evaluation_schema_version`` is passed over. With ``methods``,
    so are ids that are not text and methods that are not among them; without,
    every method counts, and ids are made text, so 7 and "7" are one sample.
    """
    broken = F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("value", 1, 80)))
    rows = lines.withColumn("value", F.when(F.col("ok"), F.col("value")).otherwise(broken))
    value = F.col("value")
    wanted = (jsons.kind_at(value, "$.evaluation_schema_version") == "STRING") & (F.get_json_object(value, "$.evaluation_schema_version") == version)
    if methods is not None:
        for name in ("method", "sample_id"):
            wanted &= jsons.kind_at(value, f"$.{name}") == "STRING"
        wanted &= F.get_json_object(value, "$.method").isin(*methods)
    found = rows.filter(wanted).select("position", _text_at(value, "method").alias("method"), _text_at(value, "sample_id").alias("sample_id"), "value")
    return keep_latest(found, ["method", "sample_id"], "position").drop("position")
