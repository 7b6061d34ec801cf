"""Streaming twins of the batch operators, and a request limiter."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_of(spark: SparkSession, path: str, schema: T.StructType, glob: str = "*.parquet", files_a_batch: int = 100) -> DataFrame:
    """Parquet files as they arrive below ``path``."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def utc(df: DataFrame, ts: str) -> DataFrame:
    """A zoneless time column as a timestamp of the session's zone, which watermarks need."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def latest_stream(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """Keep-latest for update or complete mode; the state is one row a key."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(order, *values), F.col(order)).alias("r")).select(*keys, "r.*")


def case_counters_stream(df: DataFrame, keys: Sequence[str], attempt: str, failed: str) -> DataFrame:
    """Requests, retries and errors of each case as events come."""
    return df.groupBy(*keys).agg(F.count("*").alias("num_request"), F.count_if(F.col(attempt) > 1).alias("num_retry"), F.count_if(F.col(failed)).alias("num_error_request"))


def session_counts(df: DataFrame, ts: str, keys: Sequence[str], gap: str, late: str) -> DataFrame:
    return df.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("events")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


#: Requests that wait for the watermark, and the last start times, as two packed arrays of longs.
_ADMISSION_STATE = "waiting binary, starts binary"


def admitted(requests: np.ndarray, starts: np.ndarray, cap: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Start times of sorted ``requests``, and the last ``cap`` of all starts.

    A request starts when it is asked, but not before the one before it, and not
    before the start ``cap`` places earlier is a whole window old.
    """
    begun = [*starts.tolist()]
    first = len(begun)
    for asked in requests.tolist():
        at = max(asked, begun[-1]) if begun else asked
        if len(begun) >= cap:
            at = max(at, begun[-cap] + window)
        begun.append(at)
    return np.array(begun[first:], np.int64), np.array(begun[-cap:], np.int64)


def admission_plan(requests: DataFrame, asked: str, cap: int, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """``key``, ``request_id``, ``asked``, ``starts`` (both in microseconds) of a stream of requests with ``key`` and ``request_id``.

    A key starts at most ``cap`` requests in any ``seconds``; requests wait, none is
    turned away. They are admitted in the order of ``asked`` and ``request_id``,
    whatever chunks and micro-batches they come in: a request is kept until the
    watermark has passed it (a timer wakes the key), as earlier ones may still
    come. Requests later than ``late`` are left out, as by any watermark. The state
    of a key is its requests of the last ``late`` and ``cap`` start times.
    """
    if cap < 1:
        raise ValueError("at least one request must be let through")
    window = seconds * 1_000_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, starts = (np.frombuffer(b, np.int64) for b in state.get) if state.exists else (np.zeros(0, np.int64),) * 2
        waiting = waiting.reshape(-1, 2)
        if not state.hasTimedOut:
            waiting = np.concatenate([waiting, *(f[["asked_us", "request_id"]].to_numpy(np.int64) for f in frames)])
            waiting = waiting[np.lexsort((waiting[:, 1], waiting[:, 0]))]
        passed = state.getCurrentWatermarkMs() * 1000
        ready = int(np.searchsorted(waiting[:, 0], passed))
        begun, starts = admitted(waiting[:ready, 0], starts, cap, window)
        yield pd.DataFrame({"key": [key[0]] * ready, "request_id": waiting[:ready, 1], "asked": waiting[:ready, 0], "starts": begun})
        state.update((waiting[ready:].tobytes(), starts.tobytes()))
        if ready < len(waiting):
            state.setTimeoutTimestamp(int(waiting[ready, 0]) // 1000 + 1)

    rows = requests.select("key", "request_id", F.col(asked).alias("at_"), F.unix_micros(asked).alias("asked_us")).withWatermark("at_", late)
    return rows.groupBy("key").applyInPandasWithState(
        step, "key string, request_id long, asked long, starts long", _ADMISSION_STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


def durable_append(df: DataFrame, path: str, checkpoint: str, form: str = "json") -> StreamingQuery:
    """Append a stream's rows to files below ``path``, each row once, whatever is killed and started again.

    A batch's files count when its commit is in the folder's log, which
    ``spark.read`` follows; ``checkpoint`` says where to go on.
    """
    return df.writeStream.format(form).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
