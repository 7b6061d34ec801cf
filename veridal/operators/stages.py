"""Stage workflows over an injected model.

A stage renders a prompt, calls ``model(prompts) -> texts`` once an Arrow batch,
validates, and leaves ``{value, error}`` for every row, so a row is never lost. If
a call for many rows raises, each row is called for by itself, so that one bad row
costs no other. With several ``workers`` a task has that many calls of one row each
open, takes the next row when one is done, and passes rows on as they are done.
Model calls are not repeatable, so each stage's result is written to the shared
checkpoint folder before the next stage reads it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridal.functions.text import trim_u

Model = Callable[[list[str]], list[str]]

#: Used only where the session names no folder and runs in local mode.
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints"


@dataclass(frozen=True)
class Stage:
    """``prompt`` renders the input; ``valid`` says whether an answer is fit.

    ``valid`` gets the answer and then the row's values of the columns ``beside``,
    so that an answer can be held against what other stages have said.
    """

    name: str
    prompt: Callable[[DataFrame], Column]
    model: Model
    valid: Callable[..., bool] = lambda text: bool(text and text.strip())
    attempts: int = 1
    beside: Sequence[str] = ()
    refused: str = "invalid answer"
    workers: int = 1


def settled(df: DataFrame) -> DataFrame:
    """``df``, computed once and read from the shared checkpoint folder from then on."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if found is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(found or LOCAL_CHECKPOINTS)
    return df.checkpoint()


def _answers(model: Model, prompts: list[str]) -> list[tuple[str | None, str | None]]:
    """An answer or an error for each prompt."""
    try:
        answers = model(prompts)
        if len(answers) != len(prompts):
            raise ValueError(f"{len(answers)} answers to {len(prompts)} prompts")
        return [(a, None) for a in answers]
    except Exception as e:  # noqa: BLE001 - a failing model call becomes the row's error
        if len(prompts) == 1:
            return [(None, str(e) or type(e).__name__)]
        return [x for p in prompts for x in _answers(model, [p])]


def bounded_calls(items: Iterable, work: Callable, workers: int) -> Iterator:
    """Results as they are done; no more than ``workers`` items are open at once.

    An item is taken only when a worker is free for it, so a slow consumer or slow
    work holds the input back. A call that raises ends the iteration.
    """
    if workers < 1:
        raise ValueError("there must be at least one worker")
    waiting = iter(items)
    with ThreadPoolExecutor(workers) as pool:
        running = {pool.submit(work, i) for i in islice(waiting, workers)}
        while running:
            done, running = wait(running, return_when=FIRST_COMPLETED)
            for d in done:
                yield d.result()
            running |= {pool.submit(work, i) for i in islice(waiting, workers - len(running))}


def _judged(stage: Stage, rows: list[tuple[str, tuple]]) -> list[tuple[str | None, str | None]]:
    """An answer or an error for each ``(prompt, values beside)``; what fails is asked again while attempts are left."""
    out: list[tuple[str | None, str | None]] = [(None, None)] * len(rows)
    left = list(range(len(rows)))
    for _ in range(stage.attempts):
        if not left:
            break
        for i, (a, e) in zip(left, _answers(stage.model, [rows[i][0] for i in left]), strict=True):
            good = e is None and stage.valid(a, *rows[i][1])
            out[i] = (a, None) if good else (None, f"{stage.name}: {e or stage.refused}")
        left = [i for i in left if out[i][1] is not None]
    return out


#: Rows that a task with several workers gathers before it passes them on.
_PASSED_ON = 64


def call(df: DataFrame, stage: Stage) -> DataFrame:
    """``df`` with ``<name>`` (text or null) and ``error`` kept from before or set here."""
    name = stage.name

    def beside(f: pd.DataFrame, i: int) -> tuple:
        return tuple(f[c].iloc[i] for c in stage.beside)

    def finished(f: pd.DataFrame, results: dict[int, tuple[str | None, str | None]]) -> pd.DataFrame:
        out = f.iloc[list(results)].drop(columns="prompt_")
        out[name], out["error"] = [r[0] for r in results.values()], [r[1] for r in results.values()]
        return out

    def by_frame(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            results = {i: (None, e) for i, e in enumerate(f["error"])}
            asked = [i for i, (_, e) in results.items() if e is None]
            results |= zip(asked, _judged(stage, [(f["prompt_"].iloc[i], beside(f, i)) for i in asked]), strict=True)
            yield finished(f, results)

    def by_worker(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(item: tuple[pd.DataFrame, int]) -> pd.DataFrame:
            f, i = item
            error = f["error"].iloc[i]
            return finished(f, {i: (None, error) if error is not None else _judged(stage, [(f["prompt_"].iloc[i], beside(f, i))])[0]})

        ready: list[pd.DataFrame] = []
        for row in bounded_calls(((f, i) for f in frames for i in range(len(f))), one, stage.workers):
            ready.append(row)
            if len(ready) == _PASSED_ON:
                yield pd.concat(ready)
                ready = []
        if ready:
            yield pd.concat(ready)

    run = by_frame if stage.workers == 1 else by_worker
    rows = df if "error" in df.columns else df.withColumn("error", F.lit(None).cast("string"))
    rows = rows.withColumn("prompt_", stage.prompt(rows))
    schema = rows.drop("prompt_").withColumn(name, F.lit(None).cast("string")).schema
    schema = [f for f in schema if f.name not in ("error", name)] + [f for f in schema if f.name in ("error", name)]
    ordered = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return settled(rows.mapInPandas(lambda it: (f[[s.name for s in schema]] for f in run(it)), ordered))


def flow(df: DataFrame, stages: Sequence[Stage]) -> DataFrame:
    """Stages one after another; a row that failed passes through."""
    for s in stages:
        df = call(df, s)
    return df.withColumn("status", F.when(F.col("error").isNull(), "success").otherwise("error"))


def fan_out(df: DataFrame, stage: Stage, focuses: Sequence[str]) -> DataFrame:
    """The stage once per focus, answers gathered in the focuses' order.

    Rows are numbered for it, so every row comes back once, whatever its ids are.
    """
    numbered = settled(df.withColumn("row_", F.monotonically_increasing_id()))
    asked = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(f).alias("focus")) for k, f in enumerate(focuses)])
    wide = numbered.withColumn("asked_", F.explode(asked)).withColumn("focus", F.col("asked_.focus")).withColumn("place_", F.col("asked_.place")).drop("asked_")
    done = call(wide, stage)
    answers = F.transform(F.array_sort(F.collect_list(F.struct("place_", stage.name))), lambda x: x[stage.name])
    gathered = done.groupBy("row_").agg(answers.alias(f"{stage.name}s"), F.min("error").alias("error"))
    return numbered.drop("error").join(gathered, "row_").drop("row_")


def refine(df: DataFrame, round_stages: Sequence[Stage], accepted: Column, most_rounds: int, feedback: Column, exhausted: str) -> DataFrame:
    """Rounds of stages over the rows that no round has accepted yet.

    A row leaves with ``workflow_status`` *accepted*, with ``exhausted`` and its last
    draft after the last round, or with its error.
    """
    empty = df.withColumn("feedback", F.lit(None).cast("string")).withColumn("error", F.lit(None).cast("string"))
    waiting, finished = empty, []
    names = [s.name for s in round_stages]
    for k in range(most_rounds):
        for s in round_stages:
            waiting = call(waiting, s)
        ok = F.coalesce(accepted, F.lit(False)) & F.col("error").isNull()
        marked = waiting.withColumn("workflow_status", F.when(F.col("error").isNotNull(), "error").when(ok, "accepted").otherwise(F.lit(exhausted))).withColumn("rounds", F.lit(k + 1))
        last = k + 1 == most_rounds
        finished.append(marked if last else marked.filter(F.col("workflow_status") != exhausted))
        waiting = marked.filter(F.col("workflow_status") == exhausted).withColumn("feedback", feedback).drop("workflow_status", "rounds", *names)
        if last or waiting.isEmpty():
            break
    out = finished[0]
    for f in finished[1:]:
        out = out.unionByName(f)
    return out


def prediction_rows(df: DataFrame, method: str, model_id: str, prompt_version: str, caption: Column, attributes: Column) -> DataFrame:
    """Flat prediction records; captions only for successes, errors as ``struct(code, message)``."""
    ok = F.col("status") == "success"
    code = F.replace(F.lower(F.split("error", ":").getItem(0)), F.lit(" "), F.lit("_"))
    return df.select(
        "sample_id", F.lit(method).alias("method"), F.lit(model_id).alias("model_id"), F.lit(prompt_version).alias("prompt_version"), "status",
        F.when(ok, trim_u(caption)).alias("caption"), F.when(ok, attributes).alias("attributes"), F.when(~ok, F.struct(code.alias("code"), F.col("error").alias("message"))).alias("error"),
    )
