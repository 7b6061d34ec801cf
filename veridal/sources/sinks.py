"""Writers: line-JSON, CSV, partitioned tables, and single small files put in place at once."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridal.functions import jsons
from veridal.operators.telemetry import run_summary

BOM = "﻿"


def append_json_lines(df: DataFrame, path: str) -> None:
    """Append compact lines, null fields included; a task's lines appear when it commits."""
    df.select(jsons.compact_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def append_commit(df: DataFrame, path: str, run: str) -> bool:
    """Append line-JSON as the commit ``run``; whether it was written now.

    A commit's rows count once its folder has Spark's ``_SUCCESS``, which comes
    after all tasks have committed theirs. A commit that is there is not written
    again, and what a killed attempt has left is replaced, so a run that is started
    again appends each row once.
    """
    if run in committed_runs(df.sparkSession, path):
        return False
    df.select(jsons.compact_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{path}/{run}")
    return True


def committed_runs(spark: SparkSession, path: str) -> list[str]:
    """The names of the commits below ``path``, in order."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, "*/_SUCCESS"))
    return sorted(s.getPath().getParent().getName() for s in done or [])


def read_commits(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all commits below ``path``; of attempts that were not committed, none."""
    found = [f"{path}/{run}" for run in committed_runs(spark, path)]
    return spark.read.schema(schema).json(found) if found else spark.createDataFrame([], schema)


def write_new(df: DataFrame, path: str) -> None:
    """Write Parquet; fails if there is anything."""
    df.write.mode("errorifexists").parquet(path)


def write_by(df: DataFrame, path: str, column: str) -> None:
    """One folder for each value of ``column``."""
    df.repartition(column).write.mode("overwrite").partitionBy(column).parquet(path)


def blanks_for_nulls(df: DataFrame) -> DataFrame:
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV parts with a header; nulls become blanks."""
    blanks_for_nulls(df).write.mode("overwrite").options(header=True, quote='"', escape='"', emptyValue="").csv(path)


def replace_file(path: str, text: str, mode: int = 0o644) -> None:
    """Write a small local file so that readers see the old or the new one whole."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.chmod(name, mode)
        os.replace(name, target)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def write_small_csv(df: DataFrame, path: str, most_rows: int = 100_000, bom: bool = True) -> None:
    """One CSV file with a byte-order mark, for reports; more rows than the bound are an error."""
    import csv
    import io

    rows = blanks_for_nulls(df).limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"more than {most_rows} rows for one file")
    out = io.StringIO()
    writer = csv.writer(out)
    writer.writerow(df.columns)
    writer.writerows(rows)
    replace_file(path, (BOM if bom else "") + out.getvalue())


def markdown_table(df: DataFrame, most_rows: int = 1000) -> str:
    """A small frame as a Markdown table; more rows than the bound are an error."""
    rows = blanks_for_nulls(df).limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"more than {most_rows} rows for one table")
    lines = [df.columns, ["---"] * len(df.columns), *rows]
    return "\n".join("| " + " | ".join(str(x).replace("|", "\\|") for x in line) + " |" for line in lines)


def write_run(rows: DataFrame, folder: str, overwrite: bool = False) -> dict:
    """Write a run's ``predictions`` as line-JSON and then its ``summary``, which is also given back.

    A folder with predictions is left alone and an error, unless ``overwrite``. An
    old summary goes first and the new one, counted from the written rows, comes
    last, so a run that was stopped has none.
    """
    spark = rows.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path(f"{folder}/predictions")) and not overwrite:
        raise FileExistsError(f"{folder} has a run already")
    fs.delete(path(f"{folder}/summary"), True)
    rows.select(jsons.compact_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{folder}/predictions")
    summary = run_summary(spark.read.schema(rows.schema).json(f"{folder}/predictions")).first()
    spark.createDataFrame([summary], run_summary(rows).schema).coalesce(1).write.option("ignoreNullFields", False).json(f"{folder}/summary")
    return summary.asDict(recursive=True)


def write_npy(df: DataFrame, column: str, path: str, order: str, most_rows: int = 1_000_000) -> int:
    """Vectors of one length as a local ``.npy`` file of float32, a line a row by ``order``; the number of rows.

    Partitions pass one by one; more rows than the bound, nulls, and vectors of
    another length are errors. Large tables of vectors belong in Parquet.
    """
    rows = df.select(column, order).orderBy(order).select(column)
    n, least, most, nulls = rows.agg(F.count("*"), F.min(F.size(column)), F.max(F.size(column)), F.count_if(F.col(column).isNull())).first()
    if n > most_rows or nulls or (n and least != most):
        raise ValueError(f"{n} rows, {nulls} without a vector, of {least} to {most} numbers, for one file")
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    draft = target.with_name(f".{target.name}.{os.getpid()}.draft")
    try:
        with draft.open("wb") as f:
            np.lib.format.write_array_header_1_0(f, {"descr": "<f4", "fortran_order": False, "shape": (n, most or 0)})
            for row in rows.toLocalIterator():
                f.write(np.asarray(row[0], "<f4").tobytes())
        draft.replace(target)
    finally:
        draft.unlink(missing_ok=True)
    return n
