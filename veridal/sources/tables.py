"""Readers: delimited text, line-JSON with positions, JSON documents, files.

Positions matter: in an append-only log the later line wins. They are taken at
the scan (file, start of its split, row within it), where they still exist.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridal.functions import jsons


class DataError(ValueError):
    """Input that a strict reader refuses."""


def require_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise DataError(f"missing columns: {', '.join(missing)}")
    return df


def read_delimited(spark: SparkSession, path: str, sep: str = "\t", wanted: Sequence[str] = (), multi_line: bool = True) -> DataFrame:
    """All columns as text, header required; quoted line breaks unless ``multi_line`` is off; a byte-order mark is dropped."""
    df = spark.read.options(sep=sep, header=True, multiLine=multi_line, escape='"', quote='"', inferSchema=False).csv(path)
    if not df.columns:
        raise DataError(f"no header in {path}")
    return require_columns(df, wanted)


def with_position(lines: DataFrame) -> DataFrame:
    """``value`` with ``position``: an array that orders lines by file and place."""
    return lines.select(
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("position"),
        "value",
    )


def read_json_lines(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """``position``, ``value`` and ``ok`` (a JSON object) of every line that is not blank."""
    reader = spark.read if glob is None else spark.read.option("pathGlobFilter", glob)
    lines = with_position(reader.text(paths)).filter(F.col("value").rlike(r"(?U)\S"))
    return lines.withColumn("ok", jsons.is_object(F.col("value")))


def parse_json_lines(lines: DataFrame, schema: T.StructType, strict: bool = True) -> DataFrame:
    """Fields of each line and its ``position``; a bad line is an error, or is left out if not ``strict``."""
    good = lines.filter("ok") if not strict else lines.withColumn(
        "value", F.when(F.col("ok"), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not a JSON object in "), F.col("position.file"))))
    )
    return good.select("position", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).select("position", "r.*")


def read_json_map(spark: SparkSession, path: str, value: T.DataType, field: str, version: str | None = None) -> DataFrame:
    """``key``, ``value`` of an object map in a JSON document; another version gives no rows."""
    document = T.StructType([T.StructField("schema_version", T.StringType()), T.StructField(field, T.MapType(T.StringType(), value))])
    df = spark.read.option("wholetext", True).text(path).select(F.from_json("value", document).alias("d")).select("d.*")
    if version is not None:
        df = df.filter(F.col("schema_version") == version)
    return df.select(F.explode(field))


def read_attribute_schema(spark: SparkSession, path: str, attributes: int = 21) -> DataFrame:
    """``position``, ``name``, ``kind``, ``classes`` of an attribute schema document; fails on another number."""
    df = spark.read.option("multiLine", True).json(path).select(F.posexplode("attributes").alias("position", "a"))
    df = df.select("position", "a.name", F.col("a.type").alias("kind"), "a.classes")
    return df.withColumn("position", F.when(F.lit(attributes) == df.groupBy().count().scalar(), F.col("position")).otherwise(F.raise_error(F.lit("unexpected number of attributes"))))


def read_files(spark: SparkSession, path: str, recursive: bool = False, glob: str | None = None) -> DataFrame:
    """``path``, ``length``, ``sha256``, ``content`` of files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    reader = reader if glob is None else reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "length", F.sha2("content", 256).alias("sha256"), "content")


def listed_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path`` and ``length`` of the files right in a folder, as the driver lists them, in order."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, glob))
    rows = sorted((s.getPath().toString(), s.getLen()) for s in found or [] if s.isFile())
    return spark.createDataFrame(rows, "path string, length long")


def read_files_or_errors(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path``, ``length``, ``sha256``, ``content``, ``error`` of the files right in a folder, by path.

    The folder is listed first, without opening a file; a file of the list that
    cannot be read then is a row with an ``error`` and no content.
    """
    listed = listed_files(spark, path, glob)
    reader = spark.read.format("binaryFile").options(pathGlobFilter=glob, recursiveFileLookup=False, ignoreMissingFiles=True, ignoreCorruptFiles=True)
    out = listed.join(reader.load(path).select("path", "content"), "path", "left")
    error = F.when(F.col("content").isNull(), F.concat(F.lit("cannot read "), F.col("path")))
    return out.select("path", "length", F.sha2("content", 256).alias("sha256"), "content", error.alias("error")).orderBy("path")


def resolved_path(path: F.Column) -> F.Column:
    """A path without ``.``, empty and ``..`` segments, as far as they can go; a path of nothing is ``.``.

    A fold over the segments keeps a stack: ``..`` takes the last one off unless
    that is itself ``..``, and goes nowhere from the root. Two slashes at the
    start, and not three, stay two.
    """
    rooted = path.startswith("/")
    empty = F.array().cast("array<string>")

    def step(stack: F.Column, segment: F.Column) -> F.Column:
        last = F.try_element_at(stack, F.lit(-1))
        back = F.when(last.isNull() & rooted, stack).when(last.isNull() | (last == ".."), F.array_append(stack, "..")).otherwise(F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0))))
        return F.when(segment.isin("", "."), stack).when(segment == "..", back).otherwise(F.array_append(stack, segment))

    inner = F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/")
    start = F.when(path.startswith("//") & ~path.startswith("///"), "//").when(rooted, "/").otherwise("")
    return F.coalesce(F.nullif(F.concat(start, inner), F.lit("")), F.when(path.isNotNull(), "."))


def stays_below(path: F.Column, root: str) -> F.Column:
    """Whether a path, taken from ``root`` if it is relative, leads to ``root`` or below it."""
    base = root.rstrip("/")
    whole = resolved_path(F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base + "/"), path)))
    return (whole == (base or "/")) | whole.startswith(base + "/")


def safe_relative_path(path: F.Column) -> F.Column:
    """Whether a path stays below its root."""
    return ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..") & ~path.contains("\\") & (path != "")


def manifest_mismatches(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Names of ``manifest`` (name, bytes, sha256) whose file is absent or differs."""
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("found_bytes"), F.col("sha256").alias("found_sha"))
    same = F.col("bytes").eqNullSafe(F.col("found_bytes")) & F.col("sha256").eqNullSafe(F.col("found_sha"))
    return manifest.join(named, "name", "left").filter(~same).select("name")
