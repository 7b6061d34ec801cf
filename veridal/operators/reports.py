"""The evaluation report: its tables, and their text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridal.functions.text import NO_RATE
from veridal.operators import joins, stats
from veridal.sources.sinks import markdown_table


def evaluation_tables(rows: DataFrame, fields: DataFrame, methods: Sequence[str], corrected: DataFrame) -> dict[str, DataFrame]:
    """The report's tables from latest evaluation rows.

    ``rows`` has ``method``, ``sample_id``, ``status``, ``error_code``,
    ``caption_correct``, ``latency_ms`` and ``checks`` (a map by field); ``fields``
    has ``position`` and ``field``; ``corrected`` has ``method`` and the counts of
    corrections. Methods are compared on the samples that all of them have done.
    """
    ok = F.col("status") == "success"
    mine = rows.filter(F.col("method").isin(*methods))
    done = mine.filter(ok)
    long = stats.long_form(done, ["method", "sample_id"], "checks")
    detail = stats.field_detail(long, ["method"], fields)
    n = F.broadcast(done.groupBy("method").agg(F.count("*").alias("n_")))
    width = fields.agg(F.count("*").alias("fields_"))
    spread = detail.groupBy("method").agg(*[F.sum(c).alias(c) for c in ("mentioned", "correct", "incorrect")]).join(n, "method").join(F.broadcast(width))
    spread = spread.select("method", "mentioned", "correct", "incorrect", stats.rate(F.col("correct"), F.col("incorrect")).alias("rate"), F.try_divide("mentioned", F.col("n_") * F.col("fields_")).alias("coverage"))
    cohort = joins.in_every(done, "sample_id", "method", methods)
    paired = long.join(cohort, "sample_id", "left_semi").filter("mentioned").groupBy("field", "method").agg(F.count_if("is_correct").alias("correct"), F.count_if(~F.coalesce(F.col("is_correct"), F.lit(False))).alias("incorrect"))
    position = F.lit(None).cast("int")
    for i, m in enumerate(methods):
        position = F.when(F.col("method") == m, i).otherwise(position)
    paired = paired.withColumn("position_", position)
    text = stats.by_method(paired, "field", "method", methods, stats.rate_text(F.col("correct"), F.col("incorrect")))
    compared = text.join(stats.decision(paired, "field", "method", "position_"), "field").join(F.broadcast(fields), "field").na.fill(NO_RATE, list(methods))
    ends = stats.extremes(detail, "method", 3, F.lit(10))
    found = stats.finding_text(ends, "method", "weakest").join(stats.finding_text(ends, "method", "strongest"), "method", "full")
    return {
        "summary": stats.method_summary(mine, "method", ok, F.col("caption_correct"), "latency_ms").join(F.broadcast(corrected), "method", "left").na.fill(0, ["corrected_rows", "corrected_fields"]).orderBy("method"),
        "errors": stats.error_histogram(mine, "method", ~ok, F.col("error_code")).orderBy("method", "code"),
        "attributes": spread.orderBy("method"), "fields": detail.orderBy("method", "position"),
        "compared": compared.orderBy("position").drop("position"), "findings": found.orderBy("method"),
    }


def report_text(title: str, tables: Mapping[str, DataFrame], most_rows: int = 1000) -> str:
    """The tables under their names as Markdown; ends with a line break."""
    parts = [f"# {title}"]
    for name, df in tables.items():
        parts += [f"## {name.replace('_', ' ').capitalize()}", markdown_table(df, most_rows)]
    return "\n\n".join(parts) + "\n"
