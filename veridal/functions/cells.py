"""Table cells of annotations: one code, codes joined by ``|``, ``none``, or empty.

Null, the empty list and ``["unknown"]`` are three different answers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from veridal.functions.text import trim_u

EMPTY, JOIN = "none", "|"


def decode_cell(cell: Column, multi: bool = True) -> Column:
    """'' -> null, ``none`` -> [], ``a|b`` -> [a, b]; a single-label cell stays text."""
    text = trim_u(cell)
    if not multi:
        return F.nullif(text, F.lit(""))
    return F.when(text == "", None).when(text == EMPTY, F.array().cast("array<string>")).otherwise(F.split(text, r"\|"))


def encode_cell(values: Column, multi: bool = True) -> Column:
    if not multi:
        return F.coalesce(values, F.lit(""))
    return F.when(values.isNull(), "").when(F.size(values) == 0, EMPTY).otherwise(F.array_join(values, JOIN))


def cell_violations(cell: Column, domain: list[str], multi: bool = True) -> Column:
    """What is wrong with a cell, as an array of names; empty if nothing."""
    text = trim_u(cell)
    if not multi:
        bad = [F.when((text != "") & ~text.isin(*domain), F.lit("domain"))]
    else:
        parts = F.split(text, r"\|")
        filled = (text != "") & (text != EMPTY)
        known = F.array(*[F.lit(d) for d in domain])
        bad = [
            F.when(filled & F.exists(parts, lambda p: p == ""), F.lit("empty_code")),
            F.when(filled & (F.size(F.array_distinct(parts)) < F.size(parts)), F.lit("repeated")),
            F.when(filled & F.array_contains(parts, EMPTY), F.lit("none_mixed")),
            F.when(filled & (F.size(F.array_except(parts, F.array_append(known, F.lit(EMPTY)))) > 0) & ~F.exists(parts, lambda p: p == ""), F.lit("domain")),
        ]
    return F.array_compact(F.array(*bad))


def same_answer(a: Column, b: Column) -> Column:
    """Equal as sets, null only equal to null."""
    return F.array_sort(a).eqNullSafe(F.array_sort(b))


def tool_results(attributes: Column) -> Column:
    """A map of label arrays as the results of an annotation tool: null has none, the empty list one without choices."""
    given = F.filter(F.map_entries(attributes), lambda e: e["value"].isNotNull())
    one = F.transform(given, lambda e: F.struct(e["key"].alias("from_name"), F.lit("image").alias("to_name"), F.lit("choices").alias("type"), F.struct(e["value"].alias("choices")).alias("value")))
    return F.to_json(one)


def tool_attributes(results: Column, fields: Sequence[str]) -> Column:
    """The map that ``tool_results`` was made from, with all of ``fields``; the last result of a field counts, unknown ones do not."""
    given = F.from_json(results, "array<struct<from_name: string, value: struct<choices: array<string>>>>")

    def labels(name: str) -> Column:
        return F.try_element_at(F.filter(given, lambda r: r["from_name"] == name), F.lit(-1))["value"]["choices"]

    return F.map_from_entries(F.array(*[F.struct(F.lit(f).alias("key"), labels(f).alias("value")) for f in fields]))
