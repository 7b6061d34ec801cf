"""Closed-world checks of JSON text: exact keys, explicit nulls, strict types.

A parse into a struct would drop unknown keys and turn wrong types into null, so
these look at the text through variants.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def variant_of(text: Column) -> Column:
    """Null if the text is not JSON."""
    return F.try_parse_json(text)


def kind_at(text: Column, path: str) -> Column:
    """Type name of the value at ``path``: ``VOID`` for an explicit null, SQL null if absent."""
    return F.schema_of_variant(F.try_variant_get(variant_of(text), path, "variant"))


def is_object(text: Column) -> Column:
    return F.coalesce(F.schema_of_variant(variant_of(text)).startswith("OBJECT"), F.lit(False))


def has_exact_keys(text: Column, keys: list[str]) -> Column:
    """Whether the object has these keys and no other."""
    return F.coalesce(F.array_sort(F.json_object_keys(text)) == F.array_sort(F.array(*[F.lit(k) for k in keys])), F.lit(False))


def is_boolean_at(text: Column, path: str, nullable: bool = False) -> Column:
    """Strict: text and numbers are not booleans; ``nullable`` lets an explicit null pass."""
    kind = kind_at(text, path)
    allowed = ["BOOLEAN", "VOID"] if nullable else ["BOOLEAN"]
    return F.coalesce(kind.isin(*allowed), F.lit(False))


def number_at(text: Column, path: str) -> Column:
    """Whole number at ``path``, null if it is none; fractions are cut off."""
    number = F.try_variant_get(variant_of(text), path, "double")
    return F.when(kind_at(text, path).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)"), number.cast("bigint"))


def token_usage(payload: Column) -> Column:
    """Prompt, completion and total tokens of a response."""
    return F.struct(*[number_at(payload, f"$.usage.{k}").alias(k) for k in ("prompt_tokens", "completion_tokens", "total_tokens")])


def response_content(payload: Column) -> Column:
    """The first choice's message if it is itself a JSON object, else null."""
    content = F.get_json_object(payload, "$.choices[0].message.content")
    return F.when(is_object(content), content)


def compact_json(value: Column) -> Column:
    """Compact text of a struct or map; null fields stay."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def is_truthy(text: Column, path: str) -> Column:
    """Whether the value at ``path`` is there and is not null, false, zero, or empty."""
    kind, value = kind_at(text, path), F.get_json_object(text, path)
    return (
        F.when(kind.isNull() | (kind == "VOID"), False)
        .when(kind == "BOOLEAN", value == "true")
        .when(kind == "STRING", value != "")
        .when(kind.startswith("ARRAY"), F.json_array_length(value) > 0)
        .when(kind.startswith("OBJECT"), F.size(F.json_object_keys(value)) > 0)
        .otherwise(value.cast("double") != 0)
    )
