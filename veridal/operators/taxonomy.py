"""The label taxonomy as a dimension table, and decoding of score vectors by it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridal.functions import scores
from veridal.functions.text import class_label
from veridal.operators.latest import prefix_offsets

#: Fixed values: (name, kind, number of classes, display tier) in the order of the score vector.
ATTRIBUTES = (
    ("age", "single", 6, "weak"), ("gender", "single", 2, "strong"), ("body_build", "single", 3, "hidden"),
    ("upper_clothing_type", "single", 25, "strong"), ("upper_clothing_color", "single", 15, "strong"),
    ("lower_clothing_type", "single", 16, "strong"), ("lower_clothing_color", "single", 15, "strong"),
    ("clothing_style", "single", 5, "hidden"), ("upper_pattern", "single", 7, "moderate"), ("footwear_type", "single", 13, "moderate"),
    ("bag_type", "multi", 11, "unvalidated"), ("bag_color", "multi", 15, "unvalidated"), ("headwear", "single", 8, "moderate"),
    ("eyewear", "single", 4, "moderate"), ("face_mask", "single", 5, "weak"), ("other_accessories", "multi", 8, "unvalidated"),
    ("hair_length", "single", 6, "strong"), ("hair_texture", "single", 3, "hidden"), ("hairstyle", "single", 5, "strong"),
    ("hair_color", "single", 12, "hidden"), ("carried_objects", "multi", 16, "unvalidated"),
)
FILTERABLE_TIERS = ("strong", "moderate", "unvalidated")
MULTI_THRESHOLD = 0.20


@dataclass(frozen=True)
class Slice:
    """The part of a score vector that belongs to one attribute."""

    name: str
    kind: str
    start: int
    size: int


def slices_of(attributes: Sequence[tuple[str, str, int]]) -> list[Slice]:
    out, at = [], 0
    for name, kind, size in attributes:
        out.append(Slice(name, kind, at, size))
        at += size
    return out


def compile_attributes(schema: DataFrame, tiers: Mapping[str, str]) -> DataFrame:
    """Attributes (``position``, ``name``, ``kind``, ``classes``) with their place in the vector, tier and gates."""
    tier = F.lit("hidden")
    for name, t in tiers.items():
        tier = F.when(F.col("name") == name, t).otherwise(tier)
    df = schema.withColumn("size", F.size("classes")).withColumn("tier", tier)
    df = prefix_offsets(df, "position", "size")
    gated = (F.col("name") == "gender") | (F.col("tier") == "moderate")
    return df.select("position", "name", "kind", "tier", "start", (F.col("start") + F.col("size")).alias("stop"), F.col("tier").isin(*FILTERABLE_TIERS).alias("filterable"), gated.alias("gated"), "classes")


def class_index(compiled: DataFrame, labels: Mapping[str, str] | None = None, patterns: Mapping[str, str] | None = None, exempt: Mapping[str, set[str]] | None = None) -> DataFrame:
    """One row per place of the vector: attribute, class, label."""
    flat = compiled.select("position", F.col("name").alias("attribute"), "start", F.posexplode("classes").alias("class_index", "code"))
    label = class_label(F.col("attribute"), F.col("code"), labels or {}, patterns or {}, exempt or {})
    return flat.select((F.col("start") + F.col("class_index")).alias("logit_index"), "attribute", "class_index", "code", label.alias("label"))


def place_of(logit_index: Column, starts: Sequence[int], names: Sequence[str], stop: int) -> Column:
    """``struct(attribute, class_index)`` of a place of the vector, null beyond it.

    ``starts`` are ascending and few, as attributes are: a binary search in them,
    by halved steps, replaces a join with every place.
    """
    offsets, n = F.array(*[F.lit(s) for s in starts]), len(starts)
    steps = [1 << k for k in range(max(1, n - 1).bit_length() - 1, -1, -1)]
    at = F.lit(0)
    for step in steps:
        at = F.when(F.get(offsets, at + step) <= logit_index, at + step).otherwise(at)
    found = F.struct(F.get(F.array(*[F.lit(x) for x in names]), at).alias("attribute"), (logit_index - F.get(offsets, at)).alias("class_index"))
    return F.when((logit_index >= starts[0]) & (logit_index < stop), found)


def taxonomy_violations(compiled: DataFrame, attributes: int, logits: int) -> DataFrame:
    """Attributes that do not tile the vector, repeat a class, or stand twice; and wrong totals."""
    expected = F.coalesce(F.sum(F.col("stop") - F.col("start")).over(Window.orderBy("position").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = F.array_compact(
        F.array(
            F.when(F.col("start") != expected, F.lit("tiling")),
            F.when(F.size(F.array_distinct("classes")) < F.size("classes"), F.lit("repeated_class")),
            F.when(F.count("*").over(Window.partitionBy("name")) > 1, F.lit("repeated_attribute")),
        )
    )
    rows = compiled.select("name", found.alias("violations")).filter(F.size("violations") > 0)
    totals = compiled.agg(F.count("*").alias("n"), F.max("stop").alias("stop")).filter((F.col("n") != attributes) | (F.col("stop") != logits))
    return rows.unionByName(totals.select(F.lit("*").alias("name"), F.array(F.lit("totals")).alias("violations")))


def document_violations(document: DataFrame, schema_version: str, model_version: str, attributes: int = 21, logits: int = 200) -> DataFrame:
    """What is wrong with a taxonomy document: versions, threshold, then each attribute; ``(name, violations)``.

    ``document`` has one row: ``schema_version``, ``model_version``,
    ``multi_threshold`` and ``attributes`` (name, kind, start, stop, classes).
    """
    head = F.array_compact(
        F.array(
            F.when(~F.col("schema_version").eqNullSafe(F.lit(schema_version)), F.lit("schema_version")),
            F.when(~F.col("model_version").eqNullSafe(F.lit(model_version)), F.lit("model_version")),
            F.when(~F.coalesce((F.col("multi_threshold") > 0) & (F.col("multi_threshold") < 1), F.lit(False)), F.lit("multi_threshold")),
            F.when(F.exists("attributes", lambda a: ~a["kind"].isin("single", "multi")), F.lit("kind")),
            F.when(F.exists("attributes", lambda a: F.size(a["classes"]) != a["stop"] - a["start"]), F.lit("size")),
        )
    )
    rows = document.select(F.lit("*").alias("name"), head.alias("violations")).filter(F.size("violations") > 0)
    flat = document.select(F.posexplode("attributes").alias("position", "a")).select("position", "a.*")
    return rows.unionByName(taxonomy_violations(flat, attributes, logits))


def prediction_map(decoded: Column, s: Slice, codes: Sequence[str], labels: Sequence[str], tier: str, label: str) -> Column:
    """One attribute's prediction as a struct for machines: codes, labels and rounded scores of what was decoded."""
    code, name = F.array(*[F.lit(c) for c in codes]), F.array(*[F.lit(x) for x in labels])
    common = [F.lit(s.name).alias("attribute"), F.lit(label).alias("attribute_label"), F.lit(s.kind).alias("type"), F.lit(tier).alias("display_tier")]
    if s.kind == "single":
        at, p = decoded["class_index"], decoded["confidence"]
        return F.struct(*common, F.array(F.get(code, at)).alias("codes"), F.array(F.get(name, at)).alias("labels"), F.array(F.bround(p, 6)).alias("scores"))
    return F.struct(
        *common, F.transform(decoded, lambda c: F.get(code, c["class_index"])).alias("codes"), F.transform(decoded, lambda c: F.get(name, c["class_index"])).alias("labels"),
        F.transform(decoded, lambda c: F.bround(c["probability"], 6)).alias("scores"),
    )


def predictions(parts: Mapping[str, Column]) -> Column:
    """``{attribute: prediction}`` in the taxonomy's order."""
    return F.map_from_entries(F.array(*[F.struct(F.lit(n).alias("key"), p.alias("value")) for n, p in parts.items()]))


def label_map(found: Column) -> Column:
    """``{attribute label: class labels}`` of ``predictions``, for people."""
    return F.map_from_entries(F.transform(F.map_values(found), lambda p: F.struct(p["attribute_label"], p["labels"])))


def part_of(vector: Column, s: Slice) -> Column:
    return F.transform(F.slice(vector, s.start + 1, s.size), lambda v: v.cast("double"))


def decode_single(vector: Column, s: Slice, codes: Sequence[str] | None = None) -> Column:
    """Best class (first of equal ones), its softmax probability, and its code if given."""
    part = part_of(vector, s)
    best = scores.first_argmax(part)
    fields = [best.alias("class_index"), scores.top_probability(part).alias("confidence")]
    if codes is not None:
        fields.append(F.get(F.array(*[F.lit(c) for c in codes]), best).alias("code"))
    return F.struct(*fields)


def decode_multi(vector: Column, s: Slice, threshold: float = MULTI_THRESHOLD) -> Column:
    """Classes at or above the threshold, in the taxonomy's order; [] is an answer, not a missing one."""
    chances = F.transform(part_of(vector, s), scores.sigmoid)
    picked = F.filter(F.transform(chances, lambda p, i: F.struct(i.alias("class_index"), p.alias("probability"))), lambda c: c["probability"] >= threshold)
    return picked


def decode(df: DataFrame, vector: str, slices: Sequence[Slice], threshold: float = MULTI_THRESHOLD) -> DataFrame:
    """``df`` with a struct or array column per attribute, in one projection."""
    out = [decode_single(F.col(vector), s).alias(s.name) if s.kind == "single" else decode_multi(F.col(vector), s, threshold).alias(s.name) for s in slices]
    return df.select("*", *out)


def passes_gate(confidence: Column, gated: Column, threshold: float = 0.35) -> Column:
    return ~gated | (confidence >= threshold)


def shown_attributes(compiled: DataFrame, all_tiers: bool = False) -> DataFrame:
    return compiled if all_tiers else compiled.filter(F.col("tier") != "hidden")
