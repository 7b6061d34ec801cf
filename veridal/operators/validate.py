"""Row validators: each gives an array of violation names, empty where a row is valid."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridal.functions import jsons
from veridal.functions.text import trim_u


def violations(**rules: Column) -> Column:
    """Names of the rules that do not hold; a rule that is null does not hold."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def strict(df: DataFrame, found: Column, message: str) -> DataFrame:
    """``df``, failing at the first row with a violation."""
    first = df.columns[0]
    text = F.concat(F.lit(f"{message}: "), F.array_join(found, ", "))
    return df.withColumn(first, F.when(F.size(found) > 0, F.raise_error(text)).otherwise(F.col(first)))


def quarantine(df: DataFrame, found: Column) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others with their ``violations``."""
    marked = df.withColumn("violations", found)
    return marked.filter(F.size("violations") == 0).drop("violations"), marked.filter(F.size("violations") > 0)


def single_value(x: Column, domain: Sequence[str]) -> Column:
    return x.isNull() | x.isin(*domain)


def multi_value(x: Column, domain: Sequence[str]) -> Column:
    known = F.array(*[F.lit(d) for d in domain])
    return x.isNull() | ((F.size(F.array_distinct(x)) == F.size(x)) & (F.size(F.array_except(x, known)) == 0))


def annotation(attributes: Column, singles: Mapping[str, Sequence[str]], multis: Mapping[str, Sequence[str]]) -> Column:
    """Violations of a JSON text with exactly these attributes, values in their domains or null."""
    rules = {"keys": jsons.has_exact_keys(attributes, [*singles, *multis])}
    for name, domain in singles.items():
        kind = jsons.kind_at(attributes, f"$.{name}")
        rules[name] = (kind == "VOID") | ((kind == "STRING") & F.get_json_object(attributes, f"$.{name}").isin(*domain))
    for name, domain in multis.items():
        kind = jsons.kind_at(attributes, f"$.{name}")
        values = F.from_json(F.get_json_object(attributes, f"$.{name}"), "array<string>")
        rules[name] = (kind == "VOID") | (kind.startswith("ARRAY") & multi_value(values, domain))
    return violations(**rules)


def prediction_keys(attributes: Column, names: Sequence[str]) -> Column:
    """The weak check: the keys alone."""
    return violations(keys=jsons.has_exact_keys(attributes, list(names)))


def caption_verdict(text: Column, most_note: int = 400) -> Column:
    return violations(
        keys=jsons.has_exact_keys(text, ["is_correct", "needs_human_review", "note"]),
        is_correct=jsons.is_boolean_at(text, "$.is_correct"),
        needs_human_review=jsons.is_boolean_at(text, "$.needs_human_review"),
        note=(jsons.kind_at(text, "$.note") == "STRING") & (F.length(F.get_json_object(text, "$.note")) <= most_note),
    )


def attribute_check(text: Column, most_note: int = 400) -> Column:
    """One field's check: a mention has a boolean verdict, anything else an explicit null; the note is not too long."""
    mentioned = F.get_json_object(text, "$.mentioned") == "true"
    kind = jsons.kind_at(text, "$.is_correct")
    return violations(
        keys=jsons.has_exact_keys(text, ["mentioned", "is_correct", "note"]),
        mentioned=jsons.is_boolean_at(text, "$.mentioned"),
        verdict=F.when(mentioned, kind == "BOOLEAN").otherwise(kind == "VOID"),
        note=(jsons.kind_at(text, "$.note") == "STRING") & (F.length(F.get_json_object(text, "$.note")) <= most_note),
    )


def attribute_checks(text: Column, names: Sequence[str], most_note: int = 400) -> Column:
    """The checks of all fields, of exactly these names: ``keys``, or the fields whose own check fails."""
    keys = violations(keys=jsons.has_exact_keys(text, list(names)))
    bad = [F.when(F.size(attribute_check(F.get_json_object(text, f"$.{n}"), most_note)) > 0, F.lit(n)) for n in names]
    return F.concat(keys, F.array_compact(F.array(*bad)))


def tri_state_map(checks: Column) -> Column:
    """Whether every entry of a map is a mention with verdict, or neither."""
    return F.forall(F.map_values(checks), lambda c: c["mentioned"] == c["is_correct"].isNotNull())


def caption_length(caption: Column, most: int = 500) -> Column:
    return violations(caption=F.length(trim_u(caption)).between(1, most))


def _field(name: str) -> Callable[[Column], Column]:
    return lambda i: i[name]


def issues(items: Column, most: int = 6, limits: Mapping[str, int] | None = None) -> Column:
    """At most so many; every field not blank and not too long after trimming."""
    limits = limits or {"target": 64, "issue": 180, "suggested_correction": 180}

    def within(length: int) -> Callable[[Column], Column]:
        return lambda v: F.length(trim_u(v)).between(1, length)

    rules = {"count": F.size(items) <= most}
    for name, length in limits.items():
        rules[name] = F.forall(F.transform(items, _field(name)), within(length))
    return violations(**rules)


def verifier_decision(decision: Column, reasons: Column) -> Column:
    return violations(
        decision=decision.isin("accept", "reject"),
        reasons=(F.size(reasons) <= 6) & F.forall(reasons, lambda r: F.length(trim_u(r)).between(1, 180)),
    )


def questions(items: Column) -> Column:
    """Some questions, with ids of their own."""
    ids = F.transform(items, lambda q: q["id"])
    return violations(count=F.size(items) > 0, ids=F.size(F.array_distinct(ids)) == F.size(ids))


def answers(items: Column, question_ids: Column) -> Column:
    """The answers' question ids are the questions' ids, as sets."""
    ids = F.array_sort(F.array_distinct(F.transform(items, lambda a: a["question_id"])))
    return violations(ids=ids == F.array_sort(F.array_distinct(question_ids)))


def comparison(decision: Column, notes: Column, decisions: Sequence[str]) -> Column:
    return violations(decision=decision.isin(*decisions), notes=F.forall(notes, lambda n: F.length(trim_u(n)) > 0))


def override(text: Column, methods: Sequence[str], fields: Sequence[str]) -> Column:
    """A reviewer's correction: exact keys, a known method and sample, a boolean or null caption, known fields."""
    names = F.coalesce(F.json_object_keys(F.get_json_object(text, "$.attributes")), F.array().cast("array<string>"))
    caption = jsons.kind_at(text, "$.caption")
    checks = F.from_json(F.get_json_object(text, "$.attributes"), "map<string,string>")
    return violations(
        keys=jsons.has_exact_keys(text, ["sample_id", "method", "caption", "attributes"]),
        sample_id=(jsons.kind_at(text, "$.sample_id") == "STRING") & (F.get_json_object(text, "$.sample_id") != ""),
        method=F.get_json_object(text, "$.method").isin(*methods),
        caption=(caption == "VOID") | (jsons.has_exact_keys(F.get_json_object(text, "$.caption"), ["is_correct"]) & jsons.is_boolean_at(text, "$.caption.is_correct")),
        attributes=jsons.kind_at(text, "$.attributes").startswith("OBJECT") & (F.size(F.array_except(names, F.array(*[F.lit(f) for f in fields]))) == 0),
        values=F.forall(F.map_values(checks), lambda c: jsons.has_exact_keys(c, ["is_correct"]) & jsons.is_boolean_at(c, "$.is_correct", nullable=True)) | (F.size(names) == 0),
    )


def logits(x: Column, size: int) -> Column:
    finite = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return violations(size=F.size(x) == size, finite=finite)


def draft_annotation(text: Column, singles: Mapping[str, Sequence[str]], multis: Mapping[str, Sequence[str]], most: int = 500) -> Column:
    """A draft: exactly caption and attributes, the caption's length, and the attributes' own check."""
    caption = F.get_json_object(text, "$.caption")
    inner = annotation(F.get_json_object(text, "$.attributes"), singles, multis)
    own = violations(
        keys=jsons.has_exact_keys(text, ["caption", "attributes"]),
        caption=(jsons.kind_at(text, "$.caption") == "STRING") & F.length(trim_u(caption)).between(1, most),
    )
    return F.concat(own, F.transform(inner, lambda v: F.concat(F.lit("attributes."), v)))


def text_answer(text: Column, key: str, most: int = 500) -> Column:
    """An object with one text (a caption, a translation) of 1 to ``most`` characters when trimmed."""
    value = F.get_json_object(text, f"$.{key}")
    return violations(keys=jsons.has_exact_keys(text, [key]), **{key: (jsons.kind_at(text, f"$.{key}") == "STRING") & F.length(trim_u(value)).between(1, most)})


def _items(text: Column, key: str) -> Column:
    """The members of a list in a JSON object, each as JSON text; null where there is none."""
    inner = F.get_json_object(text, f"$.{key}")
    return F.when(jsons.kind_at(text, f"$.{key}").startswith("ARRAY"), F.from_json(inner, "array<string>"))


def _said(item: Column, key: str) -> Column:
    """Whether an object says something not blank under ``key``."""
    return (jsons.kind_at(item, f"$.{key}") == "STRING") & (F.length(trim_u(F.get_json_object(item, f"$.{key}"))) > 0)


def _every(items: Column, holds: Callable[[Column], Column]) -> Column:
    return F.forall(items, lambda x: F.coalesce(holds(x), F.lit(False)))


def question_ids(text: Column) -> Column:
    return F.transform(_items(text, "questions"), lambda q: F.get_json_object(q, "$.id"))


def question_list(text: Column) -> Column:
    """Some question objects of exactly an id, a target and a question, none blank, ids of their own."""
    items, ids = _items(text, "questions"), question_ids(text)
    return violations(
        count=F.size(items) > 0,
        items=_every(items, lambda q: jsons.has_exact_keys(q, ["id", "target", "question"]) & _said(q, "id") & _said(q, "target") & _said(q, "question")),
        ids=F.size(F.array_distinct(ids)) == F.size(items),
    )


def answer_list(text: Column, asked: Column) -> Column:
    """Answers of exactly four keys, with evidence and a boolean, to all of the ids ``asked`` and to no other."""
    items = _items(text, "answers")
    ids = F.transform(items, lambda a: F.get_json_object(a, "$.question_id"))
    return violations(
        items=_every(items, lambda a: jsons.has_exact_keys(a, ["question_id", "answer", "evidence", "determinable"]) & (jsons.kind_at(a, "$.question_id") == "STRING") & _said(a, "answer") & _said(a, "evidence") & jsons.is_boolean_at(a, "$.determinable")),
        ids=F.array_sort(F.array_distinct(ids)) == F.array_sort(F.array_distinct(asked)),
    )


def string_list(items: Column) -> Column:
    """No blank text in a list."""
    return violations(items=F.forall(items, lambda s: F.length(trim_u(s)) > 0))


def stripped(items: Column) -> Column:
    return F.transform(items, trim_u)
