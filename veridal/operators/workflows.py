"""The generator workflows and the judge, over injected models.

Each agent is a ``Model``: prompts in, answers (JSON texts) out. Prompts are
templates with ``{column}`` places and are parameters, as the contract of the
attributes is. A row whose agent fails, or answers what its check refuses, ends
with ``status`` *error* and the agent's name in ``error``; it is never lost.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridal.functions import jsons
from veridal.operators.filters import feedback_of
from veridal.operators.stages import Model, Stage, call, fan_out, flow, refine

#: What an observer looks at, in the order in which observers are asked.
OBSERVER_FOCUSES = ("head and upper body", "lower body and footwear", "accessories and carried objects", "whole person")
MOST_CAPTION, MOST_ISSUES = 500, 6
DONE, REJECTED, LIMIT = "accepted", "rejected_after_max_attempts", "refine_limit_reached"


@dataclass(frozen=True)
class Contract:
    """The closed world of the attributes: domains of single and of multiple values."""

    singles: Mapping[str, Sequence[str]] = field(default_factory=dict)
    multis: Mapping[str, Sequence[str]] = field(default_factory=dict)

    def fits(self, value: object) -> bool:
        if not isinstance(value, dict) or set(value) != {*self.singles, *self.multis}:
            return False
        alone = all(value[k] is None or value[k] in domain for k, domain in self.singles.items())
        lists = ((value[k], domain) for k, domain in self.multis.items() if value[k] is not None)
        return alone and all(isinstance(v, list) and all(isinstance(x, str) for x in v) and len(set(v)) == len(v) and set(v) <= set(domain) for v, domain in lists)


def _object(text: str | None, keys: set[str]) -> dict | None:
    """The JSON object of a text if it has exactly these keys."""
    try:
        value = json.loads(text or "")
    except ValueError:
        return None
    return value if isinstance(value, dict) and set(value) == keys else None


def _text(value: object, most: int) -> bool:
    return isinstance(value, str) and 1 <= len(value.strip()) <= most


def is_caption(text: str) -> bool:
    value = _object(text, {"caption"})
    return value is not None and _text(value["caption"], MOST_CAPTION)


def is_annotation(contract: Contract) -> Callable[[str], bool]:
    def check(text: str) -> bool:
        value = _object(text, {"caption", "attributes"})
        return value is not None and _text(value["caption"], MOST_CAPTION) and contract.fits(value["attributes"])

    return check


def is_facts(contract: Contract) -> Callable[[str], bool]:
    def check(text: str) -> bool:
        value = _object(text, {"facts", "attributes"})
        return value is not None and _strings(value["facts"]) and contract.fits(value["attributes"])

    return check


def is_consensus(contract: Contract) -> Callable[[str], bool]:
    def check(text: str) -> bool:
        value = _object(text, {"attributes"})
        return value is not None and contract.fits(value["attributes"])

    return check


def _strings(value: object) -> bool:
    return isinstance(value, list) and all(isinstance(x, str) and x.strip() for x in value)


def is_issues(text: str) -> bool:
    value, limits = _object(text, {"issues"}), {"target": 64, "issue": 180, "suggested_correction": 180}
    if value is None or not isinstance(value["issues"], list) or len(value["issues"]) > MOST_ISSUES:
        return False
    return all(isinstance(i, dict) and set(i) == set(limits) and all(_text(i[k], n) for k, n in limits.items()) for i in value["issues"])


def is_verdict(text: str) -> bool:
    value = _object(text, {"decision", "reasons"})
    return value is not None and value["decision"] in ("accept", "reject") and _strings(value["reasons"]) and len(value["reasons"]) <= MOST_ISSUES and all(_text(r, 180) for r in value["reasons"])


def _member(text: str | None, key: str) -> object:
    """A member of the JSON object that a text is; other members are let pass."""
    try:
        value = json.loads(text or "")
    except ValueError:
        return None
    return value.get(key) if isinstance(value, dict) else None


def _all_texts(item: object, keys: set[str]) -> bool:
    """An object of exactly these keys, none of them blank."""
    return isinstance(item, dict) and set(item) == keys and all(isinstance(v, str) and v.strip() for v in item.values())


def is_questions(text: str) -> bool:
    """Some questions, each with an id of its own and a target."""
    found = _member(text, "questions")
    if not isinstance(found, list) or not found or not all(_all_texts(q, {"id", "target", "question"}) for q in found):
        return False
    return len({q["id"] for q in found}) == len(found)


def is_answers(text: str, questions: str) -> bool:
    """Answers with evidence to all of the questions and to no other."""
    found, asked = _member(text, "answers"), _member(questions, "questions")
    if not isinstance(found, list) or not isinstance(asked, list):
        return False
    for a in found:
        if not isinstance(a, dict) or not isinstance(a.get("determinable"), bool) or not isinstance(a.get("question_id"), str):
            return False
        if not _all_texts({k: v for k, v in a.items() if k not in ("determinable", "question_id")}, {"answer", "evidence"}):
            return False
    return {a["question_id"] for a in found} == {q["id"] for q in asked}


def is_comparison(text: str) -> bool:
    return _member(text, "decision") in ("accept", "refine") and _strings(_member(text, "corrections"))


def rendered(template: str, columns: Sequence[str]) -> Callable[[DataFrame], Column]:
    """A prompt: the template with the row's values put in; null is blank."""

    def prompt(df: DataFrame) -> Column:
        out = F.lit(template)
        for c in columns:
            value = F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
            out = F.replace(out, F.lit("{" + c + "}"), F.coalesce(value, F.lit("")))
        return out

    return prompt


def _stage(name: str, models: Mapping[str, Model], prompts: Mapping[str, str], columns: Sequence[str], valid: Callable[..., bool], attempts: int, **more: object) -> Stage:
    return Stage(name, rendered(prompts.get(name, f"{name}: " + " ".join("{" + c + "}" for c in columns)), columns), models[name], valid, attempts, **more)


def _translation(models: Mapping[str, Model], prompts: Mapping[str, str], attempts: int) -> Stage:
    return _stage("caption_vi_json", {"caption_vi_json": models["translation"]}, {"caption_vi_json": prompts.get("translation", "translation: {caption}")}, ["caption"], is_caption, attempts)


def _part(column: str, path: str) -> Column:
    return F.get_json_object(column, path)


def _finished(df: DataFrame, *keep: str) -> DataFrame:
    """Caption, its translation and attributes of the rows without an error; the others keep the error alone."""
    ok = F.col("error").isNull()
    out = df.withColumn("caption_vi", F.trim(_part("caption_vi_json", "$.caption"))).withColumn("status", F.when(ok, "success").otherwise("error"))
    names = ("caption", "caption_vi", "attributes", *keep)
    return out.select("sample_id", "status", *[F.when(ok, F.col(c)).alias(c) for c in names], "error")


def direct_annotation(samples: DataFrame, models: Mapping[str, Model], contract: Contract, prompts: Mapping[str, str] | None = None, attempts: int = 1) -> DataFrame:
    """One call annotates, another translates the caption."""
    prompts = prompts or {}
    done = call(samples, _stage("annotation", models, prompts, ["sample_id", "image"], is_annotation(contract), attempts))
    done = done.withColumn("caption", F.trim(_part("annotation", "$.caption"))).withColumn("attributes", _part("annotation", "$.attributes"))
    return _finished(call(done, _translation(models, prompts, attempts)))


def facts_then_caption(samples: DataFrame, models: Mapping[str, Model], contract: Contract, prompts: Mapping[str, str] | None = None, attempts: int = 1) -> DataFrame:
    """Free analysis, structured facts from it, a caption from the facts alone, its translation."""
    prompts = prompts or {}
    stages = [
        _stage("visual_analysis", models, prompts, ["sample_id", "image"], lambda t: bool(t and t.strip()), attempts),
        _stage("structured_facts", models, prompts, ["image", "visual_analysis"], is_facts(contract), attempts),
    ]
    done = flow(samples, stages).drop("status").withColumn("facts", _part("structured_facts", "$.facts")).withColumn("attributes", _part("structured_facts", "$.attributes"))
    done = call(done, _stage("caption_json", {"caption_json": models["caption"]}, {"caption_json": prompts.get("caption", "caption: {facts}")}, ["facts"], is_caption, attempts))
    done = done.withColumn("caption", F.trim(_part("caption_json", "$.caption")))
    return _finished(call(done, _translation(models, prompts, attempts)))


def consensus_annotation(samples: DataFrame, models: Mapping[str, Model], contract: Contract, prompts: Mapping[str, str] | None = None, attempts: int = 1, focuses: Sequence[str] = OBSERVER_FOCUSES) -> DataFrame:
    """Observers with a focus each, one consensus of their attributes, a caption of it, its translation."""
    prompts = prompts or {}
    seen = fan_out(samples, _stage("observer", models, prompts, ["sample_id", "image", "focus"], is_annotation(contract), attempts), focuses)
    seen = seen.withColumn("candidates", F.array_join("observers", "\n"))
    done = call(seen, _stage("consensus", models, prompts, ["image", "candidates"], is_consensus(contract), attempts)).withColumn("attributes", _part("consensus", "$.attributes"))
    done = call(done, _stage("caption_json", {"caption_json": models["caption"]}, {"caption_json": prompts.get("caption", "caption: {attributes}")}, ["attributes"], is_caption, attempts))
    done = done.withColumn("caption", F.trim(_part("caption_json", "$.caption")))
    return _finished(call(done, _translation(models, prompts, attempts)))


_ISSUES = "array<struct<target:string,issue:string,suggested_correction:string>>"


def critic_verifier(samples: DataFrame, models: Mapping[str, Model], contract: Contract, prompts: Mapping[str, str] | None = None, attempts: int = 1, rounds: int = 3) -> DataFrame:
    """Draft, critic and verifier in rounds; issues and reasons go back to the next draft.

    After the last round the last draft stays, marked as rejected, with its notes.
    """
    prompts = prompts or {}
    if rounds < 1:
        raise ValueError("there must be at least one round")
    stages = [
        _stage("generator", models, prompts, ["sample_id", "image", "feedback"], is_annotation(contract), attempts),
        _stage("critic", models, prompts, ["image", "generator"], is_issues, attempts),
        _stage("verifier", models, prompts, ["image", "generator", "critic"], is_verdict, attempts),
    ]
    issues, reasons = F.from_json(_part("critic", "$.issues"), _ISSUES), F.from_json(_part("verifier", "$.reasons"), "array<string>")
    done = refine(samples, stages, _part("verifier", "$.decision") == "accept", rounds, jsons.compact_json(feedback_of(issues, reasons)), REJECTED)
    notes = F.concat(F.transform(issues, lambda i: i["issue"]), F.transform(reasons, lambda r: F.trim(r)))
    return _refined(done, "generator", notes, models, prompts, attempts)


def question_refinement(samples: DataFrame, models: Mapping[str, Model], contract: Contract, prompts: Mapping[str, str] | None = None, attempts: int = 2, refinements: int = 2) -> DataFrame:
    """Draft, questions about it, answers from the image, comparison; corrections go back to the next draft.

    Answers are held against the questions of their own round, and an answer that
    does not fit is asked for once more there (``attempts``), the translation not.
    """
    prompts = prompts or {}
    if refinements < 0:
        raise ValueError("the number of refinements cannot be negative")
    asked = {"beside": ["verification_questions"], "refused": "incomplete image answers"}
    stages = [
        _stage("draft_annotation", models, prompts, ["sample_id", "image", "feedback"], is_annotation(contract), attempts, refused="invalid draft"),
        _stage("verification_questions", models, prompts, ["draft_annotation"], is_questions, attempts, refused="invalid verification questions"),
        _stage("image_answers", models, prompts, ["image", "verification_questions"], is_answers, attempts, **asked),
        _stage("comparison", models, prompts, ["draft_annotation", "image_answers"], is_comparison, attempts, refused="invalid comparison"),
    ]
    corrections = F.from_json(_part("comparison", "$.corrections"), "array<string>")
    done = refine(samples, stages, _part("comparison", "$.decision") == "accept", refinements + 1, jsons.compact_json(corrections), LIMIT)
    return _refined(done, "draft_annotation", corrections, models, prompts, 1)


def _refined(done: DataFrame, draft: str, notes: Column, models: Mapping[str, Model], prompts: Mapping[str, str], attempts: int) -> DataFrame:
    none = F.array().cast("array<string>")
    done = done.withColumn("caption", F.trim(_part(draft, "$.caption"))).withColumn("attributes", _part(draft, "$.attributes"))
    done = done.withColumn("workflow_notes", F.when(F.col("workflow_status") == DONE, none).otherwise(notes))
    return _finished(call(done, _translation(models, prompts, attempts)), "workflow_status", "workflow_notes")


def judge(tasks: DataFrame, models: Mapping[str, Model], caption_valid: Callable[[str], bool], attributes_valid: Callable[[str], bool], judge_model: str, versions: Mapping[str, str], prompts: Mapping[str, str] | None = None, attempts: int = 1) -> DataFrame:
    """Two isolated calls a task: image and caption, then caption and golden labels; with the five counters."""
    prompts = prompts or {}
    done = flow(tasks, [
        _stage("caption_evaluation", models, prompts, ["image", "caption"], caption_valid, attempts),
        _stage("attribute_evaluation", models, prompts, ["caption", "golden_attributes"], attributes_valid, attempts),
    ])
    checks = F.map_values(F.from_json("attribute_evaluation", "map<string,struct<mentioned:boolean,is_correct:boolean,note:string>>"))
    from veridal.operators.stats import row_summary

    ok = F.col("status") == "success"
    return done.select(
        F.lit("3").alias("evaluation_schema_version"), "sample_id", "method", F.lit(judge_model).alias("judge_model"), F.create_map(*[F.lit(x) for kv in versions.items() for x in kv]).alias("prompt_versions"),
        "status", F.when(ok, F.col("caption_evaluation")).alias("caption_evaluation"), F.when(ok, F.col("attribute_evaluation")).alias("caption_attribute_evaluation"),
        F.when(ok, row_summary(checks)).alias("caption_attribute_summary"), F.when(~ok, F.struct(F.split("error", ":").getItem(0).alias("code"), F.col("error").alias("message"))).alias("error"),
    )
