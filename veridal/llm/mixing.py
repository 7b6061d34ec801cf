"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed to cells (source, language, topic); raking scales the
cells to each marginal's targets in turn. A cell's final weight over its tokens
is its factor; dividing by the largest factor gives probabilities of at most 1
that keep all proportions, and a document stays if a number that its id fixes is
below its cell's probability. As the factor of a cell grows while its share
shrinks, one rare cell can leave next to nothing of the others. ``least_rate``
bounds that: if fewer of all tokens would be expected to stay, the cells of the
largest factors stay whole, and one scale for all others makes it that share.
Everything is DataFrame functions; only cells, not documents, are shuffled for
raking, once, to the one task that rakes them. Probabilities are rounded to ``PLACES`` places, but never to 0, so that
every cell keeps its chance.

Targets default to tempered shares: a category with share ``s`` of all tokens
gets a share proportional to ``s ** temper``. A mapping of shares replaces them
for the categories it names.

Defined results: a null category is a category of its own; a document without
words counts one token, so that it has a chance to stay; rows with equal ids
in one cell share their fate; a draw equal to the probability does not stay; long
texts count whole; an empty table gives an empty table; further columns pass.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridal.llm.store import WORD_GAP, cut

ROUNDS = 8
PLACES = 9
#: The share of all tokens that the query and the pipeline keep at least, as expected.
LEAST_RATE = 1 / 3
TEMPER = {"source": 0.7, "lang": 0.9, "topic": 0.9}
#: Fixed words for the sampling number, so that it differs from other hashes of ids.
SALT = "mix:"


def tokens_of(text: Column) -> Column:
    """Words of the text, 1 at least."""
    parts = F.split(F.coalesce(text, F.lit("")), WORD_GAP)
    return F.greatest(F.size(F.array_remove(parts, "")), F.lit(1)).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    """A coarse topic from a text's form: table, note, article or essay."""
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    return F.when(bars * 10 > tokens, "table").when(tokens < 80, "note").when(tokens < 600, "article").otherwise("essay")


def unit_number(id_column: Column) -> Column:
    """A number in [0, 1) that the id fixes."""
    digits = F.substring(F.md5(F.concat(F.lit(SALT), F.coalesce(id_column.cast("string"), F.lit("null"))).cast("binary")), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 48))


def target_shares(cells: DataFrame, margin: str, temper: float, given: Mapping[str | None, float] | None = None) -> DataFrame:
    """``margin`` and ``target_<margin>``: shares that add up to 1."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").alias("t"))
    every = Window.partitionBy(F.lit(0))  # one row per category
    sums = sums.withColumn("share", F.pow(F.col("t") / F.sum("t").over(every), F.lit(temper)))
    for name, share in (given or {}).items():
        sums = sums.withColumn("share", F.when(F.col(margin).eqNullSafe(F.lit(name)), F.lit(float(share))).otherwise(F.col("share")))
    return sums.select(F.col(margin), (F.col("share") / F.sum("share").over(every)).alias(f"target_{margin}"))


def rake(cells: DataFrame, margins: list[str], rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (with ``tokens`` and ``target_*`` columns) with ``weight``."""
    out = cells.withColumn("weight", F.col("tokens").cast("double"))
    for _ in range(rounds):
        for m in margins:
            total = F.sum("weight").over(Window.partitionBy(m))
            out = out.withColumn("weight", F.col("weight") * F.col(f"target_{m}") / total)
    return out


def scale_of(cells: DataFrame, least_rate: float | None = None) -> DataFrame:
    """One row, ``scale``: what the factors of ``cells`` are divided by; quotients over 1 count as 1."""
    if least_rate is None:
        return cells.agg(F.max("factor").alias("scale"))
    if not 0 < least_rate < 1:
        raise ValueError("the least rate must lie between 0 and 1")
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("factor").desc(), F.col("tokens"))  # one row per cell
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    steps = cells.select(
        "factor", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("whole"), F.sum(F.col("factor") * F.col("tokens")).over(onward).alias("mass"),
        (F.sum("tokens").over(Window.partitionBy(F.lit(0))) * F.lit(least_rate)).alias("wanted"),
    )
    # The largest factor at which enough is kept: cells before it stay whole, the others share what is left.
    enough = F.when(F.col("whole") + F.col("mass") / F.col("factor") >= F.col("wanted"), F.struct("factor", "whole", "mass", "wanted"))
    at = steps.agg(F.max(enough).alias("at"), F.max("factor").alias("largest"), F.min("factor").alias("smallest"))
    return at.select(F.coalesce(F.least("largest", F.expr("at.mass / (at.wanted - at.whole)")), "smallest").alias("scale"))


def mixture(docs: DataFrame, text: str = "text", id_col: str = "doc_id", margins: tuple[str, str, str] = ("source", "lang", "topic"), targets: Mapping[str, Mapping[str | None, float]] | None = None, rounds: int = ROUNDS, least_rate: float | None = None) -> DataFrame:
    """One row per document: id, marginals, tokens, probability, draw and ``sampled``.

    The third marginal is the topic, from ``topic_of``. Without ``least_rate`` the
    rarest cell alone sets how much stays.
    """
    source, lang, topic = margins
    tokens = tokens_of(F.col(text))
    table = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source).alias("source"), F.col(lang).alias("lang"),
        topic_of(F.coalesce(F.col(text), F.lit("")), tokens).alias("topic"), tokens.alias("tokens"),
    )
    table = cut(table)
    names = ["source", "lang", "topic"]
    # One row per cell, in one partition, so that the steps of all rounds need no shuffles; coalesce() tells Spark that it is one.
    cells = cut(table.groupBy(*names).agg(F.sum("tokens").alias("tokens")).repartition(1)).coalesce(1)
    for name, margin in zip(names, margins, strict=True):
        shares = target_shares(cells, name, TEMPER[name], (targets or {}).get(margin)).withColumnRenamed(name, "category")
        cells = cells.join(F.broadcast(shares), cells[name].eqNullSafe(shares["category"])).drop("category")
    cells = cut(rake(cells, names, rounds).select(*names, "tokens", (F.col("weight") / F.col("tokens")).alias("factor")))
    probability = F.least(F.greatest(F.round(F.col("factor") / F.col("scale"), PLACES), F.lit(10.0**-PLACES)), F.lit(1.0))
    cells = cells.join(F.broadcast(scale_of(cells, least_rate))).select(*(F.col(n).alias(f"cell_{n}") for n in names), probability.alias("probability"))
    same = [table[n].eqNullSafe(cells[f"cell_{n}"]) for n in names]
    return table.join(cells, same[0] & same[1] & same[2]).select(
        F.col("doc_id").alias(id_col), *names, "tokens", "probability",
        F.round(unit_number(F.col("doc_id")), 9).alias("draw"),
        (F.round(unit_number(F.col("doc_id")), 9) < F.col("probability")).alias("sampled"),
    )


def sample_mixture(docs: DataFrame, text: str = "text", id_col: str = "doc_id", margins: tuple[str, str, str] = ("source", "lang", "topic"), **how: object) -> DataFrame:
    """The rows of ``docs`` that the mixture samples, each by its own cell."""
    names = ["id", "source", "lang", "topic"]
    left_out = mixture(docs, text, id_col, margins, **how).filter("NOT sampled").select(F.col(id_col).alias("id"), *names[1:]).distinct()
    own = (F.col(id_col), F.col(margins[0]), F.col(margins[1]), topic_of(F.coalesce(F.col(text), F.lit("")), tokens_of(F.col(text))))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(f"own_{n}") for n, c in zip(names, own, strict=True)])
    same = [F.col(f"own_{n}").eqNullSafe(F.col(n)) for n in names]
    return rows.join(left_out, same[0] & same[1] & same[2] & same[3], "left_anti").select("row.*")


def oracle_sql(rounds: int = ROUNDS, least_rate: float = LEAST_RATE) -> str:
    """The mixture over ``documents`` as DuckDB SQL."""
    names = ("source", "lang", "topic")
    steps = []
    for r in range(rounds):
        for m in names:
            at = r * 3 + names.index(m)
            steps.append(f"w{at + 1} AS (SELECT * REPLACE (weight * target_{m} / sum(weight) OVER (PARTITION BY {m}) AS weight) FROM w{at})")
    shares = ", ".join(
        f"{m}_s AS (SELECT {m}, p / sum(p) OVER () AS target_{m} FROM (SELECT {m}, pow(sum(tokens) / (SELECT sum(tokens) FROM cells), {TEMPER[m]}) AS p FROM cells GROUP BY {m}))"
        for m in names
    )
    joins = " ".join(f"JOIN {m}_s ON cells.{m} IS NOT DISTINCT FROM {m}_s.{m}" for m in names)
    return f"""
        WITH counted AS (
            SELECT doc_id, source, lang, coalesce(text, '') AS body,
                   greatest(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')), 1)::BIGINT AS tokens
            FROM documents
        ), docs AS (
            SELECT doc_id, source, lang, tokens,
                   CASE WHEN (length(body) - length(replace(body, '|', ''))) * 10 > tokens THEN 'table'
                        WHEN tokens < 80 THEN 'note' WHEN tokens < 600 THEN 'article' ELSE 'essay' END AS topic,
                   round(('0x' || substr(md5('{SALT}' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE / 281474976710656.0, 9) AS draw
            FROM counted
        ), cells AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM docs GROUP BY ALL),
        {shares},
        w0 AS (SELECT cells.*, target_source, target_lang, target_topic, tokens AS weight FROM cells {joins}),
        {", ".join(steps)},
        f AS (SELECT source, lang, topic, tokens, weight / tokens AS factor FROM w{rounds * 3}),
        steps AS (
            SELECT factor, coalesce(sum(tokens) OVER (ORDER BY factor DESC, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS whole,
                   sum(factor * tokens) OVER (ORDER BY factor DESC, tokens ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS mass, sum(tokens) OVER () * {least_rate!r} AS wanted
            FROM f
        ), enough AS (SELECT * FROM steps WHERE whole + mass / factor >= wanted ORDER BY factor DESC, whole DESC, mass DESC LIMIT 1),
        scale AS (SELECT coalesce(least((SELECT max(factor) FROM f), (SELECT mass / (wanted - whole) FROM enough)), (SELECT min(factor) FROM f)) AS scale),
        p AS (SELECT source, lang, topic, least(greatest(round(factor / scale, {PLACES}), 1e-{PLACES}), 1.0) AS probability FROM f, scale)
        SELECT doc_id, docs.source, docs.lang, docs.topic, tokens, probability, draw, draw < probability AS sampled
        FROM docs JOIN p ON docs.source IS NOT DISTINCT FROM p.source AND docs.lang IS NOT DISTINCT FROM p.lang AND docs.topic = p.topic
    """
