"""URL filters: host and path rules, then a character language-model ratio.

URLs that a rule decides train two smoothed variable-order Markov models, one of
accepted and one of rejected URLs. Orders 0 to ``ORDER`` are blended from the
shortest context up: ``P_k = (n(context, c) + PULL * P_(k-1)) / (n(context) +
PULL)``. A URL's score is the difference of the two log likelihoods over its
length. A part of the decided URLs, one in ``HELD_OUT_OF`` by a hash, trains no
model but calibrates the threshold, which lies where accepted and rejected ones
are equally many of their standard deviations away; a verdict that none of these
has takes the training URLs' figures.

Counts are exact at every size: what a character adds depends on its window, the
character and the ``ORDER`` before it, so windows are counted once, and all
shorter contexts are summed from the windows' counts. The ``FREQUENT`` most
frequent windows' values are broadcast to the URLs; the remaining ones meet
theirs in a shuffle, where none is frequent enough to be a hot key.

Defined results: a null URL or one without ``://`` has empty host and path;
without a rule that fits, an empty or null URL is allowed, and so is every URL
when one of the models has no decided URL; longer rules win over shorter ones,
and of two equally long ones the longer host; repeated rows are judged one by one
and count each time; a URL of any length takes time in proportion; an empty table
gives none; columns besides id and URL are not read, so none can clash.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridal.llm.store import ascii_lower, cut, own_name

ORDER = 4
HELD_OUT_OF = 8
FREQUENT = 1 << 14
PULL = 2.0
ALPHABET = 256

#: (verdict, host, path)
Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    after = F.expr("substring(url, instr(url, '://') + 3)")
    return F.when(at > 0, ascii_lower(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    after = F.expr("substring(url, instr(url, '://') + 3)")
    return F.when(at > 0, F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The rule that decides, as a struct of ``rule`` and ``verdict``; null if none fits."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in reversed(ranked):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def windows_of(url: Column) -> Column:
    """For each character, itself after the ``ORDER`` characters before it, or as many as there are.

    The URL is split once, into an array that its places look up.
    """

    def each(letters: Column) -> Column:
        return F.transform(letters, lambda c, at: F.concat(*(F.coalesce(F.get(letters, at - k), F.lit("")) for k in range(ORDER, 0, -1)), c))

    letters = F.when(F.length(url) > 0, F.split(url, "")).otherwise(F.array().cast("array<string>"))
    return F.get(F.transform(F.array(letters), each), F.lit(0))


def window_counts(urls: DataFrame) -> DataFrame:
    """``(window, allow, block, n)`` of every window of ``urls``: counts by verdict of those that train (``verdict``, ``held_out``), and of all."""
    each = urls.select(F.when(~F.col("held_out"), F.col("verdict")).alias("verdict"), F.explode(windows_of(F.col("url"))).alias("window"))
    return each.groupBy("window").agg(F.count_if(F.col("verdict") == "allow").alias("allow"), F.count_if(F.col("verdict") == "block").alias("block"), F.count("*").alias("n"))


def window_values(seen: DataFrame) -> DataFrame:
    """``(window, n, value)``: the difference of the last character's log probabilities in the two models."""
    orders = F.sequence(F.lit(0), F.length("window") - 1)
    steps = seen.select("window", "n", "allow", "block", F.explode(orders).alias("k"))
    steps = steps.withColumn("gram", F.expr("right(window, k + 1)")).withColumn("context", F.expr("left(gram, k)"))
    grams = cut(steps.groupBy("k", "context", "gram").agg(F.sum("allow").alias("gram_allow"), F.sum("block").alias("gram_block")))
    contexts = grams.groupBy("k", "context").agg(F.sum("gram_allow").alias("context_allow"), F.sum("gram_block").alias("context_block"))
    # Fewer rows than grams, and no gram has more than one context.
    models = cut(grams.join(contexts, ["k", "context"]).drop("k", "context"))
    joined = steps.select("window", "n", "k", "gram").join(models, "gram")
    by_order = joined.groupBy("window").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("k", *models.columns))).alias("orders"))

    def probability(verdict: str) -> Column:
        return F.aggregate("orders", F.lit(1.0 / ALPHABET), lambda p, o: (o[f"gram_{verdict}"] + F.lit(PULL) * p) / (o[f"context_{verdict}"] + F.lit(PULL)))

    return by_order.select("window", "n", (F.log(probability("allow")) - F.log(probability("block"))).alias("value"))


def scored(urls: DataFrame, values: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """``urls`` (``row``, ``url``, …) with ``score``: difference of log likelihoods over the length, null if empty."""
    each = urls.select("row", F.explode(windows_of(F.col("url"))).alias("window"))
    often = F.broadcast(cut(values.orderBy(F.desc("n"), "window").limit(frequent)).select("window", "value"))
    sums = [
        some.groupBy("row").agg(F.sum("value").alias("value"))
        for some in (each.join(often, "window"), each.join(often, "window", "left_anti").join(values.select("window", "value"), "window"))
    ]
    total = sums[0].unionByName(sums[1]).groupBy("row").agg(F.sum("value").alias("total"))
    return urls.join(total, "row", "left").withColumn("score", F.col("total") / F.length("url")).drop("total")


def filter_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url", id_col: str = "page_id") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, score."""
    table = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"))
    table = table.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    table = table.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    held_out = F.pmod(F.xxhash64("url"), F.lit(HELD_OUT_OF)) == 0
    table = cut(table.select(F.monotonically_increasing_id().alias("row"), "id", "url", "host", "path", "found.rule", "found.verdict", held_out.alias("held_out")))
    table = cut(scored(table, cut(window_values(cut(window_counts(table))))))
    known = table.filter(F.col("verdict").isNotNull() & (F.length("url") > 0))

    def figure(f: Callable[[Column], Column], verdict: str) -> Column:
        mine = F.col("verdict") == verdict
        return F.coalesce(f(F.when(mine & F.col("held_out"), F.col("score"))), f(F.when(mine, F.col("score"))))

    stats = known.groupBy().agg(*[figure(f, v).alias(f"{n}_{v}") for v in ("allow", "block") for n, f in (("mean", F.avg), ("sd", F.stddev_pop))])
    a, b = F.col("sd_allow") + F.lit(1e-6), F.col("sd_block") + F.lit(1e-6)
    threshold = cut(stats.select(((F.col("mean_allow") * b + F.col("mean_block") * a) / (a + b)).alias("threshold")))
    judged = table.join(F.broadcast(threshold))
    by_model = F.when(F.col("score") < F.col("threshold"), "block").otherwise("allow")
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", by_model).alias("verdict"), "score")


def drop_rejected(pages: DataFrame, rules: Sequence[Rule], url: str = "url", id_col: str = "page_id") -> DataFrame:
    """``pages`` without the rows whose URL is blocked."""
    blocked = filter_urls(pages, rules, url, id_col).filter("verdict = 'block'").select(F.col(id_col).alias(own_name(pages, "blocked_id"))).distinct()
    return pages.join(blocked, pages[id_col].eqNullSafe(blocked[blocked.columns[0]]), "left_anti")
