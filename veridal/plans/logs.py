"""Queries over the event log: latest rows, verdicts, telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridal.operators import joins, latest, selection, stats, telemetry
from veridal.plans.registry import query, table

#: An event's verdict stands for a judge's: high values hold, middling ones do not, low ones are undecided.
_SQL_VERDICT = "CASE WHEN value >= 50 THEN true WHEN value >= 10 THEN false END"
_SQL_LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1"


def verdict() -> F.Column:
    return F.when(F.col("value") >= 50, True).when(F.col("value") >= 10, False)


def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest.keep_latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id")


@query(f"""
    SELECT event_type, count(*) AS total, count(*) FILTER (v) AS n_true, count(*) FILTER (NOT v) AS n_false, count(*) FILTER (v IS NULL) AS n_null,
           round(count(*) FILTER (v) / nullif(count(*) FILTER (v IS NOT NULL), 0), 6) AS rate,
           round(avg(value), 4) AS value_mean, round(median(value), 6) AS value_p50, quantile_disc(value, 0.95) AS value_p95
    FROM (SELECT *, {_SQL_VERDICT} AS v FROM ({_SQL_LATEST})) GROUP BY event_type
""")
def method_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latest_events(spark, sf_dir)
    out = stats.method_summary(rows, "event_type", F.lit(True), verdict(), "value")
    return out.select(
        "event_type", "total", "n_true", "n_false", "n_null", F.round(F.try_divide("n_true", F.col("n_true") + F.col("n_false")), 6).alias("rate"),
        F.round("latency_mean", 4).alias("value_mean"), F.round("latency_p50", 6).alias("value_p50"), F.col("latency_p95").alias("value_p95"),
    )


@query(f"SELECT user_id, event_type, event_id, value FROM ({_SQL_LATEST})")
def latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_events(spark, sf_dir).select("user_id", "event_type", "event_id", "value")


@query("SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id")
def latest_after_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latest.keep_latest(table(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("event_type").isin("click", "view"))
    return rows.select("user_id", "event_id", "event_type")


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'")
def ever_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest.ever_completed(table(spark, sf_dir, "events"), ["user_id"], F.col("event_type") == "purchase")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = latest.ever_completed(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"], F.col("o_orderstatus") == "F")
    return latest.pending(table(spark, sf_dir, "customer"), done, ["c_custkey"]).select("c_custkey")


@query("""
    SELECT event_type, coalesce(nullif(CASE WHEN (props->>'k')::INT % 3 = 0 THEN NULL ELSE 'k' || ((props->>'k')::INT % 3) END, ''), 'unknown') AS code, count(*) AS rows
    FROM events WHERE value < 10 GROUP BY ALL
""")
def error_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int") % 3
    code = F.when(k == 0, None).otherwise(F.concat(F.lit("k"), k.cast("string")))
    return stats.error_histogram(table(spark, sf_dir, "events"), "event_type", F.col("value") < 10, code)


@query("SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = 5")
def cohort_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.in_every(table(spark, sf_dir, "events"), "user_id", "event_type", ["click", "error", "purchase", "signup", "view"])


@query("""
    WITH cohort AS (SELECT user_id FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1 HAVING count(DISTINCT event_type) = 3),
    r AS (SELECT user_id % 10 AS field, event_type, count(*) FILTER (value >= 50) AS c, count(*) FILTER (value >= 10 AND value < 50) AS i
          FROM events JOIN cohort USING (user_id) GROUP BY ALL)
    SELECT field, max(c || '/' || (c + i)) FILTER (event_type = 'click') AS click, max(c || '/' || (c + i)) FILTER (event_type = 'view') AS view,
           max(c || '/' || (c + i)) FILTER (event_type = 'purchase') AS purchase
    FROM r GROUP BY field
""")
def paired_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, methods = table(spark, sf_dir, "events"), ["click", "view", "purchase"]
    rows = events.join(joins.in_every(events, "user_id", "event_type", methods), "user_id", "left_semi").withColumn("v", verdict())
    detail = rows.groupBy((F.col("user_id") % 10).alias("field"), "event_type").agg(F.count_if("v").alias("c"), F.count_if(~F.col("v")).alias("i"))
    return stats.by_method(detail, "field", "event_type", methods, F.concat(F.col("c").cast("string"), F.lit("/"), (F.col("c") + F.col("i")).cast("string")))


@query("""
    SELECT place::INT AS place, event_type, rate FROM (
        SELECT event_type, rate, row_number() OVER (ORDER BY coalesce(rate, -1) DESC, event_type) AS place
        FROM (SELECT event_type, round(count(*) FILTER (value >= 50) / nullif(count(*) FILTER (value >= 10), 0), 6) AS rate FROM events GROUP BY 1))
    WHERE place <= 2
""")
def best_runner_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "events").withColumn("v", verdict())
    rates = v.groupBy("event_type").agg(F.round(F.try_divide(F.count_if("v"), F.count_if(F.col("v").isNotNull())), 6).alias("rate"))
    return stats.best_and_runner_up(rates, "event_type", "rate", "event_type")


@query("""
    SELECT user_id, count(*) AS num_request, count(*) FILTER (event_id % 4 > 0) AS num_retry, count(*) FILTER (event_type = 'error') AS num_error_request,
           CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN coalesce(sum(CASE WHEN event_type = 'purchase' THEN value::BIGINT END), 0)::BIGINT END AS input_token,
           CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN coalesce(sum(CASE WHEN event_type = 'purchase' THEN user_id END), 0)::BIGINT END AS output_token
    FROM (SELECT * REPLACE (trunc(value) AS value) FROM events) GROUP BY user_id
""")
def case_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = F.col("event_type") == "purchase"
    return telemetry.case_counters(
        table(spark, sf_dir, "events"), ["user_id"], F.col("event_id") % 4 + 1, F.col("event_type") == "error",
        F.when(used, F.col("value").cast("bigint")), F.when(used, F.col("user_id")),
    )


@query("SELECT event_id, user_id, event_type, (row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id))::INT AS ordinal, user_id || ':' || event_type || ':' || row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS call_id FROM events")
def call_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latest.call_ordinal(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["event_id"])
    return rows.select("event_id", "user_id", "event_type", "ordinal", F.concat_ws(":", "user_id", "event_type", "ordinal").alias("call_id"))


@query("""
    SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS in_window FROM events
""")
def rolling_60(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest.rolling_count(table(spark, sf_dir, "events"), "ts", 3600, ["user_id"]).select("event_id", "in_window")


@query("SELECT count(*) AS over FROM (SELECT count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS n FROM events) WHERE n > 3")
def limiter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = latest.rolling_count(table(spark, sf_dir, "events"), "ts", 86400, ["user_id"])
    return telemetry.limiter_audit(counted, 3).agg(F.count("*").alias("over"))


@query("SELECT event_id FROM events WHERE user_id % 7 <> 0 AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12) UNION ALL SELECT event_id FROM events WHERE user_id % 7 = 0 AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)")
def orphan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "customer").filter("c_nationkey < 12").select(F.col("c_custkey").alias("user_id"))
    return telemetry.orphan_events(table(spark, sf_dir, "events"), cases, ["user_id"]).select("event_id")


@query("""
    SELECT coalesce(sum(CASE WHEN value > 20 THEN trunc(value)::BIGINT END), 0)::BIGINT AS tokens, event_type,
           round(100.0 * count(*) FILTER (value > 20) / count(*), 6) AS usage_coverage
    FROM events GROUP BY event_type
""")
def conditional_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = F.col("value") > 20
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.coalesce(F.sum(F.when(used, F.col("value").cast("bigint"))), F.lit(0)).alias("tokens"), F.round(F.count_if(used) * 100 / F.count("*"), 6).alias("usage_coverage")
    )


@query("""
    SELECT l_returnflag AS method, CASE WHEN grouping(l_linestatus) = 1 THEN 'ALL' ELSE l_linestatus END AS stage,
           any_value(s.n) AS submitted_cases, any_value(s.ok) AS successful_cases, any_value(s.n - s.ok) AS error_cases,
           count(DISTINCT (l_orderkey, CASE WHEN l_linenumber > 1 THEN l_linenumber END)) AS logical_model_calls, count(*) AS actual_http_requests,
           count(*) FILTER (l_linenumber > 1) AS http_retry_requests, round(count(*) / nullif(any_value(s.ok), 0), 6) AS requests_per_successful_case,
           round(100.0 * count(*) FILTER (l_quantity > 10) / count(*), 6) AS usage_coverage,
           coalesce(sum(CASE WHEN l_quantity > 10 THEN trunc(l_quantity)::BIGINT END), 0)::BIGINT AS input_tokens,
           coalesce(sum(CASE WHEN l_quantity > 10 THEN l_partkey END), 0)::BIGINT AS output_tokens,
           coalesce(sum(CASE WHEN l_quantity > 10 THEN l_suppkey END), 0)::BIGINT AS total_tokens,
           quantile_disc(l_extendedprice, 0.5) AS p50_latency_ms, quantile_disc(l_extendedprice, 0.95) AS p95_latency_ms
    FROM lineitem JOIN (SELECT l_returnflag AS m, count(*) AS n, count(*) FILTER (l_discount < 0.05) AS ok FROM lineitem GROUP BY 1) s ON m = l_returnflag
    GROUP BY GROUPING SETS ((l_returnflag), (l_returnflag, l_linestatus))
""")
def benchmark_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    events = items.select(
        F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("stage"), F.col("l_orderkey").alias("sample_id"),
        F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")).alias("logical_call_id"), F.col("l_linenumber").alias("http_attempt"),
        (F.col("l_quantity") > 10).alias("usage_available"), F.col("l_quantity").alias("input_tokens"), F.col("l_partkey").alias("output_tokens"),
        F.col("l_suppkey").alias("total_tokens"), F.col("l_extendedprice").alias("latency_ms"),
    )
    cases = items.select(F.col("l_returnflag").alias("method"), F.when(F.col("l_discount") < 0.05, "success").otherwise("error").alias("status"))
    out = telemetry.benchmark_summary(events, cases)
    return out.withColumns({c: F.round(c, 6) for c in ("requests_per_successful_case", "usage_coverage")})


@query("SELECT l_returnflag, count(DISTINCT (l_orderkey, CASE WHEN l_linenumber > 2 THEN l_linenumber END)) AS calls FROM lineitem GROUP BY 1")
def distinct_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    call = F.struct("l_orderkey", F.when(F.col("l_linenumber") > 2, F.col("l_linenumber")))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_distinct(call).alias("calls"))


@query("""
    SELECT o_orderpriority, quantile_disc(o_totalprice, 0.5) AS p50_rank, round(median(o_totalprice), 6) AS p50_median,
           quantile_disc(o_totalprice, 0.95) AS p95_rank, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1
""")
def nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    ranks = {"p50_rank": selection.nearest(0.5), "low": selection.LOW_MIDDLE, "high": selection.HIGH_MIDDLE, "p95_rank": selection.nearest(0.95)}
    means = orders.groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 4).alias("mean"))
    out = selection.with_ranks(means, selection.at_ranks(orders, ["o_orderpriority"], "o_totalprice", ranks), ["o_orderpriority"])
    return out.select("o_orderpriority", "p50_rank", F.round((F.col("low") + F.col("high")) / 2, 6).alias("p50_median"), "p95_rank", "mean")


@query("SELECT event_type, count(*) AS rows, (sum(count(*)) OVER ())::BIGINT AS all_rows FROM events GROUP BY event_type")
def total_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    rolled = events.rollup("event_type").agg(F.count("*").alias("rows"), F.grouping("event_type").alias("whole"))
    one = rolled.filter("whole = 1").select(F.col("rows").alias("all_rows"))
    return rolled.filter("whole = 0").select("event_type", "rows").join(F.broadcast(one))
