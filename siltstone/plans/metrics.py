"""Queries on counters over time and on rules with conditions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import rates as R
from siltstone.operators import stats as S
from siltstone.runtime import table


def _events(spark, d) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _daily(spark, d) -> DataFrame:
    e = _events(spark, d)
    return e.groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("v"))


def metric_deltas(spark, d):
    got = R.deltas(_daily(spark, d), "day", ["n"], "event_type")
    return got.select("event_type", F.unix_micros("day").alias("day_us"), "n", "n_change", F.round("n_rate", 9).alias("n_rate"), F.round("n_percent", 6).alias("n_percent"))


def metric_alerts(spark, d):
    got = R.alerts(_daily(spark, d), {"busy": F.col("n") > 70, "quiet": F.col("n") < 60, "rich": F.col("v") > 4000})
    return got.groupBy("event_type", "alert").agg(F.count(F.lit(1)).alias("n"))


def event_throughput(spark, d):
    got = R.throughput(_events(spark, d), "ts", F.length("props"), "1 hour", "30 minutes")
    return got.select("start_us", "n", "bytes", F.round("mb_s", 12).alias("mb_s"), F.round("per_s", 9).alias("per_s"))


def best_day(spark, d):
    got = R.best_setting(_daily(spark, d), ["event_type", "day"], "n", F.col("v") < 5000)
    return got.select("event_type", F.unix_micros("day").alias("day_us"), "n")


_RULES = (
    {"name": "dear", "condition": "p_retailprice > :limit", "action": "flag", "priority": 2, "parameters": {"limit": 1500}},
    {"name": "brand", "condition": "p_brand = :brand and p_size between 1 and 20", "action": "mark", "priority": 1, "parameters": {"brand": "Brand#1"}},
    {"name": "off", "condition": "true", "action": "mark", "enabled": False},
)


def rule_conditions(spark, d):
    return R.apply_conditions(table(spark, d, "part"), list(_RULES), "p_partkey")


def latency_percentiles(spark, d):
    """Median, 95th and 99th value of a measured series, by index."""
    got = S.order_statistics(table(spark, d, "events"), "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return spark.createDataFrame([tuple(round(v, 6) for v in got.values())], "p50 double, p95 double, p99 double")


_DAILY = "(SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n, round(sum(value), 6) AS v FROM events GROUP BY 1, 2)"

QUERIES = {f.__name__: f for f in (metric_deltas, metric_alerts, event_throughput, best_day, rule_conditions, latency_percentiles)}

SQL = {
    "metric_deltas": f"""
SELECT event_type, epoch_us(day) AS day_us, n, n - o AS n_change, round((n - o) / ((epoch_us(day) - epoch_us(p)) / 1e6), 9) AS n_rate, round((n - o) / o * 100, 6) AS n_percent
FROM (SELECT *, lag(n) OVER w AS o, lag(day) OVER w AS p FROM {_DAILY} WINDOW w AS (PARTITION BY event_type ORDER BY day))""",
    "metric_alerts": f"SELECT event_type, alert, count(*) AS n FROM (SELECT event_type, unnest([CASE WHEN n > 70 THEN 'busy' END, CASE WHEN n < 60 THEN 'quiet' END, CASE WHEN v > 4000 THEN 'rich' END]) AS alert FROM {_DAILY}) WHERE alert IS NOT NULL GROUP BY 1, 2",
    "event_throughput": """
SELECT epoch_us(s) AS start_us, count(*) AS n, CAST(sum(length(props)) AS BIGINT) AS bytes, round(sum(length(props)) / 1048576 / 3600, 12) AS mb_s, round(count(*) / 3600, 9) AS per_s
FROM (SELECT props, time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01') - to_minutes(30 * k) AS s FROM events, range(2) t(k)) GROUP BY s""",
    "best_day": f"SELECT event_type, epoch_us(day) AS day_us, n FROM {_DAILY} WHERE v < 5000 ORDER BY n DESC, event_type, day LIMIT 1",
    "rule_conditions": "SELECT p_partkey, 'dear' AS rule, 'flag' AS action, 2 AS priority FROM part WHERE p_retailprice > 1500 UNION ALL SELECT p_partkey, 'brand', 'mark', 1 FROM part WHERE p_brand = 'Brand#1' AND p_size BETWEEN 1 AND 20",
    "latency_percentiles": "SELECT round(max(value) FILTER (WHERE i = floor(n * 0.5)), 6) AS p50, round(max(value) FILTER (WHERE i = floor(n * 0.95)), 6) AS p95, round(max(value) FILTER (WHERE i = floor(n * 0.99)), 6) AS p99 FROM (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL)",
}
