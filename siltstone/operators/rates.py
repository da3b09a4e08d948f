"""Counters over time: deltas, rates, alerts, throughput windows, best settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.texts import percent_change


def deltas(snapshots: DataFrame, time: str, counters: list[str], *keys: str) -> DataFrame:
    """``snapshots`` with, for each counter, its change, change a second and change
    in percent since the one before of the same keys; null for the first.

    Without keys the series is one per call, as a trend is; with keys each series
    has its own window.
    """
    order = Window.partitionBy(*keys).orderBy(time)
    seconds = (F.unix_micros(time) - F.unix_micros(F.lag(time).over(order))) / 1e6
    out = {}
    for c in counters:
        old = F.lag(c).over(order)
        out |= {f"{c}_change": F.col(c) - old, f"{c}_rate": F.when(seconds > 0, (F.col(c) - old) / seconds), f"{c}_percent": F.when(old.isNotNull(), percent_change(old, F.col(c)))}
    return snapshots.withColumns(out)


def alerts(snapshots: DataFrame, limits: dict[str, Column]) -> DataFrame:
    """``snapshots`` once for each limit that is passed, with ``alert``."""
    named = F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in limits.items())), lambda x: x.isNotNull())
    return snapshots.withColumn("alert", F.explode(named))


def throughput(events: DataFrame, time: str, size: Column, window: str, slide: str | None = None) -> DataFrame:
    """(start_us, n, bytes, mb_s, per_s) of time windows."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    per = events.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))
    seconds = (F.unix_micros("w.end") - F.unix_micros("w.start")) / 1e6
    return per.select(F.unix_micros("w.start").alias("start_us"), "n", "bytes", (F.col("bytes") / (1 << 20) / seconds).alias("mb_s"), (F.col("n") / seconds).alias("per_s"))


def best_setting(measurements: DataFrame, setting: list[str], score: str, bound: Column) -> DataFrame:
    """The setting with the highest score among those within a bound, ties by setting."""
    return measurements.where(bound).orderBy(F.col(score).desc(), *setting).limit(1)


def apply_conditions(rows: DataFrame, rules: list[dict], key: str) -> DataFrame:
    """(key, rule, action, priority) of rows that meet a rule's SQL condition.

    Rules are name, condition, action, enabled, priority and parameters; those
    not enabled are left out.  A condition may use ``:name`` for a parameter;
    values become quoted literals.  Unreadable conditions
    raise when the plan is made.
    """
    found = []
    for r in rules:
        if r.get("enabled", True):
            text = r["condition"]
            for name, value in (r.get("parameters") or {}).items():
                quoted = "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"
                text = text.replace(f":{name}", quoted)
            hit = F.struct(F.lit(r["name"]).alias("rule"), F.lit(r["action"]).alias("action"), F.lit(int(r.get("priority", 0))).alias("priority"))
            found.append(F.when(F.expr(text), hit))
    if not found:
        return rows.select(key, F.lit("").alias("rule"), F.lit("").alias("action"), F.lit(0).alias("priority")).limit(0)
    return rows.select(key, F.inline(F.filter(F.array(*found), lambda x: x.isNotNull())))
