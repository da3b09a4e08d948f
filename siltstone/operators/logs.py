"""Log lines to rows, filters, statistics and written forms.

Rows: ts TIMESTAMP, source, level, message, host, process STRING, pid INT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.texts import overlapping_count

COLUMNS = ["ts", "source", "level", "message", "host", "process", "pid"]
_SYSLOG = r"^(\w{3} [ \d]\d \d{2}:\d{2}:\d{2}) (\S+) ([^:\[]+)(?:\[(\d+)\])?: ?(.*)$"
_CLF = r'^(\S+) \S+ \S+ \[([^\]]*)\] "([^"]*)" (\d{3}) (\S+)'
_LEVEL = r"(?i)\b(fatal|error|warn(?:ing)?|info|debug)\b"
#: Format descriptions.
FORMATS = {"syslog": "Syslog format", "apache": "Apache Common Log Format", "nginx": "Nginx Log Format", "json": "JSON Log Format", "csv": "CSV Log Format", "custom": "Custom Log Format"}


def detect_format(path: Column, head: Column) -> Column:
    """Format by extension, else by the first 1024 characters; null of nothing."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^.]*)$", 1))
    head = F.substring(head, 1, 1024)
    return (
        F.when(ext == ".json", "json")
        .when(ext == ".csv", "csv")
        .when(head == "", None)
        .when((F.length(head) > 20) & head.rlike(r"(?s)^...[ \t]..[ \t]..:..:"), "syslog")
        .when(head.contains("GET ") | head.contains("POST ") | head.contains("HTTP/"), "apache")
        .when(head.startswith("{") | head.startswith("["), "json")
        .otherwise("custom")
    )


def format_description(name: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in FORMATS.items() for x in pair))[name], F.lit("Unknown format"))


def _level(message: Column) -> Column:
    """Level that a message names, else info."""
    found = F.lower(F.regexp_extract(message, _LEVEL, 1))
    return F.when(found == "", "info").when(found == "warning", "warn").otherwise(found)


def parse_syslog(lines: DataFrame, value: str = "value", year: int = 1970) -> DataFrame:
    """Lines without a year, which the format lacks, get ``year``; lines of another
    form and empty ones give no row."""
    v = F.col(value)
    part = lambda k: F.regexp_extract(v, _SYSLOG, k)
    stamp = F.try_to_timestamp(F.concat(F.lit(f"{year} "), F.regexp_replace(part(1), r"\s+", " ")), F.lit("yyyy MMM d HH:mm:ss"))
    return lines.where(v.rlike(_SYSLOG)).select(stamp.alias("ts"), F.lit("syslog").alias("source"), _level(part(5)).alias("level"), part(5).alias("message"), part(2).alias("host"), part(3).alias("process"), part(4).try_cast("int").alias("pid"))


def parse_apache(lines: DataFrame, value: str = "value", source: str = "apache") -> DataFrame:
    """Common log format: the host and the request; statuses from 500 are errors, from 400 warnings."""
    v = F.col(value)
    part = lambda k: F.regexp_extract(v, _CLF, k)
    status = part(4).try_cast("int")
    level = F.when(status >= 500, "error").when(status >= 400, "warn").otherwise("info")
    stamp = F.try_to_timestamp(part(2), F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
    none = F.lit(None).cast("string")
    return lines.where(v.rlike(_CLF)).select(stamp.alias("ts"), F.lit(source).alias("source"), level.alias("level"), part(3).alias("message"), part(1).alias("host"), none.alias("process"), F.lit(None).cast("int").alias("pid"))


def parse_json(lines: DataFrame, value: str = "value") -> DataFrame:
    """One object a line; a line that is none is its own message."""
    v = F.col(value)
    j = F.from_json(v, "ts timestamp, timestamp timestamp, source string, level string, message string, msg string, host string, process string, pid int")
    rows = lines.where(F.trim(v) != "").select(v.alias("_line"), j.alias("j"))
    return rows.select(F.coalesce("j.ts", "j.timestamp").alias("ts"), F.coalesce("j.source", F.lit("json")).alias("source"), F.lower(F.coalesce("j.level", F.lit("info"))).alias("level"), F.coalesce("j.message", "j.msg", "_line").alias("message"), "j.host", "j.process", "j.pid")


def parse_csv(lines: DataFrame, value: str = "value") -> DataFrame:
    """ts, source, level, message, host, process, pid a line; the heading is left out."""
    v = F.col(value)
    c = F.from_csv(v, "ts timestamp, source string, level string, message string, host string, process string, pid int")
    return lines.where((F.trim(v) != "") & ~F.lower(v).startswith("ts,") & ~F.lower(v).startswith("timestamp,")).select(c.alias("c")).select("c.*")


def parse_custom(lines: DataFrame, value: str = "value") -> DataFrame:
    none = F.lit(None).cast("string")
    return lines.where(F.col(value) != "").select(F.lit(None).cast("timestamp").alias("ts"), F.lit("custom").alias("source"), _level(F.col(value)).alias("level"), F.col(value).alias("message"), none.alias("host"), none.alias("process"), F.lit(None).cast("int").alias("pid"))


PARSERS = {"syslog": parse_syslog, "apache": parse_apache, "nginx": lambda lines, value="value": parse_apache(lines, value, "nginx"), "json": parse_json, "csv": parse_csv, "custom": parse_custom}


def level_class(level: Column) -> Column:
    """error, warning, info or debug by the first that the level contains, else null."""
    low = F.lower(level)
    return F.when(low.contains("error") | low.contains("fatal"), "error").when(low.contains("warn"), "warning").when(low.contains("info"), "info").when(low.contains("debug"), "debug")


def filter_logs(logs: DataFrame, *, start: str = "", end: str = "", source: str = "", level: str = "", host: str = "", process: str = "", keyword: str = "", classes=("error", "warning", "info", "debug")) -> DataFrame:
    """Rows in the closed time range that contain the texts, case ignored; a null
    field passes; a level of no class passes."""
    keep = F.lit(True)
    if start:
        keep = keep & (F.col("ts") >= F.lit(start).cast("timestamp"))
    if end:
        keep = keep & (F.col("ts") <= F.lit(end).cast("timestamp"))
    for name, wanted in (("source", source), ("level", level), ("host", host), ("process", process), ("message", keyword)):
        if wanted:
            keep = keep & F.coalesce(F.lower(name).contains(wanted.lower()), F.lit(True))
    kind = level_class(F.col("level"))
    return logs.where(keep & (kind.isNull() | kind.isin(*classes)))


def log_statistics(logs: DataFrame, *keys: str) -> DataFrame:
    kind = level_class(F.col("level"))
    counts = [F.count_if(kind == k).alias(f"{k}_count") for k in ("error", "warning", "info", "debug")]
    return logs.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *counts, F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def first_sources(logs: DataFrame, order: str, n: int = 10) -> DataFrame:
    """The first ``n`` different sources in order of appearance."""
    return logs.where("source is not null").groupBy("source").agg(F.min(order).alias("first_seen")).orderBy("first_seen", "source").limit(n)


def top_sources(logs: DataFrame, n: int = 10) -> DataFrame:
    return logs.where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "source").limit(n)


def search_logs(logs: DataFrame, keyword: str, case_sensitive: bool = True) -> DataFrame:
    """(n): overlapping occurrences in all messages."""
    text, word = (F.col("message"), keyword) if case_sensitive else (F.lower("message"), keyword.lower())
    return logs.agg(F.coalesce(F.sum(overlapping_count(text, word)), F.lit(0)).alias("n"))


def formatted(logs: DataFrame, style: str) -> DataFrame:
    """(value) lines of a written log."""
    blank = lambda c, other="-": F.coalesce(F.col(c).cast("string"), F.lit(other))
    clf = F.concat(blank("host"), F.lit(" - - ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss Z"), F.lit('] "'), blank("message", ""), F.lit('" 200 1024'))
    lines = {
        "syslog": F.concat(F.date_format("ts", "MMM dd HH:mm:ss"), F.lit(" "), blank("host"), F.lit(" "), blank("process"), F.lit("["), blank("pid", "0"), F.lit("]: "), blank("message", "")),
        "apache": clf,
        "nginx": clf,
        "json": F.to_json(F.struct(*COLUMNS)),
        "csv": F.to_csv(F.struct(*COLUMNS)),
        "custom": blank("message", ""),
    }
    return logs.select(lines[style].alias("value"))
