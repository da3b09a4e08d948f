"""Written results: tables in several formats, log files, text and JSON reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.logs import formatted

FORMATS = ("csv", "json", "parquet", "orc", "xml")


def write_table(df: DataFrame, path: str, style: str, mode: str = "error") -> None:
    """One of FORMATS, case ignored; CSV has a heading, XML one ``row`` a record."""
    style = style.lower()
    if style not in FORMATS:
        raise ValueError(f"unknown format {style}")
    writer = df.write.mode(mode).format(style)
    writer = writer.option("header", True) if style == "csv" else writer.option("rowTag", "row") if style == "xml" else writer
    writer.save(path)


def write_log(logs: DataFrame, path: str, style: str, mode: str = "error") -> None:
    formatted(logs, style).write.mode(mode).text(path)


def write_carved(carved: DataFrame, path: str, mode: str = "error") -> None:
    """Carved data with names, as a table of binaries."""
    carved.select("name", "offset", "size", "extension", "data").write.mode(mode).parquet(path)


def json_documents(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """(keys, value): one JSON document ``{name: [...]}`` for each key, bounded by
    what the caller groups by."""
    rows = F.collect_list(F.struct(*(c for c in df.columns if c not in keys)))
    return df.groupBy(*keys).agg(F.to_json(F.struct(rows.alias(name))).alias("value"))


def audit_report(score: DataFrame, style: str = "text") -> DataFrame:
    """(value): lines or one JSON object of the row of ``audit_score``."""
    if style == "json":
        return score.select(F.to_json(F.struct(*score.columns)).alias("value"))
    labels = (("permissions", "Permissions checked"), ("insecure", "Insecure permissions"), ("vulnerabilities", "Vulnerabilities found"), ("critical", "Critical vulnerabilities"), ("violations", "Policy violations"))
    lines = [F.concat(F.lit(f"  {text}: "), F.col(c).cast("string")) for c, text in labels]
    return score.select(F.explode(F.array(F.lit("Security audit summary:"), *lines, F.concat(F.lit("  Overall score: "), F.format_string("%.2f%%", F.col("score") * 100)))).alias("value"))


def vulnerability_report(vulnerabilities: DataFrame) -> DataFrame:
    """(severity, n, exploitable, worst): counts and the highest score of each severity."""
    return vulnerabilities.groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_exploitable").alias("exploitable"), F.max("cvss_score").alias("worst"))


def compliance_report(results: DataFrame) -> DataFrame:
    """(checked, compliant, violations, percent) of policies with is_compliant; a null
    counts as a violation, and nothing checked is 0 percent."""
    met, n = F.count_if(F.coalesce("is_compliant", F.lit(False))), F.count(F.lit(1))
    return results.agg(n.alias("checked"), met.alias("compliant"), (n - met).alias("violations"), F.when(n > 0, met * 100 / n).otherwise(0.0).alias("percent"))


def report_lines(report: DataFrame, title: str) -> DataFrame:
    """(value): the title and a line ``column: value, ...`` for each row."""
    cells = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in report.columns]
    return report.sparkSession.createDataFrame([(title,)], "value string").unionByName(report.select(F.concat_ws(", ", *cells).alias("value")))


def memory_report(processes: DataFrame, connections: DataFrame) -> DataFrame:
    """(section, n, suspicious) of judged processes and connections."""
    parts = [df.agg(F.lit(name).alias("section"), F.count(F.lit(1)).alias("n"), F.count_if("is_suspicious").alias("suspicious")) for name, df in (("processes", processes), ("connections", connections))]
    return parts[0].unionByName(parts[1])
