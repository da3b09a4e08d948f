"""Command line: python -m siltstone.cli COMMAND ... (see --help).

scan writes catalog rows of the files below a folder; the other commands read
such a table and write theirs.  None changes a file.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.fuzzy import ssdeep
from siltstone.operators.catalog import residue_plan
from siltstone.operators.dedupe import duplicate_groups, duplicate_members, duplicate_plan
from siltstone.operators.layout import squarified
from siltstone.sources.files import scan
from siltstone.sources.sinks import FORMATS, write_table


def _scan(spark: SparkSession, a) -> DataFrame:
    return scan(spark, a.source, content=a.content, attributes=True, include_extensions=tuple(a.extension or ()), exclude_names=tuple(a.exclude or ()), min_size=a.min_size)


def _dedupe(spark: SparkSession, a) -> DataFrame:
    members = duplicate_members(spark.read.parquet(a.source), F.col("content"), min_size=max(1, a.min_size))
    return duplicate_groups(members) if a.action == "report" else duplicate_plan(members, a.action)


def _similar(spark: SparkSession, a) -> DataFrame:
    """Files of one fuzzy digest."""
    files = spark.read.parquet(a.source).select("file_id", ssdeep("content").alias("digest")).where("digest is not null")
    several = files.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return files.join(several, "digest")


def _cleanup(spark: SparkSession, a) -> DataFrame:
    files = spark.read.parquet(a.source)
    files = files.withColumn("accessed", F.coalesce("accessed", "modified"))
    return residue_plan(files, F.lit(a.as_of).cast("timestamp"), a.days, tuple(a.exclude or ()))


def _treemap(spark: SparkSession, a) -> DataFrame:
    return squarified(spark.read.parquet(a.source).select(F.lit(0).cast("bigint").alias("parent"), F.col("file_id").alias("id"), F.col("size_logical").alias("size")), a.width, a.height)


def _export(spark: SparkSession, a) -> DataFrame:
    return spark.read.parquet(a.source).drop("content")


COMMANDS = {"scan": _scan, "dedupe": _dedupe, "similar": _similar, "cleanup": _cleanup, "treemap": _treemap, "export": _export}


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="siltstone", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=sorted(COMMANDS))
    parser.add_argument("source", help="folder of files for scan, else a table that scan wrote")
    parser.add_argument("target", help="folder of the table to write")
    parser.add_argument("--format", choices=FORMATS, default="parquet")
    parser.add_argument("--content", action="store_true", help="scan: keep the bytes, which dedupe and similar need")
    parser.add_argument("--extension", action="append", help="scan: take in only these")
    parser.add_argument("--exclude", action="append", help="scan: names, cleanup: paths that contain this stay out")
    parser.add_argument("--min-size", type=int, default=0)
    parser.add_argument("--action", choices=("report", "simulate", "hardlink", "recycle", "delete"), default="report", help="dedupe: the action that the plan names")
    parser.add_argument("--days", type=int, default=0, help="cleanup: least age")
    parser.add_argument("--as-of", help="cleanup: the time that ages are counted to", default="2025-01-01")
    parser.add_argument("--width", type=float, default=1.0)
    parser.add_argument("--height", type=float, default=1.0)
    a = parser.parse_args(args)
    session = spark or SparkSession.builder.appName("siltstone").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    write_table(COMMANDS[a.command](session, a), a.target, a.format)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
