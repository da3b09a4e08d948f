"""Queries of the general training-data operators, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.hierarchy import ancestors, current_rows, descendants, hierarchy
from siltstone.operators.snapshots import SnapshotStore, compared_fields, file_snapshot_changes, snapshot_rows
from siltstone.operators.timestamps import ABBREVIATIONS, MONTHS, normalise_stamps, read_stamps
from siltstone.runtime import Scratch, table


def _stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = (("file_timestamps", "stamp_id", "creation_time"), ("trash_entry", "trash_id", "deletion_date"), ("metadata_info", "metadata_id", "last_write_time"))
    stamps = None
    for name, key, text in parts:
        one = table(spark, sf_dir, name).select(F.lit(name).alias("stamp_table"), F.col(key).alias("stamp_id"), "host_id", F.col(text).alias("stamp"))
        stamps = one if stamps is None else stamps.unionByName(one)
    return stamps


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "scan_host")
    return normalise_stamps(_stamps(spark, sf_dir), hosts, hosts.count())


def _trees(spark: SparkSession, sf_dir: str, with_paths: bool = False) -> DataFrame:
    nodes = current_rows(table(spark, sf_dir, "treemap_node"), ["volume_id", "file_id"], "seq", ["path_id", "name", "size_logical"])
    return hierarchy(nodes.select(F.col("file_id").alias("id"), F.col("path_id").alias("parent"), "name", F.col("size_logical").alias("bytes")), with_paths)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trees(spark, sf_dir).select(F.col("id").alias("file_id"), F.col("root").alias("root_id"), "depth", F.col("n_below").cast("int").alias("n_below"))


def p3_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path and rolled-up size of each node."""
    return _trees(spark, sf_dir, True).select(F.col("id").alias("file_id"), "path", "total_bytes")


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descendants, by nested-set ranges, of each node whose id is divisible by 100."""
    trees = _trees(spark, sf_dir)
    return descendants(trees, trees.where("id % 100 = 0")).select(F.col("ancestor").alias("file_id"), F.col("id").alias("below_id"))


def p3_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ancestors, by nested-set ranges, of each node whose id is divisible by 100."""
    trees = _trees(spark, sf_dir)
    return ancestors(trees, trees.where("id % 100 = 0")).select(F.col("id").alias("file_id"), F.col("ancestor").alias("above_id"))


def p1_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many stamps of each table have an instant, and why the others have none."""
    hosts = table(spark, sf_dir, "scan_host")
    read = read_stamps(_stamps(spark, sf_dir), hosts, hosts.count())
    return read.groupBy("stamp_table", F.coalesce("reason", F.lit("instant")).alias("reason")).agg(F.count_distinct("stamp_id").alias("n"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_snapshot_changes(spark, sf_dir)


def p6_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of p6_found from as many runs as there are snapshots, each of which
    opens the folder of ordinals and blocks that the one before left."""
    rows = snapshot_rows(spark, sf_dir)
    path = f"{Scratch(spark, 'kept').root}/snapshots"
    numbers = sorted(r["snap_no"] for r in rows.select("snap_no").where("snap_no is not null").distinct().collect())
    return reduce(DataFrame.unionByName, (SnapshotStore(spark, path).add(rows.where(F.col("snap_no") == n), compared_fields()) for n in numbers))


QUERIES = {f.__name__: f for f in (p1_found, p1_reasons, p3_found, p3_paths, p3_descendants, p3_ancestors, p6_found, p6_resumed)}

_TREES = """
WITH RECURSIVE node AS (
  SELECT file_id, v.p AS p0, v.n AS name, v.s AS own FROM (SELECT file_id, arg_max(struct_pack(p := path_id, n := name, s := size_logical), seq) AS v FROM treemap_node GROUP BY file_id)
), link AS (
  SELECT n.file_id, p.file_id AS parent, coalesce(n.name, '') AS name, coalesce(n.own, 0) AS own FROM node n LEFT JOIN node p ON n.p0 = p.file_id AND n.p0 <> 0
), down AS (
  SELECT file_id, name AS path FROM link WHERE parent IS NULL
  UNION ALL SELECT l.file_id, d.path || '/' || l.name FROM down d JOIN link l ON l.parent = d.file_id
), up AS (
  SELECT l.file_id, l.parent AS above FROM link l JOIN down d ON l.file_id = d.file_id WHERE l.parent IS NOT NULL
  UNION ALL SELECT u.file_id, l.parent FROM up u JOIN link l ON u.above = l.file_id WHERE l.parent IS NOT NULL
)"""

#: Both instants that the offsets before and after may give are tried: one that shows
#: the stamp's time again settles it, two different ones or none leave it open.
_STAMPS = r"""
WITH raw AS (
  SELECT 'file_timestamps' AS stamp_table, stamp_id, host_id, creation_time AS stamp FROM file_timestamps
  UNION SELECT 'trash_entry', trash_id, host_id, deletion_date FROM trash_entry
  UNION SELECT 'metadata_info', metadata_id, host_id, last_write_time FROM metadata_info
), s AS (
  SELECT r.stamp_table, r.stamp_id, h.tz_name, h.locale, trim(regexp_replace(r.stamp, '\s+', ' ', 'g')) AS s FROM raw r LEFT JOIN scan_host h ON r.host_id = h.host_id WHERE r.stamp IS NOT NULL
), form AS (
  SELECT *, CASE
    WHEN regexp_matches(s, '^(\d{9,10}|\d{13}|\d{16,19})$') THEN 'count' WHEN regexp_matches(s, '^\d{9,10}\.\d{1,9}$') THEN 'fraction' WHEN regexp_matches(s, '^0[xX][0-9A-Fa-f]{12,16}$') THEN 'hex'
    WHEN regexp_matches(s, '^\d{4}-\d\d?-\d\d?[T ]\d') THEN 'iso' WHEN regexp_matches(s, '^\d{8}T?\d{6}$') THEN 'compact' WHEN regexp_matches(s, '^\d\d?[/.]\d\d?[/.]\d{4} ') THEN 'numeric'
    WHEN regexp_matches(s, '^(\p{L}+, )?\d\d? \p{L}+\.? \d{4} ') THEN 'worded' END AS form
  FROM s
), part AS (
  SELECT *, CASE form
    WHEN 'iso' THEN regexp_extract(s, '^(\d{4})-(\d\d?)-(\d\d?)[T ](\d\d?)[:.](\d\d)(?:[:.](\d\d)(?:[.,](\d{1,9}))?)?\s*(.*)$', ['y', 'mo', 'd', 'h', 'mi', 's', 'f', 'z'])
    WHEN 'compact' THEN regexp_extract(s, '^(\d{4})(\d\d)(\d\d)T?(\d\d)(\d\d)(\d\d)()()$', ['y', 'mo', 'd', 'h', 'mi', 's', 'f', 'z'])
    WHEN 'numeric' THEN CASE WHEN locale IN ('en-US', 'en-PH', 'fil-PH') THEN regexp_extract(s, '^(\d\d?)[/.](\d\d?)[/.](\d{4}) (\d\d?):(\d\d):(\d\d)()(.*)$', ['mo', 'd', 'y', 'h', 'mi', 's', 'f', 'z'])
      ELSE regexp_extract(s, '^(\d\d?)[/.](\d\d?)[/.](\d{4}) (\d\d?):(\d\d):(\d\d)()(.*)$', ['d', 'mo', 'y', 'h', 'mi', 's', 'f', 'z']) END
    WHEN 'worded' THEN regexp_extract(s, '^(?:\p{L}+, )?(\d\d?) (\p{L}+)\.? (\d{4}) (\d\d?):(\d\d)(?::(\d\d))?()(.*)$', ['d', 'mo', 'y', 'h', 'mi', 's', 'f', 'z']) END AS v
  FROM form
), num AS (
  SELECT *, try_cast(v.y AS INTEGER) AS y, CASE WHEN form = 'worded' THEN (map {@MONTHS})[lower(v.mo)[1:3]] ELSE try_cast(v.mo AS INTEGER) END AS mo, try_cast(v.d AS INTEGER) AS d,
    CASE WHEN form = 'numeric' AND trim(v.z) <> '' THEN CASE WHEN try_cast(v.h AS INTEGER) BETWEEN 1 AND 12 THEN try_cast(v.h AS INTEGER) % 12 + CASE WHEN lower(trim(v.z)) = 'pm' THEN 12 ELSE 0 END END ELSE try_cast(v.h AS INTEGER) END AS h,
    try_cast(v.mi AS INTEGER) AS mi, coalesce(try_cast(v.s AS INTEGER), 0) AS sec, coalesce(try_cast(rpad(v.f, 6, '0')[1:6] AS INTEGER), 0) AS us, CASE WHEN form = 'numeric' THEN '' ELSE trim(v.z) END AS z
  FROM part
), clock AS (
  SELECT *, CASE WHEN h <= 23 AND mi <= 59 AND sec <= 59 THEN epoch_us(try_cast(printf('%04d-%02d-%02d', y, mo, d) AS DATE)::TIMESTAMP) + (h * 3600 + mi * 60 + sec)::BIGINT * 1000000 + us END AS local,
    CASE form WHEN 'count' THEN CASE WHEN length(s) <= 10 THEN try_cast(s AS BIGINT) * 1000000 WHEN length(s) = 13 THEN try_cast(s AS BIGINT) * 1000 WHEN length(s) = 16 THEN try_cast(s AS BIGINT) WHEN length(s) <= 18 THEN try_cast(s AS BIGINT) // 10 - 11644473600000000 ELSE try_cast(s AS BIGINT) // 1000 END
      WHEN 'fraction' THEN try_cast(split_part(s, '.', 1) AS BIGINT) * 1000000 + try_cast(rpad(split_part(s, '.', 2), 6, '0')[1:6] AS BIGINT) WHEN 'hex' THEN try_cast('0x' || s[3:] AS BIGINT) // 10 - 11644473600000000 END AS counted,
    regexp_extract(z, '^(?:UTC|GMT)?([+-])(\d\d?):?(\d\d)?$', ['g', 'h', 'm']) AS o, (map {@ZONES})[z] AS named
  FROM num
), zoned AS (
  SELECT stamp_table, stamp_id, local, coalesce(counted, local - CASE WHEN o.g <> '' THEN CASE o.g WHEN '-' THEN -1 ELSE 1 END * (try_cast(o.h AS BIGINT) * 60 + coalesce(try_cast(o.m AS BIGINT), 0)) ELSE named END * 60000000) AS direct,
    CASE WHEN z = '' THEN tz_name WHEN z[1] = '[' THEN z[2:-2] END AS zone
  FROM clock WHERE counted IS NOT NULL OR local IS NOT NULL
), tried AS (
  SELECT *, local - (epoch_us(timezone(zone, timezone('UTC', make_timestamp(local - 129600000000)))) - (local - 129600000000)) AS u1, local - (epoch_us(timezone(zone, timezone('UTC', make_timestamp(local + 129600000000)))) - (local + 129600000000)) AS u2
  FROM zoned
), fits AS (
  SELECT *, direct IS NULL AND epoch_us(timezone(zone, timezone('UTC', make_timestamp(u1)))) = local AS ok1, direct IS NULL AND epoch_us(timezone(zone, timezone('UTC', make_timestamp(u2)))) = local AS ok2 FROM tried
)
SELECT DISTINCT stamp_table, stamp_id, CASE WHEN direct IS NOT NULL THEN direct WHEN ok1 THEN u1 ELSE u2 END AS utc_us FROM fits WHERE direct IS NOT NULL OR (ok1 AND ok2 AND u1 = u2) OR (ok1 <> ok2 AND (ok1 OR ok2))
"""
_STAMPS = _STAMPS.replace("@MONTHS", ", ".join(f"'{n}': {k}" for k, row in MONTHS.items() for n in row.split())).replace("@ZONES", ", ".join(f"'{z}': {m}" for z, m in ABBREVIATIONS.items()))

SQL = {
    "p1_found": _STAMPS,
    "p3_paths": f"""{_TREES}, below AS (
  SELECT u.above AS file_id, sum(l.own) AS s FROM up u JOIN link l ON u.file_id = l.file_id GROUP BY 1
)
SELECT l.file_id, d.path, CASE WHEN d.path IS NOT NULL THEN (l.own + coalesce(b.s, 0))::BIGINT END AS total_bytes FROM link l LEFT JOIN down d ON l.file_id = d.file_id LEFT JOIN below b ON l.file_id = b.file_id""",
    "p3_descendants": f"{_TREES} SELECT above AS file_id, file_id AS below_id FROM up WHERE above % 100 = 0",
    "p3_ancestors": f"{_TREES} SELECT file_id, above AS above_id FROM up WHERE file_id % 100 = 0",
    "p3_found": """
WITH RECURSIVE node AS (
  SELECT file_id, arg_max(path_id, seq) AS p0 FROM (SELECT file_id, coalesce(path_id, 0) AS path_id, seq FROM treemap_node) GROUP BY file_id
), link AS (
  SELECT n.file_id, p.file_id AS parent FROM node n LEFT JOIN node p ON n.p0 = p.file_id AND n.p0 <> 0
), down AS (
  SELECT file_id, file_id AS root_id, 0 AS depth FROM link WHERE parent IS NULL
  UNION ALL SELECT l.file_id, d.root_id, d.depth + 1 FROM down d JOIN link l ON l.parent = d.file_id
), up AS (
  SELECT l.file_id, l.parent AS above FROM link l JOIN down d ON l.file_id = d.file_id WHERE l.parent IS NOT NULL
  UNION ALL SELECT u.file_id, l.parent FROM up u JOIN link l ON u.above = l.file_id WHERE l.parent IS NOT NULL
), below AS (
  SELECT above AS file_id, count(*) AS n FROM up GROUP BY above
), lost AS (
  SELECT file_id, parent FROM link WHERE file_id NOT IN (SELECT file_id FROM down)
), reach AS (
  SELECT file_id, parent AS above FROM lost
  UNION SELECT r.file_id, l.parent FROM reach r JOIN lost l ON r.above = l.file_id
), ring AS (
  SELECT file_id FROM reach WHERE file_id = above
), least AS (
  SELECT r.file_id, min(r.above) AS root_id FROM reach r JOIN ring c ON r.above = c.file_id GROUP BY r.file_id
)
SELECT d.file_id, d.root_id, d.depth, CAST(coalesce(b.n, 0) AS INTEGER) AS n_below FROM down d LEFT JOIN below b ON d.file_id = b.file_id
UNION ALL SELECT file_id, root_id, -1, -1 FROM least
""",
    "p6_found": """
WITH latest AS (
  SELECT snap_no, volume_id, full_path, arg_max(struct_pack(s := size_logical, t := last_write_time), seq) AS v
  FROM file_snapshot GROUP BY ALL
), nos AS (
  SELECT snap_no, lag(snap_no) OVER (ORDER BY snap_no) AS prev_no FROM (SELECT DISTINCT snap_no FROM latest)
), old AS (
  SELECT n.snap_no, l.volume_id, l.full_path, l.v FROM latest l JOIN nos n ON l.snap_no = n.prev_no
), new AS (
  SELECT l.* FROM latest l JOIN nos n ON l.snap_no = n.snap_no WHERE n.prev_no IS NOT NULL
)
SELECT coalesce(o.snap_no, w.snap_no) AS snap_no, coalesce(o.volume_id, w.volume_id) AS volume_id, coalesce(o.full_path, w.full_path) AS full_path,
  CASE WHEN o.full_path IS NULL THEN 'added' WHEN w.full_path IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM old o FULL JOIN new w ON o.snap_no = w.snap_no AND o.volume_id = w.volume_id AND o.full_path = w.full_path
WHERE o.full_path IS NULL OR w.full_path IS NULL OR o.v.s IS DISTINCT FROM w.v.s OR o.v.t IS DISTINCT FROM w.v.t
""",
}
SQL["p6_resumed"] = SQL["p6_found"]
