"""Queries on the file catalog, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import content, modes, paths, texts
from siltstone.operators import catalog as C
from siltstone.operators import stats as S
from siltstone.runtime import table

AS_OF = "2025-11-01 00:00:00"
_NOW = f"TIMESTAMP '{AS_OF}'"


def _files(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return C.current(table(spark, d, "file_entry"), list(columns))


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


def catalog_current(spark, d):
    return _files(spark, d, "full_path", "size_logical")


def catalog_get(spark, d):
    entries = table(spark, d, "file_entry")
    # The least key of volume 7 that the catalog holds.
    first = entries.where("volume_id = 7").agg(F.min("file_id")).first()[0]
    return C.get(entries, 7, first, ["full_path", "size_logical"])


def catalog_by_volume(spark, d):
    return C.by_volume(table(spark, d, "file_entry"), 7, ["full_path", "size_logical"])


def catalog_by_size(spark, d):
    return C.by_size(table(spark, d, "file_entry"), 1_000, 4_000, ["size_logical"])


def catalog_by_path(spark, d):
    entries = table(spark, d, "file_entry")
    first = entries.agg(F.min("full_path")).first()[0]
    return C.by_path(entries, first, ["full_path"])


def catalog_by_extension(spark, d):
    return C.by_extension(table(spark, d, "file_entry"), ".PDF", ["full_path"])


def catalog_by_date_range(spark, d):
    return C.by_date_range(table(spark, d, "file_entry"), "2023-01-01", "2023-06-30", ["full_path"]).select("volume_id", "file_id", F.unix_micros("modified").alias("modified_us"))


def catalog_stats(spark, d):
    return C.stats(table(spark, d, "file_entry"))


def catalog_upsert_delete(spark, d):
    """All of volume 7 deleted by later change rows."""
    entries = table(spark, d, "file_entry").select("volume_id", "file_id", "full_path", "size_logical", "seq", "deleted")
    gone = C.tombstones(entries.where("volume_id = 7").select("volume_id", "file_id").distinct(), F.lit(10**15), entries)
    return C.current(C.upsert(entries, gone), ["size_logical"])


def bloom_false_positive_rate(spark, d):
    sizes = C.stats(table(spark, d, "file_entry")).select("volume_id", F.col("entries").alias("n"))
    bits = F.ceil(F.ceil(-F.col("n") * F.log(F.lit(0.01)) / F.pow(F.log(F.lit(2.0)), 2)) / 64) * 64
    hashes = F.least(F.greatest(F.round(bits / F.col("n") * F.log(F.lit(2.0))), F.lit(1)), F.lit(20))
    return sizes.select("volume_id", bits.cast("bigint").alias("bits"), hashes.cast("int").alias("hashes"), F.round(C.bloom_rate(F.col("n"), bits, hashes), 9).alias("rate"))


def bloom_filter_members(spark, d):
    """Incoming digests, however written, that a filter over the catalog does not rule out, confirmed by a join."""
    entries = table(spark, d, "file_entry")
    known = entries.where("sha256 is not null").select(F.lower(F.hex("sha256")).alias("digest")).distinct()
    bits, hashes = C.bloom_size(max(1, entries.count()), 0.01)
    asked = table(spark, d, "incoming_entry").select(F.lower(F.hex(content.digest(F.col("sha256"), 32))).alias("digest")).where("digest is not null")
    maybe = C.bloom_might_contain(asked, ["digest"], C.bloom_build(known, ["digest"], bits, hashes), bits, hashes)
    return maybe.join(known, "digest", "left_semi")


def scan_filter(spark, d):
    files = _files(spark, d, "full_path", "size_logical")
    return C.scan_filter(files, exclude_prefixes=("/srv/v7/",), include_extensions=(".pdf", ".TXT", ".log"), exclude_extensions=(".log",), exclude_names=("index",), min_size=100, max_size=10_000_000)


def age_filter(spark, d):
    files = _files(spark, d, "full_path", "size_logical")
    return C.age_filter(files, include_extensions=(".pdf", ".PDF", ".zip"), exclude_extensions=(".zip",), include_paths=("/srv/", "D:\\"), exclude_paths=("cache",), min_size=1)


def include_exclude(spark, d):
    return C.include_exclude(_files(spark, d, "full_path"), include=("archive", "backup"), exclude=("cache", "tmp"))


def old_files(spark, d):
    return C.old_files(_files(spark, d, "modified"), "modified", 24 * 365 * 3, _as_of()).select("volume_id", "file_id", F.unix_micros("modified").alias("modified_us"))


def recent_files(spark, d):
    return C.recent_files(_files(spark, d, "modified"), "modified", 24 * 180, _as_of()).select("volume_id", "file_id", F.unix_micros("modified").alias("modified_us"))


def advanced_filter(spark, d):
    return C.advanced_filter(_files(spark, d, "full_path", "size_logical", "modified"), name="*_*.*", types=("pdf", "txt", "log"), min_size=10, max_size=5_000_000, start="2022-01-01", end="2024-12-31", pattern="^[a-m]").select("volume_id", "file_id", "full_path")


def hidden_files(spark, d):
    return C.hidden_files(_files(spark, d, "full_path", "mode").where("full_path is not null")).select("volume_id", "file_id", "is_hidden", "has_suspicious_name", "has_suspicious_permissions", "reason")


def type_distribution(spark, d):
    return C.type_distribution(_files(spark, d, "full_path", "size_logical").where("full_path is not null"))


def age_distribution(spark, d):
    return C.age_distribution(_files(spark, d, "modified", "size_logical"), _as_of())


def age_statistics(spark, d):
    got = C.age_statistics(_files(spark, d, "created", "size_logical"), _as_of())
    return got.withColumns({"oldest": F.unix_micros("oldest"), "newest": F.unix_micros("newest")})


def largest_files(spark, d):
    return C.largest(_files(spark, d, "size_logical").where("size_logical is not null"), 1000)


def directory_rollup(spark, d):
    return C.directory_rollup(_files(spark, d, "full_path", "size_logical"), 3)


def residue_plan(spark, d):
    return C.residue_plan(_files(spark, d, "full_path", "size_logical", "accessed"), _as_of(), min_days=30, exclude=("keep",))


def residue_savings(spark, d):
    plan = residue_plan(spark, d)
    return plan.groupBy("file_type").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


def empty_directories(spark, d):
    nodes = C.current_rows(table(spark, d, "treemap_node"), ["volume_id", "file_id"], "seq", ["path_id", "name", "is_directory"])
    return C.empty_directories(nodes)


def trash_listing(spark, d):
    """Trash entries with both paths, the latest received of each."""
    rows = C.current_rows(table(spark, d, "trash_entry"), ["trash_id"], "received_at", ["trashed_path", "original_path", "deletion_date"])
    return rows.where("trashed_path is not null and original_path is not null").select("trash_id", paths.base_name(F.col("trashed_path")).alias("name"), "original_path", F.trim("deletion_date").alias("deletion_date"))


def catalog_projection(spark, d):
    """Derived columns of a catalog row: block-rounded size, mode text, names."""
    f = _files(spark, d, "full_path", "size_logical", "mode")
    size = F.col("size_logical")
    return f.where("full_path is not null").select(
        "volume_id", "file_id", (F.ceil(size / 4096) * 4096).cast("bigint").alias("size_on_disk"), modes.permission_string(F.col("mode")).alias("permissions"),
        modes.file_type(F.col("mode")).alias("kind"), paths.base_name(F.col("full_path")).alias("name"), paths.parent(F.col("full_path")).alias("directory"),
        paths.extension(F.col("full_path")).alias("extension"), texts.format_size_whole(size).alias("shown"), texts.size_class(size).alias("band"),
    )


def size_histogram(spark, d):
    return S.histogram(_files(spark, d, "size_logical").where("size_logical is not null"), F.col("size_logical"), 65_536, 64).withColumn("total", F.col("total").cast("bigint"))


def size_histogram_percentiles(spark, d):
    return S.histogram_percentiles(size_histogram(spark, d), 65_536, [50.0, 90.0, 95.0, 99.0, 99.9])


def size_percentiles_by_index(spark, d):
    got = S.order_statistics(_files(spark, d, "size_logical"), "size_logical", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return spark.createDataFrame([tuple(got.values())], "p50 long, p95 long, p99 long")


def snapshot_comparison(spark, d):
    """Totals of each snapshot against the one before: differences, percentages, growth a day."""
    rows = C.current_rows(table(spark, d, "file_snapshot"), ["snap_no", "volume_id", "full_path"], "seq", ["size_logical", "taken_at"])
    totals = rows.groupBy("snap_no").agg(F.min("taken_at").alias("taken_at"), F.count(F.lit(1)).alias("files"), F.sum("size_logical").alias("bytes"))
    order = Window.orderBy("snap_no")  # a row per snapshot
    before = {c: F.lag(c).over(order) for c in ("taken_at", "files", "bytes")}
    days = F.datediff("taken_at", before["taken_at"])
    return totals.select(
        "snap_no", "files", "bytes", (F.col("files") - before["files"]).alias("files_diff"), (F.col("bytes") - before["bytes"]).alias("bytes_diff"),
        F.round(texts.share_change(before["files"], F.col("files")), 6).alias("files_percent"), F.round(texts.share_change(before["bytes"], F.col("bytes")), 6).alias("bytes_percent"),
        F.round((F.col("bytes") - before["bytes"]) / days, 3).alias("growth_per_day"),
    ).where("snap_no > 1")


def order_trend(spark, d):
    """Monthly totals with change and percentage change."""
    months = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    old = F.lag("n").over(Window.orderBy("month"))
    return months.select("month", "n", (F.col("n") - old).alias("change"), F.round(texts.percent_change(old, F.col("n")), 6).alias("percent"))


_CUR = "SELECT * FROM file_entry QUALIFY row_number() OVER (PARTITION BY volume_id, file_id ORDER BY seq DESC) = 1"
_LIVE = f"(SELECT * FROM ({_CUR}) WHERE NOT deleted)"
_EXT = "regexp_extract(full_path, '(\\.[^.]*)$', 1)"
_BASE = "regexp_extract(full_path, '([^/\\\\]*)$', 1)"
_SUFFIX = f"lower(regexp_extract({_BASE}, '\\.([^.]*)$', 1))"
_PARENT = "regexp_extract(full_path, '^(.*)[/\\\\][^/\\\\]*$', 1)"


def _bit(n: int, letter: str) -> str:
    return f"CASE WHEN mode & {n} <> 0 THEN '{letter}' ELSE '-' END"


def _exec(bit: int, special: int, small: str, large: str) -> str:
    return f"CASE WHEN mode & {special} <> 0 THEN CASE WHEN mode & {bit} <> 0 THEN '{small}' ELSE '{large}' END WHEN mode & {bit} <> 0 THEN 'x' ELSE '-' END"


_MODE = " || ".join(["CASE WHEN mode & 61440 = 16384 THEN 'd' WHEN mode & 61440 = 40960 THEN 'l' ELSE '-' END", _bit(256, "r"), _bit(128, "w"), _exec(64, 2048, "s", "S"), _bit(32, "r"), _bit(16, "w"), _exec(8, 1024, "s", "S"), _bit(4, "r"), _bit(2, "w"), _exec(1, 512, "t", "T")])
_RESIDUE = f"""
SELECT full_path, max(CASE WHEN contains(low, '.tmp') OR contains(low, '.temp') THEN 'temp' WHEN contains(low, '.log') THEN 'log' ELSE 'cache' END) AS file_type, max(size_logical) AS bytes, 'simulate' AS action
FROM (SELECT *, lower(full_path) AS low FROM {_LIVE})
WHERE datediff('microsecond', accessed::TIMESTAMP, {_NOW}) // 86400000000 >= 30 AND NOT contains(full_path, 'keep')
  AND (contains(low, '.tmp') OR contains(low, '.temp') OR contains(low, '.log') OR contains(low, '.cache') OR contains(low, '\\temp\\') OR contains(low, '/tmp/') OR contains(low, '\\cache\\') OR contains(low, '/cache/'))
GROUP BY full_path"""
_BUCKET = "CAST(greatest(least(floor(size_logical / 65536), 63), 0) AS INTEGER)"
_HISTOGRAM = f"SELECT {_BUCKET} AS bucket, count(*) AS n, CAST(sum(size_logical) AS BIGINT) AS total, min(size_logical) AS least, max(size_logical) AS most FROM {_LIVE} WHERE size_logical IS NOT NULL GROUP BY 1"
_RANKED = f"SELECT size_logical AS v, row_number() OVER (ORDER BY size_logical) - 1 AS i, count(*) OVER () AS n FROM {_LIVE} WHERE size_logical IS NOT NULL"
_AGES = f"SELECT *, datediff('microsecond', created::TIMESTAMP, {_NOW}) // 3600000000 AS age FROM {_LIVE}"

QUERIES = {
    f.__name__: f
    for f in (
        catalog_current, catalog_get, catalog_by_volume, catalog_by_size, catalog_by_path, catalog_by_extension, catalog_by_date_range, catalog_stats, catalog_upsert_delete, bloom_false_positive_rate,
        bloom_filter_members, scan_filter, age_filter, include_exclude, old_files, recent_files, advanced_filter, hidden_files, type_distribution, age_distribution, age_statistics, largest_files,
        directory_rollup, residue_plan, residue_savings, empty_directories, trash_listing, catalog_projection, size_histogram, size_histogram_percentiles, size_percentiles_by_index, snapshot_comparison, order_trend,
    )
}

SQL = {
    "catalog_current": f"SELECT volume_id, file_id, full_path, size_logical FROM {_LIVE}",
    "catalog_get": f"SELECT volume_id, file_id, full_path, size_logical FROM {_LIVE} WHERE volume_id = 7 AND file_id = (SELECT min(file_id) FROM file_entry WHERE volume_id = 7)",
    "catalog_by_volume": f"SELECT volume_id, file_id, full_path, size_logical FROM {_LIVE} WHERE volume_id = 7",
    "catalog_by_size": f"SELECT volume_id, file_id, size_logical FROM {_LIVE} WHERE size_logical BETWEEN 1000 AND 4000",
    "catalog_by_path": f"SELECT volume_id, file_id, full_path FROM {_LIVE} WHERE full_path = (SELECT min(full_path) FROM file_entry)",
    "catalog_by_extension": f"SELECT volume_id, file_id, full_path FROM {_LIVE} WHERE lower({_EXT}) = '.pdf'",
    "catalog_by_date_range": f"SELECT volume_id, file_id, epoch_us(modified) AS modified_us FROM {_LIVE} WHERE modified BETWEEN TIMESTAMPTZ '2023-01-01 00:00:00+00' AND TIMESTAMPTZ '2023-06-30 00:00:00+00'",
    "catalog_stats": f"SELECT volume_id, count(*) AS entries, count(*) FILTER (WHERE NOT deleted) AS live, CAST(sum(size_logical) FILTER (WHERE NOT deleted) AS BIGINT) AS bytes FROM ({_CUR}) GROUP BY 1",
    "catalog_upsert_delete": f"SELECT volume_id, file_id, size_logical FROM {_LIVE} WHERE volume_id <> 7",
    "bloom_false_positive_rate": f"""
WITH c AS (SELECT volume_id, count(*) AS n FROM ({_CUR}) GROUP BY 1),
b AS (SELECT *, ceil(ceil(-n * ln(0.01::DOUBLE) / pow(ln(2.0::DOUBLE), 2)) / 64) * 64 AS m FROM c),
h AS (SELECT *, least(greatest(round(m / n * ln(2.0::DOUBLE)), 1), 20) AS k FROM b)
SELECT volume_id, CAST(m AS BIGINT) AS bits, CAST(k AS INTEGER) AS hashes, round(pow(1 - exp(-k * n / m), k), 9) AS rate FROM h""",
    "bloom_filter_members": """
SELECT DISTINCT digest FROM (SELECT CASE WHEN length(sha256) = 44 THEN lower(hex(from_base64(sha256))) ELSE lower(replace(replace(trim(sha256), 'sha256:', ''), ':', '')) END AS digest FROM incoming_entry)
WHERE digest IN (SELECT lower(hex(sha256)) FROM file_entry WHERE sha256 IS NOT NULL)""",
    "scan_filter": f"SELECT volume_id, file_id, full_path, size_logical FROM {_LIVE} WHERE NOT starts_with(full_path, '/srv/v7/') AND lower({_EXT}) IN ('.pdf', '.txt') AND NOT contains({_BASE}, 'index') AND size_logical BETWEEN 100 AND 10000000",
    "age_filter": f"SELECT volume_id, file_id, full_path, size_logical FROM {_LIVE} WHERE size_logical >= 1 AND {_EXT} IN ('.pdf', '.PDF') AND (contains(full_path, '/srv/') OR contains(full_path, 'D:\\')) AND NOT contains(full_path, 'cache')",
    "include_exclude": f"SELECT volume_id, file_id, full_path FROM {_LIVE} WHERE (contains(full_path, 'archive') OR contains(full_path, 'backup')) AND NOT contains(full_path, 'cache') AND NOT contains(full_path, 'tmp')",
    "old_files": f"SELECT volume_id, file_id, epoch_us(modified) AS modified_us FROM {_LIVE} WHERE modified::TIMESTAMP <= {_NOW} - INTERVAL 26280 HOUR",
    "recent_files": f"SELECT volume_id, file_id, epoch_us(modified) AS modified_us FROM {_LIVE} WHERE modified::TIMESTAMP >= {_NOW} - INTERVAL 4320 HOUR",
    "advanced_filter": f"SELECT volume_id, file_id, full_path FROM {_LIVE} WHERE regexp_matches({_BASE}, '(?is)^.*_.*\\..*$') AND {_SUFFIX} IN ('pdf', 'txt', 'log') AND size_logical BETWEEN 10 AND 5000000 AND modified BETWEEN TIMESTAMPTZ '2022-01-01 00:00:00+00' AND TIMESTAMPTZ '2024-12-31 00:00:00+00' AND regexp_matches({_BASE}, '^[a-m]')",
    "hidden_files": f"""
SELECT volume_id, file_id, h AS is_hidden, n AS has_suspicious_name, p AS has_suspicious_permissions,
  CASE WHEN h THEN 'Hidden file' WHEN n THEN 'Suspicious filename' WHEN p THEN 'Suspicious permissions' ELSE 'No suspicious characteristics' END AS reason
FROM (SELECT volume_id, file_id, starts_with({_BASE}, '.') AS h,
  regexp_matches({_BASE}, '\\.\\.|~|\\.tmp|\\.temp|\\.bak|\\.old|\\.orig|\\.sw[pon]|\\.lock|\\.pid|\\.log') OR regexp_matches({_BASE}, '^[.0-9]*$') OR strlen({_BASE}) > 255 AS n,
  (mode & 61440) <> 16384 AND (mode & 3074) <> 0 AS p FROM {_LIVE} WHERE full_path IS NOT NULL)""",
    "type_distribution": f"SELECT CASE WHEN {_SUFFIX} = '' THEN '(none)' ELSE {_SUFFIX} END AS type, count(*) AS n, CAST(sum(size_logical) AS BIGINT) AS bytes FROM {_LIVE} WHERE full_path IS NOT NULL GROUP BY 1",
    "age_distribution": f"""
SELECT CAST(s.slot AS INTEGER) AS slot, CAST(coalesce(sum(size_logical), 0) AS BIGINT) AS bytes
FROM range(12) s(slot) LEFT JOIN (SELECT size_logical, 11 - greatest(least((2025 - year(modified::TIMESTAMP)) * 12 + 11 - month(modified::TIMESTAMP), 11), 0) AS slot FROM {_LIVE} WHERE modified IS NOT NULL) f ON s.slot = f.slot GROUP BY 1""",
    "age_statistics": f"""
WITH a AS ({_AGES}), r AS (SELECT age, row_number() OVER (ORDER BY age) - 1 AS i, count(*) OVER () AS n FROM a)
SELECT (SELECT count(*) FROM a) AS total_files, (SELECT CAST(sum(size_logical) AS BIGINT) FROM a) AS total_size, (SELECT epoch_us(min(created)) FROM a) AS oldest, (SELECT epoch_us(max(created)) FROM a) AS newest,
  CAST((SELECT sum(age) // count(*) FROM a) AS BIGINT) AS average_hours,
  (SELECT min(age) FROM r WHERE i = least(floor(n * 0.5), n - 1)) AS median_hours, (SELECT min(age) FROM r WHERE i = least(floor(n * 0.95), n - 1)) AS p95_hours, (SELECT min(age) FROM r WHERE i = least(floor(n * 0.99), n - 1)) AS p99_hours""",
    "largest_files": f"SELECT volume_id, file_id, size_logical FROM {_LIVE} WHERE size_logical IS NOT NULL ORDER BY size_logical DESC, file_id LIMIT 1000",
    "directory_rollup": f"""
SELECT CAST(k AS INTEGER) AS depth, array_to_string(parts[1:k], '/') AS directory, count(*) AS files, CAST(sum(size_logical) AS BIGINT) AS bytes
FROM (SELECT size_logical, string_split(regexp_replace(replace({_PARENT}, '\\', '/'), '^/', ''), '/') AS parts FROM {_LIVE} WHERE full_path IS NOT NULL), range(1, 4) t(k)
WHERE k <= len(parts) GROUP BY 1, 2""",
    "residue_plan": _RESIDUE,
    "residue_savings": f"SELECT file_type, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM ({_RESIDUE}) GROUP BY 1",
    "empty_directories": """
WITH n AS (SELECT * FROM treemap_node QUALIFY row_number() OVER (PARTITION BY volume_id, file_id ORDER BY seq DESC) = 1)
SELECT file_id, volume_id, name FROM n WHERE is_directory AND file_id NOT IN (SELECT path_id FROM n WHERE path_id IS NOT NULL)""",
    "trash_listing": """
SELECT trash_id, regexp_extract(trashed_path, '([^/\\\\]*)$', 1) AS name, original_path, trim(deletion_date) AS deletion_date
FROM (SELECT trash_id, max(row(received_at, trashed_path, original_path, deletion_date)) AS r FROM trash_entry GROUP BY 1) x, LATERAL (SELECT 1) y, LATERAL (SELECT r[2] AS trashed_path, r[3] AS original_path, r[4] AS deletion_date) z
WHERE trashed_path IS NOT NULL AND original_path IS NOT NULL""",
    "catalog_projection": f"""
SELECT volume_id, file_id, CAST(ceil(size_logical / 4096) * 4096 AS BIGINT) AS size_on_disk, {_MODE} AS permissions,
  CASE WHEN mode & 61440 = 16384 THEN 'directory' WHEN mode & 61440 = 40960 THEN 'symbolic link' ELSE 'regular file' END AS kind,
  {_BASE} AS name, {_PARENT} AS directory, {_EXT} AS extension,
  CASE WHEN size_logical < 1024 THEN size_logical || ' B' WHEN size_logical < 1048576 THEN size_logical // 1024 || ' KB' WHEN size_logical < 1073741824 THEN size_logical // 1048576 || ' MB' ELSE size_logical // 1073741824 || ' GB' END AS shown,
  CASE WHEN size_logical < 1024 THEN 'tiny' WHEN size_logical < 1048576 THEN 'small' WHEN size_logical < 10485760 THEN 'medium' WHEN size_logical < 104857600 THEN 'large' WHEN size_logical < 1073741824 THEN 'huge' ELSE 'giant' END AS band
FROM {_LIVE} WHERE full_path IS NOT NULL""",
    "size_histogram": _HISTOGRAM,
    "size_histogram_percentiles": f"""
WITH r AS (SELECT bucket, sum(n) OVER (ORDER BY bucket) AS upto, sum(n) OVER () AS all_n FROM ({_HISTOGRAM}))
SELECT CAST(p AS DOUBLE) AS percent, CAST(min(bucket) * 65536 AS BIGINT) AS value FROM r, unnest([50.0, 90.0, 95.0, 99.0, 99.9]) t(p) WHERE upto >= all_n * p / 100 GROUP BY 1""",
    "size_percentiles_by_index": f"SELECT max(v) FILTER (WHERE i = least(floor(n * 0.5), n - 1)) AS p50, max(v) FILTER (WHERE i = least(floor(n * 0.95), n - 1)) AS p95, max(v) FILTER (WHERE i = least(floor(n * 0.99), n - 1)) AS p99 FROM ({_RANKED})",
    "snapshot_comparison": """
WITH l AS (SELECT * FROM file_snapshot QUALIFY row_number() OVER (PARTITION BY snap_no, volume_id, full_path ORDER BY seq DESC) = 1),
t AS (SELECT snap_no, min(taken_at) AS taken_at, count(*) AS files, CAST(sum(size_logical) AS BIGINT) AS bytes FROM l GROUP BY 1),
g AS (SELECT *, lag(files) OVER w AS f0, lag(bytes) OVER w AS b0, lag(taken_at) OVER w AS t0 FROM t WINDOW w AS (ORDER BY snap_no))
SELECT snap_no, files, bytes, files - f0 AS files_diff, bytes - b0 AS bytes_diff, round(CASE WHEN f0 > 0 THEN (files - f0) / f0 * 100 ELSE 0 END, 6) AS files_percent,
  round(CASE WHEN b0 > 0 THEN (bytes - b0) / b0 * 100 ELSE 0 END, 6) AS bytes_percent, round((bytes - b0) / datediff('day', t0, taken_at), 3) AS growth_per_day
FROM g WHERE snap_no > 1""",
    "order_trend": """
WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1), g AS (SELECT *, lag(n) OVER (ORDER BY month) AS o FROM m)
SELECT month, n, n - o AS change, round(CASE WHEN o IS NULL THEN NULL WHEN o = 0 THEN CASE WHEN n > 0 THEN 100.0 ELSE 0.0 END ELSE (n - o) / o * 100 END, 6) AS percent FROM g""",
}
