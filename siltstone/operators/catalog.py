"""The file catalog: versions, tombstones, look-ups, filters, distributions.

Rows carry volume_id, file_id, seq and deleted; the row with the highest seq
of a file holds, and a deleted one is a tombstone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import paths
from siltstone.functions.modes import suspicious
from siltstone.functions.times import age_days, age_hours, age_months
from siltstone.operators.hierarchy import current_rows

KEY = ["volume_id", "file_id"]


def latest(entries: DataFrame, columns: list[str]) -> DataFrame:
    """Every file's current row, tombstones included."""
    return current_rows(entries, KEY, "seq", [c for c in dict.fromkeys([*columns, "deleted"]) if c not in KEY])


def current(entries: DataFrame, columns: list[str]) -> DataFrame:
    """Current rows of files that are not deleted."""
    return latest(entries, columns).where("not deleted").select(*dict.fromkeys([*KEY, *columns]))


def upsert(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """The catalog with change rows added; they win by their higher seq."""
    return entries.unionByName(changes)


def tombstones(keys: DataFrame, seq: Column, like: DataFrame) -> DataFrame:
    """Change rows that delete ``keys``, in the columns of ``like``."""
    known = {"volume_id": F.col("volume_id"), "file_id": F.col("file_id"), "seq": seq, "deleted": F.lit(True)}
    return keys.select(*(known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema))


def get(entries: DataFrame, volume_id: int, file_id: int, columns: list[str]) -> DataFrame:
    """One file; the key filters reach the scan before the versions are compared."""
    return current(entries.where((F.col("volume_id") == volume_id) & (F.col("file_id") == file_id)), columns)


def by_volume(entries: DataFrame, volume_id: int, columns: list[str]) -> DataFrame:
    return current(entries.where(F.col("volume_id") == volume_id), columns)


def by_size(entries: DataFrame, least: int, most: int, columns: list[str]) -> DataFrame:
    """A size belongs to a version, so it is tested after the current one is known."""
    return current(entries, [*columns, "size_logical"]).where(F.col("size_logical").between(least, most))


def by_path(entries: DataFrame, path: str, columns: list[str]) -> DataFrame:
    return current(entries, [*columns, "full_path"]).where(F.col("full_path") == path)


def by_extension(entries: DataFrame, extension: str, columns: list[str]) -> DataFrame:
    return current(entries, [*columns, "full_path"]).where(F.lower(paths.extension(F.col("full_path"))) == extension.lower())


def by_date_range(entries: DataFrame, start: str, end: str, columns: list[str]) -> DataFrame:
    """Files last written in the closed range."""
    return current(entries, [*columns, "modified"]).where(F.col("modified").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def stats(entries: DataFrame) -> DataFrame:
    """(volume_id, entries, live, bytes) over current rows."""
    rows = latest(entries, ["size_logical"])
    return rows.groupBy("volume_id").agg(F.count(F.lit(1)).alias("entries"), F.count_if(~F.col("deleted")).alias("live"), F.sum(F.when(~F.col("deleted"), F.col("size_logical"))).alias("bytes"))


def bloom_size(elements: int, rate: float) -> tuple[int, int]:
    """Bits, rounded up to 64, and hash functions, 1 to 20, of a Bloom filter."""
    bits = -(-math.ceil(-elements * math.log(rate) / math.log(2) ** 2) // 64) * 64
    return bits, min(20, max(1, round(bits / max(1, elements) * math.log(2))))


def bloom_rate(elements: Column, bits: Column, hashes: Column) -> Column:
    """Chance of a false positive."""
    return F.pow(1 - F.exp(-hashes * elements / bits), hashes)


def bloom_places(key: list[Column], bits: int, hashes: int) -> Column:
    """Bit places of a key by double hashing."""
    one, two = F.xxhash64(*key), F.xxhash64(*key, F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(F.pmod(one, F.lit(bits)) + i * F.pmod(two, F.lit(bits)), F.lit(bits)))


def bloom_build(keys: DataFrame, key: list[str], bits: int, hashes: int) -> DataFrame:
    """(block, bitmap): the filter as built-in bitmaps of 32768 bits, which merge by OR."""
    places = keys.select(F.explode(bloom_places([F.col(c) for c in key], bits, hashes)).alias("place"))
    return places.groupBy(F.bitmap_bucket_number("place").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap"))


def bloom_might_contain(keys: DataFrame, key: list[str], blocks: DataFrame, bits: int, hashes: int) -> DataFrame:
    """``keys`` that the filter does not rule out; those it holds are never lost.

    The bitmaps are joined by block, so that a filter of any size works.
    """
    asked = keys.select(*key).distinct().withColumn("place", F.explode(F.array_distinct(bloom_places([F.col(c) for c in key], bits, hashes))))
    asked = asked.select(*key, F.bitmap_bucket_number("place").alias("block"), F.bitmap_bit_position("place").alias("bit"))
    byte = F.conv(F.hex(F.substring("bitmap", (F.floor(F.col("bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    on = F.call_function("getbit", byte, F.pmod(F.col("bit"), F.lit(8)).cast("int")) == 1
    return asked.join(blocks, "block", "left").groupBy(*key).agg(F.bool_and(F.coalesce(on, F.lit(False))).alias("maybe")).where("maybe").drop("maybe")


def scan_filter(files: DataFrame, *, exclude_prefixes=(), include_extensions=(), exclude_extensions=(), exclude_names=(), min_size: int = 0, max_size: int = 0) -> DataFrame:
    """Files that a scan takes in.  Prefixes exclude paths; extensions go by lower
    case, and with an include list a file without one is out; names are excluded
    by substring; a bound of 0 is off."""
    path, ext = F.col("full_path"), F.lower(paths.extension(F.col("full_path")))
    keep = F.lit(True)
    for p in exclude_prefixes:
        keep = keep & ~path.startswith(p)
    if include_extensions:
        keep = keep & ext.isin(*(e.lower() for e in include_extensions))
    if exclude_extensions:
        keep = keep & ~ext.isin(*(e.lower() for e in exclude_extensions))
    if exclude_names:
        keep = keep & ~paths.contains_any(paths.base_name(path), exclude_names)
    if min_size:
        keep = keep & (F.col("size_logical") >= min_size)
    if max_size:
        keep = keep & (F.col("size_logical") <= max_size)
    return files.where(keep)


def age_filter(files: DataFrame, *, include_extensions=(), exclude_extensions=(), include_paths=(), exclude_paths=(), min_size: int = 0, max_size: int = 0) -> DataFrame:
    """As ``scan_filter``, but extensions keep their case and paths go by substring."""
    path, ext = F.col("full_path"), paths.extension(F.col("full_path"))
    keep = F.lit(True)
    if min_size:
        keep = keep & (F.col("size_logical") >= min_size)
    if max_size:
        keep = keep & (F.col("size_logical") <= max_size)
    if include_extensions:
        keep = keep & ext.isin(*include_extensions)
    if exclude_extensions:
        keep = keep & ~ext.isin(*exclude_extensions)
    if include_paths:
        keep = keep & paths.contains_any(path, include_paths)
    if exclude_paths:
        keep = keep & ~paths.contains_any(path, exclude_paths)
    return files.where(keep)


def include_exclude(files: DataFrame, include=(), exclude=()) -> DataFrame:
    """An excluded substring wins; with includes one of them must occur."""
    keep = ~paths.contains_any(F.col("full_path"), exclude)
    return files.where(keep & paths.contains_any(F.col("full_path"), include) if include else keep)


def old_files(files: DataFrame, time: str, hours: int, as_of: Column) -> DataFrame:
    return files.where(F.unix_micros(as_of) - F.unix_micros(time) >= hours * 3_600_000_000)


def recent_files(files: DataFrame, time: str, hours: int, as_of: Column) -> DataFrame:
    return files.where(F.unix_micros(as_of) - F.unix_micros(time) <= hours * 3_600_000_000)


def glob_pattern(glob: str) -> str:
    """Regular expression, case ignored, of a wildcard name."""
    out = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() and c not in "_[]" else c for c in glob)
    return f"(?is)^{out}$"


def advanced_filter(files: DataFrame, *, name: str = "", types=(), min_size: int = 0, max_size: int = 0, start: str = "", end: str = "", pattern: str = "") -> DataFrame:
    """Wildcard on the name, suffixes, size bounds, last-write range and a
    regular expression found in the name; what is empty or 0 is off."""
    base = paths.base_name(F.col("full_path"))
    keep = F.lit(True)
    if name:
        keep = keep & base.rlike(glob_pattern(name))
    if types:
        keep = keep & paths.suffix(F.col("full_path")).isin(*(t.lower() for t in types))
    if min_size:
        keep = keep & (F.col("size_logical") >= min_size)
    if max_size:
        keep = keep & (F.col("size_logical") <= max_size)
    if start and end:
        if start > end:
            raise ValueError("the range ends before it starts")
        keep = keep & F.col("modified").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    if pattern:
        keep = keep & base.rlike(pattern)
    return files.where(keep)


#: Parts of a file name that make it suspicious.
SUSPICIOUS_NAMES = ("..", "~", ".tmp", ".temp", ".bak", ".old", ".orig", ".swp", ".swo", ".swn", ".lock", ".pid", ".log")


def suspicious_name(name: Column) -> Column:
    return paths.contains_any(name, SUSPICIOUS_NAMES) | name.rlike(r"^[.0-9]*$") | (F.octet_length(name) > 255)


def hidden_files(files: DataFrame) -> DataFrame:
    """Files with flags is_hidden, has_suspicious_name, has_suspicious_permissions
    and a reason, of which hidden goes first, then the name, then permissions."""
    name = paths.base_name(F.col("full_path"))
    flagged = files.select("*", name.startswith(".").alias("is_hidden"), suspicious_name(name).alias("has_suspicious_name"), suspicious(F.col("mode")).alias("has_suspicious_permissions"))
    reason = F.when(F.col("is_hidden"), "Hidden file").when(F.col("has_suspicious_name"), "Suspicious filename").when(F.col("has_suspicious_permissions"), "Suspicious permissions").otherwise("No suspicious characteristics")
    return flagged.withColumn("reason", reason)


def type_distribution(files: DataFrame) -> DataFrame:
    """(type, n, bytes) by lower-case suffix, ``(none)`` without one."""
    kind = paths.suffix(F.col("full_path"))
    return files.groupBy(F.when(kind == "", "(none)").otherwise(kind).alias("type")).agg(F.count(F.lit(1)).alias("n"), F.sum("size_logical").alias("bytes"))


def age_distribution(files: DataFrame, as_of: Column, months: int = 12) -> DataFrame:
    """(slot, bytes) of ``months`` slots, 0 the oldest, none left out; older files
    count in the oldest, later ones in the newest."""
    ago = F.greatest(F.least(age_months(F.col("modified"), as_of), F.lit(months - 1)), F.lit(0))
    sums = files.where("modified is not null").groupBy((F.lit(months - 1) - ago).cast("int").alias("slot")).agg(F.sum("size_logical").alias("bytes"))
    slots = files.sparkSession.range(months).select(F.col("id").cast("int").alias("slot"))
    return slots.join(sums, "slot", "left").select("slot", F.coalesce("bytes", F.lit(0)).alias("bytes"))


def age_statistics(files: DataFrame, as_of: Column) -> DataFrame:
    """One row: files, bytes, oldest, newest, and average, median, 95th and 99th
    percentile of whole-hour ages since creation, by index of the sorted ages.

    One pass counts files by age; all else, the ranking window too, runs over
    the different ages and not over files.
    """
    per = files.groupBy(age_hours(F.col("created"), as_of).alias("age")).agg(F.count(F.lit(1)).alias("n"), F.sum("size_logical").alias("bytes"), F.min("created").alias("first"), F.max("created").alias("last"))
    known = F.col("age").isNotNull()
    n = F.when(known, F.col("n"))
    whole = Window.partitionBy(known)
    ranked = per.select("*", F.sum(n).over(whole.orderBy("age")).alias("upto"), F.sum(n).over(whole).alias("all_n"))

    def at(p: float) -> Column:
        return F.min(F.when(known & (F.col("upto") > F.least(F.floor(F.col("all_n") * p), F.col("all_n") - 1)), F.col("age")))

    return ranked.agg(
        F.sum("n").alias("total_files"), F.sum("bytes").alias("total_size"), F.min("first").alias("oldest"), F.max("last").alias("newest"),
        F.call_function("div", F.sum(F.col("age") * n), F.sum(n)).alias("average_hours"), at(0.5).alias("median_hours"), at(0.95).alias("p95_hours"), at(0.99).alias("p99_hours"),
    )


def largest(files: DataFrame, n: int = 1000) -> DataFrame:
    """The n largest files overall, equal sizes by file_id."""
    return files.orderBy(F.col("size_logical").desc_nulls_last(), "file_id").limit(n)


def directory_rollup(files: DataFrame, depth: int) -> DataFrame:
    """(depth, directory, files, bytes) of every directory down to ``depth``."""
    parts = F.split(F.regexp_replace(paths.platform_path(paths.parent(F.col("full_path"))), "^/", ""), "/")
    levels = F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth)))
    each = files.where("full_path is not null").select("size_logical", parts.alias("parts"), F.explode(levels).alias("depth"))
    return each.groupBy("depth", F.concat_ws("/", F.slice("parts", 1, F.col("depth"))).alias("directory")).agg(F.count(F.lit(1)).alias("files"), F.sum("size_logical").alias("bytes"))


#: Substrings that class a path, in order of precedence.
RESIDUE = (("temp", (".tmp", ".temp")), ("log", (".log",)), ("cache", (".cache",)), ("cache", ("\\temp\\", "/tmp/", "\\cache\\", "/cache/")))


def residue_type(path: Column) -> Column:
    low, out = F.lower(path), None
    for name, parts in RESIDUE:
        test = paths.contains_any(low, parts)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("unknown")


def residue_plan(files: DataFrame, as_of: Column, min_days: int = 0, exclude=(), keep_duplicates: bool = False) -> DataFrame:
    """Removal plan (full_path, file_type, bytes, action) of temporary files whose
    last access is at least ``min_days`` ago.  Nothing is removed here."""
    kind = residue_type(F.col("full_path"))
    old = files.where((age_days(F.col("accessed"), as_of) >= min_days) & ~paths.contains_any(F.col("full_path"), exclude))
    plan = old.select("full_path", kind.alias("file_type"), F.col("size_logical").alias("bytes"), F.lit("simulate").alias("action")).where("file_type <> 'unknown'")
    return plan if keep_duplicates else plan.groupBy("full_path").agg(F.max("file_type").alias("file_type"), F.max("bytes").alias("bytes"), F.max("action").alias("action"))


def empty_directories(nodes: DataFrame) -> DataFrame:
    """Directories that no node names as its parent."""
    parents = nodes.where("path_id is not null").select(F.col("path_id").alias("file_id")).distinct()
    return nodes.where("is_directory").join(parents, "file_id", "left_anti").select("file_id", "volume_id", "name")
