"""Files, logs, packets, trash and snapshots as DataFrames."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import paths
from siltstone.operators.catalog import scan_filter
from siltstone.operators.logs import PARSERS
from siltstone.operators.network import decode_ethernet


_ATTRIBUTES = "mode int, owner_id long, group_id long, owner_name string, group_name string, created timestamp, accessed timestamp, changed timestamp, links long, inode long, size_on_disk long"


def _attributes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the file system of the machine says about each path; nulls where it says
    nothing, as for files that are gone or lie elsewhere."""
    import grp
    import pwd

    def name(find, number: int) -> str | None:
        try:
            return find(number)[0]
        except (KeyError, OverflowError):
            return None

    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "timestamp": pa.timestamp("us", "UTC")}
    fields = [(f.split()[0], kinds[f.split()[1]]) for f in _ATTRIBUTES.split(", ")]
    for batch in batches:
        rows = []
        for path in batch.column("full_path").to_pylist():
            try:
                s = os.lstat(path)
            except (OSError, ValueError):
                rows.append((None,) * len(fields))
                continue
            made = getattr(s, "st_birthtime_ns", None)
            times = [None if t is None else t // 1000 for t in (made, s.st_atime_ns, s.st_ctime_ns)]
            rows.append((s.st_mode, s.st_uid, s.st_gid, name(pwd.getpwuid, s.st_uid), name(grp.getgrgid, s.st_gid), *times, s.st_nlink, s.st_ino, s.st_blocks * 512))
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
        found = [pa.array(c, pa.int64()).cast(kind) if pa.types.is_timestamp(kind) else pa.array(c, kind) for c, (_, kind) in zip(columns, fields, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*batch.schema.names, *(f for f, _ in fields)])


def scan(spark: SparkSession, root: str, *, recursive: bool = True, content: bool = False, attributes: bool = False, **filters) -> DataFrame:
    """Catalog rows of the files below ``root``; content is read only if asked for.

    file_id is a hash of the path.  With ``attributes`` each executor asks the
    file system, which all must share at the same place, for mode, owner, group,
    times, links, inode and bytes on disk; a birth time that the system does not
    tell is null.  Filters are those of ``scan_filter``.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("ignoreMissingFiles", True).load(root)
    path = F.regexp_replace("path", "^file:/*", "/")
    rows = raw.select(
        F.lit(0).cast("bigint").alias("volume_id"), F.xxhash64(path).alias("file_id"), path.alias("full_path"), F.col("length").alias("size_logical"),
        (F.ceil(F.col("length") / 4096) * 4096).cast("bigint").alias("size_on_disk"), F.col("modificationTime").alias("modified"), *(["content"] if content else []),
    )
    kept = scan_filter(rows, **filters)
    if not attributes:
        return kept
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.drop("size_on_disk").schema)
    return kept.drop("size_on_disk").mapInArrow(_attributes, f"{schema}, {_ATTRIBUTES}").withColumn("is_hidden", paths.base_name(F.col("full_path")).startswith("."))


def directories_first(rows: DataFrame) -> DataFrame:
    """Listing order: directories, then files, by path."""
    return rows.orderBy(F.col("is_directory").desc(), "full_path")


def read_logs(spark: SparkSession, path: str, style: str) -> DataFrame:
    return PARSERS[style](spark.read.text(path))


def _split_capture(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frames of capture files of either byte order, in micro- or nanoseconds."""
    for batch in batches:
        where, ts, size, frames = [], [], [], []
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            order = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}.get(data[:4])
            at = 24
            while order and at + 16 <= len(data):
                seconds, part, kept, whole = struct.unpack_from(order[0] + "IIII", data, at)
                if at + 16 + kept > len(data):
                    break
                where.append(path)
                ts.append(seconds * 1_000_000 + part // order[1])
                size.append(whole)
                frames.append(data[at + 16 : at + 16 + kept])
                at += 16 + kept
        yield pa.RecordBatch.from_arrays([pa.array(where, pa.string()), pa.array(ts, pa.int64()), pa.array(size, pa.int64()), pa.array(frames, pa.binary())], names=["path", "ts_us", "packet_size", "frame"])


def read_pcap(spark: SparkSession, path: str) -> DataFrame:
    """Decoded packets of capture files; a frame that is cut off ends its file."""
    return decode_captures(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))


def decode_captures(files: DataFrame) -> DataFrame:
    """Decoded packets of capture files (path, content)."""
    frames = files.select("path", "content").mapInArrow(_split_capture, "path string, ts_us long, packet_size long, frame binary")
    return decode_ethernet(frames.withColumn("ts", F.timestamp_micros("ts_us")).drop("ts_us"))


def read_trash(spark: SparkSession, path: str) -> DataFrame:
    """(trashed_name, original_path, deletion_date) of ``.trashinfo`` files."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    field = lambda name: F.nullif(F.regexp_extract("value", rf"(?m)^{name}=(.*)$", 1), F.lit(""))
    return text.select(F.regexp_replace(paths.base_name(F.col("file")), r"\.trashinfo$", "").alias("trashed_name"), F.url_decode(field("Path")).alias("original_path"), field("DeletionDate").alias("deletion_date"))


SNAPSHOT = "ts timestamp, path string, total_files long, total_size long, duplicate_files long, duplicate_size long, similar_files long, residue_files long"


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SNAPSHOT).option("multiLine", True).json(path)
