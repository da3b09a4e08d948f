"""Changes between consecutive full snapshots.

Each key gets a lasting ordinal from a dictionary that only ever grows; a
``SnapshotStore`` keeps dictionary and snapshots in a folder, so that a new
snapshot is compared with the last one without encoding any other again.  A
snapshot is kept as one block per 32768 ordinals: a compressed bitmap of the
ordinals present and, aligned with its set bits, the compressed vectors of the
compared columns.  AND-NOT of two bitmaps gives additions and removals, and
the vectors at common bits give the changes.
"""

from __future__ import annotations

import json
import uuid
import zlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.runtime import Scratch, read_text, table, write_text

#: Ordinals of one block.
BLOCK = 32_768
_KEY = ["volume_id", "full_path"]
_ORDINALS = "volume_id bigint, full_path string, ordinal bigint"
_BLOCKS = "snap_no int, block bigint, n int, bitmap binary, vectors binary"
_CHANGES = "snap_no int, ordinal bigint, change string"


def assign_ordinals(keys: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """Dictionary (volume_id, full_path, ordinal) of the distinct ``keys``.

    Keys in ``dictionary`` keep their ordinals; new ones follow its highest.
    New keys are numbered within hash shards of bounded size and the shards'
    counts summed, so that no task numbers all of them.
    """
    if dictionary is None:
        return new_ordinals(keys)
    return dictionary.select(*_KEY, "ordinal").unionByName(new_ordinals(keys, dictionary))


def new_ordinals(keys: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """The part of ``assign_ordinals`` that ``dictionary`` lacks."""
    spark, key = keys.sparkSession, _KEY
    fresh, start = keys.select(*key).where("volume_id is not null and full_path is not null").distinct(), 0
    if dictionary is not None:
        highest = dictionary.agg(F.max("ordinal")).first()[0]
        start = 0 if highest is None else highest + 1
        fresh = fresh.join(dictionary, key, "left_anti")
    scratch = Scratch(spark, "ordinals")
    fresh = scratch.write(fresh, "fresh")
    shards = max(1, -(-scratch.rows["fresh"] // 20_000))
    sharded = fresh.withColumn("shard", F.pmod(F.xxhash64(*key), F.lit(shards)))
    # The counts are one row per 20,000 keys; their running sum is taken in two levels.
    counts = sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.shiftright("shard", 12))
    parts = counts.groupBy("part").agg(F.sum("n").alias("part_n"))
    below = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    part_start = parts.select("part", F.coalesce(F.sum("part_n").over(below(Window.orderBy("part"))), F.lit(0)).alias("part_start"))
    starts = counts.withColumn("in_part", F.coalesce(F.sum("n").over(below(Window.partitionBy("part").orderBy("shard"))), F.lit(0))).join(part_start, "part")
    starts = starts.select("shard", (F.col("part_start") + F.col("in_part") + start).alias("start"))
    place = F.row_number().over(Window.partitionBy("shard").orderBy(*key)) - 1
    return sharded.withColumn("place", place).join(starts, "shard").select(*key, (F.col("start") + F.col("place")).alias("ordinal"))


def _pack(bits: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def _encode(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("place", kind="stable")
    bits = np.zeros(BLOCK, dtype=bool)
    bits[pdf["place"].to_numpy()] = True
    # A null is its own value: a flag vector beside each value vector.
    columns = [c for c in pdf.columns if c.startswith("v_")]
    stack = [pdf[c].isna().to_numpy().astype("<i8") for c in columns] + [pdf[c].fillna(0).to_numpy().astype("<i8") for c in columns]
    vectors = np.vstack(stack) if stack else np.zeros((0, len(pdf)), dtype="<i8")
    first = pdf.iloc[0]
    return pd.DataFrame({"snap_no": [int(first["snap_no"])], "block": [int(first["block"])], "n": [len(pdf)], "bitmap": [_pack(bits)], "vectors": [zlib.compress(vectors.tobytes(), 1)]})


def encode_snapshots(rows: DataFrame, dictionary: DataFrame, compared: dict[str, Column]) -> DataFrame:
    """Blocks (snap_no, block, n, bitmap, vectors) of ``rows``, which hold each
    key at most once per snapshot.  ``compared`` gives BIGINT expressions."""
    keyed = rows.join(dictionary, ["volume_id", "full_path"]).select(
        F.col("snap_no").cast("int").alias("snap_no"),
        F.floor(F.col("ordinal") / BLOCK).cast("bigint").alias("block"),
        (F.col("ordinal") % BLOCK).cast("int").alias("place"),
        *(c.cast("bigint").alias(f"v_{name}") for name, c in compared.items()),
    )
    return keyed.groupBy("snap_no", "block").applyInPandas(_encode, _BLOCKS)


def _unpack(n: int, bitmap: bytes | None, vectors: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    if bitmap is None:
        return np.zeros(BLOCK, dtype=bool), np.zeros((0, 0), dtype="<i8")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8)).astype(bool)
    return bits, np.frombuffer(zlib.decompress(vectors), dtype="<i8").reshape(-1, int(n))


def _compare(batches):
    for batch in batches:
        for r in batch.itertuples(index=False):
            old, old_v = _unpack(r.n_old, r.bitmap_old, r.vectors_old)
            new, new_v = _unpack(r.n_new, r.bitmap_new, r.vectors_new)
            out = [("added", np.flatnonzero(new & ~old)), ("removed", np.flatnonzero(old & ~new))]
            both = old & new
            if both.any():
                # The rank of a bit is its column in the vectors.
                here = np.flatnonzero(both)
                a = old_v[:, np.cumsum(old)[here] - 1]
                b = new_v[:, np.cumsum(new)[here] - 1]
                out.append(("changed", here[(a != b).any(axis=0)]))
            for change, places in out:
                if len(places):
                    yield pd.DataFrame({"snap_no": np.int32(r.snap_no), "ordinal": r.block * BLOCK + places.astype(np.int64), "change": change})


def diff_blocks(blocks: DataFrame, following: DataFrame) -> DataFrame:
    """(snap_no, ordinal, change) between each snapshot and the one before it.

    ``following``: prev_no, snap_no, the pairs of consecutive snapshots.  A
    block that one side lacks is an empty bitmap.
    """
    old = blocks.select(F.col("snap_no").alias("prev_no"), "block", F.col("n").alias("n_old"), F.col("bitmap").alias("bitmap_old"), F.col("vectors").alias("vectors_old")).join(F.broadcast(following), "prev_no").drop("prev_no")
    new = blocks.join(F.broadcast(following.select("snap_no")), "snap_no", "left_semi").select("snap_no", "block", F.col("n").alias("n_new"), F.col("bitmap").alias("bitmap_new"), F.col("vectors").alias("vectors_new"))
    both = old.join(new, ["snap_no", "block"], "full").withColumns({"n_old": F.coalesce("n_old", F.lit(0)), "n_new": F.coalesce("n_new", F.lit(0))})
    return both.mapInPandas(_compare, _CHANGES)


def snapshot_changes(snapshots: DataFrame, compared: dict[str, Column], dictionary: DataFrame | None = None) -> DataFrame:
    """Rows (snap_no, volume_id, full_path, change) between consecutive snapshots.

    ``snapshots``: snap_no, volume_id, full_path, seq and the columns that
    ``compared`` reads.  Within a snapshot the highest seq of a key holds; equal
    seqs are told apart by the compared values.  A null differs from any value
    but not from a null.  Rows with a null snap_no or key part are no readings;
    repeats count once; the first snapshot has no changes; further columns are
    ignored; an empty table gives an empty result.
    """
    spark = snapshots.sparkSession
    scratch = Scratch(spark, "snapshots")
    names = list(compared)
    latest = scratch.write(_latest(snapshots, compared), "latest")
    ordinals = scratch.write(assign_ordinals(latest, dictionary), "ordinals")
    blocks = scratch.write(encode_snapshots(latest, ordinals, {c: F.col(c) for c in names}), "blocks")
    numbers = blocks.select("snap_no").distinct()  # one row per snapshot
    following = numbers.select(F.lag("snap_no").over(Window.orderBy("snap_no")).alias("prev_no"), "snap_no").where("prev_no is not null")
    return diff_blocks(blocks, following).join(ordinals, "ordinal").select("snap_no", "volume_id", "full_path", "change")


def _latest(snapshots: DataFrame, compared: dict[str, Column]) -> DataFrame:
    """The reading of each key that holds within its snapshot."""
    best = F.max(F.struct(F.col("seq"), *(c.cast("bigint").alias(name) for name, c in compared.items()))).alias("_best")
    read = snapshots.where("snap_no is not null and volume_id is not null and full_path is not null").groupBy("snap_no", *_KEY).agg(best)
    return read.select(F.col("snap_no").cast("int").alias("snap_no"), F.col("volume_id").cast("bigint").alias("volume_id"), "full_path", *(F.col(f"_best.{c}").alias(c) for c in compared))


class SnapshotStore:
    """Dictionary and encoded snapshots of one table, kept in the folder ``path``.

    ``add`` takes in later snapshots, in the columns of ``snapshot_changes``,
    and gives what changed in them.  It reads the dictionary and the blocks of
    the last snapshot, but no earlier row.  A snapshot that is not later than
    the last one is refused, as its successors were compared already.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.tables = Scratch(spark, "snapshots", self.path)
        listed = read_text(spark, f"{self.path}/snapshots.json")
        self.list = json.loads(listed) if listed else {"last": None, "dictionary": [], "blocks": []}

    def dictionary(self) -> DataFrame | None:
        parts = [f"{self.path}/{name}" for name in self.list["dictionary"]]
        return self.spark.read.schema(_ORDINALS).parquet(*parts) if parts else None

    def add(self, snapshots: DataFrame, compared: dict[str, Column]) -> DataFrame:
        """Rows (snap_no, volume_id, full_path, change) of the new snapshots."""
        scratch = Scratch(self.spark, "snapshots")
        latest = scratch.write(_latest(snapshots, compared), "latest", first=F.min("snap_no"))
        if not scratch.rows["latest"]:
            return self.spark.createDataFrame([], "snap_no int, volume_id bigint, full_path string, change string")
        last = self.list["last"]
        if last is not None and scratch.rows["latest.first"] <= last:
            raise ValueError(f"snapshot {scratch.rows['latest.first']} is not later than {last}")
        keys, encoded = f"keys-{uuid.uuid4().hex}", f"blocks-{uuid.uuid4().hex}"
        self.tables.write(new_ordinals(latest, self.dictionary()), keys)
        self.list["dictionary"].append(keys)
        ordinals = self.dictionary()
        blocks = self.tables.write(encode_snapshots(latest, ordinals, {c: F.col(c) for c in compared}), encoded)
        numbers = sorted(r["snap_no"] for r in blocks.select("snap_no").distinct().collect())  # one row per snapshot
        before = [self.spark.read.schema(_BLOCKS).parquet(f"{self.path}/{self.list['blocks'][-1]}").where(F.col("snap_no") == last)] if last is not None else []
        every = reduce(DataFrame.unionByName, before, blocks)
        pairs = list(zip(([last] if last is not None else []) + numbers, numbers if last is not None else numbers[1:], strict=False))
        self.list["blocks"].append(encoded)
        self.list["last"] = numbers[-1]
        write_text(self.spark, f"{self.path}/snapshots.json", json.dumps(self.list))
        following = self.spark.createDataFrame(pairs, "prev_no int, snap_no int")
        return diff_blocks(every, following).join(ordinals, "ordinal").select("snap_no", "volume_id", "full_path", "change")


def compared_fields() -> dict[str, Column]:
    """What makes a file of ``file_snapshot`` count as changed."""
    return {"size_logical": F.col("size_logical"), "last_write_us": F.unix_micros("last_write_time")}


def snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "file_snapshot").select("snap_no", "volume_id", "full_path", "seq", "size_logical", "last_write_time")


def file_snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added, removed and changed files of ``file_snapshot``."""
    return snapshot_changes(snapshot_rows(spark, sf_dir), compared_fields())
