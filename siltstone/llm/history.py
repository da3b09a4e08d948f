"""New batches against all history: immutable segments of sorted suffixes.

A record's text is its digests, each followed by the size: sha256 + size, and
head_tail + size + whether it has a sha256.  Digests match only as a whole, so
the suffix array of the concatenated texts is kept at the field starts alone.
Every batch becomes one segment: per hash bucket the sorted, distinct suffixes
in one packed block with the first position at which each was delivered.
A new batch binary-searches its own fields in the blocks of all segments, and
the bytes found, the best match of each field, are summed up as coverage of
each record.  Segments of like size merge, so that there are few of them and
the history is never read again.  A history that is given a folder stays there:
a later run opens it and reads segments, not records.

A head_tail bucket holds one band of sizes, 1.1 % wide: equal digests of very
many different files spread over the buckets, and a search for sizes within
1 % asks two or three bands.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.content import digest
from siltstone.runtime import Scratch, read_text, write_text

#: Smallest file that takes part.
LEAST_SIZE = 1024
#: Suffixes of a bucket; a segment has as many buckets, a power of two, as that takes.
BUCKET_ROWS = 4096
LEAST_BITS = 5
#: Bytes of the fields: sha256 + size, head_tail + size + flag.
WIDTHS = {"s": 40, "h": 25}
#: Coverage, in bytes, from which a record counts as an exact copy.
EXACT_BYTES = 24
NEAR_BYTES = 16
#: Searches of a batch, of under 100 bytes each, that may be broadcast to the segments.
BROADCAST_SEARCHES = 600_000
_BEFORE_ALL = -(2**63)
_SEGMENT = "kind string, bucket int, suffixes binary, positions binary"
_ASKED = "kind string, bucket int, entries binary, low binary, high binary, cover binary"
_COVERED = "entry_id bigint, kind string, cover int"


def _bytes8(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n), 16, "0"))


def _band(size: Column) -> Column:
    return F.floor(F.log2(size.cast("double")) * 64).cast("int")


def _bits(suffixes: int) -> int:
    """Bits of a bucket number for so many suffixes: no cap, blocks stay small."""
    return max(LEAST_BITS, (max(1, suffixes) // BUCKET_ROWS).bit_length())


def _s_bucket(sha256: Column, bits: int) -> Column:
    return F.xxhash64(sha256).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def _h_bucket(head_tail: Column, band: Column, bits: int) -> Column:
    return F.xxhash64(head_tail, band).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def _flag(on: Column) -> Column:
    return F.unhex(F.when(on, "01").otherwise("00"))


def suffixes(records: DataFrame, bits: int) -> DataFrame:
    """(kind, bucket, suffix, position) of the fields of ``records``: position,
    size, sha256 and head_tail, of which any may be null."""
    size8 = _bytes8(F.col("size"))
    s = F.when(F.col("sha256").isNotNull(), F.struct(F.lit("s").alias("kind"), _s_bucket(F.col("sha256"), bits).alias("bucket"), F.concat("sha256", size8).alias("suffix")))
    flagged = F.concat("head_tail", size8, _flag(F.col("sha256").isNotNull()))
    h = F.when(F.col("head_tail").isNotNull(), F.struct(F.lit("h").alias("kind"), _h_bucket(F.col("head_tail"), _band(F.col("size")), bits).alias("bucket"), flagged.alias("suffix")))
    own = records.where(F.col("size") >= LEAST_SIZE).select("position", F.explode(F.filter(F.array(s, h), lambda x: x.isNotNull())).alias("f"))
    return own.select("f.kind", "f.bucket", "f.suffix", "position")


def searches(records: DataFrame, bits: int) -> DataFrame:
    """(kind, bucket, entry_id, low, high, cover): ranges of suffixes to find."""
    size = F.col("size")
    has = F.col("sha256").isNotNull()
    size8 = _bytes8(size)
    whole = F.concat("sha256", size8)
    s = F.when(has, F.array(F.struct(F.lit("s").alias("kind"), _s_bucket(F.col("sha256"), bits).alias("bucket"), whole.alias("low"), whole.alias("high"), F.lit(WIDTHS["s"]).alias("cover"))))
    # With equal head_tail and size one side must lack the sha256.
    same = F.struct(
        F.lit("h").alias("kind"), _h_bucket(F.col("head_tail"), _band(size), bits).alias("bucket"), F.concat("head_tail", size8, _flag(F.lit(False))).alias("low"),
        F.concat("head_tail", size8, _flag(~has)).alias("high"), F.lit(EXACT_BYTES).alias("cover"),
    )
    low, high = F.call_function("div", size * 99 + 99, F.lit(100)), F.call_function("div", size * 100, F.lit(99))
    near = F.transform(
        F.sequence(_band(low), _band(high)),
        lambda band: F.struct(
            F.lit("h").alias("kind"), _h_bucket(F.col("head_tail"), band, bits).alias("bucket"), F.concat("head_tail", _bytes8(low), _flag(F.lit(False))).alias("low"),
            F.concat("head_tail", _bytes8(high), _flag(F.lit(True))).alias("high"), F.lit(NEAR_BYTES).alias("cover"),
        ),
    )
    h = F.when(F.col("head_tail").isNotNull(), F.concat(F.array(same), near))
    empty = F.array().cast("array<struct<kind:string,bucket:int,low:binary,high:binary,cover:int>>")
    asked = F.concat(F.coalesce(s, empty), F.coalesce(h, empty))
    return records.where(size >= LEAST_SIZE).select(F.col("position").alias("entry_id"), F.inline(asked))


def _fixed(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A column of equally long binaries as a fixed-width array."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=f"S{width}")


def _packed(kind: str, bucket: int, keys: np.ndarray, positions: np.ndarray) -> pa.Table:
    order = np.lexsort((positions, keys))
    keys, positions = keys[order], positions[order]
    first = np.ones(len(keys), dtype=bool)
    first[1:] = keys[1:] != keys[:-1]
    return pa.table({"kind": [kind], "bucket": pa.array([bucket], pa.int32()), "suffixes": pa.array([keys[first].tobytes()], pa.binary()), "positions": pa.array([positions[first].astype("<i8").tobytes()], pa.binary())})


def _build(key: tuple, table: pa.Table) -> pa.Table:
    kind, bucket = key[0].as_py(), key[1].as_py()
    return _packed(kind, bucket, _fixed(table["suffix"], WIDTHS[kind]), table["position"].to_numpy())


def _merge(key: tuple, table: pa.Table) -> pa.Table:
    kind, bucket = key[0].as_py(), key[1].as_py()
    keys = np.frombuffer(b"".join(table["suffixes"].to_pylist()), dtype=f"S{WIDTHS[kind]}")
    return _packed(kind, bucket, keys, np.frombuffer(b"".join(table["positions"].to_pylist()), dtype="<i8"))


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks back to rows (kind, suffix, position)."""
    for batch in batches:
        for r in batch.to_pylist():
            keys = np.frombuffer(r["suffixes"], dtype=np.uint8)
            n = len(keys) // WIDTHS[r["kind"]]
            rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(WIDTHS[r["kind"]]), n, [None, pa.py_buffer(r["suffixes"])]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r["kind"]] * n, pa.string()), rows, pa.array(np.frombuffer(r["positions"], dtype="<i8"))], names=["kind", "suffix", "position"])


def _rebucketed(segments: DataFrame, bits: int) -> DataFrame:
    """Blocks of ``segments`` laid out anew in more buckets."""
    rows = segments.mapInArrow(_unpack, "kind string, suffix binary, position bigint")
    part = lambda at, n: F.substring("suffix", at, n)
    size = F.conv(F.hex(part(17, 8)), 16, 10).cast("bigint")
    bucket = F.when(F.col("kind") == "s", _s_bucket(part(1, 32), bits)).otherwise(_h_bucket(part(1, 16), _band(size), bits))
    return rows.select("kind", bucket.alias("bucket"), "suffix", "position").groupBy("kind", "bucket").applyInArrow(_build, _SEGMENT)


def _pack_searches(key: tuple, table: pa.Table) -> pa.Table:
    blob = lambda b: pa.array([b], pa.binary())
    return pa.table({
        "kind": [key[0].as_py()], "bucket": pa.array([key[1].as_py()], pa.int32()), "entries": blob(table["entry_id"].to_numpy().astype("<i8").tobytes()),
        "low": blob(b"".join(table["low"].to_pylist())), "high": blob(b"".join(table["high"].to_pylist())), "cover": blob(table["cover"].to_numpy().astype("<i4").tobytes()),
    })


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("entry_id", pa.int64()), ("kind", pa.string()), ("cover", pa.int32())])
    for batch in batches:
        for r in batch.to_pylist():
            width = f"S{WIDTHS[r['kind']]}"
            keys = np.frombuffer(r["suffixes"], dtype=width)
            positions = np.append(np.frombuffer(r["positions"], dtype="<i8"), np.int64(2**63 - 1))
            entries, cover = np.frombuffer(r["entries"], dtype="<i8"), np.frombuffer(r["cover"], dtype="<i4")
            left = np.searchsorted(keys, np.frombuffer(r["low"], dtype=width), "left")
            right = np.searchsorted(keys, np.frombuffer(r["high"], dtype=width), "right")
            hit = np.flatnonzero(right > left)
            if len(hit):
                spans = np.stack([left[hit], right[hit]], axis=1).ravel()
                first = np.minimum.reduceat(positions, spans)[::2]
                hit = hit[first < entries[hit]]
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(entries[hit]), pa.array([r["kind"]] * len(hit), pa.string()), pa.array(cover[hit])], schema=schema)


class Level(NamedTuple):
    suffixes: int
    bits: int
    name: str


class History:
    """The segments of everything accepted so far.

    ``add`` and ``check`` take records (position, size, sha256, head_tail):
    position BIGINT is the order of delivery.  Segments are written tables; a
    segment is never changed, only merged with another of its level into a new
    one.  With ``path``, a folder that all executors share, they stay there
    with a list of them: ``History(spark, path)`` goes on where the last run
    ended, and a run that died between two writes leaves the list before it
    valid.  Without, they lie in the shared folder until ``close``.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.scratch = Scratch(spark, "history")
        self.spark, self.path = spark, path and path.rstrip("/")
        self.store = Scratch(spark, "history", self.path) if self.path else self.scratch
        self.levels: list[Level] = []
        self.made = 0
        self.asked: list[str] = []
        listed = read_text(spark, f"{self.path}/segments.json") if self.path else None
        if listed:
            self.levels = [Level(*one) for one in json.loads(listed)]

    @property
    def is_new(self) -> bool:
        return not self.levels

    def _segment(self, level: Level) -> DataFrame:
        return self.spark.read.schema(_SEGMENT).parquet(f"{self.store.root}/{level.name}")

    def add(self, records: DataFrame, rows: int) -> None:
        """Write the segment of a batch of about ``rows`` records, then merge while two are of like size."""
        bits = _bits(2 * rows)
        distinct = suffixes(records, bits).groupBy("kind", "bucket", "suffix").agg(F.min("position").alias("position"))
        self._keep(distinct.groupBy("kind", "bucket").applyInArrow(_build, _SEGMENT), bits)
        gone = []
        while len(self.levels) > 1 and self.levels[-2].suffixes < 2 * self.levels[-1].suffixes:
            one, other = self.levels.pop(), self.levels.pop()
            bits = _bits(one.suffixes + other.suffixes)
            both = self._segment(one).unionByName(self._segment(other))
            same = one.bits == other.bits == bits
            self._keep(both.groupBy("kind", "bucket").applyInArrow(_merge, _SEGMENT) if same else _rebucketed(both, bits), bits)
            gone += [one.name, other.name]
        if self.path:
            write_text(self.spark, f"{self.path}/segments.json", json.dumps(self.levels))
        self.store.drop(*gone)

    def _keep(self, segment: DataFrame, bits: int) -> None:
        name = f"segment-{uuid.uuid4().hex}"
        self.store.write(segment, name, suffixes=F.sum(F.octet_length("positions") / 8))
        self.levels.append(Level(int(self.store.rows[f"{name}.suffixes"] or 0), bits, name))

    def check(self, records: DataFrame) -> DataFrame:
        """(entry_id, kind, coverage) of the records of a batch, already added, that
        match an earlier position: ``exact`` or ``near``, and the bytes of the
        record that were found.  Write it before ``forget``."""
        most = max(level.bits for level in self.levels)
        asked = searches(records, most)
        # Lists of searches are cut by entry, so that a hot digest fills none.
        packed = asked.groupBy("kind", "bucket", F.shiftright("entry_id", 13)).applyInArrow(_pack_searches, _ASKED)
        self.made += 1
        self.asked.append(f"asked{self.made}")
        packed = self.scratch.write(packed, self.asked[-1], n=F.sum(F.octet_length("cover") / 4))
        small = (self.scratch.rows[f"{self.asked[-1]}.n"] or 0) <= BROADCAST_SEARCHES
        found = None
        for level in self.levels:
            # A bucket of fewer bits holds those of more bits that end in it.
            ours = packed.withColumn("bucket", F.col("bucket").bitwiseAND((1 << level.bits) - 1)) if level.bits < most else packed
            one = self._segment(level).join(F.broadcast(ours) if small else ours, ["kind", "bucket"]).mapInArrow(_look_up, _COVERED)
            found = one if found is None else found.unionByName(one)
        best = lambda field: F.coalesce(F.max(F.when(F.col("kind") == field, F.col("cover"))), F.lit(0))
        covered = found.groupBy("entry_id").agg((best("s") + best("h")).alias("coverage"))
        return covered.select("entry_id", F.when(F.col("coverage") >= EXACT_BYTES, "exact").otherwise("near").alias("kind"), "coverage")

    def forget(self) -> None:
        """Remove the searches that were answered."""
        self.scratch.drop(*self.asked)
        self.asked.clear()

    def close(self) -> None:
        """Remove what the history doesn't keep: all of it, without ``path``."""
        self.forget()
        if not self.path:
            self.scratch.drop(*(level.name for level in self.levels))


def _delivered(incoming: DataFrame) -> list[list[int]]:
    """Batches in the order of delivery; those whose entries overlap go together."""
    spans = incoming.groupBy("batch_id").agg(F.min("position").alias("a"), F.max("position").alias("b")).collect()  # a row per batch
    groups: list[list[int]] = []
    until = None
    for r in sorted(spans, key=lambda r: r["a"]):
        if until is not None and r["a"] <= until:
            groups[-1].append(r["batch_id"])
        else:
            groups.append([r["batch_id"]])
        until = r["b"] if until is None else max(until, r["b"])
    return groups


def accept_batches(history: History, incoming: DataFrame) -> DataFrame:
    """Rows (entry_id, kind) of the incoming rows that match something earlier;
    every batch is added to ``history``.  Columns and cases as below."""
    spark = incoming.sparkSession
    scratch = Scratch(spark, "incoming")
    new = incoming.select(
        F.col("entry_id").cast("bigint").alias("position"), F.coalesce("batch_id", F.lit(-1)).alias("batch_id"), F.col("size_logical").alias("size"),
        digest(F.col("sha256"), 32).alias("sha256"), digest(F.col("head_tail"), 16).alias("head_tail"),
    )
    # A folder for each batch, so that none is read for another.
    new = scratch.write(new.where(F.col("position").isNotNull() & (F.col("size") >= LEAST_SIZE)), "rows", by="batch_id")
    out = None
    for k, ids in enumerate(_delivered(new)):
        batch = new.where(F.col("batch_id").isin(ids))
        history.add(batch, scratch.rows["rows"] if len(ids) > 1 else batch.count())
        found = scratch.write(history.check(batch).select("entry_id", "kind"), f"found{k}")
        history.forget()
        out = found if out is None else out.unionByName(found)
    scratch.drop("rows")
    return out if out is not None else spark.createDataFrame([], "entry_id bigint, kind string")


def accept_catalog(history: History, catalog: DataFrame) -> None:
    """Add catalog rows (size_logical, sha256, head_tail), earlier than any batch."""
    old = catalog.select(F.lit(_BEFORE_ALL).alias("position"), F.col("size_logical").alias("size"), "sha256", "head_tail")
    history.add(old.where(F.col("size") >= LEAST_SIZE), catalog.count())


def duplicates_of_history(catalog: DataFrame, incoming: DataFrame, path: str | None = None) -> DataFrame:
    """Rows (entry_id, kind) of the incoming rows that match something earlier.

    ``catalog``: size_logical, sha256, head_tail (BINARY), all of it earlier
    than any batch; ``incoming``: entry_id, batch_id, size_logical and the
    digests as text.  With ``path`` the history is kept there, and a history
    that lies there already is gone on with: its catalog is not read again.
    Null digests match nothing; rows with a null size, under 1024 bytes or
    without entry_id take no part; a digest that can't be read counts as
    missing; repeated rows count once; empty tables give no rows.
    """
    history = History(catalog.sparkSession, path)
    if history.is_new:
        accept_catalog(history, catalog)
    out = accept_batches(history, incoming)
    history.close()
    return out
