"""A catalog kept in a folder: a base sorted by key, and the deltas since.

A batch of changes is written as a delta, so that its cost is that of the batch
and not of the catalog.  Once the deltas hold a share of the base's rows they
are folded into a new base.  Every table is laid out in ranges of the key and
sorted in them, so that the Parquet footers' least and greatest keys keep
look-ups from reading the rest.  A list of the tables is replaced in one step:
a run that dies in between leaves the catalog as it was before.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.catalog import KEY, current, latest
from siltstone.runtime import Scratch, read_text, write_text

#: Deltas are folded in once they hold this share of the base's rows, or are so many.
FOLD_SHARE = 0.25
FOLD_DELTAS = 50
#: Rows of a file of a table.
FILE_ROWS = 1_000_000


class CatalogStore:
    """The catalog in ``path``: rows volume_id, file_id, seq, deleted and ``columns``.

    A change whose key is null is left out; of a key the row with the highest
    seq holds, wherever it lies; repeated rows count once.
    """

    def __init__(self, spark: SparkSession, path: str, columns: list[str] | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.tables = Scratch(spark, "catalog", self.path)
        listed = read_text(spark, f"{self.path}/tables.json")
        self.list = json.loads(listed) if listed else {"columns": columns or [], "schema": None, "base": None, "base_rows": 0, "deltas": [], "batches": []}
        self.columns: list[str] = self.list["columns"]

    def _save(self) -> None:
        write_text(self.spark, f"{self.path}/tables.json", json.dumps(self.list))

    def _write(self, rows: DataFrame, expected: int) -> tuple[str, int]:
        """A table of ``rows``, in key ranges, sorted; its name and its rows."""
        name = f"rows-{uuid.uuid4().hex}"
        files = max(1, -(-expected // FILE_ROWS))
        ranged = rows.repartitionByRange(files, *KEY) if files > 1 else rows.coalesce(1)
        self.tables.write(ranged.sortWithinPartitions(*KEY), name)
        return name, self.tables.rows[name]

    def add(self, changes: DataFrame, batch: int | None = None) -> None:
        """Take in change rows.  A ``batch`` number that was taken in is left out."""
        if batch is not None and batch in self.list["batches"]:
            return
        rows = changes.where(" and ".join(f"{k} is not null" for k in KEY)).select(*KEY, "seq", "deleted", *self.columns)
        with Scratch(self.spark, "changes") as scratch:
            newest = scratch.write(latest(rows, [*self.columns, "seq"]).select(*KEY, "seq", "deleted", *self.columns), "newest")
            self.list["schema"] = newest.schema.json()
            name, n = self._write(newest, scratch.rows["newest"])
        self.list["deltas"].append([name, n])
        if batch is not None:
            self.list["batches"] = [*self.list["batches"], batch][-1_000:]
        self._save()
        if len(self.list["deltas"]) > FOLD_DELTAS or sum(n for _, n in self.list["deltas"]) > self.list["base_rows"] * FOLD_SHARE:
            self.fold()

    def fold(self) -> None:
        """Fold the deltas into a new base; tombstones stay, as late rows may be older."""
        old = [name for name in (self.list["base"], *(d[0] for d in self.list["deltas"])) if name]
        expected = self.list["base_rows"] + sum(n for _, n in self.list["deltas"])
        rows = latest(self.versions(), [*self.columns, "seq"]).select(*KEY, "seq", "deleted", *self.columns)
        name, n = self._write(rows, expected)
        self.list |= {"base": name, "base_rows": n, "deltas": []}
        self._save()
        self.tables.drop(*old)

    def versions(self) -> DataFrame:
        """All rows that are kept, of which the highest seq of a key holds."""
        from pyspark.sql.types import StructType

        if self.list["schema"] is None:
            raise ValueError(f"{self.path} holds no rows yet")
        schema = StructType.fromJson(json.loads(self.list["schema"]))
        names = [name for name in (self.list["base"], *(d[0] for d in self.list["deltas"])) if name]
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{name}" for name in names))

    def rows(self) -> DataFrame:
        """Current rows of files that are not deleted."""
        return current(self.versions(), self.columns)

    def get(self, volume_id: int, file_id: int) -> DataFrame:
        """One file; its key reaches the scans, which skip what can't hold it."""
        return current(self.versions().where((F.col("volume_id") == volume_id) & (F.col("file_id") == file_id)), self.columns)
