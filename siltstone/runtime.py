"""What every operator needs from the session: a shared folder for written
intermediate tables, joins that survive hot keys, and checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import time
import uuid
import warnings

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table may be broadcast.  At the widths used here (under
#: 100 bytes a row) this is some 20 MB in every executor.
BROADCAST_ROWS = 200_000
#: A join key is hot when it has this many rows, or one in HOT_SHARE of all.
HOT_ROWS = 50_000
HOT_SHARE = 1_000


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, from ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it then gets a temporary
    folder that is removed at exit.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="siltstone-")
    atexit.register(shutil.rmtree, made, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


class Scratch:
    """Written intermediate tables of one run of an operator.

    Each table is Parquet below the shared folder, so that a lost executor
    costs a read and not a recomputation, and lineage ends there.  Tables that
    are no longer needed are dropped early; the rest goes when the interpreter
    exits or, used as a context manager, when the block ends.  What a driver
    that died left behind is removed by ``sweep``.
    """

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self._remove(self.root)

    def __init__(self, spark: SparkSession, label: str, kept: str | None = None):
        """``kept`` names a folder of the caller's whose tables stay."""
        self.spark = spark
        self.root = kept or f"{shared_dir(spark)}/siltstone/{label}-{uuid.uuid4().hex}"
        self.rows: dict[str, int] = {}
        if not kept:
            atexit.register(self._remove, self.root)

    def write(self, df: DataFrame, name: str, *, by: str | None = None, **more: Column) -> DataFrame:
        """Write ``df`` and read it back; ``rows[name]`` is then its row count
        and ``rows[name.key]`` the value of each further aggregate.  With ``by``
        there is one folder for each value of that column, which filters prune."""
        seen = Observation()
        path = f"{self.root}/{name}"
        writer = df.observe(seen, F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in more.items())).write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(path)
        got = seen.get
        self.rows[name] = got["n"]
        self.rows |= {f"{name}.{k}": got[k] for k in more}
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more."""
        for name in names:
            self._remove(f"{self.root}/{name}")

    def _remove(self, path: str) -> None:
        if self.spark.sparkContext._jsc is None:  # the session was stopped before: left to ``sweep``
            return
        try:
            files, p = _file_system(self.spark, path)
            files.delete(p, True)
        except Exception as e:  # at exit the gateway may be gone already
            if self.spark.sparkContext._jsc is not None and not sys.is_finalizing():
                warnings.warn(f"{path} is left behind: {type(e).__name__}", stacklevel=2)


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def sweep(spark: SparkSession, older_than_hours: float = 24.0) -> int:
    """Remove the intermediate tables of runs that ended without doing so: folders
    below the shared one that are older than this.  The number removed."""
    files, p = _file_system(spark, f"{shared_dir(spark)}/siltstone")
    if not files.exists(p):
        return 0
    limit = (time.time() - older_than_hours * 3600) * 1000
    old = [s.getPath() for s in files.listStatus(p) if s.getModificationTime() < limit]
    for path in old:
        files.delete(path, True)
    return len(old)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in one step: written beside its place, then put there."""
    files, p = _file_system(spark, path)
    _, beside = _file_system(spark, f"{path}.new")
    out = files.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    files.delete(p, False)
    if not files.rename(beside, p):
        raise OSError(path)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, or None if there is none."""
    files, p = _file_system(spark, path)
    if not files.exists(p):
        files, p = _file_system(spark, f"{path}.new")  # a writer died between its two steps
        if not files.exists(p):
            return None
    size = files.getFileStatus(p).getLen()
    jvm = spark.sparkContext._jvm
    opened = files.open(p)
    text = jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8") if size else ""
    opened.close()
    return text


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its counted rows are within ``limit``."""
    return F.broadcast(df) if rows <= limit else df


def hot_limit(rows: int) -> int:
    """Rows from which a key counts as hot; at most HOT_SHARE keys can be."""
    return max(HOT_ROWS, rows // HOT_SHARE)


def lookup_join(left: DataFrame, right: DataFrame, key: str, hot_keys: DataFrame | None, how: str = "left") -> DataFrame:
    """Join ``left`` with ``right``, which has one row per ``key``.

    ``hot_keys`` (column ``key``, at most HOT_SHARE rows, see ``hot_limit``)
    names the keys under which ``left`` holds very many rows.  Their few rows
    of ``right`` are broadcast, so that no task gathers a hot key; all others
    meet in a shuffled join.
    """
    if hot_keys is None:
        return left.join(right, key, how)
    marked = left.join(F.broadcast(hot_keys.select(key, F.lit(True).alias("_hot"))), key, "left")
    hot_right = right.join(F.broadcast(hot_keys.select(key)), key, "left_semi")
    cold = marked.where(F.col("_hot").isNull()).drop("_hot").join(right, key, how)
    hot = marked.where(F.col("_hot")).drop("_hot").join(F.broadcast(hot_right), key, how)
    return cold.unionByName(hot)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
