"""Change feeds: windows over events, rolling histograms, a catalog kept up to date."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltstone.operators.stats import bucket
from siltstone.operators.store import CatalogStore
from siltstone.runtime import Scratch


def read_changes(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Rows of Parquet files as they arrive below ``path``."""
    reader: DataStreamReader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def event_windows(events: DataFrame, time: str, late: str, size: str, slide: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(start_us, keys, n) of event-time windows; rows later than ``late`` are dropped
    once their window is final."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    counted = events.withWatermark(time, late).groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.unix_micros("w.start").alias("start_us"), *keys, "n")


def sessions(events: DataFrame, time: str, late: str, gap: str, key: str) -> DataFrame:
    """(key, start_us, end_us, n) of runs of events without a longer gap."""
    counted = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(key, F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n")


def histogram(events: DataFrame, value: Column, width: float, buckets: int) -> DataFrame:
    """(bucket, n), added up over the whole feed."""
    return events.groupBy(bucket(value, width, buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def distinct_events(events: DataFrame, time: str, late: str, *keys: str) -> DataFrame:
    """Each key once within the time that rows may be late."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def into_catalog(changes: DataFrame, catalog_path: str, checkpoint: str, columns: list[str], **trigger) -> StreamingQuery:
    """Fold change rows (volume_id, file_id, seq, deleted, columns) into the
    ``CatalogStore`` of a folder.  A batch costs what it holds, not what the
    catalog does, and a batch that is run again changes nothing.  By default all
    that is there is read; ``processingTime="1 minute"`` goes on for ever."""

    def fold(batch: DataFrame, number: int) -> None:
        CatalogStore(batch.sparkSession, catalog_path, columns).add(batch, number)

    kept = changes.select("volume_id", "file_id", "seq", "deleted", *columns)
    return kept.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def ring_percentiles(events: DataFrame, key: str, value: str, size: int, percents: tuple[float, ...] = (50.0, 95.0, 99.0)) -> DataFrame:
    """(key, n, percent, value) of the last ``size`` values of each key of a feed,
    in order of arrival: a ring buffer of bounded size is the state of a key.
    The value at index min(floor(p / 100 * n), n - 1) of the sorted buffer."""
    kind = events.schema[key].dataType.simpleString()

    def turn(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ring = list(state.get[0]) if state.exists else []
        for batch in batches:
            ring = (ring + batch[value].dropna().astype(float).tolist())[-size:]
        state.update((ring,))
        inside = sorted(ring)
        rows = [(name[0], len(inside), p, inside[min(int(p / 100 * len(inside)), len(inside) - 1)]) for p in percents] if inside else []
        yield pd.DataFrame(rows, columns=[key, "n", "percent", "value"])

    out = f"{key} {kind}, n long, percent double, value double"
    return events.select(key, value).groupBy(key).applyInPandasWithState(turn, out, "ring array<double>", "update", GroupStateTimeout.NoTimeout)


def append_snapshots(feed: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append the rows of a feed of snapshot summaries to a series in ``path``; what is
    there is never changed, and a batch that is run again is not appended twice."""
    return feed.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def run_to_end(stream: DataFrame, label: str, mode: str = "complete") -> DataFrame:
    """What a stream has given once all that is there was read: the last batch of a
    complete one, else everything appended.  Kept in the shared folder."""
    spark = stream.sparkSession
    scratch = Scratch(spark, f"stream-{label}")
    out = f"{scratch.root}/out"

    seen: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        seen.append(number)
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{scratch.root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if not seen:  # nothing arrived
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(out)
