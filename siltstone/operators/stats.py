"""Order statistics, fixed-width histograms, deltas and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of a counting pass, and rows of a bucket that may be sorted together.
PIECES = 4096
SORTED_ROWS = 100_000


def order_statistics(df: DataFrame, value: str, places: dict[str, float]) -> dict[str, float]:
    """Exact values at index min(floor(p * n), n - 1) of the sorted column.

    Counts in equal pieces narrow the interval around each index until few rows
    are left to sort, all places in one pass a round, so no task ever sorts the
    whole column.  Whole numbers of any size are cut by whole numbers.  Nulls
    are left out; an empty column gives nulls.
    """
    values = df.select(F.col(value).alias("v")).where("v is not null")
    kind = values.schema["v"].dataType
    whole = values.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    n = whole["n"]
    if not n:
        return dict.fromkeys(places)
    open_at = {name: (min(int(p * n), n - 1), whole["lo"], whole["hi"], n) for name, p in places.items()}
    out: dict[str, float] = {}
    while open_at:
        out |= {name: lo for name, (_, lo, hi, _) in open_at.items() if lo == hi}
        open_at = {name: at for name, at in open_at.items() if name not in out}
        # Intervals are equal or disjoint: a row lies in one at most.
        spans = sorted({(lo, hi, n) for _, lo, hi, n in open_at.values()})
        if not spans:
            break
        number, piece = F.lit(None).cast("int"), F.lit(None).cast("bigint")
        for k, (lo, hi, held) in enumerate(spans):
            inside = F.col("v").between(F.lit(lo).cast(kind), F.lit(hi).cast(kind))
            number = F.when(inside, k).otherwise(number)
            piece = F.when(inside, F.lit(-1) if held <= SORTED_ROWS else _piece(kind, lo, hi)).otherwise(piece)
        # Few rows are counted by value, many by piece: at most SORTED_ROWS or PIECES rows an interval.
        alone = F.when(F.col("piece") < 0, F.col("v"))
        counts = (
            values.select("v", number.alias("number"), piece.alias("piece")).where("number is not null").groupBy("number", "piece", alone.alias("one"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        )
        for name, (index, lo, hi, held) in open_at.items():
            k = spans.index((lo, hi, held))
            for r in sorted((r for r in counts if r["number"] == k), key=lambda r: (r["piece"], r["lo"])):
                if index < r["n"]:
                    open_at[name] = (index, r["lo"], r["hi"], r["n"])
                    break
                index -= r["n"]
    return {name: out[name] for name in places}


def _piece(kind: T.DataType, lo, hi) -> Column:
    """Number, below PIECES, of the equal piece of [lo, hi] that holds v."""
    v = F.col("v")
    if isinstance(kind, T.IntegralType):
        width = (hi - lo) // PIECES + 1
        down = v.cast("decimal(20,0)") - F.lit(lo).cast("decimal(20,0)") if hi - lo >= 2**63 else v.cast("bigint") - F.lit(lo).cast("bigint")
        return F.call_function("div", down, F.lit(width).cast("decimal(20,0)" if hi - lo >= 2**63 else "bigint")).cast("bigint")
    if isinstance(kind, T.DecimalType):
        share = (v - F.lit(lo)) / F.lit(hi - lo)
    else:  # halves can't overflow
        share = (v / 2 - lo / 2) / (hi / 2 - lo / 2)
    return F.least(F.floor(share * PIECES), F.lit(PIECES - 1)).cast("bigint")


def bucket(value: Column, width: float, buckets: int) -> Column:
    """floor(value / width), kept within 0 and buckets - 1."""
    return F.greatest(F.least(F.floor(value / width), F.lit(buckets - 1)), F.lit(0)).cast("int")


def histogram(df: DataFrame, value: Column, width: float, buckets: int, *keys: str) -> DataFrame:
    """(keys, bucket, n, total, least, most): mergeable by adding up."""
    return df.groupBy(*keys, bucket(value, width, buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))


def merge_histograms(one: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    both = one.unionByName(other)
    return both.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))


def histogram_percentiles(counts: DataFrame, width: float, percents: list[float], *keys: str) -> DataFrame:
    """(keys, percent, value): lower edge of the first bucket in which the count
    from below reaches the percentage of all.  Works on counts, not on rows."""
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.select(*keys, "bucket", upto.alias("upto"), F.sum("n").over(Window.partitionBy(*keys)).alias("all_n"))
    ranked = ranked.withColumn("percent", F.explode(F.array(*map(F.lit, percents))))
    return ranked.where(F.col("upto") >= F.col("all_n") * F.col("percent") / 100).groupBy(*keys, "percent").agg((F.min("bucket").cast("bigint") * width).alias("value"))
