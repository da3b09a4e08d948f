"""The N highest-scoring items of every group, by simultaneous bisection.

An item's code is its score followed by its identifier, lower identifiers
first.  For all groups at once the interval that holds the N-th code is cut at
63 midpoints, the rows above each midpoint are counted with map-side partial
counts, and the interval shrinks to the piece in which the count passes N,
until a cutoff leaves exactly N.  A group's rows never meet in one task: only
its at most 64 counts do, and at the end its N rows.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.runtime import BROADCAST_ROWS, Scratch, hot_limit, lookup_join, maybe_broadcast

#: Pieces into which each interval is cut in a round.
PIECES = 64
_MOST = 2**63 - 1


def _piece(high: Column, low: Column, a: Column, b: Column) -> Column:
    """Piece, below PIECES, that a value falls in: ``a - b`` is its way from the
    interval's first value.  Differences of halves stand for those that might
    not fit BIGINT; they keep the order."""
    half = lambda c: F.shiftright(c, 1)
    down = lambda way, width: F.call_function("div", way, F.call_function("div", width, F.lit(PIECES)) + 1)
    wide = half(high) - half(low) >= 2**61
    return F.when(wide, down(half(a) - half(b), half(high) - half(low))).otherwise(down(a - b, high - low))


def _double_code(x: Column) -> Column:
    """BIGINT that orders as the doubles do: their bits as a whole number, negated
    for negative ones, worked out from exponent and mantissa."""
    a = F.abs(x)
    guess = F.greatest(F.least(F.floor(F.log2(F.when(a > 0, a))), F.lit(1023)), F.lit(-1022)).cast("int")
    power = lambda e: F.pow(F.lit(2.0), e.cast("double"))
    # The logarithm may be off by one next to a power of two.
    e = F.when((a < power(guess)) & (guess > -1022), guess - 1).when((guess < 1023) & (a / 2 >= power(guess)), guess + 1).otherwise(guess)
    normal = (e + 1023).cast("bigint") * 2**52 + ((a / power(e) - 1) * 2.0**52).cast("bigint")
    bits = F.when(a == 0, 0).when(a == float("inf"), 2047 * 2**52).when(a < 2.0**-1022, (a * 2.0**537 * 2.0**537).cast("bigint")).otherwise(normal)
    return F.when(x < 0, -bits).otherwise(bits)


def score_code(score: Column, kind: T.DataType) -> Column:
    """BIGINT code that orders as the scores do, without a loss; null for NaN."""
    if isinstance(kind, T.IntegralType):
        return score.cast("bigint")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(score), _double_code(score.cast("double")))
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return (score * F.lit(Decimal(10) ** kind.scale)).cast("bigint")
    raise TypeError(f"scores of {kind.simpleString()}: cast them to double or decimal(18, s)")


def _counted(open_rows: DataFrame) -> DataFrame:
    """Counts and bounds of each piece of each group's interval."""
    by_score = F.col("hi_s") > F.col("lo_s")
    piece = F.when(by_score, _piece(F.col("hi_s"), F.col("lo_s"), F.col("hi_s"), F.col("s"))).otherwise(_piece(F.col("hi_t"), F.col("lo_t"), F.col("t"), F.col("lo_t")))
    return open_rows.groupBy("g", "need", by_score.alias("by_score"), piece.alias("piece")).agg(
        F.count(F.lit(1)).alias("n"), F.min("s").alias("lo_s"), F.max("s").alias("hi_s"), F.min("t").alias("lo_t"), F.max("t").alias("hi_t")
    )


def _crossing(counted: DataFrame) -> DataFrame:
    """The piece of each group in which the count from above reaches ``need``."""
    upto = F.sum("n").over(Window.partitionBy("g").orderBy("piece").rowsBetween(Window.unboundedPreceding, 0))
    return counted.withColumn("upto", upto).where("upto >= need and upto - n < need")


def _attach(rows: DataFrame, state: DataFrame, n_state: int, hot: DataFrame | None) -> DataFrame:
    if n_state <= BROADCAST_ROWS:
        return rows.join(maybe_broadcast(state, n_state), "g")
    return lookup_join(rows, state, "g", hot, "inner")


def top_n_per_group(rows: DataFrame, group: str, score: str, ident: str, n: int, unique: bool = False) -> DataFrame:
    """Rows (group, rank_no, ident, score): the ``n`` highest scores per group.

    Equal scores go by ascending ``ident``; all rows if a group has fewer.
    ``score`` is a whole number, FLOAT, DOUBLE or DECIMAL of at most 18 digits
    and ``ident`` a whole number; other types raise TypeError.  A row with a
    null group, score or ident, or the score NaN, has no rank; repeated rows
    count once (``unique`` says there are none); further columns are ignored;
    an empty table gives an empty result.
    """
    scratch = Scratch(rows.sparkSession, "topn")
    kind, whole = rows.schema[score].dataType, isinstance(rows.schema[score].dataType, T.IntegralType)
    if not isinstance(rows.schema[ident].dataType, T.IntegralType):
        raise TypeError(f"identifiers of {rows.schema[ident].dataType.simpleString()}")
    codes = rows.select(F.col(group).alias("g"), score_code(F.col(score), kind).alias("s"), F.col(ident).cast("bigint").alias("t"), *([] if whole else [F.col(score).alias("v")])).dropna()
    codes = scratch.write(codes if unique else codes.distinct(), "codes")
    bounds = codes.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("lo_s"), F.max("s").alias("hi_s"), F.min("t").alias("lo_t"), F.max("t").alias("hi_t"))
    bounds = scratch.write(bounds, "bounds", open=F.count_if(F.col("n") > n), undecided=F.sum(F.when(F.col("n") > n, F.col("n"))))
    hot = None
    if scratch.rows["codes"] >= hot_limit(scratch.rows["codes"]):
        hot = scratch.write(bounds.where(F.col("n") >= hot_limit(scratch.rows["codes"])).select("g"), "hot")
    cutoffs = [bounds.where(F.col("n") <= n).select("g", F.col("lo_s").alias("cut_s"), F.lit(_MOST).alias("cut_t"))]
    intervals = ["lo_s", "hi_s", "lo_t", "hi_t"]
    state = bounds.where(F.col("n") > n).select("g", F.lit(n).cast("bigint").alias("need"), *intervals)
    left, undecided, held, k = scratch.rows["bounds.open"], scratch.rows["bounds.undecided"] or 0, scratch.rows["codes"], 0
    within, kept = codes, "none"
    while left:
        inside = _attach(within, state, left, hot).where("s between lo_s and hi_s and (lo_s < hi_s or t between lo_t and hi_t)")
        if k and undecided * 4 < held:  # the rest is small: keep only that
            within, held = scratch.write(inside.select("g", "s", "t"), f"within{k}"), undecided
            scratch.drop(kept)
            kept = f"within{k}"
            inside = _attach(within, state, left, hot)
        k += 1
        cut = _crossing(_counted(inside))
        more = F.col("upto") > F.col("need")
        cut = scratch.write(cut, f"cut{k}", open=F.count_if(more), undecided=F.sum(F.when(more, F.col("n"))))
        left, undecided = scratch.rows[f"cut{k}.open"], scratch.rows[f"cut{k}.undecided"] or 0
        cutoffs.append(cut.where(~more).select("g", F.col("lo_s").alias("cut_s"), F.when(F.col("by_score"), F.lit(_MOST)).otherwise(F.col("hi_t")).alias("cut_t")))
        state = cut.where(more).select("g", (F.col("need") - F.col("upto") + F.col("n")).alias("need"), *intervals)
    scratch.drop(kept)
    every = reduce(DataFrame.unionByName, cutoffs)
    best = _attach(codes, every, scratch.rows["bounds"], hot).where("s > cut_s or (s = cut_s and t <= cut_t)")
    order = Window.partitionBy("g").orderBy(F.col("s").desc(), F.col("t"))  # n rows at most
    back = F.col("s").cast(kind) if whole else F.col("v")
    out = best.select(F.col("g").alias(group), F.row_number().over(order).alias("rank_no"), F.col("t").cast(rows.schema[ident].dataType).alias(ident), back.alias(score))
    return out
