"""Rectangles of sized items: squarified, strip, shelf and spiral layouts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: If set, the items of one parent that get a rectangle of their own, for
#: display; the rest share one.
SHOWN: int | None = None


def shown_items(items: DataFrame) -> DataFrame:
    """(parent, id, size, rank_no): all items of each parent, largest first; with
    SHOWN only so many, and one of id -1 with the size of all others.  Empty items
    are left out."""
    live = items.where("size > 0").select("parent", "id", "size")
    order = Window.partitionBy("parent").orderBy(F.col("size").desc(), "id")
    top = live.withColumn("rank_no", F.row_number().over(order))
    if SHOWN is None:
        return top
    top = top.where(F.col("rank_no") <= SHOWN)
    whole = live.groupBy("parent").agg(F.sum("size").alias("whole"), F.count(F.lit(1)).alias("n")).where(F.col("n") > SHOWN)
    kept = top.groupBy("parent").agg(F.sum("size").alias("kept"))
    rest = whole.join(kept, "parent").select("parent", F.lit(-1).cast("bigint").alias("id"), (F.col("whole") - F.col("kept")).alias("size"), F.lit(SHOWN + 1).alias("rank_no"))
    return top.unionByName(rest)


def squarify(sizes: list[float], x: float, y: float, w: float, h: float) -> list[tuple[float, float, float, float]]:
    """Rectangles (x, y, w, h) of sizes, largest first, that fill a rectangle.

    A row along the shorter side takes items as long as its worst aspect ratio
    gets better.
    """
    scale = w * h / sum(sizes) if sizes else 0.0
    areas = [s * scale for s in sizes]
    out: list[tuple[float, float, float, float]] = []
    at = 0
    while at < len(areas):
        side = min(w, h)
        end, total = at + 1, areas[at]
        worst = _worst(areas[at], areas[at], total, side)
        while end < len(areas) and (better := _worst(areas[at], areas[end], total + areas[end], side)) <= worst:
            worst, total, end = better, total + areas[end], end + 1
        depth, along = total / side if side else 0.0, 0.0
        for a in areas[at:end]:
            length = a / depth if depth else 0.0
            out.append((x, y + along, depth, length) if w >= h else (x + along, y, length, depth))
            along += length
        x, y, w, h = (x + depth, y, w - depth, h) if w >= h else (x, y + depth, w, h - depth)
        at = end
    return out


#: Items that are laid out together in one Python call, whole parents each.
CALL_ITEMS = 50_000


def _laid_out(shown: DataFrame, n: int, place) -> DataFrame:
    """``place(sizes)`` of each parent's items by rank; many parents share a call."""
    calls = max(1, n // CALL_ITEMS)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["parent", "size", "rank_no"], ascending=[True, False, True])
        spots: list[tuple[float, float, float, float]] = []
        ends = np.flatnonzero(np.diff(pdf["parent"].to_numpy())) + 1
        sizes = pdf["size"].to_numpy(dtype=np.float64)
        for some in np.split(sizes, ends):
            spots += place(some.tolist())
        x, y, w, h = np.array(spots).T
        return pd.DataFrame({"parent": pdf["parent"].to_numpy(), "id": pdf["id"].to_numpy(), "x": x, "y": y, "w": w, "h": h})

    keyed = shown.withColumn("_call", F.pmod(F.xxhash64("parent"), F.lit(calls)))
    return keyed.groupBy("_call").applyInPandas(run, "parent long, id long, x double, y double, w double, h double")


def _worst(most: float, least: float, total: float, side: float) -> float:
    return max(side * side * most / (total * total), total * total / (side * side * least)) if least and total and side else 0.0


def squarified(items: DataFrame, width: float = 1.0, height: float = 1.0) -> DataFrame:
    """(parent, id, x, y, w, h) of each parent's items within its rectangle."""

    return _laid_out(shown_items(items), items.count(), lambda sizes: squarify(sizes, 0.0, 0.0, width, height))


def strips(items: DataFrame, width: float = 1.0, height: float = 1.0) -> DataFrame:
    """(parent, id, x, y, w, h): full-width strips, heights by size, largest first."""
    shown = shown_items(items)
    order = Window.partitionBy("parent").orderBy("rank_no")
    above = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("size").over(Window.partitionBy("parent"))
    return shown.select("parent", "id", F.lit(0.0).alias("x"), (above / whole * height).alias("y"), F.lit(width).alias("w"), (F.col("size") / whole * height).alias("h"))


def spiral(items: DataFrame, centre: tuple[float, float] = (0.5, 0.5), start: float = 10.0, growth: float = 5.0, turn: float = 0.5) -> DataFrame:
    """(parent, id, x, y, side): squares along a spiral, by rank."""
    step = F.col("rank_no") - 1
    radius, angle = start + growth * step, turn * step
    return shown_items(items).select("parent", "id", (centre[0] + radius * F.cos(angle)).alias("x"), (centre[1] + radius * F.sin(angle)).alias("y"), (F.sqrt("size") * 2).alias("side"))


def shelves(items: DataFrame, width: float = 1.0, height: float = 1.0) -> DataFrame:
    """(parent, id, x, y, w, h): squares of the items' areas, from left to right; a
    shelf ends when it passes the right edge."""

    def place(sizes: list[float]) -> list[tuple[float, float, float, float]]:
        whole, x, y, tall, out = sum(sizes), 0.0, 0.0, 0.0, []
        for size in sizes:
            side = (size / whole * width * height) ** 0.5
            out.append((x, y, side, side))
            x, tall = x + side, max(tall, side)
            if x > width:
                x, y, tall = 0.0, y + tall, 0.0
        return out

    return _laid_out(shown_items(items), items.count(), place)


def contains(x: Column, y: Column) -> Column:
    """Whether a rectangle of the row holds a point."""
    return (F.col("x") <= x) & (x < F.col("x") + F.col("w")) & (F.col("y") <= y) & (y < F.col("y") + F.col("h"))


def hit_test(rectangles: DataFrame, x: float, y: float) -> DataFrame:
    """The deepest rectangle (with ``depth``) that holds a point."""
    return rectangles.where(contains(F.lit(x), F.lit(y))).orderBy(F.col("depth").desc(), "id").limit(1)


def visible(rectangles: DataFrame, left: float, top: float, right: float, bottom: float) -> DataFrame:
    """Rectangles that overlap a viewport."""
    return rectangles.where((F.col("x") < right) & (F.col("x") + F.col("w") > left) & (F.col("y") < bottom) & (F.col("y") + F.col("h") > top))


def layout_faults(rectangles: DataFrame, width: float, height: float, slack: float = 1e-6) -> DataFrame:
    """(parent, items, fills, inside, apart) of rectangles (parent, id, x, y, w, h):
    whether those of a parent have the area of its rectangle, lie in it, and no
    two overlap.

    Rectangles that fill theirs without a gap overlap nowhere just if every
    corner point inside it is met by corners of exactly one full turn: each
    corner adds +1 or -1 by its kind, and in a tiling the sums vanish but at
    the corners of the whole.  So no two rectangles are ever compared.
    """
    unit = slack * max(width, height)
    grid = lambda c: F.round(c / unit).cast("bigint")
    corners = F.array(*(F.struct(grid(x).alias("u"), grid(y).alias("v"), F.lit(s).alias("s")) for x, y, s in (
        (F.col("x"), F.col("y"), 1), (F.col("x") + F.col("w"), F.col("y"), -1), (F.col("x"), F.col("y") + F.col("h"), -1), (F.col("x") + F.col("w"), F.col("y") + F.col("h"), 1),
    )))
    inner = (F.col("x") > -unit) & (F.col("y") > -unit) & (F.col("x") + F.col("w") < width + unit) & (F.col("y") + F.col("h") < height + unit)
    whole = rectangles.groupBy("parent").agg(F.count(F.lit(1)).alias("items"), (F.abs(F.sum(F.col("w") * F.col("h")) - width * height) < slack * width * height).alias("fills"), F.bool_and(inner).alias("inside"))
    met = rectangles.select("parent", F.inline(corners)).groupBy("parent", "u", "v").agg(F.sum("s").alias("s")).where("s <> 0")
    # Rounding may part corners that are one: sums of neighbouring cells are taken together.
    near = met.select("parent", F.call_function("div", F.col("u") + 4, F.lit(8)).alias("u"), F.call_function("div", F.col("v") + 4, F.lit(8)).alias("v"), "s").groupBy("parent", "u", "v").agg(F.sum("s").alias("s")).where("s <> 0")
    odd = near.groupBy("parent").agg(F.count(F.lit(1)).alias("n"))
    return whole.join(odd, "parent", "left").select("parent", "items", "fills", "inside", (F.coalesce("n", F.lit(0)) <= 4).alias("apart"))


def extension_colour(extension: Column) -> Column:
    """Colour class of an extension."""
    return (
        F.when(extension.isin(".exe", ".dll"), "red").when(extension.isin(".jpg", ".png", ".gif"), "green").when(extension.isin(".mp3", ".wav", ".flac"), "yellow")
        .when(extension.isin(".txt", ".doc", ".pdf"), "purple").otherwise("gray")
    )
