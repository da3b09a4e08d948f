"""Parent-child rows to trees: roots, depths, nested-set ranges, roll-ups, paths.

Pointer doubling carries everything in as many rounds as the deepest branch
has binary digits: in round k a node knows its 2^k-th ancestor, and what lies
less than 2^k below it.

1. Upward: the size (and byte total) of each subtree.  Nodes whose ancestor
   pointer never runs out hang on a cycle.
2. Siblings get consecutive preorder ranges by prefix sums of those sizes.
3. Downward: a node's place is the sum of the sibling offsets on its path, so
   that [pre, pre + n_below] holds exactly the node and its descendants.

A node leaves the rounds once its pointer has run out and nothing lies 2^k
below it: each round handles only nodes on branches still longer than that.
When few are left, one task takes them through the remaining rounds.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.runtime import HOT_ROWS, Scratch, hot_limit, lookup_join, maybe_broadcast

#: Between the names of a path.
SEPARATOR = "/"
#: Nodes, at most, that one task takes through the rounds that are left.
TASK_NODES = 100_000
#: Children of a parent that are placed in one block.
BLOCK_CHILDREN = 8_192
_UP = "id bigint, parent bigint, target bigint, size bigint, total bigint, depth bigint, root bigint, reach int"
_DOWN = "id bigint, parent bigint, target bigint, size bigint, total bigint, depth bigint, root bigint, reach int, pre bigint"


def current_rows(df: DataFrame, key: list[str], seq: str, values: list[str]) -> DataFrame:
    """The row with the highest ``seq`` of each ``key``, with ``values``.

    Rows of equal ``seq`` are told apart by their values, the greatest wins, so
    that the result does not depend on row order.  A null ``seq`` is the lowest.
    """
    best = F.max(F.struct(F.col(seq).alias("_order"), *values)).alias("_best")
    return df.groupBy(*key).agg(best).select(*key, *(F.col(f"_best.{v}").alias(v) for v in values))


def _hot(scratch: Scratch, name: str, targets: DataFrame, rows: int) -> DataFrame | None:
    """Targets of very many pointers (``targets``: column target), if any can be."""
    if rows < HOT_ROWS:
        return None
    limit = hot_limit(rows)
    counts = targets.groupBy("target").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= limit).select("target")
    kept = scratch.write(counts, name)
    return kept if scratch.rows[name] else None


def _column(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a BIGINT column, 0 for null, and where it is null."""
    one = table[name].combine_chunks()
    none = one.is_null().to_numpy(zero_copy_only=False)
    return one.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), none


def _places(ids: np.ndarray, wanted: np.ndarray, none: np.ndarray) -> np.ndarray:
    """Row of each wanted id, -1 for none."""
    order = np.argsort(ids, kind="stable")
    at = np.minimum(np.searchsorted(ids[order], wanted), len(ids) - 1)
    found = ~none & (ids[order][at] == wanted)
    return np.where(found, order[at], -1)


def _finish_up(first: int):
    """The rounds from ``first`` on, for a table of all nodes that are left."""

    def finish(table: pa.Table) -> pa.Table:
        ids, _ = _column(table, "id")
        parent, no_parent = _column(table, "parent")
        wanted, none = _column(table, "target")
        size, total, depth, root, reach = (_column(table, c)[0] for c in ("size", "total", "depth", "root", "reach"))
        fits = ~_column(table, "total")[1]
        rough = total.astype(np.float64)
        target = _places(ids, wanted, none)
        orphan = ~none & (target < 0)  # the node below a parent without a row is the root
        depth[orphan] -= 1
        if not first:
            no_parent |= orphan
        k = first
        while True:
            up = np.flatnonzero(target >= 0)
            if not len(up):
                break
            to = target[up]
            more, more_total, more_rough = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), np.zeros(len(ids))
            np.add.at(more, to, size[up])
            with np.errstate(over="ignore"):
                np.add.at(more_total, to, total[up])
            np.add.at(more_rough, to, rough[up])
            reach[to] = k
            depth[up], root[up] = depth[up] + depth[to], root[to]
            after = target[to]
            with np.errstate(over="ignore"):
                size, total, rough = size + more, total + more_total, rough + more_rough
            left, target[up] = len(up), after
            k += 1
            if int((target >= 0).sum()) == left:
                break
        fits &= np.abs(rough) < 2.0**63
        back = np.where(target >= 0, ids[target], 0)
        return pa.table({
            "id": ids, "parent": pa.array(parent, pa.int64(), mask=no_parent), "target": pa.array(back, pa.int64(), mask=target < 0), "size": size,
            "total": pa.array(total, pa.int64(), mask=~fits), "depth": depth, "root": root, "reach": pa.array(reach.astype(np.int32)),
        })

    return finish


def _finish_down(first: int):
    """The rounds from ``first`` on of the places, for all nodes that are left."""

    def finish(table: pa.Table) -> pa.Table:
        ids, _ = _column(table, "id")
        target = _places(ids, *_column(table, "target"))
        pre, _ = _column(table, "pre")
        path = np.array(table["path"].to_pylist(), dtype=object) if "path" in table.column_names else None
        while len(up := np.flatnonzero(target >= 0)):
            to = target[up]
            pre[up] += pre[to]
            if path is not None:
                path[up] = [a + SEPARATOR + b for a, b in zip(path[to], path[up], strict=True)]
            target[up] = target[to]
        out = table.set_column(table.column_names.index("pre"), "pre", pa.array(pre))
        out = out.set_column(out.column_names.index("target"), "target", pa.nulls(len(ids), pa.int64()))
        return out if path is None else out.set_column(out.column_names.index("path"), "path", pa.array(path.tolist(), pa.string()))

    return finish


def _double_up(scratch: Scratch, nodes: DataFrame, extra: list[str]) -> tuple[DataFrame, int, list[DataFrame | None]]:
    """Subtree sizes, totals, depths and roots; rounds done and their hot targets.

    ``nodes``: id, parent (null or 0 for a root), bytes, ``extra``.  A parent
    that is no id makes a root as well.  Nodes that still have a target at the
    end hang on a cycle.  ``reach`` is the last round in which something lay
    2^reach below a node, -1 for a leaf.
    """
    target = F.nullif("parent", F.lit(0).cast("bigint"))
    state = nodes.select(
        "id",
        target.alias("parent"),
        target.alias("target"),
        F.lit(1).cast("bigint").alias("size"),
        F.coalesce("bytes", F.lit(0).cast("bigint")).alias("total"),
        F.when(target.isNull(), 0).otherwise(1).cast("bigint").alias("depth"),
        F.col("id").alias("root"),  # the last node below the target
        F.lit(-1).alias("reach"),
        *extra,
        F.lit(True).alias("stays"),
    )
    stays, open_nodes = F.count_if("stays"), F.count(F.col("target"))
    state = scratch.write(state, "up0", stays=stays, open=open_nodes)
    done: list[DataFrame] = []
    hots: list[DataFrame | None] = []
    k = 0
    while (left := scratch.rows[f"up{k}.open"]) and scratch.rows[f"up{k}.stays"] > TASK_NODES:
        here = state.where("stays")
        pointing = here.where("target is not null")
        hot = _hot(scratch, f"hot{k}", pointing.select("target"), left)
        hots.append(hot)
        gains = pointing.groupBy(F.col("target").alias("id")).agg(F.sum("size").alias("more"), F.try_sum("total").alias("more_total"))
        ahead = here.select(F.col("id").alias("target"), F.col("target").alias("next"), F.col("depth").alias("further"), F.col("root").alias("next_root"))
        moved = lookup_join(pointing, ahead, "target", hot)
        # Where nothing was found the path has passed its top: a parent has no row.
        known = F.col("next_root").isNotNull()
        moved = moved.select(
            "id", (F.col("parent") if k else F.when(known, F.col("parent"))).alias("parent"), F.col("next").alias("target"), "size", "total",
            (F.col("depth") + F.coalesce("further", F.lit(-1))).alias("depth"), F.coalesce("next_root", "root").alias("root"), "reach", *extra,
        )
        closed = here.where("target is null").select(*moved.columns)
        gained = F.col("more").isNotNull()
        after = moved.unionByName(closed).join(gains, "id", "left").select(
            "id", "parent", "target", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"), F.when(gained, F.try_add("total", "more_total")).otherwise(F.col("total")).alias("total"), "depth", "root",
            F.when(gained, k).otherwise(F.col("reach")).alias("reach"), *extra, (F.col("target").isNotNull() | gained).alias("stays"),
        )
        k += 1
        state = scratch.write(after, f"up{k}", stays=stays, open=open_nodes)
        done.append(state.where("not stays").drop("stays"))
        # Depths have no gaps: while an acyclic node is left, each round ends one.
        if scratch.rows[f"up{k}.open"] == left:
            break
    here = state.where("stays").drop("stays")
    if scratch.rows[f"up{k}.open"] and scratch.rows[f"up{k}.stays"] <= TASK_NODES:
        rest = here.drop(*extra).groupBy().applyInArrow(_finish_up(k), _UP)
        if extra:
            rest = rest.join(here.select("id", *extra), "id")
        here = scratch.write(rest, "up_rest")
    return reduce(DataFrame.unionByName, done, here), k, hots


def _finish_rings(table: pa.Table) -> pa.Table:
    """``_cycle_roots`` of a table that one task can take."""
    ids, _ = _column(table, "id")
    target = _places(ids, *_column(table, "target"))
    least = ids[target]
    for _ in range(len(ids).bit_length() + 1):
        least, target = np.minimum(least, least[target]), target[target]
    return pa.table({"id": ids, "cycle_id": least[target]})


def _cycle_roots(scratch: Scratch, links: DataFrame, rows: int) -> DataFrame:
    """(id, cycle_id) of nodes that hang on a cycle; ``links``: id, target, all
    inside the set.  cycle_id is the smallest id on the cycle.

    After enough doublings every pointer ends on its cycle, and the least id
    seen on the way from there is that of the whole cycle.
    """
    if rows <= TASK_NODES:
        return links.select("id", "target").groupBy().applyInArrow(_finish_rings, "id bigint, cycle_id bigint")
    state = scratch.write(links.select("id", "target", F.col("target").alias("least")), "ring0")
    k, landed = 0, -1
    while True:
        # The targets shrink to the nodes on cycles and then stay as many.
        hot = _hot(scratch, f"ring_hot{k}", state.select("target"), rows)
        ends = state.select(F.col("target").alias("id")).distinct()
        on_ring = state.join(ends, "id", "left_semi").select("id", "target", "least")
        pairs = on_ring.join(on_ring.select(F.col("id").alias("target"), F.col("least").alias("then")), "target")
        n, unequal = pairs.agg(F.count(F.lit(1)), F.count_if(F.col("least") != F.col("then"))).first()
        if n == landed and not unequal:
            break
        landed = n
        ahead = state.select(F.col("id").alias("target"), F.col("target").alias("next"), F.col("least").alias("then"))
        k += 1
        moved = lookup_join(state, ahead, "target", hot, "inner")
        state = scratch.write(moved.select("id", F.col("next").alias("target"), F.least("least", "then").alias("least")), f"ring{k}")
        scratch.drop(f"ring{k - 1}")
    rings = state.join(ends, "id", "left_semi").select(F.col("id").alias("target"), F.col("least").alias("cycle_id"))
    return lookup_join(state.select("id", "target"), rings, "target", hot, "inner").select("id", "cycle_id")


def _shifts(scratch: Scratch, nodes: DataFrame, rows: int) -> DataFrame:
    """``nodes`` (id, parent, size, ...) with ``pre``, for now their place within the
    parent: 1 plus the sizes of earlier siblings, 0 for a root.

    Siblings go by id; those of a parent of more than BLOCK_CHILDREN by blocks,
    dealt by a hash of the id, and in a block by id.  Prefix sums are taken in
    each block and then over the blocks, so that the children of one parent are
    never all in one task, whatever their ids are.
    """
    zero = F.lit(0).cast("bigint")
    wide = None
    if rows > BLOCK_CHILDREN:
        counts = nodes.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK_CHILDREN)
        wide = scratch.write(counts.select("parent", F.ceil(F.col("n") / BLOCK_CHILDREN).cast("int").alias("blocks")), "wide")
        wide = wide if scratch.rows["wide"] else None
    # Roots, which may be any number, are spread as well: they need no place.
    if wide is None:
        blocked = nodes.withColumn("block", F.when(F.col("parent").isNull(), F.col("id")).otherwise(zero))
    else:
        dealt = F.when(F.col("parent").isNull(), F.col("id")).when(F.col("blocks").isNull(), zero).otherwise(F.pmod(F.xxhash64("id"), F.col("blocks")))
        blocked = nodes.join(maybe_broadcast(wide, scratch.rows["wide"]), "parent", "left").withColumn("block", dealt.cast("bigint")).drop("blocks")
    of_node = Window.partitionBy("parent", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    inner = F.when(F.col("parent").isNull(), zero).otherwise(F.coalesce(F.sum("size").over(of_node), zero) + 1)
    placed = blocked.withColumn("pre", inner)
    if wide is None:
        return placed.drop("block")
    large = maybe_broadcast(wide.select("parent"), scratch.rows["wide"])
    of_block = Window.partitionBy("parent").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocked.join(large, "parent", "left_semi").groupBy("parent", "block").agg(F.sum("size").alias("block_size"))
    starts = scratch.write(sizes.select("parent", "block", F.coalesce(F.sum("block_size").over(of_block), zero).alias("start")), "starts")
    joined = placed.join(maybe_broadcast(starts, scratch.rows["starts"]), ["parent", "block"], "left")
    return joined.withColumn("pre", F.col("pre") + F.coalesce("start", zero)).drop("block", "start")


def hierarchy(nodes: DataFrame, with_paths: bool = False) -> DataFrame:
    """Trees of ``nodes`` (id, parent, name, bytes), one row per id.

    Columns: id, parent, root, depth, pre, last, n_below, total_bytes, on_cycle,
    and with ``with_paths`` the path of names from the root.  A parent that is
    null, 0 or no id makes a root.  Descendants of x are the rows with the same
    root and pre in (x.pre, x.last]; ancestors those whose range holds x.pre.
    On or below a cycle root is the smallest id on it, depth, pre, last and
    n_below are -1, total_bytes and path null.

    Rows with a null id are no nodes; of several rows of one id the greatest
    (parent, name, bytes) holds; null bytes count 0, a total beyond BIGINT is
    null, and a null name is empty.  An empty table gives an empty result.
    """
    spark: SparkSession = nodes.sparkSession
    scratch = Scratch(spark, "hierarchy")
    own = nodes.where("id is not null").groupBy("id").agg(F.max(F.struct("parent", "name", "bytes")).alias("r")).select("id", "r.*")
    extra = ["name"] if with_paths else []
    up, rounds, hots = _double_up(scratch, own, extra)
    rows = scratch.rows["up0"]
    trees = up.where("target is null").withColumn("target", F.col("parent"))
    down = _shifts(scratch, trees, rows)
    if with_paths:
        down = down.withColumn("path", F.coalesce("name", F.lit(""))).drop("name")
    stays = lambda k: F.col("target").isNotNull() | (F.col("reach") >= k)
    state = scratch.write(down.withColumn("stays", stays(0)), "down0", stays=F.count_if("stays"), open=F.count(F.col("target")))
    done = [state.where("not stays").drop("stays")]
    for k in range(rounds):
        if not scratch.rows[f"down{k}.open"]:
            break
        here = state.where("stays").drop("stays")
        # The pointers are those of the way up, and so are the hot ones.
        ahead = here.select(F.col("id").alias("target"), F.col("target").alias("next"), F.col("pre").alias("further"), *([F.col("path").alias("above")] if with_paths else []))
        moved = lookup_join(here.where("target is not null"), ahead, "target", hots[k], "inner").withColumns({"pre": F.col("pre") + F.col("further"), "target": F.col("next")})
        if with_paths:
            moved = moved.withColumn("path", F.concat("above", F.lit(SEPARATOR), "path")).drop("above")
        after = moved.drop("next", "further").unionByName(here.where("target is null")).withColumn("stays", stays(k + 1))
        state = scratch.write(after, f"down{k + 1}", stays=F.count_if("stays"), open=F.count(F.col("target")))
        done.append(state.where("not stays").drop("stays"))
    rest = state.where("stays").drop("stays")
    if scratch.rows.get(f"down{rounds}.open"):
        rest = rest.select(*(c.split()[0] for c in _DOWN.split(", ")), *(["path"] if with_paths else []))
        rest = rest.groupBy().applyInArrow(_finish_down(rounds), _DOWN + (", path string" if with_paths else ""))
    state = reduce(DataFrame.unionByName, done, rest)
    last = F.col("pre") + F.col("size") - 1
    found = state.select(
        "id", "parent", "root", F.col("depth").cast("int").alias("depth"), "pre", last.alias("last"), (last - F.col("pre")).alias("n_below"), F.col("total").alias("total_bytes"),
        F.lit(False).alias("on_cycle"), *(["path"] if with_paths else []),
    )
    lost = scratch.write(up.where("target is not null").select("id", F.col("parent").alias("target")), "lost")
    if not scratch.rows["lost"]:
        return found
    minus, none = F.lit(-1).cast("bigint"), F.lit(None)
    rings = _cycle_roots(scratch, lost, scratch.rows["lost"]).join(lost, "id").select(
        "id", F.col("target").alias("parent"), F.col("cycle_id").alias("root"), F.lit(-1).alias("depth"), minus.alias("pre"), minus.alias("last"), minus.alias("n_below"),
        none.cast("bigint").alias("total_bytes"), F.lit(True).alias("on_cycle"), *([none.cast("string").alias("path")] if with_paths else []),
    )
    return found.unionByName(rings)


def descendants(trees: DataFrame, of: DataFrame) -> DataFrame:
    """(ancestor, id) for each id in ``of.id``, by nested-set ranges: its descendants.

    The ranges are cut into blocks of places, so that they meet by equality.
    """
    step = 4096
    block = F.floor(F.col("pre") / step)
    tops = trees.join(of.select("id").distinct(), "id", "left_semi").where("n_below > 0").select(F.col("id").alias("ancestor"), "root", F.col("pre").alias("lo"), F.col("last").alias("hi"))
    tops = tops.withColumn("block", F.explode(F.sequence(F.floor((F.col("lo") + 1) / step), F.floor(F.col("hi") / step))))
    inside = trees.where("not on_cycle").select("id", "root", "pre", block.alias("block"))
    return tops.join(inside, ["root", "block"]).where("pre > lo and pre <= hi").select("ancestor", "id")


def ancestors(trees: DataFrame, of: DataFrame) -> DataFrame:
    """(id, ancestor) for each id in ``of.id``: the nodes whose range holds its place."""
    step = 4096
    asked = trees.join(of.select("id").distinct(), "id", "left_semi").where("not on_cycle").select("id", "root", "pre", F.floor(F.col("pre") / step).alias("block"))
    over = trees.where("n_below > 0").select(F.col("id").alias("ancestor"), "root", F.col("pre").alias("lo"), F.col("last").alias("hi"))
    over = over.withColumn("block", F.explode(F.sequence(F.floor((F.col("lo") + 1) / step), F.floor(F.col("hi") / step))))
    return asked.join(over, ["root", "block"]).where("pre > lo and pre <= hi").select("id", "ancestor")
