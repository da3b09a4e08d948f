"""File features, similarity, clusters and classifiers."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import paths
from siltstone.functions.fuzzy import tlsh_score
from siltstone.functions.vectors import label_of
from siltstone.runtime import BROADCAST_ROWS, HOT_ROWS, Scratch, hot_limit, lookup_join

_YEAR = 365 * 86_400


def file_features(files: DataFrame) -> DataFrame:
    """(volume_id, file_id, full_path, size, type, modified_s, features) with 8 features:
    MB, size and time mixed, 0, years of creation and last write, length of the type, 0, 0."""
    kind = F.regexp_extract("full_path", r"\.([^.]*)$", 1)
    kind = F.when(kind == "", "unknown").otherwise(kind)
    made, wrote = F.unix_seconds("created"), F.unix_seconds("modified")
    zero = F.lit(0.0)
    features = F.array(F.col("size_logical") / (1 << 20), F.col("size_logical").bitwiseXOR(wrote) / 1e6, zero, made / _YEAR, wrote / _YEAR, F.length(kind).cast("double"), zero, zero)
    return files.select("volume_id", "file_id", "full_path", F.col("size_logical").alias("size"), kind.alias("type"), wrote.alias("modified_s"), features.alias("features"))


def metadata_features(rows: DataFrame) -> DataFrame:
    """``rows`` with ``features``: scaled size, times, mode bits, flags and owner."""
    fifty = 50 * _YEAR
    times = [F.unix_seconds(c) / fifty for c in ("created", "modified", "accessed")]
    features = F.array(F.log(F.col("size_logical") + 1) / 20, *times, F.col("mode").bitwiseAND(0o777) / 0x1FF, F.col("mode").bitwiseAND(0o170000).eqNullSafe(0o040000).cast("double"), paths.base_name(F.col("full_path")).startswith(".").cast("double"))
    return rows.withColumn("features", F.transform(features, lambda x: F.coalesce(x, F.lit(0.0))))


def training_rows(files: DataFrame) -> DataFrame:
    return metadata_features(files).withColumn("label", label_of(paths.suffix(F.col("full_path"))))


def _likeness(a: np.ndarray, b: np.ndarray, more: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """1 less the relative difference of all of ``a`` to all of ``b``, and where both are positive."""
    a, b = a[:, None].astype(np.float64), b[None, :].astype(np.float64)
    with np.errstate(invalid="ignore", divide="ignore"):
        return 1 - np.abs(a - b) / (np.abs(a) + np.abs(b) + more), (a > 0) & (b > 0)


def _unit(column: pd.Series) -> np.ndarray:
    x = np.stack(column.map(np.asarray)).astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def similarities(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    """Likeness [len(a), len(b)] of rows of ``file_features``: the mean of those of
    size, type, last write and features that both sides allow; 1 for one path."""
    total, known = (a["type"].to_numpy()[:, None] == b["type"].to_numpy()[None, :]) * 0.9 + 0.1, 1
    for value, ok in (_likeness(a["size"].to_numpy(), b["size"].to_numpy()), _likeness(a["modified_s"].fillna(0).to_numpy(), b["modified_s"].fillna(0).to_numpy(), 1.0)):
        total, known = total + np.where(ok, value, 0), known + ok
    mean = (total + _unit(a["features"]) @ _unit(b["features"]).T) / (known + 1)
    return np.where(a["full_path"].to_numpy()[:, None] == b["full_path"].to_numpy()[None, :], 1.0, mean)


def _in_blocks(rows: DataFrame, asked: DataFrame, spread: list[str], search) -> DataFrame:
    """The union of ``search(rows, block)`` for blocks, by hash of the columns
    ``spread``, of at most about BROADCAST_ROWS // 10 rows of ``asked``."""
    most = BROADCAST_ROWS // 10
    block = asked.limit(most + 1).toPandas()
    if len(block) <= most:
        return search(rows, block)
    scratch = Scratch(asked.sparkSession, "blocks")
    rows, asked = scratch.write(rows, "rows"), scratch.write(asked, "asked")
    blocks = -(-scratch.rows["asked"] * 2 // most)  # half full, as hashes spread unevenly
    out = None
    for k in range(blocks):
        found = search(rows, asked.where(F.pmod(F.xxhash64(*spread), F.lit(blocks)) == k).toPandas())
        out = found if out is None else out.unionByName(found)
    return out


#: What the similarity of two files may be made of.
PARTS = ("size", "type", "time", "features", "digest")


def similar_files(features: DataFrame, targets: DataFrame, threshold: float, use: tuple[str, ...] = PARTS[:4]) -> DataFrame:
    """(target_id, file_id, similarity) of a stated set of targets.

    ``use`` names the likenesses whose mean counts; ``digest`` compares the
    locality digests of that column.  A mean that reaches the threshold leaves
    none of them far below it: up from some threshold files must be of one
    type, and their sizes must lie in the same or the next band.  Only such
    files meet; files without a size meet all of their type, and files of one
    path meet whatever else they are.  Below that, targets go in blocks through
    every task.
    """
    if not use or set(use) - set(PARTS):
        raise ValueError(f"use {use}")
    columns = ["file_id", "full_path", "size", "type", "modified_s", "features", *(["digest"] if "digest" in use else [])]
    n = len(use)
    a, b = features.select(*columns), targets.select(*(F.col(c).alias(f"t_{c}") for c in columns))
    one_type = F.col("type") == F.col("t_type")
    least = 1 - n * (1 - threshold)  # of one likeness, if the others are 1
    if "type" not in use or threshold <= (n - 0.9) / n:
        if use == PARTS[:4]:
            search = lambda rows, asked: _similar(rows, asked, threshold)
            return _in_blocks(a, targets.select(*columns), ["file_id", "full_path", "size", "modified_s"], search)
        scratch = Scratch(features.sparkSession, "similar")
        a, b = scratch.write(a, "rows"), scratch.write(b, "asked")
        blocks = max(1, -(-scratch.rows["asked"] * 10 // BROADCAST_ROWS))
        parts = [a.join(F.broadcast(b.where(F.pmod(F.xxhash64("t_file_id", "t_full_path"), F.lit(blocks)) == k)), F.lit(True)) for k in range(blocks)]  # a stated set, in blocks
        met = reduce(DataFrame.unionByName, parts)
    elif "size" not in use or least <= 0:
        met = a.join(b, one_type)
    else:
        width = math.log((2 - least) / least) * (1 + 1e-9)
        band = lambda c: F.when(F.col(c) > 0, F.floor(F.log(F.col(c).cast("double")) / width)).otherwise(-1)
        a, b = a.withColumn("band", band("size")), b.withColumn("t_band", band("t_size"))
        around = b.where("t_band >= 0").withColumn("band", F.explode(F.array(F.col("t_band") - 1, F.col("t_band"), F.col("t_band") + 1))).where("band >= 0")
        met = a.where("band >= 0").join(around, one_type & (a["band"] == around["band"])).drop("band", "t_band")
        met = met.unionByName(a.where("band < 0").join(b, one_type).drop("band", "t_band")).unionByName(a.where("band >= 0").join(b.where("t_band < 0"), one_type).drop("band", "t_band"))
        a, b = a.drop("band"), b.drop("t_band")
    one_path = a.join(b, F.col("full_path") == F.col("t_full_path")).select("t_file_id", "file_id", F.lit(1.0).alias("similarity"))
    found = met.where(~F.col("full_path").eqNullSafe(F.col("t_full_path"))).select("t_file_id", "file_id", _similarity(use).alias("similarity")).where(F.col("similarity") >= threshold)
    return found.unionByName(one_path).select(F.col("t_file_id").alias("target_id"), "file_id", "similarity")


def _similarity(use: tuple[str, ...]) -> Column:
    """Mean of the likenesses of the two files of a row that both sides allow."""

    def like(x: str, more: float = 0.0) -> Column:
        one, other = F.coalesce(F.col(x), F.lit(0)).cast("double"), F.coalesce(F.col(f"t_{x}"), F.lit(0)).cast("double")
        return F.when((one > 0) & (other > 0), 1 - F.abs(one - other) / (one + other + more))

    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    f, g = F.col("features"), F.col("t_features")
    length = F.greatest(F.sqrt(dot(f, f)), F.lit(1e-300)) * F.greatest(F.sqrt(dot(g, g)), F.lit(1e-300))
    every = {
        "size": lambda: like("size"), "time": lambda: like("modified_s", 1.0), "type": lambda: F.when(F.col("type") == F.col("t_type"), 1.0).otherwise(0.1),
        "features": lambda: dot(f, g) / length, "digest": lambda: tlsh_score(F.col("digest"), F.col("t_digest")) / 100,
    }
    parts = [every[name]() for name in use]
    known = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
    return F.coalesce(sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)) / F.nullif(known, F.lit(0)), F.lit(0.0))


def _similar(rows: DataFrame, asked: pd.DataFrame, threshold: float) -> DataFrame:
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(asked) if len(batch) else 0, 256):
                some = asked.iloc[at : at + 256]
                found = similarities(some, batch)
                i, j = np.nonzero(found >= threshold)
                yield pd.DataFrame({"target_id": some["file_id"].to_numpy()[i], "file_id": batch["file_id"].to_numpy()[j], "similarity": found[i, j]})

    return rows.mapInPandas(compare, "target_id long, file_id long, similarity double")


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int, ident: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, id, score): the k highest cosines of each of a stated set of
    queries, itself left out, ties by id.  Queries are taken in blocks; every task
    scores its rows against a block by one matrix product and keeps its k best."""
    search = lambda rows, asked: _nearest(rows, asked, k, ident, column)
    part = _in_blocks(vectors.select(ident, column), queries.select(ident, column), [ident], search)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return part.withColumn("rank_no", F.row_number().over(order)).where(F.col("rank_no") <= k)


def _nearest(rows: DataFrame, asked: pd.DataFrame, k: int, ident: str, column: str) -> DataFrame:
    names = asked[ident].to_numpy()
    q = np.stack(asked[column].map(np.asarray)).astype(np.float64) if len(asked) else np.zeros((0, 1))
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-30)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch) or not len(q):
                continue
            x = np.stack(batch[column].map(np.asarray)).astype(np.float64)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
            s = np.round(q @ x.T, 9)
            ids = batch[ident].to_numpy()
            s[names[:, None] == ids[None, :]] = -2
            order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
            which = np.repeat(np.arange(len(q)), order.shape[1])
            at = order.ravel()
            keep = s[which, at] > -2
            yield pd.DataFrame({"query_id": names[which][keep], "id": ids[at][keep], "score": s[which, at][keep]})

    return rows.mapInPandas(score, "query_id long, id long, score double")


def kmeans(rows: DataFrame, k: int, column: str = "features", seed: int = 42, iterations: int = 100) -> DataFrame:
    """``rows`` with ``cluster``."""
    data = rows.withColumn("_v", array_to_vector(F.transform(column, lambda x: x.cast("double"))))
    model = KMeans(k=k, seed=seed, maxIter=iterations, tol=0.1, featuresCol="_v", predictionCol="cluster").fit(data)
    return model.transform(data).drop("_v")


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of undirected edges (a, b): component is the smallest id.

    Large-star and small-star steps in turn: every node's neighbours move to
    its smallest one, until the edges are stars.  Rounds grow with the
    logarithm of the size; each is written to the shared folder.
    """
    scratch = Scratch(edges.sparkSession, "components")
    pairs = scratch.write(edges.select("a", "b").where("a <> b").distinct(), "edges0")
    nodes = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    before, k = None, 0
    while True:
        both = pairs.union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        rows = 2 * scratch.rows[f"edges{k}"]
        hubs = None
        if rows >= HOT_ROWS:  # hubs may have very many neighbours: no task gathers them
            least = scratch.write(least, f"least{k}", most=F.max("n"))
            if scratch.rows[f"least{k}.most"] >= hot_limit(rows):
                hubs = scratch.write(least.where(F.col("n") >= hot_limit(rows)).select("a"), f"hubs{k}")
        large = lookup_join(both, least.select("a", "m"), "a", hubs, "inner").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        # After the large step a node's smaller neighbours are few.
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(low, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        k += 1
        mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        pairs = scratch.write(small, f"edges{k}", mark=mark)
        now = (scratch.rows[f"edges{k}"], scratch.rows[f"edges{k}.mark"])
        if now == before:
            break
        before = now
        scratch.drop(f"edges{k - 1}")
    stars = pairs.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m"))
    return nodes.join(stars, "id", "left").select("id", F.coalesce("m", "id").alias("component"))


def dbscan(nodes: DataFrame, edges: DataFrame, least: int = 2) -> DataFrame:
    """(id, cluster, is_core) over a neighbour graph: nodes with ``least`` neighbours
    are core, linked cores form a cluster named by its smallest id, others join
    the smallest cluster next to them, the rest is noise: -1."""
    both = edges.select("a", "b").where("a <> b").union(edges.select("b", "a").where("a <> b")).distinct()
    core = both.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("id")
    inner = both.join(core.withColumnRenamed("id", "a"), "a", "left_semi").join(core.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b")
    parts = core.join(connected_components(inner), "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))
    border = both.join(core.withColumnRenamed("id", "a"), "a", "left_anti").join(parts.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("cluster").alias("cluster"))
    known = parts.withColumn("is_core", F.lit(True)).union(border.withColumn("is_core", F.lit(False)))
    return nodes.select("id").distinct().join(known, "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("is_core", F.lit(False)).alias("is_core"))


def single_linkage(nodes: DataFrame, edges: DataFrame, distance: str, most: float) -> DataFrame:
    """(id, component): single linkage cut at a distance, which is what components
    of the edges within it are."""
    within = edges.where(F.col(distance) <= most)
    parts = connected_components(within)
    return nodes.select("id").distinct().join(parts, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def link_to_k(nodes: DataFrame, edges: DataFrame, distance: str, k: int) -> DataFrame:
    """(id, component): single linkage merged until ``k`` groups are left, or as few
    as the edges allow.

    Merging by ascending distance is what a minimum spanning forest does: the
    groups are the components of its edges without the ``k`` - 1 longest, ties
    by the ends.  The forest comes by rounds in which every component takes its
    shortest edge; rounds grow with the logarithm of the nodes.  Repeated edges
    count once.
    """
    scratch = Scratch(nodes.sparkSession, "linkage")
    live = scratch.write(nodes.select("id").dropna().distinct(), "nodes")
    ends = edges.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(distance).alias("d"))
    left = scratch.write(ends.select("a", "b", "d", F.col("a").alias("p"), F.col("b").alias("q")), "edges0")
    forest, r = None, 0
    while scratch.rows[f"edges{r}"]:
        both = left.select("p", "d", "a", "b").unionByName(left.select(F.col("q").alias("p"), "d", "a", "b"))
        best = both.groupBy("p").agg(F.min(F.struct("d", "a", "b")).alias("e")).select("e.*").distinct()
        r += 1
        taken = scratch.write(best, f"taken{r}")
        forest = taken if forest is None else forest.unionByName(taken)
        parts = scratch.write(connected_components(forest), f"parts{r}")
        now = left.select("a", "b", "d").join(parts.select(F.col("id").alias("a"), F.col("component").alias("p")), "a", "left").join(parts.select(F.col("id").alias("b"), F.col("component").alias("q")), "b", "left")
        now = now.select("a", "b", "d", F.coalesce("p", "a").alias("p"), F.coalesce("q", "b").alias("q")).where("p <> q")
        left = scratch.write(now, f"edges{r}")
    if forest is None:
        return live.select("id", F.col("id").alias("component"))
    # Of n nodes n - k edges make k groups; fewer edges are all taken.
    longest = max(0, forest.count() - max(0, scratch.rows["nodes"] - k))
    cut = forest.orderBy(F.col("d").desc(), F.col("a").desc(), F.col("b").desc()).limit(longest)
    kept = forest.join(cut.select("a", "b"), ["a", "b"], "left_anti") if longest else forest
    return live.join(connected_components(kept.select("a", "b")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


#: Rows that one task takes through the leader rule at a time.
SLICE_ROWS = 20_000


def leaders(rows: DataFrame, block: str, ident: str, column: str, threshold: float) -> DataFrame:
    """(block, ident, leader): in order of ident each row joins the first leader
    whose cosine reaches the threshold, else leads itself.

    Order matters, so the rows of a block are taken in slices of SLICE_ROWS by
    ident: a slice is first compared, in parallel, with the leaders so far, and
    only what none of them takes goes through the rule in one task.  Rounds
    grow with the largest block; a task never holds more than a slice and a
    batch.  Rows with a null part are left out; repeated rows count once.
    """
    spark = rows.sparkSession
    kind = rows.schema[block].dataType.simpleString()
    scratch = Scratch(spark, "leaders")
    unit = F.transform(column, lambda v: v.cast("double"))
    live = rows.select(block, F.col(ident).cast("bigint").alias(ident), unit.alias("_v")).dropna().distinct()
    ranged = scratch.write(live, "live")
    if scratch.rows["live"] <= SLICE_ROWS:
        sliced, slices = ranged.withColumn("slice", F.lit(0)), 1
    else:
        # Slices by ranges of ident over all blocks: each holds about SLICE_ROWS rows.
        parts = -(-scratch.rows["live"] // SLICE_ROWS)
        cuts = ranged.select(F.percentile_approx(ident, [k / parts for k in range(1, parts)], 10_000)).first()[0]
        sliced, slices = ranged.withColumn("slice", sum(((F.col(ident) > c).cast("int") for c in sorted(set(cuts))), F.lit(0))), len(set(cuts)) + 1
        sliced = scratch.write(sliced, "sliced", by="slice")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ident)
        x = np.stack(pdf["_v"].map(np.asarray)).astype(np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
        ids, chosen, heads = pdf[ident].to_numpy(), [], []
        for i in range(len(x)):
            scores = x[heads] @ x[i] if heads else np.zeros(0)
            fits = np.flatnonzero(scores >= threshold)
            if not len(fits):
                heads.append(i)
            chosen.append(ids[heads[int(fits[0])] if len(fits) else i])
        return pd.DataFrame({block: pdf[block], ident: ids, "leader": chosen})

    out, heads = None, None
    for k in range(slices):
        part = sliced.where(F.col("slice") == k).select(block, ident, "_v") if slices > 1 else sliced.select(block, ident, "_v")
        if heads is not None:
            norm = lambda c: F.greatest(F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v)), F.lit(1e-30))
            dot = F.aggregate(F.zip_with("_v", "_h", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
            told = heads.select(block, F.col(ident).alias("leader"), F.col("_v").alias("_h"))
            taken = part.join(told, block).where(dot / norm(F.col("_v")) / norm(F.col("_h")) >= threshold).groupBy(block, ident).agg(F.min("leader").alias("leader"))
            taken = scratch.write(taken, f"taken{k}")
            part = part.join(taken.select(block, ident), [block, ident], "left_anti")
            out = taken.select(block, ident, "leader") if out is None else out.unionByName(taken.select(block, ident, "leader"))
        new = scratch.write(part.groupBy(block).applyInPandas(run, f"{block} {kind}, {ident} long, leader long"), f"new{k}")
        out = new if out is None else out.unionByName(new)
        if k + 1 < slices:
            fresh = part.join(new.where(F.col(ident) == F.col("leader")).select(block, ident), [block, ident], "left_semi")
            heads = scratch.write(fresh if heads is None else heads.unionByName(fresh), f"heads{k}")
    return out


def cluster_cohesion(rows: DataFrame, cluster: str, column: str) -> DataFrame:
    """(cluster, n, cohesion): mean cosine over all pairs of a cluster, 1 below two.

    The sum over pairs follows from the length of the sum of unit vectors, so
    no pair is formed.
    """
    length = F.sqrt(F.aggregate(column, F.lit(0.0), lambda s, v: s + v.cast("double") * v))
    unit = rows.select(cluster, F.posexplode(F.transform(column, lambda v: v.cast("double") / F.when(length > 0, length).otherwise(1.0))).alias("axis", "v"))
    squares = unit.groupBy(cluster, "axis").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q")).groupBy(cluster).agg(F.sum(F.col("s") * F.col("s")).alias("whole"), F.sum("q").alias("own"))
    n = rows.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    return n.join(squares, cluster).select(cluster, "n", F.when(F.col("n") < 2, 1.0).otherwise((F.col("whole") - F.col("own")) / (F.col("n") * (F.col("n") - 1))).alias("cohesion"))


def _estimator(kind: str, features: int, classes: int, seed: int):
    common = {"featuresCol": "_v", "labelCol": "label"}
    return {
        "logistic": lambda: LogisticRegression(maxIter=20, **common),
        "tree": lambda: DecisionTreeClassifier(seed=seed, **common),
        "forest": lambda: RandomForestClassifier(numTrees=20, seed=seed, **common),
        "svm": lambda: LinearSVC(maxIter=20, **common),
        "perceptron": lambda: MultilayerPerceptronClassifier(layers=[features, 16, classes], maxIter=30, seed=seed, **common),
    }[kind]()


def train(rows: DataFrame, kind: str = "logistic", column: str = "features", seed: int = 42):
    """A fitted model of (features, label); save it with ``model.write()``.  ``svm``
    tells two labels apart, the others any number."""
    data = rows.select(array_to_vector(F.transform(column, lambda x: x.cast("double"))).alias("_v"), F.col("label").cast("double").alias("label"))
    shape = data.select(F.max("label")).first()[0]
    width = len(data.first()["_v"])
    model = _estimator(kind, width, int(shape) + 1, seed).fit(data)
    # The training summary ties the model to the session, which can't always be
    # sent to executors; a model that was written and read has none.
    path = f"{Scratch(rows.sparkSession, 'model').root}/{kind}"
    model.write().save(path)
    return type(model).load(path)


def predict(model, rows: DataFrame, column: str = "features") -> DataFrame:
    return model.transform(rows.withColumn("_v", array_to_vector(F.transform(column, lambda x: x.cast("double"))))).drop("_v", "rawPrediction", "probability")


def accuracy(predicted: DataFrame) -> float:
    """Share of rows whose prediction is their label; 0 of none."""
    return predicted.agg(F.coalesce(F.avg((F.col("label") == F.col("prediction")).cast("double")), F.lit(0.0))).first()[0]


def cross_validate(rows: DataFrame, index: str, folds: int, kind: str = "logistic", column: str = "features") -> list[float]:
    """Accuracy on each fold, rows dealt by index modulo folds."""
    fold = F.pmod(F.col(index), F.lit(folds))
    return [accuracy(predict(train(rows.where(fold != i), kind, column), rows.where(fold == i), column)) for i in range(folds)]
