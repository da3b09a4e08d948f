"""The most similar bit vectors of every vector, by pruned search graphs.

In each shard of vectors a directed graph is built: greedy searches propose
neighbours, robust pruning keeps the near ones that no kept neighbour is much
nearer to, and their edges are also laid back.  A beam search then takes
vectors through the graph.

``similar_vectors`` links all vectors within RADIUS bits.  Vectors meet in
shards that agree on t of 12 + t blocks of their bits: two that differ in at
most 12 bits agree on t whole blocks somewhere, so no link falls between
shards.  With t = 1 a vector is in 13 shards; t grows with the number of
vectors, so that shards stay small and copies do not grow with it (91 for up to
8 * 10^9).  A beam that comes back full of links is no proof that there are
no more, so those vectors are compared, many at once, with their whole shard.

``nearest_of`` finds the k nearest of a stated set of queries, however far they
are: the graphs of hashed shards are built once over all vectors and every
query is searched in each.

Every reported distance is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.runtime import Scratch, maybe_broadcast

#: Bits of a vector, and the most in which linked vectors differ.
BITS = 128
RADIUS = 12
#: Out-edges of a node, width of the beam when building and when asking.
DEGREE = 10
BUILD_BEAM = 8
BEAM = 14
#: An edge is pruned if a kept neighbour is nearer to its end by this factor.
ALPHA = 1.2
#: Vectors of a shard; more that agree on a block are cut into several, each of
#: which all of them ask.
SHARD_ROWS = 32_768
#: Vectors handled together in a task, of one or many shards.
TASK_ROWS = 40_000
#: Distances worked out at once where vectors are compared with a whole shard.
COMPARED = 2_000_000
#: Queries taken at a time, out-edges and beam of the graphs that they search.
QUERIES = 50_000
WIDE_DEGREE, WIDE_BEAM = 32, 256

_FULL = np.int64(2**62)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which vectors differ; the last axis holds their two halves."""
    return np.bitwise_count(a[..., 0] ^ b[..., 0]).astype(np.int64) + np.bitwise_count(a[..., 1] ^ b[..., 1])


def _merge(beam: np.ndarray, more: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` best of both, each node once.

    An entry is distance, node and, in the lowest bit, whether it still has to
    be expanded; of a node's entries the expanded one sorts first and stays.
    """
    every = np.sort(np.concatenate([beam, more], axis=1), axis=1)
    twice = (every[:, 1:] >> 1) == (every[:, :-1] >> 1)
    if twice.any():
        every[:, 1:][twice] = _FULL
        every.sort(axis=1)
    return every[:, :width]


def _entries(vectors: np.ndarray, asked: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Beam entries of ``nodes`` (-1: none) for the asked vectors."""
    far = distance(vectors[nodes], asked[:, None, :])
    return np.where(nodes >= 0, far << 33 | nodes << 1 | 1, _FULL)


def search(vectors: np.ndarray, graph: np.ndarray, asked: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """Beams [rows, width] of a greedy search from ``start`` for each asked vector."""
    beams = _merge(np.full((len(asked), width), _FULL), _entries(vectors, asked, start), width)
    active = np.arange(len(asked))
    for _ in range(4 * width):
        beam = beams[active]
        todo = (beam & 1 == 1) & (beam < _FULL)
        going = todo.any(axis=1)
        if not going.any():
            break
        active, beam, todo = active[going], beam[going], todo[going]
        rows = np.arange(len(active))
        at = todo.argmax(axis=1)
        node = beam[rows, at] >> 1 & (2**32 - 1)
        beam[rows, at] &= ~np.int64(1)
        beams[active] = _merge(beam, _entries(vectors, asked[active], graph[node]), width)
    return beams


def prune(vectors: np.ndarray, own: np.ndarray, nodes: np.ndarray, far: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """Out-edges [rows, degree] from candidates, nearest first (-1: none).

    Robust pruning: the nearest candidate stays, those that it is nearer to by
    ALPHA than the node itself go, and so on.
    """
    alive = (nodes >= 0) & (nodes != own[:, None])
    out = np.full((len(own), degree), -1, dtype=np.int64)
    rows = np.arange(len(own))
    for k in range(degree):
        any_left = alive.any(axis=1)
        if not any_left.any():
            break
        at = alive.argmax(axis=1)
        kept = np.where(any_left, nodes[rows, at], -1)
        out[:, k] = kept
        between = distance(vectors[kept][:, None, :], vectors[nodes])
        alive &= (between * ALPHA > far) & any_left[:, None]
        alive[rows, at] = False
    return out


def _unpacked(beams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    full = beams >= _FULL
    return np.where(full, -1, beams >> 1 & (2**32 - 1)), np.where(full, 10**6, beams >> 33)


def build(vectors: np.ndarray, first: np.ndarray, count: np.ndarray, rng: np.random.Generator, degree: int = DEGREE, beam: int = BUILD_BEAM) -> np.ndarray:
    """Graph [rows, degree] over vectors that lie sorted by shard: ``first`` and
    ``count`` of each vector's shard."""
    n = len(vectors)
    own = np.arange(n)
    # To begin with, the next ones in order of bits and some at random.
    near = own[:, None] + np.array([-3, -2, -1, 1, 2, 3])
    near = np.where((near >= first[:, None]) & (near < (first + count)[:, None]), near, -1)
    far = first[:, None] + (rng.random((n, degree - 6)) * count[:, None]).astype(np.int64)
    graph = np.concatenate([near, np.where(far == own[:, None], -1, far)], axis=1)
    nodes, dist = _unpacked(search(vectors, graph, vectors, graph, beam + 1))
    graph = prune(vectors, own, nodes, dist, degree)
    # Edges are laid back: of each node's incoming edges the nearest ones compete with its own.
    ends = graph.ravel()
    sources = np.repeat(own, degree)[ends >= 0]
    ends = ends[ends >= 0]
    length = distance(vectors[sources], vectors[ends])
    order = np.lexsort((length, ends))
    sources, ends = sources[order], ends[order]
    starts = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]]) if len(ends) else np.zeros(0, dtype=np.int64)
    rank = np.arange(len(ends)) - np.repeat(starts, np.diff(np.r_[starts, len(ends)]))
    back = np.full((n, degree), -1, dtype=np.int64)
    few = rank < degree
    back[ends[few], rank[few]] = sources[few]
    beams = _merge(_entries(vectors, vectors, graph), _entries(vectors, vectors, back), 2 * degree)
    nodes, dist = _unpacked(beams)
    return prune(vectors, own, nodes, dist, degree)


def shard_links(shard: np.ndarray, vectors: np.ndarray, member: np.ndarray, radius: int = RADIUS, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, row, distance) of vectors of one shard within ``radius``.

    Rows come sorted by shard.  Those that are no members ask, but are not asked.
    """
    rng = np.random.default_rng(seed)
    place = np.flatnonzero(member)
    inside, code = vectors[place], shard[place]
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.r_[starts, len(code)])
    graph = build(inside, np.repeat(starts, sizes), np.repeat(sizes, sizes), rng)
    # Members start at themselves, visitors anywhere in the shard; every shard has members.
    begin = np.searchsorted(code[starts], shard)
    begin = np.minimum(begin, max(0, len(starts) - 1))
    some = starts[begin][:, None] + (rng.random((len(shard), 4)) * sizes[begin][:, None]).astype(np.int64)
    own = np.full(len(shard), -1, dtype=np.int64)
    own[place] = np.arange(len(place))
    start = np.concatenate([np.where(member, own, some[:, 0])[:, None], some], axis=1)
    start[code[starts][begin] != shard] = -1
    nodes, dist = _unpacked(search(inside, graph, vectors, start, BEAM))
    near = (dist <= radius) & (nodes >= 0) & (nodes != own[:, None])
    row, at = np.nonzero(near)
    a, b, d = [row], [nodes[row, at]], [dist[row, at]]
    # A full beam may have left some out: those are compared with their shard, many at once.
    full = np.flatnonzero((dist <= radius).all(axis=1))
    at = 0
    while at < len(full):
        low, size = starts[begin[full[at]]], sizes[begin[full[at]]]
        same = int(np.searchsorted(begin[full], begin[full[at]], "right"))
        some = full[at : min(same, at + max(1, COMPARED // size))]
        every = distance(inside[None, low : low + size], vectors[some][:, None])
        i, j = np.nonzero(every <= radius)
        other = low + j
        keep = other != own[some[i]]
        a.append(some[i][keep])
        b.append(other[keep])
        d.append(every[i, j][keep])
        at += len(some)
    return np.concatenate(a), place[np.concatenate(b)], np.concatenate(d)


def _edges(agree: int) -> np.ndarray:
    """First bits of the blocks, of which ``agree`` must be alike."""
    return np.linspace(0, BITS, RADIUS + agree + 1).astype(int)


def blocks_that_agree(vectors: int) -> int:
    """Blocks on which the vectors of a shard agree, so that shards of evenly spread
    vectors stay below SHARD_ROWS.  Each further one multiplies the copies by
    some 6 and the shards by some 500."""
    agree = 1
    while vectors >> int(BITS / (RADIUS + agree) * agree) > SHARD_ROWS and agree < 4:
        agree += 1
    return agree


def _bits(vectors: np.ndarray) -> np.ndarray:
    return np.unpackbits(vectors.astype(">u8").view(np.uint8).reshape(-1, BITS // 8), axis=1)


def _halves(hi: pa.ChunkedArray, lo: pa.ChunkedArray) -> np.ndarray:
    return np.stack([hi.to_numpy(), lo.to_numpy()], axis=1).view(np.uint64)


def _assign(agree: int):
    """Each vector once for every choice of blocks: (shard, id, hi, lo)."""
    edges = _edges(agree)
    places = np.arange(BITS)
    chosen = [np.concatenate([places[edges[k] : edges[k + 1]] for k in some]) for some in combinations(range(RADIUS + agree), agree)]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = np.frombuffer(b"".join(batch.column("vector").to_pylist()), dtype=">u8").astype(np.uint64).reshape(-1, 2)
            bits = _bits(vectors).astype(np.int64)
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            halves = vectors.view(np.int64)
            for k, some in enumerate(chosen):
                shard = k << 50 | bits[:, some] @ (1 << np.arange(len(some))[::-1])
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(ids), pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=["shard", "id", "hi", "lo"])

    return assign


def _link(agree: int):
    """Links of the shards of one task."""
    edges = _edges(agree)
    after = np.array([edges[some[0] + 1] % BITS for some in combinations(range(RADIUS + agree), agree)])

    def link(table: pa.Table) -> pa.Table:
        vectors = _halves(table["hi"], table["lo"])
        named, part = table["shard"].to_numpy(), table["part"].to_numpy()
        shard = np.unique(np.stack([named, part], axis=1), axis=0, return_inverse=True)[1].reshape(-1)
        # Within a shard vectors go by the bits that follow its first block.
        turn = after[named >> 50]
        rolled = np.where(turn < 64, vectors[:, 0], vectors[:, 1]) << (turn % 64).astype(np.uint64)
        ids = table["id"].to_numpy()
        order = np.lexsort((ids, rolled, shard))
        a, b, d = shard_links(shard[order], vectors[order], table["member"].to_numpy(zero_copy_only=False)[order].astype(bool))
        ids = ids[order]
        pairs = np.unique(np.stack([np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b]), d], axis=1), axis=0) if len(a) else np.zeros((0, 3), dtype=np.int64)
        pairs = pairs[pairs[:, 0] < pairs[:, 1]]
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1]), "distance": pa.array(pairs[:, 2].astype(np.int32))})

    return link


def _valid(rows: DataFrame) -> DataFrame:
    zero = F.unhex(F.lit("00" * (BITS // 8)))
    return rows.select(F.col("id").cast("bigint").alias("id"), "vector").where((F.octet_length("vector") == BITS // 8) & (F.col("vector") != zero) & F.col("id").isNotNull())


def similar_vectors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b, distance) between different vectors within RADIUS bits, and
    classes (id, class_id) of equal vectors.

    ``rows``: id BIGINT, vector BINARY of 16 bytes.  class_id is the smallest
    id with the same vector, and a < b are class ids.  A null, all-zero or
    otherwise long vector and a null id take no part; repeated rows count once;
    further columns are ignored; an empty table gives empty results.
    """
    scratch = Scratch(rows.sparkSession, "vectors")
    valid = scratch.write(_valid(rows).distinct(), "valid")
    heads = valid.groupBy("vector").agg(F.min("id").alias("id"))
    agree = blocks_that_agree(scratch.rows["valid"])
    assigned = scratch.write(heads.mapInArrow(_assign(agree), "shard bigint, id bigint, hi bigint, lo bigint"), "assigned")
    # Common bit patterns make shards that are too large: those are cut.
    large = assigned.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD_ROWS).select("shard", F.ceil(F.col("n") / SHARD_ROWS).cast("int").alias("parts"))
    # At most one shard in SHARD_ROWS assigned rows is.
    cut = assigned.join(maybe_broadcast(large, scratch.rows["assigned"] // SHARD_ROWS), "shard", "left").select("*", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    cut = cut.withColumn("member", F.col("part") == F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))))
    tasks = max(1, -(-scratch.rows["assigned"] // TASK_ROWS))
    links = (
        cut.select(F.pmod(F.xxhash64("shard", "part"), F.lit(tasks)).alias("task"), "shard", "part", "id", "hi", "lo", "member")
        .groupBy("task")
        .applyInArrow(_link(agree), "a bigint, b bigint, distance int")
    )
    links = scratch.write(links.distinct(), "links")
    return links, valid.join(heads.withColumnRenamed("id", "class_id"), "vector").select("id", "class_id")


def _index(table: pa.Table) -> pa.Table:
    """The graph of one shard, in one row of blobs."""
    ids = table["id"].to_numpy()
    vectors = np.frombuffer(b"".join(table["vector"].to_pylist()), dtype=">u8").astype(np.uint64).reshape(-1, 2)
    order = np.lexsort((ids, vectors[:, 1], vectors[:, 0]))
    ids, vectors = ids[order], vectors[order]
    n = len(ids)
    graph = build(vectors, np.zeros(n, np.int64), np.full(n, n), np.random.default_rng(7), WIDE_DEGREE, WIDE_DEGREE)
    blob = lambda x: pa.array([x.tobytes()], pa.binary())
    return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int64()), "ids": blob(ids.astype("<i8")), "vectors": blob(vectors.astype("<u8")), "graph": blob(graph.astype("<i4"))})


def _search_shards(queries, k: int):
    """The ``k`` best of each shard for all of a block of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked = queries.value
        for batch in batches:
            for r in batch.to_pylist():
                ids, vectors = np.frombuffer(r["ids"], dtype="<i8"), np.frombuffer(r["vectors"], dtype="<u8").reshape(-1, 2)
                graph = np.frombuffer(r["graph"], dtype="<i4").reshape(len(ids), -1).astype(np.int64)
                rng = np.random.default_rng(len(ids))
                for at in range(0, len(names), 2_000):
                    some = asked[at : at + 2_000]
                    start = (rng.random((len(some), 16)) * len(ids)).astype(np.int64)
                    nodes, dist = _unpacked(search(vectors, graph, some, start, WIDE_BEAM))
                    nodes, dist = nodes[:, : k + 1], dist[:, : k + 1]  # one may be the query itself
                    row, place = np.nonzero(nodes >= 0)
                    yield pa.RecordBatch.from_arrays([pa.array(names[at : at + 2_000][row]), pa.array(ids[nodes[row, place]]), pa.array(dist[row, place].astype(np.int32))], names=["query_id", "id", "distance"])

    return run


def nearest_of(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank_no, id, distance): the ``k`` different vectors nearest to each
    query, whatever their distance, that beam searches find; ties by id.

    ``rows`` and ``queries``: id BIGINT, vector BINARY of 16 bytes.  Every row is
    indexed, equal vectors once by their smallest id; a query's own vector is
    left out.  Null, all-zero and otherwise long vectors and null ids take no
    part; repeated rows count once; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "nearest")
    heads = scratch.write(_valid(rows).groupBy("vector").agg(F.min("id").alias("id")), "heads")
    shards = max(1, -(-scratch.rows["heads"] // SHARD_ROWS))
    placed = heads.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)))
    index = scratch.write(placed.groupBy("shard").applyInArrow(_index, "shard bigint, ids binary, vectors binary, graph binary"), "index")
    # A query stands for all that have its vector.
    asked = scratch.write(_valid(queries).distinct().join(heads.withColumnRenamed("id", "_own"), "vector", "left"), "asked")
    blocks = max(1, -(-scratch.rows["asked"] // QUERIES))
    found = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).select("id", "vector").toPandas()  # a block of the stated queries
        if not len(part):
            continue
        vectors = np.frombuffer(b"".join(map(bytes, part["vector"])), dtype=">u8").astype(np.uint64).reshape(-1, 2)
        shared = spark.sparkContext.broadcast((part["id"].to_numpy(dtype=np.int64), vectors))
        one = index.mapInArrow(_search_shards(shared, k), "query_id bigint, id bigint, distance int")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "query_id bigint, rank_no int, id bigint, distance int")
    own = asked.select(F.col("id").alias("query_id"), "_own")
    others = found.join(maybe_broadcast(own, scratch.rows["asked"]), "query_id").where(~F.col("id").eqNullSafe(F.col("_own")))
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    ranked = others.distinct().withColumn("rank_no", F.row_number().over(order)).where(F.col("rank_no") <= k)
    return ranked.select("query_id", "rank_no", "id", "distance")


def _distances_of(queries, k: int):
    """The ``k`` least distances, by brute force, of each query to a batch of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked = queries.value
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = np.frombuffer(b"".join(batch.column("vector").to_pylist()), dtype=">u8").astype(np.uint64).reshape(-1, 2)
            for at in range(0, len(names), step := max(1, COMPARED // len(vectors))):
                far = distance(vectors[None], asked[at : at + step, None])
                far[far == 0] = BITS + 1  # the query's own vector
                least = np.sort(np.partition(far, min(k, far.shape[1]) - 1, axis=1)[:, :k], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names[at : at + step], least.shape[1])), pa.array(least.ravel().astype(np.int32))], names=["query_id", "distance"])

    return run


def recall(rows: DataFrame, queries: DataFrame, found: DataFrame, k: int = 10) -> DataFrame:
    """(queries, recall) of what ``nearest_of`` found: the share of the ``k`` nearest
    that are as near as those of brute force.  Queries go in blocks against all rows."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "recall")
    heads = scratch.write(_valid(rows).groupBy("vector").agg(F.min("id").alias("id")), "heads")
    asked = scratch.write(_valid(queries).distinct(), "asked")
    blocks = max(1, -(-scratch.rows["asked"] // QUERIES))
    truth = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toPandas()  # a block of the stated queries
        if not len(part):
            continue
        vectors = np.frombuffer(b"".join(map(bytes, part["vector"])), dtype=">u8").astype(np.uint64).reshape(-1, 2)
        shared = spark.sparkContext.broadcast((part["id"].to_numpy(dtype=np.int64), vectors))
        one = heads.select("vector").mapInArrow(_distances_of(shared, k), "query_id bigint, distance int")
        truth = one if truth is None else truth.unionByName(one)
    if truth is None:
        return spark.createDataFrame([(0, None)], "queries bigint, recall double")
    order = Window.partitionBy("query_id").orderBy("distance")
    kth = truth.where(F.col("distance") <= BITS).withColumn("rank_no", F.row_number().over(order)).where(F.col("rank_no") <= k).groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"), F.max("distance").alias("kth"))
    near = kth.join(found, "query_id", "left").groupBy("query_id", "wanted").agg(F.count_if(F.col("distance") <= F.col("kth")).alias("hits"))
    return near.agg(F.count(F.lit(1)).alias("queries"), (F.sum(F.least("hits", "wanted")) / F.sum("wanted")).alias("recall"))


def most_similar(links: DataFrame, k: int = 10) -> DataFrame:
    """(id, rank_no, other_id, distance): the ``k`` nearest linked classes of each."""
    both = links.select(F.col("a").alias("id"), F.col("b").alias("other_id"), "distance").unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("other_id"), "distance"))
    order = Window.partitionBy("id").orderBy("distance", "other_id")
    return both.withColumn("rank_no", F.row_number().over(order)).where(F.col("rank_no") <= k).select("id", "rank_no", "other_id", "distance")


def expanded_pairs(links: DataFrame, classes: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: links between all members, and pairs of equal ones.

    For data in which no class is large; else use links and classes as they are.
    """
    one = classes.select(F.col("class_id").alias("a"), F.col("id").alias("x"))
    other = classes.select(F.col("class_id").alias("b"), F.col("id").alias("y"))
    across = links.join(one, "a").join(other, "b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    # Only classes of several members are joined with themselves.
    several = classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("class_id").alias("a"))
    multiple = one.join(several, "a")
    within = multiple.join(multiple.select("a", F.col("x").alias("y")), "a").where("x < y").select(F.col("x").alias("id_a"), F.col("y").alias("id_b"))
    return across.unionByName(within).distinct()
