"""Statistics, catalog, clusters, layouts, feeds and sinks on small inputs."""

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import catalog as C
from siltstone.operators import cluster as K
from siltstone.operators import layout as Y
from siltstone.operators import stats as S
from siltstone.operators.store import CatalogStore
from siltstone.plans import catalog as P
from siltstone.runtime import lookup_join
from siltstone.sources import sinks
from siltstone.streaming import changes


def test_order_statistics_of_wide_numbers(spark, monkeypatch):
    monkeypatch.setattr(S, "SORTED_ROWS", 3)
    values = sorted([-(2**63), 2**63 - 1, 2**60, 2**60 + 1, 2**60 + 2, 2**53, 2**53 + 1, 0, 0, 1])
    places = {str(k): k / 10 for k in range(11)}
    got = S.order_statistics(spark.createDataFrame([(v,) for v in values], "v long"), "v", places)
    assert got == {str(k): values[min(k, 9)] for k in range(11)}
    floats = sorted([-1.7e308, 1.7e308, 0.5, 0.25, -0.25, 3.0, 3.0, 1e-300, 7.0, 8.0])
    got = S.order_statistics(spark.createDataFrame([(v,) for v in floats], "v double"), "v", places)
    assert got == {str(k): floats[min(k, 9)] for k in range(11)}


def test_order_statistics_of_many_rows(spark, monkeypatch):
    monkeypatch.setattr(S, "SORTED_ROWS", 50)
    monkeypatch.setattr(S, "PIECES", 16)
    rng = random.Random(1)
    values = [rng.choice([0, 5, rng.randrange(10**12)]) for _ in range(2000)]
    got = S.order_statistics(spark.createDataFrame([(v,) for v in values] + [(None,)], "v long"), "v", {"a": 0.0, "b": 0.5, "c": 0.95, "d": 1.0})
    ranked = sorted(values)
    assert got == {"a": ranked[0], "b": ranked[1000], "c": ranked[1900], "d": ranked[-1]}
    assert S.order_statistics(spark.createDataFrame([], "v long"), "v", {"a": 0.5}) == {"a": None}


def test_histograms_merge(spark):
    df = spark.createDataFrame([(-5.0,), (0.0,), (9.9,), (10.0,), (1e9,)], "v double")
    one = S.histogram(df, F.col("v"), 10.0, 4)
    assert {r.bucket: r.n for r in one.collect()} == {0: 3, 1: 1, 3: 1}
    assert {r.bucket: r.n for r in S.merge_histograms(one, one).collect()} == {0: 6, 1: 2, 3: 2}
    assert {r.percent: r.value for r in S.histogram_percentiles(one, 10.0, [50.0, 80.0, 99.0]).collect()} == {50.0: 0, 80.0: 10, 99.0: 30}


ENTRY = "volume_id long, file_id long, full_path string, size_logical long, seq long, deleted boolean"


def test_catalog_versions_and_tombstones(spark):
    entries = spark.createDataFrame([(1, 1, "/a", 1, 1, False), (1, 1, "/a2", 2, 2, False), (1, 2, "/b", 3, 1, False), (1, 2, "/b", 3, 2, True), (2, 1, "/c", 9, 1, False)], ENTRY)
    rows = {(r.volume_id, r.file_id, r.full_path) for r in C.current(entries, ["full_path"]).collect()}
    assert rows == {(1, 1, "/a2"), (2, 1, "/c")}
    gone = C.tombstones(spark.createDataFrame([(2, 1)], "volume_id long, file_id long"), F.lit(5), entries)
    assert C.current(C.upsert(entries, gone), []).count() == 1
    back = spark.createDataFrame([(2, 1, "/d", 9, 6, False)], ENTRY)
    assert C.by_path(C.upsert(C.upsert(entries, gone), back), "/d", []).count() == 1


def test_bloom_filter_never_loses_a_member(spark):
    keys = spark.range(500).select((F.col("id") * 7).alias("k"))
    bits, hashes = C.bloom_size(500, 0.01)
    assert bits % 64 == 0 and 1 <= hashes <= 20
    blocks = C.bloom_build(keys, ["k"], bits, hashes)
    maybe = {r.k for r in C.bloom_might_contain(spark.range(3500).withColumnRenamed("id", "k"), ["k"], blocks, bits, hashes).collect()}
    members = {i * 7 for i in range(500)}
    assert members <= maybe and len(maybe - members) < 150
    assert C.bloom_might_contain(spark.range(5).withColumnRenamed("id", "k"), ["k"], C.bloom_build(keys.limit(0), ["k"], bits, hashes), bits, hashes).count() == 0


@pytest.mark.parametrize(("name", "hidden", "suspicious"), [(".hidden", True, False), ("..file", True, True), ("file.bak", False, True), ("normal.txt", False, False), ("123.4", False, True), ("a" * 77, False, False), ("a" * 256, False, True), ("x~", False, True)])
def test_hidden_names(spark, name, hidden, suspicious):
    r = C.hidden_files(spark.createDataFrame([(f"/d/{name}", 0o100644)], "full_path string, mode int")).first()
    assert (r.is_hidden, r.has_suspicious_name) == (hidden, suspicious)


def test_residue_plan(spark):
    as_of = F.lit("2024-02-01").cast("timestamp")
    files = spark.createDataFrame([("/x/old.tmp", 5), ("/x/old.tmp", 5), ("/x/a.log", 7), ("/tmp/z", 1), ("/x/keep.txt", 9)], "full_path string, size_logical long").withColumn("accessed", F.lit("2024-01-01").cast("timestamp"))
    got = {(r.full_path, r.file_type, r.bytes) for r in C.residue_plan(files, as_of, 30).collect()}
    assert got == {("/x/old.tmp", "temp", 5), ("/x/a.log", "log", 7), ("/tmp/z", "cache", 1)}
    assert C.residue_plan(files, as_of, 40).count() == 0 and C.residue_plan(files, as_of, 0, keep_duplicates=True).count() == 4


def test_lookup_join_with_hot_keys(spark):
    left = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 100), (3, 101), (None, 102)], "k int, v int")
    right = spark.createDataFrame([(1, "a"), (2, "b")], "k int, w string")
    hot = spark.createDataFrame([(1,)], "k int")
    for how in ("left", "inner"):
        want = sorted(map(repr, left.join(right, "k", how).collect()))
        assert sorted(map(repr, lookup_join(left, right, "k", hot, how).collect())) == want


def test_components_and_density(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, k) for k in range(5001, 5040)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.id: r.component for r in K.connected_components(df).collect()} == {x: find(x) for x in list(parent)}
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 10)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 9, 10, 11)], "id long")
    got = {r.id: (r.cluster, r.is_core) for r in K.dbscan(nodes, links).collect()}
    assert got == {1: (2, False), 2: (2, True), 3: (2, True), 4: (2, False), 9: (-1, False), 10: (-1, False), 11: (-1, False)}


def test_similarity_of_features(spark):
    f = spark.createDataFrame([(1, 1, "/a.txt", 100, "txt", 1000, [1.0, 0.0]), (1, 2, "/b.txt", 100, "txt", 1000, [1.0, 0.0]), (1, 3, "/c.pdf", 300, "pdf", 0, [0.0, 1.0]), (1, 4, "/a.txt", 1, "pdf", 5, [0.0, 1.0])], "volume_id long, file_id long, full_path string, size long, type string, modified_s long, features array<double>")
    got = {(r.target_id, r.file_id): round(r.similarity, 6) for r in K.similar_files(f, f.where("file_id = 1"), 0.0).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 1.0, (1, 3): round((0.5 + 0.1 + 0) / 3, 6), (1, 4): 1.0}


def test_models_learn_and_save(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(i % 2 * 3, 1, 4)], i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "i long, features array<double>, label int")
    for kind in ("logistic", "tree", "forest", "svm", "perceptron"):
        assert K.accuracy(K.predict(K.train(df, kind), df)) > 0.9
    model = K.train(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = type(model).load(str(tmp_path / "m"))
    assert K.accuracy(K.predict(again, df)) == K.accuracy(K.predict(model, df))
    assert len({(r.cluster, r.label) for r in K.kmeans(df, 2).collect()}) <= 4


@pytest.mark.parametrize("sizes", [[6, 6, 4, 3, 2, 2, 1], [1], [5] * 9, [1000, 1, 1, 1]])
def test_squarified_rectangles_fill_without_overlap(sizes):
    spots = Y.squarify(sizes, 0, 0, 6, 4)
    assert sum(w * h for *_, w, h in spots) == pytest.approx(24)
    assert all(w * h == pytest.approx(s / sum(sizes) * 24) for s, (*_, w, h) in zip(sizes, spots, strict=True))
    for i, (x, y, w, h) in enumerate(spots):
        assert x >= -1e-9 and y >= -1e-9 and x + w <= 6 + 1e-9 and y + h <= 4 + 1e-9
        for a, b, c, d in spots[:i]:
            assert min(x + w, a + c) - max(x, a) < 1e-9 or min(y + h, b + d) - max(y, b) < 1e-9


def test_layouts(spark, monkeypatch):
    monkeypatch.setattr(Y, "SHOWN", 3)
    items = spark.createDataFrame([(1, i, i) for i in range(6)] + [(2, 9, 4)], "parent long, id long, size long")
    strips = {r.id: (round(r.y, 6), round(r.h, 6)) for r in Y.strips(items.where("parent = 1")).collect()}
    assert strips == {5: (0.0, round(5 / 15, 6)), 4: (round(5 / 15, 6), round(4 / 15, 6)), 3: (0.6, 0.2), -1: (0.8, 0.2)}
    deep = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0, 0), (2, 0.0, 0.0, 0.5, 0.5, 1), (3, 0.5, 0.0, 0.5, 0.5, 1)], "id long, x double, y double, w double, h double, depth int")
    assert [Y.hit_test(deep, x, 0.1).first().id for x in (0.1, 0.6)] == [2, 3] and Y.hit_test(deep, 0.1, 0.9).first().id == 1
    assert Y.visible(deep, 0.6, 0.0, 0.7, 0.2).count() == 2


@pytest.mark.parametrize("style", ["csv", "JSON", "parquet", "orc", "xml"])
def test_written_tables_read_back(spark, tmp_path, style):
    df = spark.createDataFrame([(1, "a,\"b\""), (2, "c")], "k long, v string")
    sinks.write_table(df, str(tmp_path / "t"), style)
    reader = spark.read.schema(df.schema).format(style.lower())
    reader = reader.option("header", True).option("escape", "\\") if style == "csv" else reader.option("rowTag", "row") if style == "xml" else reader
    assert sorted(map(tuple, reader.load(str(tmp_path / "t")).collect())) == [(1, "a,\"b\""), (2, "c")]
    with pytest.raises(ValueError):
        sinks.write_table(df, str(tmp_path / "u"), "pdf")


def test_feed_into_catalog(spark, tmp_path):
    schema = "volume_id long, file_id long, seq long, deleted boolean, size_logical long"
    feed, catalog = str(tmp_path / "feed"), f"file://{tmp_path}/catalog"
    steps = [[(1, 1, 1, False, 5), (1, 2, 2, False, 6), (1, None, 9, False, 1)], [(1, 1, 3, True, 5), (1, 3, 4, False, 7)], [(1, 3, 5, False, 8), (1, 1, 2, False, 9)]]
    for rows in steps:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(feed)
        stream = changes.read_changes(spark, feed, spark.createDataFrame([], schema).schema)
        changes.into_catalog(stream, catalog, str(tmp_path / "check"), ["size_logical"]).awaitTermination()
    store = CatalogStore(spark, catalog)
    assert {(r.file_id, r.size_logical) for r in store.rows().collect()} == {(2, 6), (3, 8)}
    store.add(spark.createDataFrame([(1, 2, 99, True, 0)], schema), 2)  # a batch that was taken in before
    assert [r.size_logical for r in store.get(1, 2).collect()] == [6]


def test_a_batch_costs_what_it_holds(spark, tmp_path):
    path = f"file://{tmp_path}/catalog"
    store = CatalogStore(spark, path, ["size_logical"])
    rows = lambda a, b, seq: spark.range(a, b).selectExpr("id % 7 AS volume_id", "id AS file_id", f"{seq}L AS seq", "false AS deleted", f"id * {seq} AS size_logical")
    store.add(rows(0, 1000, 1))
    base = store.list["base"]
    for k in range(3):
        store = CatalogStore(spark, path)
        store.add(rows(k * 10, k * 10 + 10, 2))
        assert store.list["base"] == base and store.list["deltas"][-1][1] == 10
    assert store.rows().agg({"size_logical": "sum"}).first()[0] == sum(range(1000)) + sum(range(30))
    store.fold()
    assert store.list["deltas"] == [] and store.list["base_rows"] == 1000 and CatalogStore(spark, path).rows().count() == 1000
    assert "PushedFilters: [IsNotNull(volume_id), IsNotNull(file_id), EqualTo(volume_id,5), EqualTo(file_id,12)]" in store.get(5, 12)._jdf.queryExecution().toString()


def test_ring_percentiles_keep_the_last_values(spark, tmp_path):
    schema = "k string, v double"
    for at in (0, 50):
        spark.createDataFrame([("a", float(v)) for v in range(at, at + 50)] + [("b", None), ("b", 7.0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "f"))
        stream = changes.read_changes(spark, str(tmp_path / "f"), spark.createDataFrame([], schema).schema)
        rings = changes.ring_percentiles(stream, "k", "v", 20)
        got: list = []
        query = rings.writeStream.outputMode("update").foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert {(r.n, r.percent, r.value) for r in got if r.k == "a"} == {(20, 50.0, at + 40.0), (20, 95.0, at + 49.0), (20, 99.0, at + 49.0)}
    assert {r.n for r in got if r.k == "b"} == {2}


def test_snapshot_series_is_appended(spark, tmp_path):
    from siltstone.sources.files import SNAPSHOT

    for n in (1, 2):
        spark.createDataFrame([(None, f"/v{n}", n, n, 0, 0, 0, 0)], SNAPSHOT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = changes.read_changes(spark, str(tmp_path / "in"), spark.createDataFrame([], SNAPSHOT).schema)
        changes.append_snapshots(stream, str(tmp_path / "series"), str(tmp_path / "check")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "series")).count() == n


def test_late_rows_of_a_stream_match_the_batch(spark, tmp_path):
    spark.createDataFrame([(f"2024-01-01 0{h}:10:00", h) for h in range(6)] * 2, "ts string, k int").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "e"))
    batch = spark.read.parquet(str(tmp_path / "e"))
    stream = changes.read_changes(spark, str(tmp_path / "e"), batch.schema)
    got = changes.run_to_end(changes.event_windows(stream, "ts", "1 hour", "2 hours"), "t")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, changes.event_windows(batch, "ts", "1 hour", "2 hours").collect()))


def test_digests_in_every_notation_are_asked(spark, tmp_path):
    digests = [hashlib.sha256(bytes([k])).digest() for k in range(6)]
    hexed = [d.hex() for d in digests]
    written = [hexed[0].upper(), base64.b64encode(digests[1]).decode(), "sha256:" + hexed[2], ":".join(hexed[3][k : k + 2] for k in range(0, 64, 2)), hexed[5], "none", None]
    spark.createDataFrame([(bytearray(d),) for d in digests[:5]] + [(None,)], "sha256 binary").write.parquet(str(tmp_path / "file_entry.parquet"))
    spark.createDataFrame([(w,) for w in written], "sha256 string").write.parquet(str(tmp_path / "incoming_entry.parquet"))
    assert sorted(r.digest for r in P.bloom_filter_members(spark, str(tmp_path)).collect()) == sorted(hexed[:4])


def test_every_item_of_a_large_parent_is_laid_out(spark):
    items = spark.range(1, 2501).select(F.lit(1).cast("bigint").alias("parent"), "id", (F.col("id") % 97 + 1).alias("size"))
    for layout in (Y.strips, Y.squarified, Y.shelves, Y.spiral):
        assert sorted(r.id for r in layout(items).select("id").collect()) == list(range(1, 2501))
    whole = sum(k % 97 + 1 for k in range(1, 2501))
    assert all(r.w * r.h == pytest.approx((r.id % 97 + 1) / whole) for r in Y.squarified(items).collect())


def test_more_targets_than_a_block_holds(spark, monkeypatch):
    f = spark.range(30).select(F.lit(1).cast("bigint").alias("volume_id"), F.col("id").alias("file_id"), F.concat(F.lit("/"), "id").alias("full_path"), (F.col("id") + 1).alias("size"), F.lit("txt").alias("type"), F.lit(5).cast("bigint").alias("modified_s"), F.array(F.lit(1.0), F.col("id") / 9).alias("features"))
    v = f.select(F.col("file_id").alias("vec_id"), F.col("features").alias("embedding"))
    found = lambda: (sorted(map(tuple, K.similar_files(f, f.where("file_id < 25"), 0.95).collect())), sorted(map(tuple, K.nearest_vectors(v, v.where("vec_id < 25"), 3).collect())))
    want = found()
    monkeypatch.setattr(K, "BROADCAST_ROWS", 70)
    assert found() == want and len(want[1]) == 75


def test_similar_files_lose_nothing_by_meeting_in_bands(spark):
    rng = random.Random(3)
    rows = []
    for i in range(220):
        size = rng.choice([None, 0, 5, 1000, rng.randrange(900, 1100), rng.randrange(1, 10**6)])
        rows.append((1, i, f"/d/{i % 180}.{rng.choice(['txt', 'pdf'])}", size, rng.choice(["txt", "pdf"]), rng.choice([None, 0, 1_600_000_000 + rng.randrange(10**7)]), [float(size or 0), rng.random(), 1.0]))
    df = spark.createDataFrame(rows, "volume_id long, file_id long, full_path string, size long, type string, modified_s long, features array<double>")
    asked = df.where("file_id % 5 = 0")
    for threshold in (0.9, 0.97):
        whole = K._similar(df.withColumn("size", F.coalesce("size", F.lit(0))), asked.withColumn("size", F.coalesce("size", F.lit(0))).toPandas(), threshold)
        want = {(r.target_id, r.file_id): round(r.similarity, 9) for r in whole.collect()}
        got = [(r.target_id, r.file_id, round(r.similarity, 9)) for r in K.similar_files(df, asked, threshold).collect()]
        assert {(a, b): s for a, b, s in got} == want and len(got) == len(want)


def test_leaders_in_slices(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(90, 4))
    df = spark.createDataFrame([(i % 2, i, x.tolist()) for i, x in enumerate(v)] + [(0, None, [1.0] * 4), (1, 200, None)], "b int, id long, v array<double>")
    want = {tuple(r) for r in K.leaders(df, "b", "id", "v", 0.7).collect()}
    monkeypatch.setattr(K, "SLICE_ROWS", 25)
    assert {tuple(r) for r in K.leaders(df, "b", "id", "v", 0.7).collect()} == want and len(want) == 90


def test_linkage_to_k_groups(spark):
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 10, 11, 30, 31, 32, 99)], "id long")
    ids = [1, 2, 3, 10, 11, 30, 31, 32]
    edges = spark.createDataFrame([(a, b, b - a) for a in ids for b in ids if a < b] + [(2, 1, 1)], "a long, b long, d long")
    groups = lambda k: sorted(sorted(r.id for r in g) for g in _grouped(K.link_to_k(nodes, edges, "d", k).collect()))
    assert groups(4) == [[1, 2, 3], [10, 11], [30, 31, 32], [99]]
    assert groups(3) == [[1, 2, 3, 10, 11], [30, 31, 32], [99]] and groups(1) == [ids, [99]] and len(groups(9)) == 9
    assert K.link_to_k(nodes, edges.limit(0), "d", 2).count() == 9


def _grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r.component, []).append(r)
    return out.values()


def test_faults_of_layouts_are_seen(spark):
    r = "parent long, id long, x double, y double, w double, h double"
    ok = [(1, 1, 0.0, 0.0, 0.5, 1.0), (1, 2, 0.5, 0.0, 0.5, 0.5), (1, 3, 0.5, 0.5, 0.5, 0.5)]
    over = [(2, 1, 0.0, 0.0, 0.5, 1.0), (2, 2, 0.25, 0.0, 0.5, 1.0)]
    out = [(3, 1, 0.0, 0.0, 0.5, 1.0), (3, 2, 0.75, 0.0, 0.5, 1.0)]
    got = {f.parent: (f.fills, f.inside, f.apart) for f in Y.layout_faults(spark.createDataFrame(ok + over + out, r), 1.0, 1.0).collect()}
    assert got[1] == (True, True, True) and got[2] == (True, True, False) and not got[3][1]


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(K, "HOT_ROWS", 5)
    monkeypatch.setattr(K, "hot_limit", lambda rows: 6)
    edges = [(500, i) for i in range(1, 30)] + [(i, 600) for i in range(100, 130)] + [(700, 701), (701, 702), (600, 777)]
    got = {r.id: r.component for r in K.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: 1 for x in (500, *range(1, 30))} | {x: 100 for x in (600, 777, *range(100, 130))} | {x: 700 for x in (700, 701, 702)}
    assert got == want


def test_similarity_options(spark):
    f = "file_id long, full_path string, size long, type string, modified_s long, features array<double>, digest string"
    rows = [(1, "/a", 100, "txt", 1000, [1.0, 0.0], "abcd"), (2, "/b", 100, "pdf", 1000, [0.0, 1.0], "abcx"), (3, "/c", None, "txt", None, [1.0, 0.0], None), (4, "/a", 7, "bin", 9, [0.0, 0.0], "zz")]
    df = spark.createDataFrame(rows, f)
    run = lambda threshold, *use: {(r.file_id, round(r.similarity, 6)) for r in K.similar_files(df, df.where("file_id = 1"), threshold, use).collect()}
    assert run(0.7, "digest") == {(1, 1.0), (2, 0.75), (4, 1.0)}
    assert run(0.9, "size", "time") == {(1, 1.0), (2, 1.0), (4, 1.0)}
    assert run(0.95, "type", "features") == {(1, 1.0), (3, 1.0), (4, 1.0)}
    assert run(0.99, "size", "type") == {(1, 1.0), (3, 1.0), (4, 1.0)}
    with pytest.raises(ValueError):
        run(0.5, "colour")
