"""Queries on vectors, clusters, models, layouts, scalars and feeds, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import modes, paths, texts, times
from siltstone.functions import vectors as V
from siltstone.operators import catalog as C
from siltstone.operators import cluster as K
from siltstone.operators import layout as Y
from siltstone.operators import memory as M
from siltstone.operators import security as S
from siltstone.operators.store import CatalogStore
from siltstone.runtime import Scratch, table
from siltstone.sources import sinks
from siltstone.streaming import changes

AS_OF = "2025-11-01 00:00:00"


def _next_vectors(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.select("vec_id", "embedding").join(nxt, "vec_id")


def vector_distances(spark, d):
    a, b = F.col("embedding"), F.col("other")
    return _next_vectors(spark, d).select("vec_id", F.round(V.euclidean(a, b), 6).alias("euclidean"), F.round(V.manhattan(a, b), 6).alias("manhattan"), F.round(V.cosine(a, b), 6).alias("cosine"))


#: A weight for each of the 64 coordinates.
_WEIGHTS = [round(((7 * k) % 13 - 6) / 4, 2) for k in range(64)]


def vector_classes(spark, d):
    x = F.transform("embedding", lambda v: v.cast("double") * 10)
    e = table(spark, d, "embeddings").select("vec_id", "label", x.alias("x"))
    p = V.logistic_score(F.col("x"), _WEIGHTS, 0.1)
    return e.select(
        "vec_id", F.round(p, 6).alias("p"), V.classify(F.col("x"), _WEIGHTS, 0.1)["type"].alias("by_score"), V.classify_by_mean(F.col("x"))["type"].alias("by_mean"),
        F.round(V.classify_by_margin(F.col("x"), _WEIGHTS, 0.1)["confidence"], 6).alias("margin"), V.type_name(F.col("label")).alias("name"),
        F.round(F.array_max(V.softmax(F.col("x"))), 6).alias("softmax"), F.round(F.aggregate(V.clamp(F.col("x")), F.lit(0.0), lambda s, v: s + v), 6).alias("clamped"),
    )


def logistic_loss(spark, d):
    x = F.transform("embedding", lambda v: v.cast("double"))
    p = V.logistic_score(x, _WEIGHTS, 0.1)
    return table(spark, d, "embeddings").agg(F.round(F.avg(V.log_loss(p, (F.col("label") == 1).cast("double"))), 9).alias("loss"))


def nearest_vectors(spark, d):
    """The five most similar of each vector whose id is divisible by 100."""
    e = table(spark, d, "embeddings")
    got = K.nearest_vectors(e, e.where("vec_id % 100 = 0"), 5)
    return got.select("query_id", "rank_no", "id", F.round("score", 6).alias("score"))


def _features(spark, d) -> DataFrame:
    files = C.current(table(spark, d, "file_entry"), ["full_path", "size_logical", "created", "modified", "accessed", "mode"])
    return files.where("full_path is not null and size_logical is not null")


def file_features(spark, d):
    f = K.file_features(_features(spark, d))
    return f.select("file_id", "type", *(F.round(F.col("features")[k], 6).alias(f"f{k}") for k in (0, 1, 3, 4, 5)))


def training_rows(spark, d):
    t = K.training_rows(_features(spark, d))
    return t.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("features")[0]), 9).alias("mean_size"))


def similar_files(spark, d):
    """Files much like each of those whose id is divisible by 100."""
    f = K.file_features(_features(spark, d))
    return K.similar_files(f, f.where("file_id % 100 = 0"), 0.995).select("target_id", "file_id", F.round("similarity", 6).alias("similarity"))


def similar_by_options(spark, d):
    """As similar_files, by size, type and time alone."""
    f = K.file_features(_features(spark, d))
    return K.similar_files(f, f.where("file_id % 100 = 0"), 0.999, ("size", "type", "time")).select("target_id", "file_id", F.round("similarity", 6).alias("similarity"))


def cluster_cohesion(spark, d):
    got = K.cluster_cohesion(table(spark, d, "embeddings"), "label", "embedding")
    return got.withColumn("cohesion", F.round("cohesion", 6))


def cluster_sizes(spark, d):
    rows = K.kmeans(table(spark, d, "embeddings"), 5, "embedding", iterations=20)
    return rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


def _graph(spark, d) -> DataFrame:
    """Links of orders of one customer in date order."""
    o = table(spark, d, "orders")
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    links = o.select(F.col("o_orderkey").alias("a"), F.lag("o_orderkey").over(order).alias("b"), F.datediff("o_orderdate", F.lag("o_orderdate").over(order)).alias("days"))
    return links.where("b is not null")


def linked_orders(spark, d):
    nodes = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return K.single_linkage(nodes, _graph(spark, d), "days", 120)


def density_clusters(spark, d):
    nodes = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return K.dbscan(nodes, _graph(spark, d).where("days <= 120"), 2)


def leader_clusters(spark, d):
    return K.leaders(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 0.5)


def model_accuracy(spark, d):
    """Accuracy of a linear and of a tree model on vectors dealt by identifier."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("features"), "label")
    test, rest = e.where("vec_id % 4 = 0"), e.where("vec_id % 4 <> 0")
    rows = [(kind, round(K.accuracy(K.predict(K.train(rest, kind), test)), 6)) for kind in ("logistic", "tree")]
    return spark.createDataFrame(rows, "model string, accuracy double")


def cross_validation(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("features"), "label")
    return spark.createDataFrame([(i, a) for i, a in enumerate(K.cross_validate(e, "vec_id", 3))], "fold int, accuracy double")


def _items(spark, d) -> DataFrame:
    nodes = C.current_rows(table(spark, d, "treemap_node"), ["volume_id", "file_id"], "seq", ["path_id", "size_logical"])
    return nodes.where("path_id is not null and size_logical is not null").select(F.col("path_id").alias("parent"), F.col("file_id").alias("id"), F.col("size_logical").alias("size"))


def treemap_strips(spark, d):
    s = Y.strips(_items(spark, d))
    return s.select("parent", "id", F.round("y", 6).alias("y"), F.round("h", 6).alias("h"))


def treemap_squarified(spark, d):
    """The areas are those of the sizes, wherever the rectangles lie."""
    s = Y.squarified(_items(spark, d), 4.0, 3.0)
    return s.select("parent", "id", F.round(F.col("w") * F.col("h"), 6).alias("area"))


def treemap_fit(spark, d):
    """Of each parent's squarified rectangles: whether they fill its 4 by 3 rectangle,
    lie in it, overlap nowhere, and keep the largest one no narrower than 1 to 16."""
    return Y.layout_faults(Y.squarified(_items(spark, d), 4.0, 3.0), 4.0, 3.0).select("parent", "items", "fills", "inside", "apart")


def treemap_hits(spark, d):
    """The item of each parent that lies under the middle of its strips."""
    s = Y.strips(_items(spark, d)).withColumn("depth", F.lit(1))
    return s.where(Y.contains(F.lit(0.5), F.lit(0.5))).select("parent", "id")


def treemap_shelves(spark, d):
    return Y.shelves(_items(spark, d)).select("parent", "id", F.round("w", 6).alias("side"))


def treemap_spiral(spark, d):
    return Y.spiral(_items(spark, d)).select("parent", "id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("side", 6).alias("side"))


def treemap_visible(spark, d):
    return Y.visible(Y.strips(_items(spark, d)), 0.0, 0.25, 1.0, 0.5).groupBy("parent").agg(F.count(F.lit(1)).alias("n"))


def text_scalars(spark, d):
    p = table(spark, d, "part")
    name = F.col("p_name")
    return p.select(
        "p_partkey", texts.title_case(name).alias("title"), texts.sentence_case(name).alias("sentence"), F.size(paths.split_keep(name, " ")).alias("words"), paths.join_paths(F.lit("/a/"), name).alias("joined"),
        paths.equals_ignoring_case(name, F.upper(name)).alias("same"), texts.format_size(F.col("p_partkey") * 1_000_003).alias("shown"), texts.format_percentage(F.col("p_retailprice")).alias("percent"),
        F.round(texts.throughput_mb(F.col("p_partkey") * 1e6, F.col("p_size")), 6).alias("mb_s"), F.round(texts.compression_ratio(F.col("p_size"), F.col("p_partkey") % 50), 6).alias("ratio"),
        F.round(texts.aspect_ratio(F.col("p_size").cast("double"), F.lit(7.0)), 6).alias("aspect"),
    )


def display_scalars(spark, d):
    """How the catalog's files are shown: sizes in whole units, size and extension classes."""
    f = C.current(table(spark, d, "file_entry"), ["full_path", "size_logical"]).where("full_path is not null and size_logical is not null")
    size, ext = F.col("size_logical"), F.lower(F.regexp_extract("full_path", r"(\.[^./\\]*)$", 1))
    return f.select("volume_id", "file_id", texts.format_size_whole(size).alias("whole"), texts.size_class(size).alias("band"), Y.extension_colour(ext).alias("colour"))


def type_texts(spark, d):
    e = table(spark, d, "embeddings")
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select("label", "n", V.type_description(F.col("label")).alias("description"))


def model_round_trip(spark, d):
    """Rows for which a model that was saved and loaded again says something else."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("features"), (F.col("label") % 2).alias("label"))
    out = None
    for kind in ("logistic", "tree", "svm", "perceptron"):
        model = K.train(e, kind)
        path = f"{Scratch(spark, 'model').root}/{kind}"
        model.write().save(path)
        again = type(model).load(path)
        both = K.predict(model, e).select("vec_id", "prediction").join(K.predict(again, e).select("vec_id", F.col("prediction").alias("other")), "vec_id")
        one = both.agg(F.lit(kind).alias("model"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col("prediction") != F.col("other")).alias("different"))
        out = one if out is None else out.unionByName(one)
    return out


def export_formats(spark, d):
    """The parts written in every format and read back."""
    parts = table(spark, d, "part").select("p_partkey", "p_name")
    root, out = Scratch(spark, "exports").root, None
    for style in sinks.FORMATS:
        sinks.write_table(parts, f"{root}/{style}", style)
        reader = spark.read.schema(parts.schema)
        reader = reader.option("header", True) if style == "csv" else reader.option("rowTag", "row") if style == "xml" else reader
        one = reader.format(style).load(f"{root}/{style}").agg(F.lit(style).alias("format"), F.count(F.lit(1)).alias("n"), F.sum("p_partkey").alias("keys"), F.sum(F.length("p_name")).alias("characters"))
        out = one if out is None else out.unionByName(one)
    return out


def linked_to_k(spark, d):
    """Order dates as points on a line, merged by nearest gap until twenty groups are left."""
    o = table(spark, d, "orders").select(F.datediff("o_orderdate", F.lit("1990-01-01")).cast("bigint").alias("id")).distinct()
    order = Window.orderBy("id")  # at most one row a day
    edges = o.select(F.col("id").alias("a"), F.lead("id").over(order).alias("b"), (F.lead("id").over(order) - F.col("id")).alias("distance")).where("b is not null")
    sizes = K.link_to_k(o, edges, "distance", 20).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("days"))


def stream_catalog(spark, d):
    """The catalog as a feed of its rows leaves it in a kept store."""
    schema = table(spark, d, "file_entry").schema
    scratch = Scratch(spark, "feed")
    feed = changes.read_changes(spark, f"{d}/file_entr[y].parquet", schema)
    changes.into_catalog(feed, f"{scratch.root}/catalog", f"{scratch.root}/checkpoint", ["full_path", "size_logical"]).awaitTermination()
    return CatalogStore(spark, f"{scratch.root}/catalog").rows()


def stream_rings(spark, d):
    """Number of values that each event type's ring buffer of 100 holds at the end."""
    rings = changes.ring_percentiles(_event_stream(spark, d).select("event_type", "value"), "event_type", "value", 100)
    got = changes.run_to_end(rings, "rings", "update")
    return got.groupBy("event_type").agg(F.max("n").alias("n"), F.count_distinct("percent").alias("percents"))


def time_scalars(spark, d):
    f = C.current(table(spark, d, "file_entry"), ["modified", "accessed"]).where("modified is not null")
    as_of = F.lit(AS_OF).cast("timestamp")
    date, time = times.unix_to_dos_date(F.col("modified")), times.unix_to_dos_time(F.col("modified"))
    return f.select(
        "volume_id", "file_id", times.timestamp_to_filetime(F.col("modified")).alias("filetime"), times.filetime_to_ms(times.timestamp_to_filetime(F.col("modified"))).alias("ms"), date.alias("dos_date"), time.alias("dos_time"),
        times.dos_to_unix(date, time).alias("dos_unix"), times.age_hours(F.col("modified"), as_of).alias("hours"), times.age_months(F.col("modified"), as_of).alias("months"),
        times.time_difference_ms(F.unix_millis("modified"), F.unix_millis(F.coalesce("accessed", "modified"))).alias("since_ms"),
    )


def mode_round_trip(spark, d):
    m = table(spark, d, "file_entry").select("mode").distinct()
    text = modes.permission_string(F.col("mode"))
    return m.select("mode", text.alias("text"), modes.mode_of(text).alias("back"), modes.suspicious(F.col("mode")).alias("suspicious"))


def enumerations(spark, d):
    n = spark.range(7).select(F.col("id").cast("int").alias("n"))
    return n.select("n", *(S.enumeration(F.col("n"), names).alias(c) for c, names in (("severity", S.SEVERITIES), ("level", S.AUDIT_LEVELS), ("permission", S.PERMISSION_TYPES), ("policy", S.POLICY_TYPES))))


def dump_formats(spark, d):
    rows = spark.createDataFrame([("a.RAW", ""), ("b.dmp", ""), ("c.bin", "50414745"), ("d.bin", "00112233"), ("e", "00")], "path string, head string")
    name = M.dump_format(F.col("path"), F.unhex("head"))
    return rows.select("path", name.alias("format"), M.format_description(name).alias("description"))


def export_json(spark, d):
    """One JSON document of regions for each key."""
    return sinks.json_documents(table(spark, d, "region").select("r_regionkey", "r_name"), "regions", "r_regionkey")


def _event_stream(spark, d) -> DataFrame:
    schema = table(spark, d, "events").schema
    return changes.read_changes(spark, f"{d}/event[s].parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_windows(spark, d):
    return changes.run_to_end(changes.event_windows(_event_stream(spark, d), "ts", "1 hour", "6 hours", keys=("event_type",)), "windows")


def stream_sliding(spark, d):
    return changes.run_to_end(changes.event_windows(_event_stream(spark, d), "ts", "1 hour", "12 hours", "6 hours"), "sliding")


def stream_histogram(spark, d):
    return changes.run_to_end(changes.histogram(_event_stream(spark, d), F.col("value"), 10.0, 12), "histogram")


def stream_distinct(spark, d):
    got = changes.run_to_end(changes.distinct_events(_event_stream(spark, d), "ts", "60 days", "user_id", "event_type"), "distinct", "append")
    return got.groupBy("event_type").agg(F.count(F.lit(1)).alias("users"))


def event_sessions(spark, d):
    return changes.sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "2 days", "user_id")


_PAIR = "(SELECT a.vec_id, a.embedding::DOUBLE[64] AS x, b.embedding::DOUBLE[64] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"
_X = "(SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE * 10) AS x FROM embeddings)"
_DOT = "list_sum(list_transform(x, lambda v, i: v * ([" + ", ".join(map(str, _WEIGHTS)) + "]::DOUBLE[])[i]))"
_S = f"(0.1::DOUBLE + {_DOT})"
_LIVE = "(SELECT * FROM (SELECT * FROM file_entry QUALIFY row_number() OVER (PARTITION BY volume_id, file_id ORDER BY seq DESC) = 1) WHERE NOT deleted AND full_path IS NOT NULL AND size_logical IS NOT NULL)"
_FEATURES = f"""(SELECT file_id, full_path, size_logical AS size, CASE WHEN t = '' THEN 'unknown' ELSE t END AS type, w AS modified_s,
  [size_logical / 1048576, xor(size_logical, w) / 1e6, 0, c / 31536000, w / 31536000, length(CASE WHEN t = '' THEN 'unknown' ELSE t END), 0, 0]::DOUBLE[8] AS f
  FROM (SELECT *, regexp_extract(full_path, '\\.([^.]*)$', 1) AS t, epoch_us(created) // 1000000 AS c, epoch_us(modified) // 1000000 AS w FROM {_LIVE}))"""
_ITEMS = "(SELECT path_id AS parent, file_id AS id, size_logical AS size FROM (SELECT * FROM treemap_node QUALIFY row_number() OVER (PARTITION BY volume_id, file_id ORDER BY seq DESC) = 1) WHERE path_id IS NOT NULL AND size_logical > 0)"
_SHOWN = f"""(SELECT *, sum(size) OVER (PARTITION BY parent) AS whole, sum(size) OVER (PARTITION BY parent ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above
  FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY size DESC, id) AS r FROM {_ITEMS}))"""
_NAMES = "CASE label " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(V.FILE_TYPES)) + " ELSE 'Unknown' END"
_LINKS = "(SELECT o_orderkey AS a, lag(o_orderkey) OVER w AS b, datediff('day', lag(o_orderdate) OVER w, o_orderdate) AS days FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"
_RUNS = f"""(SELECT o.o_orderkey AS id, o.o_custkey, sum(CASE WHEN l.days IS NULL OR l.days > 120 THEN 1 ELSE 0 END) OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderdate, o.o_orderkey) AS run FROM orders o JOIN {_LINKS} l ON l.a = o.o_orderkey)"""
_ENUM = lambda names: "CASE n " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(names)) + " ELSE 'Unknown' END"

QUERIES = {
    f.__name__: f
    for f in (
        vector_distances, vector_classes, logistic_loss, nearest_vectors, file_features, training_rows, similar_files, similar_by_options, cluster_cohesion, cluster_sizes, linked_orders, density_clusters, leader_clusters, model_accuracy,
        cross_validation, treemap_strips, treemap_squarified, treemap_fit, treemap_hits, treemap_shelves, treemap_spiral, treemap_visible, text_scalars, time_scalars, mode_round_trip, enumerations, dump_formats, export_json, stream_windows,
        stream_sliding, stream_histogram, stream_distinct, stream_catalog, stream_rings, event_sessions, display_scalars, type_texts, model_round_trip, export_formats, linked_to_k,
    )
}

SQL = {
    "display_scalars": f"""
SELECT volume_id, file_id, CASE WHEN s < 1024 THEN s || ' B' WHEN s < 1048576 THEN s // 1024 || ' KB' WHEN s < 1073741824 THEN s // 1048576 || ' MB' ELSE s // 1073741824 || ' GB' END AS whole,
  CASE WHEN s < 1024 THEN 'tiny' WHEN s < 1048576 THEN 'small' WHEN s < 10485760 THEN 'medium' WHEN s < 104857600 THEN 'large' WHEN s < 1073741824 THEN 'huge' ELSE 'giant' END AS band,
  CASE WHEN e IN ('exe', 'dll') THEN 'red' WHEN e IN ('jpg', 'png', 'gif') THEN 'green' WHEN e IN ('mp3', 'wav', 'flac') THEN 'yellow' WHEN e IN ('txt', 'doc', 'pdf') THEN 'purple' ELSE 'gray' END AS colour
FROM (SELECT volume_id, file_id, size_logical AS s, lower(regexp_extract(full_path, '\\.([^./\\\\]*)$', 1)) AS e FROM {_LIVE})""",
    "type_texts": "SELECT label, count(*) AS n, CASE label " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(V.TYPE_DESCRIPTIONS)) + " ELSE 'Unknown file type' END AS description FROM embeddings GROUP BY label",
    "model_round_trip": "SELECT model, count(*) AS rows, 0::BIGINT AS different FROM embeddings, (VALUES ('logistic'), ('tree'), ('svm'), ('perceptron')) m(model) GROUP BY 1",
    "export_formats": "SELECT format, count(*) AS n, sum(p_partkey)::BIGINT AS keys, sum(length(p_name))::BIGINT AS characters FROM part, (VALUES ('csv'), ('json'), ('parquet'), ('orc'), ('xml')) f(format) GROUP BY 1",
    "linked_to_k": "SELECT 20::BIGINT AS groups, count(DISTINCT o_orderdate)::BIGINT AS days FROM orders",
    "stream_catalog": f"SELECT volume_id, file_id, full_path, size_logical FROM (SELECT * FROM file_entry QUALIFY row_number() OVER (PARTITION BY volume_id, file_id ORDER BY seq DESC) = 1) WHERE NOT deleted",
    "stream_rings": "SELECT event_type, least(count(value), 100)::BIGINT AS n, 3::BIGINT AS percents FROM events GROUP BY 1",
    "vector_distances": f"SELECT vec_id, round(array_distance(x, y), 6) AS euclidean, round(list_sum(list_transform(list_zip(x::DOUBLE[], y::DOUBLE[]), lambda p: abs(p[1] - p[2]))), 6) AS manhattan, round(array_cosine_similarity(x, y), 6) AS cosine FROM {_PAIR}",
    "vector_classes": f"""
SELECT vec_id, round(p, 6) AS p, CASE WHEN p > 0.9 THEN 'Malware' WHEN p > 0.7 THEN 'Executable' WHEN x[1] > 0.5 THEN 'Document' ELSE 'Unknown' END AS by_score,
  CASE WHEN list_sum(x) / 64 > 0.7 THEN 'Malware' WHEN list_sum(x) / 64 > 0.3 THEN 'Executable' ELSE 'Unknown' END AS by_mean, round(abs(s) / (abs(s) + 1), 6) AS margin, {_NAMES} AS name,
  round(1 / list_sum(list_transform(x, lambda v: exp(v - list_max(x)))), 6) AS softmax, round(list_sum(list_transform(x, lambda v: least(greatest(v, 0), 1))), 6) AS clamped
FROM (SELECT *, {_S} AS s, 1 / (1 + exp(-{_S})) AS p FROM {_X})""",
    "logistic_loss": f"SELECT round(avg(-CASE WHEN label = 1 THEN ln(p) ELSE ln(1 - p) END), 9) AS loss FROM (SELECT label, 1 / (1 + exp(-(0.1::DOUBLE + {_DOT} / 10))) AS p FROM {_X})",
    "nearest_vectors": """
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id)::INTEGER AS rank_no, id, round(s, 6) AS score
FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, round(array_cosine_similarity(q.embedding::DOUBLE[64], e.embedding::DOUBLE[64]), 9) AS s FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id)
QUALIFY rank_no <= 5""",
    "file_features": f"SELECT file_id, type, round(f[1], 6) AS f0, round(f[2], 6) AS f1, round(f[4], 6) AS f3, round(f[5], 6) AS f4, round(f[6], 6) AS f5 FROM {_FEATURES}",
    "training_rows": f"""
SELECT CASE WHEN s IN ('exe', 'dll') THEN 1 WHEN s IN ('txt', 'doc', 'pdf') THEN 2 WHEN s IN ('jpg', 'png', 'gif') THEN 3 WHEN s IN ('mp3', 'wav') THEN 4 WHEN s IN ('mp4', 'avi') THEN 5 WHEN s IN ('zip', 'rar') THEN 6 ELSE 0 END AS label, count(*) AS n, round(avg(ln(size_logical + 1) / 20), 9) AS mean_size
FROM (SELECT *, lower(regexp_extract(regexp_extract(full_path, '([^/\\\\]*)$', 1), '\\.([^.]*)$', 1)) AS s FROM {_LIVE}) GROUP BY 1""",
    "similar_files": f"""
SELECT b.file_id AS target_id, a.file_id, round(CASE WHEN a.full_path = b.full_path THEN 1.0 ELSE v END, 6) AS similarity
FROM {_FEATURES} a JOIN {_FEATURES} b ON b.file_id % 100 = 0, LATERAL (SELECT list_avg(list_filter([
  CASE WHEN a.size > 0 AND b.size > 0 THEN 1 - abs(a.size - b.size) / (a.size + b.size) END, CASE WHEN a.type = b.type THEN 1.0 ELSE 0.1 END::DOUBLE,
  CASE WHEN a.modified_s > 0 AND b.modified_s > 0 THEN 1 - abs(a.modified_s - b.modified_s) / (a.modified_s + b.modified_s + 1) END, array_cosine_similarity(a.f, b.f)], lambda q: q IS NOT NULL)) AS v)
WHERE CASE WHEN a.full_path = b.full_path THEN 1.0 ELSE v END >= 0.995""",
    "similar_by_options": f"""
SELECT b.file_id AS target_id, a.file_id, round(CASE WHEN a.full_path = b.full_path THEN 1.0 ELSE v END, 6) AS similarity
FROM {_FEATURES} a JOIN {_FEATURES} b ON b.file_id % 100 = 0, LATERAL (SELECT list_avg(list_filter([
  CASE WHEN a.size > 0 AND b.size > 0 THEN 1 - abs(a.size - b.size) / (a.size + b.size) END, CASE WHEN a.type = b.type THEN 1.0 ELSE 0.1 END::DOUBLE,
  CASE WHEN a.modified_s > 0 AND b.modified_s > 0 THEN 1 - abs(a.modified_s - b.modified_s) / (a.modified_s + b.modified_s + 1) END], lambda q: q IS NOT NULL)) AS v)
WHERE CASE WHEN a.full_path = b.full_path THEN 1.0 ELSE v END >= 0.999""",
    "cluster_cohesion": """
WITH p AS (SELECT a.label, avg(array_cosine_similarity(a.embedding::DOUBLE[64], b.embedding::DOUBLE[64])) AS c FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1)
SELECT e.label, count(*) AS n, round(coalesce(max(c), 1.0), 6) AS cohesion FROM embeddings e LEFT JOIN p ON e.label = p.label GROUP BY 1""",
    "linked_orders": f"SELECT id, min(id) OVER (PARTITION BY o_custkey, run) AS component FROM {_RUNS}",
    "density_clusters": f"""
WITH r AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY o_custkey, run ORDER BY d, id) AS k FROM (SELECT r.*, o.o_orderdate AS d FROM {_RUNS} r JOIN orders o ON o.o_orderkey = r.id) WINDOW w AS (PARTITION BY o_custkey, run))
SELECT id, CASE WHEN n < 3 THEN -1 ELSE min(CASE WHEN k > 1 AND k < n THEN id END) OVER (PARTITION BY o_custkey, run) END AS cluster, n >= 3 AND k > 1 AND k < n AS is_core FROM r""",
    "treemap_strips": f"SELECT parent, id, round(coalesce(above, 0) / whole, 6) AS y, round(size / whole, 6) AS h FROM {_SHOWN}",
    "treemap_squarified": f"SELECT parent, id, round(size / whole * 12, 6) AS area FROM {_SHOWN}",
    "treemap_fit": f"SELECT parent, count(*) AS items, true AS fills, true AS inside, true AS apart FROM {_ITEMS} GROUP BY 1",
    "treemap_hits": f"SELECT parent, id FROM {_SHOWN} WHERE coalesce(above, 0) / whole <= 0.5 AND 0.5 < coalesce(above, 0) / whole + size / whole",
    "treemap_shelves": f"SELECT parent, id, round(sqrt(size / whole), 6) AS side FROM {_SHOWN}",
    "treemap_spiral": f"SELECT parent, id, round(0.5::DOUBLE + (10 + 5 * (r - 1)) * cos(0.5 * (r - 1)), 6) AS x, round(0.5::DOUBLE + (10 + 5 * (r - 1)) * sin(0.5 * (r - 1)), 6) AS y, round(sqrt(size) * 2, 6) AS side FROM {_SHOWN}",
    "treemap_visible": f"SELECT parent, count(*) AS n FROM {_SHOWN} WHERE coalesce(above, 0) / whole < 0.5 AND coalesce(above, 0) / whole + size / whole > 0.25 GROUP BY 1",
    "text_scalars": """
SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title, upper(p_name[1]) || lower(p_name[2:]) AS sentence, len(string_split(p_name, ' '))::INTEGER AS words, '/a/' || p_name AS joined, true AS same,
  CASE WHEN s < 1024 THEN s || ' B' WHEN s < 1048576 THEN printf('%.2f KB', s / 1024) WHEN s < 1073741824 THEN printf('%.2f MB', s / 1048576) ELSE printf('%.2f GB', s / 1073741824) END AS shown, printf('%.2f', p_retailprice) AS percent,
  round(CASE WHEN p_size > 0 THEN p_partkey * 1e6 / 1048576 / p_size ELSE 0 END, 6) AS mb_s, round(CASE WHEN p_partkey % 50 > 0 THEN greatest(1 - p_size / (p_partkey % 50), 0) ELSE 0 END, 6) AS ratio, round(greatest(p_size / 7, 7 / p_size), 6) AS aspect
FROM (SELECT *, p_partkey * 1000003 AS s FROM part)""",
    "time_scalars": f"""
SELECT volume_id, file_id, u * 10 + 116444736000000000 AS filetime, (u * 10 + 116444736000000000) // 10000 AS ms, dd AS dos_date, dt AS dos_time, epoch_us(m) // 1000000 - second(m)::BIGINT % 2 AS dos_unix,
  datediff('microsecond', m, TIMESTAMP '{AS_OF}') // 3600000000 AS hours, ((2025 - year(m)) * 12 + 11 - month(m))::INTEGER AS months, greatest(epoch_ms(coalesce(accessed, modified)) - epoch_ms(modified), 0) AS since_ms
FROM (SELECT *, epoch_us(modified) AS u, modified::TIMESTAMP AS m, (((year(m) - 1980) << 9) + (month(m) << 5) + day(m))::INTEGER AS dd, ((hour(m) << 11) + (minute(m) << 5) + (second(m) >> 1))::INTEGER AS dt
  FROM (SELECT * FROM file_entry QUALIFY row_number() OVER (PARTITION BY volume_id, file_id ORDER BY seq DESC) = 1) WHERE NOT deleted AND modified IS NOT NULL)""",
    "enumerations": f"SELECT n::INTEGER AS n, {_ENUM(S.SEVERITIES)} AS severity, {_ENUM(S.AUDIT_LEVELS)} AS level, {_ENUM(S.PERMISSION_TYPES)} AS permission, {_ENUM(S.POLICY_TYPES)} AS policy FROM range(7) t(n)",
    "dump_formats": "SELECT * FROM (VALUES ('a.RAW', 'Raw', 'Raw memory dump'), ('b.dmp', 'Crash Dump', 'Windows crash dump'), ('c.bin', 'LiME', 'LiME (Linux Memory Extractor) format'), ('d.bin', 'Raw', 'Raw memory dump'), ('e', 'Unknown', 'Unknown memory dump format')) t(path, format, description)",
    "export_json": "SELECT r_regionkey, '{\"regions\":[{\"r_name\":\"' || r_name || '\"}]}' AS value FROM region",
    "stream_windows": "SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')) AS start_us, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_sliding": "SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - to_hours(6 * k)) AS start_us, count(*) AS n FROM events, range(2) t(k) GROUP BY 1",
    "stream_histogram": "SELECT greatest(least(floor(value / 10), 11), 0)::INTEGER AS bucket, count(*) AS n FROM events GROUP BY 1",
    "stream_distinct": "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "event_sessions": """
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 2 DAY) AS end_us, count(*) AS n
FROM (SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 2 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events)) GROUP BY user_id, s""",
}
