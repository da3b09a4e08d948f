"""Queries of the operators for language-model data, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.contamination import leaked_items
from siltstone.llm.history import History, accept_batches, accept_catalog, duplicates_of_history
from siltstone.llm.language import languages_not_named
from siltstone.llm.neighbours import expanded_pairs, nearest_of, recall, similar_vectors
from siltstone.llm.packing import audit, pack_documents, split_documents
from siltstone.llm.survivor import duplicate_group_records, duplicate_group_survivors
from siltstone.llm.topn import top_n_per_group
from siltstone.operators.hierarchy import current_rows
from siltstone.runtime import Scratch, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = current_rows(table(spark, sf_dir, "file_entry"), ["volume_id", "file_id"], "seq", ["deleted", "size_logical"]).where("not deleted")
    return top_n_per_group(files, "volume_id", "size_logical", "file_id", 10, unique=True).select("volume_id", "rank_no", "file_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = table(spark, sf_dir, "file_entry").select("size_logical", "sha256", "head_tail")
    return duplicates_of_history(catalog, table(spark, sf_dir, "incoming_entry"))


def p4_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of p4_found from two runs: the second opens the history that the
    first left in a folder, and reads neither the catalog nor the first batches."""
    catalog = table(spark, sf_dir, "file_entry").select("size_logical", "sha256", "head_tail")
    incoming = table(spark, sf_dir, "incoming_entry")
    ends = incoming.agg(F.min("entry_id").alias("a"), F.max("entry_id").alias("b")).first()
    cut = ((ends["a"] or 0) + (ends["b"] or 0)) // 2
    path = f"{Scratch(spark, 'kept').root}/history"
    first = History(spark, path)
    accept_catalog(first, catalog)
    early = accept_batches(first, incoming.where(F.col("entry_id") <= cut))
    first.close()
    second = History(spark, path)
    late = accept_batches(second, incoming.where(F.col("entry_id") > cut))
    second.close()
    return early.unionByName(late)


def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = current_rows(table(spark, sf_dir, "file_entry"), ["volume_id", "file_id"], "seq", ["deleted", "perceptual_hash"])
    return files.where("not deleted and perceptual_hash is not null").select(F.col("file_id").alias("id"), F.col("perceptual_hash").alias("vector"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = expanded_pairs(*similar_vectors(_hashes(spark, sf_dir)))
    return pairs.select(F.col("id_a").alias("file_id_a"), F.col("id_b").alias("file_id_b"))


def p5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest hashes, however far, of each file whose id is divisible by 100."""
    rows = Scratch(spark, "hashes").write(_hashes(spark, sf_dir), "rows")
    return nearest_of(rows, rows.where("id % 100 = 0"), 10)


def p5_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of p5_nearest, and whether nine in ten of what it finds is as near as
    what brute force finds."""
    rows = Scratch(spark, "hashes").write(_hashes(spark, sf_dir), "rows")
    asked = rows.where("id % 100 = 0")
    return recall(rows, asked, nearest_of(rows, asked, 10), 10).select("queries", (F.col("recall") >= 0.9).alias("enough"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "scan_host")
    return duplicate_group_survivors(table(spark, sf_dir, "duplicate_group"), hosts, hosts.count())


def p7_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record that each group's surviving values make."""
    hosts = table(spark, sf_dir, "scan_host")
    got = duplicate_group_records(table(spark, sf_dir, "duplicate_group"), hosts, hosts.count())
    return got.select("group_id", "members", F.col("base").alias("base_file_id"), "complete", "full_path", F.unix_micros("last_write_time").alias("last_write_us"), "owner_name", "mode")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity = table(spark, sf_dir, "container_spec").agg(F.max("capacity_tokens")).first()[0]
    placements, _, _ = pack_documents(table(spark, sf_dir, "documents"), capacity)
    return split_documents(placements)


def p8_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row that checks the packing of all documents against capacity, texts and bound."""
    capacity = table(spark, sf_dir, "container_spec").agg(F.max("capacity_tokens")).first()[0]
    placements, containers, bound = pack_documents(table(spark, sf_dir, "documents"), capacity)
    return audit(placements, capacity, containers, bound)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_item"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages_not_named(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


QUERIES = {f.__name__: f for f in (p2_found, p4_found, p4_resumed, p5_found, p5_nearest, p5_recall, p7_found, p7_records, p8_found, p8_audit, p9_found, p10_found)}

_CURRENT = "SELECT * FROM file_entry QUALIFY row_number() OVER (PARTITION BY volume_id, file_id ORDER BY seq DESC) = 1"

_MEMBER = """WITH member AS (
  SELECT DISTINCT group_id, f.file_id AS file_id, h.trust_rank,
    CASE WHEN year(f.last_write_time) BETWEEN 1980 AND 2025 THEN f.last_write_time END AS t,
    CASE WHEN lower(trim(f.full_path)) NOT IN ('', '?', '-', 'n/a', 'unknown', '(unknown)', '(null)') THEN f.full_path END AS p,
    CASE WHEN lower(trim(f.owner_name)) NOT IN ('', '?', '-', 'n/a', 'unknown', '(unknown)', '(null)') THEN f.owner_name END AS o,
    nullif(f.mode, 0) AS m
  FROM (SELECT group_id, unnest(files) AS f FROM duplicate_group) LEFT JOIN scan_host h ON f.host_id = h.host_id
"""

#: Words without case, accents and punctuation.
_WORDS = "string_split(trim(regexp_replace(lower(strip_accents(regexp_replace(text, '(\\p{L}|\\d)[''’ʼ`´](\\p{L}|\\d)', '\\1\\2', 'g'))), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ')"

SQL = {
    # A token of these texts has 2 to 5 characters, and none is near the limit.
    "p8_found": "SELECT doc_id FROM documents, (SELECT max(capacity_tokens) AS c FROM container_spec) WHERE length(text) > 5 * c",
    # With one changed word in twelve, six in a row before or behind it are the item's.
    "p9_found": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM eval_item),
passage AS (SELECT item_id, w[p:p+11] AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS p FROM i)),
half AS (SELECT item_id, g, 0 AS at, array_to_string(g[1:6], ' ') AS h FROM passage UNION ALL SELECT item_id, g, 6, array_to_string(g[7:12], ' ') FROM passage),
six AS (SELECT doc_id, p, array_to_string(w[p:p+5], ' ') AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 4)) AS p FROM d)),
near AS (SELECT s.doc_id, x.item_id, x.g, s.p - x.at AS start FROM half x JOIN six s ON x.h = s.h)
SELECT DISTINCT item_id, n.doc_id FROM near n JOIN d ON d.doc_id = n.doc_id
WHERE start >= 1 AND start + 11 <= len(w) AND len(list_filter(range(1, 13), lambda k: g[k] <> w[start + k - 1])) <= 1""",
    "p7_records": f"""
{_MEMBER}), scored AS (SELECT *, (p IS NOT NULL)::INTEGER + (t IS NOT NULL)::INTEGER + (o IS NOT NULL)::INTEGER + (m IS NOT NULL)::INTEGER AS c FROM member)
SELECT group_id, count(DISTINCT file_id) AS members, list(file_id ORDER BY c DESC, trust_rank NULLS LAST, t DESC NULLS LAST, file_id)[1] AS base_file_id, max(c) AS complete,
  list(p ORDER BY trust_rank NULLS LAST, t DESC NULLS LAST, file_id) FILTER (WHERE p IS NOT NULL)[1] AS full_path, epoch_us(list(t ORDER BY trust_rank NULLS LAST, t DESC NULLS LAST, file_id) FILTER (WHERE t IS NOT NULL)[1]) AS last_write_us,
  list(o ORDER BY trust_rank NULLS LAST, t DESC NULLS LAST, file_id) FILTER (WHERE o IS NOT NULL)[1] AS owner_name, list(m ORDER BY trust_rank NULLS LAST, t DESC NULLS LAST, file_id) FILTER (WHERE m IS NOT NULL)[1] AS mode
FROM scored GROUP BY group_id""",
    "p2_found": f"""
SELECT * FROM (
  SELECT volume_id, CAST(row_number() OVER (PARTITION BY volume_id ORDER BY size_logical DESC, file_id) AS INTEGER) AS rank_no, file_id
  FROM ({_CURRENT}) WHERE NOT deleted AND size_logical IS NOT NULL
) WHERE rank_no <= 10
""",
    "p8_audit": "SELECT count(DISTINCT doc_id) AS documents, 0::BIGINT AS overfull, 0::BIGINT AS misplaced, 0::BIGINT AS split_short, true AS counted, true AS near_bound FROM documents",
    "p4_found": """
WITH old AS (
  SELECT DISTINCT -1 AS pos, size_logical AS size, lower(hex(sha256)) AS sha, lower(hex(head_tail)) AS ht FROM file_entry WHERE size_logical >= 1024
), new AS (
  SELECT DISTINCT entry_id AS pos, size_logical AS size,
    CASE WHEN length(sha256) = 44 THEN lower(hex(from_base64(sha256))) ELSE lower(replace(replace(trim(sha256), 'sha256:', ''), ':', '')) END AS sha,
    lower(replace(trim(head_tail), ':', '')) AS ht
  FROM incoming_entry WHERE size_logical >= 1024
), every AS (
  SELECT * FROM old UNION ALL SELECT * FROM new
), exact AS (
  SELECT n.pos FROM new n JOIN every e ON n.sha = e.sha AND n.size = e.size AND e.pos < n.pos
  UNION SELECT n.pos FROM new n JOIN every e ON n.ht = e.ht AND n.size = e.size AND e.pos < n.pos AND (n.sha IS NULL OR e.sha IS NULL)
), near AS (
  SELECT DISTINCT n.pos FROM new n JOIN every e ON n.ht = e.ht AND e.pos < n.pos AND abs(n.size - e.size) * 100 <= greatest(n.size, e.size)
)
SELECT pos AS entry_id, 'exact' AS kind FROM exact
UNION ALL SELECT pos, 'near' FROM near WHERE pos NOT IN (SELECT pos FROM exact)
""",
    "p5_found": f"""
WITH f AS (
  SELECT file_id, CAST('0x' || hex(perceptual_hash)[1:16] AS UBIGINT) AS hi, CAST('0x' || hex(perceptual_hash)[17:32] AS UBIGINT) AS lo
  FROM ({_CURRENT}) WHERE NOT deleted AND perceptual_hash IS NOT NULL
)
SELECT a.file_id AS file_id_a, b.file_id AS file_id_b
FROM (SELECT * FROM f WHERE hi <> 0 OR lo <> 0) a JOIN (SELECT * FROM f WHERE hi <> 0 OR lo <> 0) b ON a.file_id < b.file_id
WHERE bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 12
""",
    "p5_recall": f"SELECT count(*) AS queries, true AS enough FROM ({_CURRENT}) WHERE NOT deleted AND file_id % 100 = 0 AND hex(perceptual_hash) <> repeat('0', 32)",
    "p7_found": f"""
{_MEMBER}), told AS (
  SELECT group_id, file_id, trust_rank, t, 'full_path' AS field_name FROM member WHERE p IS NOT NULL
  UNION ALL SELECT group_id, file_id, trust_rank, t, 'last_write_time' FROM member WHERE t IS NOT NULL
  UNION ALL SELECT group_id, file_id, trust_rank, t, 'owner_name' FROM member WHERE o IS NOT NULL
  UNION ALL SELECT group_id, file_id, trust_rank, t, 'mode' FROM member WHERE m IS NOT NULL
)
SELECT group_id, field_name, file_id FROM told
QUALIFY row_number() OVER (PARTITION BY group_id, field_name ORDER BY trust_rank NULLS LAST, t DESC NULLS LAST, file_id) = 1
""",
}
SQL["p4_resumed"] = SQL["p4_found"]
