"""Queries on file contents, with the documents as files."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import tarfile
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import content as K
from siltstone.functions import fuzzy as Z
from siltstone.functions import texts
from siltstone.operators import catalog as C
from siltstone.operators import dedupe as D
from siltstone.operators import extract as E
from siltstone.runtime import table


def _contents(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), "volume_id", F.encode("text", "UTF-8").alias("content"))


def content_digests(spark, d):
    c = F.col("content")
    return _contents(spark, d).select("file_id", K.sha256(c).alias("full"), K.head_tail_signature(c).alias("signature"), K.keyed_sha256(F.encode(F.lit("key"), "UTF-8"), c).alias("keyed"))


def content_checksums(spark, d):
    c = F.col("content")
    return _contents(spark, d).select("file_id", F.crc32(c).alias("crc32"), K.adler32(c).alias("adler32"), K.crc16(c).cast("bigint").alias("crc16"), K.fnv1a(c).alias("fnv1a"))


def content_entropy(spark, d):
    with_entropy = _contents(spark, d).select("file_id", K.entropy("content").alias("e"))
    return with_entropy.select("file_id", F.round("e", 9).alias("entropy"), K.entropy_description(F.col("e")).alias("description"))


def content_encryption(spark, d):
    c = F.col("content")
    scored = _contents(spark, d).select("file_id", "content", K.entropy("content").alias("e"), K.entropy(F.substring("content", 1, 4096)).alias("h"), K.repeated_blocks("content").alias("r"))
    guessed = scored.select("file_id", "e", K.is_compressed(c).alias("is_compressed"), K.algorithm(c, F.col("h")).alias("a"), K.cipher(c, F.col("e"), F.col("r")).alias("k"))
    sure = F.col("a.confidence") >= 0.9
    return guessed.select(
        "file_id", "is_compressed", F.col("a.name").alias("algorithm"), F.when(~sure, F.col("k.name")).alias("cipher"), (sure | (F.col("e") >= 0.8)).alias("is_encrypted"),
        F.round(F.when(sure, F.col("a.confidence")).otherwise(F.greatest("a.confidence", "k.confidence", "e")), 9).alias("confidence"),
    )


#: First bytes of test files, in hexadecimal.
_HEADS = ("504B0304140000", "1F8B08000000", "425A6839", "FD377A585A000004", "4D53434600000000", "213C617263683E0A", "526172211A0700", "377ABCAF271C", "7801730D626260", "1F9D90", "1FA0", "89504E470D0A1A0A", "FFD8FFE0", "68656C6C6F", "00", "")


def magic_bytes(spark, d):
    heads = spark.createDataFrame([(h,) for h in _HEADS], "head string")
    c = F.unhex("head")
    return heads.select("head", K.is_compressed(c).alias("is_compressed"), K.format_by_magic(c).alias("format"))


def cipher_table(spark, d):
    rows = spark.createDataFrame(list(K.CIPHERS), "name string, description string, block_size int, key_bits array<int>, modes array<string>")
    return rows.select("name", "block_size", F.explode("key_bits").alias("key_bits"), F.concat_ws(",", "modes").alias("modes"))


def duplicate_groups(spark, d):
    return D.duplicate_groups(D.duplicate_members(_contents(spark, d), F.col("content")))


def signature_candidates(spark, d):
    return D.signature_candidates(_contents(spark, d), F.col("content"))


def duplicate_plan(spark, d):
    return D.duplicate_plan(D.duplicate_members(_contents(spark, d), F.col("content")))


def catalog_duplicates(spark, d):
    return D.catalog_duplicates(C.current(table(spark, d, "file_entry"), ["size_logical", "sha256", "head_tail"]))


def fuzzy_digests(spark, d):
    return _contents(spark, d).select("file_id", Z.tlsh("content").alias("tlsh"))


def fuzzy_scores(spark, d):
    """Scores of each document against the one with the next identifier."""
    both = _contents(spark, d).select("file_id", Z.ssdeep("content").alias("s"), Z.tlsh("content").alias("t"))
    nxt = both.select((F.col("file_id") - 1).alias("file_id"), F.col("s").alias("s2"), F.col("t").alias("t2"))
    return both.join(nxt, "file_id").select("file_id", Z.ssdeep_score(F.col("s"), F.col("s2")).alias("ssdeep"), Z.tlsh_score(F.col("t"), F.col("t2")).alias("tlsh"))


def fuzzy_neighbours(spark, d):
    """Documents whose locality digest is nine tenths that of one whose id is divisible by 100."""
    digests = _contents(spark, d).select("file_id", Z.tlsh("content").alias("digest"))
    return D.alike_by_digest(digests, digests.where("file_id % 100 = 0"), 90)


def _sign_hashes(spark, d) -> DataFrame:
    """64-bit hashes: the signs of the embeddings' coordinates."""
    bits = F.aggregate(F.transform("embedding", lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), bits.alias("hash"))


def hash_neighbours(spark, d):
    """Files whose perceptual hashes differ in at most 8 of their 128 bits."""
    files = C.current(table(spark, d, "file_entry"), ["perceptual_hash"]).where("perceptual_hash is not null and hex(perceptual_hash) <> repeat('0', 32)")
    half = lambda at: F.conv(F.hex(F.substring("perceptual_hash", at, 4)), 16, 10).cast("bigint")
    word = lambda at: F.shiftleft(half(at), 32).bitwiseOR(half(at + 4))
    return D.banded_pairs(files.select(F.col("file_id").alias("id"), word(1).alias("high"), word(9).alias("low")), 8, ("high", "low"))


def lsh_bucket_sizes(spark, d):
    bucket = F.shiftrightunsigned("hash", 48)
    return _sign_hashes(spark, d).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def perceptual_hashes(spark, d):
    """Perceptual hash of each whole text that isn't empty, taken as an image 32 bytes wide."""
    return _contents(spark, d).where(F.octet_length("content") > 0).select("file_id", Z.bytes_phash("content").alias("hash"))


def content_chunks(spark, d):
    return E.chunks(_contents(spark, d), "file_id", F.col("content"), least=256, most=4096, mask=0x7F)


def chunk_set_sketches(spark, d):
    sets = content_chunks(spark, d).groupBy("file_id").agg(F.collect_set("hash").alias("hashes"))
    return sets.select("file_id", Z.set_sketch("hashes").alias("s")).select("file_id", "s.one", "s.two")


def printable_strings(spark, d):
    return E.printable_strings(_contents(spark, d), "file_id", F.col("content"), 40)


def file_slack(spark, d):
    return E.slack(C.current(table(spark, d, "file_entry"), ["size_logical"]), "size_logical").select("volume_id", "file_id", "allocated", "slack")


def keyword_counts(spark, d):
    text = F.lower("text")
    return table(spark, d, "documents").select("doc_id", texts.overlapping_count(text, "ee").alias("n")).where("n > 0")


def carved_files(spark, d):
    """Files carved from images that hold a JPEG, a PNG and a PDF among zeros."""
    filler = lambda n: F.repeat(F.lit("00"), n)
    parts = [filler(1000), F.lit("FFD8FF"), filler(5000), F.lit("FFD9"), filler(3995), F.lit("89504E470D0A1A0A"), filler(8000), F.lit("49454E44AE426082"), filler(1984), F.lit("25504446"), filler(12000), F.lit("2525454F46")]
    images = spark.range(4).select("id", F.unhex(F.concat(*parts)).alias("content"))
    return E.carve(images, "id", F.col("content"))


@F.pandas_udf(T.BinaryType())
def _zipped(content: pd.Series) -> pd.Series:
    def one(data: bytes) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("text.txt", data)
            z.writestr("folder/copy.txt", data)
        return out.getvalue()

    return content.map(one)


def archive_entries(spark, d):
    """Entries of archives that each hold a document twice."""
    archives = _contents(spark, d).select("file_id", _zipped("content").alias("content"))
    return E.archive_entries(archives, "file_id", F.col("content")).select("file_id", "format", "name", "size", "is_directory", "encrypted")


def _packed_as(style: str):
    @F.pandas_udf(T.BinaryType())
    def pack(content: pd.Series) -> pd.Series:
        def tar(data: bytes) -> bytes:
            out = io.BytesIO()
            with tarfile.open(fileobj=out, mode="w") as t:
                entry = tarfile.TarInfo("text.txt")
                entry.size = len(data)
                t.addfile(entry, io.BytesIO(data))
            return out.getvalue()

        one = {"tar": tar, "gzip": gzip.compress, "bzip2": bz2.compress, "xz": lzma.compress, "lzma": lambda data: lzma.compress(data, lzma.FORMAT_ALONE), "tar.gzip": lambda data: gzip.compress(tar(data))}
        return content.map(one[style])

    return pack


_STYLES = ("tar", "gzip", "bzip2", "xz", "lzma", "tar.gzip")


def archive_styles(spark, d):
    """Each document packed by itself in one of six formats, and listed."""
    files = _contents(spark, d).withColumn("style", F.pmod("file_id", F.lit(len(_STYLES))))
    out = None
    for k, style in enumerate(_STYLES):
        one = files.where(F.col("style") == k).select("file_id", _packed_as(style)("content").alias("content"))
        out = one if out is None else out.unionByName(one)
    return E.archive_entries(out, "file_id", F.col("content")).select("file_id", "format", "name", "size", "is_directory", "encrypted")


def archive_headers(spark, d):
    """Entries of older RAR archives, header by header, one for each part; and the
    formats that are known by their first bytes alone."""
    little = lambda n, size: F.concat(*(F.lpad(F.hex(F.shiftright(n, 8 * k).bitwiseAND(255)), 2, "0") for k in range(size)))
    parts = table(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("id"), F.encode("p_name", "UTF-8").alias("name"), (F.col("p_size").cast("bigint") * 1000).alias("size"))
    n = F.octet_length("name").cast("bigint")
    fixed = F.concat(little(F.lit(0).cast("bigint"), 4), little(F.col("size"), 4), F.lit("00"), F.lit("00" * 4), F.lit("00" * 4), F.lit("1D30"), little(n, 2), little(F.lit(0o100644).cast("bigint"), 4))
    flags = F.when(F.col("id") % 2 == 0, F.lit("0480")).otherwise(F.lit("0080"))
    block = F.concat(F.lit("0000"), F.lit("74"), flags, little(n + 32, 2), fixed, F.hex("name"))
    rar = parts.select("id", F.unhex(F.concat(F.lit("526172211A0700"), block)).alias("content"))
    marks = spark.createDataFrame([(-1, "526172211A070100"), (-2, "377ABCAF271C0004"), (-3, "28B52FFD00000000"), (-4, "04224D1800000000")], "id long, head string").select("id", F.unhex("head").alias("content"))
    return E.archive_entries(rar.unionByName(marks), "id", F.col("content")).select("id", "format", "name", "size", "encrypted")


def slack_keywords(spark, d):
    """A keyword behind the last byte of every part's file."""
    files = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 4000 + 1).alias("size"))
    image = F.encode(F.rpad(F.concat(F.repeat(F.lit("k"), F.col("size").cast("int")), F.lit("keykey")), 4096, "-"), "UTF-8")
    return E.search_slack(files.withColumn("content", image), "id", F.col("content"), F.col("size"), "key")


def image_formats(spark, d):
    """Disk image and archive formats by the names of the catalog's files."""
    files = C.current(table(spark, d, "file_entry"), ["full_path"]).where("full_path is not null")
    return files.groupBy(K.image_format(F.col("full_path"), F.unhex(F.lit("00"))).alias("image"), K.archive_by_extension(F.col("full_path")).alias("archive")).agg(F.count(F.lit(1)).alias("n"))


def archive_contents(spark, d):
    archives = _contents(spark, d).select("file_id", _zipped("content").alias("content"))
    return E.extract_entries(archives, "file_id", F.col("content"), "folder/copy.txt").select("file_id", F.sha2("data", 256).alias("digest"))


_BYTES = "(SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents)"
_ENTROPY = f"SELECT doc_id, -sum(p * log2(p)) / 8 AS e FROM (SELECT doc_id, count(*) / sum(count(*)) OVER (PARTITION BY doc_id) AS p FROM {_BYTES} GROUP BY doc_id, b) GROUP BY doc_id"
_SIGNATURE = "sha256(unhex(hex(encode(text))[1:32768] || CASE WHEN strlen(text) > 32768 THEN right(hex(encode(text)), 32768) ELSE '' END))"
_MEMBERS = """
WITH s AS (SELECT doc_id, volume_id, strlen(text) AS size, sha256(text) AS digest FROM documents WHERE strlen(text) >= 1),
m AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY size, digest) AS n FROM s) WHERE n > 1)
"""
_HASH = "(SELECT vec_id AS id, list_sum(list_transform(embedding, lambda x, i: CASE WHEN x > 0 THEN CAST(pow(2::HUGEINT, i - 1) AS HUGEINT) ELSE 0::HUGEINT END))::UBIGINT AS h FROM embeddings)"

def _crc_table() -> str:
    """Table of the crc32 steps, worked out from its polynomial."""
    values = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ 0xEDB88320 if n & 1 else n >> 1
        values.append(n)
    return "[" + ", ".join(map(str, values)) + "]::BIGINT[]"


_CODES = "list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)"

QUERIES = {
    f.__name__: f
    for f in (
        content_digests, content_checksums, content_entropy, content_encryption, magic_bytes, cipher_table, duplicate_groups, signature_candidates, duplicate_plan, catalog_duplicates, fuzzy_digests, fuzzy_scores, fuzzy_neighbours, hash_neighbours,
        lsh_bucket_sizes, perceptual_hashes, content_chunks, chunk_set_sketches, printable_strings, file_slack, keyword_counts, carved_files, archive_entries, archive_styles, archive_headers, archive_contents, slack_keywords, image_formats,
    )
}

SQL = {
    "content_digests": f"SELECT doc_id AS file_id, sha256(text) AS \"full\", {_SIGNATURE} AS signature, sha256('key' || text) AS keyed FROM documents",
    "content_entropy": f"""
SELECT d.doc_id AS file_id, round(coalesce(e, 0), 9) AS entropy,
  CASE WHEN e >= 0.9 THEN 'Highly random - likely encrypted or compressed' WHEN e >= 0.8 THEN 'Moderately random - possibly encrypted or compressed' WHEN e >= 0.7 THEN 'Somewhat random - contains some structured data'
    WHEN e >= 0.5 THEN 'Moderately structured - likely unencrypted data' ELSE 'Highly structured - definitely unencrypted data' END AS description
FROM documents d LEFT JOIN ({_ENTROPY}) x ON d.doc_id = x.doc_id""",
    "content_checksums": f"""
SELECT doc_id AS file_id, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, ({_crc_table()})[(xor(c, x) & 255) + 1])), 4294967295)::BIGINT AS crc32,
  ((n + list_sum(list_transform(b, lambda x, i: (n - i + 1) * x))::BIGINT) % 65521) * 65536 + (1 + list_sum(b)::BIGINT) % 65521 AS adler32,
  list_reduce(list_prepend(0, b), lambda c, x: xor(c >> 8, ({K.crc16_table().tolist()}::BIGINT[])[(xor(c, x) & 255) + 1]))::BIGINT AS crc16,
  list_reduce(list_prepend(2166136261, b), lambda c, x: xor(c, x) * 16777619 & 4294967295)::BIGINT AS fnv1a
FROM (SELECT doc_id, {_CODES} AS b, strlen(text) AS n FROM documents)""",
    "archive_styles": "SELECT doc_id AS file_id, CASE doc_id % 6 WHEN 0 THEN 'tar' WHEN 1 THEN 'gzip' WHEN 2 THEN 'bzip2' WHEN 3 THEN 'xz' WHEN 4 THEN 'lzma' ELSE 'tar.gzip' END AS format, CASE WHEN doc_id % 6 IN (0, 5) THEN 'text.txt' END AS name, strlen(text) AS size, false AS is_directory, false AS encrypted FROM documents",
    "archive_headers": "SELECT p_partkey::BIGINT AS id, 'rar' AS format, p_name AS name, p_size::BIGINT * 1000 AS size, p_partkey % 2 = 0 AS encrypted FROM part UNION ALL SELECT * FROM (VALUES (-1, 'rar', NULL, NULL, NULL), (-2, '7z', NULL, NULL, NULL), (-3, 'zstd', NULL, NULL, NULL), (-4, 'lz4', NULL, NULL, NULL)) t",
    "slack_keywords": "SELECT p_partkey AS id, (p_partkey % 4000 + 1 + k)::BIGINT AS address FROM part, (VALUES (0), (3)) t(k) WHERE p_partkey % 4000 + 1 + k + 3 <= 4096",
    "image_formats": """
SELECT CASE WHEN e = '.e01' THEN 'EWF' WHEN e = '.vmdk' THEN 'VMDK' WHEN e IN ('.vhd', '.vhdx') THEN 'VHD' WHEN e = '.qcow2' THEN 'QCOW2' ELSE 'RAW' END AS image,
  CASE WHEN regexp_matches(p, '\\.(zip|jar|docx|xlsx)$') THEN 'zip' WHEN p LIKE '%.tar' THEN 'tar' WHEN p LIKE '%.gz' OR p LIKE '%.tgz' THEN 'gzip' WHEN p LIKE '%.bz2' THEN 'bzip2' WHEN p LIKE '%.xz' THEN 'xz' WHEN p LIKE '%.lzma' THEN 'lzma' WHEN p LIKE '%.lz4' THEN 'lz4' WHEN p LIKE '%.zst' THEN 'zstd' WHEN p LIKE '%.rar' THEN 'rar' WHEN p LIKE '%.7z' THEN '7z' END AS archive, count(*) AS n
FROM (SELECT lower(full_path) AS p, regexp_extract(lower(full_path), '(\\.[^.]*)$', 1) AS e FROM (SELECT * FROM file_entry QUALIFY row_number() OVER (PARTITION BY volume_id, file_id ORDER BY seq DESC) = 1) WHERE NOT deleted AND full_path IS NOT NULL) GROUP BY 1, 2""",
    "magic_bytes": "SELECT head, regexp_matches(head, '^(504B0304|1F8B|425A68|FD377A585A00|4D534346|213C617263683E0A|526172211A07|377ABCAF271C|7801730D626260|1F9D|1FA0)') AS is_compressed,\n  CASE WHEN head LIKE '504B0304%' THEN 'zip' WHEN head LIKE '1F8B%' THEN 'gzip' WHEN head LIKE '425A68%' THEN 'bzip2' WHEN head LIKE 'FD377A585A00%' THEN 'xz' WHEN head LIKE '4D534346%' THEN 'cab' WHEN head LIKE '213C617263683E0A%' THEN 'ar' WHEN head LIKE '526172211A07%' THEN 'rar' WHEN head LIKE '377ABCAF271C%' THEN '7z' WHEN head LIKE '1F9D%' OR head LIKE '1FA0%' THEN 'compress' WHEN head LIKE '89504E470D0A1A0A%' THEN 'png' WHEN head LIKE 'FFD8FF%' THEN 'jpg' END AS format\nFROM (VALUES " + ", ".join(f"('{h}')" for h in _HEADS) + ") t(head)",
    "cipher_table": "SELECT name, block_size, unnest(key_bits)::INTEGER AS key_bits, modes FROM (VALUES "
    + ", ".join(f"('{n}', {b}, [{', '.join(map(str, k))}], '{','.join(m)}')" for n, _, b, k, m in K.CIPHERS)
    + ") t(name, block_size, key_bits, modes)",
    "duplicate_groups": _MEMBERS + "SELECT digest, size, count(*) AS n, (count(*) - 1) * size AS savings, min(volume_id) = max(volume_id) AS same_volume FROM m GROUP BY digest, size",
    "duplicate_plan": _MEMBERS + """
SELECT doc_id AS file_id, digest, CASE WHEN doc_id = k THEN 'keep' WHEN v0 <> v1 THEN 'recycle' ELSE 'hardlink' END AS action, CASE WHEN doc_id = k THEN 0 ELSE size END AS bytes
FROM (SELECT *, min(doc_id) OVER w AS k, min(volume_id) OVER w AS v0, max(volume_id) OVER w AS v1 FROM m WINDOW w AS (PARTITION BY digest, size))""",
    "signature_candidates": f"SELECT strlen(text) AS size, {_SIGNATURE} AS signature, count(*) AS n FROM documents WHERE strlen(text) >= 1 GROUP BY 1, 2 HAVING count(*) > 1",
    "catalog_duplicates": "SELECT size_logical AS size, lower(hex(coalesce(sha256, head_tail))) AS digest, count(*) AS n, (count(*) - 1) * size_logical AS savings FROM (SELECT * FROM file_entry QUALIFY row_number() OVER (PARTITION BY volume_id, file_id ORDER BY seq DESC) = 1) WHERE NOT deleted AND size_logical > 0 AND coalesce(sha256, head_tail) IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1",
    "fuzzy_digests": f"""
WITH h AS (SELECT doc_id, ('0x' || b)::INTEGER % 128 AS k, count(*) AS n FROM {_BYTES} GROUP BY 1, 2),
b AS (SELECT d.doc_id, i, least(coalesce(n, 0), 255) AS n FROM documents d CROSS JOIN range(8) t(i) LEFT JOIN h ON h.doc_id = d.doc_id AND h.k = i),
g AS (SELECT doc_id, string_agg(printf('%02x', n::INTEGER), '' ORDER BY i) AS s FROM b GROUP BY 1)
SELECT d.doc_id AS file_id, CASE WHEN strlen(text) >= 50 THEN printf('%02x', (strlen(text) % 256)::INTEGER)
  || CASE WHEN strlen(text) <= 256 THEN '0' WHEN strlen(text) <= 1024 THEN '1' WHEN strlen(text) <= 4096 THEN '2' WHEN strlen(text) <= 16384 THEN '3' WHEN strlen(text) <= 65536 THEN '4' WHEN strlen(text) <= 262144 THEN '5' WHEN strlen(text) <= 1048576 THEN '6' ELSE '7' END
  || '0123' || s END AS tlsh FROM documents d JOIN g ON d.doc_id = g.doc_id""",
    "hash_neighbours": """
WITH h AS (SELECT file_id AS id, CAST('0x' || hex(perceptual_hash)[1:16] AS UBIGINT) AS h, CAST('0x' || hex(perceptual_hash)[17:32] AS UBIGINT) AS l FROM (SELECT * FROM file_entry QUALIFY row_number() OVER (PARTITION BY volume_id, file_id ORDER BY seq DESC) = 1)
  WHERE NOT deleted AND perceptual_hash IS NOT NULL AND hex(perceptual_hash) <> repeat('0', 32)), c AS (SELECT h, l, min(id) AS id FROM h GROUP BY h, l)
SELECT a.id AS a, b.id AS b, (bit_count(xor(a.h, b.h)) + bit_count(xor(a.l, b.l)))::INTEGER AS distance FROM c a JOIN c b ON a.id < b.id AND bit_count(xor(a.h, b.h)) + bit_count(xor(a.l, b.l)) <= 8
UNION ALL SELECT DISTINCT c.id, h.id, 0 FROM h JOIN c ON h.h = c.h AND h.l = c.l AND h.id > c.id""",
    "lsh_bucket_sizes": f"SELECT (h >> 48)::BIGINT AS bucket, count(*) AS n FROM {_HASH} GROUP BY 1",
    "file_slack": "SELECT volume_id, file_id, (size_logical + 4095) // 4096 * 4096 AS allocated, (size_logical + 4095) // 4096 * 4096 - size_logical AS slack FROM (SELECT * FROM file_entry QUALIFY row_number() OVER (PARTITION BY volume_id, file_id ORDER BY seq DESC) = 1) WHERE NOT deleted AND size_logical % 4096 > 0",
    "keyword_counts": "SELECT doc_id, n FROM (SELECT doc_id, len(list_filter(range(1, length(text)), lambda i: lower(text)[i:i+1] = 'ee'))::INTEGER AS n FROM documents) WHERE n > 0",
    "carved_files": "SELECT id, \"offset\", size, extension FROM range(4) t(id), (VALUES (1000::BIGINT, 5005::BIGINT, 'jpg'), (10000, 8016, 'png'), (20000, 12009, 'pdf')) f(\"offset\", size, extension)",
    "archive_entries": "SELECT doc_id AS file_id, 'zip' AS format, name, strlen(text) AS size, false AS is_directory, false AS encrypted FROM documents, (VALUES ('text.txt'), ('folder/copy.txt')) t(name)",
    "archive_contents": "SELECT doc_id AS file_id, sha256(text) AS digest FROM documents",
}
SQL["fuzzy_neighbours"] = f"""
WITH t AS (SELECT * FROM ({SQL["fuzzy_digests"]}) WHERE tlsh IS NOT NULL)
SELECT a.file_id AS target_id, b.file_id, score FROM t a JOIN t b ON a.file_id % 100 = 0 AND a.file_id <> b.file_id AND length(a.tlsh) = length(b.tlsh),
  LATERAL (SELECT CASE WHEN a.tlsh = b.tlsh THEN 100 ELSE len(list_filter(range(1, length(a.tlsh) + 1), lambda i: a.tlsh[i] = b.tlsh[i])) * 100 // length(a.tlsh) END::INTEGER AS score) WHERE score >= 90"""
