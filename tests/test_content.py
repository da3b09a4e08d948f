"""Digests, entropy, magic bytes, carving, archives, chunks, fuzzy hashes."""

import bz2
import gzip
import hashlib
import io
import lzma
import random
import tarfile
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import content as K
from siltstone.functions import fuzzy as Z
from siltstone.functions import texts
from siltstone.operators import dedupe as D
from siltstone.operators import extract as E
from siltstone.plans import content as P


def frame(spark, datas):
    return spark.createDataFrame([(i, None if d is None else bytearray(d)) for i, d in enumerate(datas)], "id long, content binary")


def values(df, column):
    return [r[0] for r in df.orderBy("id").select(column).collect()]


def test_standard_digest_vectors(spark):
    block = b"abcdbcdecdefdefgefghfghighijhijkijkljklmklmnlmnomnopnopq"
    got = values(frame(spark, [b"abc", b"", block, None]), K.sha256(F.col("content")))
    assert got == [hashlib.sha256(x).hexdigest() for x in (b"abc", b"", block)] + [None]


def test_head_tail_signature_covers_edges_only(spark):
    long = bytes(random.Random(1).randbytes(50_000))
    middle = long[:20_000] + b"\0" * 100 + long[20_100:]
    short, tail = b"x" * 100, long[:-1] + b"!"
    a, b, c, d, e = values(frame(spark, [long, middle, tail, short, long[:32_768]]), K.head_tail_signature(F.col("content")))
    assert a == b == hashlib.sha256(long[:16384] + long[-16384:]).hexdigest() and a != c
    assert d == hashlib.sha256(short).hexdigest() and e == hashlib.sha256(long[:16384]).hexdigest()


def test_checksums(spark):
    df = frame(spark, [b"123456789", b"", None])
    assert values(df, F.crc32("content")) == [0xCBF43926, 0, None]
    assert values(df, K.adler32("content")) == [zlib.adler32(b"123456789"), 1, None]
    assert values(df, K.fnv1a("content")) == [0xBB86B11C, 0x811C9DC5, None]
    assert values(df, K.crc16("content")) == [0xBB3D, 0, None]


def test_entropy_and_guesses(spark):
    noise = random.Random(2).randbytes(65_536)
    df = frame(spark, [b"aaaaaaaa", bytes(range(256)), b"", None, noise]).withColumn("e", K.entropy("content"))
    got = values(df, "e")
    assert got[:4] == [0.0, 1.0, 0.0, None] and got[4] > 0.99
    heads = [b"-----BEGIN PGP MESSAGE-----", b"TDEF", b"LUKS\xba\xbe\0\1", b"LUKS", b"VERA1234", b"-FVE-FS-", b"\0\0\0\0\1\0\0\0" + b"x" * 8, noise[:4096], b"plain words"]
    df = frame(spark, heads).withColumn("e", K.entropy("content")).withColumn("r", K.repeated_blocks("content"))
    names = [r.name for r in values(df, K.algorithm(F.col("content"), F.col("e")))]
    assert names == ["PGP (ASCII-Armored)", "Telegram Desktop Encrypted File", "LUKS", "None Detected", "VeraCrypt", "BitLocker", "Encrypted Container", "Symmetric Encryption", "None Detected"]
    blocks = frame(spark, [noise[:32768] * 2, noise, b"\0" * 500 + b"x" * 500, b"short"]).withColumn("e", K.entropy("content")).withColumn("r", K.repeated_blocks("content"))
    assert [r.name for r in values(blocks, K.cipher(F.col("content"), F.col("e"), F.col("r")))] == ["ECB", "AES", "Weak Cipher/Plaintext", "Unknown"]


def test_formats(spark):
    got = values(frame(spark, [b"PK\3\4xx", b"\x1f\x8b\x08", b"BZh9", b"Rar!\x1a\x07\x00", b"7z\xbc\xaf\x27\x1c", b"text", b"", b"\0" * 257 + b"ustar"]), K.format_by_magic(F.col("content")))
    assert got == ["zip", "gzip", "bzip2", "rar", "7z", None, None, "tar"]
    names = spark.createDataFrame([("a.E01", b""), ("b.vmdk", b""), ("c.vhd", b""), ("d.qcow2", b""), ("e.raw", b""), ("f", b"QFI\xfb\0\0\0\2"), ("g", b"")], "p string, content binary")
    assert [r[0] for r in names.orderBy("p").select(K.image_format(F.col("p"), F.col("content"))).collect()] == ["EWF", "VMDK", "VHD", "QCOW2", "RAW", "QCOW2", "RAW"]


@pytest.mark.parametrize(("packed", "unpacked", "want"), [(100, 1000, 0.9), (500, 1000, 0.5), (900, 1000, 0.1), (1000, 1000, 0.0), (1500, 1000, 0.0), (0, 1000, 1.0), (1000, 0, 0.0)])
def test_compression_ratio(spark, packed, unpacked, want):
    assert spark.range(1).select(texts.compression_ratio(F.lit(packed), F.lit(unpacked))).first()[0] == pytest.approx(want)


def test_carving(spark):
    image = bytearray(1 << 20)
    for at, head, end, foot in ((1000, b"\xff\xd8\xff", 6003, b"\xff\xd9"), (10_000, b"\x89PNG\r\n\x1a\n", 18_008, b"IEND\xaeB`\x82"), (20_000, b"%PDF", 32_004, b"%%EOF")):
        image[at : at + len(head)] = head
        image[end : end + len(foot)] = foot
    rows = E.carve(frame(spark, [bytes(image), b"", None, b"BM"]), "id", F.col("content"), with_data=True).orderBy("offset").collect()
    assert [(r.id, r.offset, r.size, r.extension) for r in rows] == [(0, 1000, 5005, "jpg"), (0, 10_000, 8016, "png"), (0, 20_000, 12_009, "pdf")]
    assert rows[0].name == "carved_000003e8_0000138d.jpg" and len(rows[0].data) == 5005


def test_archives(spark):
    z, t = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(z, "w", zipfile.ZIP_DEFLATED) as f:
        f.writestr("test.txt", b"hello" * 10)
        f.writestr("d/", b"")
    with tarfile.open(fileobj=t, mode="w") as f:
        e = tarfile.TarInfo("test.txt")
        e.size, e.mtime = 5, 99
        f.addfile(e, io.BytesIO(b"hello"))
    tar = t.getvalue()
    datas = [z.getvalue(), tar, gzip.compress(b"abc"), bz2.compress(b"abc"), lzma.compress(b"abc"), lzma.compress(b"abc", format=lzma.FORMAT_ALONE), gzip.compress(tar), b"7z\xbc\xaf\x27\x1c", b"PK\3\4 broken", b"\x1f\x8b broken", b"no archive", b"", None]
    rows = {(r.id, r.format, r.name, r.size) for r in E.archive_entries(frame(spark, datas), "id", F.col("content")).collect()}
    assert rows == {(0, "zip", "test.txt", 50), (0, "zip", "d/", 0), (1, "tar", "test.txt", 5), (2, "gzip", None, 3), (3, "bzip2", None, 3), (4, "xz", None, 3), (5, "lzma", None, 3), (6, "tar.gzip", "test.txt", 5), (7, "7z", None, None)}
    got = {(r.id, bytes(r.data)) for r in E.extract_entries(frame(spark, datas), "id", F.col("content")).collect()}
    assert {(0, b"hello" * 10), (1, b"hello"), (2, b"abc"), (3, b"abc"), (4, b"abc"), (5, b"abc")} <= got


def test_chunks_cover_all_but_a_short_rest():
    data = random.Random(3).randbytes(100_000)
    spans = list(E.chunk_spans(data, least=1000, most=5000, mask=0x3FF))
    assert [s[0] for s in spans[1:]] == [s[0] + s[1] for s in spans[:-1]] and spans[0][0] == 0
    assert all(1000 <= n <= 5000 for _, n, _ in spans) and len(data) - sum(n for _, n, _ in spans) < 1000
    moved = list(E.chunk_spans(b"inserted" + data, least=1000, most=5000, mask=0x3FF))
    assert len({h for *_, h in spans} & {h for *_, h in moved}) > len(spans) / 3


def test_printable_strings(spark):
    data = b"\0hello world\1\2abc\3this has malware inside\xff" + b"z" * 50
    rows = E.printable_strings(frame(spark, [data, b"", None]), "id", F.col("content"), 5).orderBy("address").collect()
    assert [(r.address, r.text, r.suspicious) for r in rows] == [(1, "hello world", False), (18, "this has malware inside", True), (42, "z" * 50, False)]


def test_slack(spark):
    rows = E.slack(spark.createDataFrame([(100,), (2000,), (10_000,), (4096,), (0,)], "size long"), "size").collect()
    assert [r.slack for r in rows] == [3996, 2096, 2288]


def ssdeep_by_hand(data):
    """The same digest, byte by byte."""
    size = Z.block_size(len(data))
    one = two = three = s1 = s2 = 0
    h1 = h2 = ""
    for c in data:
        if len(h1) >= 64:
            break
        one = ((one << 4 | one >> 28) + c) & 0xFFFFFFFF
        two = (two + c + one) & 0xFFFFFFFF
        three = ((three << 1) + c) & 0xFFFFFFFF
        rolled = (one + two + three) & 0xFFFFFFFF
        if rolled % size == size - 1 and len(h1) < 63:
            h1, s1 = h1 + Z._ALPHABET[s1 % 64], 0
        if rolled % (2 * size) == 2 * size - 1 and len(h2) < 63:
            h2, s2 = h2 + Z._ALPHABET[s2 % 64], 0
        s1, s2 = (s1 * 256 + c) % 0xFFFFFFFF, (s2 * 256 + c) % 0xFFFFFFFF
    return f"{size}:{h1 + (Z._ALPHABET[s1 % 64] if s1 else '')}:{h2 + (Z._ALPHABET[s2 % 64] if s2 else '')}"


@pytest.mark.parametrize("n", [1, 10, 100, 1000, 5000])
def test_ssdeep(n):
    data = random.Random(n).randbytes(n)
    assert Z.ssdeep_of(data) == ssdeep_by_hand(data)


def test_fuzzy_scores(spark):
    base = b"The quick brown fox jumps over the lazy dog. " * 20
    df = frame(spark, [base, base, base + b"more", b"tiny", b"", None])
    s, t = values(df, Z.ssdeep("content")), values(df, Z.tlsh("content"))
    assert s[0] == s[1] and s[4] is s[5] is None and t[3] is t[4] is t[5] is None and len(t[0]) == 23
    pairs = spark.createDataFrame([(s[0], s[1], t[0], t[1]), (s[0], s[2], t[0], t[2]), (s[0], s[3], t[0], t[0][:-1])], "a string, b string, c string, d string")
    got = [tuple(r) for r in pairs.select(Z.ssdeep_score(F.col("a"), F.col("b")), Z.tlsh_score(F.col("c"), F.col("d"))).collect()]
    assert got[0] == (100, 100) and got[1][0] == 50 and 0 < got[1][1] < 100 and got[2] == (0, 0)


def test_perceptual_hash_keeps_what_an_eye_keeps():
    rng = np.random.default_rng(1)
    image = np.kron(rng.integers(0, 256, (8, 8)), np.ones((16, 16))).astype(np.uint8)
    brighter = np.clip(image.astype(int) * 0.8 + 20, 0, 255).astype(np.uint8)
    other = np.kron(rng.integers(0, 256, (8, 8)), np.ones((16, 16))).astype(np.uint8)
    h, b, o = map(Z.phash_of, (image, brighter, other))
    assert (h ^ b).bit_count() <= 5 < 15 < (h ^ o).bit_count() and 30 <= h.bit_count() <= 32
    assert Z.phash_of(np.repeat(image[..., None], 3, axis=2)) == pytest.approx(h, abs=2**63)


def test_set_sketches(spark):
    df = spark.createDataFrame([(0, [5, 7, -3]), (1, [7, 5, -3, 5]), (2, [9]), (3, []), (4, None)], "id long, h array<long>").withColumn("s", Z.set_sketch("h"))
    a, b, c, d, e = values(df, "s")
    assert a == b != c and d.one is None is e.one
    want = [min(v * m % 2**64 for v in (5, 7, 2**64 - 3)) for m in Z.MULTIPLIERS]
    assert [int(a.one, 16), int(a.two, 16)] == want
    assert df.where("id = 0").crossJoin(df.where("id = 1").select(F.col("s").alias("t"))).select(Z.sketch_similarity(F.col("s"), F.col("t"))).first()[0] == 1.0


def test_duplicates_and_plan(spark):
    files = spark.createDataFrame([(1, 1, b"A" * 1024), (2, 1, b"A" * 1024), (3, 1, b"C" * 1024), (4, 2, b"A" * 1024), (5, 1, b"B"), (6, 1, b"B"), (7, 1, b""), (8, 1, b""), (9, 1, None)], "file_id long, volume_id long, content binary")
    members = D.duplicate_members(files, F.col("content"))
    groups = {(r.size, r.n, r.savings, r.same_volume) for r in D.duplicate_groups(members).collect()}
    assert groups == {(1024, 3, 2048, False), (1, 2, 1, True)}
    plan = {r.file_id: (r.action, r.bytes) for r in D.duplicate_plan(members).collect()}
    assert plan == {1: ("keep", 0), 2: ("recycle", 1024), 4: ("recycle", 1024), 5: ("keep", 0), 6: ("hardlink", 1)}
    with pytest.raises(ValueError):
        D.duplicate_plan(members, "burn")


def test_banded_pairs_lose_nothing(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(63) for _ in range(40)]
    rows = [(i, h) for i, h in enumerate(base + [h ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for h in base] + base[:3])]
    got = {(r.a, r.b): r.distance for r in D.banded_pairs(spark.createDataFrame(rows, "id long, hash long"), 5).collect()}
    heads = {}
    for i, h in rows:
        heads.setdefault(h, i)
    want = {(min(a, b), max(a, b)): (x ^ y).bit_count() for x, a in heads.items() for y, b in heads.items() if a < b and (x ^ y).bit_count() <= 5} | {(heads[h], i): 0 for i, h in rows if heads[h] != i}
    assert got == want


def test_perceptual_hashes_read_whole_texts(spark, tmp_path):
    rng = random.Random(6)
    texts_of = lambda n: "".join(rng.choice("abcdefghij XYZ,.0123") for _ in range(n))
    head, square = texts_of(1024), texts_of(1024)
    body = texts_of(100_000)
    docs = [(1, head + body), (2, head + "".join(sorted(body))), (3, "short"), (4, ""), (5, None), (6, square)]
    spark.createDataFrame([(k, 1, t) for k, t in docs], "doc_id long, volume_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.file_id: r.hash for r in P.perceptual_hashes(spark, str(tmp_path)).collect()}
    assert got.keys() == {1, 2, 3, 6} and None not in got.values() and got[1] != got[2]
    assert got[6] == Z.phash_of(np.frombuffer(square.encode(), dtype=np.uint8).reshape(32, 32))
    # Each row between the points that resizing reads counts as well.
    rows = np.full((320, 32), 100, dtype=np.uint8)
    rows[[5, 6, 105, 206], 7:19] = 255
    assert Z.bytes_phash_of(rows.tobytes()) != Z.bytes_phash_of(np.full((320, 32), 100, dtype=np.uint8).tobytes())


def test_files_that_differ_in_the_middle_are_no_duplicates(spark):
    edge = b"x" * 20_000
    files = spark.createDataFrame([(1, 1, bytearray(edge + b"a" + edge)), (2, 1, bytearray(edge + b"b" + edge)), (3, 1, bytearray(b"")), (4, 1, None)], "file_id long, volume_id long, content binary")
    assert D.duplicate_members(files, F.col("content")).count() == 0
    assert [(r.size, r.n) for r in D.signature_candidates(files, F.col("content")).collect()] == [(40_001, 2)]


def test_lanes_agree_with_plain_loops(spark):
    rng = np.random.default_rng(4)
    datas = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in [0, 1, 2, 63, 64, 65, 9_000] + list(rng.integers(100, 3_000, 60))] + [b"", b"a" * 500]
    assert K.crc16_of(datas).tolist() == [K._crc16_alone(0, d) for d in datas]
    assert K.fnv1a_of(datas).tolist() == [K._fnv1a_alone(0x811C9DC5, d) for d in datas]
    for d, got in zip(datas, Z.rolling_of(datas), strict=True):
        assert got.tolist() == Z._rolling(np.frombuffer(d, dtype=np.uint8)).tolist()
    for bounds in ((64, 512, 0x3F), (1, 7, 0x1), (128, 4096, 0x7F)):
        assert E.chunk_spans_of(datas, *bounds) == [list(E.chunk_spans(d, *bounds)) for d in datas]
    assert K.crc16_of([b"123456789"]).tolist() == [0xBB3D]
    df = frame(spark, [*datas, None])
    assert df.select(K.fnv1a("content").alias("h")).where("h is null").count() == 1


def test_banded_pairs_of_two_words_and_wider_keys(spark, monkeypatch):
    rng = random.Random(8)
    base = [rng.getrandbits(128) for _ in range(40)]
    values = base + [b ^ sum(1 << rng.randrange(128) for _ in range(k % 12)) for k, b in enumerate(base)] + [base[0]]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    data = [(i, signed(v >> 64), signed(v & (2**64 - 1))) for i, v in enumerate(values)]
    df = spark.createDataFrame([*data, (None, 1, 1), (99, None, 1)], "id long, high long, low long")
    first = {}
    for i, v in enumerate(values):
        first.setdefault(v, i)
    heads = sorted(first.values())
    want = {(a, b, (values[a] ^ values[b]).bit_count()) for a in heads for b in heads if a < b and (values[a] ^ values[b]).bit_count() <= 8} | {(first[v], i, 0) for i, v in enumerate(values) if first[v] < i}
    for rows in (None, 10**9):
        if rows:
            real = D._bands
            monkeypatch.setattr(D, "_bands", lambda n, t, w: real(10**9, t, w))
        assert set(map(tuple, D.banded_pairs(df, 8, ("high", "low")).collect())) == want


def test_alike_by_digest_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "TARGETS", 2)
    rows = [(i, f"{i % 3:02x}" + "0" * 18) for i in range(12)] + [(50, None), (51, "short")]
    df = spark.createDataFrame(rows, "file_id long, digest string")
    got = {(r.target_id, r.file_id) for r in D.alike_by_digest(df, df.where("file_id % 2 = 0"), 100).collect()}
    assert got == {(a, b) for a, x in rows for b, y in rows if a % 2 == 0 and a != b and x and x == y}


def test_alike_by_digest_compares_each_digest_once(spark, monkeypatch):
    monkeypatch.setattr(D, "GIVEN", 5, raising=False)  # parts for the digests of many files, which also count as hot
    monkeypatch.setattr(D, "hot_limit", lambda rows: 100, raising=False)
    rng = random.Random(9)
    base = [["".join(rng.choices("0123é", k=n)) for _ in range(6)] for n in (10, 10, 23, 40)]
    kinds = [d[:i] + rng.choice("01") + d[i + 1 :] for some in base for d in some for i in range(0, len(d), 3)] + ["", "\0", "0"]
    digests = [rng.choice(kinds) for _ in range(600)] + [kinds[0]] * 200 + [None] * 20
    df = spark.createDataFrame(list(enumerate(digests)), "file_id long, digest string")

    def score(a, b):
        return 100 if a == b else 0 if len(a) != len(b) else sum(x == y for x, y in zip(a, b, strict=True)) * 100 // len(a)

    for least in (90, 100, 37):
        found = D.alike_by_digest(df, df.where("file_id % 7 = 0"), least)
        # Scores are those of different digests: none is computed where files meet targets.
        assert "zip_with" not in found._jdf.queryExecution().optimizedPlan().toString()
        want = [(i, j, s) for i, a in enumerate(digests) if i % 7 == 0 and a is not None for j, b in enumerate(digests) if b is not None and i != j and len(a) == len(b) and (s := score(a, b)) >= least]
        assert sorted(map(tuple, found.collect())) == sorted(want)


def test_digests_are_compared_in_blocks(monkeypatch):
    rng = random.Random(10)
    digests, asked = (["".join(rng.choices("01", k=rng.choice((0, 1, 9, 300)))) for _ in range(n)] for n in (70, 30))
    want = {(i, j, sum(x == y for x, y in zip(a, b, strict=True)) * 100 // len(a) if a else 100) for i, a in enumerate(digests) for j, b in enumerate(asked) if len(a) == len(b)}
    for pairs in (1, 64, 1 << 20):
        monkeypatch.setattr(Z, "PAIRS", pairs, raising=False)
        for least in (0, 55, 100):
            got = [(int(i), int(j), int(s)) for some in Z.alike_of(digests, asked, least) for i, j, s in zip(*some, strict=True)]
            assert sorted(got) == sorted(x for x in want if x[2] >= least)


def test_search_in_slack(spark):
    image = b"key" + b"." * 7 + b"keykey" + b"-" * 16
    df = spark.createDataFrame([(1, bytearray(image), 10), (2, bytearray(image), 32), (3, None, 5)], "id long, content binary, size long")
    assert sorted(map(tuple, E.search_slack(df, "id", F.col("content"), F.col("size"), "key", 32).collect())) == [(1, 10), (1, 13)]
    assert E.search_slack(df, "id", F.col("content"), F.col("size"), "", 32).count() == 0
