import random

import numpy as np

from siltstone.llm import neighbours as N
from siltstone.llm.neighbours import expanded_pairs, most_similar, shard_links, similar_vectors

ROWS = "id long, vector binary"


def flip(rng, v, n):
    x = int.from_bytes(v, "big")
    for b in rng.sample(range(128), n):
        x ^= 1 << b
    return x.to_bytes(16, "big")


def data(seed, n=300):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        base = rng.randbytes(16)
        out.append(base)
        out += [flip(rng, base, rng.randrange(0, 16)) for _ in range(rng.choice([0, 0, 1, 3]))]
    return [(i * 3 + 1, v) for i, v in enumerate(out)]


def brute(rows):
    live = sorted({(i, int.from_bytes(v, "big")) for i, v in rows if i is not None and v is not None and len(v) == 16 and any(v)})
    return {(a, b) for k, (a, x) in enumerate(live) for b, y in live[k + 1 :] if (x ^ y).bit_count() <= 12}


def run(spark, rows, schema=ROWS):
    return {tuple(r) for r in expanded_pairs(*similar_vectors(spark.createDataFrame(rows, schema))).collect()}


def test_recall_against_brute_force(spark):
    rows = data(1)
    want, got = brute(rows), run(spark, rows)
    assert got <= want and len(got) >= 0.9 * len(want)


def test_large_shards_are_cut(spark, monkeypatch):
    monkeypatch.setattr(N, "SHARD_ROWS", 20)
    rng = random.Random(2)
    # All agree on the first block: one shard of everything there.
    rows = [(i, b"\xff\xff" + v[2:]) for i, v in data(3, 80)]
    rows += [(10_000 + k, flip(rng, rows[k][1], 11)) for k in range(10)]
    want, got = brute(rows), run(spark, rows)
    assert got <= want and len(got) >= 0.9 * len(want)


def test_more_links_than_a_beam_holds():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, (1, 2)).astype(np.uint64)
    vectors = np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 60, (60, 2)).astype(np.uint64)), rng.integers(0, 2**63, (100, 2)).astype(np.uint64)])
    a, b, d = shard_links(np.zeros(160, dtype=np.int64), vectors, np.ones(160, dtype=bool))
    pairs = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
    assert len(pairs) == 60 * 59 // 2 and d.max() <= 4


def test_nulls_zeros_copies_repeats_and_empty(spark):
    v = bytes(range(1, 17))
    rows = [(1, v), (1, v), (2, v), (3, bytes(16)), (4, bytes(16)), (5, None), (None, v), (6, b"short"), (7, b"")]
    assert run(spark, rows) == {(1, 2)}
    assert run(spark, []) == set()
    assert run(spark, [(1, v)]) == set()
    assert run(spark, [(1, v, 5, 6), (2, v, 5, 6)], ROWS + ", class_id long, shard int") == {(1, 2)}


def test_nearest_come_first(spark):
    links = spark.createDataFrame([(1, 2, 5), (1, 3, 2), (1, 4, 5)], "a long, b long, distance int")
    got = sorted(tuple(r) for r in most_similar(links, 2).collect() if r.id == 1)
    assert got == [(1, 1, 3, 2), (1, 2, 2, 5)]


def test_nearest_of_queries_and_their_recall(spark, monkeypatch):
    rng = np.random.default_rng(5)
    data = [(i, bytearray(rng.integers(0, 256, 16, dtype=np.uint8).tobytes())) for i in range(3_000)]
    data += [(10_000 + i, bytearray(bytes(data[i][1][:15]) + bytes([data[i][1][15] ^ 1]))) for i in range(50)]
    data += [(20_000, data[0][1]), (20_001, bytearray(16)), (20_002, None), (None, data[1][1]), (0, data[0][1])]
    monkeypatch.setattr(N, "SHARD_ROWS", 1_000)
    rows = spark.createDataFrame([(*r, 7) for r in data], "id long, vector binary, distance int")
    asked = rows.where("id % 10 = 0")
    got = N.nearest_of(rows, asked, 10)
    out = got.collect()
    live = {r[0]: np.frombuffer(bytes(r[1]), dtype=">u8").astype(np.uint64) for r in data if r[0] is not None and r[1] is not None and any(r[1])}
    assert {r.query_id for r in out} == {i for i in live if i % 10 == 0} and all(r.id != 20_000 for r in out)
    assert all(N.distance(live[r.query_id], live[r.id]) == r.distance > 0 for r in out)
    assert {(r.query_id, r.id) for r in out if r.rank_no == 1 and r.query_id < 50} == {(i, 10_000 + i) for i in range(0, 50, 10)}
    measured = N.recall(rows, asked, got, 10).first()
    assert measured.queries == len({r.query_id for r in out}) and measured.recall > 0.9
    assert N.nearest_of(rows.limit(0), rows.limit(0)).collect() == [] and N.recall(rows, rows.limit(0), got).first().queries == 0


def test_more_vectors_agree_on_more_blocks(spark, monkeypatch):
    assert [N.blocks_that_agree(n) for n in (1_000, 10**7, 10**9, 8 * 10**9, 10**10)] == [1, 1, 2, 2, 3]
    rng = np.random.default_rng(6)
    base = rng.integers(0, 256, (60, 16), dtype=np.uint8)
    data = [(i, bytearray(b.tobytes())) for i, b in enumerate(base)]
    for i, b in enumerate(base):  # copies with up to 14 bits turned
        bits = np.unpackbits(b)
        bits[rng.choice(128, i % 15, replace=False)] ^= 1
        data.append((100 + i, bytearray(np.packbits(bits).tobytes())))
    rows = spark.createDataFrame(data, "id long, vector binary")
    want = {(r.id_a, r.id_b) for r in N.expanded_pairs(*N.similar_vectors(rows)).collect()}
    monkeypatch.setattr(N, "blocks_that_agree", lambda n: 2)
    assert {(r.id_a, r.id_b) for r in N.expanded_pairs(*N.similar_vectors(rows)).collect()} == want
    assert {(i, 100 + i) for i in range(60) if i % 15 <= 12} <= want
