import random

from pyspark.sql import functions as F

from siltstone.llm import history
from siltstone.llm.history import digest, duplicates_of_history

CATALOG = "size_logical long, sha256 binary, head_tail binary"
INCOMING = "entry_id long, batch_id int, size_logical long, sha256 string, head_tail string"


def brute(catalog, incoming):
    old = [(-1, s, a and a.hex(), h and h.hex()) for s, a, h in catalog if s is not None and s >= 1024]
    new = {(e, s, a, h) for e, _, s, a, h in incoming if e is not None and s is not None and s >= 1024}
    out = {}
    for e, s, a, h in new:
        for e2, s2, a2, h2 in [*old, *new]:
            if e2 >= e:
                continue
            if s == s2 and (a and a == a2 or h and h == h2 and not (a and a2)):
                out[e] = "exact"
            elif h and h == h2 and abs(s - s2) * 100 <= max(s, s2):
                out.setdefault(e, "near")
    return out


def run(spark, catalog, incoming):
    got = [tuple(r) for r in duplicates_of_history(spark.createDataFrame(catalog, CATALOG), spark.createDataFrame(incoming, INCOMING)).collect()]
    assert len(got) == len(set(got)) == len(dict(got))
    return dict(got)


def data(seed, n=250):
    rng = random.Random(seed)
    shas = [bytes(rng.randrange(256) for _ in range(31)) + b"\0" for _ in range(25)]
    heads = [bytes(rng.randrange(256) for _ in range(15)) + b"\0" for _ in range(12)]
    size = lambda: rng.choice([None, 0, 1023, 1024, 1025, 1034, 1035, 10_000, 10_100, 10_101, 9_900, 9_899, 2**40, 2**40 + 2**33])
    sha, head = (lambda: rng.choice([None, *shas])), (lambda: rng.choice([None, None, *heads]))
    catalog = [(size(), sha(), head()) for _ in range(40)]
    incoming = []
    for e in range(1, n):
        a, h = sha(), head()
        incoming.append((e, e // 60, size(), a and a.hex(), h and h.hex()))
    return catalog, incoming


def test_random_batches(spark):
    for seed in (1, 2):
        catalog, incoming = data(seed)
        assert run(spark, catalog, incoming + incoming[:20]) == brute(catalog, incoming)


def test_overlapping_batches_go_together(spark):
    catalog, incoming = data(3, 120)
    mixed = [(e, e % 3 if e > 20 else None, *rest) for e, _, *rest in incoming]
    assert run(spark, catalog, mixed) == brute(catalog, mixed)


def test_large_batches_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(history, "BROADCAST_SEARCHES", 0)
    catalog, incoming = data(4, 100)
    assert run(spark, catalog, incoming) == brute(catalog, incoming)


def test_empty_tables_and_nulls(spark):
    assert run(spark, [], []) == {}
    assert run(spark, [], [(None, 1, 5000, "00" * 32, "11" * 16), (1, None, None, None, None), (2, 1, 5000, None, None)]) == {}
    one = (5000, bytes(32), bytes(16))
    assert run(spark, [one], [(1, 1, 5000, "00" * 32, None), (2, 1, 5000, None, "00" * 16), (3, 1, 5050, None, "00" * 16), (4, 1, 5051, "12" * 32, "33" * 16)]) == {1: "exact", 2: "exact", 3: "near"}


def test_clashing_columns(spark):
    catalog = spark.createDataFrame([(5000, bytes(32), bytes(16), 3, 4)], CATALOG + ", position long, entry_id long")
    incoming = spark.createDataFrame([(1, 1, 5000, "00" * 32, None, 3, "x")], INCOMING + ", size long, kind string")
    assert [tuple(r) for r in duplicates_of_history(catalog, incoming).collect()] == [(1, "exact")]


def test_written_forms_of_a_digest(spark):
    raw = bytes(range(160, 192))
    import base64

    forms = [raw.hex(), raw.hex().upper(), "sha256:" + raw.hex(), " " + raw.hex() + " ", raw.hex(":"), base64.b64encode(raw).decode(), base64.urlsafe_b64encode(raw).decode().rstrip("="), "0x" + raw.hex()]
    bad = [None, "", "n/a", raw.hex()[:-2], "z" * 64, "x" * 100_000]
    got = [r.d for r in spark.createDataFrame([(f,) for f in forms + bad], "t string").select(digest(F.col("t"), 32).alias("d")).collect()]
    assert [g and bytes(g) for g in got] == [raw] * len(forms) + [None] * len(bad)


def records(spark, a, b):
    return spark.createDataFrame([(i, 2000 + i, i.to_bytes(32, "big"), (i % 50).to_bytes(16, "big")) for i in range(a, b)], "position long, size long, sha256 binary, head_tail binary")


def test_segments_merge_logarithmically_and_buckets_grow(spark, monkeypatch):
    monkeypatch.setattr(history, "BUCKET_ROWS", 2)
    monkeypatch.setattr(history, "LEAST_BITS", 1)
    store = history.History(spark)
    for k in range(8):
        store.add(records(spark, k * 10, k * 10 + 10), 10)
        assert len(store.levels) <= 4
    assert sum(level.suffixes for level in store.levels) == 160
    assert store.levels[0].bits > history._bits(20)
    again = records(spark, 0, 80).withColumn("position", F.col("position") + 1000)
    assert sorted((r.entry_id, r.kind, r.coverage) for r in store.check(again).collect()) == [(1000 + i, "exact", 56) for i in range(80)]


def test_second_run_opens_the_history_and_reads_no_catalog(spark, tmp_path):
    catalog, incoming = data(5, 120)
    spark.createDataFrame(catalog, CATALOG).write.parquet(str(tmp_path / "catalog"))
    files = spark.read.parquet(str(tmp_path / "catalog"))
    path, got = f"file://{tmp_path}/history", {}
    for low, high in ((0, 40), (40, 80), (80, 200)):
        part = [r for r in incoming if low <= r[0] < high]
        got |= {r.entry_id: r.kind for r in duplicates_of_history(files, spark.createDataFrame(part, INCOMING), path).collect()}
        for f in (tmp_path / "catalog").iterdir():  # later runs could not read it if they tried
            f.unlink()
    assert got == brute(catalog, incoming)
    store = history.History(spark, path)
    assert not store.is_new and all("catalog" not in f for level in store.levels for f in store._segment(level).inputFiles())
