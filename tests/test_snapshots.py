"""Snapshot changes against a plain comparison of dictionaries."""

import random

import pytest

from pyspark.sql import functions as F

from siltstone.operators.snapshots import SnapshotStore, assign_ordinals, snapshot_changes

ROWS = "snap_no int, volume_id long, full_path string, seq long, size long, time long"


def compared():
    return {"size": F.col("size"), "time": F.col("time")}


def brute(rows):
    latest = {}
    for snap, vol, path, seq, *values in rows:
        if None in (snap, vol, path):
            continue
        key = (snap, vol, path)
        rank = (seq is not None, seq or 0)
        if key not in latest or rank > latest[key][0]:
            latest[key] = (rank, values)
    snaps = sorted({k[0] for k in latest})
    out = set()
    for old, new in zip(snaps, snaps[1:], strict=False):
        a = {k[1:]: v[1] for k, v in latest.items() if k[0] == old}
        b = {k[1:]: v[1] for k, v in latest.items() if k[0] == new}
        out |= {(new, *k, "added") for k in b.keys() - a.keys()} | {(new, *k, "removed") for k in a.keys() - b.keys()}
        out |= {(new, *k, "changed") for k in a.keys() & b.keys() if a[k] != b[k]}
    return out


def run(spark, rows, **more):
    return {tuple(r) for r in snapshot_changes(spark.createDataFrame(rows, ROWS), compared(), **more).collect()}


def test_random_snapshots_with_gaps_nulls_and_repeats(spark):
    rng = random.Random(3)
    rows = []
    for snap in (1, 2, 4):
        for i in range(300):
            if rng.random() < 0.8:
                rows.append((snap, i % 3, f"/p/{i}", i, rng.choice([None, 1, 2]), rng.choice([None, 5])))
    rows += rng.sample(rows, 50)
    rows += [(4, 0, "/p/0", 10_000, 77, 77), (None, 1, "/x", 1, 1, 1), (2, None, "/x", 1, 1, 1), (2, 1, None, 1, 1, 1)]
    assert run(spark, rows) == brute(rows)


def test_null_and_null_are_equal_null_and_value_are_not(spark):
    rows = [(1, 1, "/a", 1, None, 5), (2, 1, "/a", 1, None, 5), (1, 1, "/b", 1, None, 5), (2, 1, "/b", 1, 0, 5)]
    assert run(spark, rows) == {(2, 1, "/b", "changed")}


def test_empty_and_single_snapshot_and_long_paths(spark):
    assert run(spark, []) == set()
    assert run(spark, [(1, 1, "/a", 1, 1, 1)]) == set()
    long = "/" + "x" * 100_000
    assert run(spark, [(1, 1, "", 1, 1, 1), (2, 1, long, 1, 1, 1)]) == {(2, 1, "", "removed"), (2, 1, long, "added")}


def test_clashing_columns_are_ignored(spark):
    df = spark.createDataFrame([(1, 1, "/a", 1, 1, 1, 9, "x"), (2, 1, "/a", 1, 2, 1, 9, "x")], ROWS + ", ordinal long, change string")
    assert [tuple(r) for r in snapshot_changes(df, compared()).collect()] == [(2, 1, "/a", "changed")]


def test_ordinals_last_and_new_ones_follow(spark):
    keys = "volume_id long, full_path string"
    first = assign_ordinals(spark.createDataFrame([(1, f"/{i}") for i in range(50)], keys)).collect()
    assert sorted(r.ordinal for r in first) == list(range(50))
    known = spark.createDataFrame(first)
    second = {(r.volume_id, r.full_path): r.ordinal for r in assign_ordinals(spark.createDataFrame([(1, "/3"), (2, "/3"), (2, "/4")], keys), known).collect()}
    assert all(second[r.volume_id, r.full_path] == r.ordinal for r in first)
    assert sorted(second[k] for k in ((2, "/3"), (2, "/4"))) == [50, 51]


def test_an_ordinal_of_zero_is_not_given_again(spark):
    key = "volume_id long, full_path string"
    first = assign_ordinals(spark.createDataFrame([(1, "/a")], key))
    both = assign_ordinals(spark.createDataFrame([(1, "/a"), (1, "/b")], key), first)
    assert sorted((r.full_path, r.ordinal) for r in both.collect()) == [("/a", 0), ("/b", 1)]


def test_store_goes_on_where_the_last_run_ended(spark, tmp_path):
    schema = "snap_no int, volume_id long, full_path string, seq long, size long"
    rows = [(1, 1, "/a", 1, 5), (1, 1, "/b", 1, None), (2, 1, "/a", 1, 6), (2, 1, "/c", 1, 7), (3, 1, "/a", 1, 6), (3, 1, "/b", 1, None), (5, 1, "/b", 2, 1), (5, 1, "/b", 1, None)]
    compared = {"size": F.col("size")}
    every = sorted(map(tuple, snapshot_changes(spark.createDataFrame(rows, schema), compared).collect()))
    got, path = [], f"file://{tmp_path}/store"
    for part in ([1], [2, 3], [4], [5]):
        some = [r for r in rows if r[0] in part]
        got += map(tuple, SnapshotStore(spark, path).add(spark.createDataFrame(some, schema), compared).collect())
    assert sorted(got) == every and len(every) == 7
    assert sorted((r.full_path, r.ordinal) for r in SnapshotStore(spark, path).dictionary().collect()) == [("/a", 0), ("/b", 1), ("/c", 2)]
    with pytest.raises(ValueError):
        SnapshotStore(spark, path).add(spark.createDataFrame(rows[:2], schema), compared)
