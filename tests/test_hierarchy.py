"""Trees, cycles and nested-set ranges against a plain walk."""

import random

import pytest

from siltstone.operators import hierarchy as H
from siltstone.operators.hierarchy import ancestors, current_rows, descendants, hierarchy



@pytest.fixture(autouse=True, params=[100_000, 3])
def task_nodes(request, monkeypatch):
    """All rounds in one task, and nearly all of them distributed."""
    monkeypatch.setattr(H, "TASK_NODES", request.param)
    if request.param == 3:
        monkeypatch.setattr(H, "BLOCK_CHILDREN", 4)
        monkeypatch.setattr(H, "HOT_ROWS", 5)
        monkeypatch.setattr(H, "hot_limit", lambda rows: 5)


NODES = "id long, parent long, name string, bytes long"


def brute(rows):
    parent = {i: p for i, p, *_ in rows}
    out = {}
    for i in parent:
        path, u = [], i
        while u not in path:
            path.append(u)
            up = parent[u]
            if not up or up not in parent:
                out[i] = (u, len(path) - 1)
                break
            u = up
        else:
            out[i] = (min(path[path.index(u) :]), -1)
    below = {i: 0 for i in parent}
    for i, (_, depth) in out.items():
        u = i
        for _ in range(max(depth, 0)):
            u = parent[u]
            below[u] += 1
    return {i: (r, d, below[i] if d >= 0 else -1) for i, (r, d) in out.items()}


def rows_of(trees):
    return {r.id: (r.root, r.depth, r.n_below) for r in trees.collect()}


def test_random_forest_with_cycles(spark):
    rng = random.Random(5)
    ids = rng.sample(range(1, 10_000), 400)
    rows = []
    for k, i in enumerate(ids):
        kind = rng.random()
        parent = None if kind < 0.03 else 0 if kind < 0.05 else 99_999 if kind < 0.07 else i if kind < 0.08 else rng.choice(ids[:k] or [i]) if kind < 0.97 else rng.choice(ids)
        rows.append((i, parent, f"n{i}", k))
    assert rows_of(hierarchy(spark.createDataFrame(rows, NODES))) == brute(rows)


def test_deep_branch_paths_and_totals(spark):
    n = 300
    rows = [(i, i - 1 if i > 1 else None, f"d{i}", i) for i in range(1, n + 1)]
    got = {r.id: r for r in hierarchy(spark.createDataFrame(rows, NODES), with_paths=True).collect()}
    assert got[n].depth == n - 1 and got[1].n_below == n - 1
    assert got[3].path == "d1/d2/d3" and got[n].path.count("/") == n - 1
    assert got[1].total_bytes == n * (n + 1) // 2 and got[n].total_bytes == n


def test_ranges_give_descendants_and_ancestors(spark):
    rows = [(1, None, "a", 1), (2, 1, "b", 1), (3, 1, "c", 1), (4, 2, "d", 1), (5, None, "e", 1), (6, 7, "x", 1), (7, 6, "y", 1)]
    trees = hierarchy(spark.createDataFrame(rows, NODES))
    asked = spark.createDataFrame([(1,), (4,), (6,)], "id long")
    assert sorted((r.ancestor, r.id) for r in descendants(trees, asked).collect()) == [(1, 2), (1, 3), (1, 4)]
    assert sorted((r.id, r.ancestor) for r in ancestors(trees, asked).collect()) == [(4, 1), (4, 2)]


def test_nulls_repeats_ties_and_extra_columns(spark):
    rows = [(None, 1, "z", 1), (1, None, None, None), (1, None, None, None), (2, 1, "", 5), (2, 1, "b", 5)]
    nodes = spark.createDataFrame([(*r, 7, "q") for r in rows], NODES + ", root long, path string")
    got = {r.id: r for r in hierarchy(nodes, with_paths=True).collect()}
    assert set(got) == {1, 2} and got[2].path == "/b" and got[1].total_bytes == 5


def test_empty_table(spark):
    assert hierarchy(spark.createDataFrame([], NODES)).collect() == []


def test_only_cycles(spark):
    rows = [(3, 4, "a", 1), (4, 5, "b", 1), (5, 3, "c", 1), (8, 4, "d", 1), (9, 9, "e", 1)]
    assert rows_of(hierarchy(spark.createDataFrame(rows, NODES))) == {3: (3, -1, -1), 4: (3, -1, -1), 5: (3, -1, -1), 8: (3, -1, -1), 9: (9, -1, -1)}


def test_wide_parent_crosses_sibling_blocks(spark):
    rows = [(1, None, "r", 0)] + [(i * 5000, 1, "c", 1) for i in range(1, 200)] + [(i * 5000 + 1, i * 5000, "g", 1) for i in range(1, 200)]
    trees = hierarchy(spark.createDataFrame(rows, NODES))
    got = trees.collect()
    assert sorted(r.pre for r in got) == list(range(len(rows)))
    assert rows_of(trees) == brute(rows)


def test_current_rows_take_the_highest_seq(spark):
    df = spark.createDataFrame([(1, 1, "old"), (1, 3, "new"), (1, 3, "new"), (1, None, "none"), (2, None, "only")], "k int, seq int, v string")
    assert sorted((r.k, r.v) for r in current_rows(df, ["k"], "seq", ["v"]).collect()) == [(1, "new"), (2, "only")]


def test_many_nodes_under_one_cycle_and_one_parent(spark):
    rows = [(1, 2, "a", 1), (2, 1, "b", 1)] + [(i, 1, "c", 1) for i in range(10, 60)] + [(100, None, "r", 1)] + [(i * 7919 % 100_003 + 200, 100, "d", 1) for i in range(60)]
    trees = hierarchy(spark.createDataFrame(rows, NODES))
    assert rows_of(trees) == brute(rows)
    assert sorted(r.pre for r in trees.collect() if r.root == 100) == list(range(61))


def test_totals_that_do_not_fit_are_null(spark):
    rows = [(1, None, "a", 1), (2, 1, "b", 2**62), (3, 1, "c", 2**62), (4, 9, "d", 2**62), (9, 4, "e", 2**62)]
    assert {r.id: r.total_bytes for r in hierarchy(spark.createDataFrame(rows, NODES)).collect()} == {1: None, 2: 2**62, 3: 2**62, 4: None, 9: None}
