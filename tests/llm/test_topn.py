import random

import pytest

from siltstone.llm import topn
from siltstone.llm.topn import top_n_per_group

ROWS = "g long, s long, t long"


def brute(rows, n):
    out = set()
    live = {r for r in rows if None not in r}
    for g in {r[0] for r in live}:
        best = sorted(((s, t) for h, s, t in live if h == g), key=lambda x: (-x[0], x[1]))[:n]
        out |= {(g, k + 1, t, s) for k, (s, t) in enumerate(best)}
    return out


def run(spark, rows, n, **more):
    got = [tuple(r) for r in top_n_per_group(spark.createDataFrame(rows, ROWS), "g", "s", "t", n, **more).collect()]
    assert len(got) == len(set(got))
    return set(got)


def data(seed):
    rng = random.Random(seed)
    rows = [(7, rng.choice([0, 5, rng.randrange(10**9)]), i) for i in range(1500)]
    rows += [(g, rng.randrange(-(2**40), 2**40), g * 100 + i) for g in range(20, 60) for i in range(rng.randrange(1, 30))]
    rows += [(8, 3, i) for i in range(300)]  # all tied
    rows += [(9, None, 1), (None, 4, 2), (9, 4, None), (10, 1, 1), (10, 1, 1)]
    return rows


@pytest.mark.parametrize("n", [1, 10])
def test_skewed_groups_ties_nulls_and_repeats(spark, n):
    rows = data(n)
    assert run(spark, rows, n) == brute(rows, n)


def test_shuffled_join_and_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(topn, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(topn, "maybe_broadcast", lambda df, rows: df)
    monkeypatch.setattr(topn, "hot_limit", lambda rows: 200)
    rows = data(4)
    assert run(spark, rows, 5) == brute(rows, 5)


def test_empty_and_extra_columns(spark):
    assert run(spark, [], 3) == set()
    df = spark.createDataFrame([(1, 5, 2, 9, 9)], "g long, score long, t long, s long, rank_no long")
    assert [tuple(r) for r in top_n_per_group(df, "g", "score", "t", 3).collect()] == [(1, 1, 2, 5)]


def test_wide_code_range(spark):
    rows = [(1, s, t) for s, t in ((2**61, 1), (2**61 - 1, 2), (0, 3), (0, 2**61), (-(2**61), 5))]
    for n in (1, 2, 3, 4):
        assert run(spark, rows, n) == brute(rows, n)


def test_scores_that_span_more_than_a_bigint(spark):
    rows = [(1, s, t) for t, s in enumerate((2**63 - 1, -(2**63), 2**62, -(2**62), 0, 1, 2**63 - 2, 2**63 - 1))]
    rows += [(2, 5, t) for t in (-(2**63), 2**63 - 1, 0, 7)]
    for n in (1, 2, 3, 5):
        assert run(spark, rows, n) == brute(rows, n)


FLOATS = [1.7, 1.9, -0.0, 0.0, -1.5, 1e308, 1.7976931348623157e308, -1e308, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, 0.9999999999999999, 1.0000000000000002, 2.0**52, 2.0**53 + 2,
          8.0, 7.999999999999999, float("inf"), float("-inf"), 1e-300, 0.5, 0.25, 3.141592653589793]


@pytest.mark.parametrize("n", [1, 4, 20])
def test_fractional_scores(spark, n):
    rows = [(1, s, t) for t, s in enumerate(FLOATS)]
    df = spark.createDataFrame([*rows, (1, float("nan"), 99), (1, None, 98)], "g long, s double, t int")
    got = [(r.rank_no, r.t, r.s) for r in top_n_per_group(df, "g", "s", "t", n).orderBy("rank_no").collect()]
    want = sorted(((s, t) for _, s, t in rows), key=lambda x: (-x[0], x[1]))[:n]
    assert got == [(k + 1, t, s) for k, (s, t) in enumerate(want)]


def test_decimal_scores_and_refused_types(spark):
    df = spark.sql("SELECT 1L AS g, cast(s AS DECIMAL(18, 4)) AS s, t FROM VALUES (1.7, 1L), (1.9, 2L), (-99999999999999.9999, 3L), (1.7001, 4L) AS x(s, t)")
    got = top_n_per_group(df, "g", "s", "t", 3).orderBy("rank_no").collect()
    assert [(r.t, str(r.s)) for r in got] == [(2, "1.9000"), (4, "1.7001"), (1, "1.7000")]
    for kind in ("decimal(38, 2)", "string"):
        with pytest.raises(TypeError):
            top_n_per_group(df.withColumn("s", df.s.cast(kind)), "g", "s", "t", 3)
    with pytest.raises(TypeError):
        top_n_per_group(df.withColumn("t", df.t.cast("string")), "g", "s", "t", 3)
