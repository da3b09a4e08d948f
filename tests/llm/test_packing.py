import numpy as np
import pytest

from siltstone.llm import packing
from siltstone.llm.packing import best_fit, bound_sums, lower_bound, pack_documents

DOCS = "doc_id long, text string"


def text(n):
    return "word " * n


def check(rows, capacity):
    per = {}
    for r in rows:
        if r.tokens:
            per[r.container_id] = per.get(r.container_id, 0) + r.tokens
            assert r.container_id is not None
        else:
            assert r.container_id is None
        assert r.n_pieces == 1 or sum(q.tokens for q in rows if q.doc_id == r.doc_id) > capacity
    assert all(v <= capacity for v in per.values())
    return len(per)


def test_documents_fill_containers_whole(spark):
    docs = [(i, text(i % 37 + 1)) for i in range(400)] + [(1000, text(205)), (1001, text(101))]
    out, n, bound = pack_documents(spark.createDataFrame(docs, DOCS), 100)
    rows = out.collect()
    assert {r.doc_id for r in rows} == {d for d, _ in docs}
    assert check(rows, 100) == n and bound <= n <= bound + 1
    assert {r.doc_id for r in rows if r.n_pieces > 1} == {1000, 1001}
    whole = {r.doc_id: r.tokens for r in packing.count_tokens(spark.createDataFrame(docs, DOCS)).collect()}
    assert {d: sum(r.tokens for r in rows if r.doc_id == d) for d in whole} == whole


def test_partitions_exchange_what_leaves_gaps(spark, monkeypatch):
    monkeypatch.setattr(packing, "PARTITION_ITEMS", 150)
    docs = [(i, text(i * 7 % 90 + 1)) for i in range(600)]
    out, n, bound = pack_documents(spark.createDataFrame(docs, DOCS), 100)
    rows = out.collect()
    assert len(rows) == 600 and check(rows, 100) == n and n <= bound * 1.05 + 1


def test_ends_where_no_exchange_helps(spark, monkeypatch):
    monkeypatch.setattr(packing, "PARTITION_ITEMS", 50)
    docs = [(i, text(26 + i * 7 % 30)) for i in range(300)]
    out, n, bound = pack_documents(spark.createDataFrame(docs, DOCS), 100)
    rows = out.collect()
    assert len(rows) == 300 and check(rows, 100) == n and n <= bound * 1.15


def test_null_empty_repeated_and_exact_texts(spark):
    exact = text(50)
    size = packing.count_tokens(spark.createDataFrame([(1, exact)], DOCS)).first().tokens
    docs = [(1, exact), (1, exact), (2, ""), (3, None), (None, "x"), (4, "a")]
    rows = pack_documents(spark.createDataFrame([(*d, "q") for d in docs], DOCS + ", container_id string"), size)[0].collect()
    assert sorted((r.doc_id, r.n_pieces, r.tokens) for r in rows) == [(1, 1, size), (2, 1, 0), (3, 1, 0), (4, 1, 1)]
    check(rows, size)


def test_empty_table_and_very_long_text(spark):
    out, n, bound = pack_documents(spark.createDataFrame([], DOCS), 10)
    assert (out.collect(), n, bound) == ([], 0, 0)
    out, n, _ = pack_documents(spark.createDataFrame([(1, text(30_000))], DOCS), 1000)
    assert check(out.collect(), 1000) == n >= 30


@pytest.mark.parametrize("seed", range(5))
def test_bound_is_below_and_fit_is_valid(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 100, 300)
    bins, free = best_fit(sizes, 100)
    load = np.bincount(bins, weights=sizes)
    assert (load <= 100).all() and (100 - load == free).all()
    assert lower_bound(bound_sums(sizes, 100)) <= len(free)


def test_bound_counts_items_that_never_share():
    assert lower_bound(bound_sums(np.full(10, 60), 100)) == 10


def test_two_texts_of_one_document_are_packed_each(spark):
    docs = [(1, text(25)), (1, text(3)), (1, text(3)), (1, "other " * 3), (2, None), (2, "")]
    out, n, bound = pack_documents(spark.createDataFrame(docs, DOCS), 10)
    rows = out.collect()
    assert len(rows) == 3 + 1 + 1 + 2 and len({(r.text_key, r.piece_no) for r in rows}) == 7
    said = packing.audit(out, 10, n, bound).first().asDict()
    assert said == {"documents": 2, "overfull": 0, "misplaced": 0, "split_short": 0, "counted": True, "near_bound": True}
    assert [r.doc_id for r in packing.split_documents(out).collect()] == [1]
    assert packing.audit(out.where("piece_no = 1"), 10, n, bound).first().misplaced > 0
    assert packing.audit(out.withColumn("container_id", out.container_id.substr(1, 1)), 10, n, bound).first().overfull > 0


def test_large_identifiers_keep_their_digits(spark):
    docs = [(2**62 + i, text(3)) for i in range(5)]
    out, _, _ = pack_documents(spark.createDataFrame(docs, DOCS), 10)
    assert sorted(r.doc_id for r in out.collect()) == [d for d, _ in docs]
