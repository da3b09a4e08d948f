"""Every query outside the optional subpackage against its SQL, on the smallest tables,
and those that SQL can't express against plain Python."""

import math
import re
import stat
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from siltstone.functions import fuzzy as Z
from siltstone.operators.extract import chunk_spans
from siltstone.plans import registry
from tests.oracle import check

QUERIES, SQL = registry.queries(), registry.sql()


def test_every_sql_has_a_query():
    assert not SQL.keys() - QUERIES.keys()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, small, name):
    check(spark, small, QUERIES[name], SQL[name])


@pytest.fixture(scope="module")
def texts(small):
    return dict(duckdb.sql(f"SELECT doc_id, encode(text) FROM '{small}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def vectors(small):
    return duckdb.sql(f"SELECT vec_id, label, embedding FROM '{small}/embeddings.parquet' ORDER BY vec_id").fetchall()


def rows(spark, small, name):
    df = QUERIES[name](spark, small)
    return [tuple(r) for r in df.collect()]


def test_chunks_and_their_sketches(spark, small, texts):
    want = {(i, *span) for i, t in texts.items() if t for span in chunk_spans(bytes(t), 256, 4096, 0x7F)}
    assert set(rows(spark, small, "content_chunks")) == want
    sketches = {i: (one, two) for i, one, two in rows(spark, small, "chunk_set_sketches")}
    for i in sketches:
        hashes = np.array([h for j, _, _, h in want if j == i], dtype=np.uint64)
        assert sketches[i] == tuple(f"{int((hashes * np.uint64(m)).min()):016x}" for m in Z.MULTIPLIERS)
    assert set(sketches) == {i for i, *_ in want}


def test_fuzzy_scores_of_neighbours_by_id(spark, small, texts):
    digest = {i: (Z.ssdeep_of(bytes(t)), Z.tlsh_of(bytes(t))) for i, t in texts.items()}
    got = {i: (s, t) for i, s, t in rows(spark, small, "fuzzy_scores")}
    assert set(got) == {i for i in texts if i + 1 in texts}
    for i, (s, t) in got.items():
        (a, p), (b, q) = digest[i], digest[i + 1]
        assert s == (100 if a == b else 50 if a and b and a.split(":")[0] == b.split(":")[0] else 0)
        if p and q:
            assert t == (100 if p == q else 0 if len(p) != len(q) else sum(x == y for x, y in zip(p, q, strict=True)) * 100 // len(p))


def test_perceptual_hashes(spark, small, texts):
    assert dict(rows(spark, small, "perceptual_hashes")) == {i: Z.bytes_phash_of(bytes(t)) for i, t in texts.items() if t}


def test_printable_strings(spark, small, texts):
    want = {(i, m.start(), m.group().decode()) for i, t in texts.items() for m in re.finditer(rb"[\x20-\x7e]{40,}", bytes(t or b""))}
    assert {r[:3] for r in rows(spark, small, "printable_strings")} == want


def test_encryption_guesses_of_plain_texts(spark, small, texts):
    got = {r[0]: r[1:] for r in rows(spark, small, "content_encryption")}
    assert set(got) == set(texts)
    for i, (compressed, _, _, encrypted, confidence) in got.items():
        n = Counter(bytes(texts[i] or b""))
        entropy = -sum(c / n.total() * math.log2(c / n.total()) for c in n.values()) / 8 if n else 0
        assert not compressed and 0 <= confidence <= 1
        assert encrypted or entropy < 0.8


def test_modes_as_text_and_back(spark, small):
    got = rows(spark, small, "mode_round_trip")
    assert got and all(mode is None or (text[-9:] == stat.filemode(mode)[-9:] and back & 0o777 == mode & 0o777) for mode, text, back, _ in got)


def test_cluster_sizes_add_up(spark, small, vectors):
    got = dict(rows(spark, small, "cluster_sizes"))
    assert len(got) == 5 and sum(got.values()) == len(vectors) and min(got.values()) > 0


def test_leaders_by_hand(spark, small, vectors):
    heads, want = {}, set()
    for i, label, v in vectors:
        x = np.array(v, dtype=np.float64)
        x /= np.linalg.norm(x)
        first = next((h for h, y in heads.setdefault(label, []) if x @ y >= 0.5), None)
        if first is None:
            heads[label].append((i, x))
        want.add((label, i, i if first is None else first))
    assert set(rows(spark, small, "leader_clusters")) == want


def test_models_beat_a_guess(spark, small, vectors):
    classes = len({label for _, label, _ in vectors})
    got = dict(rows(spark, small, "model_accuracy"))
    assert set(got) == {"logistic", "tree"} and all(0 <= a <= 1 for a in got.values()) and max(got.values()) >= 1 / classes / 2
    folds = rows(spark, small, "cross_validation")
    assert [f for f, _ in folds] == [0, 1, 2] and all(0 <= a <= 1 for _, a in folds)


def test_every_stamp_has_an_instant_or_a_reason(spark, small):
    found = [tuple(r) for r in QUERIES["p1_found"](spark, small).collect()]
    assert len(found) == len(set(found)) == len({r[:2] for r in found})
    counts = {r[:2]: r[2] for r in rows(spark, small, "p1_reasons")}
    for name, key, _ in (("file_timestamps", "stamp_id", 0), ("trash_entry", "trash_id", 0), ("metadata_info", "metadata_id", 0)):
        n = duckdb.sql(f"SELECT count(DISTINCT {key}) FROM '{small}/{name}.parquet'").fetchall()[0][0]
        assert counts[name, "instant"] == sum(r[0] == name for r in found) and sum(v for (t, _), v in counts.items() if t == name) >= n


def test_all_queries_are_checked_somewhere():
    here = set(re.findall(r'rows\(spark, small, "(\w+)"\)', open(__file__).read()))
    assert QUERIES.keys() - SQL.keys() == here


def test_crc32_by_hand():
    assert zlib.crc32(b"123456789") == 0xCBF43926
