import random

import pytest

from siltstone.llm import contamination
from siltstone.llm.contamination import leaked_items, words

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
ITEM = "Ein vorsichtiger Prüfer versiegelte sieben kupferne Laufwerke unter der alten Treppe trotz abgelaufener Anordnung und notierte danach jede einzelne Nummer."
OTHER = "the quick brown fox jumps over a lazy dog while seven grey cats watch from behind the broken kitchen window every night"


def run(spark, docs, items=((1, ITEM), (2, OTHER))):
    got = [tuple(r) for r in leaked_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(list(items), ITEMS)).collect()]
    assert len(got) == len(set(got))
    return set(got)


def filler(rng, n):
    return " ".join("".join(rng.choice("bcdfgaeiou") for _ in range(6)) for _ in range(n))


def test_whole_partial_edited_and_short_passages(spark):
    rng, w = random.Random(1), OTHER.split()
    changed = w[:5] + ["PURPLE"] + w[6:13]
    docs = {
        1: ITEM, 2: filler(rng, 40) + " " + OTHER + " " + filler(rng, 40), 3: filler(rng, 20) + " " + " ".join(w[4:16]) + " " + filler(rng, 9),
        4: " ".join(w[4:12]) + " " + filler(rng, 30), 5: filler(rng, 9) + " " + " ".join(changed) + " " + filler(rng, 9),
        6: " ".join(x if k % 3 else "zzz" for k, x in enumerate(w)), 7: filler(rng, 300), 8: ITEM + "\n" + OTHER,
        9: "THE QUICK\nBROWN «fox» jumps—over, a LAZY dog...while seven grey cats watch", 10: "ein vorsichtiger prufer versiegelte sieben kupferne laufwerke unter der alten treppe trotz abgelaufener",
        11: " ".join(w[:6] + ["really"] + w[6:12]), 12: " ".join(w[:6] + w[7:14]),
    }
    got = run(spark, [(k, t) for k, t in docs.items()])
    assert got == {(1, 1), (2, 2), (2, 3), (2, 5), (1, 8), (2, 8), (2, 9), (1, 10), (2, 11), (2, 12)}


def test_null_empty_repeated_long_and_clashing(spark):
    rng = random.Random(2)
    long = filler(rng, 20_000) + " " + OTHER + " " + filler(rng, 20_000)
    docs = [(1, None), (2, ""), (3, OTHER), (3, OTHER), (None, OTHER), (4, long)]
    items = [(1, None), (2, OTHER), (2, OTHER), (3, ""), (None, OTHER), (4, "two words")]
    assert run(spark, docs, items) == {(2, 3), (2, 4)}
    df = spark.createDataFrame([(5, OTHER, 1, "x")], DOCS + ", item_id long, words string")
    it = spark.createDataFrame([(2, OTHER, 7)], ITEMS + ", doc_id long")
    assert [tuple(r) for r in leaked_items(df, it).collect()] == [(2, 5)]


def test_empty_tables(spark):
    assert run(spark, []) == set()
    assert leaked_items(spark.createDataFrame([(1, OTHER)], DOCS), spark.createDataFrame([], ITEMS)).collect() == []


def test_many_items_take_one_pass_and_shuffled_joins(spark, monkeypatch):
    monkeypatch.setattr(contamination, "maybe_broadcast", lambda df, *_: df)
    rng = random.Random(9)
    items = [(k, filler(rng, 15)) for k in range(300)]
    docs = [(k, " ".join([filler(rng, 5), t, filler(rng, 5)])) for k, t in items[::3]]
    assert run(spark, docs, items) == {(k, k) for k in range(0, 300, 3)}


def test_items_of_few_words_count_where_they_stand_in_a_row(spark):
    docs = [(1, "He wrote: Rusty, copper key!"), (2, "a rusty old copper key"), (3, "key copper rusty"), (4, "Schlüssel"), (5, "one two three changed five six seven eight nine ten"), (6, "one two three four five six seven eight nine")]
    items = [(1, "rusty copper key"), (2, "schlussel"), (3, "one two three four five six seven eight nine ten"), (4, "?!"), (5, "five six seven eight")]
    assert run(spark, docs, items) == {(1, 1), (2, 4), (3, 5), (3, 6), (5, 5), (5, 6)}


def test_long_items_and_texts_cross_boxes(spark):
    rng = random.Random(11)
    item = filler(rng, 2_000).split()
    docs = []
    for k, start in enumerate((0, 100, 117, 120, 126, 128, 250, 1_000, 1_988)):
        docs.append((k, " ".join([filler(rng, 118 + k), *item[start : start + 12], filler(rng, 130)])))
        docs.append((100 + k, " ".join([filler(rng, 120), *item[start : start + 10], filler(rng, 130)])))
    docs.append((200, " ".join(item)))
    assert run(spark, docs, [(1, " ".join(item)), (1, OTHER)]) == {(1, k) for k in (*range(9), 200)}


def test_change_at_any_word_of_a_passage(spark):
    rng, w = random.Random(3), OTHER.split()
    docs = {}
    for n in (12, 13, 14):
        for k in range(n):
            docs[n * 100 + k] = " ".join([filler(rng, 9), *w[3 : 3 + k], "zzz", *w[4 + k : 3 + n], filler(rng, 9)])
    two = {k: " ".join([filler(rng, 9), *(x if at not in spots else "zzz" for at, x in enumerate(w[:n])), filler(rng, 9)]) for k, n, spots in ((1, 20, (8, 11)), (2, 20, (7, 8, 11)), (3, 12, (1, 7)), (4, 14, (4, 9)))}
    assert run(spark, [*docs.items(), *two.items()]) == {(2, k) for k in (*docs, 1)}


def test_passage_beside_a_longer_edited_stretch(spark):
    rng = random.Random(4)
    w = filler(rng, 80).split()
    edited = " ".join("zzz" if k % 5 == 4 else x for k, x in enumerate(w[20:]))
    docs = [(1, " ".join([edited, filler(rng, 30), *w[:12], filler(rng, 9)])), (2, edited)]
    assert run(spark, docs, [(1, " ".join(w))]) == {(1, 1)}


@pytest.mark.parametrize(("text", "want"), [("Don’t STOP, naïve—café!", ["dont", "stop", "naive", "cafe"]), ("й ё", ["и", "е"]), ("a_b  c\n\td", ["a", "b", "c", "d"]), ("", [])])
def test_words(text, want):
    assert words(text) == want
