"""Passages of evaluation items in training documents.

Words are compared without case, accents and punctuation.  Seeds are the items'
word n-grams; of every passage of PASSAGE words the two rarest disjoint ones
are kept, rarity counted over all documents, so that one changed word leaves
at least one seed and worn phrases seed little.  One pass over the documents
finds their n-grams that may be seeds, by a Bloom filter of bounded size, and
keeps the words around them; a join with the table of seeds makes exact what
the filter let through.  Where a seed joins a document to an item, all local
alignments of the words around it decide: some PASSAGE or more consecutive item
words, or the whole of a shorter item, must be covered with at most one word in
ten changed, wherever in them the change lies.

Documents and items alike are cut into boxes of BOX words, so that an alignment
never sees more than a box and its surroundings, however long a text is.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.runtime import Scratch, maybe_broadcast

#: Words of a seed; a shorter item is a seed as a whole.
SEED = 4
#: Consecutive item words that make a case.
PASSAGE = 12
#: Share of those words that may differ.
CHANGED = 0.1
#: A longer passage with few enough changes holds one of PASSAGE to twice PASSAGE words with few enough.
LONGEST = 2 * PASSAGE - 1
CHANGES = int(LONGEST * CHANGED + 1e-9)
#: Words of a box, and of its surroundings on either side.
BOX = 128
AROUND = LONGEST + CHANGES
#: Bits of the filter of seeds: so many for each, in all at most (32 MB).
SEED_BITS, MOST_BITS = 64, 1 << 28
#: Pairs aligned at once.
ALIGNED = 256
#: Item boxes, of some 2 kB each, that may be broadcast.
BROADCAST_BOXES = 5_000
#: Words whose hashes a Python worker remembers, and words handled together.
REMEMBERED, TOGETHER = 1_000_000, 500_000

_WORD = re.compile(r"[^\W_]+")
_APOSTROPHE = re.compile(r"(?<=\w)['’ʼ`´](?=\w)")
#: Combining marks that accents decompose to.
_MARKS = re.compile("[\u0300-\u036f\u0483-\u0489\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")
_BOXES = "ident bigint, owner bigint, box bigint, base bigint, n bigint, words array<bigint>, seeds array<bigint>, at array<bigint>"
#: Odd multipliers of the n-gram code and of the filter's hashes.
_STEP, _TURNS = np.uint64(0x9E3779B97F4A7C15), tuple(np.uint64(m) for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


def plain(text: str) -> str:
    """A text without case, accents and marks, apostrophes inside words left out."""
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return _APOSTROPHE.sub("", text.casefold())


def words(text: str) -> list[str]:
    """The words of a text without case, accents, punctuation and quote marks.

    An apostrophe inside a word joins its parts, whatever sign writes it.
    """
    return _WORD.findall(plain(text))


class _Hashes(dict):
    """Word to 64-bit hash, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got

    def of(self, text: str) -> np.ndarray:
        # A very long text is never held as a list of words.
        found = _WORD.findall(plain(text)) if len(text) < 4_000_000 else (m.group() for m in _WORD.finditer(plain(text)))
        return np.fromiter(map(self.__getitem__, found), dtype=np.uint64)


def ngram_codes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Code of the n-gram of ``size`` words at each place that has one."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    code = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        code = (code ^ hashes[k : n + k]) * _STEP
        code ^= code >> np.uint64(29)
    return code


def _spots(codes: np.ndarray, turn: np.uint64, bits: int) -> np.ndarray:
    """Bits of the filter that stand for the codes under one of its hashes."""
    return (codes * turn) >> np.uint64(64 - (bits.bit_length() - 1))


def _in_filter(codes: np.ndarray, blob: np.ndarray, bits: int) -> np.ndarray:
    """Places of the codes that the filter holds."""
    at = np.arange(len(codes))
    for turn in _TURNS:
        spot = _spots(codes[at], turn, bits)
        at = at[(blob[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    return at


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    def lists(k: int) -> pa.Array:
        parts = [r[k] for r in rows]
        ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
        flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int64) if flat.dtype != np.uint64 else flat.view(np.int64)))

    whole = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
    return pa.RecordBatch.from_arrays([*whole, *(lists(k) for k in (5, 6, 7))], names=[c.split()[0] for c in _BOXES.split(", ")])


def _boxes(ident: int, owner: int, hashes: np.ndarray, seeds: np.ndarray, at: np.ndarray) -> Iterator[tuple]:
    """The boxes of one text that hold seeds at the places ``at``, ascending.

    ``owner`` tells the texts of one ``ident`` apart."""
    box = at // BOX
    for k in np.flatnonzero(np.r_[True, box[1:] != box[:-1]]) if len(at) else ():
        b = int(box[k])
        end = int(np.searchsorted(box, b, "right"))
        base = max(0, b * BOX - AROUND)
        yield ident, owner, b, base, len(hashes), hashes[base : (b + 1) * BOX + SEED + AROUND], seeds[k:end], at[k:end]


def _item_boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items to boxes of words, each n-gram a seed."""
    known = _Hashes()
    for batch in batches:
        rows = []
        for ident, owner, text in zip(*(batch.column(c).to_pylist() for c in ("ident", "owner", "text")), strict=True):
            hashes = known.of(text)
            seeds = ngram_codes(hashes, min(SEED, len(hashes))) if len(hashes) else hashes
            rows += _boxes(ident, owner, hashes, seeds, np.arange(len(seeds)))
        yield _emit(rows)


def _text_boxes(blob, bits: int, sizes: list[int]):
    """Documents to the boxes that hold n-grams which the filter of seeds holds.

    Many documents go through the filter together; no n-gram spans two of them.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = _Hashes(), np.frombuffer(blob.value, dtype=np.uint8)

        def flush(idents: list[int], owners: list[int], texts: list[np.ndarray]) -> pa.RecordBatch:
            ends = np.cumsum([len(t) for t in texts])
            flat = np.concatenate(texts)
            whose = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
            places, codes = [], []
            for size in sizes:
                every = ngram_codes(flat, size)
                at = _in_filter(every, held, bits)
                at = at[whose[at] == whose[at + size - 1]]
                places.append(at)
                codes.append(every[at])
            place, code = np.concatenate(places), np.concatenate(codes)
            order = np.argsort(place, kind="stable")
            place, code = place[order], code[order]
            rows = []
            cuts = np.searchsorted(place, ends)
            for k in np.unique(whose[place]):
                low, high = (cuts[k - 1] if k else 0), cuts[k]
                start = ends[k] - len(texts[k])
                rows += _boxes(idents[k], owners[k], texts[k], code[low:high], place[low:high] - start)
            return _emit(rows)

        for batch in batches:
            idents, owners, texts, n = [], [], [], 0
            for ident, owner, text in zip(*(batch.column(c).to_pylist() for c in ("ident", "owner", "text")), strict=True):
                idents.append(ident)
                owners.append(owner)
                texts.append(known.of(text))
                n += len(texts[-1])
                if n >= TOGETHER:
                    yield flush(idents, owners, texts)
                    idents, owners, texts, n = [], [], [], 0
            if texts:
                yield flush(idents, owners, texts)

    return find


def _filter_blocks(bits: int):
    """Set bits of a block of the filter, packed."""
    size = min(bits, 1 << 15)

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        spots = table["spot"].to_numpy() % size
        here = np.zeros(size, dtype=np.uint8)
        here[spots] = 1
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(here, bitorder="little").tobytes()], pa.binary())})

    return size, pack


def _filter(seeds: DataFrame, n: int) -> tuple[bytes, int]:
    """The filter of ``seeds.seed`` and its number of bits, at most MOST_BITS.

    Blocks of it are made by the executors; the driver puts them together.
    """
    bits = min(MOST_BITS, 1 << max(16, (n * SEED_BITS).bit_length()))
    size, pack = _filter_blocks(bits)

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column("seed").to_numpy().view(np.uint64)
            for turn in _TURNS:
                yield pa.RecordBatch.from_arrays([pa.array(_spots(codes, turn, bits).astype(np.int64))], names=["spot"])

    every = seeds.select("seed").mapInArrow(spots, "spot bigint").distinct()
    blocks = every.withColumn("block", F.call_function("div", "spot", F.lit(size))).groupBy("block").applyInArrow(pack, "block bigint, bits binary").collect()
    blob = bytearray(bits // 8)
    for r in blocks:
        blob[r["block"] * size // 8 : (r["block"] + 1) * size // 8] = r["bits"]
    return bytes(blob), bits


def _rarest(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of the seeds (item, item_id, n, p, seed, hits) of an item's text the two rarest
    disjoint ones of each passage."""
    pdf = pdf.sort_values("p")
    hits, places = pdf["hits"].to_numpy(), pdf["p"].to_numpy()
    n = int(pdf["n"].iloc[0])
    taken: set[int] = set()
    for start in range(max(1, n - PASSAGE + 1)):
        here = range(start, min(start + PASSAGE - SEED + 1, len(places)))
        first = min(here, key=lambda p: (hits[p], p))
        apart = [p for p in here if abs(p - first) >= SEED]
        taken.add(first)
        if apart:
            taken.add(min(apart, key=lambda p: (hits[p], p)))
    keep = sorted(taken)
    return pd.DataFrame({"item": pdf["item"].iloc[0], "item_id": pdf["item_id"].iloc[0], "p": places[keep], "seed": pdf["seed"].to_numpy()[keep]})


def align(items: list[np.ndarray], stretches: list[np.ndarray], need: np.ndarray) -> list[bool]:
    """Whether some alignment of each pair, wherever it lies, covers ``need`` item
    words or more with at most one word in ten changed.

    From every place of the score table, and for each number of changes, the
    most item words that can be covered onward are known from the row below;
    equal words are always paired.  All pairs and places of a row advance
    together, so that two rows are held.
    """
    n, rows, cols = len(items), max(map(len, items)), max(map(len, stretches))
    # The last column is past the end of every stretch.
    a, b = np.zeros((n, rows), dtype=np.int64), np.zeros((n, cols + 1), dtype=np.int64)
    in_a, in_b = np.zeros(a.shape, dtype=bool), np.zeros(b.shape, dtype=bool)
    for k, (x, y) in enumerate(zip(items, stretches, strict=True)):
        a[k, : len(x)], b[k, : len(y)] = x, y
        in_a[k, : len(x)], in_b[k, : len(y)] = True, True
    least = [np.maximum(need, int(np.ceil(e / CHANGED - 1e-9)))[:, None] for e in range(CHANGES + 1)]
    onward = lambda reach: np.concatenate([reach[:, 1:], reach[:, -1:]], axis=1)
    below = [np.zeros((n, cols + 1), dtype=np.int32) for _ in range(CHANGES + 1)]
    found = np.zeros(n, dtype=bool)
    for i in range(rows - 1, -1, -1):
        same = (a[:, i, None] == b) & in_b
        inside = in_a[:, i, None]
        here: list[np.ndarray] = []
        for e in range(CHANGES + 1):
            reach = np.zeros_like(below[e])
            if e:  # the item word changed, left out, or a word put in before it
                reach = np.maximum(np.maximum(onward(below[e - 1]), below[e - 1]) + 1, onward(here[e - 1]))
            reach = np.where(same, onward(below[e]) + 1, reach) * inside
            found |= (reach >= least[e]).any(axis=1)
            here.append(reach)
        below = here
    return found.tolist()


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of boxes with the span of their seeds to the pairs that hold a passage."""
    for batch in batches:
        if not len(batch):
            continue
        # Pairs of like length go together, so that little is padded.
        batch = batch.assign(wide=batch["q1"] - batch["q0"]).sort_values("wide")
        for at in range(0, len(batch), ALIGNED):
            part = batch.iloc[at : at + ALIGNED]
            texts = [np.asarray(w)[max(0, q0 - base - AROUND) : q1 - base + SEED + AROUND] for w, base, q0, q1 in zip(part["words"], part["base"], part["q0"], part["q1"], strict=True)]
            items = [np.asarray(w)[max(0, p0 - base - AROUND) : p1 - base + SEED + AROUND] for w, base, p0, p1 in zip(part["item_words"], part["item_base"], part["p0"], part["p1"], strict=True)]
            ok = align(items, texts, np.minimum(part["n"].to_numpy(), PASSAGE))
            yield part.loc[ok, ["item_id", "doc_id"]]


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Rows (item_id, doc_id): documents that hold an item or a passage of it.

    ``documents``: doc_id, text; ``items``: item_id, text.  Both may be of any
    number and length: texts are read once, whatever the number of items.  An
    item of fewer than SEED words counts where all its words stand in a row.
    Texts that are null or have no word match nothing; rows without id are left
    out; repeated rows count once, and two texts of one id are both looked at;
    an empty table gives an empty result.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "leaks")

    def owned(df: DataFrame, key: str) -> DataFrame:
        known = df.where(F.col(key).isNotNull() & F.col("text").isNotNull())
        return known.select(F.col(key).cast("bigint").alias("ident"), F.xxhash64(key, "text").alias("owner"), "text")

    asked = scratch.write(owned(items, "item_id").distinct().mapInArrow(_item_boxes, _BOXES), "items", seeds=F.sum(F.size("seeds")))
    if not scratch.rows["items"]:
        return spark.createDataFrame([], "item_id bigint, doc_id bigint")
    seeds = asked.select(F.col("owner").alias("item"), F.col("ident").alias("item_id"), "n", F.inline(F.arrays_zip(F.col("at").alias("p"), F.col("seeds").alias("seed"))))
    sizes = sorted(r["size"] for r in asked.select(F.least("n", F.lit(SEED)).alias("size")).distinct().collect())  # at most SEED
    blob, bits = _filter(seeds, scratch.rows["items.seeds"])
    shared = spark.sparkContext.broadcast(blob)
    hits = scratch.write(owned(documents, "doc_id").mapInArrow(_text_boxes(shared, bits, sizes), _BOXES), "hits")
    spots = hits.select(F.col("ident").alias("doc_id"), F.col("owner").alias("doc"), "box", F.inline(F.arrays_zip(F.col("at").alias("q"), F.col("seeds").alias("seed"))))
    counts = spots.groupBy("seed").agg(F.count(F.lit(1)).alias("hits"))
    # Seeds that no document holds are rarest, and seed nothing.
    ranked = seeds.join(counts, "seed", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    rare = scratch.write(ranked.groupBy("item").applyInPandas(_rarest, "item bigint, item_id bigint, p bigint, seed bigint"), "rare")
    met = spots.join(maybe_broadcast(rare, scratch.rows["rare"]), "seed")
    spans = (F.min("q").alias("q0"), F.max("q").alias("q1"), F.min("p").alias("p0"), F.max("p").alias("p1"))
    pairs = met.groupBy("doc_id", "doc", "box", "item_id", "item", F.call_function("div", "p", F.lit(BOX)).alias("item_box")).agg(*spans)
    texts = hits.select(F.col("owner").alias("doc"), "box", "base", "words").dropDuplicates(["doc", "box"])  # repeated rows
    boxes = asked.select(F.col("owner").alias("item"), F.col("box").alias("item_box"), F.col("base").alias("item_base"), "n", F.col("words").alias("item_words"))
    joined = pairs.join(texts, ["doc", "box"]).join(maybe_broadcast(boxes, scratch.rows["items"], BROADCAST_BOXES), ["item", "item_box"])
    return joined.drop("doc", "item", "box", "item_box").mapInPandas(_judge, "item_id bigint, doc_id bigint").distinct()
