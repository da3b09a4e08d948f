"""Languages of documents and of their segments, with a confidence.

Error-correcting output codes: each language has a codeword, each bit of it a
binary classifier over character n-grams of words.  A sentence's n-grams vote
on every bit; the language whose codeword loses least, bits weighted by how
well their classifiers did on the training sample, wins, and a near tie leaves
the sentence undetermined.  Classifiers are fitted on a bounded sample of
labelled documents, for the languages that its labels name; wrong labels in it
are outvoted by refitting on the classifiers' own reading of each sentence.  A
sentence whose n-grams fit even its best language worse than held-out sentences
do is in none of them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Codes and names by which a label names a language.  Those that
#: labels do name are told apart; a caller may give a longer table.
NAMES = {
    "en": "en eng english inglés ingles englisch anglais inglês inglese английский",
    "es": "es spa esp spanish español espanol castellano castilian spanisch espagnol espanhol spagnolo испанский",
    "de": "de deu ger german deutsch alemán aleman allemand alemão alemao tedesco немецкий",
    "fr": "fr fra fre french français francais francés frances französisch franzosisch francês francese французский",
    "pt": "pt por portuguese português portugues portugués portugiesisch portugais portoghese португальский",
    "it": "it ita italian italiano italienisch italien итальянский",
    "ru": "ru rus russian русский ruso russisch russe russo",
    "nl": "nl nld dut dutch nederlands", "sv": "sv swe swedish svenska", "da": "da dan danish dansk", "no": "no nor nb nob norwegian norsk", "fi": "fi fin finnish suomi",
    "pl": "pl pol polish polski", "cs": "cs ces cze czech čeština", "hu": "hu hun hungarian magyar", "ro": "ro ron rum romanian română", "tr": "tr tur turkish türkçe",
    "uk": "uk ukr ukrainian українська", "el": "el ell gre greek ελληνικά", "ca": "ca cat catalan català",
}
#: Labelled documents in the training sample, at most.
SAMPLE_DOCUMENTS = 6_000
#: A longer document, in characters, is left out of the sample, so that 300 MB bound it.
SAMPLE_LONGEST = 50_000
#: Sample documents whose label names a language, at least, for it to be told apart.
LEAST_DOCUMENTS = 5
#: Longest n-gram, and buckets into which n-grams are hashed.
LONGEST = 4
BUCKETS = 1 << 16
#: Bits of a codeword.
BITS = 21
#: Words that a sentence must have to count as a whole sentence.
WHOLE = 8
#: Least lead, in confidence, over the second language.
LEAD = 0.2
REFITS = 2
#: A sentence is in no known language if it fits worse than all but this share of
#: held-out sentences, by more than SLACK of their spread below the median.
STRANGE, SLACK = 0.001, 0.5

_END = re.compile(r"(?<=[.!?…])[\"'»”’)\]]*\s+|\n+")
_LETTERS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: What has no language: stamps, paths, digests, key=value fields, mail and web addresses.
_NO_LANGUAGE = re.compile(r"[/\\=@\d]|::")
_SEGMENTS = "doc_id bigint, segment_no int, start int, length int, words int, whole int, lang string, confidence double"


def named_language(label: Column, names: dict[str, str] | None = None) -> Column:
    """The language code that a label names in any usual way, else null."""
    known = {w: code for code, row in (names or NAMES).items() for w in row.split()}
    first = F.regexp_extract(F.lower(F.trim(label)), r"^\p{L}+", 0)
    return F.create_map(*(F.lit(x) for pair in known.items() for x in pair))[first]


def codewords(n: int) -> np.ndarray:
    """Codewords of +1 and -1 of ``n`` languages, a row each, chosen from the ways to
    part the languages so that the closest two rows are as far apart as can be."""
    if n == 1:
        return np.ones((1, 1), dtype=np.float32)
    if n <= 10:
        ways = [[1 if i in chosen else -1 for i in range(n)] for size in range(2 if n > 3 else 1, n // 2 + 1) for chosen in combinations(range(n), size)]
    else:  # there are very many: some at random, the same every time
        ways = np.unique(np.random.default_rng(7).choice([-1, 1], size=(1_000, n)), axis=0)
    pool, taken = np.array(ways), []
    pairs = list(combinations(range(n), 2))
    for _ in range(min(BITS, len(pool))):
        def spread(k: int) -> tuple[float, int]:
            code = pool[[*taken, k]].T
            apart = sorted(int((code[i] != code[j]).sum()) for i, j in pairs)
            # Of many rows some are long alike: then each near pair counts.
            return (apart[0] if n <= 10 else -sum(0.5**d for d in apart)), sum(apart)

        taken.append(max((k for k in range(len(pool)) if k not in taken), key=spread))
    return pool[taken].T.astype(np.float32)


def sentences(text: str) -> Iterator[tuple[int, int, list[str], int]]:
    """(start, length, words, n_words) of the sentences of a text.

    words are those that can tell a language, in lower case; n_words counts all
    words.  Lines that hold mostly stamps, fields, paths or digests give none.
    """
    at = 0
    for gap in [*(m.span() for m in _END.finditer(text)), (len(text), len(text))]:
        part = text[at : gap[0]]
        start, at = at, gap[1]
        tokens = part.split()
        if not tokens:
            continue
        plain = [t for t in tokens if t.isalpha() or not _NO_LANGUAGE.search(t)]
        if len(plain) * 2 <= len(tokens):
            continue
        found = _LETTERS.findall(" ".join(plain).lower())
        if found:
            odd = [t for t in tokens if not t[0].isalnum()]
            yield start, len(part), found, len(tokens) - len([t for t in odd if not any(map(str.isalnum, t))])


def ngrams(word: str) -> np.ndarray:
    padded = f" {word} "
    return np.array([zlib.crc32(padded[i : i + n].encode()) % BUCKETS for n in range(1, LONGEST + 1) for i in range(len(padded) - n + 1)], dtype=np.int64)


class Classifier:
    """The fitted bit classifiers of ``languages``; votes of words are kept as they
    come up.  ``shares`` are log shares of n-grams in each language, ``least``
    and ``middle`` how well its held-out sentences fit at worst and mostly."""

    def __init__(self, languages: tuple[str, ...], weights: np.ndarray, bit_weights: np.ndarray, shares: np.ndarray, least: np.ndarray, middle: np.ndarray):
        self.languages, self.weights, self.bit_weights, self.shares, self.least, self.middle = languages, weights, bit_weights, shares, least, middle
        self.code = codewords(len(languages))
        self.bits = self.code.shape[1]
        self.votes: dict[str, np.ndarray] = {}

    def __reduce__(self):
        return Classifier, (self.languages, self.weights, self.bit_weights, self.shares, self.least, self.middle)

    def word(self, word: str) -> np.ndarray:
        """Votes on each bit, then the fit to each language."""
        got = self.votes.get(word)
        if got is None:
            if len(self.votes) > 500_000:
                self.votes.clear()
            at = ngrams(word)
            got = self.votes[word] = np.concatenate([self.weights[at].sum(axis=0), self.shares[at].mean(axis=0)])
        return got

    def _sums(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        numbers: dict[str, int] = {}
        flat = np.fromiter((numbers.setdefault(w, len(numbers)) for t in texts for w in t), dtype=np.int64, count=int(lengths.sum()))
        table = np.array([self.word(w) for w in numbers], dtype=np.float32)
        return np.add.reduceat(table[flat], np.concatenate([[0], np.cumsum(lengths)[:-1]]), axis=0), lengths

    def margins(self, texts: list[list[str]]) -> np.ndarray:
        """Vote on each bit, summed over the words of each sentence."""
        # n-grams of a word depend on each other: a word counts as one vote.
        return self._sums(texts)[0][:, : self.bits] / LONGEST / 4

    def fits(self, texts: list[list[str]]) -> np.ndarray:
        """How well each sentence fits each language, by its words' n-grams."""
        sums, lengths = self._sums(texts)
        return sums[:, self.bits :] / lengths[:, None]

    def decide(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its confidence, and its lead over the second; confidence
        and lead are 0 for a sentence that fits none of the languages."""
        if not texts:
            return np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0)
        sums, lengths = self._sums(texts)
        margins = sums[:, : self.bits] / LONGEST / 4
        losses = np.stack([(np.logaddexp(0, -margins * row) * self.bit_weights).sum(axis=1) for row in self.code], axis=1)
        likely = np.exp(losses.min(axis=1, keepdims=True) - losses)
        likely /= likely.sum(axis=1, keepdims=True)
        order = np.sort(likely, axis=1)
        best = likely.argmax(axis=1)
        fit = sums[np.arange(len(best)), self.bits + best] / lengths
        # Few words vary more.
        spread = np.sqrt(WHOLE / np.minimum(np.maximum(lengths, 1), WHOLE))
        known = fit >= self.middle[best] - (self.middle - self.least)[best] * spread
        return best, order[:, -1] * known, (order[:, -1] - order[:, -2] if order.shape[1] > 1 else order[:, -1]) * known


def _counts(by_word: dict[str, np.ndarray], n: int) -> np.ndarray:
    counts = np.full((n, BUCKETS), 0.02)
    for w, of in by_word.items():
        np.add.at(counts.T, ngrams(w), of)
    return counts


def fit(texts: list[list[str]], labels: np.ndarray, languages: tuple[str, ...]) -> Classifier:
    """Bit classifiers (log odds of hashed n-grams) of labelled sentences."""
    n = len(languages)
    code = codewords(n)
    bits = code.shape[1]
    none = np.zeros(n)
    for again in range(REFITS + 1):
        halves: list[dict[str, np.ndarray]] = [{}, {}]
        for k, (words, label) in enumerate(zip(texts, labels, strict=True)):
            by_word = halves[k % 2]
            for w in words:
                if w not in by_word:
                    by_word[w] = np.zeros(n)
                by_word[w][label] += 1
        whole = {w: halves[0].get(w, none) + halves[1].get(w, none) for w in (*halves[0], *halves[1])}
        counts = _counts(whole, n)
        weights = np.zeros((BUCKETS, bits), dtype=np.float32)
        share = counts / counts.sum(axis=1, keepdims=True)  # each language counts alike
        for b in range(bits if n > 1 else 0):
            yes, no = share[code[:, b] > 0].mean(axis=0), share[code[:, b] < 0].mean(axis=0)
            weights[:, b] = np.clip(np.log(yes / no), -4, 4)
        shares = np.log(share.T).astype(np.float32)
        model = Classifier(languages, weights, np.ones(bits, dtype=np.float32), shares, np.full(n, -np.inf), np.zeros(n))
        right = (np.sign(model.margins(texts)) == code[labels]).mean(axis=0)
        model.bit_weights = np.clip(np.log(right / (1 - right + 1e-3)), 0.1, 5).astype(np.float32)
        model.bit_weights /= model.bit_weights.mean()
        if again < REFITS:
            labels = model.decide(texts)[0]
    # Each half of the sentences is held out from the other's counts.
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for k in (0, 1):
        some, of = texts[1 - k :: 2], np.asarray(labels)[1 - k :: 2]
        if not some:
            continue
        counts = _counts(halves[k], n)
        half = Classifier(languages, weights, model.bit_weights, np.log(counts / counts.sum(axis=1, keepdims=True)).T.astype(np.float32), model.least, model.middle)
        held.append((half.fits(some)[np.arange(len(some)), of], of))
    scores, of = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
    for i in range(n):
        mine = scores[of == i]
        if len(mine) >= 20:
            model.middle[i] = np.median(mine)
            low = np.quantile(mine, STRANGE)
            model.least[i] = low - SLACK * (model.middle[i] - low)
    return model


def train(documents: DataFrame, sample: int = SAMPLE_DOCUMENTS, names: dict[str, str] | None = None) -> Classifier | None:
    """A classifier fitted on at most ``sample`` documents whose label names a
    language, drawn alike from each language by a hash of doc_id and read whole;
    those longer than SAMPLE_LONGEST are left out.  It tells the languages apart
    that LEAST_DOCUMENTS of them or more name.  None if there are none."""
    labelled = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", named_language(F.col("lang"), names).alias("named")).where("named is not null")
    # Counting and drawing read labels alone, and a rank limit is applied before the shuffle.
    present = labelled.select("named").distinct().count()  # at most as many as names
    if not present:
        return None
    order = Window.partitionBy("named").orderBy(F.xxhash64("doc_id"), "doc_id")
    drawn = labelled.select("doc_id", "named").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(1, sample // present)).select("doc_id", "named")
    read = labelled.where(F.length("text") <= SAMPLE_LONGEST).join(F.broadcast(drawn.distinct()), ["doc_id", "named"], "left_semi")
    rows = read.orderBy("doc_id", "text").limit(sample).collect()
    found = [r["named"] for r in rows]
    languages = tuple(c for c in (names or NAMES) if found.count(c) >= min(LEAST_DOCUMENTS, len(rows)))
    texts, labels = [], []
    for r in rows:
        if r["named"] in languages:
            for _, _, words, n in sentences(r["text"]):
                if n >= WHOLE:
                    texts.append(words)
                    labels.append(languages.index(r["named"]))
    return fit(texts, np.array(labels), languages) if texts else None


def label_segments(documents: DataFrame, model: Classifier, carried: str | None = None) -> DataFrame:
    """Segments (doc_id, segment_no, start, length, words, whole, lang, confidence).

    A segment is a run of sentences of one language, from character ``start``;
    ``whole`` counts its sentences of at least WHOLE words, ``confidence`` is
    the mean over its words.  A sentence whose lead is below LEAD is ``und``.
    A text that is null, empty or without sentences gives one row of segment
    0, lang ``und`` and confidence 0.  Rows without doc_id are left out.
    ``carried`` names a STRING column that goes along.
    """

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            owner, starts, lengths, words, counts = [], [], [], [], []
            for k, text in enumerate(texts):
                for start, length, found, n in sentences(text or ""):
                    owner.append(k)
                    starts.append(start)
                    lengths.append(length)
                    words.append(found)
                    counts.append(n)
            best, confidence, lead = model.decide(words)
            frame = pd.DataFrame({"k": owner, "start": starts, "end": np.add(starts, lengths) if starts else [], "words": counts, "lang": np.where(lead >= LEAD, best, -1)})
            frame["whole"] = (frame["words"] >= WHOLE).astype(int) if len(frame) else []
            frame["weighted"] = confidence * frame["words"] if len(frame) else []
            new = (frame["k"] != frame["k"].shift()) | (frame["lang"] != frame["lang"].shift())
            out = frame.groupby(new.cumsum()).agg(k=("k", "first"), start=("start", "min"), end=("end", "max"), words=("words", "sum"), whole=("whole", "sum"), lang=("lang", "first"), weighted=("weighted", "sum"))
            none = sorted(set(range(len(ids))) - set(owner))
            out = pd.concat([out, pd.DataFrame({"k": none, "start": 0, "end": 0, "words": 0, "whole": 0, "lang": -1, "weighted": 0.0})]).sort_values(["k", "start"], kind="stable")
            names = np.array([*model.languages, "und"])
            place = out["k"].astype(int).to_numpy()
            along = [batch.column(carried).take(pa.array(place))] if carried else []
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[k] for k in place], pa.int64()), pa.array(out.groupby("k").cumcount(), pa.int32()), pa.array(out["start"].astype("int32"), pa.int32()),
                    pa.array((out["end"] - out["start"]).astype("int32"), pa.int32()), pa.array(out["words"].astype("int32"), pa.int32()),
                    pa.array(out["whole"].astype("int32"), pa.int32()), pa.array(names[out["lang"].astype(int)]), pa.array((out["weighted"] / np.maximum(out["words"], 1)).astype(float), pa.float64()), *along,
                ],
                names=["doc_id", "segment_no", "start", "length", "words", "whole", "lang", "confidence", *([carried] if carried else [])],
            )

    texts = documents.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *([carried] if carried else []))
    return texts.mapInArrow(label, _SEGMENTS + (f", {carried} string" if carried else ""))


def label_documents(segments: DataFrame) -> DataFrame:
    """(doc_id, lang, confidence): the language of most words of each document,
    and their share times the mean confidence; ``und`` where no segment has one."""
    by = segments.groupBy("doc_id", "lang").agg(F.sum("words").alias("n"), F.sum(F.col("words") * F.col("confidence")).alias("c"))
    best = by.groupBy("doc_id").agg(F.max(F.struct((F.col("lang") != "und").alias("known"), "n", "lang", "c")).alias("b"), F.sum("n").alias("all_n"))
    return best.select("doc_id", F.col("b.lang").alias("lang"), F.when(F.col("b.known"), F.col("b.c") / F.greatest("all_n", F.lit(1))).otherwise(0.0).alias("confidence"))


def languages_not_named(documents: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Rows (doc_id, lang): languages of whole sentences other than the one that
    the document's label names.  Texts are read twice, for the sample and for
    the labels, which travel with their document.  Of several rows of one doc_id
    each counts with its own label.  Empty if no document has a usable label."""
    spark = documents.sparkSession
    model = train(documents, names=names)
    if model is None:
        return spark.createDataFrame([], "doc_id bigint, lang string")
    named = documents.select("doc_id", "text", named_language(F.col("lang"), names).alias("named"))
    found = label_segments(named, model, "named").where((F.col("whole") > 0) & (F.col("lang") != "und") & ~F.col("lang").eqNullSafe(F.col("named")))
    return found.select("doc_id", "lang").distinct()
