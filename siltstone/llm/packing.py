"""Texts, measured in tokens, into containers of fixed capacity.

Bound-certified repacking: items are spread over partitions of bounded size
and packed there by best fit, largest first.  Dual-feasible functions map item
sizes so that their sum is a lower bound on the containers any packing needs;
the sums add up over partitions, which certifies the packing as a whole.
Containers that a partition leaves with a gap give their items back; these
exchange partitions and are packed again, in ever fewer partitions, until the bound is
met, the rest fits one partition, or an exchange saves less than GAIN, one in 200,
of the containers that were packed again.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.runtime import Scratch

#: Ranks file of a public byte-level BPE tokenizer for many languages.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the public split pattern that goes with the ranks.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Items of a partition.
PARTITION_ITEMS = 20_000
#: A container with more than this share free gives its items back.
GAP = 1 / 64
#: Another exchange is made only if the last one saved this share of containers.
GAIN = 1 / 200
#: Thresholds of the dual-feasible functions, as shares of the capacity.
THRESHOLDS = np.arange(1, 33) / 64

_ITEM = ["doc_id", "text_key", "piece_no", "n_pieces", "tokens"]
_PACKED = "kind string, part int, bin int, doc_id bigint, text_key bigint, piece_no int, n_pieces int, tokens int, free int, sums array<double>"


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, text_key, tokens) of the whole texts; a null text has no tokens.
    text_key, a 64-bit hash, tells the texts of one doc_id apart."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(tokenizer).encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(counts, pa.int32())], names=["doc_id", "text_key", "tokens"])

    texts = documents.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return texts.mapInArrow(measure, "doc_id bigint, text_key bigint, tokens int")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each item, free space of each bin), best fit by decreasing size."""
    bins = np.empty(len(sizes), dtype=np.int32)
    free: list[int] = []
    by_free: dict[int, list[int]] = {}
    spaces: list[int] = []  # free spaces that some bin has, ascending
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        at = bisect_left(spaces, size)
        if at < len(spaces):
            space = spaces[at]
            held = by_free[space]
            b = held.pop()
            if not held:
                del by_free[space], spaces[at]
        else:
            b, space = len(free), capacity
            free.append(capacity)
        bins[i], rest = b, space - size
        free[b] = rest
        if rest:
            if rest not in by_free:
                by_free[rest] = []
                spaces.insert(bisect_left(spaces, rest), rest)
            by_free[rest].append(b)
    return bins, np.array(free, dtype=np.int64)


def bound_sums(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Sums over items of each dual-feasible function; the largest, rounded up,
    is a lower bound on the containers.

    The first is the plain share of the capacity.  That of a threshold t counts
    an item above 1 - t as a whole container, one below t not at all.
    """
    share = sizes / capacity
    out = [float(share.sum())]
    for t in THRESHOLDS:
        out.append(float(share[(share >= t) & (share <= 1 - t)].sum() + (share > 1 - t).sum()))
    return np.array(out)


def lower_bound(sums: np.ndarray) -> int:
    return int(np.ceil(np.max(sums) - 1e-6)) if len(sums) else 0


def _pack_part(capacity: int, last: bool):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        # A fixed order makes the result independent of how rows arrive.
        pdf = pdf.sort_values(["tokens", "doc_id", "text_key", "piece_no"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        sizes = pdf["tokens"].to_numpy(dtype=np.int64)
        bins, free = best_fit(sizes, capacity)
        sums = bound_sums(sizes, capacity)
        keep_all = last or len(free) <= lower_bound(sums)
        pdf["bin"], pdf["free"] = bins, free[bins].astype(np.int32)
        pdf["kind"] = np.where(keep_all | (free[bins] <= capacity * GAP), "placed", "open")
        pdf["sums"] = None
        told = pd.DataFrame({"kind": ["sums"], "part": [pdf["part"].iloc[0]], "sums": [sums.tolist()]})
        numbers = {"bin": "Int32", "doc_id": "Int64", "text_key": "Int64", "piece_no": "Int32", "n_pieces": "Int32", "tokens": "Int32", "free": "Int32"}
        # Nullable integers first: floats between would lose digits of large identifiers.
        return pd.concat([pdf.astype(numbers), told])[["kind", "part", "bin", *_ITEM, "free", "sums"]]

    return pack


def pack_documents(documents: DataFrame, capacity: int, tokenizer: str = TOKENIZER) -> tuple[DataFrame, int, int]:
    """Placements (doc_id, text_key, piece_no, n_pieces, tokens, container_id), the
    number of containers, and the certified lower bound on it.

    ``documents``: doc_id, text.  Only a text longer than ``capacity`` is split,
    into full pieces and one rest.  A text without tokens, empty or null, takes
    no room: one piece, container_id null.  Rows without doc_id are left out;
    repeated rows are packed once, different texts of one doc_id each by itself;
    an empty table gives an empty result.
    """
    scratch = Scratch(documents.sparkSession, "packing")
    sized = scratch.write(count_tokens(documents, tokenizer).distinct(), "sized", pieces=F.sum(F.call_function("div", F.col("tokens") + capacity - 1, F.lit(capacity))))
    items = max(1, scratch.rows["sized.pieces"] or 0)
    pieces = F.greatest(F.call_function("div", F.col("tokens") + capacity - 1, F.lit(capacity)), F.lit(1)).cast("int")
    split = sized.select("doc_id", "text_key", "tokens", pieces.alias("n_pieces")).select("doc_id", "text_key", F.explode(F.sequence(F.lit(1), "n_pieces")).alias("piece_no"), "n_pieces", "tokens")
    split = split.withColumn("tokens", F.when(F.col("piece_no") < F.col("n_pieces"), capacity).otherwise(F.col("tokens") - (F.col("n_pieces") - 1) * capacity).cast("int"))

    def container(round_no: int):
        return F.concat_ws(":", F.lit(round_no), "part", "bin").alias("container_id")

    whole = split.where(F.col("tokens") == capacity)
    rest = split.where((F.col("tokens") > 0) & (F.col("tokens") < capacity)).select(*_ITEM)
    # Full pieces fill a container each, which is named after them.
    placed = [
        whole.select(*_ITEM, F.concat_ws(":", F.lit("whole"), "doc_id", "text_key", "piece_no").alias("container_id")),
        split.where("tokens = 0").select(*_ITEM, F.lit(None).cast("string").alias("container_id")),
    ]
    n_whole = whole.count()
    total, bound, round_no, left, before = n_whole, None, 0, items, None
    while left:
        parts = max(1, -(-left // PARTITION_ITEMS))
        parted = rest.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_key", "piece_no", F.lit(round_no)), F.lit(parts)).cast("int"))
        packed = parted.groupBy("part").applyInPandas(_pack_part(capacity, parts == 1), _PACKED)
        is_open, is_item = F.col("kind") == "open", F.col("kind") != "sums"
        name = f"round{round_no}"
        packed = scratch.write(packed, name, open=F.count_if(is_open))
        if bound is None:
            # One vector of sums per partition, added up in the executors.
            sums = packed.where("kind = 'sums'").select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
            bound = n_whole + lower_bound(np.array([r["v"] for r in sums]))
        bins = packed.where(is_item).select("part", "bin", is_open.alias("open")).distinct().agg(F.count(F.lit(1)).alias("n"), F.count_if("open").alias("open")).first()
        left = scratch.rows[f"{name}.open"]
        if before is not None and bins["n"] > before * (1 - GAIN):
            left = 0  # no exchange helps any more: everything stays where it is
        keep = is_item & ~is_open if left else is_item
        total += bins["n"] - (bins["open"] if left else 0)
        before = bins["open"]
        placed.append(packed.where(keep).select(*_ITEM, container(round_no)))
        rest = packed.where(is_open).select(*_ITEM)
        round_no += 1
    return reduce(DataFrame.unionByName, placed), total, bound if bound is not None else n_whole


def split_documents(placements: DataFrame) -> DataFrame:
    """(doc_id) of the texts whose pieces lie in several containers."""
    spread = placements.where("container_id is not null").groupBy("doc_id", "text_key").agg(F.min("container_id").alias("a"), F.max("container_id").alias("b"))
    return spread.where("a < b").select("doc_id").distinct()


def audit(placements: DataFrame, capacity: int, containers: int, bound: int, slack: float = 0.01) -> DataFrame:
    """One row that checks a packing: documents, containers that hold more than
    ``capacity``, texts not placed exactly once and in full, texts split that
    would have fitted, whether the containers are as many as was said, and
    whether they exceed the certified bound by no more than ``slack``."""
    loads = placements.where("container_id is not null").groupBy("container_id").agg(F.sum("tokens").alias("load"))
    texts = placements.groupBy("doc_id", "text_key").agg(
        F.count(F.lit(1)).alias("pieces"), F.count_distinct("piece_no").alias("numbers"), F.max("piece_no").alias("last"), F.max("n_pieces").alias("n"), F.sum("tokens").alias("tokens"),
        F.count_if((F.col("piece_no") < F.col("n_pieces")) & (F.col("tokens") != capacity)).alias("short"),
    )
    of_loads = loads.agg(F.count_if(F.col("load") > capacity).alias("overfull"), (F.count(F.lit(1)) == containers).alias("counted"))
    wrong = (F.col("pieces") != F.col("n")) | (F.col("numbers") != F.col("n")) | (F.col("last") != F.col("n")) | (F.col("short") > 0)
    of_texts = texts.agg(F.count_distinct("doc_id").alias("documents"), F.count_if(wrong).alias("misplaced"), F.count_if((F.col("n") > 1) & (F.col("tokens") <= capacity)).alias("split_short"))
    near = F.lit(containers <= bound * (1 + slack) + 1)
    return of_texts.crossJoin(of_loads).select("documents", "overfull", "misplaced", "split_short", "counted", near.alias("near_bound"))  # a row each
