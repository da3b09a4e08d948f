"""Fuzzy digests, perceptual hashes and set sketches, as Arrow-batched UDFs."""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import lanes

_ALPHABET = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"
#: Characters of a piecewise hash, smallest and largest block size.
PIECES, LEAST_BLOCK, MOST_BLOCK = 64, 3, 4096


def _rolling(data: np.ndarray) -> np.ndarray:
    """Rolling value after each byte: three running sums of 32 bits."""
    one = two = three = 0
    out = np.empty(len(data), dtype=np.int64)
    for i, c in enumerate(data.tolist()):
        one = ((one << 4 | one >> 28) + c) & 0xFFFFFFFF
        two = (two + c + one) & 0xFFFFFFFF
        three = ((three << 1) + c) & 0xFFFFFFFF
        out[i] = (one + two + three) & 0xFFFFFFFF
    return out


def rolling_of(datas: list[bytes]) -> list[np.ndarray]:
    """``_rolling`` of many byte strings, side by side."""
    out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(datas)
    for numbers, lengths in lanes.groups(datas):
        if len(numbers) < lanes.FEW:
            for i in numbers:
                out[i] = _rolling(np.frombuffer(datas[i], dtype=np.uint8))
            continue
        bytes_at = lanes.columns(datas, numbers, lengths).astype(np.uint32)
        one, two, three = (np.zeros(len(numbers), dtype=np.uint32) for _ in range(3))
        rolled = np.empty(bytes_at.shape, dtype=np.uint32)
        # What runs on beyond a string's end is cut off below.
        for i, c in enumerate(bytes_at):
            one = (one << np.uint32(4) | one >> np.uint32(28)) + c
            two = two + c + one
            three = (three << np.uint32(1)) + c
            rolled[i] = one + two + three
        for k, (i, n) in enumerate(zip(numbers, lengths, strict=True)):
            out[i] = rolled[:n, k].astype(np.int64)
    return out


def _pieces(data: bytes, ends: np.ndarray) -> tuple[str, int]:
    """Characters of the pieces that end before the bytes at ``ends``, and where
    the last piece starts.  A piece's character is its last six bits, which the
    running sum keeps only of its last byte."""
    starts = np.concatenate([[0], ends])[:-1]
    return "".join(_ALPHABET[_sum(data[a:b]) % 64] for a, b in zip(starts, ends, strict=True)), int(ends[-1]) if len(ends) else 0


def _sum(piece: bytes) -> int:
    return int.from_bytes(piece, "big") % 0xFFFFFFFF if piece else 0


def block_size(length: int) -> int:
    size = LEAST_BLOCK
    while size * PIECES < length:
        size *= 2
    return min(size, MOST_BLOCK)


def ssdeep_of(data: bytes, rolled: np.ndarray | None = None) -> str | None:
    """``size:one:two``: piecewise hashes at a block size and its double; null of nothing."""
    if not data:
        return None
    size = block_size(len(data))
    rolled = _rolling(np.frombuffer(data, dtype=np.uint8)) if rolled is None else rolled
    first = np.flatnonzero(rolled % size == size - 1)[: PIECES - 1]
    second = np.flatnonzero(rolled % (2 * size) == 2 * size - 1)[: PIECES - 1]
    out = []
    for ends in (first, second):
        text, at = _pieces(data, ends)
        rest = _sum(data[at:])
        out.append(text + (_ALPHABET[rest % 64] if rest else ""))
    return f"{size}:{out[0]}:{out[1]}"


def tlsh_of(data: bytes) -> str | None:
    """Locality digest of at least 50 bytes: length checks, then counts of byte classes."""
    if data is None or len(data) < 50:
        return None
    counts = np.minimum(np.bincount(np.frombuffer(data, dtype=np.uint8) % 128, minlength=128), 255)
    level = sum(len(data) > limit for limit in (1 << k for k in range(8, 21, 2)))
    return f"{len(data) % 256:02x}{level:x}0123" + "".join(f"{c:02x}" for c in counts[:8])


@F.pandas_udf(T.StringType())
def ssdeep(content: pd.Series) -> pd.Series:
    datas = [c or b"" for c in content]
    return pd.Series([ssdeep_of(d, r) for d, r in zip(datas, rolling_of(datas), strict=True)], index=content.index)


@F.pandas_udf(T.StringType())
def tlsh(content: pd.Series) -> pd.Series:
    return content.map(tlsh_of)


def ssdeep_score(a: Column, b: Column) -> Column:
    """100 for equal digests, 50 for an equal block size, else 0."""
    return F.when(a == b, 100).when(F.split(a, ":")[0] == F.split(b, ":")[0], 50).otherwise(0)


def tlsh_score(a: Column, b: Column) -> Column:
    """100 for equal digests, 0 for unlike lengths, else the percentage of equal characters."""
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda x: x))
    return F.when(a == b, 100).when(F.length(a) != F.length(b), 0).otherwise(F.floor(same * 100 / F.length(a)).cast("int"))


#: Pairs of digests that are compared at once.
PAIRS = 1 << 20


def alike_of(digests: list[str], asked: list[str], least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers of digests, numbers of asked digests, scores) of the pairs of one
    length to which ``tlsh_score`` gives ``least`` or more, place by place for many pairs."""
    for n in {*map(len, digests)} & {*map(len, asked)}:
        some, others = (np.flatnonzero([len(d) == n for d in x]) for x in (digests, asked))
        # A row for each place; without characters, all are equal.
        a, b = (np.array([x[i] for i in k], dtype=f"U{max(n, 1)}").view(np.uint32).reshape(len(k), -1).T for x, k in ((digests, some), (asked, others)))
        if max(a.max(), b.max()) < 256:
            a, b = a.astype(np.uint8), b.astype(np.uint8)
        a, b = np.ascontiguousarray(a), np.ascontiguousarray(b)
        step = max(1, PAIRS // len(some))
        for at in range(0, len(others), step):
            block = b[:, at : at + step]
            same = np.zeros((block.shape[1], len(some)), dtype=np.uint8 if len(a) < 256 else np.uint32)
            for x, y in zip(a, block, strict=True):
                same += y[:, None] == x[None, :]
            j, i = np.nonzero(same >= max(0, -(-least * len(a) // 100)))
            yield some[i], others[at + j], (same[j, i].astype(np.int64) * 100 // len(a)).astype(np.int32)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


@lru_cache(maxsize=4)
def _cosines(n: int) -> np.ndarray:
    rows = np.cos(np.pi * np.arange(n)[:, None] * (2 * np.arange(n)[None, :] + 1) / (2 * n)) * np.sqrt(2 / n)
    rows[0] *= np.sqrt(0.5)
    return rows


def grey(pixels: np.ndarray) -> np.ndarray:
    """Luminance of an image with colour channels."""
    return pixels if pixels.ndim == 2 else (pixels[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def phash_of(pixels: np.ndarray, size: int = 32, low: int = 8) -> int:
    """63 bits: which low-frequency cosine coefficients of the image, resized and
    normalised, exceed their upper median."""
    image = grey(pixels).astype(float)
    h, w = image.shape
    y, x = np.arange(size) * h / size, np.arange(size) * w / size
    y0, x0 = np.minimum(y.astype(int), h - 1), np.minimum(x.astype(int), w - 1)
    y1, x1 = np.minimum(y.astype(int) + 1, h - 1), np.minimum(x.astype(int) + 1, w - 1)
    fy, fx = (y - y.astype(int))[:, None], (x - x.astype(int))[None, :]
    small = image[np.ix_(y0, x0)] * (1 - fx) * (1 - fy) + image[np.ix_(y0, x1)] * fx * (1 - fy) + image[np.ix_(y1, x0)] * (1 - fx) * fy + image[np.ix_(y1, x1)] * fx * fy
    small = np.floor(small + 0.5)
    if small.std() > 1e-8:
        small = np.floor(np.clip((small - small.mean()) / small.std() * 128 + 128, 0, 255))
    c = _cosines(size)
    values = (c @ (small - 128) @ c.T)[:low, :low].ravel()[1:]
    bits = values > np.sort(values)[len(values) // 2]
    return int(sum(1 << int(i) for i in np.flatnonzero(bits)))


@F.pandas_udf(T.LongType())
def phash(pixels: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """Perceptual hash of raw grey bytes with their width and height; null if they disagree."""

    def one(data, w, h):
        if data is None or not w or not h or len(data) != w * h:
            return None
        return phash_of(np.frombuffer(data, dtype=np.uint8).reshape(int(h), int(w)))

    return pd.Series([one(*r) for r in zip(pixels, width, height, strict=True)], dtype="Int64")


def bytes_phash_of(data: bytes, size: int = 32) -> int | None:
    """``phash_of`` of bytes as a grey image ``size`` wide, the last row padded with zeros.

    Resizing an image reads single points of it; so that every byte counts, an
    image of more rows is first brought to ``size`` rows by their means.
    """
    if not data:
        return None
    rows = -(-len(data) // size)
    image = np.zeros(rows * size, dtype=np.uint8)
    image[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    image = image.reshape(rows, size)
    if rows > size:
        above = np.concatenate([np.zeros((1, size)), np.cumsum(image, axis=0, dtype=np.int64)])
        at = np.arange(size + 1) * rows / size
        whole = np.minimum(at.astype(int), rows - 1)
        until = above[whole] + (at - whole)[:, None] * image[whole]
        image = np.diff(until, axis=0) * size / rows
    return phash_of(image, size)


@F.pandas_udf(T.LongType())
def bytes_phash(content: pd.Series) -> pd.Series:
    return pd.Series([bytes_phash_of(c) for c in content], dtype="Int64")


#: Odd multipliers of the two hash functions of a set sketch.
MULTIPLIERS = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F)


@F.pandas_udf(T.StructType([T.StructField("one", T.StringType()), T.StructField("two", T.StringType())]))
def set_sketch(hashes: pd.Series) -> pd.DataFrame:
    """Least products, as unsigned 64-bit hexadecimal, of the hashes with two odd numbers."""
    rows = []
    for h in hashes:
        values = np.asarray([] if h is None else h, dtype=np.int64).astype(np.uint64)
        rows.append([f"{int((values * np.uint64(m)).min()):016x}" if len(values) else None for m in MULTIPLIERS])
    return pd.DataFrame(rows, columns=["one", "two"])


def sketch_similarity(a: Column, b: Column) -> Column:
    """0, one half or 1: the share of equal parts of two sketches."""
    return ((a["one"] == b["one"]).cast("int") + (a["two"] == b["two"]).cast("int")) / 2
