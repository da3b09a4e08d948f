"""What lies inside byte columns: chunks, carved files, strings, archive entries."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import re
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import lanes

#: Content-defined chunks: bounds and the bits that must be 0 at a cut.
CHUNK_LEAST, CHUNK_MOST, CHUNK_MASK = 128 * 1024, 4 * 1024 * 1024, 0x31FFF
_MB = 1 << 20
#: Extension, header, footer (or none), least and most bytes of carved files.
SIGNATURES = (
    ("jpg", "FFD8FF", "FFD9", 100, 100 * _MB), ("png", "89504E470D0A1A0A", "49454E44AE426082", 100, 100 * _MB), ("gif", "474946383761", "", 100, 50 * _MB),
    ("gif", "474946383961", "", 100, 50 * _MB), ("pdf", "25504446", "2525454F46", 100, 100 * _MB), ("zip", "504B0304", "504B0506", 100, 100 * _MB),
    ("rar", "526172211A0700", "", 100, 100 * _MB), ("rar", "526172211A070100", "", 100, 100 * _MB), ("mp3", "494433", "", 100, 100 * _MB), ("mp3", "FFFB", "", 100, 100 * _MB),
    ("mp3", "FFF3", "", 100, 100 * _MB), ("mp3", "FFF2", "", 100, 100 * _MB), ("avi", "52494646", "", 100, 200 * _MB), ("bmp", "424D", "", 100, 100 * _MB),
)
#: Words that make a string suspicious.
SUSPICIOUS_WORDS = ("malware", "trojan", "virus", "backdoor", "keylog", "ransom", "exploit", "shellcode")


def _per_row(df: DataFrame, key: str, content: Column, fields: str, types: list[pa.DataType], expand) -> DataFrame:
    """Rows (key, *fields) from ``expand(content)`` of each row, batch by batch."""
    kind = df.schema[key].dataType.simpleString()
    names = [key, *(f.split()[0] for f in fields.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, columns = [], [[] for _ in types]
            for i, data in enumerate(batch.column(1).to_pylist()):
                for row in expand(data) if data else ():
                    ids.append(i)
                    for c, v in zip(columns, row, strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

    return df.select(key, content.alias("content")).mapInArrow(run, f"{key} {kind}, {fields}")


def chunk_spans(data: bytes, least: int = CHUNK_LEAST, most: int = CHUNK_MOST, mask: int = CHUNK_MASK) -> Iterator[tuple[int, int, int]]:
    """(offset, length, hash) of content-defined chunks.

    The hash turns left one bit and takes in a byte; a chunk ends where its
    masked bits are 0, at its most bytes, or with the data.  What remains at
    the end below the least bytes is no chunk.
    """
    start, value = 0, 0
    for i, byte in enumerate(data):
        value = ((value << 1 | value >> 31) & 0xFFFFFFFF) ^ byte
        size = i - start + 1
        if size >= most or size >= least and (value & mask == 0 or i == len(data) - 1):
            yield start, size, value
            start, value = i + 1, 0


def chunk_spans_of(datas: list[bytes], least: int = CHUNK_LEAST, most: int = CHUNK_MOST, mask: int = CHUNK_MASK) -> list[list[tuple[int, int, int]]]:
    """``chunk_spans`` of many byte strings, side by side."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in datas]
    for numbers, lengths in lanes.groups(datas):
        if len(numbers) < lanes.FEW:
            for i in numbers:
                out[i] = list(chunk_spans(datas[i], least, most, mask))
            continue
        value, start = np.zeros(len(numbers), dtype=np.uint32), np.zeros(len(numbers), dtype=np.int64)
        for i, c in enumerate(lanes.columns(datas, numbers, lengths)):
            value = (value << np.uint32(1) | value >> np.uint32(31)) ^ c
            size = i - start + 1
            cut = (i < lengths) & ((size >= most) | (size >= least) & ((value & np.uint32(mask) == 0) | (i == lengths - 1)))
            if cut.any():
                for k in np.flatnonzero(cut):
                    out[numbers[k]].append((int(start[k]), int(size[k]), int(value[k])))
                start[cut], value[cut] = i + 1, 0
    return out


def chunks(df: DataFrame, key: str, content: Column, **bounds: int) -> DataFrame:
    """(key, offset, length, hash) of the content-defined chunks of each row."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = chunk_spans_of([d or b"" for d in batch.column(1).to_pylist()], **bounds)
            at = np.repeat(np.arange(len(spans)), [len(s) for s in spans])
            flat = np.array([x for s in spans for x in s], dtype=np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(flat[:, k]) for k in range(3))], names=[key, "offset", "length", "hash"])

    return df.select(key, content.alias("content")).mapInArrow(run, f"{key} {kind}, offset long, length long, hash long")


_HEADERS = [(ext, bytes.fromhex(h), bytes.fromhex(f), least, most) for ext, h, f, least, most in SIGNATURES]
_ANY_HEADER = re.compile(b"|".join(re.escape(h) for _, h, *_ in _HEADERS), re.DOTALL)


def carve_spans(data: bytes) -> Iterator[tuple[int, int, str]]:
    """(offset, size, extension) of files found from left to right without overlap.

    At each place the first signature whose file keeps its bounds wins; the file
    ends with the first footer, else with the data or at its most bytes, and is
    dropped if it would be below its least bytes.
    """
    at = 0
    while found := _ANY_HEADER.search(data, at):
        at = found.start()
        for ext, head, foot, least, most in _HEADERS:
            if not data.startswith(head, at):
                continue
            end = data.find(foot, at) if foot else -1
            size = end + len(foot) - at if end >= 0 else min(most, len(data) - at)
            if least <= size <= most:
                yield at, size, ext
                at += size
                break
        else:
            at += 1


def carve(df: DataFrame, key: str, content: Column, with_data: bool = False) -> DataFrame:
    """Carved files (key, offset, size, extension[, data, name])."""
    if not with_data:
        return _per_row(df, key, content, "offset long, size long, extension string", [pa.int64(), pa.int64(), pa.string()], carve_spans)
    types = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
    return _per_row(df, key, content, "offset long, size long, extension string, data binary, name string", types, lambda d: ((o, n, e, d[o : o + n], f"carved_{o:08x}_{n:08x}.{e}") for o, n, e in carve_spans(d)))


def printable_strings(df: DataFrame, key: str, content: Column, least: int = 4) -> DataFrame:
    """Runs of printable ASCII (key, address, text, suspicious) of at least ``least`` bytes."""
    run = re.compile(rb"[\x20-\x7e]{%d,}" % least)
    found = _per_row(df, key, content, "address long, text string", [pa.int64(), pa.string()], lambda d: ((m.start(), m.group().decode()) for m in run.finditer(d)))
    test = F.lit(False)
    for w in SUSPICIOUS_WORDS:
        test = test | F.col("text").contains(w)
    return found.withColumn("suspicious", test)


def slack(files: DataFrame, size: str, cluster: int = 4096) -> DataFrame:
    """``files`` with allocated and slack bytes, those with slack only."""
    allocated = (F.ceil(F.col(size) / cluster) * cluster).cast("bigint")
    return files.withColumn("allocated", allocated).withColumn("slack", F.col("allocated") - F.col(size)).where("slack > 0")


def search_slack(images: DataFrame, key: str, content: Column, size: Column, keyword: str, cluster: int = 4096) -> DataFrame:
    """(key, address): where a keyword stands in what lies behind a file's last byte up to
    the end of its cluster, overlapping places as well.  ``content`` holds whole clusters."""
    allocated = (F.ceil(size / cluster) * cluster).cast("int")
    behind = F.substring(content, size.cast("int") + 1, allocated - size.cast("int"))
    word = keyword.encode()
    found = re.compile(b"(?=" + re.escape(word) + b")")
    hits = _per_row(images.select(key, size.alias("_size"), behind.alias("_behind")), key, F.col("_behind"), "place long", [pa.int64()], lambda d: ((m.start(),) for m in found.finditer(d)) if word else ())
    return hits.join(images.select(key, size.cast("bigint").alias("_size")), key).select(key, (F.col("place") + F.col("_size")).alias("address"))


_ENTRY = "format string, name string, size long, packed long, modified long, is_directory boolean, mode int, encrypted boolean"
_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.bool_()]


def _zip_entries(data: bytes):
    import calendar

    for e in zipfile.ZipFile(io.BytesIO(data)).infolist():
        yield "zip", e.filename, e.file_size, e.compress_size, calendar.timegm((*e.date_time, 0, 0, 0)), e.is_dir(), e.external_attr >> 16 & 0o7777, bool(e.flag_bits & 1)


def _tar_entries(data: bytes, name: str = "tar"):
    for e in tarfile.open(fileobj=io.BytesIO(data)):
        yield name, e.name, e.size, e.size, int(e.mtime), e.isdir(), e.mode & 0o7777, False


def _single(name: str, unpack, data: bytes, modified: int | None = None):
    whole = unpack(data)
    if whole[257:262] == b"ustar":
        yield from _tar_entries(whole, f"tar.{name}")
    else:
        yield name, None, len(whole), len(data), modified, False, None, False


def _rar_entries(data: bytes):
    """File headers of the older block format: names, sizes and the password flag."""
    at = 7
    while at + 7 <= len(data):
        kind, flags, size = struct.unpack_from("<BHH", data, at + 2)
        if size < 7:
            return
        extra = struct.unpack_from("<I", data, at + 7)[0] if (flags & 0x8000 or kind == 0x74) and at + 11 <= len(data) else 0
        if kind == 0x74 and at + 32 <= len(data):
            unpacked, = struct.unpack_from("<I", data, at + 11)
            length, mode = struct.unpack_from("<HI", data, at + 26)
            yield "rar", data[at + 32 : at + 32 + length].decode("utf-8", "replace"), unpacked, extra, None, flags & 0xE0 == 0xE0, mode & 0o7777, bool(flags & 4)
        at += size + extra


def archive_entries_of(data: bytes):
    """Entries of an archive by its first bytes; what can't be read gives none.

    Formats that Python can't unpack give one row that names the format.
    """
    try:
        if data.startswith((b"PK\x03\x04", b"PK\x05\x06")):
            yield from _zip_entries(data)
        elif data.startswith(b"\x1f\x8b"):
            yield from _single("gzip", gzip.decompress, data, int.from_bytes(data[4:8], "little"))
        elif data.startswith(b"BZh"):
            yield from _single("bzip2", bz2.decompress, data)
        elif data.startswith((b"\xfd7zXZ\x00", b"]\x00\x00")):
            yield from _single("xz" if data[0] == 0xFD else "lzma", lzma.decompress, data)
        elif data.startswith(b"Rar!\x1a\x07\x00"):
            yield from _rar_entries(data)
        elif data[257:262] == b"ustar":
            yield from _tar_entries(data)
        else:
            for name, mark in (("rar", b"Rar!\x1a\x07\x01\x00"), ("7z", b"7z\xbc\xaf\x27\x1c"), ("zstd", b"(\xb5/\xfd"), ("lz4", b"\x04\x22M\x18")):
                if data.startswith(mark):
                    yield name, None, None, len(data), None, False, None, None
    except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, zlib.error, lzma.LZMAError, struct.error, ValueError):
        return


def archive_entries(df: DataFrame, key: str, content: Column) -> DataFrame:
    return _per_row(df, key, content, _ENTRY, _TYPES, archive_entries_of)


def _contents(data: bytes):
    try:
        if data.startswith(b"PK\x03\x04"):
            z = zipfile.ZipFile(io.BytesIO(data))
            yield from ((e.filename, z.read(e)) for e in z.infolist() if not e.is_dir() and not e.flag_bits & 1)
        elif data[257:262] == b"ustar":
            t = tarfile.open(fileobj=io.BytesIO(data))
            yield from ((e.name, t.extractfile(e).read()) for e in t if e.isfile())
        else:
            for mark, unpack in ((b"\x1f\x8b", gzip.decompress), (b"BZh", bz2.decompress), (b"\xfd7zXZ\x00", lzma.decompress), (b"]\x00\x00", lzma.decompress)):
                if data.startswith(mark):
                    yield None, unpack(data)
    except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, zlib.error, lzma.LZMAError, ValueError):
        return


def extract_entries(df: DataFrame, key: str, content: Column, name: str | None = None) -> DataFrame:
    """(key, name, data) of readable entries, or of those called ``name``."""
    out = _per_row(df, key, content, "name string, data binary", [pa.string(), pa.binary()], _contents)
    return out if name is None else out.where(F.col("name") == name)


def is_password_protected(entries: DataFrame, key: str) -> DataFrame:
    """(key, protected): whether any entry is encrypted."""
    return entries.groupBy(key).agg(F.coalesce(F.bool_or("encrypted"), F.lit(False)).alias("protected"))
