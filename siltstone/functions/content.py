"""What bytes look like: digests, entropy, magic numbers, cipher guesses."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import lanes

#: Bytes of the head and of the tail that a signature covers.
EDGE = 16_384


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def keyed_sha256(key: Column, content: Column) -> Column:
    return F.sha2(F.concat(key, content), 256)


def head_tail_signature(content: Column) -> Column:
    """Digest of the first EDGE bytes, and of the last if there are over two times as many."""
    n = F.octet_length(content)
    tail = F.when(n > 2 * EDGE, F.substring(content, n - EDGE + 1, F.lit(EDGE))).otherwise(F.unhex(F.lit("")))
    return F.sha2(F.concat(F.substring(content, 1, EDGE), tail), 256)


def digest(text: Column, size: int) -> Column:
    """The bytes of a written digest of ``size`` bytes, null if it is none.

    Hexadecimal in any case, with a name in front or separators inside, or base64.
    """
    bare = F.regexp_replace(F.trim(text), r"^(?i:sha-?256[:=]|head[_-]?tail[:=]|0x)\s*", "")
    plain = F.regexp_replace(bare, r"[:\s-]", "")
    b64 = F.regexp_replace(F.translate(bare, "-_", "+/"), "=+$", "")
    letters = -(-size * 8 // 6)
    return F.when(plain.rlike(f"^[0-9A-Fa-f]{{{2 * size}}}$"), F.unhex(plain)).when(
        b64.rlike(f"^[A-Za-z0-9+/]{{{letters}}}$"), F.unbase64(F.rpad(b64, -(-letters // 4) * 4, "="))
    )


@F.pandas_udf(T.DoubleType())
def entropy(content: pd.Series) -> pd.Series:
    """Shannon entropy of the bytes as a share of 8 bits; null of null, 0 of nothing."""

    def one(data) -> float | None:
        if data is None:
            return None
        counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
        p = counts[counts > 0] / max(1, len(data))
        return float(-(p * np.log2(p)).sum() / 8) if len(data) else 0.0

    return content.map(one)


@F.pandas_udf(T.DoubleType())
def repeated_blocks(content: pd.Series) -> pd.Series:
    """Pairs of equal aligned 16-byte blocks."""

    def one(data) -> float | None:
        if data is None:
            return None
        blocks = np.frombuffer(data[: len(data) // 16 * 16], dtype="V16")
        counts = np.unique(blocks, return_counts=True)[1].astype(float)
        return float((counts * (counts - 1) / 2).sum())

    return content.map(one)


def _checksum(name: str, kind: T.DataType, compute):
    """``compute`` gives the values of a list of byte strings."""

    @F.pandas_udf(kind)
    def udf(content: pd.Series) -> pd.Series:
        known = content.notna()
        out = pd.Series(pd.NA, index=content.index, dtype="Int64")
        if known.any():
            out[known] = np.asarray(compute(content[known].tolist()), dtype=np.int64)
        return out

    udf.__name__ = name
    return udf


def _fnv1a_alone(value: int, data: bytes) -> int:
    for byte in data:
        value = (value ^ byte) * 0x01000193 & 0xFFFFFFFF
    return value


def crc16_table() -> np.ndarray:
    """What each byte does to a remainder."""
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, value >> 1 ^ 0xA001, value >> 1).astype(np.uint32)
    return value


_CRC16 = crc16_table()
_CRC16_LIST = _CRC16.tolist()


def _crc16_alone(value: int, data: bytes) -> int:
    for byte in data:
        value = value >> 8 ^ _CRC16_LIST[(value ^ byte) & 0xFF]
    return value


def fnv1a_of(datas: list[bytes]) -> np.ndarray:
    return lanes.fold(datas, 0x811C9DC5, lambda v, b: (v ^ b) * np.uint32(0x01000193), _fnv1a_alone)


def crc16_of(datas: list[bytes]) -> np.ndarray:
    return lanes.fold(datas, 0, lambda v, b: v >> np.uint32(8) ^ _CRC16[(v ^ b) & np.uint32(0xFF)], _crc16_alone)


adler32 = _checksum("adler32", T.LongType(), lambda datas: [zlib.adler32(d) for d in datas])
fnv1a = _checksum("fnv1a", T.LongType(), fnv1a_of)
crc16 = _checksum("crc16", T.IntegerType(), crc16_of)


def starts_with_hex(content: Column, *heads: str) -> Column:
    """Whether the content begins with one of some bytes, written in hexadecimal."""
    longest = max(map(len, heads)) // 2
    return F.hex(F.substring(content, 1, longest)).rlike("^(" + "|".join(heads) + ")")


#: Format by first bytes (hexadecimal), first match wins.
MAGIC = (
    ("zip", "504B0304"), ("gzip", "1F8B"), ("bzip2", "425A68"), ("xz", "FD377A585A00"), ("cab", "4D534346"), ("ar", "213C617263683E0A"), ("rar", "526172211A07"),
    ("7z", "377ABCAF271C"), ("zstd", "28B52FFD"), ("lz4", "04224D18"), ("compress", "1F9D"), ("compress", "1FA0"), ("pdf", "25504446"), ("png", "89504E470D0A1A0A"),
    ("jpg", "FFD8FF"), ("gif", "474946383761"), ("gif", "474946383961"),
)
_PACKED = ("zip", "gzip", "bzip2", "xz", "cab", "ar", "rar", "7z", "compress")


def format_by_magic(content: Column) -> Column:
    """Format by the first bytes; ``tar`` by its mark at 257; null if unknown."""
    head, out = F.hex(F.substring(content, 1, 8)), None
    for name, mark in MAGIC:
        out = F.when(head.startswith(mark), name) if out is None else out.when(head.startswith(mark), name)
    return out.when(F.hex(F.substring(content, 258, 5)) == "7573746172", "tar")


def is_compressed(content: Column) -> Column:
    """Whether the content begins as a packed format, or as a known zlib stream."""
    return F.coalesce(format_by_magic(content).isin(*_PACKED), F.lit(False)) | starts_with_hex(content, "7801730D626260")


def archive_by_extension(path: Column) -> Column:
    """Archive format that a name ends in, null if none."""
    low, out = F.lower(path), None
    for ends, name in (((".zip", ".jar", ".docx", ".xlsx"), "zip"), ((".tar",), "tar"), ((".tar.gz", ".tgz", ".gz"), "gzip"), ((".bz2",), "bzip2"), ((".xz",), "xz"), ((".lzma",), "lzma"), ((".lz4",), "lz4"), ((".zst",), "zstd"), ((".rar",), "rar"), ((".7z",), "7z")):
        for end in ends:
            out = F.when(low.endswith(end), name) if out is None else out.when(low.endswith(end), name)
    return out


#: Image format by extension, and by first bytes.
IMAGE_EXTENSIONS = {".e01": "EWF", ".vmdk": "VMDK", ".vhd": "VHD", ".vhdx": "VHD", ".qcow2": "QCOW2", ".raw": "RAW", ".dd": "RAW", ".img": "RAW"}
IMAGE_MAGIC = {"455646090D0AFF00": "EWF", "4B444D56": "VMDK", "636F6E6563746978": "VHD", "514649FB": "QCOW2"}


def image_format(path: Column, content: Column) -> Column:
    """Disk image format by extension, else by first bytes, else RAW."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^.]*)$", 1))
    named = F.create_map(*(F.lit(x) for pair in IMAGE_EXTENSIONS.items() for x in pair))[ext]
    head, by_head = F.hex(F.substring(content, 1, 8)), F.when(F.lit(False), "")
    for mark, name in IMAGE_MAGIC.items():
        by_head = by_head.when(head.startswith(mark), name)
    return F.coalesce(named, by_head, F.lit("RAW"))


#: Containers by their first bytes, with a confidence.
CONTAINERS = (
    ("PGP (ASCII-Armored)", b"-----BEGIN PGP MESSAGE-----", 1.0), ("Telegram Desktop Encrypted File", b"TDEF", 1.0), ("LUKS", b"LUKS", 0.95),
    ("TrueCrypt", b"TRUE", 0.9), ("VeraCrypt", b"VERA", 0.9), ("BitLocker", b"-FVE-F", 0.9),
)
#: Cipher, description, block bytes, key bits, modes.
CIPHERS = (
    ("AES", "Advanced Encryption Standard", 16, [128, 192, 256], ["ECB", "CBC", "CFB", "OFB", "CTR", "GCM"]),
    ("DES", "Data Encryption Standard (deprecated)", 8, [56], ["ECB", "CBC", "CFB", "OFB"]),
    ("3DES", "Triple DES", 8, [112, 168], ["ECB", "CBC", "CFB", "OFB"]),
    ("Blowfish", "Symmetric block cipher", 8, [32, 64, 128, 256, 448], ["ECB", "CBC", "CFB", "OFB"]),
    ("Twofish", "Successor to Blowfish", 16, [128, 192, 256], ["ECB", "CBC", "CFB", "OFB", "CTR"]),
    ("RC4", "Stream cipher", 1, [40, 56, 64, 128, 256], ["Stream"]),
    ("ChaCha20", "Stream cipher", 1, [256], ["Stream"]),
    ("Salsa20", "Stream cipher", 1, [128, 256], ["Stream"]),
)


def _guess(name: str, confidence: float) -> Column:
    return F.struct(F.lit(name).alias("name"), F.lit(confidence).alias("confidence"))


def algorithm(content: Column, head_entropy: Column) -> Column:
    """Struct (name, confidence): container marks first, then the entropy of the
    first 4096 bytes.  Marks other than the first two need 8 bytes in all."""
    n, out = F.octet_length(content), None
    for name, mark, confidence in CONTAINERS:
        test = (F.substring(content, 1, len(mark)) == F.lit(mark)) & ((n >= 8) | F.lit(confidence == 1.0))
        out = F.when(test, _guess(name, confidence)) if out is None else out.when(test, _guess(name, confidence))
    zeros = F.hex(F.substring(content, 1, 8))
    out = out.when((n >= 16) & zeros.startswith("00000000") & (zeros != "0" * 16), _guess("Encrypted Container", 0.7))
    return out.when(head_entropy > 0.85, _guess("Symmetric Encryption", 0.8)).when(head_entropy > 0.7, _guess("Possible Encryption", 0.5)).otherwise(_guess("None Detected", 0.2))


def cipher(content: Column, whole_entropy: Column, blocks: Column) -> Column:
    """Struct (name, confidence) of a cipher by entropy, repeats and zero bytes."""
    n = F.octet_length(content)
    head = F.hex(F.substring(content, 1, 1024))
    zeros = F.size(F.filter(F.regexp_extract_all(head, F.lit("(..)")), lambda x: x == "00"))
    return (
        F.when((n >= 16) & (whole_entropy > 0.9), F.when((n >= 32) & (blocks > F.floor(n / 64)), _guess("ECB", 0.8)).otherwise(_guess("AES", 0.7)))
        .when((n >= 16) & (zeros / F.least(n, F.lit(1024)) > 0.3), _guess("Weak Cipher/Plaintext", 0.6))
        .otherwise(_guess("Unknown", 0.1))
    )


def entropy_description(value: Column) -> Column:
    return (
        F.when(value >= 0.9, "Highly random - likely encrypted or compressed")
        .when(value >= 0.8, "Moderately random - possibly encrypted or compressed")
        .when(value >= 0.7, "Somewhat random - contains some structured data")
        .when(value >= 0.5, "Moderately structured - likely unencrypted data")
        .otherwise("Highly structured - definitely unencrypted data")
    )
