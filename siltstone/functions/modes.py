"""POSIX mode bits as text and as predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUID, SGID, STICKY = 0o4000, 0o2000, 0o1000
WORLD_READ, WORLD_WRITE, GROUP_READ, GROUP_WRITE = 0o4, 0o2, 0o40, 0o20
_KIND, _DIRECTORY, _LINK = 0o170000, 0o040000, 0o120000


def has(mode: Column, bits: int) -> Column:
    """Whether any of the bits is set."""
    return mode.bitwiseAND(bits) != 0


def is_directory(mode: Column) -> Column:
    return mode.bitwiseAND(_KIND) == _DIRECTORY


def file_type(mode: Column) -> Column:
    return F.when(is_directory(mode), "directory").when(mode.bitwiseAND(_KIND) == _LINK, "symbolic link").otherwise("regular file")


def permission_string(mode: Column) -> Column:
    """The ten characters of a long listing."""

    def executable(bit: int, special: int, small: str, large: str) -> Column:
        x = has(mode, bit)
        return F.when(has(mode, special), F.when(x, small).otherwise(large)).when(x, "x").otherwise("-")

    def flag(bit: int, letter: str) -> Column:
        return F.when(has(mode, bit), letter).otherwise("-")

    kind = F.when(is_directory(mode), "d").when(mode.bitwiseAND(_KIND) == _LINK, "l").otherwise("-")
    parts = [kind, flag(0o400, "r"), flag(0o200, "w"), executable(0o100, SUID, "s", "S"), flag(0o40, "r"), flag(0o20, "w"), executable(0o10, SGID, "s", "S")]
    return F.concat(*parts, flag(0o4, "r"), flag(0o2, "w"), executable(0o1, STICKY, "t", "T"))


def mode_of(text: Column) -> Column:
    """Permission bits of a ten-character listing."""
    out = F.lit(0)
    for place, bit in zip(range(2, 11), (0o400, 0o200, 0o100, 0o40, 0o20, 0o10, 0o4, 0o2, 0o1), strict=True):
        out = out + F.when(F.substring(text, place, 1).isin("r", "w", "x", "s", "t"), bit).otherwise(0)
    for place, bit in ((4, SUID), (7, SGID), (10, STICKY)):
        out = out + F.when(F.lower(F.substring(text, place, 1)).isin("s", "t"), bit).otherwise(0)
    return out


def suspicious(mode: Column, directory: Column | None = None) -> Column:
    """No directory, and world-writable or set-uid or set-gid."""
    folder = is_directory(mode) if directory is None else directory
    return ~folder & has(mode, WORLD_WRITE | SUID | SGID)
