"""Path and name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def platform_path(path: Column) -> Column:
    """Backslashes as slashes."""
    return F.translate(path, "\\", "/")


def base_name(path: Column) -> Column:
    """What follows the last separator of either kind."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def parent(path: Column) -> Column:
    """What precedes the last separator, empty without one."""
    return F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)


def extension(path: Column) -> Column:
    """From the last dot of the whole path, so that a dotted directory leaks in."""
    return F.regexp_extract(path, r"(\.[^.]*)$", 1)


def suffix(path: Column) -> Column:
    """Lower-case text after the last dot of the file name, empty without one."""
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]*)$", 1))


def join_paths(left: Column, right: Column) -> Column:
    """Both with one separator between; an empty side gives the other."""
    glued = F.concat(F.regexp_replace(left, r"[/\\]$", ""), F.lit("/"), F.regexp_replace(right, r"^[/\\]", ""))
    return F.when(left == "", right).when(right == "", left).otherwise(glued)


def split_keep(text: Column, delimiter: str) -> Column:
    """All parts, empty ones and the last included."""
    return F.split(text, "\\Q" + delimiter + "\\E", -1)


def equals_ignoring_case(a: Column, b: Column) -> Column:
    """Equality in which only ASCII letters may differ in case."""
    return ascii_lower(a) == ascii_lower(b)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contains_any(text: Column, parts: list[str] | tuple[str, ...]) -> Column:
    """Whether any of ``parts`` occurs in the text; false without parts."""
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out
