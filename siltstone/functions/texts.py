"""Number, size, case and rate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = ((1 << 10, "KB"), (1 << 20, "MB"), (1 << 30, "GB"))


def format_size(size: Column) -> Column:
    """Bytes as B, or as KB, MB, GB with two decimals."""
    shown = [F.format_string(f"%.2f {unit}", size / step) for step, unit in _UNITS]
    return F.when(size < 1 << 10, F.format_string("%d B", size)).when(size < 1 << 20, shown[0]).when(size < 1 << 30, shown[1]).otherwise(shown[2])


def format_size_whole(size: Column) -> Column:
    """Bytes in whole units, rounded down."""
    shown = [F.concat(F.call_function("div", size, F.lit(step)), F.lit(f" {unit}")) for step, unit in _UNITS]
    return F.when(size < 1 << 10, F.concat(size, F.lit(" B"))).when(size < 1 << 20, shown[0]).when(size < 1 << 30, shown[1]).otherwise(shown[2])


def size_class(size: Column) -> Column:
    """Band of a size, as maps colour it."""
    return F.when(size < 1 << 10, "tiny").when(size < 1 << 20, "small").when(size < 10 << 20, "medium").when(size < 100 << 20, "large").when(size < 1 << 30, "huge").otherwise("giant")


def title_case(text: Column) -> Column:
    return F.initcap(text)


def sentence_case(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 2**31 - 1)))


def format_percentage(value: Column) -> Column:
    return F.format_string("%.2f", value)


def percent_change(old: Column, new: Column) -> Column:
    """Change in percent; from zero 100 if anything came, else 0."""
    return F.when(old == 0, F.when(new > 0, 100.0).otherwise(0.0)).otherwise((new - old) / old * 100)


def share_change(old: Column, new: Column) -> Column:
    """Change in percent, 0 from nothing."""
    return F.when(old > 0, (new - old) / old * 100).otherwise(0.0)


def throughput_mb(size: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, size / (1 << 20) / seconds).otherwise(0.0)


def per_second(count: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, count / seconds).otherwise(0.0)


def aspect_ratio(x: Column, y: Column) -> Column:
    return F.greatest(x / y, y / x)


def compression_ratio(packed: Column, unpacked: Column) -> Column:
    """Share saved by packing, never below 0; 0 if nothing was unpacked."""
    return F.when(unpacked > 0, F.greatest(1 - packed / unpacked, F.lit(0.0))).otherwise(0.0)


def overlapping_count(text: Column, word: str) -> Column:
    """Occurrences of a word, overlapping ones included."""
    if not word:
        return F.lit(0)
    # A look-ahead takes up no text, so the next match may begin inside this one.
    return F.regexp_count(text, F.lit("(?=\\Q" + word + "\\E)"))
