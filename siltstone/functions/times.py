"""Conversions between the time counts of file systems and archives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ticks of 100 ns between 1601 and 1970.
FILETIME_1970 = 116_444_736_000_000_000


def filetime_to_timestamp(ticks: Column) -> Column:
    return F.timestamp_micros(F.call_function("div", ticks - FILETIME_1970, F.lit(10)))


def timestamp_to_filetime(moment: Column) -> Column:
    return F.unix_micros(moment) * 10 + FILETIME_1970


def filetime_to_ms(ticks: Column) -> Column:
    return F.call_function("div", ticks, F.lit(10_000))


def time_difference_ms(start: Column, end: Column) -> Column:
    """Milliseconds from start to end, 0 if end is earlier."""
    return F.greatest(end - start, F.lit(0))


def dos_to_unix(date: Column, time: Column) -> Column:
    """Seconds since 1970 of an MS-DOS date and time, null if there is no such time."""
    moment = F.try_make_timestamp_ltz(
        F.shiftright(date, 9) + 1980, F.shiftright(date, 5).bitwiseAND(15), date.bitwiseAND(31),
        F.shiftright(time, 11), F.shiftright(time, 5).bitwiseAND(63), (time.bitwiseAND(31) * 2).cast("decimal(16,6)"), F.lit("UTC"),
    )
    return F.unix_seconds(moment)


def unix_to_dos_date(moment: Column) -> Column:
    """MS-DOS date of a timestamp, read in the session's zone."""
    return F.shiftleft(F.year(moment) - 1980, 9) + F.shiftleft(F.month(moment), 5) + F.dayofmonth(moment)


def unix_to_dos_time(moment: Column) -> Column:
    return F.shiftleft(F.hour(moment), 11) + F.shiftleft(F.minute(moment), 5) + F.shiftright(F.second(moment), 1)


def age_hours(moment: Column, as_of: Column) -> Column:
    """Whole hours from a moment to ``as_of``."""
    return F.call_function("div", F.unix_micros(as_of) - F.unix_micros(moment), F.lit(3_600_000_000))


def age_days(moment: Column, as_of: Column) -> Column:
    return F.call_function("div", F.unix_micros(as_of) - F.unix_micros(moment), F.lit(86_400_000_000))


def age_months(moment: Column, as_of: Column) -> Column:
    """Calendar months from a moment's month to that of ``as_of``."""
    return (F.year(as_of) - F.year(moment)) * 12 + F.month(as_of) - F.month(moment)
