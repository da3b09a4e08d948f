"""Text time stamps of many notations, precisions and zones to UTC instants.

Stamps are parsed with column expressions only.  Those with an offset of their
own, and counts since an epoch, give their instant at once.  Wall times are
joined as of their local time to the intervals in which a zone kept one
offset, laid out on the local time line: one matching interval gives the
offset, two mean that clocks showed the time twice, none that they skipped it.
"""

from __future__ import annotations

import datetime as dt
import zoneinfo
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Zone abbreviations with one usual meaning, in minutes east of UTC.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "UT": 0, "GMT": 0, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "MSK": 180, "EST": -300, "EDT": -240, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600, "JST": 540, "KST": 540, "AEST": 600, "AEDT": 660, "ACST": 570,
    "ACDT": 630, "AWST": 480, "NZST": 720, "NZDT": 780,
}
#: First letters of month names (English, Spanish, Portuguese, German, French, Italian).
MONTHS = {
    1: "jan ene gen", 2: "feb fev fév", 3: "mar mär mrz", 4: "apr abr avr", 5: "may mai mag", 6: "jun giu",
    7: "jul lug", 8: "aug ago aoû", 9: "sep set", 10: "oct out okt ott", 11: "nov", 12: "dec dic dez déc",
}
#: French writes juin and juillet, which share their first three letters.
LONG_MONTHS = {"juin": 6, "juil": 7}
#: Locales that write numeric dates month first.
MONTH_FIRST = ("en-US", "en-PH", "fil-PH")
#: Years covered by the offset intervals; zones began later.  Wall times before them have the zone's
#: first offset, those after them that of the year of FOLDED with the same calendar.
YEARS = (1800, 2100)
FOLDED = (2072, 2099)
#: Intervals are cut at multiples of this, about 407 days, to join by equality.
SLOT_US = 1 << 45
#: Slot of all times before the first interval.
EARLIER = -(1 << 40)

_INTERVALS = "zone string, slot long, lo long, hi long, offset_us long"
_ZONE = r"Z|[+-]\d{2}:?\d{2}(?:\[[^\]]+\])?|[A-Z]{2,5}(?:[+-]\d{1,2}(?::?\d{2})?)?|\[[^\]]+\]|[A-Z]\p{L}+(?:/[\w+-]+)+"
_ISO = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})[T ](\d{1,2})[:.](\d{2})(?:[:.](\d{2})(?:[.,](\d{1,9}))?)?\s*(" + _ZONE + r")?$"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})[T ]?(\d{2})(\d{2})(\d{2})(Z|[+-]\d{2}:?\d{2})?$"
_NUMERIC = r"^(\d{1,2})[/.](\d{1,2})[/.](\d{4}),? (\d{1,2}):(\d{2})(?::(\d{2}))?(?: ?([AaPp])\.?[Mm]\.?)?$"
_WORDED = r"^(?:\p{L}+\.?, )?(\d{1,2})[ ./-]+(\p{L}+)\.?[ /-](\d{4})(?:,? |:)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?: ?(Z|[+-]\d{2}:?\d{2}|[A-Z]{2,5}))?$"
_YEAR_LAST = r"^\p{L}{3} (\p{L}{3}) (\d{1,2}) (\d{1,2}):(\d{2}):(\d{2})(?: ([A-Z]{2,5}))? (\d{4})$"
_COUNT = r"^(\d{9,10}|\d{13}|\d{16,19})$"
_FRACTION = r"^(\d{9,10})\.(\d{1,9})$"
_HEX = r"^0[xX]([0-9A-Fa-f]{12,16})$"


def _int(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def _micros(fraction: Column) -> Column:
    return F.coalesce(F.rpad(fraction, 6, "0").try_cast("bigint"), F.lit(0))


def _local(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column) -> Column:
    """Microseconds on a clock without zone; null for a date or time that no calendar has."""
    return F.unix_micros(F.try_make_timestamp_ltz(y, mo, d, h, mi, F.coalesce(s, F.lit(0)).cast("decimal(16,6)"), F.lit("UTC")))


def _parsed(local: Column, zone: Column) -> Column:
    return F.struct(F.lit(None).cast("bigint").alias("utc_us"), local.alias("local_us"), zone.alias("zone_text"))


def _instant(utc: Column) -> Column:
    return F.struct(utc.alias("utc_us"), F.lit(None).cast("bigint").alias("local_us"), F.lit(None).cast("string").alias("zone_text"))


def _count_us(n: Column) -> Column:
    """An epoch count, its unit told by its digits: seconds, milliseconds,
    microseconds, 100 ns since 1601, nanoseconds."""
    size = F.length(n)
    v = n.try_cast("bigint")
    return (
        F.when(size <= 10, v * 1_000_000)
        .when(size == 13, v * 1_000)
        .when(size == 16, v)
        .when(size <= 18, _filetime_us(v))
        .otherwise(F.call_function("div", v, F.lit(1_000)))
    )


def _filetime_us(ticks: Column) -> Column:
    return F.call_function("div", ticks, F.lit(10)) - F.lit(11_644_473_600_000_000)


def parse_stamp(text: Column, locale: Column) -> Column:
    """Struct (utc_us, local_us, zone_text) of one stamp; all null if it says nothing.

    ``locale`` gives the order of day and month in numeric dates.
    """
    s = F.trim(F.regexp_replace(text, r"\s+", " "))
    a, b = _int(s, _NUMERIC, 1), _int(s, _NUMERIC, 2)
    month_first = F.coalesce(locale.isin(*MONTH_FIRST), F.lit(False))
    half = F.lower(F.regexp_extract(s, _NUMERIC, 7))
    hour = _int(s, _NUMERIC, 4)
    hour = (
        F.when(half == "", hour)
        .when((hour < 1) | (hour > 12), F.lit(None))
        .otherwise(hour % 12 + F.when(half == "p", 12).otherwise(0))
    )
    names = {name: n for n, row in MONTHS.items() for name in row.split()} | LONG_MONTHS
    months = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))

    def month(pattern: str, group: int) -> Column:
        spelled = F.lower(F.regexp_extract(s, pattern, group))
        return F.coalesce(months[F.substring(spelled, 1, 4)], months[F.substring(spelled, 1, 3)])

    none = F.lit(None).cast("string")

    def at(pattern: str, *groups: int) -> list[Column]:
        return [_int(s, pattern, g) for g in groups]

    def cut(pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(s, pattern, group), F.lit(""))

    return (
        F.when(s.rlike(_COUNT), _instant(_count_us(s).cast("bigint")))
        .when(s.rlike(_FRACTION), _instant(F.regexp_extract(s, _FRACTION, 1).try_cast("bigint") * 1_000_000 + _micros(cut(_FRACTION, 2))))
        .when(s.rlike(_HEX), _instant(_filetime_us(F.conv(F.regexp_extract(s, _HEX, 1), 16, 10).try_cast("bigint")).cast("bigint")))
        .when(s.rlike(_ISO), _parsed(_local(*at(_ISO, 1, 2, 3, 4, 5, 6)) + _micros(cut(_ISO, 7)), cut(_ISO, 8)))
        .when(s.rlike(_COMPACT), _parsed(_local(*at(_COMPACT, 1, 2, 3, 4, 5, 6)), cut(_COMPACT, 7)))
        .when(
            s.rlike(_NUMERIC),
            _parsed(_local(_int(s, _NUMERIC, 3), F.when(month_first, a).otherwise(b), F.when(month_first, b).otherwise(a), hour, *at(_NUMERIC, 5, 6)), none),
        )
        .when(s.rlike(_WORDED), _parsed(_local(_int(s, _WORDED, 3), month(_WORDED, 2), *at(_WORDED, 1, 4, 5, 6)) + _micros(cut(_WORDED, 7)), cut(_WORDED, 8)))
        .when(s.rlike(_YEAR_LAST), _parsed(_local(_int(s, _YEAR_LAST, 7), month(_YEAR_LAST, 1), *at(_YEAR_LAST, 2, 3, 4, 5)), cut(_YEAR_LAST, 6)))
    )


def zone_offset_us(zone_text: Column) -> Column:
    """Offset in microseconds that a stamp's own zone text states, else null."""
    pattern = r"^(?:UTC|GMT)?([+-])(\d{1,2}):?(\d{2})?(?:\[.*\])?$"
    sign = F.when(F.regexp_extract(zone_text, pattern, 1) == "-", -1).otherwise(1)
    minutes = _int(zone_text, pattern, 2) * 60 + F.coalesce(_int(zone_text, pattern, 3), F.lit(0))
    named = F.create_map(*(F.lit(x) for pair in ABBREVIATIONS.items() for x in pair))
    return F.when(zone_text.rlike(pattern), sign * minutes).otherwise(named[zone_text]).cast("bigint") * 60_000_000


def _zone_runs(name: str) -> list[tuple[int, int, int]]:
    """(start, end, offset), in UTC and offset microseconds, of a zone."""
    try:
        zone = zoneinfo.ZoneInfo(name)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        return []
    utc = dt.timezone.utc
    epoch = dt.datetime(1970, 1, 1, tzinfo=utc)
    day = 86_400

    def offset(second: int) -> int:
        moment = epoch + dt.timedelta(seconds=second)
        return round(moment.astimezone(zone).utcoffset().total_seconds())

    first, last = (round((dt.datetime(y, 1, 1, tzinfo=utc) - epoch).total_seconds()) for y in YEARS)
    runs, start, now = [], first, offset(first)
    for t in range(first, last, day):
        if (then := offset(t + day)) == now:
            continue
        low, high = t, t + day
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if offset(middle) == now else (low, middle)
        runs.append((start, high, now))
        start, now = high, then
    runs.append((start, last, now))
    return [(a * 1_000_000, b * 1_000_000, c * 1_000_000) for a, b, c in runs]


def _folded(local_us: Column) -> Column:
    """``local_us``, those after YEARS moved to the year of FOLDED that has the same
    weekdays and leap day.  Zones keep their rules of that time for ever, as far
    as anyone knows, so the clock changes at the same places of both years."""
    alike = {(dt.date(y, 1, 1).isoweekday() % 7 + 1, y % 4 == 0): dt.date(y, 1, 1).toordinal() for y in range(*FOLDED)}
    alike[dt.date(FOLDED[1], 1, 1).isoweekday() % 7 + 1, False] = dt.date(FOLDED[1], 1, 1).toordinal()
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(local_us / 86_400_000_000).cast("int"))
    first = F.trunc(day, "year")
    leap = F.datediff(F.add_months(first, 12), first) == 366
    places = F.create_map(*(F.lit(x) for (weekday, long), at in alike.items() for x in (weekday + (10 if long else 0), at - dt.date(1970, 1, 1).toordinal())))
    days = F.datediff(first, F.lit("1970-01-01").cast("date")) - places[F.dayofweek(first) + F.when(leap, 10).otherwise(0)]
    after = _year_us(YEARS[1])
    return F.when(local_us >= after, local_us - days.cast("bigint") * 86_400_000_000).otherwise(local_us)


def _year_us(year: int) -> int:
    return (dt.date(year, 1, 1).toordinal() - dt.date(1970, 1, 1).toordinal()) * 86_400_000_000


def _explode_zones(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for name in batch["zone"]:
            runs = _zone_runs(name)
            if runs:  # a zone's first offset also holds before
                runs[0] = (runs[0][0] - 3 * 86_400_000_000, *runs[0][1:])
            rows = [
                (name, slot, max(lo + off, slot * SLOT_US), min(hi + off, (slot + 1) * SLOT_US), off)
                for lo, hi, off in runs
                for slot in range((lo + off) // SLOT_US, (hi + off - 1) // SLOT_US + 1)
            ]
            if runs:  # all earlier times, in one slot of their own
                rows.append((name, EARLIER, -(2**63), _year_us(YEARS[0]), runs[0][2]))
            yield pd.DataFrame(rows, columns=["zone", "slot", "lo", "hi", "offset_us"])


def zone_intervals(zones: DataFrame) -> DataFrame:
    """Offset intervals on the local time line, cut at slots, of ``zones.zone``.

    At most some 600 zones exist with under 800 pieces each, so the result is
    bounded whatever the input, and safe to broadcast.  Unknown names have none.
    """
    return zones.where(F.col("zone").isNotNull()).repartition(8, "zone").dropDuplicates(["zone"]).mapInPandas(_explode_zones, _INTERVALS)


def read_stamps(stamps: DataFrame, hosts: DataFrame, hosts_rows: int) -> DataFrame:
    """Rows (stamp_table, stamp_id, stamp, utc_us, reason), one for each distinct
    stamp: the instant, or the reason why it has none.

    ``stamps``: stamp_table, stamp_id, host_id, stamp; ``hosts``: host_id,
    tz_name, locale, with its counted number of rows.  Further columns are
    ignored.  A zone or offset in the stamp goes before the host's zone; an
    offset before the zone that stands in brackets behind it.  Reasons are
    ``no time`` (null, blank, the stand-ins 0, -1 and 0000-00-00), ``unread``
    (no known notation; a date without a time of day), ``impossible`` (no
    calendar has it), ``unknown zone``, ``skipped`` and ``shown twice`` (by a
    clock change).  Years are not limited.  A null id is kept as it is; an empty
    table gives an empty result.
    """
    known = hosts.select("host_id", F.col("tz_name").alias("_tz"), F.col("locale").alias("_locale")).dropDuplicates(["host_id"])
    if hosts_rows <= 100_000:
        known = F.broadcast(known)
    parsed = (
        stamps.select("stamp_table", "stamp_id", "host_id", "stamp")
        .join(known, "host_id", "left")
        # inline() keeps the optimizer from repeating the parser in every later expression.
        .select("stamp_table", "stamp_id", "stamp", "_tz", F.inline_outer(F.array(parse_stamp(F.col("stamp"), F.col("_locale")))))
    )
    bracket = F.regexp_extract("zone_text", r"^\[(.+)\]$", 1)
    own = zone_offset_us(F.col("zone_text"))
    resolved = parsed.select(
        "stamp_table",
        "stamp_id",
        "stamp",
        "local_us",
        F.coalesce("utc_us", F.col("local_us") - own).alias("direct_us"),
        F.when(F.col("zone_text").isNull(), F.col("_tz")).when(bracket != "", bracket).when(F.col("zone_text").contains("/"), F.col("zone_text")).alias("zone"),
        _folded(F.col("local_us")).alias("_at"),
    ).withColumn("slot", F.when(F.col("_at") < _year_us(YEARS[0]) - 86_400_000_000, EARLIER).otherwise(F.floor(F.col("_at") / SLOT_US)).cast("bigint"))
    in_text = F.coalesce(F.nullif(F.regexp_extract("stamp", r"\[([^\]]+)\]\s*$", 1), F.lit("")), F.regexp_extract("stamp", r"\s([A-Z]\p{L}+(?:/[\w+-]+)+)\s*$", 1))
    named = stamps.select(in_text.alias("zone")).where("zone <> ''").distinct()
    intervals = F.broadcast(zone_intervals(known.select(F.col("_tz").alias("zone")).union(named)))
    matched = resolved.join(intervals, ["zone", "slot"], "left")
    fits = F.col("direct_us").isNotNull() | ((F.col("_at") >= F.col("lo")) & (F.col("_at") < F.col("hi")))
    utc = F.when(fits, F.coalesce("direct_us", F.col("local_us") - F.col("offset_us")))
    found = matched.groupBy("stamp_table", "stamp_id", "stamp", "zone", "local_us", "direct_us").agg(F.min(utc).alias("utc_us"), F.max(utc).alias("_last"), F.max("offset_us").isNotNull().alias("_known"))
    text = F.trim(F.regexp_replace("stamp", r"\s+", " "))
    said = F.coalesce(text.rlike(r"[1-9]") & (text != "-1"), F.lit(False))
    shaped = F.coalesce(text.rlike("|".join((_ISO, _COMPACT, _NUMERIC, _WORDED, _YEAR_LAST, _COUNT, _FRACTION, _HEX))), F.lit(False))
    reason = (
        F.when(F.col("utc_us") == F.col("_last"), None).when(~said, "no time").when(F.col("local_us").isNull() & F.col("direct_us").isNull(), F.when(shaped, "impossible").otherwise("unread"))
        .when(F.col("utc_us") != F.col("_last"), "shown twice").when(F.col("_known"), "skipped").otherwise("unknown zone")
    )
    return found.select("stamp_table", "stamp_id", "stamp", F.when(F.col("utc_us") == F.col("_last"), F.col("utc_us")).alias("utc_us"), reason.alias("reason"))


def normalise_stamps(stamps: DataFrame, hosts: DataFrame, hosts_rows: int) -> DataFrame:
    """Rows (stamp_table, stamp_id, utc_us) of the stamps that denote one instant.

    Those of ``read_stamps`` that have an instant and an id; repeated rows give
    one row; an empty table gives an empty result.
    """
    some = stamps.where(F.col("stamp").isNotNull() & F.col("stamp_id").isNotNull())
    return read_stamps(some, hosts, hosts_rows).where("utc_us is not null").select("stamp_table", "stamp_id", "utc_us").distinct()
