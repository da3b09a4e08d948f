"""Stamps of every notation, against instants worked out by hand and by zoneinfo."""

import datetime as dt
import zoneinfo

import pytest

from siltstone.operators.timestamps import _zone_runs, normalise_stamps, read_stamps

HOSTS = "host_id int, tz_name string, locale string"
STAMPS = "stamp_table string, stamp_id long, host_id int, stamp string"
UTC = dt.timezone.utc


def us(*parts, micro=0, minutes=0):
    moment = dt.datetime(*parts, tzinfo=UTC) - dt.timedelta(minutes=minutes)
    return round(moment.timestamp()) * 1_000_000 + micro


CASES = {
    "2022-03-14T02:38:42.585Z": us(2022, 3, 14, 2, 38, 42, micro=585_000),
    "2022-03-14T02:38:42.5851239Z": us(2022, 3, 14, 2, 38, 42, micro=585_123),
    "2022-03-14T02:38:42+0545": us(2022, 3, 14, 2, 38, 42, minutes=345),
    "2022-03-14T02:38:42-05:00": us(2022, 3, 14, 2, 38, 42, minutes=-300),
    "2022-03-14 02:38:42 UTC+5:45": us(2022, 3, 14, 2, 38, 42, minutes=345),
    "2022-03-14 02:38:42 UTC-5": us(2022, 3, 14, 2, 38, 42, minutes=-300),
    "2022-07-14 02:38:42 CEST": us(2022, 7, 14, 2, 38, 42, minutes=120),
    "2022-07-14T02:38:42[Asia/Tokyo]": us(2022, 7, 14, 2, 38, 42, minutes=540),
    "Fri, 01 Apr 2022 09:36:51 +0200": us(2022, 4, 1, 9, 36, 51, minutes=120),
    "1640995200": us(2022, 1, 1),
    "1640995200123": us(2022, 1, 1, micro=123_000),
    "1640995200123456": us(2022, 1, 1, micro=123_456),
    "1640995200.25": us(2022, 1, 1, micro=250_000),
    "132854688001234567": us(2022, 1, 1, micro=123_456),
    "0x01D7FEA1C2F0C000": int("01D7FEA1C2F0C000", 16) // 10 - 11_644_473_600_000_000,
    # Wall time of host 1, Europe/Madrid, day first.
    "2022-07-14 02:38": us(2022, 7, 14, 2, 38, minutes=120),
    "  2022-01-14 02:38:07,250 ": us(2022, 1, 14, 2, 38, 7, micro=250_000, minutes=60),
    "20220114T023807": us(2022, 1, 14, 2, 38, 7, minutes=60),
    "20220114023807": us(2022, 1, 14, 2, 38, 7, minutes=60),
    "03/04/2022 10:00:00": us(2022, 4, 3, 10, minutes=120),
    "1 ago. 2021 05:42": us(2021, 8, 1, 5, 42, minutes=120),
    "14.01.2022 02:38:07": us(2022, 1, 14, 2, 38, 7, minutes=60),
    "2022-01-14 02.38.07": us(2022, 1, 14, 2, 38, 7, minutes=60),
    "2022-07-14T02:38:42+02:00[Europe/Berlin]": us(2022, 7, 14, 2, 38, 42, minutes=120),
    "2022-07-14 02:38:42 Asia/Tokyo": us(2022, 7, 14, 2, 38, 42, minutes=540),
    "2022/07/14 02:38:42": us(2022, 7, 14, 2, 38, 42, minutes=120),
    "14/Jul/2022:02:38:42 -0500": us(2022, 7, 14, 2, 38, 42, minutes=-300),
    "Thu Jul 14 02:38:42 2022": us(2022, 7, 14, 2, 38, 42, minutes=120),
    "14 Jul 2022 02:38:42.75 Z": us(2022, 7, 14, 2, 38, 42, micro=750_000),
}
NONE = [None, "", "  ", "0", "-1", "n/a", "0000-00-00 00:00:00", "2022-02-30 10:00:00", "2022-13-01 10:00:00", "2022-01-01 25:00:00", "2022-01-01 10:00:00 XYZ", "2022-01-01T10:00:00[No/Where]",
        "2022-03-27 02:30:00", "2022-10-30 02:30:00", "nonsense " * 5000]


def run(spark, rows, hosts=((1, "Europe/Madrid", "es-ES"), (2, "America/New_York", "en-US"), (3, None, "en-GB"))):
    out = normalise_stamps(spark.createDataFrame(rows, STAMPS), spark.createDataFrame(list(hosts), HOSTS), len(hosts))
    return sorted((r.stamp_id, r.utc_us) for r in out.collect())


def test_notations_and_what_denotes_no_instant(spark):
    texts = list(CASES) + NONE
    got = dict(run(spark, [("t", i, 1, s) for i, s in enumerate(texts)]))
    assert {texts[i]: v for i, v in got.items()} == CASES


def test_month_first_locale_and_half_days(spark):
    rows = [("t", 1, 2, "3/4/2022 12:05:00 AM"), ("t", 2, 2, "3/4/2022 12:05:00 PM"), ("t", 3, 2, "13/4/2022 1:00:00 AM")]
    assert run(spark, rows) == [(1, us(2022, 3, 4, 0, 5, minutes=-300)), (2, us(2022, 3, 4, 12, 5, minutes=-300))]


def test_unknown_zone_missing_host_and_repeats(spark):
    rows = [("t", 1, 3, "2022-01-01 10:00:00"), ("t", 2, 9, "2022-01-01 10:00:00"), ("t", 3, None, "2022-01-01T10:00:00Z"), ("t", 4, 3, "1640995200"), ("t", 4, 3, "1640995200"), ("t", None, 1, "1640995200")]
    assert run(spark, rows) == [(3, us(2022, 1, 1, 10)), (4, us(2022, 1, 1))]


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == []
    stamps = spark.createDataFrame([("t", 1, 1, "1640995200", "x", 5)], STAMPS + ", tz_name string, utc_us long")
    hosts = spark.createDataFrame([(1, "UTC", "en-GB", "y")], HOSTS + ", stamp string")
    assert [r.utc_us for r in normalise_stamps(stamps, hosts, 1).collect()] == [us(2022, 1, 1)]


def test_session_time_zone_does_not_matter(spark):
    rows = [("t", 1, 1, "2022-07-14 02:38"), ("t", 2, 1, "1640995200")]
    want = run(spark, rows)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert run(spark, rows) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("name", ["Europe/London", "Australia/Sydney", "America/New_York", "Asia/Kathmandu"])
def test_intervals_agree_with_zoneinfo(name):
    zone = zoneinfo.ZoneInfo(name)
    runs = _zone_runs(name)
    assert all(a[1] == b[0] and a[2] != b[2] for a, b in zip(runs, runs[1:], strict=False))
    for start, _, offset in runs[1:]:
        for second, want in ((start // 10**6, offset), (start // 10**6 - 1, None)):
            moment = dt.datetime.fromtimestamp(second, UTC).astimezone(zone).utcoffset().total_seconds() * 1e6
            assert (moment == offset) is (want is not None)


@pytest.mark.parametrize("year", [1, 1601, 1899, 1900, 2099, 2100, 2101, 2150, 2196, 2400, 9998])
@pytest.mark.parametrize("name", ["Europe/Madrid", "America/New_York", "Australia/Sydney", "Asia/Tokyo"])
def test_years_have_no_end(spark, name, year):
    zone = zoneinfo.ZoneInfo(name)
    days = [dt.datetime(year, m, d, 12, tzinfo=zone) for m, d in ((1, 1), (3, 12), (3, 30), (6, 1), (10, 3), (10, 28), (11, 4), (12, 31))]
    rows = [("t", i, 1, f"{d:%m-%d %H:%M:%S}".join([f"{year:04d}-", ""])) for i, d in enumerate(days)]
    want = [(i, round((d.astimezone(UTC) - dt.datetime(1970, 1, 1, tzinfo=UTC)).total_seconds()) * 10**6) for i, d in enumerate(days)]
    assert run(spark, rows, ((1, name, "en-GB"),)) == want


def test_reasons(spark):
    texts = {None: "no time", " ": "no time", "-1": "no time", "0000-00-00 00:00:00": "no time", "next Tuesday 5": "unread", "2022-01-14": "unread", "2022-02-30 10:00:00": "impossible", "2022-03-27 02:30:00": "skipped",
             "2022-10-30 02:30:00": "shown twice", "2022-01-01T10:00:00[No/Where]": "unknown zone", "2022-01-01 10:00:00 XYZ": "unknown zone", "1640995200": None}
    stamps = spark.createDataFrame([("t", i, 1, s) for i, s in enumerate(texts)], STAMPS)
    hosts = spark.createDataFrame([(1, "Europe/Madrid", "es-ES")], HOSTS)
    got = {r.stamp: r.reason for r in read_stamps(stamps, hosts, 1).collect()}
    assert got == texts
