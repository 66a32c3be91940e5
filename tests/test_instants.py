import datetime as dt

import pytest

from mnesis.operators.instants import normalise_timestamps, zone_intervals

ZONES = ["Europe/Paris", "America/Toronto", "Asia/Kolkata", "Australia/Sydney", "America/Los_Angeles"]


@pytest.fixture(scope="module")
def intervals(spark):
    return zone_intervals(spark, spark.createDataFrame([(z,) for z in ZONES], "zone string")).cache()


@pytest.fixture(scope="module")
def read(spark, intervals):
    channels = spark.createDataFrame([("dmy", "Europe/Paris", "dmy", 1.0), ("mdy", "America/Toronto", "mdy", 1.0)], "channel string, home_zone string, date_order string, trust_weight double")

    def run(values):
        rows = [(i, "message", v[1] if isinstance(v, tuple) else "dmy", v[2] if isinstance(v, tuple) and len(v) > 2 else None, v[0] if isinstance(v, tuple) else v, 1) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, "record_id bigint, record_kind string, channel string, export_zone string, timestamp_raw string, utc_us int")
        got = {r.record_id: r.utc_us for r in normalise_timestamps(df, channels, intervals).collect()}
        return [None if i not in got else (dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=got[i])).isoformat(" ") for i in range(len(values))]

    return run


def test_notations(read):
    values = [
        "2024-03-18T18:14:27Z", "2024-03-18T18:14:27.123456789Z", "2024-03-18T18:14:27,5+02:00", "2023-01-21T19:55:53+0545", "2020-01-16T00:05:18.746+02", "20230525T215925Z",
        "2023-08-05 10:58:35 PST", "[2017-05-12 10:06:51 UTC]", "‎1456011216646", "1456011216", "1456011216.25", "1456011216646123", "Sun, 14 Mar 2021 00:26:21 GMT", "10 Jul 2016 17:04:22 +0530",
        "2022-03-13T22:41:52[America/Los_Angeles]", "2020-08-28 20:41:39 America/Los_Angeles", "2023-03-12, 03 h 46", "27 avr. 2021 à 0h27", "8 juin 2023 à 17h05", "14 août 2020 03:15", "31 déc. 2020 à 23:01",
    ]
    want = [
        "2024-03-18 18:14:27", "2024-03-18 18:14:27.123456", "2024-03-18 16:14:27.500000", "2023-01-21 14:10:53", "2020-01-15 22:05:18.746000", "2023-05-25 21:59:25",
        "2023-08-05 18:58:35", "2017-05-12 10:06:51", "2016-02-20 23:33:36.646000", "2016-02-20 23:33:36", "2016-02-20 23:33:36.250000", "2016-02-20 23:33:36.646123", "2021-03-14 00:26:21", "2016-07-10 11:34:22",
        "2022-03-14 05:41:52", "2020-08-29 03:41:39", "2023-03-12 02:46:00", "2021-04-26 22:27:00", "2023-06-08 15:05:00", "2020-08-14 01:15:00", "2020-12-31 22:01:00",
    ]
    assert read(values) == want


def test_order_halves_and_zones(read):
    values = [("04/05/18 10:51:40 PM", "mdy"), ("04/05/18 22:51:40", "dmy"), ("4.5.2018 12:05 am", "dmy"), ("Jul 12, 2020 at 12:24", "mdy"), ("Jul 12, 2020 12:24 PM", "mdy"), ("12/25/2021 1:05 p.m.", "mdy", "Asia/Kolkata")]
    assert read(values) == ["2018-04-06 02:51:40", "2018-05-04 20:51:40", "2018-05-03 22:05:00", "2020-07-12 16:24:00", "2020-07-12 16:24:00", "2021-12-25 07:35:00"]


def test_ambiguous_first_and_skipped_with_offset_before(read):
    values = ["2021-10-31 02:30:00", "2021-03-28 02:30:00", "2021-03-28 03:00:00", "2021-10-31 03:00:00", ("2021-11-07 01:30:00", "mdy"), ("2021-03-14 02:30:00", "mdy"), ("2021-10-03 02:30:00", "dmy", "Australia/Sydney"), ("2021-04-04 02:30:00", "dmy", "Australia/Sydney")]
    want = ["2021-10-31 00:30:00", "2021-03-28 01:30:00", "2021-03-28 01:00:00", "2021-10-31 02:00:00", "2021-11-07 05:30:00", "2021-03-14 07:30:00", "2021-10-02 16:30:00", "2021-04-03 15:30:00"]
    assert read(values) == want


def test_no_times(read):
    values = [None, "", "  ", "soon", "25:61", "32/01/2025 09:10", "2025-02-30 10:15", "2024-13-01T08:00:00", "0000-00-00 00:00:00", "n/a", "2024-01-01 13:10 PM", "x" * 50_000, "2024-01-01 10:00:00 qqq", ("13/13/2024 10:00", "mdy")]
    assert read(values) == [None] * len(values)


def test_unknown_channel_and_repeats(read):
    assert read([("2024-03-18 10:00:00", "none"), ("2024-03-18 10:00:00Z", "none"), ("29/02/2024 10:00", "dmy"), ("29/02/2023 10:00", "dmy")]) == [None, "2024-03-18 10:00:00", "2024-02-29 09:00:00", None]
    assert read([]) == []


def test_intervals_cover_each_reading_once(intervals):
    rows = intervals.where("zone = 'europe/paris' and year = 2021").orderBy("asof_from").collect()
    assert all(a.asof_to == b.asof_from for a, b in zip(rows, rows[1:])) and len(rows) == 3


def test_any_year_as_the_zone_database_has_it(spark, read):
    from zoneinfo import ZoneInfo

    days = [(y, m, 10) for y in (1, 1650, 1850, 1899, 1901, 2099, 2100, 2101, 2129, 2150, 2300, 2400, 2401, 5000, 9998) for m in (1, 4, 7, 11)]
    values, want = [], []
    for zone in ("Europe/Paris", "America/Toronto", "Australia/Sydney"):
        for y, m, d in days:
            values.append((f"{y:04d}-{m:02d}-{d:02d} 12:00:00", "dmy", zone))
            local = dt.datetime(y, m, d, 12, tzinfo=ZoneInfo(zone))
            want.append(str((local - local.utcoffset()).replace(tzinfo=None)))
    assert read(values) == want
