"""Timestamps against Python's own time zone arithmetic, and the defined results of odd input."""

from __future__ import annotations

import random
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest

from quadloom.operators.timestamps import equal_instants, instant_classes, normalise_timestamps

SCHEMA = "id bigint, text string, zone string, `order` string"


def run(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    out = normalise_timestamps(df, "text", "zone", "order").orderBy("id").collect()
    return [(r["ts_status"], None if r["ts_instant_us"] is None else datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=r["ts_instant_us"])) for r in out]


NOTATIONS = ["%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y/%m/%d %H:%M:%S", "%Y%m%d%H%M%S", "%Y%m%dT%H%M%S", "%Y-%jT%H:%M:%S", "%d.%m.%Y, %H:%M:%S", "%d.%m.%y %H:%M", "%d/%m/%Y %H:%M:%S", "%d/%m/%Y %I:%M:%S %p", "%B %d, %Y %H:%M:%S", "%d-%b-%Y %H:%M:%S", "%a, %d %b %Y %H:%M:%S"]


def expected(local: datetime, zone: str):
    """By brute force: every UTC time whose local time in the zone is the given one."""
    z = ZoneInfo(zone)
    hits = {u for h in range(-15, 16) for m in (0, 30) if (u := (local - timedelta(hours=h, minutes=m)).replace(tzinfo=UTC)).astimezone(z).replace(tzinfo=None) == local}
    return ("resolved", hits.pop()) if len(hits) == 1 else ("ambiguous" if hits else "nonexistent", None)


def test_notations_and_zones(spark):
    rng, rows, want = random.Random(5), [], []
    for zone in ("Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kolkata", "UTC"):
        for notation in NOTATIONS:
            for _ in range(3):
                t = datetime(rng.randrange(2001, 2030), rng.randrange(1, 13), rng.randrange(1, 29), rng.randrange(24), rng.randrange(60), 0)
                rows.append((t.strftime(notation), zone, "dmy"))
                want.append(expected(t, zone))
        for day in (datetime(2024, 3, 31), datetime(2024, 10, 27), datetime(2024, 3, 10), datetime(2024, 11, 3), datetime(2024, 10, 6), datetime(2024, 4, 7)):
            for minute in range(0, 300, 20):
                t = day + timedelta(minutes=minute)
                rows.append((t.isoformat(sep=" "), zone, None))
                want.append(expected(t, zone))
    assert run(spark, rows) == want


@pytest.mark.parametrize(
    ("text", "zone", "order", "want"),
    [
        ("2020-06-01T12:00:00Z", None, None, "2020-06-01T12:00:00"),
        ("2020-06-01T12:00+02:00", "Asia/Kolkata", None, "2020-06-01T10:00:00"),
        ("20200601T120000+05", None, None, "2020-06-01T07:00:00"),
        ("2020-06-01 12:00:00 UTC-03:30", None, None, "2020-06-01T15:30:00"),
        ("2011-10-30T02:31:00+02:00[Europe/Madrid]", None, None, "2011-10-30T00:31:00"),
        ("2020-06-01T12:00:00 Europe/London", None, None, "2020-06-01T11:00:00"),
        ("2020-06-01 12:00:00 CEST", None, None, "2020-06-01T10:00:00"),
        ("2020-06-01T24:00:00Z", None, None, "2020-06-02T00:00:00"),
        ("2019-12-31 24:00:00", "Europe/Berlin", None, "2019-12-31T23:00:00"),
        ("1600000000", None, None, "2020-09-13T12:26:40"),
        ("1600000000123", None, None, "2020-09-13T12:26:40.123"),
        ("1600000000123456", None, None, "2020-09-13T12:26:40.123456"),
        ("03/04/2020 1:02:03 PM", "UTC", "mdy", "2020-03-04T13:02:03"),
        ("03/04/2020 12:02:03 AM", "UTC", "dmy", "2020-04-03T00:02:03"),
        ("12. November 2022, 21:52:00 Uhr", "UTC", "dmy", "2022-11-12T21:52:00"),
        ("30 de octubre de 2016, 02:52:00", "UTC", None, "2016-10-30T02:52:00"),
        ("22 août 2011 à 02h58", "UTC", None, "2011-08-22T02:58:00"),
        ("2020-02-29 10:00:00,5", "UTC", None, "2020-02-29T10:00:00.500"),
        ("2019-060T00:00:00Z", None, None, "2019-03-01T00:00:00"),
        ("2020-06-01T12:00:00." + "0" * 300_000 + "Z", None, None, "2020-06-01T12:00:00"),
    ],
)
def test_forms(spark, text, zone, order, want):
    assert run(spark, [(text, zone, order)]) == [("resolved", datetime.fromisoformat(want).replace(tzinfo=UTC))]


@pytest.mark.parametrize(
    ("text", "zone", "order", "status"),
    [
        (None, "UTC", None, "unparsed"), ("", "UTC", None, "unparsed"), ("n/a", "UTC", None, "unparsed"), ("2020-06-01", "UTC", None, "unparsed"), ("2020-06", "UTC", None, "unparsed"),
        ("9" * 200_000, "UTC", None, "unparsed"), ("1 a/" * 50_000, "UTC", None, "unparsed"), ("2019-02-29 10:00:00", "UTC", None, "invalid"), ("2020-13-01 10:00:00", "UTC", None, "invalid"), ("2020-01-01 24:00:01", "UTC", None, "invalid"),
        ("2019-366T10:00:00", "UTC", None, "invalid"), ("13/01/2020 13:00:00 PM", "UTC", "dmy", "invalid"), ("2020-06-01 10:00:00", None, None, "no_zone"), ("2020-06-01 10:00:00 XYZ", None, None, "unknown_zone"),
        ("2020-06-01 10:00:00+19:00", None, None, "unknown_zone"), ("2020-06-01 10:00:00", "Mars/Base", None, "unknown_zone"), ("01/02/2020 10:00:00", "UTC", None, "unparsed"), ("01/02/2020 10:00:00", "UTC", "ymd", "unparsed"),
        ("1700-06-01 10:00:00", "UTC", None, "out_of_range"),
    ],
)
def test_unresolved(spark, text, zone, order, status):
    assert run(spark, [(text, zone, order)]) == [(status, None)]


def test_empty_repeated_and_clashing_columns(spark):
    df = spark.createDataFrame([], "id bigint, text string, __t string, spans int, ts_status int")
    assert normalise_timestamps(df, "text").count() == 0
    rows = spark.createDataFrame([(1, "2020-06-01T00:00:00Z", "x", 1, 2, None)] * 2, "id bigint, text string, __t string, spans int, ts_status int, __zone string")
    out = normalise_timestamps(rows, "text")
    assert sorted(out.columns) == sorted(["id", "text", "__t", "spans", "__zone", "ts_status", "ts_instant_us", "ts_sub_us", "ts_zone"])
    assert [(r["__t"], r["spans"], r["ts_status"]) for r in out.collect()] == [("x", 1, "resolved")] * 2


def test_pairs(spark):
    rows = [(1, "s", "2020-06-01T10:00:00Z", "d"), (2, "s", "2020-06-01T12:00:00+02:00", "d"), (3, "s", "2020-06-01T10:00:00Z", None), (4, "s", "2020-06-01T10:00:00Z", "d"), (5, "t", "2020-06-01T10:00:00Z", "e"), (6, None, "2020-06-01T10:00:00Z", "e"), (7, "s", "2020-06-01T10:00:00.0000001Z", "d")]
    df = normalise_timestamps(spark.createDataFrame(rows, "id bigint, s string, v string, dt string"), "v")
    got = {tuple(r) for r in equal_instants(df, "id", "s", ["v", "dt"]).collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (2, 4), (3, 4)}
    assert sorted(tuple(r) for r in instant_classes(df, "id", "s", ["v", "dt"]).collect()) == [(1, 1, 2), (2, 1, 3), (3, 1, 3), (4, 1, 2)]
