from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinbook.operators.instants import rewritten, with_instant

FEEDS = "feed_id int, zone_name string, date_order string"
ROWS = [(1, "America/New_York", "ymd"), (2, "America/Chicago", "mdy"), (4, "Europe/London", "dmy"), (7, "Asia/Kolkata", "dmy"), (9, "Australia/Sydney", "dmy")]


def read(spark, rows, near=None):
    feeds = spark.createDataFrame(ROWS, FEEDS)
    df = spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(rows)], "i int, feed_id int, t string")
    if near is not None:
        df = df.withColumn("received_at", F.lit(near).cast("timestamp"))
    got = {r.i: r.utc_us for r in with_instant(df, "t", feeds, near=None if near is None else F.col("received_at")).collect()}
    return [None if got[i] is None else datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=got[i]) for i in range(len(rows))]


CASES = [
    (1, "2026-02-04T04:00:00.687707733Z", "2026-02-04T04:00:00.687707"),
    (1, " 2026-02-04t04:00:18z ", "2026-02-04T04:00:18"),
    (1, "1770177600", "2026-02-04T04:00:00"), (1, "1770177611.451", "2026-02-04T04:00:11.451"), (1, "1770182194155", "2026-02-04T05:16:34.155"),
    (1, "1770182200534702", "2026-02-04T05:16:40.534702"), (1, "1770182200534702999", "2026-02-04T05:16:40.534702"),
    (4, "04/02/2026 05:25:03", "2026-02-04T05:25:03"), (2, "04/02/2026 05:25:03", "2026-04-02T10:25:03"), (1, "04/02/2026", None),
    (2, "02/10/2026 7:33:15 PM", "2026-02-11T01:33:15"), (2, "02/10/2026 12:00:00 AM", "2026-02-10T06:00:00"), (2, "02/10/2026 13:00:00 PM", None),
    (9, "04.02.2026 20:55:56.778", "2026-02-04T09:55:56.778"), (1, "2026-02-03 23:27:58-0600", "2026-02-04T05:27:58"),
    (1, "2026-03-31T11:00:00.000-04:00[America/New_York]", "2026-03-31T15:00:00"), (1, "20260204T051617Z", "2026-02-04T05:16:17"),
    (4, "20260704174312", "2026-07-04T16:43:12"), (4, "2026-07-04 17:43:12,516", "2026-07-04T16:43:12.516"), (1, "2026-02-04T05:28:38.108631+00", "2026-02-04T05:28:38.108631"),
    (1, "2026-02-15 11:04:52 GMT+05:30", "2026-02-15T05:34:52"), (1, "2026-03-08 03:22:55 EDT", "2026-03-08T07:22:55"), (1, "2026-03-30 06:05:34 CEST", "2026-03-30T04:05:34"),
    (1, "Tue, 10 Feb 2026 20:12:34 -0600", "2026-02-11T02:12:34"), (2, "Mar 10, 2026 1:11:44 PM ET", "2026-03-10T18:11:44"), (1, "April 20, 2027 at 8:00 pm ET", "2027-04-21T00:00:00"),
    (2, "08-Jan-28 17:00", "2028-01-08T23:00:00"), (1, "2028-02-02", "2028-02-02T05:00:00"), (1, "2029-07-15T15:00Z", "2029-07-15T15:00:00"),
    (7, "26-02-04", "2004-02-26T00:00:00"), (1, "26-02-04 01:00", "2026-02-04T06:00:00"), (1, "2028-02-29", "2028-02-29T05:00:00"),
    (1, "2026-02-30T10:00:00Z", None), (1, "2026-13-45T99:00:00Z", None), (1, "0000-00-00 00:00:00", None), (1, "24:00", None), (1, "2026-02-04 24:00:00", None),
    (1, "2026-02-04 23:59:60", None), (1, "TBD", None), (1, "", None), (1, "   ", None), (1, None, None), (1, "T::Z", None), (1, "2026-02-04 10:00 XYZ", None),
    (None, "2026-02-04 10:00", None), (99, "2026-02-04 10:00", None), (None, "2026-02-04 10:00 UTC", "2026-02-04T10:00:00"), (1, "2026-03-08 02:30:00", "2026-03-08T07:30:00"),
    (1, "2026-02-04 10:00:00 Europe/Berlin", "2026-02-04T09:00:00"), (1, "x" * 100_000, None), (7, "26-Feb-2004", "2004-02-25T18:30:00"),
]


def test_forms(spark):
    want = [None if w is None else datetime.fromisoformat(w).replace(tzinfo=timezone.utc) for _, _, w in CASES]
    got = read(spark, [(f, t) for f, t, _ in CASES])
    # the two-digit form follows the feed's order: day, month, year
    want[29] = datetime(2004, 2, 25, 18, 30, tzinfo=timezone.utc)
    assert [(c[1][:60] if c[1] else c[1], g) for c, g in zip(CASES, got)] == [(c[1][:60] if c[1] else c[1], w) for c, w in zip(CASES, want)]


@pytest.mark.parametrize(("near", "hour"), [("2026-11-01T05:31:00Z", 5), ("2026-11-01T06:31:00Z", 6)])
def test_repeated_hour_is_the_nearer(spark, near, hour):
    assert read(spark, [(1, "2026-11-01 01:30:00")], near)[0].hour == hour


def test_repeated_hour_is_the_earlier_without_arrival(spark):
    assert read(spark, [(1, "2026-11-01 01:30:00"), (9, "2026-04-05 02:30:00")]) == [datetime(2026, 11, 1, 5, 30, tzinfo=timezone.utc), datetime(2026, 4, 4, 15, 30, tzinfo=timezone.utc)]


def test_plain_is_no_case_and_names_may_clash(spark):
    feeds = spark.createDataFrame(ROWS, FEEDS)
    df = spark.createDataFrame([(1, 1, "2026-02-04T04:00:00Z", "a", 5), (2, 1, "2026-02-04 04:00:00Z", "b", 5), (2, 1, "2026-02-04 04:00:00Z", "b", 5)], "row_id int, feed_id int, t string, zone_name string, utc_us int")
    out = with_instant(df, "t", feeds)
    assert out.columns == ["row_id", "feed_id", "t", "zone_name", "utc_us"] and out.count() == 3
    assert [r.row_id for r in rewritten(out, "t").collect()] == [2, 2]
    assert with_instant(df.limit(0), "t", feeds).count() == 0


@given(st.lists(st.tuples(st.sampled_from([r[0] for r in ROWS]), st.datetimes(datetime(1990, 1, 1), datetime(2037, 12, 31))), min_size=1, max_size=60))
@settings(max_examples=6, deadline=None)
def test_wall_times_against_zone_rules(spark, rows):
    zones = {r[0]: ZoneInfo(r[1]) for r in ROWS}
    got = read(spark, [(f, d.strftime("%Y-%m-%d %H:%M:%S.%f")) for f, d in rows])
    # fold=0 takes the earlier of two instants, and the offset before the change in a gap
    assert got == [d.replace(tzinfo=zones[f], fold=0).astimezone(timezone.utc) for f, d in rows]
