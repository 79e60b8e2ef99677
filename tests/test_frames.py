"""Problems 2, 4 and 5 against plain Python on small tables."""

import math
import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest

from twinbook.operators.frames import is_valid_frame
from twinbook.operators.late_minutes import first_deliveries, late_minutes
from twinbook.operators.regular_grid import regular_grid
from twinbook.operators.spikes import implausible_rows, reading_scores

T0 = datetime(2026, 3, 1, tzinfo=timezone.utc)
EVENTS = "row_id long, market_id string, seq long, received_at timestamp, event_us long, best_bid_price double, best_ask_price double"


def us(t):
    return int((t - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))


def test_late_minutes_match_plain_python(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(600):
        event = T0 + timedelta(seconds=rnd.randrange(0, 400), microseconds=rnd.randrange(10**6))
        late = rnd.choice([0.2, 5, 40, 200, 301, 600])
        price = rnd.choice([None, float("nan"), round(rnd.random(), 2)])
        rows.append((i, rnd.choice(["a", "b", None]), i, event + timedelta(seconds=late), us(event), price, rnd.random()))
    rows.append((1000, "a", None, None, us(T0), 0.1, 0.2))
    rows.append((1001, "a", None, T0, None, 0.1, 0.2))
    got = late_minutes(spark.createDataFrame(rows, EVENTS))
    state, late_keys, dropped = defaultdict(list), set(), 0
    for r in rows:
        if r[3] is None or r[4] is None:
            continue
        minute = r[4] // 60_000_000 * 60
        over = us(r[3]) - (minute + 60) * 10**6
        if over > 300 * 10**6:
            dropped += 1
            continue
        state[r[1], minute].append(r)
        if over >= 10 * 10**6:
            late_keys.add((r[1], minute))
    assert got.dropped.count() == dropped
    upserts = got.upserts.collect()
    assert {(r.market_id, r.minute_s) for r in upserts if r.is_correction} == late_keys
    final = {(r.market_id, r.minute_s): r for r in got.final.collect()}
    assert set(final) == set(state)
    for k, rs in state.items():
        bids = [(r[4], r[2], r[5]) for r in rs if r[5] is not None and not math.isnan(r[5])]
        f = final[k]
        assert f.frame_count == len(rs)
        assert (f.last_bid, f.low_bid, f.high_bid) == ((max(bids)[2], min(b[2] for b in bids), max(b[2] for b in bids)) if bids else (None, None, None))
        assert f.last_ask == max((r[4], r[2], r[6]) for r in rs)[2]
    versions = defaultdict(list)
    for r in upserts:
        versions[r.market_id, r.minute_s].append((r.version, r.frame_count))
    assert all([v for v, _ in sorted(x)] == list(range(1, len(x) + 1)) and sorted(x)[-1][1] == final[k].frame_count for k, x in versions.items())


def test_first_delivery_is_looked_at(spark):
    rows = [(1, "a", 1, T0 + timedelta(seconds=5)), (2, "a", 1, T0), (3, "a", 1, T0), (4, "a", None, T0), (5, "a", None, T0), (6, None, 1, T0), (7, "a", 2, None), (8, "a", 2, T0)]
    df = spark.createDataFrame(rows, "row_id long, market_id string, seq long, received_at timestamp")
    assert sorted(r.row_id for r in first_deliveries(df, columns=("row_id", "received_at")).collect()) == [2, 4, 5, 6, 8]


def test_empty_frames(spark):
    empty = spark.createDataFrame([], EVENTS)
    got = late_minutes(empty)
    assert got.final.count() == got.upserts.count() == got.dropped.count() == 0


STREAMS = "stream_id long, started_at timestamp, ended_at timestamp, extra string"
READINGS = "row_id long, stream_id long, received_at timestamp, best_bid_price double, best_ask_price double, status string"


def test_grid_interpolates_in_time_and_marks_gaps(spark):
    m = lambda x: T0 + timedelta(minutes=x)
    streams = spark.createDataFrame([(1, m(0), m(20), "x"), (1, m(0), m(20), "x"), (2, m(0), m(2), "x"), (3, m(5), m(5), "x"), (4, None, m(3), "x"), (None, m(0), m(3), "x")], STREAMS)
    readings = spark.createDataFrame(
        [
            (1, 1, m(0.5), 0.2, 0.3, "s"), (2, 1, m(4.5), 0.6, 0.7, "s"), (3, 1, m(15.5), 0.4, 0.5, "s"), (4, 1, m(2), None, 0.5, "s"), (5, 1, m(2), float("nan"), 0.5, "s"),
            (6, 9, m(1), 0.1, 0.2, "s"), (7, 1, m(21), 0.5, 0.6, "s"), (8, None, m(1), 0.5, 0.6, "s"), (9, 1, None, 0.5, 0.6, "s"), (3, 1, m(15.5), 0.4, 0.5, "s"),
        ],
        READINGS,
    )
    got = {(r.stream_id, (r.minute_s - us(T0) // 10**6) // 60): r for r in regular_grid(streams, readings).collect()}
    assert sorted(k for k in got if k[0] == 1) == [(1, i) for i in range(20)] and sorted(k for k in got if k[0] == 2) == [(2, 0), (2, 1)] and len(got) == 22
    assert got[1, 0].status == "observed" and got[1, 0].best_bid_price == 0.2
    assert got[1, 2].status == "filled" and math.isclose(got[1, 2].best_bid_price, 0.2 + 0.4 * 1.5 / 4)
    assert got[1, 4].status == "observed" and math.isclose(got[1, 4].best_bid_price, 0.2 + 0.4 * 3.5 / 4)
    assert got[1, 8].status == "gap" and got[1, 8].best_bid_price is None
    assert got[1, 15].n_readings == 2
    assert got[1, 18].status == "gap" and got[2, 0].status == "gap"
    assert regular_grid(streams.limit(0), readings).count() == 0
    assert regular_grid(streams, readings.limit(0)).where("status <> 'gap'").count() == 0


FRAMES = "row_id long, market_id string, stream_id long, seq long, type string, is_valid boolean, best_bid_price double, best_ask_price double, received_at timestamp, score double"


def walk(market, stream, n, seed, start=1):
    rnd = np.random.default_rng(seed)
    price, out = 0.5, []
    for i in range(n):
        price = min(0.85, max(0.15, price + float(rnd.choice([-0.02, -0.01, 0.01, 0.02]))))
        out.append([start + i, market, stream, i + 1, "update", True, round(price, 2), round(price + 0.02, 2), T0 + timedelta(seconds=i), 0.0])
    return out


def test_spikes_frozen_runs_and_limits(spark):
    rows = walk("m", 1, 6_000, 5)
    want = set()
    for at, k in ((100, 1), (300, 3), (2047, 2), (4096, 3)):
        for i in range(at, at + k):
            rows[i][6] = round(rows[i][6] - 0.14, 2)
            want.add(rows[i][0])
    for i in range(1000, 6000):  # a level that moves and stays
        rows[i][6], rows[i][7] = round(rows[i][6] * 0.5, 3), round(rows[i][7] * 0.5, 3)
    for i in range(2030, 2090):  # frozen over a block's border
        rows[i][7] = 0.97
        want.add(rows[i][0])
    want.discard(rows[2030][0])
    for i, (b, a) in {50: (float("nan"), 0.5), 60: (-0.1, 0.5), 70: (0.2, 1.5), 80: (0.6, 0.6)}.items():
        rows[i][6], rows[i][7] = b, a
        want.add(rows[i][0])
    rows[90][6] = None
    again = [list(r) for r in rows if r[0] in (101, 61)]
    for j, r in enumerate(again):
        r[0], r[8] = 90_000 + j, r[8] + timedelta(hours=1)
        want.add(r[0])
    rows += again + [[95_000, "m", 1, None, "update", True, 2.0, 3.0, T0, 0.0], [95_001, "m", None, 3, "update", True, 0.3, 0.4, T0, 0.0]] + walk("flat", 2, 1, 1, 96_000)
    want.add(95_000)
    frames = spark.createDataFrame([tuple(r) for r in rows], FRAMES).where(is_valid_frame())
    got = {r.row_id for r in implausible_rows(frames).collect()}
    assert {51, 61, 71, 81, 95_000, 90_001} <= got
    assert len(got & want) >= 0.97 * len(want) and len(got - want) < 0.02 * len(rows)  # short runs where the walk meets its bounds
    scores = reading_scores(frames)
    assert scores.where("score <= 0 OR score > 1").count() == 0
    assert implausible_rows(frames.limit(0)).count() == 0


def test_frozen_runs_in_spite_of_one_of_middle_length(spark):
    rows = walk("m", 1, 3_000, 5)
    want = set()
    for at, k, price in [(100, 3, 0.11), (200, 7, 0.11), (500, 12, 0.12), (2030, 33, 0.13)]:  # the last one over a block's border
        for i in range(at, at + k):
            rows[i][6] = price
            if k >= 22 and i > at:
                want.add((i + 1, 0))
    frames = spark.createDataFrame([tuple(r) for r in rows], FRAMES)
    got = {(r.seq, r.side) for r in reading_scores(frames).where("is_outlier").collect()}
    assert want <= got and len(got - want) < 0.02 * 2 * len(rows)  # runs of 7 and 12 are long, too, where the others have length 1


def test_the_forest_alone_decides(spark, monkeypatch):
    from twinbook.functions.forest import Forests

    rows = walk("m", 1, 400, 5)
    for i in range(100, 103):
        rows[i][6] = round(rows[i][6] - 0.14, 2)
    rows[50][6] = 0.99
    frames = spark.createDataFrame([tuple(r) for r in rows], FRAMES)
    assert {51, 101, 102, 103} <= {r.row_id for r in implausible_rows(frames).collect()}

    class Silent(Forests):
        def score(self, points, source):
            return np.zeros(len(points))

    monkeypatch.setattr("twinbook.operators.spikes.Forests", Silent)
    from pyspark import cloudpickle

    import twinbook.operators.spikes as module

    cloudpickle.register_pickle_by_value(module)  # the workers get the module as it is here
    try:
        assert {r.row_id for r in implausible_rows(frames).collect()} == {51}
    finally:
        cloudpickle.unregister_pickle_by_value(module)


def test_a_forest_is_the_same_beside_others():
    from twinbook.functions.forest import Forests

    rnd = np.random.default_rng(2)
    a, b = rnd.random((90, 2)) * [1, 2], rnd.random((20, 2))
    box, x = np.array([8.0, 8.0]), np.array([[0.5, 0.5], [7.0, 0.5], [0.5, 7.9]])
    both, alone = Forests([a, b], [5, 9], box), Forests([b], [9], box)
    assert np.allclose(both.score(x, np.ones(3, int)), alone.score(x, np.zeros(3, int)))
    s = both.score(x, np.zeros(3, int))
    assert s[0] < 0.45 and s[1:].min() > 0.5


@pytest.mark.parametrize("n", [1, 2, 5])
def test_few_readings(spark, n):
    frames = spark.createDataFrame([tuple(r) for r in walk("m", 1, n, 2)], FRAMES)
    assert implausible_rows(frames).count() == 0 and reading_scores(frames).count() == 2 * n
