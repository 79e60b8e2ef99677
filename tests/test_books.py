"""Books, ladders, gates and streams: fixed vectors, brute force, and the same replay as batch and as stream."""

import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from twinbook.operators import books as B
from twinbook.operators import gates as G
from twinbook.operators.depth import depth_walk
from twinbook.streaming import processors as S

T0 = datetime(2026, 3, 1, tzinfo=timezone.utc)
LADDER = "pair int, price decimal(9,6), qty double"


def ladder(spark, levels):
    from decimal import Decimal

    return spark.createDataFrame([(k, Decimal(str(p)), float(q)) for k, p, q in levels], LADDER)


@pytest.mark.parametrize(
    ("asks", "bids", "size", "steps"),
    [
        ([(0.42, 100), (0.40, 100), (0.41, 100)], [(0.48, 100), (0.50, 100), (0.49, 100)], 300, 3),
        ([(0.40, 30), (0.41, 100)], [(0.50, 120)], 120, 2),
        ([(0.60, 100)], [(0.50, 100)], None, None),
        ([(0.40, 40)], [(0.50, 30.5)], 30, 1),
        ([(0.40, 0.9)], [(0.50, 30)], None, None),
        ([(0.40, 40)], [], None, None),
    ],
)
def test_depth_vectors(spark, asks, bids, size, steps):
    got = depth_walk(ladder(spark, [(1, *x) for x in asks]), ladder(spark, [(1, *x) for x in bids]), ["pair"]).collect()
    assert [(r["size"], r.steps) for r in got] == ([] if size is None else [(size, steps)])


def test_depth_is_the_sequential_walk(spark):
    rnd = random.Random(7)
    asks, bids = [], []
    for k in range(200):
        for side in (asks, bids):
            for p in rnd.sample(range(30, 70), rnd.randrange(0, 7)):
                side.append((k, p / 100, rnd.choice([0.5, 1, 3, 10.25, 40])))
    got = {r.pair: (r["size"], round(float(r.gain), 6), r.steps) for r in depth_walk(ladder(spark, asks), ladder(spark, bids), ["pair"]).collect()}
    want = {}
    for k in range(200):
        a = sorted([p, int(q)] for kk, p, q in asks if kk == k and int(q))
        b = sorted(([p, int(q)] for kk, p, q in bids if kk == k and int(q)), reverse=True)
        size = steps = gain = 0
        while a and b and b[0][0] - a[0][0] > 1e-12:
            n = min(a[0][1], b[0][1])
            size, steps, gain = size + n, steps + 1, gain + n * (b[0][0] - a[0][0])
            for side in (a, b):
                side[0][1] -= n
                if not side[0][1]:
                    side.pop(0)
        if size:
            want[k] = (size, round(gain, 6), steps)
    assert got == want


DELTAS = "market_id string, seq long, kind string, side string, price double, qty double"


def deltas(n, seed):
    rnd, out = random.Random(seed), []
    for i in range(n):
        m = rnd.choice("abc")
        if rnd.random() < 0.05:
            out += [(m, i, "snapshot", s, float(p), float(rnd.randrange(1, 9))) for s in ("bid", "ask") for p in rnd.sample(range(5), 2)]
        else:
            out.append((m, i, "delta", rnd.choice(["bid", "ask", None]), float(rnd.randrange(5)), float(rnd.randrange(-6, 7))))
    return out


def fold(rows):
    state, out = defaultdict(lambda: None), {}
    seen = {}
    for m, i, kind, side, price, qty in rows:
        if kind == "snapshot" and seen.get(m) != i:
            state[m], seen[m] = {}, i
        if state[m] is None or side is None:
            continue
        state[m][side, price] = max(0.0, (0.0 if kind == "snapshot" else state[m].get((side, price), 0.0)) + qty)
        out[m, side, price, i] = state[m][side, price]
    return out


def test_fold_of_deltas(spark):
    rows = deltas(1_500, 1)
    got = {(r.market_id, r.side, r.price, r.seq): r.qty for r in B.fold_deltas(spark.createDataFrame(rows, DELTAS)).collect()}
    assert got == fold(rows)


def test_ladder_expressions(spark):
    df = spark.sql("SELECT array(named_struct('price', 0.5D, 'qty', 1D), named_struct('price', 0.4D, 'qty', 2D), named_struct('price', 0.5D, 'qty', 3D), named_struct('price', 0.3D, 'qty', 0D), named_struct('price', CAST(NULL AS DOUBLE), 'qty', 1D)) AS s")
    r = df.select(B.levels(F.col("s")).alias("all"), B.levels(F.col("s"), True).alias("last"), B.complement(B.levels(F.col("s"), True)).alias("no"), B.sorted_side(B.levels(F.col("s")), False).alias("bids")).collect()[0]
    assert [tuple(x) for x in r["all"]] == [(0.5, 1), (0.4, 2), (0.5, 3)] and [tuple(x) for x in r["last"]] == [(0.4, 2), (0.5, 3)]
    assert [tuple(x) for x in r["no"]] == [(0.5, 3), (0.6, 2)] and [tuple(x) for x in r["bids"]] == [(0.5, 1), (0.5, 3), (0.4, 2)]


def frames(spark, rows):
    return spark.createDataFrame(
        [(i, m, i, T0 + timedelta(seconds=s), kind, valid, b, a, None) for i, (m, s, kind, valid, b, a) in enumerate(rows)],
        "row_id long, market_id string, seq long, received_at timestamp, type string, is_valid boolean, best_bid_price double, best_ask_price double, exchange_timestamp string",
    )


def test_last_valid_book_is_kept(spark):
    df = frames(spark, [("m", 0, "snapshot", True, 0.4, 0.5), ("m", 1, "update", False, 0.6, 0.5), ("m", 2, "update", None, 0.41, 0.5), ("m", 3, "update", True, 0.5, 0.5), ("m", 4, "status", True, 0.1, 0.2), ("n", 0, "update", False, 0.1, 0.2)])
    assert [(r.market_id, r.bid) for r in B.latest_books(df).collect()] == [("m", 0.41)]
    assert {r.market_id: r.invalid for r in B.invalid_counts(df).collect()} == {"m": 2, "n": 1}
    assert [r.row_id for r in B.changes(df.where("market_id = 'm'")).orderBy("row_id").collect()] == [0, 1, 2, 3, 4]


def test_cadence_and_patience(spark):
    df = frames(spark, [("m", 6 * i, "update", True, 0.5, 0.51) for i in range(7)])
    at = G.rolling_median_gap(G.updates(df)).withColumn("p", G.patience(F.col("median_gap"))).orderBy("us").collect()
    assert at[4].median_gap is None and at[4].p == 10.0 and at[6].median_gap == 6.0 and at[6].p == 24.0


def test_as_of_falls_back_to_the_first(spark):
    prices = spark.createDataFrame([("m", 10, 0.5), ("m", 20, 0.6), ("m", 15, None), ("n", 5, 0.1)], "market_id string, us long, mid double")
    moments = spark.createDataFrame([("m", 5), ("m", 10), ("m", 16), ("m", 30), ("x", 1)], "market_id string, us long")
    assert {(r.market_id, r.us): r.mid for r in G.as_of(moments, prices).collect()} == {("m", 5): 0.5, ("m", 10): 0.5, ("m", 16): 0.5, ("m", 30): 0.6, ("x", 1): None}


def test_persistence_runs(spark):
    ticks = [("a", 1, True, 1), ("a", 2, False, 1), ("a", 3, True, 1), ("a", 4, True, 2), ("a", 5, True, 3), ("a", 6, True, 3), ("b", 1, True, 1), ("b", 2, True, 1), ("b", 3, None, 1), ("b", 4, True, None), ("b", 5, True, None), ("b", 6, True, None)]
    df = spark.createDataFrame(ticks, "k string, at int, present boolean, version int")
    got = {(r.k, r.first["at"]): (r.last["at"], r.ticks, r.observations, r.confirmed and r.confirmed["at"]) for r in G.persistence(df, ["k"], ["at"]).collect()}
    assert got == {("a", 1): (1, 1, 1, None), ("a", 3): (5, 4, 3, 5), ("b", 1): (1, 2, 1, None), ("b", 4): (6, 3, 3, 6)}


def test_persistence_by_duration(spark):
    rnd = random.Random(7)
    ticks, at = [], 0
    for _ in range(400):
        at += rnd.choice([1, 2, 5])
        ticks.append(("a", at, rnd.random() < 0.9, rnd.choice([None, 1, 1, 2])))
    df = spark.createDataFrame(ticks, "k string, at int, present boolean, version int")
    for least, lasting in ((3, 6), (None, 6), (4, None)):
        want, run = {}, None
        for _, t, present, version in ticks:
            if not present:
                run = None
                continue
            if run is not None and version is not None and version == run["version"]:
                continue
            run = run or {"first": t, "seen": 0}
            run["seen"], run["version"] = run["seen"] + 1, version
            if want.setdefault(run["first"], None) is None and ((least and run["seen"] >= least) or (lasting and t - run["first"] >= lasting)):
                want[run["first"]] = t
        got = {r.first["at"]: r.confirmed and r.confirmed["at"] for r in G.persistence(df, ["k"], ["at"], least, lasting).collect()}
        assert got == want and any(want.values())
    with pytest.raises(ValueError, match="must be given"):
        G.persistence(df, ["k"], ["at"], None)
    with pytest.raises(ValueError, match="at least 1"):
        G.persistence(df, ["k"], ["at"], 0)


def run_stream(spark, tmp_path, batches, schema, build, name):
    """Replays batches in order through a stream over files; returns what it put out."""
    source = tmp_path / name
    for i, df in enumerate(batches):
        df.coalesce(1).write.mode("append").parquet(str(source / f"{i:03d}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(str(source))
    q = build(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"{name}_ckpt")).start()
    q.awaitTermination(180)
    return spark.table(name).collect()


def test_stream_of_deltas_is_the_batch_fold(spark, tmp_path):
    rows = deltas(240, 3)
    df = spark.createDataFrame(rows, DELTAS)
    got = run_stream(spark, tmp_path, [df.where(f"seq >= {a} AND seq < {a + 80}") for a in (0, 80, 160)], df.schema, S.stream_ladders, "ladders")
    assert {(r.market_id, r.side, r.price, r.seq): r.qty for r in got} == fold(rows)


def test_stream_of_books_ends_with_the_latest(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(rnd.choice("mn"), i, rnd.choice(["update", "update", "status"]), rnd.choice([True, None, False]), rnd.choice([0.4, 0.41]), rnd.choice([0.5, 0.41])) for i in range(120)]
    df = frames(spark, rows)
    got = run_stream(spark, tmp_path, [df.where(f"row_id >= {a} AND row_id < {a + 60}") for a in (0, 60)], df.schema, S.stream_books, "books")
    last = {}
    for r in sorted(got, key=lambda r: r.received_us):
        last[r.market_id] = (r.bid, r.ask)
    assert last == {r.market_id: (r.bid, r.ask) for r in B.latest_books(df).collect()}
    assert all((x.bid, x.ask) != (y.bid, y.ask) for m in "mn" for x, y in zip(*(lambda o: (o, o[1:]))(sorted((r for r in got if r.market_id == m), key=lambda r: r.received_us))))


def test_stream_of_minutes_is_the_batch(spark, tmp_path):
    from twinbook.operators.late_minutes import first_deliveries, late_minutes

    rnd = random.Random(8)
    rows = []
    for i in range(300):
        event = T0 + timedelta(seconds=rnd.randrange(0, 240))
        rows.append((i, rnd.choice("ab"), rnd.randrange(0, 250), event + timedelta(seconds=rnd.choice([0.3, 2, 30, 250, 400])), "update", rnd.choice([True, None, False]), round(rnd.random() / 2, 2), round(0.5 + rnd.random() / 2, 2), int(event.timestamp() * 1e6)))
    rows.sort(key=lambda r: r[3])
    schema = "row_id long, market_id string, seq long, received_at timestamp, type string, is_valid boolean, best_bid_price double, best_ask_price double, event_us long"
    df = spark.createDataFrame(rows, schema)
    cuts = [rows[0][3], rows[100][3], rows[200][3], rows[-1][3] + timedelta(seconds=1)]
    got = run_stream(spark, tmp_path, [df.where((F.col("received_at") >= F.lit(a)) & (F.col("received_at") < F.lit(b))) for a, b in zip(cuts, cuts[1:])], df.schema, S.stream_minutes, "minutes")
    last = {}
    for r in sorted(got, key=lambda r: r.version):
        last[r.market_id, r.minute_s] = r
    first = first_deliveries(df, columns=("row_id", "received_at", "type", "is_valid", "best_bid_price", "best_ask_price", "event_us"))
    kept, _ = S.accepted_frames(first)
    want = {(r.market_id, r.minute_s): r for r in late_minutes(kept.drop("minute_s", "late_s")).final.collect()}
    assert {k: (r.frame_count, r.low_bid, r.high_bid, r.low_ask, r.high_ask) for k, r in last.items()} == {k: (r.frame_count, r.low_bid, r.high_bid, r.low_ask, r.high_ask) for k, r in want.items()}


def test_ranges_of_a_hot_key(spark):
    """Most rows are one market's, some have no market, one lies in a range of its own: windows by range give what whole windows give."""
    from pyspark.sql import Window

    from twinbook.operators.ranged import HALO, PART, ranged, with_halo

    rows = [("hot", i, i % 7) for i in range(3_000)] + [(None, i, i % 5) for i in range(1_500)] + [("cold", i, i) for i in range(3)]
    df = spark.createDataFrame(rows, "market_id string, us long, v long")
    whole = Window.partitionBy("market_id").orderBy("us")
    want = sorted(map(tuple, df.select("market_id", "us", F.lag("v").over(whole), F.sum("v").over(whole.rowsBetween(-40, 0))).collect()), key=str)
    at = ranged(df, "market_id", "us")
    assert at.where("market_id = 'hot'").select(PART).distinct().count() > 1
    part = Window.partitionBy("market_id", PART).orderBy("us")
    got = with_halo(at, "market_id", ["us"], 40).select("*", F.lag("v").over(part).alias("l"), F.sum("v").over(part.rowsBetween(-40, 0)).alias("s")).where(~F.col(HALO))
    assert sorted(map(tuple, got.select("market_id", "us", "l", "s").collect()), key=str) == want
    kept = with_halo(at, "market_id", ["us"], 1, F.col("v") == 0).withColumn("last", F.last(F.when(F.col("v") == 0, F.col("us")), True).over(part.rowsBetween(Window.unboundedPreceding, 0))).where(~F.col(HALO))
    assert kept.where("market_id = 'hot' AND last <> us - us % 7").count() == 0
    assert with_halo(ranged(df.limit(0), "market_id", "us"), "market_id", ["us"], 3).count() == 0
