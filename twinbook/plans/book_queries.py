"""Queries on book frames, ladders and gates, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinbook.operators import books as B
from twinbook.operators import gates as G
from twinbook.operators.depth import depth_walk
from twinbook.operators.frames import is_valid_frame
from twinbook.sources.tables import table


def _frames(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "book_frames")


def _plain(spark: SparkSession, sf: str) -> DataFrame:
    """Valid frames with both prices as numbers."""
    both = F.col("best_bid_price").isNotNull() & F.col("best_ask_price").isNotNull() & ~F.isnan("best_bid_price") & ~F.isnan("best_ask_price")
    return _frames(spark, sf).where(is_valid_frame() & both)


def latest_books(spark: SparkSession, sf: str) -> DataFrame:
    return B.latest_books(_frames(spark, sf))


def invalid_frames(spark: SparkSession, sf: str) -> DataFrame:
    return B.invalid_counts(_frames(spark, sf))


def frame_counts(spark: SparkSession, sf: str) -> DataFrame:
    return B.frame_counts(table(spark, sf, "book_streams"), _frames(spark, sf))


def frame_rate_1s(spark: SparkSession, sf: str) -> DataFrame:
    return B.trailing_rate(_frames(spark, sf))


def bbo_changes(spark: SparkSession, sf: str) -> DataFrame:
    return B.changes(_plain(spark, sf))


def book_mid_spread(spark: SparkSession, sf: str) -> DataFrame:
    at = B.latest_books(_frames(spark, sf))
    return at.select("market_id", F.round(B.mid("bid", "ask"), 9).alias("mid"), F.round(F.col("ask") - F.col("bid"), 9).alias("spread"))


def snapshot_ladders(spark: SparkSession, sf: str) -> DataFrame:
    at = _frames(spark, sf).where(F.col("type") == "snapshot")
    sides = [at.select("row_id", F.lit(s).alias("side"), F.posexplode(B.sorted_side(B.levels(F.col(c)), c == "asks"))) for s, c in (("ask", "asks"), ("bid", "bids"))]
    return sides[0].unionByName(sides[1]).select("row_id", "side", F.col("pos").cast("long").alias("level"), "col.price", "col.qty")


def complement_asks(spark: SparkSession, sf: str) -> DataFrame:
    at = _frames(spark, sf).where(F.col("type") == "snapshot")
    return at.select("row_id", F.explode(B.complement(B.levels(F.col("bids"), last_wins=True))).alias("x")).select("row_id", "x.price", "x.qty")


def freshest_book(spark: SparkSession, sf: str) -> DataFrame:
    f = _frames(spark, sf)
    return B.freshest(B.latest_books(f.where("feed_id % 2 = 0")), B.latest_books(f.where("feed_id % 2 = 1")))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "book_streams").select((F.col("stream_id") / 2).cast("long").alias("pair"), (F.col("stream_id") % 2).alias("side"), "market_id")


def top_of_book_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Both directions of neighbouring streams' markets: sell at the one's bid what the other asks."""
    books = B.latest_books(_frames(spark, sf)).select("market_id", "bid", "ask")
    k = _pairs(spark, sf).where("side = 0").join(books, "market_id").select("pair", F.col("bid").alias("kb"), F.col("ask").alias("ka"))
    p = _pairs(spark, sf).where("side = 1").join(books, "market_id").select("pair", F.col("bid").alias("pb"), F.col("ask").alias("pa"))
    both = k.join(p, "pair").where("kb IS NOT NULL AND ka IS NOT NULL AND pb IS NOT NULL AND pa IS NOT NULL")
    d = lambda c: F.col(c).cast("decimal(18,6)")
    return both.select("pair", F.inline(F.array(F.struct(F.lit("K").alias("buy"), (d("pb") - d("ka")).cast("double").alias("gross")), F.struct(F.lit("P").alias("buy"), (d("kb") - d("pa")).cast("double").alias("gross")))))


def best_direction(spark: SparkSession, sf: str) -> DataFrame:
    """The better direction of each pair; the first at equal gross."""
    return top_of_book_edges(spark, sf).groupBy("pair").agg(F.max(F.struct("gross", (F.col("buy") == "K").cast("int").alias("k"))).alias("b")).select(
        "pair", F.when(F.col("b.k") == 1, "K").otherwise("P").alias("buy"), "b.gross"
    )


def _ladders(spark: SparkSession, sf: str, side: str) -> DataFrame:
    ask = side == "O"
    tick = (F.lit(400) + F.round(F.col("l_discount") * 1000) + F.col("l_linenumber") * 3) if ask else (F.lit(560) - F.round(F.col("l_discount") * 1000) - F.col("l_linenumber") * 3)
    at = table(spark, sf, "lineitem").where(F.col("l_linestatus") == side)
    return at.groupBy(F.col("l_partkey").alias("pair"), tick.cast("int").alias("tick")).agg(F.sum("l_quantity").alias("qty")).select(
        "pair", (F.col("tick").cast("decimal(9,6)") / 1000).cast("decimal(9,6)").alias("price"), (F.col("qty") / 4).alias("qty")
    )


def depth_of_ladders(spark: SparkSession, sf: str) -> DataFrame:
    walked = depth_walk(_ladders(spark, sf, "O"), _ladders(spark, sf, "F"), ["pair"])
    return walked.select("pair", "size", F.col("gain").cast("double").alias("gain"), F.col("capital").cast("double").alias("capital"), "steps")


def ranked_depth(spark: SparkSession, sf: str, most: int = 20) -> DataFrame:
    return depth_of_ladders(spark, sf).orderBy(F.desc("gain"), F.desc("size"), "pair").limit(most)


def _deltas(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "snapshot").when(F.col("event_type").isNotNull(), "delta")
    value = F.col("value").cast("decimal(12,2)")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("market_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.when(F.col("event_id") % 2 == 0, "bid").otherwise("ask").alias("side"),
        (F.col("event_id") % 5).cast("int").alias("price"), F.when(kind == "snapshot", value).otherwise(F.when(F.col("event_id") % 3 == 0, -value).otherwise(value)).alias("qty"),
    )


def book_delta_fold(spark: SparkSession, sf: str) -> DataFrame:
    return B.fold_deltas(_deltas(spark, sf)).withColumn("qty", F.col("qty").cast("double"))


def _updates(spark: SparkSession, sf: str) -> DataFrame:
    return G.updates(_plain(spark, sf))


def median_gap(spark: SparkSession, sf: str) -> DataFrame:
    return G.rolling_median_gap(_updates(spark, sf)).select("market_id", "us", F.round("median_gap", 7).alias("median_gap"))


def staleness(spark: SparkSession, sf: str) -> DataFrame:
    at = G.rolling_median_gap(_updates(spark, sf))
    return at.where("gap IS NOT NULL").select("market_id", "us", F.round("gap", 6).alias("gap"), F.round(G.patience(F.col("was")), 6).alias("patience"), (F.col("gap") > G.patience(F.col("was"))).alias("stale"))


def asof_mid(spark: SparkSession, sf: str) -> DataFrame:
    moments = table(spark, sf, "book_streams").select("market_id", F.explode(F.array("started_at", "ended_at")).alias("t")).select("market_id", F.unix_micros("t").alias("us"))
    return G.as_of(moments, _updates(spark, sf)).select("market_id", "us", F.round("mid", 9).alias("mid"))


def persistence_islands(spark: SparkSession, sf: str) -> DataFrame:
    ticks = _plain(spark, sf).select(
        "stream_id", F.unix_micros("received_at").alias("us"), "row_id", (F.round(F.col("best_ask_price") - F.col("best_bid_price"), 6) <= 0.01).alias("present"), F.col("best_bid_price").alias("version")
    )
    runs = G.persistence(ticks, ["stream_id"], ["us", "row_id"])
    return runs.select("stream_id", F.col("first.us").alias("first_us"), F.col("last.us").alias("last_us"), "ticks", "observations", F.col("confirmed.us").alias("confirmed_us"))


def stream_union(spark: SparkSession, sf: str) -> DataFrame:
    streams = table(spark, sf, "book_streams").select("stream_id", "exchange_name")
    of = lambda venue: _frames(spark, sf).join(streams.where(F.col("exchange_name") == venue), "stream_id").select("row_id", "exchange_name", "type")
    return of("KALSHI").unionByName(of("POLYMARKET")).groupBy("exchange_name", "type").agg(F.count("*").alias("frames"))


QUERIES = {
    f.__name__: f
    for f in (
        latest_books, invalid_frames, frame_counts, frame_rate_1s, bbo_changes, book_mid_spread, snapshot_ladders, complement_asks, freshest_book,
        top_of_book_edges, best_direction, depth_of_ladders, ranked_depth, book_delta_fold, median_gap, staleness, asof_mid, persistence_islands, stream_union,
    )
}

_VALID = "type IN ('snapshot', 'update') AND coalesce(is_valid, true)"
_PLAIN = f"{_VALID} AND best_bid_price IS NOT NULL AND best_ask_price IS NOT NULL AND NOT isnan(best_bid_price) AND NOT isnan(best_ask_price)"
_CROSSED = "coalesce(best_bid_price >= best_ask_price, false)"
_BOOKS = """SELECT market_id, best_bid_price AS bid, best_ask_price AS ask, exchange_timestamp, epoch_us(received_at) AS received_us FROM book_frames
    WHERE {0} AND NOT {1} {2} QUALIFY row_number() OVER (PARTITION BY market_id ORDER BY received_at DESC, row_id DESC) = 1"""
_LATEST = _BOOKS.format(_VALID, _CROSSED, "")
_EDGES = f"""b AS ({_LATEST}), s AS (SELECT stream_id // 2 AS pair, stream_id % 2 AS side, market_id FROM book_streams),
    j AS (SELECT k.pair, CAST(kb.bid AS DECIMAL(18,6)) AS kb, CAST(kb.ask AS DECIMAL(18,6)) AS ka, CAST(pb.bid AS DECIMAL(18,6)) AS pb, CAST(pb.ask AS DECIMAL(18,6)) AS pa
          FROM s k JOIN s p ON k.pair = p.pair AND k.side = 0 AND p.side = 1 JOIN b kb ON kb.market_id = k.market_id JOIN b pb ON pb.market_id = p.market_id
          WHERE kb.bid IS NOT NULL AND kb.ask IS NOT NULL AND pb.bid IS NOT NULL AND pb.ask IS NOT NULL),
    e AS (SELECT pair, 'K' AS buy, CAST(pb - ka AS DOUBLE) AS gross FROM j UNION ALL SELECT pair, 'P', CAST(kb - pa AS DOUBLE) FROM j)"""
_WALK = """l AS (SELECT l_partkey AS pair, l_linestatus AS s, CAST(CASE WHEN l_linestatus = 'O' THEN 400 + round(l_discount * 1000) + l_linenumber * 3 ELSE 560 - round(l_discount * 1000) - l_linenumber * 3 END AS INTEGER) AS tick, sum(l_quantity) / 4 AS qty
        FROM lineitem WHERE l_linestatus IN ('O', 'F') GROUP BY ALL),
    u AS (SELECT pair, s, CAST(tick AS DECIMAL(9,6)) / 1000 AS price0, tick, CAST(floor(qty) AS BIGINT) AS units FROM l WHERE floor(qty) > 0),
    c AS (SELECT pair, s, tick, units, sum(units) OVER (PARTITION BY pair, s ORDER BY CASE WHEN s = 'O' THEN tick ELSE -tick END ROWS UNBOUNDED PRECEDING) AS hi FROM u),
    x AS (SELECT a.pair, a.tick AS ask, b.tick AS bid, greatest(a.hi - a.units, b.hi - b.units) AS lo, least(a.hi, b.hi) - greatest(a.hi - a.units, b.hi - b.units) AS units
          FROM c a JOIN c b ON a.pair = b.pair AND a.s = 'O' AND b.s = 'F' AND a.hi - a.units < b.hi AND b.hi - b.units < a.hi),
    y AS (SELECT *, min(bid - ask) OVER (PARTITION BY pair ORDER BY lo ROWS UNBOUNDED PRECEDING) AS least FROM x),
    d AS (SELECT pair, CAST(sum(units) AS BIGINT) AS size, CAST(CAST(sum((bid - ask) * units) AS DECIMAL(30,6)) / 1000 AS DOUBLE) AS gain, CAST(CAST(sum((ask + 1000 - bid) * units) AS DECIMAL(30,6)) / 1000 AS DOUBLE) AS capital, count(*) AS steps FROM y WHERE least > 0 GROUP BY pair)"""
_UPDATES = f"""u0 AS (SELECT market_id, epoch_us(received_at) AS us, arg_max((best_bid_price + best_ask_price) / 2, row_id) AS mid FROM book_frames WHERE {_PLAIN} GROUP BY ALL),
    u AS (SELECT *, (us - lag(us) OVER (PARTITION BY market_id ORDER BY us)) / 1e6 AS gap FROM u0),
    g AS (SELECT *, CASE WHEN count(gap) OVER w >= 5 THEN median(gap) OVER w END AS median_gap FROM u WINDOW w AS (PARTITION BY market_id ORDER BY us ROWS 127 PRECEDING))"""
_PATIENCE = "CASE WHEN was IS NULL THEN 10.0 ELSE least(greatest(was * 4, 3.0), 30.0) END"
SQL = {
    "latest_books": _LATEST,
    "invalid_frames": f"SELECT market_id, count(*) AS invalid, epoch_us(max(received_at)) AS last_us FROM book_frames WHERE type IN ('snapshot', 'update') AND (NOT coalesce(is_valid, true) OR {_CROSSED}) GROUP BY 1",
    "frame_counts": "SELECT s.stream_id, count(f.row_id) AS frames FROM (SELECT DISTINCT stream_id FROM book_streams) s LEFT JOIN book_frames f USING (stream_id) GROUP BY 1",
    "frame_rate_1s": "SELECT row_id, market_id, count(*) OVER (PARTITION BY market_id ORDER BY epoch_us(received_at) RANGE BETWEEN 1000000 PRECEDING AND CURRENT ROW) AS frames FROM book_frames WHERE received_at IS NOT NULL",
    "bbo_changes": f"""WITH x AS (SELECT row_id, market_id, best_bid_price, best_ask_price, row_number() OVER w AS i, lag(best_bid_price) OVER w AS b, lag(best_ask_price) OVER w AS a FROM book_frames WHERE {_PLAIN}
        WINDOW w AS (PARTITION BY market_id ORDER BY received_at, row_id)) SELECT row_id, market_id, best_bid_price, best_ask_price FROM x WHERE i = 1 OR b <> best_bid_price OR a <> best_ask_price""",
    "book_mid_spread": f"WITH b AS ({_LATEST}) SELECT market_id, round(coalesce((bid + ask) / 2, bid, ask), 9) AS mid, round(ask - bid, 9) AS spread FROM b",
    "snapshot_ladders": """WITH a AS (SELECT row_id, 'ask' AS side, unnest(asks) AS x, generate_subscripts(asks, 1) AS i FROM book_frames WHERE type = 'snapshot' UNION ALL
        SELECT row_id, 'bid', unnest(bids), generate_subscripts(bids, 1) FROM book_frames WHERE type = 'snapshot')
        SELECT row_id, side, row_number() OVER (PARTITION BY row_id, side ORDER BY CASE WHEN side = 'ask' THEN x.price ELSE -x.price END, i) - 1 AS level, x.price AS price, x.qty AS qty FROM a WHERE x.price IS NOT NULL AND x.qty > 0""",
    "complement_asks": """WITH a AS (SELECT row_id, unnest(bids) AS x, generate_subscripts(bids, 1) AS i FROM book_frames WHERE type = 'snapshot')
        SELECT row_id, 1.0::DOUBLE - x.price AS price, x.qty AS qty FROM a WHERE x.price IS NOT NULL AND x.qty > 0 QUALIFY row_number() OVER (PARTITION BY row_id, x.price ORDER BY i DESC) = 1""",
    "freshest_book": f"""WITH u AS (SELECT *, 1 AS f FROM ({_BOOKS.format(_VALID, _CROSSED, "AND feed_id % 2 = 0")}) UNION ALL SELECT *, 0 FROM ({_BOOKS.format(_VALID, _CROSSED, "AND feed_id % 2 = 1")}))
        SELECT * EXCLUDE (f) FROM u QUALIFY row_number() OVER (PARTITION BY market_id ORDER BY received_us DESC, f DESC) = 1""",
    "top_of_book_edges": f"WITH {_EDGES} SELECT * FROM e",
    "best_direction": f"WITH {_EDGES} SELECT pair, buy, gross FROM e QUALIFY row_number() OVER (PARTITION BY pair ORDER BY gross DESC, buy) = 1",
    "depth_of_ladders": f"WITH {_WALK} SELECT * FROM d",
    "ranked_depth": f"WITH {_WALK} SELECT * FROM d ORDER BY gain DESC, size DESC, pair LIMIT 20",
    "book_delta_fold": """WITH f AS (SELECT user_id AS market_id, event_id AS seq, CASE WHEN event_type = 'signup' THEN 'snapshot' WHEN event_type IS NOT NULL THEN 'delta' END AS kind, CASE WHEN event_id % 2 = 0 THEN 'bid' ELSE 'ask' END AS side,
            CAST(event_id % 5 AS INTEGER) AS price, CASE WHEN event_type <> 'signup' AND event_id % 3 = 0 THEN -CAST(value AS DECIMAL(12,2)) ELSE CAST(value AS DECIMAL(12,2)) END AS qty FROM events),
        e AS (SELECT *, max(CASE WHEN kind = 'snapshot' THEN seq END) OVER (PARTITION BY market_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS epoch FROM f),
        c AS (SELECT *, sum(qty) OVER (PARTITION BY market_id, epoch, side, price ORDER BY seq ROWS UNBOUNDED PRECEDING) AS c FROM e WHERE epoch IS NOT NULL AND qty IS NOT NULL)
        SELECT market_id, side, price, seq, CAST(c - least(min(c) OVER (PARTITION BY market_id, epoch, side, price ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) AS DOUBLE) AS qty FROM c""",
    "median_gap": f"WITH {_UPDATES} SELECT market_id, us, round(median_gap, 7) AS median_gap FROM g",
    "staleness": f"""WITH {_UPDATES}, h AS (SELECT *, lag(median_gap) OVER (PARTITION BY market_id ORDER BY us) AS was FROM g)
        SELECT market_id, us, round(gap, 6) AS gap, round({_PATIENCE}, 6) AS patience, gap > {_PATIENCE} AS stale FROM h WHERE gap IS NOT NULL""",
    "asof_mid": f"""WITH {_UPDATES}, m AS (SELECT market_id, epoch_us(unnest([started_at, ended_at])) AS us FROM book_streams), f AS (SELECT market_id, arg_min(mid, us) AS first FROM u GROUP BY 1)
        SELECT m.market_id, m.us, round(coalesce(u.mid, f.first), 9) AS mid FROM m ASOF LEFT JOIN u ON m.market_id = u.market_id AND m.us >= u.us LEFT JOIN f ON f.market_id = m.market_id""",
    "persistence_islands": f"""WITH t AS (SELECT stream_id, epoch_us(received_at) AS us, row_id, round(best_ask_price - best_bid_price, 6) <= 0.01 AS p, best_bid_price AS v FROM book_frames WHERE {_PLAIN}),
        r AS (SELECT *, sum(CASE WHEN p THEN 0 ELSE 1 END) OVER (PARTITION BY stream_id ORDER BY us, row_id ROWS UNBOUNDED PRECEDING) AS run FROM t),
        c AS (SELECT *, row_number() OVER w = 1 OR v <> lag(v) OVER w AS counted FROM r WHERE p WINDOW w AS (PARTITION BY stream_id, run ORDER BY us, row_id)),
        o AS (SELECT *, sum(counted::INT) OVER (PARTITION BY stream_id, run ORDER BY us, row_id ROWS UNBOUNDED PRECEDING) AS seen FROM c)
        SELECT stream_id, min(us) AS first_us, max(us) FILTER (WHERE counted) AS last_us, count(*) AS ticks, CAST(max(seen) AS BIGINT) AS observations, min(us) FILTER (WHERE seen >= 3) AS confirmed_us FROM o GROUP BY stream_id, run""",
    "stream_union": "SELECT s.exchange_name, f.type, count(*) AS frames FROM book_frames f JOIN book_streams s USING (stream_id) GROUP BY ALL",
}
