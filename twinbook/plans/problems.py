"""Queries of the general problems (1, 2, 4, 5) over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinbook.functions.timestamps import PLAIN
from twinbook.operators.frames import is_valid_frame
from twinbook.operators.instants import rewritten, with_instant
from twinbook.operators.late_minutes import LateMinutes, first_deliveries, late_minutes
from twinbook.operators.regular_grid import regular_grid
from twinbook.operators.spikes import implausible_rows, reading_scores
from twinbook.plans.instant_sql import instants
from twinbook.sources.tables import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    feeds = table(spark, sf, "feeds")
    parts = []
    for name, text, near in (("k_markets", "expiration_datetime", None), ("p_markets", "expiration_datetime", None), ("book_frames", "exchange_timestamp", F.col("received_at"))):
        found = rewritten(with_instant(table(spark, sf, name), text, feeds, near=near), text)
        parts.append(found.select(F.lit(name).alias("src"), "row_id", "utc_us"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def counting_frames(spark: SparkSession, sf: str) -> DataFrame:
    """First deliveries that are valid frames, with their instant as ``event_us``."""
    columns = ("row_id", "feed_id", "received_at", "exchange_timestamp", "best_bid_price", "best_ask_price", "type", "is_valid")
    first = first_deliveries(table(spark, sf, "book_frames"), columns=columns).where(is_valid_frame())
    return with_instant(first, "exchange_timestamp", table(spark, sf, "feeds"), out="event_us", near=F.col("received_at"))


def _minutes(spark: SparkSession, sf: str) -> LateMinutes:
    return late_minutes(counting_frames(spark, sf))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _minutes(spark, sf).upserts.where("is_correction").select("market_id", "minute_s").distinct()


def p2_minutes(spark: SparkSession, sf: str) -> DataFrame:
    return _minutes(spark, sf).final.drop("is_correction", "emitted_at")


def p2_dropped(spark: SparkSession, sf: str) -> DataFrame:
    return _minutes(spark, sf).dropped.select("row_id", "market_id", "minute_s", "late_s")


def p4_grid(spark: SparkSession, sf: str) -> DataFrame:
    readings = table(spark, sf, "book_frames").where(is_valid_frame())
    return regular_grid(table(spark, sf, "book_streams"), readings)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_grid(spark, sf).where("status <> 'observed'").select("stream_id", "minute_s")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return implausible_rows(table(spark, sf, "book_frames").where(is_valid_frame()))


def p5_scores(spark: SparkSession, sf: str) -> DataFrame:
    return reading_scores(table(spark, sf, "book_frames").where(is_valid_frame()))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_minutes": p2_minutes, "p2_dropped": p2_dropped, "p4_found": p4_found, "p4_grid": p4_grid, "p5_found": p5_found, "p5_scores": p5_scores}

_VALID = "type IN ('snapshot', 'update') AND coalesce(is_valid, true)"
_TABLES = (("k_markets", "expiration_datetime", None), ("p_markets", "expiration_datetime", None), ("book_frames", "exchange_timestamp", "received_at"))
_READ = ",".join(instants(f"i_{n}", n, f"b.{t}", f"b.row_id, b.{t}" + (f", b.{near}" if near else ""), near) for n, t, near in _TABLES)
_COUNTING = f"""fr AS (SELECT * FROM book_frames QUALIFY row_number() OVER (PARTITION BY market_id, seq, CASE WHEN seq IS NULL THEN row_id END ORDER BY received_at NULLS LAST, row_id) = 1),
  va AS (SELECT * FROM fr WHERE {_VALID}),
  {instants("ev", "va", "b.exchange_timestamp", "b.row_id, b.market_id, b.seq, b.received_at, b.best_bid_price, b.best_ask_price", "received_at")},
  mi AS (SELECT * EXCLUDE (best_bid_price, best_ask_price), CASE WHEN NOT isnan(best_bid_price) THEN best_bid_price END AS bid, CASE WHEN NOT isnan(best_ask_price) THEN best_ask_price END AS ask,
         (utc_us - ((utc_us % 60000000) + 60000000) % 60000000) // 1000000 AS minute_s FROM ev WHERE received_at IS NOT NULL),
  la AS (SELECT *, epoch_us(received_at) - (minute_s + 60) * 1000000 AS late FROM mi)"""
_NEAR = lambda op: f"SELECT stream_id, t, {op}(i) AS i, arg_{op}(bid, i) AS bid, arg_{op}(ask, i) AS ask FROM r GROUP BY 1, 2"
SQL = {
    "p1_found": f"WITH {_READ} " + " UNION ALL ".join(f"SELECT '{n}' AS src, row_id, utc_us FROM i_{n} WHERE NOT regexp_matches({t}, '{PLAIN}')" for n, t, _ in _TABLES),
    "p2_found": f"WITH {_COUNTING} SELECT DISTINCT market_id, minute_s FROM la WHERE late BETWEEN 10000000 AND 300000000",
    "p2_minutes": f"""WITH {_COUNTING} SELECT market_id, minute_s, count(DISTINCT CASE WHEN late < 10000000 THEN -1 ELSE (late - 10000000) // 10000000 END) AS version, count(*) AS frame_count,
        arg_max(bid, (utc_us, seq, bid)) AS last_bid, arg_max(ask, (utc_us, seq, ask)) AS last_ask, min(bid) AS low_bid, max(bid) AS high_bid, min(ask) AS low_ask, max(ask) AS high_ask FROM la WHERE late <= 300000000 GROUP BY 1, 2""",
    "p2_dropped": f"WITH {_COUNTING} SELECT row_id, market_id, minute_s, late / 1e6 AS late_s FROM la WHERE late > 300000000",
    "p4_found": f"""
        WITH g AS (SELECT DISTINCT stream_id, unnest(generate_series(CAST(ceil(epoch_us(started_at) / 60e6) AS BIGINT), CAST(floor(epoch_us(ended_at) / 60e6) AS BIGINT) - 1)) * 60 AS minute_s FROM book_streams),
        r AS (SELECT DISTINCT stream_id, epoch_us(received_at) // 60000000 * 60 AS minute_s FROM book_frames
              WHERE {_VALID} AND best_bid_price IS NOT NULL AND best_ask_price IS NOT NULL AND NOT isnan(best_bid_price) AND NOT isnan(best_ask_price))
        SELECT g.stream_id, g.minute_s FROM g ANTI JOIN r ON g.stream_id = r.stream_id AND g.minute_s = r.minute_s""",
    "p4_grid": f"""
        WITH g AS (SELECT DISTINCT stream_id, unnest(generate_series(CAST(ceil(epoch_us(started_at) / 60e6) AS BIGINT), CAST(floor(epoch_us(ended_at) / 60e6) AS BIGINT) - 1)) * 60 AS minute_s FROM book_streams),
        r AS (SELECT stream_id, epoch_us(received_at) AS t, row_id AS i, best_bid_price AS bid, best_ask_price AS ask FROM book_frames
              WHERE {_VALID} AND received_at IS NOT NULL AND best_bid_price IS NOT NULL AND best_ask_price IS NOT NULL AND NOT isnan(best_bid_price) AND NOT isnan(best_ask_price)),
        ea AS ({_NEAR("min")}), la AS ({_NEAR("max")}),
        m AS (SELECT stream_id, t // 60000000 * 60 AS minute_s, count(*) AS n, arg_min(bid, (t, i)) AS bid, arg_min(ask, (t, i)) AS ask FROM r GROUP BY 1, 2),
        x AS (SELECT g.*, minute_s * 1000000 AS us FROM g),
        b AS (SELECT x.*, la.t AS bt, la.bid AS bb, la.ask AS ba FROM x ASOF LEFT JOIN la ON x.stream_id = la.stream_id AND x.us > la.t),
        a AS (SELECT b.*, ea.t AS at_, ea.bid AS ab, ea.ask AS aa FROM b ASOF LEFT JOIN ea ON b.stream_id = ea.stream_id AND b.us <= ea.t),
        c AS (SELECT a.*, coalesce(m.n, 0) AS n, m.bid AS fb, m.ask AS fa, coalesce(at_ - bt <= 300000000, false) AS near, coalesce((us - bt)::DOUBLE / (at_ - bt)::DOUBLE, 0) AS w FROM a LEFT JOIN m USING (stream_id, minute_s))
        SELECT stream_id, minute_s, n AS n_readings, CASE WHEN near THEN bb + (ab - bb) * w WHEN n > 0 THEN fb END AS best_bid_price, CASE WHEN near THEN ba + (aa - ba) * w WHEN n > 0 THEN fa END AS best_ask_price,
               CASE WHEN n > 0 THEN 'observed' WHEN near THEN 'filled' ELSE 'gap' END AS status FROM c""",
}
