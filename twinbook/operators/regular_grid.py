"""Problem 4: irregular readings on a regular grid of minutes.

Readings are reduced to the first and last of each (source, minute) with partial aggregation, merged as-of with the grid
(an equi-join on source and minute, then running last values from both sides), and interpolated linearly in time between
the neighbours of each grid instant where these are no further apart than the gap limit. A source's window holds minutes,
not readings, so that a hot source is no larger a task than its calendar; both passes only run forward.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def minute_grid(streams: DataFrame, source: str = "stream_id") -> DataFrame:
    """One row per source and full UTC minute of its window; a source listed twice has the minutes of either window once."""
    start, end = F.unix_micros("started_at"), F.unix_micros("ended_at")
    first = F.ceil(start / 60_000_000).cast("long")
    last = F.floor(end / 60_000_000).cast("long") - 1
    spans = streams.where(F.col(source).isNotNull() & (last >= first)).select(F.col(source), F.explode(F.sequence(first, last)).alias("m"))
    return spans.select(source, (F.col("m") * 60).alias("minute_s")).distinct()


def regular_grid(
    streams: DataFrame, readings: DataFrame, source: str = "stream_id", prices: tuple[str, ...] = ("best_bid_price", "best_ask_price"),
    gap_limit_s: int = 300,
) -> DataFrame:
    """Columns: source, ``minute_s``, ``n_readings``, per price ``<price>`` at the minute's start, ``status``.

    ``status`` is ``observed`` (a reading within the minute), ``filled`` (none, interpolated between neighbours at most
    ``gap_limit_s`` apart) or ``gap`` (none, and no such neighbours; its prices are null). Only readings whose prices are
    all numbers count; those outside the window serve as neighbours. Prices of observed minutes without both neighbours are
    the first reading's. Readings of sources without a window, null sources and null arrival times are left out; equal
    arrival times are settled by ``row_id``. Repeated readings count. Empty streams give an empty grid; empty readings, gaps.
    """
    ok = F.col("received_at").isNotNull() & F.col(source).isNotNull()
    for p in prices:
        ok = ok & F.col(p).isNotNull() & ~F.isnan(p)
    t = F.unix_micros("received_at")
    minute = F.call_function("div", t - F.pmod(t, F.lit(60_000_000)), F.lit(1_000_000))
    reading = F.struct(t.alias("t"), F.col("row_id").alias("i"), *[F.col(p).alias(f"p{i}") for i, p in enumerate(prices)])
    by_minute = readings.where(ok).groupBy(F.col(source), minute.alias("minute_s")).agg(
        F.count("*").alias("n"), F.min(reading).alias("first"), F.max(reading).alias("last")
    )
    grid = minute_grid(streams, source).withColumn("__in", F.lit(True))
    merged = grid.join(by_minute, [source, "minute_s"], "full")
    before = Window.partitionBy(source).orderBy("minute_s").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(source).orderBy(F.col("minute_s").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = merged.select("*", F.last("last", True).over(before).alias("b")).select("*", F.last("first", True).over(after).alias("a"))
    at = near.where("__in").withColumn("__us", F.col("minute_s") * 1_000_000)
    close = F.coalesce(F.col("a.t") - F.col("b.t") <= gap_limit_s * 1_000_000, F.lit(False))
    weight = F.coalesce(F.try_divide((F.col("__us") - F.col("b.t")).cast("double"), (F.col("a.t") - F.col("b.t")).cast("double")), F.lit(0.0))
    seen = F.coalesce(F.col("n"), F.lit(0)).cast("long")

    def value(i: int) -> Column:
        mixed = F.col(f"b.p{i}") + (F.col(f"a.p{i}") - F.col(f"b.p{i}")) * weight
        return F.when(close, mixed).when(seen > 0, F.col(f"first.p{i}"))

    status = F.when(seen > 0, "observed").when(close, "filled").otherwise("gap")
    return at.select(source, "minute_s", seen.alias("n_readings"), *[value(i).alias(p) for i, p in enumerate(prices)], status.alias("status"))
