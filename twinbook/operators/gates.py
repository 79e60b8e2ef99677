"""Cadence, staleness and persistence of quotes as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinbook.operators.books import mid
from twinbook.operators.ranged import HALO, PART, ranged, with_halo


def updates(frames: DataFrame) -> DataFrame:
    """One row per market and arrival time, strictly newer than the one before, with the ``gap`` in seconds and the mid price."""
    at = frames.where(F.col("received_at").isNotNull()).groupBy("market_id", F.unix_micros("received_at").alias("us")).agg(
        F.max(F.struct(F.col("row_id"), mid().alias("mid"))).alias("last")
    )
    rows = with_halo(ranged(at.select("market_id", "us", F.col("last.mid").alias("mid")), "market_id", "us"), "market_id", ["us"], 1)
    before = Window.partitionBy("market_id", PART).orderBy("us")
    return rows.withColumn("gap", (F.col("us") - F.lag("us").over(before)) / 1e6).where(~F.col(HALO)).select("market_id", "us", "mid", "gap")


def rolling_median_gap(updated: DataFrame, remembered: int = 128, least: int = 5) -> DataFrame:
    """Adds ``median_gap``, the median of the last ``remembered`` gaps, null below ``least`` of them, and ``was``, the one before."""
    rows = with_halo(ranged(updated, "market_id", "us"), "market_id", ["us"], remembered + 1)
    in_range = Window.partitionBy("market_id", PART).orderBy("us")
    back = in_range.rowsBetween(-(remembered - 1), 0)
    at = rows.withColumn("median_gap", F.when(F.count("gap").over(back) >= least, F.percentile("gap", 0.5).over(back)))
    return at.withColumn("was", F.lag("median_gap").over(in_range)).where(~F.col(HALO)).select(*updated.columns, "median_gap", "was")


def patience(median_gap: Column, factor: float = 4.0, least: float = 3.0, most: float = 30.0, unknown: float = 10.0) -> Column:
    """Seconds of silence that are still usual."""
    return F.when(median_gap.isNull(), unknown).otherwise(F.least(F.greatest(median_gap * factor, F.lit(least)), F.lit(most)))


def as_of(moments: DataFrame, prices: DataFrame, value: str = "mid") -> DataFrame:
    """Adds to moments (``market_id``, ``us``) the last ``value`` at or before them, else the market's first one.

    One union and a running window in ranges of a market's time, into which the last price before them is carried; the price wins at
    equal times. Moments of markets without any price have null.
    """
    p = prices.where(F.col(value).isNotNull()).select("market_id", "us", F.lit(0).alias("k"), F.col(value).alias("v"))
    m = moments.select("market_id", "us", F.lit(1).alias("k"), F.lit(None).cast("double").alias("v"))
    run = Window.partitionBy("market_id", PART).orderBy("us", "k").rowsBetween(Window.unboundedPreceding, 0)
    first = prices.where(F.col(value).isNotNull()).groupBy("market_id").agg(F.min_by(value, "us").alias("first"))
    rows = with_halo(ranged(p.unionByName(m), "market_id", "us", "k"), "market_id", ["us", "k"], 1, F.col("k") == 0)
    seen = rows.withColumn("seen", F.last("v", True).over(run)).where("k = 1")
    return seen.join(first, "market_id", "left").select("market_id", "us", F.coalesce("seen", "first").alias(value))


def persistence(ticks: DataFrame, key: list[str], order: list[str], least: int | None = 3, least_us: int | None = None) -> DataFrame:
    """Runs of ticks that are present: one row per run with its ticks, counted versions, and the tick that confirmed it.

    ``ticks``: key, order, ``present``, ``version``. A tick counts if it is the run's first, its version is null, or differs
    from the tick before. Null presence is absence. A run is confirmed by its first counted tick that is the ``least``-th or
    is ``least_us`` after the run's start by the first column of ``order`` (microseconds); one of the two must be given.
    """
    if least is None and least_us is None:
        raise ValueError("least or least_us must be given")
    if least is not None and least < 1:
        raise ValueError("least must be at least 1")
    w = Window.partitionBy(*key).orderBy(*order)
    present = F.coalesce(F.col("present"), F.lit(False))
    at = ticks.select("*", present.alias("p")).select(
        "*", F.sum((~F.col("p")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run")
    )
    inside = Window.partitionBy(*key, "run").orderBy(*order)
    at = at.where("p").select(
        "*", (F.row_number().over(inside) == 1).alias("starts"), F.lag("version").over(inside).alias("was")
    )
    counted = F.col("starts") | F.col("version").isNull() | ~F.col("version").eqNullSafe(F.col("was"))
    at = at.withColumn("counted", counted).withColumn("seen", F.sum(F.col("counted").cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    o = F.struct(*order)
    enough = F.lit(False) if least is None else F.col("seen") >= least
    if least_us is not None:
        at = at.withColumn("lasted", F.col(order[0]) - F.min(order[0]).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        enough = enough | (F.col("counted") & (F.col("lasted") >= least_us))
    return at.groupBy(*key, "run").agg(
        F.min(o).alias("first"), F.max(F.when(F.col("counted"), o)).alias("last"), F.count("*").alias("ticks"), F.max("seen").alias("observations"),
        F.min(F.when(enough, o)).alias("confirmed"),
    )
