"""Problem 1: texts of mixed forms and zones as UTC instants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinbook.functions.timestamps import PLAIN, known_zones, steps


def feed_rules(feeds: DataFrame) -> DataFrame:
    """One row per ``feed_id`` with its zone and date order; a feed listed twice counts once (smallest values)."""
    rules = feeds.where(F.col("feed_id").isNotNull()).groupBy(F.col("feed_id").alias("__feed"))
    return rules.agg(F.min("zone_name").alias("__feed_zone"), F.min("date_order").alias("__feed_order"))


def with_instant(df: DataFrame, text: str, feeds: DataFrame, out: str = "utc_us", near: Column | None = None) -> DataFrame:
    """``df`` and column ``out`` (bigint): microseconds since 1970 UTC named by ``text``.

    Texts without an offset are wall time in the zone of the row's ``feed_id``; all-numeric dates follow its order. Digits
    finer than a microsecond are cut off. ``near`` (a timestamp) settles wall times that occur twice, else the earlier is
    taken. Null: null, blank and meaningless texts, dates and times outside the calendar, unknown zones, and wall times of
    rows whose feed is null or unknown. Row count, order of columns and repeated rows stay; an existing ``out`` is
    replaced; other columns may have any name but those beginning with ``__feed`` or ``__ts``. An empty table stays empty.
    """
    at = df.join(feed_rules(feeds), F.col("feed_id") == F.col("__feed"), "left")
    given = [F.col(f"`{c}`") for c in df.columns]
    near_us = None if near is None else F.unix_micros(near)
    found = steps(F.col(f"`{text}`"), F.col("__feed_order"), known_zones(df.sparkSession), F.col("__feed_zone"), near_us)
    for step in found:  # inline() keeps the optimiser from copying one step's expressions into each of their uses
        at = at.select("*", F.inline(F.array(F.struct(*[v.alias(f"__ts_{k}") for k, v in step.items()]))))
    return at.select(*[F.col(f"`{c}`") for c in df.columns if c != out], F.col("__ts_utc").alias(out))


def rewritten(df: DataFrame, text: str, out: str = "utc_us") -> DataFrame:
    """Rows whose text gave an instant without being of the plain form already."""
    return df.where(F.col(out).isNotNull() & ~F.col(f"`{text}`").rlike(PLAIN))
