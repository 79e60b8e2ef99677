"""Depth: two price ladders walked against each other as an overlap join of cumulative quantities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _plain_margin(ask: Column, bid: Column) -> Column:
    return bid - ask


def cumulative(ladder: DataFrame, key: list[str], ask: bool) -> DataFrame:
    """Half-open intervals ``[lo, hi)`` of whole units by level in order of price; levels without a whole unit are left out."""
    whole = ladder.where(F.col("price").isNotNull() & (F.col("qty") > 0)).withColumn("units", F.floor("qty").cast("long"))
    price = F.col("price").asc() if ask else F.col("price").desc()
    run = Window.partitionBy(*key).orderBy(price, "qty").rowsBetween(Window.unboundedPreceding, 0)
    at = whole.where(F.col("units") > 0).withColumn("hi", F.sum("units").over(run))
    return at.select(*key, "price", (F.col("hi") - F.col("units")).alias("lo"), "hi")


def depth_walk(asks: DataFrame, bids: DataFrame, key: list[str], margin: Callable[[Column, Column], Column] = _plain_margin) -> DataFrame:
    """Size, total margin, capital and steps of each key, walking both ladders from the best price to the first margin that isn't positive.

    ``asks`` and ``bids``: key, ``price``, ``qty``. A ladder is one market's book, so that an overlap join within a key meets at
    most as many cells as both ladders have levels. Null prices, and quantities below one unit, are left out; a key with one
    empty ladder has no row. ``margin`` gives the gain of one unit at an ask and a bid.
    """
    a = cumulative(asks, key, True).toDF(*key, "ask", "alo", "ahi")
    b = cumulative(bids, key, False).toDF(*key, "bid", "blo", "bhi")
    cells = a.join(b, key).where((F.col("alo") < F.col("bhi")) & (F.col("blo") < F.col("ahi")))
    lo, hi = F.greatest("alo", "blo"), F.least("ahi", "bhi")
    cells = cells.select(*key, "ask", "bid", lo.alias("lo"), (hi - lo).alias("units"), margin(F.col("ask"), F.col("bid")).alias("margin"))
    run = Window.partitionBy(*key).orderBy("lo").rowsBetween(Window.unboundedPreceding, 0)
    taken = cells.withColumn("least", F.min("margin").over(run)).where(F.col("least") > 0)
    return taken.groupBy(*key).agg(
        F.sum("units").alias("size"), F.sum(F.col("margin") * F.col("units")).alias("gain"),
        F.sum((F.col("ask") + 1 - F.col("bid")) * F.col("units")).alias("capital"), F.count("*").alias("steps"),
    )
