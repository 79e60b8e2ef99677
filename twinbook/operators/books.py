"""Order books from frames: ladders, validity, last valid book, change suppression, counts, and the fold of deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinbook.operators.frames import is_valid_frame
from twinbook.operators.ranged import HALO, PART, ranged, with_halo


def levels(side: Column, last_wins: bool = False) -> Column:
    """Levels with a price and a positive quantity; with ``last_wins`` one per price, the last given."""
    kept = F.filter(side, lambda x: x["price"].isNotNull() & (x["qty"] > 0))
    if not last_wins:
        return kept
    prices = F.transform(kept, lambda x: x["price"])
    return F.filter(kept, lambda x, i: ~F.array_contains(F.slice(prices, i + 2, F.size(prices)), x["price"]))


def complement(side: Column) -> Column:
    """Levels of the opposite outcome as asks: one minus the price, in binary arithmetic, ascending."""
    return F.array_sort(F.transform(side, lambda x: F.struct((F.lit(1.0) - x["price"]).alias("price"), x["qty"].alias("qty"))))


def sorted_side(side: Column, ask: bool) -> Column:
    """Levels by price, asks ascending and bids descending; equal prices in the order given."""
    placed = F.transform(side, lambda x, i: F.struct((x["price"] if ask else -x["price"]).alias("k"), i.alias("i"), x.alias("v")))
    return F.transform(F.array_sort(placed), lambda x: x["v"])


def crossed() -> Column:
    """A bid at or above the ask; false where a side is missing."""
    return F.coalesce(F.col("best_bid_price") >= F.col("best_ask_price"), F.lit(False))


def mid(bid: str = "best_bid_price", ask: str = "best_ask_price") -> Column:
    """Mean of both prices, else the one that is there."""
    return F.coalesce((F.col(bid) + F.col(ask)) / 2, F.col(bid), F.col(ask))


def latest_books(frames: DataFrame) -> DataFrame:
    """The last frame received of each market that is valid and not crossed (ties: larger ``row_id``)."""
    kept = frames.where(is_valid_frame() & ~crossed())
    order = F.struct("received_at", "row_id")
    book = F.max(F.struct(order.alias("o"), F.col("best_bid_price").alias("bid"), F.col("best_ask_price").alias("ask"), F.col("exchange_timestamp").alias("ts")))
    return kept.groupBy("market_id").agg(book.alias("b")).select("market_id", "b.bid", "b.ask", F.col("b.ts").alias("exchange_timestamp"), F.unix_micros("b.o.received_at").alias("received_us"))


def invalid_counts(frames: DataFrame) -> DataFrame:
    """Invalid or crossed frames of each market: how many, and when the last came."""
    known = F.col("type").isin("snapshot", "update")
    bad = frames.where(known & (~F.coalesce(F.col("is_valid"), F.lit(True)) | crossed()))
    return bad.groupBy("market_id").agg(F.count("*").alias("invalid"), F.unix_micros(F.max("received_at")).alias("last_us"))


def frame_counts(streams: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames of each subscribed stream, 0 for silent ones."""
    counts = frames.groupBy("stream_id").agg(F.count("*").alias("n"))
    return streams.select("stream_id").distinct().join(counts, "stream_id", "left").select("stream_id", F.coalesce("n", F.lit(0)).alias("frames"))


def trailing_rate(frames: DataFrame, seconds: float = 1.0) -> DataFrame:
    """Frames of the market received within the ``seconds`` up to each frame, both ends included."""
    at = frames.where(F.col("received_at").isNotNull()).select("row_id", "market_id", F.unix_micros("received_at").alias("us"))
    width = int(seconds * 1_000_000)
    counted = at.groupBy("market_id", "us").agg(F.count("*").alias("n")).withColumn("span", F.call_function("div", F.col("us"), F.lit(max(width, 1))))
    # A frame looks back no further than one span, so that each span and the one before it are a window of their own.
    both = counted.select("market_id", "us", "n", (F.col("span")).alias("own"), F.explode(F.array("span", F.col("span") + 1)).alias("span"))
    back = Window.partitionBy("market_id", "span").orderBy("us").rangeBetween(-width, 0)
    rates = both.withColumn("frames", F.sum("n").over(back)).where("span = own").select("market_id", "us", "frames")
    same = F.col("a.market_id").eqNullSafe(F.col("r.market_id")) & (F.col("a.us") == F.col("r.us"))
    return at.alias("a").join(rates.alias("r"), same).select("a.row_id", "a.market_id", "r.frames")


def changes(frames: DataFrame) -> DataFrame:
    """Frames whose two best prices differ from those of the frame of the market received before (null differs from a price)."""
    before = Window.partitionBy("market_id", PART).orderBy("received_at", "row_id")
    bid, ask = F.col("best_bid_price"), F.col("best_ask_price")
    rows = ranged(frames.select("row_id", "market_id", "received_at", "best_bid_price", "best_ask_price"), "market_id", "received_at", "row_id")
    at = with_halo(rows, "market_id", ["received_at", "row_id"], 1).withColumn("was", F.lag(F.struct(bid, ask)).over(before)).where(~F.col(HALO))
    same = F.col("was").isNotNull() & bid.eqNullSafe(F.col("was.best_bid_price")) & ask.eqNullSafe(F.col("was.best_ask_price"))
    return at.where(~same).select("row_id", "market_id", bid, ask)


def freshest(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of two tables of books the newer row of each market; the first table's at equal times."""
    both = a.withColumn("__first", F.lit(1)).unionByName(b.withColumn("__first", F.lit(0)))
    return both.groupBy("market_id").agg(F.max_by(F.struct(*a.columns), F.struct("received_us", "__first")).alias("b")).select("b.*")


def fold_deltas(frames: DataFrame) -> DataFrame:
    """Quantities of ladders after every frame: columns market_id, side, price, seq, ``qty`` after it, for levels it touches.

    ``frames``: market_id, seq, kind (``snapshot`` or ``delta``), side, price, qty. A snapshot's rows replace the market's
    ladders; a delta adds to its level, from 0, and a level at or below 0 is gone; deltas before the first snapshot and rows
    with a null side or price are ignored. Resetting at 0 is a running sum less its running minimum where that is negative.
    """
    ok = F.col("side").isNotNull() & F.col("price").isNotNull() & F.col("qty").isNotNull()
    so_far = Window.partitionBy("market_id").orderBy("seq").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    at = frames.withColumn("epoch", F.max(F.when(F.col("kind") == "snapshot", F.col("seq"))).over(so_far)).where(ok & F.col("epoch").isNotNull())
    run = Window.partitionBy("market_id", "epoch", "side", "price").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    summed = at.withColumn("c", F.sum("qty").over(run))
    return summed.withColumn("low", F.min("c").over(run)).select("market_id", "side", "price", "seq", (F.col("c") - F.least(F.col("low"), F.lit(0))).alias("qty"))
