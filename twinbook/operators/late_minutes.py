"""Problem 2: per-minute aggregates by event time, corrected as late frames arrive, until a minute is too old.

A minute's clock is the arrival time: its first result is due ``grace_s`` after its end, frames arriving later correct it
in ticks of ``tick_s`` (one upsert a tick), and frames arriving more than ``cutoff_s`` after its end are diverted. Frames
are first reduced per (source, minute, tick) with partial aggregation, so that a hot source or minute costs a few rows a
map task, and the keyed state is a window of at most ``(cutoff_s - grace_s) / tick_s + 2`` ticks of one minute.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE_US = 60_000_000


@dataclass(frozen=True)
class LateMinutes:
    """``upserts``: every version of every minute; ``final``: the last version; ``dropped``: frames beyond the cut-off."""

    upserts: DataFrame
    final: DataFrame
    dropped: DataFrame


def first_deliveries(frames: DataFrame, source: str = "market_id", seq: str = "seq", columns: tuple[str, ...] = ()) -> DataFrame:
    """The row received first (ties: smallest ``row_id``) of each (source, seq); rows without a seq stand for themselves."""
    order = F.struct(F.col("received_at").isNull().alias("n"), F.col("received_at").alias("t"), F.col("row_id").alias("i"))
    lone = F.when(F.col(seq).isNull(), F.col("row_id")).alias("__lone")
    kept = F.struct(order.alias("o"), F.struct(*[F.col(c) for c in columns]).alias("v"))
    first = frames.groupBy(F.col(source), F.col(seq), lone).agg(F.min(kept).alias("__first"))
    return first.select(source, seq, *[F.col(f"__first.v.{c}").alias(c) for c in columns])


def _running(values: dict[str, Column], window) -> list[Column]:
    return [v.over(window).alias(k) for k, v in values.items()]


def late_minutes(
    frames: DataFrame, source: str = "market_id", event_us: str = "event_us", grace_s: int = 10, cutoff_s: int = 300, tick_s: int = 10
) -> LateMinutes:
    """Minutes of counting frames (columns: source, ``event_us``, ``received_at``, ``seq``, best prices).

    Null event or arrival times are no event; null and NaN prices are left out of prices but the frame counts; ties of
    event time are settled by seq, then by the larger price. Repeated rows count as often as they are there (reduce them with
    ``first_deliveries`` before). A null source is a source of its own. An empty table gives empty tables; further columns
    are ignored.
    """
    minute = F.call_function("div", F.col(event_us) - F.pmod(F.col(event_us), F.lit(MINUTE_US)), F.lit(1_000_000))
    arrived = F.unix_micros("received_at")
    lateness = arrived - (F.col("__minute") * 1_000_000 + MINUTE_US)
    at = frames.where(F.col(event_us).isNotNull() & F.col("received_at").isNotNull())
    at = at.withColumn("__minute", minute).withColumn("__late_us", lateness)
    bid = F.when(~F.isnan("best_bid_price"), F.col("best_bid_price"))
    ask = F.when(~F.isnan("best_ask_price"), F.col("best_ask_price"))
    past = F.col("__late_us") - grace_s * 1_000_000
    tick = F.when(past < 0, 0).otherwise(F.call_function("div", past, F.lit(tick_s * 1_000_000)) + 1)

    def latest(price: Column) -> Column:
        return F.max(F.when(price.isNotNull(), F.struct(F.col(event_us).alias("t"), F.col("seq").alias("s"), price.alias("p"))))

    reduced = (
        at.where(F.col("__late_us") <= cutoff_s * 1_000_000)
        .groupBy(F.col(source), F.col("__minute").alias("minute_s"), tick.alias("__tick"))
        .agg(
            F.count("*").alias("n"), latest(bid).alias("lb"), latest(ask).alias("la"), F.min(bid).alias("b0"), F.max(bid).alias("b1"),
            F.min(ask).alias("a0"), F.max(ask).alias("a1"), F.max("received_at").alias("at"),
        )
    )
    state = Window.partitionBy(source, "minute_s").orderBy("__tick").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = Window.partitionBy(source, "minute_s").orderBy("__tick")
    folded = reduced.select(
        source, "minute_s", (F.col("__tick") > 0).alias("is_correction"), F.row_number().over(ordered).alias("version"),
        F.lead("__tick").over(ordered).isNull().alias("is_final"),
        *_running(
            {
                "frame_count": F.sum("n"), "last_bid": F.max("lb"), "last_ask": F.max("la"), "low_bid": F.min("b0"), "high_bid": F.max("b1"),
                "low_ask": F.min("a0"), "high_ask": F.max("a1"), "emitted_at": F.max("at"),
            },
            state,
        ),
    )
    upserts = folded.withColumns({"last_bid": F.col("last_bid.p"), "last_ask": F.col("last_ask.p")})
    dropped = at.where(F.col("__late_us") > cutoff_s * 1_000_000).select(
        *[c for c in frames.columns], F.col("__minute").alias("minute_s"), (F.col("__late_us") / 1e6).alias("late_s")
    )
    return LateMinutes(upserts, upserts.where("is_final").drop("is_final"), dropped)
