"""Stateful streams: late minutes, last valid books, and the fold of deltas. State is keyed, bounded, and ends by timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from twinbook.operators.frames import is_valid_frame

STATE_CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
_MINUTE = (
    "frame_count bigint, last_bid double, last_ask double, low_bid double, high_bid double, low_ask double, high_ask double, "
    "bid_us bigint, ask_us bigint, version int"
)
MINUTE_OUT = (
    "market_id string, minute_s bigint, version int, is_correction boolean, frame_count bigint, last_bid double, last_ask double, low_bid double, "
    "high_bid double, low_ask double, high_ask double"
)


def _pick(value, other, choose):
    return other if value is None else value if other is None else choose(value, other)


class MinuteProcessor(StatefulProcessor):
    """Aggregates of one market and minute. Each batch of accepted frames emits one upsert; a timer drops the state when the minute is closed."""

    def __init__(self, grace_s: int, cutoff_s: int):
        self.grace_s, self.cutoff_s = grace_s, cutoff_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("minute", _MINUTE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        market, minute = key
        batch = pd.concat(list(rows)).sort_values(["event_us", "seq"], kind="stable")
        n, bid, ask, b0, b1, a0, a1, bid_us, ask_us, version = self.state.get() if self.state.exists() else (0, *[None] * 8, 0)
        n += len(batch)
        for price, which in ((batch.best_bid_price, "b"), (batch.best_ask_price, "a")):
            seen = batch.assign(p=price)[price.notna()]
            if seen.empty:
                continue
            last_us, last, low, high = int(seen.event_us.iloc[-1]), float(seen.p.iloc[-1]), float(seen.p.min()), float(seen.p.max())
            if which == "b":
                if bid_us is None or last_us >= bid_us:
                    bid, bid_us = last, last_us
                b0, b1 = _pick(b0, low, min), _pick(b1, high, max)
            else:
                if ask_us is None or last_us >= ask_us:
                    ask, ask_us = last, last_us
                a0, a1 = _pick(a0, low, min), _pick(a1, high, max)
        version += 1
        self.state.update((n, bid, ask, b0, b1, a0, a1, bid_us, ask_us, version))
        self.handle.registerTimer((minute + 60 + self.cutoff_s) * 1000 + 1)
        late = bool((batch.late_s >= self.grace_s).any())
        yield pd.DataFrame([(market, minute, version, late, n, bid, ask, b0, b1, a0, a1)], columns=[x.split()[0] for x in MINUTE_OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame(columns=[x.split()[0] for x in MINUTE_OUT.split(", ")])

    def close(self) -> None:
        pass


def accepted_frames(frames: DataFrame, cutoff_s: int = 300) -> tuple[DataFrame, DataFrame]:
    """Counting frames with ``minute_s`` and ``late_s``, and those beyond the cut-off for reporting. ``frames`` has ``event_us``."""
    minute = F.call_function("div", F.col("event_us") - F.pmod(F.col("event_us"), F.lit(60_000_000)), F.lit(1_000_000))
    at = frames.where(is_valid_frame() & F.col("event_us").isNotNull()).withColumn("minute_s", minute)
    at = at.withColumn("late_s", F.unix_micros("received_at") / 1e6 - (F.col("minute_s") + 60))
    clean = {c: F.when(~F.isnan(c), F.col(c)) for c in ("best_bid_price", "best_ask_price")}
    return at.withColumns(clean).where(F.col("late_s") <= cutoff_s), at.where(F.col("late_s") > cutoff_s)


def stream_minutes(frames: DataFrame, grace_s: int = 10, cutoff_s: int = 300, repeats: str = "2 hours") -> DataFrame:
    """Upserts of a stream of frames (``event_us``, ``received_at`` and the frame's columns): later versions replace earlier ones.

    Repeated deliveries within ``repeats`` are dropped by (market, seq), the first to come in stays. Arrival time is the clock.
    """
    first = frames.withWatermark("received_at", repeats).dropDuplicatesWithinWatermark(["market_id", "seq"])
    kept, _ = accepted_frames(first, cutoff_s)
    return kept.groupBy("market_id", "minute_s").transformWithStateInPandas(
        MinuteProcessor(grace_s, cutoff_s), outputStructType=MINUTE_OUT, outputMode="Append", timeMode="EventTime"
    )


def stream_dropped(frames: DataFrame, cutoff_s: int = 300) -> DataFrame:
    """The frames that ``stream_minutes`` leaves out for being beyond the cut-off, for reporting: row, market, minute and lateness."""
    return accepted_frames(frames, cutoff_s)[1].select("row_id", "market_id", "minute_s", "late_s")


class BookProcessor(StatefulProcessor):
    """The last valid, uncrossed book of a market; emits it when a best price changes."""

    OUT = "market_id string, received_us bigint, bid double, ask double"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.book = handle.getValueState("book", "received_us bigint, bid double, ask double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        state = self.book.get() if self.book.exists() else None
        for r in pd.concat(list(rows)).sort_values(["received_us", "row_id"], kind="stable").itertuples(index=False):
            bid, ask = (None if v != v else float(v) for v in (r.best_bid_price, r.best_ask_price))
            if state is not None and r.received_us < state[0]:
                continue
            if state is None or (bid, ask) != tuple(state[1:]):
                out.append((key[0], int(r.received_us), bid, ask))
            state = (int(r.received_us), bid, ask)
        if state is not None:
            self.book.update(state)
        yield pd.DataFrame(out, columns=[x.split()[0] for x in self.OUT.split(", ")])

    def close(self) -> None:
        pass


def stream_books(frames: DataFrame) -> DataFrame:
    """Changes of each market's best prices, of valid and uncrossed frames in order of arrival."""
    from twinbook.operators.books import crossed

    kept = frames.where(is_valid_frame() & ~crossed()).withColumn("received_us", F.unix_micros("received_at"))
    return kept.select("market_id", "row_id", "received_us", "best_bid_price", "best_ask_price").groupBy("market_id").transformWithStateInPandas(
        BookProcessor(), outputStructType=BookProcessor.OUT, outputMode="Append", timeMode="None"
    )


class LadderProcessor(StatefulProcessor):
    """Ladders of a market: snapshots replace them, deltas add to a level that goes at 0 or below."""

    OUT = "market_id string, side string, price double, seq bigint, qty double"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.levels = handle.getMapState("levels", "side string, price double", "qty double")
        self.started = handle.getValueState("started", "seq bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for r in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples(index=False):
            if r.kind == "snapshot" and (not self.started.exists() or self.started.get()[0] != r.seq):
                self.levels.clear()
                self.started.update((int(r.seq),))
            if not self.started.exists() or r.side is None or r.price != r.price or r.qty != r.qty:
                continue
            at = (r.side, float(r.price))
            held = self.levels.getValue(at)[0] if r.kind != "snapshot" and self.levels.containsKey(at) else 0.0
            qty = max(0.0, held + float(r.qty))
            if qty > 0:
                self.levels.updateValue(at, (qty,))
            elif self.levels.containsKey(at):
                self.levels.removeKey(at)
            out.append((key[0], r.side, float(r.price), int(r.seq), qty))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in self.OUT.split(", ")])

    def close(self) -> None:
        pass


def stream_ladders(deltas: DataFrame) -> DataFrame:
    """Quantities after each delta of a stream (market_id, seq, kind, side, price, qty)."""
    return deltas.groupBy("market_id").transformWithStateInPandas(LadderProcessor(), outputStructType=LadderProcessor.OUT, outputMode="Append", timeMode="None")
