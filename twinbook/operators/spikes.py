"""Problem 5: implausible readings, judged per source by an isolation forest and explicit physical limits.

Every reading of a (source, side) has four features in units of that source: its level against the median of the readings
around it, and its difference from those before and after it (the smaller one, so that a level that moves and stays is
none), both in usual moves; its distance from the source's level at that hour of the day; and the length of the run of
equal prices that it continues, in lengths that the source reaches by chance. A forest of the source scores every reading,
and the score alone decides; the only rules are the physical limits.

The readings lie in blocks of ``BLOCK`` sequence numbers, so that a source with a third of all rows is many rows of bounded
size. Small edge rows carry, over block borders, the neighbouring prices and the lengths of runs. One Arrow pass reduces
each block to histograms of moves and run lengths, sums by hour and its share of the training sample (one point a run, those
of smallest hash, so that a long frozen run does not look ordinary); another scores the readings of a source's blocks by
one forest. The sample of at most ``SAMPLE`` points a source is the forest's own subsampling; everything else covers all rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinbook.functions.forest import Forests, mix
from twinbook.session import cut_lineage

BLOCK, CHUNK, HALO, SAMPLE = 2_048, 64, 8, 128
#: How many runs as long as its unit of length a source has by chance.
CHANCE = 0.01
#: Upper ends of the features' boxes, in units of the source: level, difference, season, run length.
DOMAIN = np.array([16.0, 16.0, 16.0, 4.0])
#: Steps to which features are rounded, so that readings alike are scored once.
STEP = np.array([0.125, 0.125, 0.5, 1 / 32])


def impossible(bid: str = "best_bid_price", ask: str = "best_ask_price") -> Column:
    """A price that cannot be: NaN, below 0, above 1, or a bid not below the ask. Null prices break no limit."""
    b, a = F.col(bid), F.col(ask)
    bad = [F.isnan(b), F.isnan(a), b < 0, b > 1, a < 0, a > 1, b >= a]
    return F.greatest(*[F.coalesce(x, F.lit(False)) for x in bad])


def price_blocks(frames: DataFrame) -> DataFrame:
    """Blocks of plausible prices in order of ``seq``: ``seqs``, ``px``, ``hours``; one delivery of each (source, seq)."""
    kept = frames.where(F.col("seq").isNotNull() & F.col("stream_id").isNotNull() & ~impossible())
    order = F.struct("received_at", "row_id", F.struct("best_bid_price", "best_ask_price").alias("p"))
    single = kept.groupBy("market_id", "stream_id", "seq").agg(F.min(order).alias("o"))
    hour = F.coalesce(F.hour("o.received_at"), F.lit(0))
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.round(F.col(f"o.p.{p}"), 6).alias("px")) for i, p in enumerate(("best_bid_price", "best_ask_price"))])
    long = single.select("market_id", "stream_id", "seq", hour.alias("hour"), F.inline(sides)).where(F.col("px").isNotNull())
    block = F.floor(F.col("seq") / BLOCK).cast("long")
    rows = F.array_sort(F.collect_list(F.struct("seq", "px", "hour")))
    packed = long.groupBy("market_id", "stream_id", "side", block.alias("block")).agg(rows.alias("r"))
    return packed.select(
        "market_id", "stream_id", "side", "block", F.col("r.seq").alias("seqs"), F.col("r.px").alias("px"), F.col("r.hour").alias("hours")
    )


def with_neighbours(blocks: DataFrame) -> DataFrame:
    """Adds ``before`` and ``after`` (up to ``HALO`` prices) and ``run_in``, ``run_out``: how much of the first and last run lies outside."""
    key = ["market_id", "stream_id", "side"]
    n, px = F.size("px"), F.col("px")
    first, last = F.element_at(px, 1), F.element_at(px, -1)
    head = F.coalesce(F.nullif(F.array_position(F.transform(px, lambda x: x != first), True), F.lit(0)) - 1, n)
    tail = F.coalesce(F.nullif(F.array_position(F.transform(F.reverse(px), lambda x: x != last), True), F.lit(0)) - 1, n)
    edges = blocks.select(
        *key, "block", n.alias("n"), first.alias("first"), last.alias("last"), head.cast("long").alias("head"), tail.cast("long").alias("tail"),
        F.slice(px, 1, HALO).alias("h"), F.slice(px, F.greatest(n - HALO + 1, F.lit(1)), HALO).alias("t"),
    )
    fore, back = Window.partitionBy(*key).orderBy("block"), Window.partitionBy(*key).orderBy(F.col("block").desc())
    edges = edges.select("*", F.lag("last").over(fore).alias("pl"), F.lead("first").over(fore).alias("nf"))
    whole = F.col("head") == F.col("n")
    stay, go = F.coalesce(F.col("pl") == F.col("first"), F.lit(False)), F.coalesce(F.col("nf") == F.col("last"), F.lit(False))
    edges = edges.withColumns({"stay": stay, "go": go, "whole": whole})
    run = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = edges.select(
        "*", F.sum(F.when(F.col("whole") & F.col("stay"), 0).otherwise(1)).over(run(fore)).alias("gf"),
        F.sum(F.when(F.col("whole") & F.col("go"), 0).otherwise(1)).over(run(back)).alias("gb"),
    )
    by_f, by_b = Window.partitionBy(*key, "gf").orderBy("block"), Window.partitionBy(*key, "gb").orderBy(F.col("block").desc())
    edges = edges.select(
        "*", F.sum(F.when(F.col("whole") & F.col("stay"), F.col("n")).otherwise(F.col("tail"))).over(run(by_f)).alias("ends"),
        F.sum(F.when(F.col("whole") & F.col("go"), F.col("n")).otherwise(F.col("head"))).over(run(by_b)).alias("starts"),
    )
    edges = edges.select(
        *key, "block",
        F.when(F.col("stay"), F.lag("ends").over(fore)).otherwise(0).alias("run_in"),
        F.when(F.col("go"), F.lead("starts").over(fore)).otherwise(0).alias("run_out"),
        F.flatten(F.collect_list("t").over(fore.rowsBetween(-HALO, -1))).alias("before"),
        F.flatten(F.collect_list("h").over(fore.rowsBetween(1, HALO))).alias("after"),
    )
    size = F.size("before")
    edges = edges.withColumns({"before": F.slice("before", F.greatest(size - HALO + 1, F.lit(1)), HALO), "after": F.slice("after", 1, HALO)})
    return blocks.join(edges, [*key, "block"])


def _features(px, before, after, run_in: int, run_out: int):
    """Level and difference of each reading in prices, the length of the run it continues (0 if it begins one), all run lengths,
    whether it begins a run, and its move."""
    n, nb = len(px), len(before)
    v = np.concatenate([before, px, after])
    window = np.lib.stride_tricks.sliding_window_view
    level = np.abs(v - np.median(window(np.pad(v, 4, mode="edge"), 9), axis=1))[nb : nb + n]
    past = np.median(window(np.pad(v, (5, 0), mode="edge"), 5), axis=1)[: len(v)]
    future = np.median(window(np.pad(v, (0, 5), mode="edge"), 5), axis=1)[1:]
    difference = np.minimum(np.abs(v - past), np.abs(v - future))[nb : nb + n]
    change = np.concatenate([[True], np.diff(px) != 0])
    run = np.cumsum(change) - 1
    lengths = np.bincount(run)
    lengths[0] += run_in
    lengths[-1] += run_out
    starts = change.copy()
    starts[0] = run_in == 0
    return level, difference, np.where(starts, 0, lengths[run]), lengths, starts, np.diff(np.concatenate([before[-1:], px]))


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for r in b.itertuples(index=False):
            px, seqs, hours = np.asarray(r.px, float), np.asarray(r.seqs, np.int64), np.asarray(r.hours, int)
            level, difference, run, lengths, starts, moves = _features(px, np.asarray(r.before, float), np.asarray(r.after, float), r.run_in, r.run_out)
            steps, many = np.unique(np.round(np.abs(moves[moves != 0]) * 1e6).astype(np.int64), return_counts=True)
            ended = lengths if r.run_out == 0 else lengths[:-1]
            runs, often = np.unique(ended, return_counts=True)
            at = np.flatnonzero(starts)
            key = mix(seqs[at], 7)
            best = np.argsort(key, kind="stable")[:SAMPLE]
            at = np.minimum(at + 1, len(px) - 1)[best]
            at = np.where(starts[at], np.flatnonzero(starts)[best], at)  # a run's second reading, if it has one here
            points = np.column_stack([level[at], difference[at], px[at], hours[at], run[at]])
            rows.append((r.market_id, r.side, steps, many, runs, often, key[best], points.tolist(), np.bincount(hours, minlength=24), np.bincount(hours, px, 24), float((px**2).sum())))
        yield pd.DataFrame(rows, columns=["market_id", "side", "steps", "many", "runs", "often", "keys", "points", "n_by_hour", "by_hour", "squares"])


_SUMMARY = (
    "market_id string, side int, steps array<bigint>, many array<bigint>, runs array<bigint>, often array<bigint>, keys array<bigint>, points array<array<double>>, "
    "n_by_hour array<bigint>, by_hour array<double>, squares double"
)


def source_models(blocks: DataFrame) -> DataFrame:
    """Per (market, side) its units, counted over all rows, and the forest's sample.

    ``usual_move``: median of its nonzero moves. ``usual_run``: the 0.9-quantile of its run lengths, times the number of
    tenfold thinnings after which it has ``CHANCE`` runs left. ``by_hour``, ``n_by_hour``, ``squares``: for its level by hour.
    """
    key = ["market_id", "side"]
    s = cut_lineage(blocks.mapInPandas(_summaries, _SUMMARY))

    def quantile(value: str, count: str, share: tuple[int, int]) -> DataFrame:
        pairs = s.select(*key, F.inline(F.arrays_zip(F.col(value).alias("x"), F.col(count).alias("n")))).toDF(*key, "x", "n")
        up = Window.partitionBy(*key).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
        at = pairs.groupBy(*key, "x").agg(F.sum("n").alias("n")).select(
            "*", F.sum("n").over(up).alias("c"), F.sum("n").over(Window.partitionBy(*key)).alias("total")
        )
        return at.where(F.col("c") * share[1] >= F.col("total") * share[0]).groupBy(*key).agg(F.min("x").alias("q"), F.max("total").alias("total"))

    usual = quantile("steps", "many", (1, 2)).select(*key, (F.col("q") / 1e6).alias("usual_move"))
    runs = quantile("runs", "often", (9, 10)).select(*key, (F.col("q") * F.log10(F.col("total") / CHANCE)).alias("usual_run"))
    slots = F.posexplode(F.arrays_zip(F.col("n_by_hour").alias("n"), F.col("by_hour").alias("x"))).alias("hour", "h")
    hours = s.select(*key, slots).groupBy(*key, "hour").agg(F.sum("h.n").alias("n"), F.sum("h.x").alias("x"))
    by_hour = hours.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("hour", "n", "x"))).alias("h")).select(
        *key, F.col("h.n").alias("n_by_hour"), F.col("h.x").alias("by_hour")
    )
    squares = s.groupBy(*key).agg(F.sum("squares").alias("squares"))
    points = s.select(*key, F.inline(F.arrays_zip(F.col("keys").alias("k"), F.col("points").alias("p")))).toDF(*key, "k", "p")
    ranked = points.select("*", F.row_number().over(Window.partitionBy(*key).orderBy("k", "p")).alias("i")).where(F.col("i") <= SAMPLE)
    sample = ranked.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("k", "p"))).alias("s")).select(*key, F.col("s.p").alias("sample"))
    return sample.join(by_hour, key).join(squares, key).join(usual, key, "left").join(runs, key, "left")


class _Source:
    """Units of a source and its features."""

    def __init__(self, r):
        n, x = np.asarray(r.n_by_hour, float), np.asarray(r.by_hour, float)
        self.by_hour = x / np.maximum(n, 1)
        self.move = r.usual_move if r.usual_move and r.usual_move == r.usual_move else 1.0
        self.run = r.usual_run if r.usual_run and r.usual_run == r.usual_run else np.inf
        spread = np.sqrt(max(r.squares - float((n * self.by_hour**2).sum()), 0.0) / max(n.sum(), 1.0))
        self.spread = spread + self.move
        p = np.array([np.asarray(q, float) for q in r.sample])
        self.sample = self.features(p[:, 0], p[:, 1], p[:, 2], p[:, 3].astype(int), p[:, 4])
        self.seed = zlib.crc32(str(r.market_id).encode()) * 2 + int(r.side)

    def features(self, level, difference, px, hours, run) -> np.ndarray:
        x = np.column_stack([level / self.move, difference / self.move, np.abs(px - self.by_hour[hours]) / self.spread, run / self.run])
        return np.round(np.minimum(x, DOMAIN) / STEP) * STEP


def _grown(sources: list[_Source], trees: int, clean: float) -> Forests:
    """Forests of the sources, grown twice: the second time without points of the samples that the first time score ``clean``."""
    seeds = [s.seed for s in sources]
    first = Forests([s.sample for s in sources], seeds, DOMAIN, (trees + 1) // 2)
    left = []
    for i, s in enumerate(sources):
        each, back = np.unique(s.sample, axis=0, return_inverse=True)
        kept = s.sample[first.score(each, np.full(len(each), i))[back.ravel()] < clean]
        left.append(kept if len(kept) else s.sample)
    return Forests(left, seeds, DOMAIN, trees)


def _scores(trees: int, clean: float, least_score: float, outliers_only: bool):
    def judge(rows: list) -> pd.DataFrame:
        sources, index = [], {}
        for r in rows:
            if (r.market_id, r.side) not in index:
                index[r.market_id, r.side] = len(sources)
                sources.append(_Source(r))
        forests = _grown(sources, trees, clean)
        parts, of = [], []
        for r in rows:
            s = index[r.market_id, r.side]
            px = np.asarray(r.px, float)
            level, difference, run, *_ = _features(px, np.asarray(r.before, float), np.asarray(r.after, float), r.run_in, r.run_out)
            parts.append(sources[s].features(level, difference, px, np.asarray(r.hours, int), run))
            of.append(np.full(len(px), s))
        x, of = np.vstack(parts), np.concatenate(of)
        places = np.rint(DOMAIN / STEP).astype(np.int64) + 1
        code = of.astype(np.int64)
        for i, n in enumerate(places):
            code = code * n + np.rint(x[:, i] / STEP[i]).astype(np.int64)
        _, first, back = np.unique(code, return_index=True, return_inverse=True)
        score = forests.score(x[first], of[first])[back]
        sizes = [len(r.px) for r in rows]
        out = pd.DataFrame({
            "market_id": np.repeat(np.array([r.market_id for r in rows], object), sizes), "stream_id": np.repeat([r.stream_id for r in rows], sizes),
            "seq": np.concatenate([np.asarray(r.seqs, np.int64) for r in rows]), "side": np.repeat([r.side for r in rows], sizes), "score": score, "is_outlier": score >= least_score,
        })
        return out[out.is_outlier] if outliers_only else out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, size, seen = [], 0, set()
            for r in b.sort_values(["market_id", "side"], kind="stable").itertuples(index=False):
                rows.append(r)
                size += len(r.px)
                seen.add((r.market_id, r.side))
                if size >= BLOCK * CHUNK or len(seen) >= 32:
                    yield judge(rows)
                    rows, size, seen = [], 0, set()
            if rows:
                yield judge(rows)

    return run


def reading_scores(frames: DataFrame, least_score: float = 0.51, trees: int = 30, clean: float = 0.46, outliers_only: bool = False) -> DataFrame:
    """One row per plausible price (source, ``seq``, ``side`` 0 bid, 1 ask) with the forest's ``score`` and ``is_outlier``.

    A reading is an outlier from ``least_score`` on. Null prices are skipped; rows without source or ``seq`` have no place in
    the order; repeated deliveries count once (the first received). A source of a single level or run has no usual move or
    run; its moves are measured in prices and its runs not at all. Empty in, empty out; further columns are ignored.
    """
    blocks = cut_lineage(with_neighbours(price_blocks(frames)))
    blocks = blocks.withColumn("chunk", F.floor(F.col("block") / CHUNK).cast("long"))
    key = ["market_id", "side"]
    models = blocks.select(*key, "chunk").distinct().join(source_models(blocks), key)
    schema = "market_id string, stream_id bigint, seq bigint, side int, score double, is_outlier boolean"
    return blocks.join(models, [*key, "chunk"]).mapInPandas(_scores(trees, clean, least_score, outliers_only), schema)


def implausible_rows(frames: DataFrame) -> DataFrame:
    """``row_id`` of every delivery of a frame with an impossible, briefly far-off or frozen price. ``frames``: valid frames."""
    flagged = reading_scores(frames, outliers_only=True).select("stream_id", "seq").distinct()
    by_rule = frames.where(impossible()).select("row_id")
    return frames.where(~impossible()).select("row_id", "stream_id", "seq").join(flagged, ["stream_id", "seq"], "left_semi").select("row_id").unionByName(by_rule).distinct()
