"""Problem 7: sources mixed to target shares of tokens, small sources repeated at most a capped number of times."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinbook.llm.encoding import count_tokens
from twinbook.session import cut_lineage

BINS = 1 << 16
MOST_SOURCES = 10_000


@dataclass(frozen=True)
class Mixture:
    """``documents``: each document of a listed source with its ``repeats``; ``shares``: one row per target."""

    documents: DataFrame
    shares: DataFrame


def fill(targets: dict[str, tuple[float, float]], total: float) -> dict[str, float]:
    """Capped water-filling: amounts of ``total`` by weight, none above its cap; targets are (weight, cap) by source.

    Sources whose share of what is left exceeds their cap are clamped, and their excess goes to the others in proportion to
    the weights, until nothing exceeds a cap. If all are clamped, less than ``total`` comes out.
    """
    amount = {s: 0.0 for s in targets}
    open_ = {s for s, (w, c) in targets.items() if w > 0 and c > 0}
    left = float(total)
    while open_:
        weight = sum(targets[s][0] for s in open_)
        full = {s for s in open_ if left * targets[s][0] / weight >= targets[s][1]}
        if not full:
            for s in open_:
                amount[s] = left * targets[s][0] / weight
            break
        for s in full:
            amount[s] = targets[s][1]
        left = max(0.0, left - sum(targets[s][1] for s in full))
        open_ -= full
    return amount


def exact_total(targets: dict[str, tuple[float, float]]) -> float:
    """The largest total of which every source that has tokens gets its share (of all such sources' shares) without exceeding its cap."""
    able = [(w, c) for w, c in targets.values() if w > 0 and c > 0]
    weight = sum(w for w, _ in able)
    return min((c * weight / w for w, c in able), default=0.0)


def mix_sources(
    documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 0, vocabulary: str | None = None, all_tokens: bool = False
) -> Mixture:
    """Mixture of ``documents`` (doc_id, text, source) by ``targets`` (source, target_share, max_repeats).

    ``total_tokens`` defaults to the largest total that meets all targets (``exact_total``), or with ``all_tokens`` to all tokens of
    the listed sources, which clamps those that have too few and gives their excess to the others. Each source gets its water-filled amount: every document
    as often as it fits wholly, and the rest from documents in the order of a seeded hash, up to the one that comes nearest
    from below. Documents of null or unlisted source take no part; texts without tokens have 0 repeats beyond the whole
    ones. A source listed twice counts with its largest share and cap; null or negative shares and caps are 0; a target
    without documents has share 0. Repeated rows are documents of their own. Empty documents give an empty mixture and
    shares of 0. ``targets`` is a table of parameters: at most ``MOST_SOURCES`` rows, else an error.
    """
    spark = documents.sparkSession
    wanted = targets.where(F.col("source").isNotNull()).groupBy("source").agg(
        F.greatest(F.coalesce(F.max("target_share"), F.lit(0.0)), F.lit(0.0)).alias("target_share"),
        F.greatest(F.coalesce(F.max("max_repeats"), F.lit(0)), F.lit(0)).alias("max_repeats"),
    )
    counted = cut_lineage(count_tokens(documents.join(wanted.select("source"), "source", "left_semi"), ["doc_id", "source"], vocabulary=vocabulary))
    bins = counted.withColumn("bin", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(BINS)))
    by_bin = cut_lineage(bins.groupBy("source", "bin").agg(F.sum("n_tokens").alias("tokens")))
    sums = by_bin.groupBy("source").agg(F.sum("tokens").alias("available"))
    rows = wanted.join(sums, "source", "left").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} target sources")
    have = {r.source: int(r.available or 0) for r in rows}
    caps = {r.source: (float(r.target_share), float(have[r.source] * r.max_repeats)) for r in rows}
    if total_tokens is None:
        total_tokens = sum(have.values()) if all_tokens else exact_total(caps)
    amount = fill(caps, total_tokens)
    most = {r.source: int(r.max_repeats) for r in rows}
    plan = []
    for s, x in amount.items():
        whole = min(most[s], int(x // have[s])) if have[s] else 0
        plan.append((s, whole, int(round(x - whole * have[s])) if whole < most[s] else 0))
    quota = spark.createDataFrame(plan, "source string, whole int, rest bigint")
    up = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    filled = by_bin.select("*", F.coalesce(F.sum("tokens").over(up), F.lit(0)).alias("below")).join(quota, "source")
    cut = filled.where((F.col("below") <= F.col("rest")) & (F.col("below") + F.col("tokens") > F.col("rest"))).select(
        "source", F.col("bin").alias("cut"), (F.col("rest") - F.col("below")).alias("room")
    )
    placed = bins.join(quota, "source").join(cut, "source", "left")
    inside = Window.partitionBy("source", "bin").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    edge = placed.where(F.col("bin") == F.col("cut")).select("*", F.sum("n_tokens").over(inside).alias("upto"))
    rest = placed.where(F.coalesce(F.col("bin") != F.col("cut"), F.lit(True)))
    # Without a cut the rest takes every document (it is never more than all of them) or, being 0, none.
    below = F.when(F.col("cut").isNull(), F.col("rest") > 0).otherwise(F.col("bin") < F.col("cut"))
    columns = ["doc_id", "source", "n_tokens"]
    chosen = rest.select(*columns, (F.col("whole") + F.when(below & (F.col("n_tokens") > 0), 1).otherwise(0)).cast("int").alias("repeats")).unionByName(
        edge.select(*columns, (F.col("whole") + F.when((F.col("upto") <= F.col("room")) & (F.col("n_tokens") > 0), 1).otherwise(0)).cast("int").alias("repeats"))
    )
    used = chosen.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens_used"), F.sum((F.col("repeats") > 0).cast("long")).alias("documents_used"),
        F.max("repeats").alias("most_repeats"),
    )
    report = wanted.join(sums, "source", "left").join(used, "source", "left")
    total = F.sum(F.coalesce(F.col("tokens_used"), F.lit(0))).over(Window.partitionBy(F.lit(0)))
    shares = report.select(
        "source", "target_share", F.coalesce(F.try_divide(F.coalesce(F.col("tokens_used"), F.lit(0)).cast("double"), total.cast("double")), F.lit(0.0)).alias("actual_share"),
        F.coalesce("available", F.lit(0)).alias("tokens_available"), F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"),
        F.coalesce("documents_used", F.lit(0)).alias("documents_used"), "max_repeats", F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
    )
    return Mixture(chosen, shares)
