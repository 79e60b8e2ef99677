"""From two catalogs to a written snapshot: liquidity, candidates, rules, scores, best matches, exclusions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinbook.operators import matching as M
from twinbook.session import cut_lineage, widened
from twinbook.sources.snapshots import SnapshotStore


def run_matcher(store: SnapshotStore, k_markets: DataFrame, p_markets: DataFrame, at: datetime) -> DataFrame:
    """Writes the best match of every liquid K market, without the excluded pairs, as the snapshot of time ``at``.

    One row comes back: markets of both venues that were looked at, candidate pairs, matches, how many of these need their
    rules read, how many are excluded, and how many pairs the snapshot has.
    """
    k, p = (cut_lineage(widened(M.liquid(M.latest_listing(x)))) for x in (k_markets, p_markets))
    kf, pf = cut_lineage(M.features(M.with_entity_k(k))), cut_lineage(M.features(M.with_entity_p(p)))
    candidates = cut_lineage(M.blocking_pairs(kf, pf))
    matches = cut_lineage(M.with_rules_check(M.best_match(M.score_pairs(M.entity_shortlist(candidates, kf, pf))), k, p))
    excluded = store.exclusions().select("k_id", "p_id")
    store.overwrite(matches, at)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [
        count(kf, "k_markets"), count(pf, "p_markets"), count(candidates, "candidates"), matches.agg(F.count("*").alias("matches"), F.count_if("rules_check").alias("needs_review")),
        count(matches.join(excluded, ["k_id", "p_id"], "left_semi"), "excluded"), count(store.pairs(), "pairs"),
    ]
    out = parts[0]
    for part in parts[1:]:  # one row each
        out = out.join(part)
    return out
