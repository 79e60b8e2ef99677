"""Record linkage by token blocking: inverted index, bounded candidate lists, rules, fuzzy scores, best match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinbook.functions import text as T
from twinbook.session import cut_lineage, widened


def latest_listing(markets: DataFrame) -> DataFrame:
    """The last listing of each market (by ``fetched_at``, then ``row_id``); rows without an id are left out."""
    order = F.struct(F.col("fetched_at"), F.col("row_id"))
    last = F.max_by(F.struct("*"), order).alias("m")
    return markets.where(F.col("market_id").isNotNull()).groupBy("market_id").agg(last).select("m.*")


def listing_counts(markets: DataFrame) -> DataFrame:
    """Rows, distinct ids and surplus rows of a catalog."""
    per = markets.groupBy("market_id").agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("raw_rows"), F.count("market_id").alias("unique_ids")).select(
        F.coalesce("raw_rows", F.lit(0)).alias("raw_rows"), "unique_ids", (F.coalesce("raw_rows", F.lit(0)) - F.col("unique_ids")).alias("duplicate_rows")
    )


def liquid(markets: DataFrame, least_total: float = 10_000.0, least_day: float = 100.0) -> DataFrame:
    """Markets with enough volume in total or of the day, or of which neither is known."""
    unknown = F.col("volume").isNull() & F.col("volume24h").isNull()
    return markets.where(unknown | (F.coalesce("volume", F.lit(0.0)) >= least_total) | (F.coalesce("volume24h", F.lit(0.0)) >= least_day))


def _given(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def ticker_suffix() -> Column:
    own = F.concat(F.col("event_ticker"), F.lit("-"))
    plain = F.substring_index("ticker", "-", -1)
    return F.when(_given("ticker").isNull(), None).when(
        _given("event_ticker").isNotNull() & F.col("ticker").startswith(own), F.substr("ticker", F.length(own) + 1)
    ).otherwise(plain)


def with_entity_k(markets: DataFrame) -> DataFrame:
    """Adds ``entity``: of events with several markets the outcome's label, else the named entity, normalized."""
    sizes = markets.where(_given("event_ticker").isNotNull()).groupBy("event_ticker").agg((F.count("*") > 1).alias("__several"))
    at = markets.join(sizes, "event_ticker", "left")
    several = F.coalesce(_given("subtitle"), _given("primary_entity_name"), ticker_suffix())
    single = F.coalesce(_given("primary_entity_name"), _given("subtitle"), F.col("name"))
    raw = F.when(F.coalesce("__several", F.lit(False)), several).otherwise(single)
    return at.withColumn("__raw", T.ascii_fold(raw)).withColumn("entity", T.normalize(F.col("__raw"))).drop("__raw", "__several")


def with_entity_p(markets: DataFrame) -> DataFrame:
    """Adds ``entity``: the named entity, else what the slug says, else, where a slug says nothing but fillers, the name."""
    slug = F.regexp_replace(F.lower("slug"), "^-+|-+$", "")
    won = F.nullif(F.regexp_extract(slug, "^will-(.+?)-win(?:-|$)", 1), F.lit(""))
    said = F.coalesce(_given("primary_entity_name"), F.regexp_replace(F.coalesce(won, F.nullif(slug, F.lit(""))), "-", " "))
    sure = _given("primary_entity_name").isNotNull() | won.isNotNull()
    at = markets.withColumns({"__said": T.ascii_fold(said), "__else": T.ascii_fold(F.coalesce(_given("name"), F.col("subtitle"))), "__sure": sure})
    entity = F.when(F.coalesce("__sure", F.lit(False)), T.normalize(F.col("__said"))).otherwise(
        F.coalesce(F.nullif(T.normalize(F.col("__said")), F.lit("")), T.normalize(F.col("__else")))
    )
    return at.withColumn("entity", entity).drop("__said", "__else", "__sure")


def token_frequency(p: DataFrame) -> DataFrame:
    """How often each token occurs in entities, repeats within one included."""
    return p.select(F.explode(F.split("entity", " ")).alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("df"))


def blocking_pairs(k: DataFrame, p: DataFrame, most_postings: int = 500, query_tokens: int = 4) -> DataFrame:
    """Pairs of ids that share one of the K entity's rarest informative tokens. The cut-off bounds each token's postings."""
    informative = token_frequency(p).where(F.col("df") <= most_postings)
    postings = p.select(F.col("market_id").alias("p_id"), F.explode(T.words(F.col("entity"))).alias("token"))
    asked = k.select(F.col("market_id").alias("k_id"), F.explode(T.words(F.col("entity"))).alias("token")).join(informative, "token")
    rarest = F.row_number().over(Window.partitionBy("k_id").orderBy("df", "token"))
    asked = asked.withColumn("i", rarest).where(F.col("i") <= query_tokens).select("k_id", "token")
    return asked.join(postings, "token").select("k_id", "p_id").distinct()


def features(markets: DataFrame) -> DataFrame:
    """Rule features of each market, computed once before any pairing."""
    name, title = F.col("name"), F.concat_ws(" ", F.col("name"), F.col("event_title"))
    return markets.select(
        "market_id", "name", "event_title", "entity",
        T.years(*[F.col(c) for c in ("name", "subtitle", "description", "ticker", "slug", "event_ticker", "expiration_datetime")]).alias("years"),
        T.years(F.col("name"), F.col("subtitle"), F.col("description")).alias("text_years"),
        T.thresholds(name).alias("thresholds"), T.numbers(name, T.STAGE).alias("stages"), T.numbers(name, T.BEFORE_YEAR).alias("before_years"),
        T.districts(name).alias("districts"), T.titles(name).alias("titles"), T.has(name, T.MARGIN).alias("margin"),
        T.has(name, T.CAMPAIGN).alias("campaign"), T.has(name, T.NOMINATION_WIN).alias("nomination_win"), T.has(name, T.BALLOT).alias("ballot"),
        T.has(name, T.ELECTION_WIN).alias("election_win"), T.phases(title, F.col("description")).alias("phases"),
        T.ascii_fold(name).alias("folded_name"), T.ascii_fold(F.col("event_title")).alias("folded_title"),
    )


def _both(c: str) -> Column:
    return (F.size(f"k.{c}") == 0) | (F.size(f"p.{c}") == 0) | (F.col(f"k.{c}") == F.col(f"p.{c}"))


def near_years() -> Column:
    """True unless both sides name years and none are within one of each other."""
    close = F.exists("k.years", lambda x: F.exists("p.years", lambda y: F.abs(x - y) <= 1))
    return (F.size("k.years") == 0) | (F.size("p.years") == 0) | close


def compatible() -> Column:
    """The rules on two feature structs ``k`` and ``p``, cheap ones first."""
    k, p = (lambda c: F.col(f"k.{c}")), (lambda c: F.col(f"p.{c}"))
    entry = (k("campaign") & ~k("nomination_win") & p("nomination_win") & ~p("campaign")) | (p("campaign") & ~p("nomination_win") & k("nomination_win") & ~k("campaign"))
    ballot = (k("ballot") & p("election_win") & ~p("ballot")) | (p("ballot") & k("election_win") & ~k("ballot"))
    titles = (F.size("k.titles") == 0) | (F.size("p.titles") == 0) | (F.array_sort("k.titles") == F.array_sort("p.titles"))
    return (
        (k("margin") == p("margin")) & (k("stages") == p("stages")) & (k("phases") == p("phases")) & _both("thresholds") & _both("before_years")
        & _both("districts") & titles & ~entry & ~ballot
    )


def entity_shortlist(pairs: DataFrame, k: DataFrame, p: DataFrame, most: int = 150) -> DataFrame:
    """Per K market the pairs of best entity overlap (ties: closer lengths, then id); both sides' features as ``k`` and ``p``.

    Only ids and words are ranked; the features join what is left.
    """
    of = lambda m, i, w: m.select(F.col("market_id").alias(i), T.words(F.col("entity")).alias(w))
    at = pairs.join(of(k, "k_id", "__a"), "k_id").join(of(p, "p_id", "__b"), "p_id")
    a, b = F.col("__a"), F.col("__b")
    at = at.select("k_id", "p_id", (F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b), F.lit(1))).alias("overlap"), F.abs(F.size(a) - F.size(b)).alias("apart"))
    rank = F.row_number().over(Window.partitionBy("k_id").orderBy(F.desc("overlap"), "apart", "p_id"))
    at = at.withColumn("rank", rank).where(F.col("rank") <= most)
    return at.join(k.select(F.col("market_id").alias("k_id"), F.struct("*").alias("k")), "k_id").join(p.select(F.col("market_id").alias("p_id"), F.struct("*").alias("p")), "p_id")


def with_phrases(shortlist: DataFrame) -> DataFrame:
    """Adds the phrases ``k_phrase`` and ``p_phrase`` and their word overlap ``phrase_overlap``."""
    shared = F.array_intersect(T.words(F.col("k.entity")), T.words(F.col("p.entity")))
    at = shortlist.withColumn("shared", shared)
    at = at.withColumns({s + "_phrase": T.phrase(F.col(f"{s}.folded_name"), F.col(f"{s}.folded_title"), F.col("shared")) for s in ("k", "p")})
    return at.withColumn("phrase_overlap", T.overlap(T.words(F.col("k_phrase")), T.words(F.col("p_phrase"))))


def score_pairs(shortlist: DataFrame, phrase_most: int = 25, most: int = 10) -> DataFrame:
    """Fuzzy scores of rule-checked pairs: per K market the ``phrase_most`` best by overlap, of these the ``most`` best by phrase.

    ``confidence`` is 0.70 of the phrase and 0.30 of the entity similarity, with years that agree or differ adding 0.02 or
    taking 0.05, between 0 and 0.99. Entities are compared only where the overlap may be among the best (ties included).
    """
    signal = F.when((F.size("k.text_years") == 0) | (F.size("p.text_years") == 0), 0.0).when(F.arrays_overlap("k.text_years", "p.text_years"), 0.02).otherwise(-0.05)
    at = cut_lineage(with_phrases(widened(shortlist.where(near_years() & compatible()), "k_id")).select(
        "k_id", "p_id", F.col("k.entity").alias("k_entity"), F.col("p.entity").alias("p_entity"), "k_phrase", "p_phrase", "phrase_overlap", signal.alias("signal")
    ))
    tied = F.rank().over(Window.partitionBy("k_id").orderBy(F.desc("phrase_overlap")))
    at = widened(at.withColumn("i", tied).where(F.col("i") <= phrase_most), "k_id").withColumn("entity_ratio", T.best_ratio("k_entity", "p_entity"))
    a, b = T.words(F.col("k_entity")), T.words(F.col("p_entity"))
    union = F.size(F.array_union(a, b))
    at = at.withColumn("entity_similarity", 0.65 * F.col("entity_ratio") + 0.35 * F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union))
    first = F.row_number().over(Window.partitionBy("k_id").orderBy(F.desc("phrase_overlap"), F.desc("entity_similarity"), "p_id"))
    at = widened(cut_lineage(at.withColumn("i", first).where(F.col("i") <= phrase_most)), "k_id").withColumn("phrase_ratio", T.best_ratio("k_phrase", "p_phrase"))
    empty = (F.col("k_phrase") == "") | (F.col("p_phrase") == "")
    at = at.withColumn("phrase_similarity", F.when(empty, 0.0).otherwise(0.75 * F.col("phrase_overlap") + 0.25 * F.col("phrase_ratio")))
    second = F.row_number().over(Window.partitionBy("k_id").orderBy(F.desc("phrase_similarity"), F.desc("entity_similarity"), "p_id"))
    score = F.least(F.greatest(0.7 * F.col("phrase_similarity") + 0.3 * F.col("entity_similarity") + F.col("signal"), F.lit(0.0)), F.lit(0.99))
    return at.withColumn("i", second).where(F.col("i") <= most).select("k_id", "p_id", "k_phrase", "p_phrase", "phrase_similarity", "entity_similarity", score.alias("confidence"))


def best_match(scored: DataFrame) -> DataFrame:
    """The most confident pair of each K market; ties go to the smaller P id."""
    first = F.row_number().over(Window.partitionBy("k_id").orderBy(F.desc("confidence"), "p_id"))
    return scored.withColumn("i", first).where("i = 1").drop("i")


def without(pairs: DataFrame, excluded: DataFrame) -> DataFrame:
    """Pairs that are not excluded."""
    return pairs.join(excluded.select("k_id", "p_id").distinct(), ["k_id", "p_id"], "left_anti")


def most_confident(matches: DataFrame, most: int = 20) -> DataFrame:
    """The ``most`` matches of highest confidence; ties go to the smaller ids."""
    return matches.orderBy(F.desc("confidence"), "k_id", "p_id").limit(most)


def _outcome() -> Column:
    """The outcome's entity as written: the named one, the label, what the slug says of a win, or the name."""
    won = F.nullif(F.regexp_replace(F.regexp_extract("slug", "(?i)^will-(.+?)-win(?:-|$)", 1), "-", " "), F.lit(""))
    return F.coalesce(_given("primary_entity_name"), _given("subtitle"), won, F.col("name"), F.lit(""))


def with_rules_check(pairs: DataFrame, k: DataFrame, p: DataFrame) -> DataFrame:
    """Adds ``rules_check``: one side's outcome is a couple, pair or duo and the other's is a single one, so the rules need a reader."""
    def side(markets: DataFrame, i: str, s: str) -> DataFrame:
        several = T.has(_outcome(), T.SEVERAL)
        pair = several & T.has(F.concat_ws(" ", _given("name"), _given("event_title")), T.PAIR_CONTEXT)
        return markets.select(F.col("market_id").alias(i), pair.alias(f"__{s}_pair"), (~several & (_outcome() != "")).alias(f"__{s}_single"))

    at = pairs.join(side(k, "k_id", "k"), "k_id").join(side(p, "p_id", "p"), "p_id")
    check = (F.col("__k_pair") & F.col("__p_single")) | (F.col("__p_pair") & F.col("__k_single"))
    return at.select(*pairs.columns, check.alias("rules_check"))


def misses(labels: DataFrame, k: DataFrame, p: DataFrame, candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """Labelled matches that are not found, the K market's best match as ``predicted`` (null where the pair is no candidate), and the first
    ``reason`` that holds: ``absent`` (a market is not in the catalogs), ``no candidate``, ``no match`` (rules and limits left none), ``other match``."""
    true = labels.where("is_match").select("k_id", "p_id")
    known = lambda m, i: m.select(F.col("market_id").alias(i), F.lit(True).alias(f"has_{i}")).distinct()
    at = true.join(known(k, "k_id"), "k_id", "left").join(known(p, "p_id"), "p_id", "left").join(
        candidates.select("k_id", "p_id", F.lit(True).alias("c")).distinct(), ["k_id", "p_id"], "left"
    ).join(matches.select("k_id", F.col("p_id").alias("best")), "k_id", "left")
    reason = (
        F.when(F.col("has_k_id").isNull() | F.col("has_p_id").isNull(), "absent").when(F.col("c").isNull(), "no candidate")
        .when(F.col("best").isNull(), "no match").when(F.col("best") != F.col("p_id"), "other match")
    )
    return at.select("k_id", "p_id", F.when(F.col("c"), F.col("best")).alias("predicted"), reason.alias("reason")).where("reason IS NOT NULL")


def validation(labels: DataFrame, candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """One row on the labelled matches: how many are candidates, how many of these have a best match of their K market (``predicted``),
    and how many are it. ``recall`` is of all labelled, ``precision`` of the predicted; ``wrong`` counts best matches that are
    labelled false."""
    marked = labels.join(candidates.select("k_id", "p_id", F.lit(True).alias("c")).distinct(), ["k_id", "p_id"], "left").join(
        matches.select("k_id", F.col("p_id").alias("best")).distinct(), "k_id", "left"
    )
    true, found, right = F.col("is_match"), F.col("is_match") & F.col("c"), F.col("best") == F.col("p_id")
    counts = marked.agg(
        F.count_if(true).alias("labelled"), F.count_if(found).alias("as_candidate"), F.count_if(found & F.col("best").isNotNull()).alias("predicted"),
        F.count_if(found & right).alias("as_match"), F.count_if(~true & right).alias("wrong"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0)).alias
    return counts.select("*", share("as_candidate", "labelled")("candidate_recall"), share("as_match", "labelled")("recall"), share("as_match", "predicted")("precision"))


def event_key() -> Column:
    """What groups markets of one event: its ticker, else title and expiration, else the market itself."""
    return F.coalesce(
        F.concat(F.lit("ticker:"), _given("event_ticker")), F.concat(F.lit("title:"), _given("event_title"), F.lit("|"), F.coalesce("expiration_datetime", F.lit(""))),
        F.concat(F.lit("market:"), F.col("market_id")),
    )


def pairs_of_markets(pairs: DataFrame) -> DataFrame:
    """One row per market and pair that it is in, all pairs kept: ``market_id``, ``side``, ``k_id``, ``p_id``."""
    sides = F.inline(F.array(F.struct(F.col("k_id").alias("market_id"), F.lit("K").alias("side")), F.struct(F.col("p_id").alias("market_id"), F.lit("P").alias("side"))))
    return pairs.select("k_id", "p_id", sides).distinct()


def with_metadata(pairs: DataFrame, markets: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs with ``columns`` of both sides' markets as ``k_<column>`` and ``p_<column>``, null where a market is unknown."""
    of = lambda s: markets.select(F.col("market_id").alias(f"{s}_id"), *[F.col(c).alias(f"{s}_{c}") for c in columns])
    return pairs.join(of("k"), "k_id", "left").join(of("p"), "p_id", "left")
