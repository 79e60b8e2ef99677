"""Queries on the venue catalogs and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinbook.functions import text as T
from twinbook.operators import matching as M
from twinbook.operators.instants import with_instant
from twinbook.operators.views import contract_link
from twinbook.sources.catalogs import envelope_rows, parse_k, parse_p
from twinbook.plans.instant_sql import instants
from twinbook.session import cut_lineage, widened
from twinbook.sources.tables import table


def _k(spark: SparkSession, sf: str) -> DataFrame:
    return M.latest_listing(table(spark, sf, "k_markets"))


def _p(spark: SparkSession, sf: str) -> DataFrame:
    return M.latest_listing(table(spark, sf, "p_markets"))


def _all(spark: SparkSession, sf: str) -> DataFrame:
    return _k(spark, sf).unionByName(_p(spark, sf))


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pair_labels").toDF("k_id", "p_id", "is_match")


def dedup_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return _all(spark, sf).select("exchange_name", "market_id", "row_id", "name", "status")


def catalog_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return M.listing_counts(table(spark, sf, "k_markets")).withColumn("venue", F.lit("K")).unionByName(
        M.listing_counts(table(spark, sf, "p_markets")).withColumn("venue", F.lit("P"))
    )


def liquid_markets(spark: SparkSession, sf: str) -> DataFrame:
    return M.liquid(_all(spark, sf)).select("exchange_name", "market_id", "volume", "volume24h")


def shrink_metrics(spark: SparkSession, sf: str) -> DataFrame:
    kept = M.liquid(_all(spark, sf)).groupBy("exchange_name").agg(F.count("*").alias("liquid"))
    every = _all(spark, sf).groupBy("exchange_name").agg(F.count("*").alias("total"))
    at = every.join(kept, "exchange_name", "left").withColumn("liquid", F.coalesce("liquid", F.lit(0)))
    return at.withColumn("shrink", F.round(1 - F.try_divide(F.col("liquid").cast("double"), F.col("total").cast("double")), 9))


def discover_top(spark: SparkSession, sf: str, most: int = 20) -> DataFrame:
    order = [F.coalesce("volume", F.lit(0.0)).desc(), F.coalesce("volume24h", F.lit(0.0)).desc(), F.col("market_id")]
    return _all(spark, sf).select("exchange_name", "market_id", "volume", "volume24h").orderBy(*order).limit(most)


def normalize_titles(spark: SparkSession, sf: str) -> DataFrame:
    at = _all(spark, sf).select("exchange_name", "market_id", T.ascii_fold("name").alias("f"))
    return at.select("exchange_name", "market_id", T.normalize(F.col("f")).alias("normalized"))


def title_numbers(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("name")
    found = {"thresholds": T.thresholds(name), "stages": T.numbers(name, T.STAGE), "before_years": T.numbers(name, T.BEFORE_YEAR), "districts": T.districts(name)}
    return _all(spark, sf).select("exchange_name", "market_id", *[F.array_join(v.cast("array<string>"), ",").alias(k) for k, v in found.items()])


def title_rules(spark: SparkSession, sf: str) -> DataFrame:
    name, context = F.col("name"), F.concat_ws(" ", F.col("name"), F.col("event_title"))
    return _all(spark, sf).select(
        "exchange_name", "market_id", T.has(name, T.MARGIN).alias("margin"), T.has(name, T.CAMPAIGN).alias("campaign"),
        T.has(name, T.NOMINATION_WIN).alias("nomination_win"), T.has(name, T.BALLOT).alias("ballot"), T.has(name, T.ELECTION_WIN).alias("election_win"),
        F.array_join(T.titles(name), ",").alias("titles"), F.array_join(T.phases(context, F.col("description")), ",").alias("phases"),
    )


def entity_extract(spark: SparkSession, sf: str) -> DataFrame:
    k = M.with_entity_k(_k(spark, sf)).select("exchange_name", "market_id", "entity", M.ticker_suffix().alias("suffix"))
    p = M.with_entity_p(_p(spark, sf)).select("exchange_name", "market_id", "entity", F.lit(None).cast("string").alias("suffix"))
    return k.unionByName(p)


_YEAR_FIELDS = ("name", "subtitle", "description", "ticker", "slug", "event_ticker", "expiration_datetime")


def market_years(spark: SparkSession, sf: str) -> DataFrame:
    return _all(spark, sf).select("exchange_name", "market_id", F.array_join(T.years(*[F.col(c) for c in _YEAR_FIELDS]).cast("array<string>"), ",").alias("years"))


def token_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return M.token_frequency(M.with_entity_p(_p(spark, sf)))


def blocking_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return M.blocking_pairs(M.with_entity_k(_k(spark, sf)), M.with_entity_p(_p(spark, sf)))


def _shortlist(spark: SparkSession, sf: str) -> DataFrame:
    k, p = (cut_lineage(M.features(x)) for x in (M.with_entity_k(widened(_k(spark, sf))), M.with_entity_p(widened(_p(spark, sf)))))
    return M.entity_shortlist(M.blocking_pairs(k, p), k, p)


def entity_prefilter(spark: SparkSession, sf: str) -> DataFrame:
    return _shortlist(spark, sf).select("k_id", "p_id", F.round("overlap", 9).alias("overlap"), F.col("rank").cast("long").alias("rank"))


def rule_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _shortlist(spark, sf).where(M.near_years() & M.compatible()).select("k_id", "p_id")


def phrase_overlap(spark: SparkSession, sf: str) -> DataFrame:
    at = M.with_phrases(_shortlist(spark, sf))
    return at.select("k_id", "p_id", "k_phrase", "p_phrase", F.round("phrase_overlap", 9).alias("phrase_overlap"))


def fuzzy_scores(spark: SparkSession, sf: str) -> DataFrame:
    return M.score_pairs(_shortlist(spark, sf))


def best_match(spark: SparkSession, sf: str) -> DataFrame:
    return M.best_match(fuzzy_scores(spark, sf))


def snapshot_minus_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    labels = _labels(spark, sf)
    return M.without(labels.select("k_id", "p_id"), labels.where("NOT is_match"))


def summary_top(spark: SparkSession, sf: str) -> DataFrame:
    return M.most_confident(best_match(spark, sf)).select("k_id", "p_id", "confidence", "phrase_similarity", "entity_similarity")


def rules_check(spark: SparkSession, sf: str) -> DataFrame:
    return M.with_rules_check(best_match(spark, sf).select("k_id", "p_id"), _k(spark, sf), _p(spark, sf))


def _judged(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels, candidates and best matches of the labelled K markets: matching is per K market, so only these are paired, with all P
    markets; entities and frequencies are of the whole tables."""
    labels = _labels(spark, sf)
    k = cut_lineage(M.features(M.with_entity_k(_k(spark, sf)).join(labels.select(F.col("k_id").alias("market_id")).distinct(), "market_id", "left_semi")))
    p = cut_lineage(M.features(M.with_entity_p(_p(spark, sf))))
    pairs = M.blocking_pairs(k, p)
    matches = M.best_match(M.score_pairs(M.entity_shortlist(pairs, k, p)))
    return labels, pairs, matches


def validation_report(spark: SparkSession, sf: str) -> DataFrame:
    return M.validation(*_judged(spark, sf))


def validation_misses(spark: SparkSession, sf: str) -> DataFrame:
    labels, pairs, matches = _judged(spark, sf)
    return M.misses(labels, _k(spark, sf), _p(spark, sf), pairs, matches)


def expiration_mismatch(spark: SparkSession, sf: str, most_days: float = 30.0) -> DataFrame:
    feeds = table(spark, sf, "feeds")
    k, p = (with_instant(f(spark, sf), "expiration_datetime", feeds, c).select(F.col("market_id").alias(i), c) for f, i, c in ((_k, "k_id", "ke"), (_p, "p_id", "pe")))
    at = _labels(spark, sf).join(k, "k_id").join(p, "p_id")
    apart = F.abs(F.col("ke") - F.col("pe")) / 86_400_000_000
    return at.select("k_id", "p_id", F.coalesce("pe", "ke").alias("ends_us"), F.coalesce(apart > most_days, F.lit(False)).alias("mismatch"))


def expiration_mismatch_count(spark: SparkSession, sf: str) -> DataFrame:
    return expiration_mismatch(spark, sf).agg(F.count_if("mismatch").alias("mismatches"), F.count("*").alias("pairs"))


def event_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _all(spark, sf).groupBy("exchange_name", M.event_key().alias("event_key")).agg(F.count("*").alias("markets"))


def pair_multimap(spark: SparkSession, sf: str) -> DataFrame:
    return M.pairs_of_markets(_labels(spark, sf))


def pair_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return M.with_metadata(_labels(spark, sf).select("k_id", "p_id"), _all(spark, sf), ["name", "status", "volume", "volume24h", "event_ticker"])


def contract_links(spark: SparkSession, sf: str) -> DataFrame:
    return _all(spark, sf).select("exchange_name", "market_id", contract_link(F.lit("https://k.example/markets/"), F.lit("https://p.example/event/")).alias("link"))


def envelope_parse(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.struct(
        F.col("market_id").alias("ticker"), F.col("name").alias("title"), F.col("subtitle").alias("yes_sub_title"), F.col("description").alias("rules_primary"),
        "category", "event_ticker", F.struct(F.col("volume").cast("string").alias("value")).alias("volume"), F.col("volume24h").cast("string").alias("volume_24h_fp"), "event_title", "status",
    )
    payload = F.to_json(F.struct(F.struct(F.array(raw).alias("markets")).alias("data")))
    pages = _k(spark, sf).select("row_id", payload.alias("payload"))
    return parse_k(envelope_rows(pages, "payload", "markets", "data")).select("row_id", "market_id", "name", "subtitle", "description", "category", "volume", "volume24h", "status")


def envelope_parse_p(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.struct(
        F.col("slug").alias("slug"), F.col("name").alias("question"), F.col("primary_entity_name").alias("participantName"), "description", "category",
        F.col("event_ticker").alias("eventSlug"), F.struct(F.col("volume").cast("string").alias("amount")).alias("volume"), F.col("volume24h").alias("volume24hr"), "status",
    )
    payload = F.to_json(F.struct(F.array(raw).alias("results")))
    pages = _p(spark, sf).select("row_id", payload.alias("payload"))
    return parse_p(envelope_rows(pages, "payload", "markets", "data", "results")).select("row_id", "market_id", "name", "description", "category", "primary_entity_name", "event_ticker", "volume", "volume24h", "status")


def multi_get(spark: SparkSession, sf: str) -> DataFrame:
    return _k(spark, sf).join(_labels(spark, sf), F.col("market_id") == F.col("k_id"), "left_semi").select("market_id", "row_id", "name", "volume")


QUERIES = {
    f.__name__: f
    for f in (
        dedup_catalog, catalog_coverage, liquid_markets, shrink_metrics, discover_top, normalize_titles, title_numbers, title_rules, entity_extract,
        market_years, token_frequency, blocking_candidates, entity_prefilter, rule_filter, phrase_overlap, fuzzy_scores, best_match,
        summary_top, rules_check, snapshot_minus_exclusions, validation_report, validation_misses, expiration_mismatch, expiration_mismatch_count,
        event_keys, pair_multimap, pair_metadata, contract_links, envelope_parse, envelope_parse_p, multi_get,
    )
}

_LATEST = """
  k AS (SELECT * FROM k_markets WHERE market_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY market_id ORDER BY fetched_at DESC NULLS LAST, row_id DESC) = 1),
  p AS (SELECT * FROM p_markets WHERE market_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY market_id ORDER BY fetched_at DESC NULLS LAST, row_id DESC) = 1),
  m AS (SELECT * FROM k UNION ALL BY NAME SELECT * FROM p)"""
_FILL = "[" + ", ".join(f"'{w}'" for w in T.FILLERS) + "]"
_PFILL = "[" + ", ".join(f"'{w}'" for w in T.PHRASE_FILLERS) + "]"


def _fold(x: str) -> str:
    return f"regexp_replace(strip_accents(replace({x}, chr(160), ' ')), '[^\\x00-\\x7F]', '', 'g')"


def _tokens(x: str) -> str:
    return f"regexp_extract_all(lower({_fold(x)}), '[a-z0-9]+')"


def _normal(x: str) -> str:
    return f"coalesce(array_to_string(list_filter({_tokens(x)}, lambda t: NOT list_contains({_FILL}, t)), ' '), '')"


def _has(x: str, pattern: str) -> str:
    return "coalesce(regexp_matches(" + x + ", '(?i)" + pattern.replace("'", "''") + "'), false)"


def _nums(x: str, pattern: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '(?i){pattern}', 1), lambda v: CAST(v AS INTEGER))"


def _joined(x: str) -> str:
    return f"coalesce(array_to_string({x}, ','), '')"


_YEARS = f"list_sort(list_distinct(list_transform(regexp_extract_all(concat_ws(' ', {', '.join(_YEAR_FIELDS)}), '{T.YEAR}'), lambda v: CAST(v AS INTEGER))))"
_ENTITY = f"""{_LATEST},
  s AS (SELECT event_ticker, count(*) > 1 AS several FROM k WHERE nullif(event_ticker, '') IS NOT NULL GROUP BY 1),
  kx AS (SELECT k.*, coalesce(s.several, false) AS several,
         CASE WHEN nullif(ticker, '') IS NULL THEN NULL WHEN nullif(k.event_ticker, '') IS NOT NULL AND starts_with(ticker, k.event_ticker || '-') THEN substr(ticker, length(k.event_ticker) + 2)
              ELSE split_part(ticker, '-', -1) END AS suffix FROM k LEFT JOIN s ON k.event_ticker = s.event_ticker),
  ke AS (SELECT *, {_normal("CASE WHEN several THEN coalesce(nullif(subtitle, ''), nullif(primary_entity_name, ''), suffix) ELSE coalesce(nullif(primary_entity_name, ''), nullif(subtitle, ''), name) END")} AS entity FROM kx),
  ps AS (SELECT *, regexp_replace(lower(slug), '^-+|-+$', '', 'g') AS sl FROM p),
  pw AS (SELECT *, nullif(regexp_extract(sl, '^will-(.+?)-win(?:-|$)', 1), '') AS won FROM ps),
  pe AS (SELECT *, CASE WHEN nullif(primary_entity_name, '') IS NOT NULL THEN {_normal("primary_entity_name")} WHEN won IS NOT NULL THEN {_normal("replace(won, '-', ' ')")}
         ELSE coalesce(nullif({_normal("replace(sl, '-', ' ')")}, ''), {_normal("coalesce(nullif(name, ''), subtitle)")}) END AS entity FROM pw)"""
_WORDS = "list_distinct(list_filter(string_split({0}, ' '), lambda t: t <> ''))"
_BLOCK = f"""{_ENTITY},
  df AS (SELECT token, count(*) AS df FROM (SELECT unnest(string_split(entity, ' ')) AS token FROM pe) WHERE token <> '' GROUP BY 1),
  q AS (SELECT market_id AS k_id, unnest({_WORDS.format("entity")}) AS token FROM ke),
  r AS (SELECT k_id, q.token FROM q JOIN df ON q.token = df.token WHERE df <= 500 QUALIFY row_number() OVER (PARTITION BY k_id ORDER BY df, q.token) <= 4),
  b AS (SELECT DISTINCT k_id, p_id FROM r JOIN (SELECT market_id AS p_id, unnest({_WORDS.format("entity")}) AS token FROM pe) t ON r.token = t.token)"""
_PREFILTER = f"""{_BLOCK},
  f AS (SELECT k_id, p_id, len(list_intersect(a, c)) / greatest(len(a), len(c), 1) AS o, abs(len(a) - len(c)) AS d, a, c, kname, ktitle, pname, ptitle
        FROM (SELECT b.*, {_WORDS.format("ke.entity")} AS a, {_WORDS.format("pe.entity")} AS c, ke.name AS kname, ke.event_title AS ktitle, pe.name AS pname, pe.event_title AS ptitle
              FROM b JOIN ke ON ke.market_id = k_id JOIN pe ON pe.market_id = p_id)),
  g AS (SELECT *, row_number() OVER (PARTITION BY k_id ORDER BY o DESC, d, p_id) AS rank FROM f QUALIFY rank <= 150)"""


def _kept(x: str) -> str:
    return f"array_to_string(list_filter(coalesce({_tokens(x)}, []), lambda t: NOT list_contains(sh, t) AND NOT list_contains({_PFILL}, t) AND NOT regexp_matches(t, '^(?:19|20)[0-9]{{2}}$')), ' ')"


def _in_sentences(pattern: str) -> str:
    return f"coalesce(len(list_filter(sentences, lambda x: regexp_matches(x, '(?i){pattern}'))) > 0, false)"


_SENTENCES = f"list_filter(regexp_extract_all(coalesce(description, ''), '(?i){T.RESOLUTION}', 1), lambda x: regexp_matches(x, '(?i){T.ELECTION_CONTEXT}'))"
_PHASES = "coalesce(array_to_string([" + ", ".join(
    f"CASE WHEN {_has('cx', p)} OR {_in_sentences(p)}" + (f" OR ({_has('cx', T.NOMINATION)} AND {_has('cx', T.ELECTION_CONTEXT)})" if k == "primary" else "") + f" THEN '{k}' END" for k, p in T.PHASES.items()
) + "], ','), '')"
_FLAGS = ", ".join(f"{_has('name', getattr(T, p.upper()))} AS {p}" for p in ("margin", "campaign", "nomination_win", "ballot", "election_win"))
_TITLES = "coalesce(array_to_string([" + ", ".join(f"CASE WHEN {_has('name', p)} THEN '{k}' END" for k, p in T.TITLES.items()) + "], ','), '')"
_THRESHOLDS = _joined("flatten([" + ", ".join(_nums("name", p) for p in T.THRESHOLDS) + "])")
_DISTRICTS = _joined(f"list_transform(regexp_extract_all(name, '(?i){T.DISTRICT}', 1), lambda x: upper(substr(x, 1, 3)) || regexp_extract(x, '-0?([0-9]+)$', 1))")
_RULES = f"""{_PREFILTER},
  fx AS (SELECT *, concat_ws(' ', name, event_title) AS cx, {_SENTENCES} AS sentences FROM (SELECT * EXCLUDE (several, suffix, entity) FROM ke UNION ALL BY NAME SELECT * EXCLUDE (sl, won, entity) FROM pe)),
  ft AS (SELECT market_id, {_FLAGS}, {_TITLES} AS titles, {_PHASES} AS phases, {_THRESHOLDS} AS thresholds, {_joined(_nums('name', T.STAGE))} AS stages, {_joined(_nums('name', T.BEFORE_YEAR))} AS before_years, {_DISTRICTS} AS districts, {_YEARS} AS years FROM fx)"""
_BOTH = lambda c: f"(k.{c} = '' OR p.{c} = '' OR k.{c} = p.{c})"
_EXPIRATIONS = f"""{_LATEST}, {instants("ik", "k", "b.expiration_datetime", "b.market_id")}, {instants("ip", "p", "b.expiration_datetime", "b.market_id")},
  w AS (SELECT k_market_id AS k_id, p_market_id AS p_id, coalesce(b.utc_us, a.utc_us) AS ends_us, coalesce(abs(a.utc_us - b.utc_us) / 86400000000 > 30, false) AS mismatch
        FROM pair_labels JOIN k ON k.market_id = k_market_id JOIN p ON p.market_id = p_market_id LEFT JOIN ik a ON a.market_id = k_market_id LEFT JOIN ip b ON b.market_id = p_market_id)"""
SQL = {
    "dedup_catalog": f"WITH {_LATEST} SELECT exchange_name, market_id, row_id, name, status FROM m",
    "catalog_coverage": """SELECT 'K' AS venue, count(*) AS raw_rows, count(DISTINCT market_id) AS unique_ids, count(*) - count(DISTINCT market_id) AS duplicate_rows FROM k_markets
        UNION ALL SELECT 'P', count(*), count(DISTINCT market_id), count(*) - count(DISTINCT market_id) FROM p_markets""",
    "liquid_markets": f"""WITH {_LATEST} SELECT exchange_name, market_id, volume, volume24h FROM m
        WHERE (volume IS NULL AND volume24h IS NULL) OR coalesce(volume, 0) >= 10000 OR coalesce(volume24h, 0) >= 100""",
    "shrink_metrics": f"""WITH {_LATEST}, f AS (SELECT exchange_name, ((volume IS NULL AND volume24h IS NULL) OR coalesce(volume, 0) >= 10000 OR coalesce(volume24h, 0) >= 100) AS ok FROM m)
        SELECT exchange_name, count(*) AS total, count(*) FILTER (WHERE ok) AS liquid, round(1 - count(*) FILTER (WHERE ok) / count(*), 9) AS shrink FROM f GROUP BY 1""",
    "discover_top": f"WITH {_LATEST} SELECT exchange_name, market_id, volume, volume24h FROM m ORDER BY coalesce(volume, 0) DESC, coalesce(volume24h, 0) DESC, market_id LIMIT 20",
    "normalize_titles": f"WITH {_LATEST} SELECT exchange_name, market_id, {_normal('name')} AS normalized FROM m",
    "title_numbers": f"""WITH {_LATEST} SELECT exchange_name, market_id, {_THRESHOLDS} AS thresholds,
        {_joined(_nums('name', T.STAGE))} AS stages, {_joined(_nums('name', T.BEFORE_YEAR))} AS before_years, {_DISTRICTS} AS districts FROM m""",
    "title_rules": f"""WITH {_LATEST}, x AS (SELECT *, concat_ws(' ', name, event_title) AS cx, {_SENTENCES} AS sentences FROM m) SELECT exchange_name, market_id, {_FLAGS}, {_TITLES} AS titles, {_PHASES} AS phases FROM x""",
    "rule_filter": f"""WITH {_RULES} SELECT k_id, p_id FROM g JOIN ft k ON k.market_id = k_id JOIN ft p ON p.market_id = p_id
        WHERE (len(k.years) = 0 OR len(p.years) = 0 OR len(list_filter(k.years, lambda x: len(list_filter(p.years, lambda y: abs(x - y) <= 1)) > 0)) > 0)
        AND k.margin = p.margin AND k.stages = p.stages AND k.phases = p.phases AND {_BOTH('thresholds')} AND {_BOTH('before_years')} AND {_BOTH('districts')} AND {_BOTH('titles')}
        AND NOT ((k.campaign AND NOT k.nomination_win AND p.nomination_win AND NOT p.campaign) OR (p.campaign AND NOT p.nomination_win AND k.nomination_win AND NOT k.campaign))
        AND NOT ((k.ballot AND p.election_win AND NOT p.ballot) OR (p.ballot AND k.election_win AND NOT k.ballot))""",
    "event_keys": f"""WITH {_LATEST} SELECT exchange_name, coalesce('ticker:' || nullif(event_ticker, ''), 'title:' || nullif(event_title, '') || '|' || coalesce(expiration_datetime, ''), 'market:' || market_id) AS event_key, count(*) AS markets FROM m GROUP BY 1, 2""",
    "pair_multimap": """SELECT DISTINCT k_market_id AS k_id, p_market_id AS p_id, k_market_id AS market_id, 'K' AS side FROM pair_labels UNION ALL SELECT DISTINCT k_market_id, p_market_id, p_market_id, 'P' FROM pair_labels""",
    "pair_metadata": f"""WITH {_LATEST} SELECT k_market_id AS k_id, p_market_id AS p_id, a.name AS k_name, a.status AS k_status, a.volume AS k_volume, a.volume24h AS k_volume24h, a.event_ticker AS k_event_ticker,
        b.name AS p_name, b.status AS p_status, b.volume AS p_volume, b.volume24h AS p_volume24h, b.event_ticker AS p_event_ticker FROM pair_labels LEFT JOIN m a ON a.market_id = k_market_id LEFT JOIN m b ON b.market_id = p_market_id""",
    "entity_extract": f"WITH {_ENTITY} SELECT exchange_name, market_id, entity, suffix FROM ke UNION ALL SELECT exchange_name, market_id, entity, NULL FROM pe",
    "market_years": f"WITH {_LATEST} SELECT exchange_name, market_id, {_joined(_YEARS)} AS years FROM m",
    "token_frequency": f"WITH {_BLOCK} SELECT token, df FROM df",
    "blocking_candidates": f"WITH {_BLOCK} SELECT k_id, p_id FROM b",
    "entity_prefilter": f"WITH {_PREFILTER} SELECT k_id, p_id, round(o, 9) AS overlap, rank FROM g",
    "phrase_overlap": f"""WITH {_PREFILTER}, h AS (SELECT *, list_intersect(a, c) AS sh FROM g),
        i AS (SELECT k_id, p_id, coalesce(nullif({_kept('kname')}, ''), {_kept('ktitle')}) AS k_phrase, coalesce(nullif({_kept('pname')}, ''), {_kept('ptitle')}) AS p_phrase FROM h),
        j AS (SELECT *, {_WORDS.format('k_phrase')} AS x, {_WORDS.format('p_phrase')} AS y FROM i)
        SELECT k_id, p_id, k_phrase, p_phrase, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE round(len(list_intersect(x, y)) / greatest(len(x), len(y)), 9) END AS phrase_overlap FROM j""",
    "snapshot_minus_exclusions": "SELECT k_market_id AS k_id, p_market_id AS p_id FROM pair_labels l WHERE NOT EXISTS (SELECT 1 FROM pair_labels x WHERE NOT x.is_match AND x.k_market_id = l.k_market_id AND x.p_market_id = l.p_market_id)",
    "expiration_mismatch": f"WITH {_EXPIRATIONS} SELECT k_id, p_id, ends_us, mismatch FROM w",
    "expiration_mismatch_count": f"WITH {_EXPIRATIONS} SELECT count(*) FILTER (WHERE mismatch) AS mismatches, count(*) AS pairs FROM w",
    "envelope_parse_p": f"""WITH {_LATEST}, x AS (SELECT *, nullif(primary_entity_name, '') AS o, coalesce(name, slug) AS q, nullif(description, '') AS de FROM p WHERE slug IS NOT NULL)
        SELECT row_id, slug AS market_id, CASE WHEN o IS NOT NULL AND NOT contains(lower(q), lower(o)) THEN coalesce(nullif(trim(regexp_extract(de, '^((?s:.)*?[.!?])(?:\\s+|$)', 1), ' '), ''), nullif(trim(de, ' '), ''), q || ': ' || o) ELSE q END AS name,
               de AS description, coalesce(category, 'Other') AS category, o AS primary_entity_name, nullif(event_ticker, '') AS event_ticker, volume, volume24h, nullif(status, '') AS status FROM x""",
    "envelope_parse": f"""WITH {_LATEST} SELECT row_id, market_id, coalesce(name, subtitle, market_id) AS name, nullif(subtitle, '') AS subtitle, nullif(description, '') AS description, coalesce(category, 'Other') AS category, volume, volume24h, nullif(status, '') AS status FROM k""",
    "multi_get": f"WITH {_LATEST} SELECT market_id, row_id, name, volume FROM k WHERE market_id IN (SELECT k_market_id FROM pair_labels)",
    "contract_links": f"""WITH {_LATEST} SELECT exchange_name, market_id, CASE WHEN exchange_name = 'KALSHI' THEN 'https://k.example/markets/' || url_encode(ticker)
        WHEN slug IS NOT NULL AND event_ticker IS NOT NULL AND event_ticker <> slug THEN 'https://p.example/event/' || url_encode(event_ticker) || '/' || url_encode(slug)
        WHEN slug IS NOT NULL THEN 'https://p.example/event/' || url_encode(slug) END AS link FROM m""",
}
