import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from twinbook.functions import text as T
from twinbook.operators import matching as M
from twinbook.operators.views import contract_link, quote_line, signed_money
from twinbook.plans import market_queries as Q
from twinbook.sources.catalogs import envelope_rows, parse_k, parse_p, parse_venue, read_pages, with_retry
from twinbook.sources.snapshots import SnapshotStore, stamp

RAW_K = {"ticker": "KX-26-A", "event_ticker": "KX-26", "title": "Will A win?", "yes_sub_title": "A", "rules_primary": "If A wins.", "rules_secondary": "", "expected_expiration_time": "2026-01-01T00:00:00Z", "volume_fp": "12.5", "volume_24h_fp": {"value": "3"}, "status": "open"}
RAW_P = {"id": 7, "slug": "a-b", "question": "Who wins?", "title": "Ann", "description": "Ann wins the cup. More text.", "endDate": "2026-01-01", "active": True, "closed": False, "feeCoefficient": 0.06}


def raw(spark, *records):
    return spark.createDataFrame([(json.dumps(list(records)),)], "payload string")


def test_records(spark):
    k = parse_k(envelope_rows(raw(spark, RAW_K, {"title": "no ticker"}), "payload")).collect()
    assert len(k) == 1 and (k[0].market_id, k[0].name, k[0].description, k[0].category, k[0].volume, k[0].volume24h, k[0].event_title) == ("KX-26-A", "Will A win?", "If A wins.", "Other", 12.5, 3.0, "Will A win?")
    p = parse_venue(envelope_rows(raw(spark, RAW_P, {"slug": "c", "question": "Does Ann win?", "title": "ann", "closed": True, "volume": "junk"}), "payload"), "p").orderBy("market_id").collect()
    assert (p[0].name, p[0].status, p[0].taker_fee_coefficient) == ("Ann wins the cup.", "active", 0.06) and (p[1].name, p[1].status, p[1].volume) == ("Does Ann win?", "closed", None)
    with pytest.raises(ValueError, match="unknown venue"):
        parse_venue(raw(spark), "x")


@pytest.mark.parametrize("body", ['[{"ticker":"a"}]', '{"markets":[{"ticker":"a"}]}', '{"data":{"markets":[{"ticker":"a"}]}}'])
def test_envelopes(spark, body):
    df = spark.createDataFrame([(body,), ("broken",), (None,), ('{"other":1}',)], "payload string")
    assert [r.market_id for r in parse_k(envelope_rows(df, "payload", "markets", "data")).collect()] == ["a"]


def test_pages_by_cursor_and_by_number(spark, tmp_path):
    for name, ids, cursor in (("0", ["a", "b"], "x"), ("x", ["b", "c"], "0")):
        (tmp_path / f"{name}.json").write_text(json.dumps({"markets": [{"ticker": i} for i in ids], "cursor": cursor}))
    rows = parse_k(envelope_rows(read_pages(spark, str(tmp_path)), "payload", "markets"))
    assert sorted(r.market_id for r in rows.collect()) == ["a", "b", "b", "c"]
    assert M.listing_counts(rows).collect()[0].asDict() == {"raw_rows": 4, "unique_ids": 3, "duplicate_rows": 1}
    assert read_pages(spark, str(tmp_path), pages=3).count() == 1


def test_retry():
    answers, slept = [(429, "", None), (429, "", 1.5), (200, "ok", None)], []
    assert with_retry(lambda: answers.pop(0), sleep=slept.append) == "ok" and slept == [0.5, 1.5]
    with pytest.raises(OSError, match="status 500"):
        with_retry(lambda: (500, "", None))
    with pytest.raises(OSError, match="too many"):
        with_retry(lambda: (429, "", None), attempts=2, sleep=lambda s: None)


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).collect()[0][0]


@pytest.mark.parametrize(
    ("name", "want"), [("Finish top 12 or at least 3, over 4", [12, 3, 4]), ("under 2, exactly 1", [2, 1]), ("none", []), (None, None)]
)
def test_thresholds(spark, name, want):
    assert one(spark, T.thresholds(F.col("x").cast("string")), x=name) == want


@pytest.mark.parametrize("name", ["win by at least 3", "win by 5–10%", "win by 3 to 6 points", "win by more than 2 goals", "by exactly 1 vote"])
def test_margins(spark, name):
    assert one(spark, T.has(F.col("x"), T.MARGIN), x=name)
    assert not one(spark, T.has(F.col("x"), T.MARGIN), x="by 2028")


def test_rules_of_names(spark):
    assert one(spark, T.normalize(T.ascii_fold("x")), x="Will the Philadelphia 76ers win?") == "philadelphia 76ers"
    assert one(spark, T.districts(F.col("x")), x="AZ-01 and wi-6") == ["AZ-1", "WI-6"]
    assert one(spark, T.titles(F.col("x")), x="Ballon d’Or or U.S. Open") == ["ballon_dor", "us_open"]
    assert one(spark, T.phases(F.col("x"), F.col("y")), x="Who wins the Senate seat?", y="The primary source is the press. The market resolves Yes if A wins the second round of the election.") == ["second_round"]
    assert one(spark, T.phases(F.col("x"), F.col("y")), x="Nominee for Senate", y="") == ["primary"]
    assert one(spark, T.phrase(T.ascii_fold("x"), T.ascii_fold("y"), F.array(F.lit("ann"))), x="Will Ann be in 2027?", y="Next mayor") == "next mayor"
    assert one(spark, T.block_ratio("x", "y"), x="abcd", y="bcde") == 0.75


def markets(spark, rows):
    columns = "market_id name subtitle description ticker slug event_ticker expiration_datetime primary_entity_name event_title".split()
    full = [(*[r.get(c) for c in columns], r.get("volume"), r.get("volume24h"), i, datetime(2026, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=i)) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, ", ".join(f"{c} string" for c in columns) + ", volume double, volume24h double, row_id long, fetched_at timestamp")


def test_linking_pipeline(spark):
    k = markets(spark, [
        {"market_id": "1", "name": "Will Tove Lindqvist win the primary in 2028?", "event_ticker": "E", "ticker": "E-TLIN", "subtitle": "Tove Lindqvist"},
        {"market_id": "2", "name": "Will Ida Moor win the top 5?", "event_ticker": "E", "ticker": "E-MOOR"}, {"market_id": "3", "name": None},
    ])
    p = markets(spark, [
        {"market_id": "10", "name": "Tove Lindqvist wins the primary", "slug": "will-tove-lindqvist-win-the-2028-x"}, {"market_id": "11", "name": "Tove Lindqvist wins", "slug": "will-tove-lindqvist-win-it"},
        {"market_id": "20", "name": "Ida Moor in the top 10", "primary_entity_name": "Ida Moor"}, {"market_id": "30", "name": "Lindqvist 2031 primary", "primary_entity_name": "Lindqvist"},
    ])
    ke, pe = M.with_entity_k(k), M.with_entity_p(p)
    assert {r.market_id: r.entity for r in ke.collect()} == {"1": "tove lindqvist", "2": "moor", "3": ""}
    assert {r.market_id: r.entity for r in pe.collect()} == {"10": "tove lindqvist", "11": "tove lindqvist", "20": "ida moor", "30": "lindqvist"}
    pairs = M.blocking_pairs(ke, pe)
    assert {(r.k_id, r.p_id) for r in pairs.collect()} == {("1", "10"), ("1", "11"), ("1", "30"), ("2", "20")}
    scored = M.score_pairs(M.entity_shortlist(pairs, M.features(ke), M.features(pe)))
    assert {(r.k_id, r.p_id) for r in scored.collect()} == {("1", "10")}  # phases, years and thresholds rule the others out
    best = M.best_match(scored).collect()[0]
    assert 0.7 < best.confidence <= 0.99
    labels = spark.createDataFrame([("1", "10", True), ("2", "20", True), ("1", "11", False)], "k_id string, p_id string, is_match boolean")
    report = M.validation(labels, pairs, scored).collect()[0]
    assert (report.labelled, report.as_candidate, report.predicted, report.as_match, report.wrong, report.recall, report.precision) == (2, 2, 1, 1, 0, 0.5, 1.0)
    other = spark.createDataFrame([("1", "11"), ("2", "20")], "k_id string, p_id string")
    report = M.validation(labels, pairs, other).collect()[0]  # one predicted wrongly, one rightly
    assert (report.predicted, report.as_match, report.wrong, report.recall, report.precision) == (2, 1, 1, 0.5, 0.5)
    assert M.validation(labels.limit(0), pairs, scored).collect()[0].precision == 0
    assert M.liquid(markets(spark, [{"market_id": "a", "volume": 10_000.0}, {"market_id": "b", "volume": 5.0, "volume24h": 100.0}, {"market_id": "c", "volume": 9_999.0, "volume24h": 99.0}, {"market_id": "d"}])).count() == 3
    assert M.latest_listing(k.unionByName(k)).count() == 3


def test_validation_counts_best_matches(spark, tmp_path):
    k = [
        {"market_id": "1", "name": "Will Tove Lindqvist win the primary in 2028?", "event_ticker": "E", "ticker": "E-TLIN", "subtitle": "Tove Lindqvist"},
        {"market_id": "2", "name": "Will Ida Moor win the top 5?", "event_ticker": "E", "ticker": "E-MOOR"},
    ]
    p = [
        {"market_id": "10", "name": "Tove Lindqvist wins the primary", "primary_entity_name": "Tove Lindqvist"}, {"market_id": "12", "name": "Lindqvist primary record", "primary_entity_name": "Lindqvist"},
        {"market_id": "20", "name": "Ida Moor in the top 10", "primary_entity_name": "Ida Moor"},
    ]
    for name, rows in (("k_markets", k), ("p_markets", p)):
        markets(spark, rows).write.parquet(f"{tmp_path}/{name}.parquet")
    labels = [("1", "10", True), ("2", "20", True), ("1", "12", False)]
    spark.createDataFrame(labels, "k_market_id string, p_market_id string, is_match boolean").write.parquet(f"{tmp_path}/pair_labels.parquet")
    got = Q.validation_report(spark, str(tmp_path)).collect()[0]
    top = {}
    for r in sorted(Q.fuzzy_scores(spark, str(tmp_path)).collect(), key=lambda r: (-r.confidence, r.p_id)):
        top.setdefault(r.k_id, r.p_id)
    assert top == {"1": "10"}  # the rules part 2 from 20, which blocking pairs; 12 is a candidate of 1, but not its best
    assert (got.labelled, got.as_candidate, got.as_match, got.wrong, got.recall, got.precision) == (2, 2, 1, 0, 0.5, 1.0)


def test_expirations_of_all_forms(spark, tmp_path):
    forms = [
        ("2026-03-01T02:00:00+02:00", "2026-05-01T00:00:00Z"), ("2026-03-01T00:00Z", "1777593600"), ("2026-03-01", "2026-03-31 00:00:00"),
        ("2026-02-28T19:00:00", "2026-05-01T00:00:00"), ("1 Mar 2026 00:00 UTC", "no date"), (None, None),
    ]
    for name, side, feed in (("k_markets", 0, 2), ("p_markets", 1, 1)):
        rows = markets(spark, [{"market_id": f"{name[0]}{i}", "expiration_datetime": f[side]} for i, f in enumerate(forms)])
        rows.withColumn("feed_id", F.when(F.col("market_id") == "k3", feed).otherwise(1)).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([(1, "UTC", "ymd"), (2, "America/New_York", "mdy")], "feed_id int, zone_name string, date_order string").write.parquet(f"{tmp_path}/feeds.parquet")
    spark.createDataFrame([(f"k{i}", f"p{i}", True) for i in range(len(forms))], "k_market_id string, p_market_id string, is_match boolean").write.parquet(f"{tmp_path}/pair_labels.parquet")
    march, last, may = 1_772_323_200_000_000, 1_774_915_200_000_000, 1_777_593_600_000_000
    got = {r.k_id: (r.ends_us, r.mismatch) for r in Q.expiration_mismatch(spark, str(tmp_path)).collect()}
    assert got == {"k0": (may, True), "k1": (may, True), "k2": (last, False), "k3": (may, True), "k4": (march, False), "k5": (None, False)}


def test_misses_and_their_reasons(spark):
    k = markets(spark, [{"market_id": i} for i in "12345"])
    p = markets(spark, [{"market_id": i} for i in ("10", "20", "30", "40", "50")])
    pair = lambda *rows: spark.createDataFrame(rows, "k_id string, p_id string")
    labels = spark.createDataFrame([("1", "10", True), ("2", "20", True), ("3", "30", True), ("4", "40", True), ("9", "50", True), ("5", "99", True), ("5", "50", False)], "k_id string, p_id string, is_match boolean")
    candidates, best = pair(("1", "10"), ("3", "30"), ("4", "40"), ("4", "10")), pair(("1", "10"), ("2", "10"), ("4", "10"), ("9", "50"))
    got = {(r.k_id, r.p_id): (r.predicted, r.reason) for r in M.misses(labels, k, p, candidates, best).collect()}
    assert got == {("2", "20"): (None, "no candidate"), ("3", "30"): (None, "no match"), ("4", "40"): ("10", "other match"), ("9", "50"): (None, "absent"), ("5", "99"): (None, "absent")}


def test_pairs_against_individuals(spark):
    k = markets(spark, [
        {"market_id": "1", "name": "Which couple wins?", "primary_entity_name": "Ann & Bob"}, {"market_id": "2", "name": "Who wins?", "subtitle": "Ann and Bob"},
        {"market_id": "3", "name": "x", "slug": "will-ann-win-it", "event_title": "Best duo"}, {"market_id": "4", "name": "Sandy's pair", "subtitle": "Sandy"},
    ])
    p = markets(spark, [{"market_id": "10", "name": "Ann"}, {"market_id": "11", "name": "Cy and Di", "event_title": "Best Pair"}, {"market_id": "12", "name": None}])
    pairs = k.select(F.col("market_id").alias("k_id")).crossJoin(p.select(F.col("market_id").alias("p_id")))
    got = {(r.k_id, r.p_id) for r in M.with_rules_check(pairs, k, p).where("rules_check").collect()}
    assert got == {("1", "10"), ("3", "11"), ("4", "11")}


def test_most_confident(spark):
    at = spark.createDataFrame([(str(i), "x", (i % 30) / 30) for i in range(100)], "k_id string, p_id string, confidence double")
    got = [(r.confidence, r.k_id) for r in M.most_confident(at).collect()]
    assert got == sorted(((i % 30 / 30, str(i)) for i in range(100)), key=lambda x: (-x[0], x[1]))[:20]


def test_slugs_that_say_nothing(spark):
    p = markets(spark, [{"market_id": "1", "slug": "will-the-win", "name": "Oak Fair"}, {"market_id": "2", "slug": "-the-", "subtitle": "Elm"}, {"market_id": "3", "slug": "will-the-win-x", "name": "Ash"}, {"market_id": "4"}])
    assert {r.market_id: r.entity for r in M.with_entity_p(p).collect()} == {"1": "", "2": "elm", "3": "", "4": ""}


@pytest.mark.parametrize(
    ("description", "want"),
    [
        ("As in v1.5 the market resolves to Yes after the runoff vote.", []), ("See v1.5. The market resolves to Yes after the runoff vote. More.", ["runoff"]),
        ("The contract will resolve at the primary election", ["primary"]), ("It is a runoff vote! Then this market resolved?", []), (None, []),
    ],
)
def test_phases_of_sentences(spark, description, want):
    assert one(spark, T.phases(F.lit("x"), F.col("y").cast("string")), y=description) == want


def test_ratio_of_sorted_words(spark):
    assert one(spark, T.best_ratio("x", "y"), x="a b", y="b a") == 1.0 and one(spark, T.best_ratio("x", "y"), x="abcd", y="bcde") == 0.75


def test_pairs_by_market_and_metadata(spark):
    pairs = spark.createDataFrame([("1", "10"), ("1", "11"), ("1", "11"), ("2", "10")], "k_id string, p_id string")
    assert sorted((r.market_id, r.side, r.k_id, r.p_id) for r in M.pairs_of_markets(pairs).collect()) == [
        ("1", "K", "1", "10"), ("1", "K", "1", "11"), ("10", "P", "1", "10"), ("10", "P", "2", "10"), ("11", "P", "1", "11"), ("2", "K", "2", "10")
    ]
    at = markets(spark, [{"market_id": "1", "name": "one", "event_ticker": "E"}, {"market_id": "10", "name": "ten", "event_title": "T", "expiration_datetime": "2026"}, {"market_id": "11"}])
    assert {(r.k_id, r.p_id, r.k_name, r.p_name) for r in M.with_metadata(pairs.distinct(), at, ["name"]).collect()} == {("1", "10", "one", "ten"), ("1", "11", "one", None), ("2", "10", None, "ten")}
    assert [r[0] for r in at.orderBy("market_id").select(M.event_key()).collect()] == ["ticker:E", "title:T|2026", "market:11"]


def test_views(spark):
    df = spark.createDataFrame([("KALSHI", "A B*~", None, "x"), ("P", None, "s", "e"), ("P", None, "s", "s"), ("P", None, "s", None), ("P", None, None, "e")], "exchange_name string, ticker string, slug string, event_ticker string")
    assert [r[0] for r in df.select(contract_link(F.lit("k/"), F.lit("p/"))).collect()] == ["k/A%20B%2A~", "p/e/s", "p/s", "p/s", None]
    assert one(spark, signed_money(F.col("x")), x=0.01234) == "+0.0123"
    assert spark.createDataFrame([("m", 0.5, None)], "market_id string, bid double, ask double").select(quote_line()).collect()[0][0] == "m 0.500/-"


def test_snapshots(spark, tmp_path):
    at = datetime(2026, 3, 4, 5, 6, tzinfo=timezone.utc)
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    assert stamp(at) == "20260304T050600000000Z" and store.pairs().count() == 0 and store.backup(f"{tmp_path}/b", at) is None and store.exclusions().count() == 0
    matches = spark.createDataFrame([("1", "a", 0.9), ("1", "a", 0.8), ("2", "b", 0.7)], "k_id string, p_id string, confidence double")
    store.overwrite(matches, at)
    assert sorted((r.k_id, r.confidence, r.taker_fee_coefficient) for r in store.pairs().collect()) == [("1", 0.9, 0.05), ("2", 0.7, 0.05)]
    assert store.flag("2", "b", at + timedelta(seconds=1), " not  the same ") and not store.flag("2", "b", at + timedelta(seconds=2))
    assert [r.k_id for r in store.pairs().collect()] == ["1"] and store.exclusions().collect()[0].note == "not the same"
    store.overwrite(matches, at + timedelta(seconds=3))
    assert store.pairs().count() == 1
    assert store.unflag("2", "b", at + timedelta(seconds=4)) and not store.unflag("2", "b", at + timedelta(seconds=5))
    store.overwrite(matches, at + timedelta(seconds=6))
    assert store.pairs().count() == 2 and store.backup(f"file://{tmp_path}/b", at).endswith("pairs_20260304T050600000000Z")


def test_matcher_run(spark, tmp_path):
    from twinbook.plans.matcher import run_matcher

    at = datetime(2026, 3, 4, tzinfo=timezone.utc)
    store = SnapshotStore(spark, f"file://{tmp_path}/run")
    k = markets(spark, [{"market_id": "1", "name": "Will Tove Lindqvist win the primary?", "primary_entity_name": "Tove Lindqvist"}, {"market_id": "2", "name": "Ida Moor and Eli win?", "primary_entity_name": "Ida Moor & Eli", "event_title": "Best couple"}, {"market_id": "3", "name": "x", "volume": 1.0}])
    p = markets(spark, [{"market_id": "10", "name": "Tove Lindqvist wins the primary", "primary_entity_name": "Tove Lindqvist"}, {"market_id": "20", "name": "Ida Moor wins", "primary_entity_name": "Ida Moor"}])
    store.flag("1", "10", at)
    got = run_matcher(store, k, p, at + timedelta(seconds=1)).collect()
    assert [(r.k_markets, r.p_markets, r.matches, r.needs_review, r.excluded, r.pairs) for r in got] == [(2, 2, 2, 1, 1, 1)]
    assert [(r.k_id, r.p_id) for r in store.pairs().collect()] == [("2", "20")]


def test_single_answers(spark):
    from twinbook.sources.catalogs import parse_k, single_rows

    answers = ['{"market": {"ticker": "A"}}', '{"markets": [{"ticker": "B"}, {"ticker": "C"}]}', '{"ticker": "D"}', '{"market": null}', "no", None, "[]"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(answers)], "i int, payload string")
    assert {r.i: r.market_id for r in parse_k(single_rows(df, "payload", "markets")).collect()} == {0: "A", 1: "B", 2: "D"}
