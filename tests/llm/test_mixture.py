import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("public_tokenizers")

from twinbook.llm.mixture import exact_total, fill, mix_sources  # noqa: E402

TARGETS = "source string, target_share double, max_repeats int"


@given(st.dictionaries(st.sampled_from("abcdefgh"), st.tuples(st.floats(0.01, 1), st.floats(0, 1e6)), min_size=1), st.floats(0, 1e7))
@settings(max_examples=300, deadline=None)
def test_water_filling(targets, total):
    x = fill(targets, total)
    assert all(0 <= x[s] <= c + 1e-6 for s, (_, c) in targets.items())
    assert abs(sum(x.values()) - min(total, sum(c for _, c in targets.values()))) < 1e-3 * max(1, total)
    free = [x[s] / w for s, (w, c) in targets.items() if x[s] < c - 1e-6 * max(1, c)]
    if free:  # sources below their caps share one level, and clamped ones are not above it
        assert max(free) - min(free) <= 1e-6 * max(1, max(free))
        assert all(x[s] / w <= max(free) * (1 + 1e-6) + 1e-6 for s, (w, _) in targets.items())


def test_shares_and_repeats(spark):
    docs = [(i, "word " * (1 + i % 7), "big") for i in range(3_000)] + [(10_000 + i, "some text here", "small") for i in range(40)]
    docs += [(20_000, "x", None), (20_001, "y", "unlisted"), (20_002, None, "big"), (20_003, "", "small"), (1, "word word", "big")]
    df = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, source string, n_tokens string")
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.3, 4), ("none", 0.1, 2), (None, 0.5, 2)], TARGETS)
    m = mix_sources(df, targets, seed=5)
    rows = m.documents.collect()
    assert {r.source for r in rows} == {"big", "small"} and len(rows) == 3_043
    assert all(r.repeats in (0, 1) for r in rows if r.source == "big") and {r.repeats for r in rows if r.source == "small" and r.n_tokens} == {4}
    shares = {r.source: r for r in m.shares.collect()}
    assert shares["none"].actual_share == 0 and abs(sum(s.actual_share for s in shares.values()) - 1) < 1e-9
    used = sum(r.n_tokens * r.repeats for r in rows)
    assert used == sum(s.tokens_used for s in shares.values()) and all(s.most_repeats <= s.max_repeats for s in shares.values())
    assert sorted((r.doc_id, r.repeats) for r in mix_sources(df, targets, seed=5).documents.collect()) == sorted((r.doc_id, r.repeats) for r in rows)


def test_fractions_come_near_their_amount(spark):
    docs = [(i, "a b c d", s) for s, n in (("x", 5_000), ("y", 5_000)) for i in range(n)]
    df = spark.createDataFrame([(i + (10_000 if s == "y" else 0), t, s) for i, t, s in docs], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("x", 0.25, 3), ("y", 0.75, 3)], TARGETS)
    got = {r.source: r for r in mix_sources(df, targets, total_tokens=36_000).shares.collect()}
    assert abs(got["x"].tokens_used - 9_000) < 8 and abs(got["y"].tokens_used - 27_000) < 8 and got["y"].most_repeats == 2


@given(st.dictionaries(st.sampled_from("abcdefgh"), st.tuples(st.floats(0.01, 1), st.floats(1, 1e6)), min_size=1))
@settings(max_examples=200, deadline=None)
def test_exact_total_is_the_largest_that_meets_all_targets(targets):
    total = exact_total(targets)
    weight = sum(w for w, _ in targets.values())
    x = fill(targets, total)
    assert all(abs(x[s] - total * w / weight) <= 1e-6 * max(1, total) for s, (w, _) in targets.items())
    more = fill(targets, total * 1.01 + 1)
    assert any(x < (total * 1.01 + 1) * targets[s][0] / weight - 1e-6 for s, x in more.items())


def test_targets_are_met_by_default(spark):
    docs = [(i, "a b c d", s) for i, s in enumerate(["x"] * 3_000 + ["y"] * 400 + ["z"] * 900)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("x", 0.5, 1), ("y", 0.3, 2), ("z", 0.2, 3)], TARGETS)
    got = {r.source: r for r in mix_sources(df, targets).shares.collect()}
    assert all(abs(r.actual_share - r.target_share) < 0.005 for r in got.values()) and got["y"].tokens_used == 2 * got["y"].tokens_available
    clamped = {r.source: r for r in mix_sources(df, targets, all_tokens=True).shares.collect()}
    assert clamped["y"].actual_share < 0.3 and sum(r.tokens_used for r in clamped.values()) > sum(r.tokens_used for r in got.values())


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("x", 0.25, 3)], TARGETS)
    m = mix_sources(df, targets)
    assert m.documents.count() == 0 and m.shares.collect()[0].actual_share == 0
    assert mix_sources(df, targets.limit(0)).shares.count() == 0
