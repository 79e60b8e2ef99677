import os
import re
from collections import Counter

import numpy as np
import pytest

from twinbook.llm.boosting import BoostedTrees
from twinbook.llm.queries import p8_quality
from twinbook.llm import quality
from twinbook.llm.quality import COMMON, FEATURES, KINDS, described, fit_kinds, judge_texts, weak_labels

def test_trees_learn_and_calibrate():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(2_000, 5))
    y = (x[:, 0] > 0).astype(int) * 2 + (x[:, 1] * x[:, 2] > 0)
    m = BoostedTrees(KINDS).fit(x[:1500], y[:1500], np.ones(1500))
    assert (m.raw(x[1500:]).argmax(1) == y[1500:]).mean() > 0.9
    p = m.calibrate(x[1500:], y[1500:]).probabilities(x[1500:])
    assert np.allclose(p.sum(1), 1) and 0.25 <= m.temperature <= 8


WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
ODD_TEXTS = [
    "The cat sat. It was fine!\nno end here", "word", "a\r\nb\rc\n\n  d  \n", "don't can’t 'x' rock'n'roll", "na\u0308ive É Ünder_score x_1", "😀 emoji 😀", "勝者は7月22日に発表される予定です。",
    "| a | 0.1 |\n|---|---|\n| b | 0.2 |", "\t\x00\u200b.", "'", "x" * 5_000, "- one\n- two\n- three", "one  two\n\n\n", "ſtraße İ ½ ²",
]


def plainly(text):
    lines = [x for x in re.split(r"\r\n|\r|\n", text) if x.strip()]
    words = WORD.findall(text)
    symbols = sum(not (c.isalnum() or c.isspace()) for c in text)
    ended = sum(x.rstrip()[-1] in ".!?…。！？\"'”’»):;," for x in lines)
    low = [w.lower() for w in words]
    n = max(len(words), 1)
    return len(words), sum(map(len, words)) / n, symbols / len(text), ended / len(lines), sum(w in COMMON for w in low) / n, len(set(low)), max(Counter(low).values(), default=0), max(map(len, text.split()))


def test_statistics_against_plain_python():
    x = described(ODD_TEXTS)
    at = {c: x[:, i] for i, c in enumerate(FEATURES)}
    for i, t in enumerate(ODD_TEXTS):
        want = plainly(t)
        n = max(want[0], 1)
        got = *x[i, :5], at["distinct"][i] * n, at["most_frequent"][i] * n, np.expm1(at["longest_token"][i])
        assert np.allclose(got, want), t
    alone = np.vstack([described([t]) for t in ODD_TEXTS])
    assert np.allclose(alone, x, equal_nan=True) and described([]).shape == (0, len(FEATURES))


def test_blank_long_and_repeated_texts(spark):
    rows = [(1, "The cat sat. It was fine!\nno end here"), (2, None), (3, ""), (4, " \n\t"), (5, "word " * 600_000), (1, "The cat sat. It was fine!\nno end here")]
    df = spark.createDataFrame([(i, t, 7.0) for i, t in rows], "doc_id long, text string, word_count double")
    got = {}
    for r in judge_texts(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    one = got[1][0]
    assert len(got[1]) == 2 and one.word_count == 9 and one.punctuated_line_share == 0.5 and one.symbol_ratio == 2 / 37
    assert all(got[i][0].word_count == 0 and got[i][0].kind is None and got[i][0].symbol_ratio is None for i in (2, 3, 4)) and got[5][0].word_count == 600_000


def test_a_text_is_judged_by_all_of_it():
    """A text of over a million characters whose last part decides its kind; and packing that reads the whole text."""
    rnd = np.random.default_rng(3)
    made = texts(150)
    model = BoostedTrees(KINDS).fit(described([t for _, t, _ in made]), np.array([KINDS.index(k) for *_, k in made]), np.ones(len(made)))
    prose = "The price moved before the vote. We do not know why it was so thin, and nobody said more about it.\n" * 10_500
    table = "a\t0.123\t0.45\n" * 160_000
    kinds = [KINDS[i] for i in model.probabilities(described([prose, prose + table])).argmax(1)]
    assert len(prose) > 1_000_000 and kinds == ["prose", "table"]
    noise = "".join(rnd.choice(list("abcdefghijklmnopqrstuvwxyz      \n"), 1_200_000))
    half, whole, mixed = described([noise[:600_000], noise, "so it was\n" * 110_000 + noise])[:, FEATURES.index("packed")]
    assert abs(half - whole) < 0.01 * whole and 0.4 * whole < mixed < 0.6 * whole


def test_signals_abstain():
    x = described(["It was over before we knew, and they said so. Who was it?", "- Harbor Cup\n- River Trophy\n- Copper Bowl", "noon\t0.125\t0.250\nnight\t0.375\t0.500", "█ □ � █ □ �", "x", "Harbor"])
    assert weak_labels(x).tolist() == [0, 1, 2, 3, -1, -1]


def test_trees_alone_judge(spark, monkeypatch):
    rows = texts(40)
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = fit_kinds(df)
    monkeypatch.setattr(quality, "fit_kinds", lambda *a, **k: model)
    before = sorted((r.doc_id, r.kind) for r in judge_texts(df).collect())
    monkeypatch.setattr(quality, "signals", None)
    monkeypatch.setattr(quality, "weak_labels", None)
    assert sorted((r.doc_id, r.kind) for r in judge_texts(df).collect()) == before
    monkeypatch.setattr(quality, "fit_kinds", lambda *a, **k: None)
    assert {r.kind for r in judge_texts(df).collect()} == {None}


def texts(n):
    rnd = np.random.default_rng(n)
    prose = "The price moved before the vote. We do not know why it was so thin, and nobody said more about it."
    made = {
        "prose": lambda: " ".join(rnd.permutation(prose.split())) + ".", "list": lambda: "\n".join(f"- Item {i} Cup" for i in range(rnd.integers(3, 20))),
        "table": lambda: "\n".join(f"a\t{rnd.random():.3f}\t{rnd.random():.2f}" for _ in range(rnd.integers(3, 20))), "junk": lambda: " ".join(rnd.choice(["b6", "2c", "f0", "9a"], 60)),
    }
    return [(i * 4 + j, made[k](), k) for i in range(n) for j, k in enumerate(KINDS)]


def test_kinds(spark):
    rows = texts(60)
    df = spark.createDataFrame([*((i, t) for i, t, _ in rows), (9_000, None), (9_001, ""), (9_002, "  ")], "doc_id long, text string")
    got = {r.doc_id: r for r in judge_texts(df).collect()}
    assert sum(got[i].kind == k for i, _, k in rows) >= 0.97 * len(rows)
    assert all(got[i].kind is None and got[i].confidence is None for i in (9_000, 9_001, 9_002)) and all(0.25 <= got[i].confidence <= 1 for i, _, _ in rows)
    assert judge_texts(df.limit(0)).count() == 0
    assert {r.kind for r in judge_texts(df.where("doc_id >= 9000")).collect()} == {None}


def test_documents_judged_by_hand_calibrate(spark, tmp_path):
    rows = texts(60)
    sure, kinds = {}, {}
    for name, shift in (("right", 0), ("wrong", 1)):
        folder = str(tmp_path / name)
        spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
        judged = [(i, KINDS[(KINDS.index(k) + shift * (j % 2)) % 4]) for j, (i, _, k) in enumerate(rows[:40])]
        spark.createDataFrame(judged, "doc_id long, kind string").write.parquet(f"{folder}/doc_kinds.parquet")
        got = {r.doc_id: r for r in p8_quality(spark, folder).collect()}
        assert len(got) == len(rows)
        sure[name], kinds[name] = np.mean([got[i].confidence for i, _, _ in rows]), {i: r.kind for i, r in got.items()}
    assert sure["wrong"] < sure["right"] - 0.1 and kinds["wrong"] == kinds["right"]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    everything = spark.createDataFrame([(i, k) for i, _, k in rows], "doc_id long, kind string")
    assert judge_texts(df, judged=everything).where("kind is null").count() == 0
    assert judge_texts(df.limit(0), judged=everything).count() == 0


HAND = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.exists(HAND), reason="needs the documents judged by hand")
def test_hand_checked_holdout(spark):
    """Half of the documents judged by hand calibrate; the other half, left out of everything, is what accuracy is measured on."""
    docs, kinds = spark.read.parquet(f"{HAND}/documents.parquet"), spark.read.parquet(f"{HAND}/doc_kinds.parquet").toPandas().sort_values("doc_id")
    known, unseen = kinds.iloc[::2], kinds.iloc[1::2]
    ids = [int(i) for i in unseen.doc_id]
    model = fit_kinds(docs.where(~docs.doc_id.isin(ids)), judged=spark.createDataFrame(known))
    text = {r.doc_id: r.text for r in docs.where(docs.doc_id.isin(ids)).collect()}
    p = model.probabilities(described([text[i] for i in ids]))
    right = np.array([KINDS[i] for i in p.argmax(1)]) == unseen.kind.to_numpy()
    assert right.mean() >= 0.93 and 0.25 <= model.temperature <= 8
