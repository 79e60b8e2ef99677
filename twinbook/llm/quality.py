"""Problem 8: statistics of each text, and whether it is prose, a list, a table or junk.

A batch of texts is one array of code points. Characters are looked up in a table of classes, lines and words are runs in
that array, words are compared by rolling hashes, and everything is summed by text, so that nothing loops over characters,
words or lines. Boosted trees judge these statistics. They learn from weak labels: several short signals of each kind look
at a bounded sample of the texts (those of smallest hash, about ``sample`` of them, at most ``per_class`` of a kind) and
each may abstain; a text of which signals of one kind only speak has that label. Judging consults the trees alone.
Documents judged by hand are held out of the fit and set the temperature that calibrates the probabilities.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinbook.llm.boosting import BoostedTrees
from twinbook.session import spread

KINDS = ["prose", "list", "table", "junk"]
STATS = ["word_count", "mean_word_length", "symbol_ratio", "punctuated_line_share", "common_word_share"]
#: Of trees without documents judged by hand.
TEMPERATURE = 1.0
#: Frequent words of the languages expected.
COMMON = (
    "the of and to a in is it that was for on are as with be at by this had not or have from one were but what all when we there can an your which "
    "their if do will each how them then some so into has more could no than been who now my over did down only i you he they me "
    "still think who lol nah imo got anyone why same here again too never sold wait these those may might must should would such before until till about after "
    "its just like know take make made come get see look back way even want because any give day most us through where much between under very being own while "
    "few off next our good first well people said went per does did having him her his she "
    "der die das und ist nicht ein eine zu den von mit auf für im dem des es sich auch als an nach wie aus bei hat dass wird oder wer war um am nur noch "
    "el la los las de que y en un una por con no se su para es al lo como más pero sus le ha o este sí porque entre cuando sobre también hasta desde "
    "le les des du et un une est dans que qui pour pas sur au avec ce il sont plus par ne se à ou la été aux cette mais on de s même encore celui ont il si sans deux "
    "bis nur keine kein sagte sei einem einer wenn läuft bei ob habe ich wir sie"
).split()
#: Characters that are packed at a time, and those of a batch that are worked on at once (a longer text is alone).
CHUNK, ROOM = 1_000_000, 1 << 21

LETTER, DIGIT, SPACE, UPPER, VOWEL, CONSONANT, IDEOGRAM, ODD, STOP, END, CELL, ITEM, HIGH, MARK, BULLET, QUOTE = (1 << i for i in range(16))
_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

FEATURES = [
    *STATS, "size", "lines", "digits", "letters", "spaces", "upper", "ideograms", "odd", "high", "cells", "items", "stops", "quotes", "line_length", "line_spread",
    "distinct", "variety", "most_frequent", "packed", "vowels", "consonant_runs", "longest_token", "capitalised", "numeric", "cell_spread", "line_tags", "row_tags", "item_tags", "per_item",
    "in_common", "in_stopped", "in_bulleted", "in_celled", "in_numeric", "in_short", "in_item_marks", "called", "keyed",
]


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Classes and lower-case forms of the basic plane; its last place stands for what lies beyond."""
    kinds, low = np.zeros(65_536, np.uint16), np.arange(65_536, dtype=np.uint32)
    for i in range(65_535):
        c = chr(i)
        k = 0
        if c.isalpha():
            k |= LETTER | (UPPER if c.isupper() else 0)
            form = c.lower()
            low[i] = ord(form) if len(form) == 1 else i
            if form in "aeiouyáéíóúäöüàèêâîôûãõåø":
                k |= VOWEL
            elif form in "bcdfghjklmnpqrstvwxz":
                k |= CONSONANT
        elif c.isalnum():
            k |= DIGIT
        if c.isspace():
            k |= SPACE
        if "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "ｦ" <= c <= "ﾟ" or "가" <= c <= "힯":
            k |= IDEOGRAM
        if (i < 32 and c not in "\t\n\r") or 127 <= i < 160 or 0x200B <= i <= 0x200F or 0x2500 <= i <= 0x25FF or 0xD800 <= i <= 0xF8FF or i in (0xFEFF, 0xFFFD):
            k |= ODD
        if 0x80 <= i <= 0xBF:
            k |= HIGH
        for bit, members in ((STOP, ".!?…。！？"), (END, '.!?…。！？"\'”’»):;,'), (CELL, "|;\t&"), (ITEM, ",/;|·•"), (MARK, "'’"), (BULLET, "-*•◦‣·–—+.)]:#"), (QUOTE, '{}"=<>\\_')):
            if c in members:
                k |= bit
        kinds[i] = k
    return kinds, low


def _powers(n: int, base: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = ROOM + 2
    forward, backward = _powers(n, _BASE), _powers(n, _INVERSE)
    hashes = np.array([sum((ord(c) + 1) * pow(_BASE, i, 1 << 64) for i, c in enumerate(w)) % (1 << 64) for w in set(COMMON)], np.uint64)
    return forward, backward, np.sort(hashes)


def describe(texts: list[str]) -> np.ndarray:
    """Features of texts that are not blank: one row each, columns ``FEATURES``. Texts are read whole."""
    kinds, low = _classes()
    joined = "\n".join(texts) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(code)
    forward, backward, common_hashes = _tables()
    if n >= len(forward):
        forward, backward = _powers(n + 1, _BASE), _powers(n + 1, _INVERSE)
    at = np.minimum(code, 65_535)
    k = kinds[at]
    docs = len(texts)
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    position = np.arange(n)
    is_ = lambda bit: (k & bit) != 0
    per_text = lambda flag: np.add.reduceat(flag, begin, dtype=np.int64)
    share = lambda bit: per_text(is_(bit)) / np.maximum(size, 1)
    space = is_(SPACE)
    # Lines.
    after = np.append(code[1:], 0)
    ends_line = (code == 10) | ((code == 13) & (after != 10))
    start = np.concatenate([[0], np.flatnonzero(ends_line)[:-1] + 1])
    per_line = lambda flag: np.add.reduceat(flag, start, dtype=np.int64)
    first = np.minimum.reduceat(np.where(space, n, position), start)
    last = np.maximum.reduceat(np.where(space, -1, position), start)
    full = last >= 0
    line_text = np.searchsorted(begin, start, side="right") - 1
    owner = line_text[full]
    length = (last - first + 1)[full]
    lines = np.maximum(np.bincount(owner, minlength=docs), 1)
    total = np.maximum(np.bincount(owner, length, docs), 1)
    by_line = lambda flag: np.bincount(owner, flag * length, docs) / total
    # Words: letters and digits, joined by apostrophes between them.
    inside = (k & (LETTER | DIGIT)) != 0
    joint = is_(MARK)
    joint[1:-1] &= inside[:-2] & inside[2:]
    joint[[0, -1]] = False
    inside |= joint
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    ws, we = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((low[at].astype(np.uint64) + np.uint64(1)) * forward[:n], dtype=np.uint64)])
    h = (prefix[we] - prefix[ws]) * backward[ws]
    word_text = np.searchsorted(begin, ws, side="right") - 1
    word_line = np.searchsorted(start, ws, side="right") - 1
    is_common = common_hashes[np.minimum(np.searchsorted(common_hashes, h), len(common_hashes) - 1)] == h
    is_number = (k[ws] & DIGIT) != 0
    count = np.bincount(word_text, minlength=docs)
    words = np.maximum(count, 1)
    order = np.lexsort((h, word_text))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (word_text[order][1:] != word_text[order][:-1])
    repeats = np.diff(np.append(np.flatnonzero(fresh), len(h)))
    different = np.bincount(word_text[order][fresh], minlength=docs)
    most = np.zeros(docs)
    np.maximum.at(most, word_text[order][fresh], repeats)
    # Tokens between blanks.
    edge = np.diff(np.concatenate([[1], space.view(np.int8), [1]]))
    ts, te = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    token_text = np.searchsorted(begin, ts, side="right") - 1
    longest = np.zeros(docs)
    np.maximum.at(longest, token_text, te - ts)
    runs = np.diff(np.concatenate([[0], is_(CONSONANT).view(np.int8), [0]]))
    rs = np.flatnonzero(runs == 1)
    rs = rs[np.flatnonzero(runs == -1) - rs >= 5]
    # Lines by what they hold.
    line_words = np.bincount(word_line, minlength=len(start))[full]
    line_common = np.bincount(word_line, is_common, len(start))[full]
    line_numbers = np.bincount(word_line, is_number, len(start))[full]
    wide = space & np.append(space[1:], False) & ~np.concatenate([[True], space[:-1]]) & (code != 10) & (after != 10)
    cells = per_line(is_(CELL) | wide)[full]
    items = per_line(is_(ITEM))[full]
    stopped = (k[last[full]] & STOP) != 0
    lead = first[full]
    gap = te[np.minimum(np.searchsorted(ts, lead), len(ts) - 1)]  # end of the line's first token
    signs = np.concatenate([[0], np.cumsum(is_(LETTER))]), np.concatenate([[0], np.cumsum(is_(DIGIT))])
    lead_letters, lead_digits = (s[gap] - s[lead] for s in signs)
    bulleted = ((k[gap - 1] & BULLET) != 0) & (gap - lead <= 5) & (lead_letters + (lead_digits > 0) <= 1) & (gap <= last[full])
    tags = per_line(code == 60)[full]
    mean_cells = np.bincount(owner, cells, docs) / lines
    spread_cells = np.sqrt(np.maximum(np.bincount(owner, cells.astype(float) ** 2, docs) / lines - mean_cells**2, 0)) / np.maximum(mean_cells, 0.5)
    mean_length = total / lines
    spread_length = np.sqrt(np.maximum(np.bincount(owner, length.astype(float) ** 2, docs) / lines - mean_length**2, 0)) / np.maximum(mean_length, 1)
    letters = per_text(is_(LETTER))
    packed = np.empty(docs)
    for i, t in enumerate(texts):
        packer = zlib.compressobj(1)
        packed[i] = sum(len(packer.compress(t[j : j + CHUNK].encode("utf-8", "replace"))) for j in range(0, len(t), CHUNK)) + len(packer.flush())
    counted = lambda *marks: np.array([sum(t.count(m) for m in marks) for t in texts]) / lines
    symbols = size - letters - per_text(is_(DIGIT)) - per_text(space) + 1  # the mark between texts is a blank
    columns = [
        count, np.bincount(word_text, we - ws, docs) / words, symbols / np.maximum(size, 1), np.bincount(owner, (k[last[full]] & END) != 0, docs) / lines, np.bincount(word_text, is_common, docs) / words,
        np.log1p(size), np.log1p(lines), share(DIGIT), share(LETTER), share(SPACE), share(UPPER), share(IDEOGRAM), share(ODD), share(HIGH), share(CELL), share(ITEM), share(STOP), share(QUOTE), mean_length, spread_length,
        different / words, different / np.sqrt(words), most / words, packed / np.maximum(size, 1), per_text(is_(VOWEL)) / np.maximum(letters, 1), np.bincount(np.searchsorted(begin, rs, side="right") - 1, minlength=docs) / words,
        np.log1p(longest), np.bincount(word_text, (k[ws] & UPPER) != 0, docs) / words, np.bincount(word_text, is_number, docs) / words, spread_cells, np.bincount(owner, tags, docs) / lines, counted("<td", "<tr", "<th"), counted("<li", "<ul", "<ol"),
        count / (np.bincount(owner, items + 1, docs) + 1e-9),
        by_line(line_common >= 0.15 * np.maximum(line_words, 1)), by_line(stopped), by_line(bulleted), by_line(cells >= 2), by_line(line_numbers >= 0.45 * np.maximum(line_words, 1)), by_line((line_words <= 8) & ~stopped), by_line(items >= 3),
        counted("(") * (counted(" at ") > 0.5), counted('":'),
    ]
    return np.column_stack(columns).astype(float)


def described(texts: list[str]) -> np.ndarray:
    """``describe`` in parts of at most ``ROOM`` characters; a longer text is a part of its own."""
    parts, part, room = [], [], 0
    for t in texts:
        if part and room + len(t) + 1 > ROOM:
            parts.append(describe(part))
            part, room = [], 0
        part.append(t)
        room += len(t) + 1
    if part:
        parts.append(describe(part))
    return np.vstack(parts) if parts else np.zeros((0, len(FEATURES)))


def signals(features: np.ndarray) -> dict[str, list[np.ndarray]]:
    """Votes of short independent signals for each kind, true or abstaining; none of them knows the others."""
    f = {name: features[:, i] for i, name in enumerate(FEATURES)}
    lines, size = np.rint(np.expm1(f["lines"])), np.rint(np.expm1(f["size"]))
    many = f["word_count"] >= 8
    return {
        "prose": [
            (f["common_word_share"] >= 0.25) & (f["in_stopped"] >= 0.5) & (f["variety"] >= 2.2) & (f["in_bulleted"] < 0.5),
            (f["ideograms"] >= 0.25) & (f["stops"] >= 0.01) & (f["in_bulleted"] < 0.5),
            (f["common_word_share"] >= 0.3) & (f["word_count"] >= 3) & (f["distinct"] >= 0.6) & (f["variety"] >= 1.5) & (f["in_celled"] < 0.2) & (f["in_bulleted"] < 0.3),
        ],
        "list": [
            (f["in_bulleted"] >= 0.8) & (lines >= 3) & (f["common_word_share"] < 0.12),
            (lines >= 4) & (f["in_short"] >= 0.85) & (f["common_word_share"] <= 0.1) & (f["cells"] < 0.01) & (f["numeric"] < 0.35) & (f["odd"] < 0.01) & (f["line_tags"] < 0.5) & (f["called"] == 0) & (f["distinct"] > 0.3),
            (f["item_tags"] >= 0.4) & (f["row_tags"] == 0),
            (lines >= 3) & (f["spaces"] * size <= lines) & (f["upper"] >= 0.3) & (f["longest_token"] < np.log1p(40)) & (f["cells"] == 0) & (f["symbol_ratio"] < 0.3),
            (f["in_item_marks"] >= 0.8) & (f["per_item"] <= 5) & (f["common_word_share"] <= 0.06) & (f["capitalised"] >= 0.35) & (f["numeric"] < 0.3) & (f["distinct"] >= 0.45) & (f["symbol_ratio"] < 0.2) & (f["in_celled"] * lines < 2),
        ],
        "table": [
            (lines >= 2) & (f["in_celled"] >= 0.8) & (f["cell_spread"] <= 0.25) & (f["quotes"] < 0.1) & (f["common_word_share"] < 0.1),
            (lines >= 2) & (f["in_numeric"] >= 0.7) & (f["in_item_marks"] + f["in_celled"] >= 0.7) & (f["quotes"] < 0.1),
            (f["row_tags"] >= 1) & (f["item_tags"] == 0),
        ],
        "junk": [
            f["odd"] >= 0.1,
            (f["letters"] * size >= 20) & (f["ideograms"] < 0.05) & (f["common_word_share"] <= 0.06) & (f["vowels"] < 0.22) & (f["upper"] < 0.4) & (f["line_tags"] < 0.5),
            (f["longest_token"] >= np.log1p(60)) & (f["spaces"] < 0.05) & (f["ideograms"] < 0.05) & (f["row_tags"] + f["item_tags"] == 0),
            many & (f["variety"] <= 2.1) & (f["distinct"] <= 0.5) & ((f["in_celled"] < 0.8) | (lines < 2)) & (f["in_numeric"] < 0.4) & (f["line_tags"] < 0.5) & (f["in_bulleted"] < 0.5),
            (f["symbol_ratio"] >= 0.5) & (f["odd"] < 0.1) & (f["row_tags"] + f["item_tags"] == 0),
            f["high"] >= 0.06,
            many & (f["common_word_share"] <= 0.03) & (f["capitalised"] <= 0.05) & (f["symbol_ratio"] <= 0.01) & (f["lines"] <= np.log1p(1)),
            f["keyed"] >= 2,
            (f["called"] >= 0.8) & (f["common_word_share"] < 0.4) & (lines >= 2),
            many & (f["word_count"] > 0) & (f["mean_word_length"] <= 2.05) & (f["spaces"] >= 0.25),
        ],
    }


def weak_labels(features: np.ndarray) -> np.ndarray:
    """Place in ``KINDS`` of the only kind that signals speak for; -1 where none or several do."""
    votes = np.column_stack([np.any(v, axis=0) for v in (signals(features)[k] for k in KINDS)])
    return np.where(votes.sum(1) == 1, votes.argmax(1), -1)


def _readable(texts: pd.Series) -> np.ndarray:
    return np.array([isinstance(t, str) and bool(t.strip()) for t in texts], bool)


def labelled_sample(documents: DataFrame, id_column: str = "doc_id", text: str = "text", sample: int = 20_000) -> DataFrame:
    """``id_column``, ``weak`` and ``features`` of the texts whose hash is smallest, about ``sample`` of them; all, if there are no more."""
    rows = documents.count()
    part = documents.select(id_column, text)
    if rows > sample:
        part = part.where(F.pmod(F.xxhash64(id_column), F.lit(1 << 40)) < int((1 << 40) * (sample / rows)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[_readable(b[text])]
            x = described(b[text].tolist())
            yield pd.DataFrame({id_column: b[id_column], "weak": weak_labels(x).astype("int32"), "features": pd.Series(list(x), index=b.index, dtype=object)})

    kind = documents.schema[id_column].dataType.simpleString()
    return spread(part).mapInPandas(run, f"`{id_column}` {kind}, weak int, features array<double>")


def fit_kinds(
    documents: DataFrame, id_column: str = "doc_id", text: str = "text", sample: int = 20_000, per_class: int = 1_500, judged: DataFrame | None = None
) -> BoostedTrees | None:
    """Trees fitted to at most ``per_class`` weakly labelled texts of each kind of a sample of about ``sample``; None without any.

    Documents of ``judged`` (id and ``kind``, a few rows) are left out of the fit and set the temperature. If no other
    labelled text is left, they are fitted to and the temperature stays.
    """
    if judged is not None:
        labels = judged.where(F.col("kind").isin(KINDS)).groupBy(id_column).agg(F.min("kind").alias("kind"))
        held = documents.select(id_column, text).join(F.broadcast(labels), id_column).dropDuplicates([id_column]).orderBy(id_column).collect()
        held = [r for r in held if r[text] and r[text].strip()]
        model = fit_kinds(documents.join(F.broadcast(labels), id_column, "left_anti"), id_column, text, sample, per_class)
        if held and model is not None:
            return model.calibrate(described([r[text] for r in held]), np.array([KINDS.index(r.kind) for r in held]))
        if model is not None:
            return model
    rows = labelled_sample(documents, id_column, text, sample).where("weak >= 0").withColumn("h", F.xxhash64(id_column))
    got = rows.orderBy("h", id_column).select("weak", "features").collect()
    y = np.array([r.weak for r in got], int)
    kept = np.concatenate([np.flatnonzero(y == i)[:per_class] for i in range(len(KINDS))]) if len(y) else y
    if not len(kept):
        return None
    y, x = y[kept], np.array([got[i].features for i in kept], float)
    weight = (len(y) / len(KINDS) / np.maximum(np.bincount(y, minlength=len(KINDS)), 1))[y]
    model = BoostedTrees(KINDS).fit(x, y, weight)
    model.temperature = TEMPERATURE
    return model


def judge_texts(
    documents: DataFrame, id_column: str = "doc_id", text: str = "text", sample: int = 20_000, per_class: int = 1_500, judged: DataFrame | None = None
) -> DataFrame:
    """The five statistics, ``kind`` (prose, list, table or junk) and ``confidence`` of every text.

    Texts that are null, empty or blank have 0 words and null for everything else. Texts of one kind only are judged as that
    kind; if no text is labelled, all kinds are null. ``judged`` has the documents judged by hand (see ``fit_kinds``). Very
    long texts are read whole. Repeated rows stay, an empty table stays empty, other columns are left out. The model of a few
    hundred trees is all that is sent to the executors, and no row is shuffled for being judged.
    """
    model = fit_kinds(documents, id_column, text, sample, per_class, judged)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            has = _readable(b[text])
            x = described(b[text][has].tolist())
            out = {id_column: b[id_column], "word_count": np.zeros(len(b), np.int64)}
            out["word_count"][has] = x[:, 0]
            for i, name in enumerate(STATS[1:], 1):
                values = np.full(len(b), None, object)
                values[has] = x[:, i]
                out[name] = values
            kind, sure = np.full(len(b), None, object), np.full(len(b), None, object)
            if has.any() and model is not None:
                p = model.probabilities(x)
                kind[has], sure[has] = np.array(KINDS, object)[p.argmax(1)], p.max(1)
            out["kind"], out["confidence"] = kind, sure
            yield pd.DataFrame(out)

    typed = f"`{id_column}` {documents.schema[id_column].dataType.simpleString()}, word_count bigint, " + ", ".join(f"{c} double" for c in STATS[1:])
    return spread(documents.select(id_column, text)).mapInPandas(run, f"{typed}, kind string, confidence double")
