"""Problem 3: markets of two venues that ask the same question, by sorted neighbourhood.

No wording is known beforehand. A market's texts are words, some of them rare (names), and the numbers, dates, directions
and stage that contradict each other or do not. Which frequent words of the two venues mean the same is counted over all
anchors: pairs of markets that are alone, each in its venue, with their rare words, years, levels and stage.

Records are sorted by several composite keys of their rarest words (all keys in one distributed sort: ranges, then
positions, then blocks of positions that overlap by a window) and compared within a sliding window; what is left is judged
by weighted similarities of words, dates and years, and assigned one to one with the largest total confidence, component by
component and exactly whatever its size, where markets of a venue that ask the same question count as one. No key's group is
ever gathered: a block holds ``BLOCK`` positions whatever the keys are. A component's pairs are held by one task.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinbook.llm.questions import read_question
from twinbook.session import cut_lineage

BLOCK = 4_000
#: Rows of a batch of assigned pairs.
BATCH = 10_000
#: How much less confidence a second counterpart may have.
SAME = 0.1
#: Shares of all markets from which a word's partners are counted, from which it is no name, and from which it says nothing.
KNOWN, FREQUENT, COMMON = 0.002, 0.005, 0.12
_READ = "venue string, market_id string, ends_day double, parts array<array<string>>, words array<string>, years array<int>, months array<int>, days array<int>, levels array<string>, nomination boolean"
_FACTS = ["years", "months", "days", "levels"]


def _parts(df: DataFrame) -> int:
    """Partitions for work that costs far more than moving its rows; their number is given, so that they are not merged for being small."""
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def read_markets(markets: DataFrame, venue: str, ends_day: str = "ends_day") -> DataFrame:
    """One row per market: what its listing with most texts says, and its earliest expiration day. Listings without an id are left out."""
    texts = ["name", "event_title", "description"]
    filled = sum((F.coalesce(F.length(F.trim(c)), F.lit(0)) > 0).cast("int") for c in texts)
    best = F.max(F.struct(filled.alias("f"), *[F.col(c) for c in texts])).alias("b")
    single = markets.where(F.col("market_id").isNotNull()).groupBy("market_id").agg(best, F.min(ends_day).cast("double").alias("ends_day"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            read = [read_question(*x) for x in zip(b["name"], b["event_title"], b["description"])]
            out = pd.DataFrame(read, columns=["parts", "words", *_FACTS, "nomination"], index=b.index)
            out.insert(0, "venue", venue)
            out.insert(1, "market_id", b["market_id"])
            out.insert(2, "ends_day", b["ends_day"])
            yield out

    return single.select("market_id", "ends_day", *[f"b.{c}" for c in texts]).repartition(_parts(markets), "market_id").mapInPandas(run, _READ)


@lru_cache(maxsize=400_000)
def close(a: str, b: str) -> float:
    """1 for equal words, 0.9 and 0.75 for one and two slips of the pen (letter added, left out, changed, or two swapped), else 0."""
    if a == b:
        return 1.0
    if abs(len(a) - len(b)) > 2 or min(len(a), len(b)) < 4 or len(set(a) ^ set(b)) > 4:
        return 0.0
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j - 1] + 1, one[j] + 1, one[j - 1] + (x != y))
            if two and i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        two, one = one, row
    return 0.9 if one[-1] == 1 else 0.75 if one[-1] == 2 and min(len(a), len(b)) >= 7 else 0.0


def shortened(a: str, b: str) -> bool:
    """Whether the shorter word is a familiar form of the longer: three to five letters that begin alike and, but for a last
    vowel, all come in the longer one in order."""
    short, long = sorted((a, b), key=len)
    if not 3 <= len(short) <= 5 or len(long) < len(short) + 2 or short[0] != long[0]:
        return False
    letters = iter(long)
    stem = short[:-1] if short[-1] in "aeiouy" and len(short) > 3 else short
    return all(c in letters for c in stem)


def alike(a: str, b: str) -> float:
    """Similarity of two words: a slip of the pen, an initial for the word it begins, or a familiar form."""
    if s := close(a, b):
        return s
    if min(len(a), len(b)) == 1:
        return 0.85 if a[0] == b[0] else 0.0
    return 0.8 if shortened(a, b) else 0.0


def _trigrams(words: list[str]) -> list[int]:
    """A signature of 256 bits: the places that the words' trigrams fall on, as four signed integers."""
    bits = 0
    for w in words:
        for i in range(len(w) - 2):
            bits |= 1 << (zlib.crc32(w[i : i + 3].encode()) & 255)
    return [((bits >> (64 * i)) & (2**64 - 1)) - (2**64 if (bits >> (64 * i + 63)) & 1 else 0) for i in range(4)]


def _mask(values, hashed: bool = False) -> int:
    """Bits of the values; equal values share a bit, so that disjoint masks are of values that contradict each other."""
    bits = 0
    for v in values:
        bits |= 1 << ((zlib.crc32(str(v).encode()) if hashed else int(v)) % 62)
    return bits


_RECORD = (
    f"venue string, market_id string, ends_day double, years array<int>, months array<int>, days array<int>, levels array<string>, nomination boolean, "
    "flat array<string>, spelled array<string>, names array<string>, rare array<string>, lead array<string>, name_codes array<int>, codes array<int>, signature array<bigint>, masks array<bigint>, "
    "keys array<string>, anchor string"
)


class Vocabulary:
    """Known words by how many of ``markets`` they are in. A word is rare that is not known, or in too few to be no name."""

    def __init__(self, frequent: dict[str, int], markets: int):
        self.count, self.markets = frequent, max(markets, 1)
        self.word = sorted(frequent)
        self.code = {w: i for i, w in enumerate(self.word)}
        self.most, self.least = COMMON * self.markets, max(FREQUENT * self.markets, self.markets**0.4)

    def weight(self, word: str) -> float:
        return math.log((self.markets + 1) / self.count.get(word, self.markets**0.33))

    def rare(self, word: str) -> bool:
        return self.count.get(word, 0) < self.least and len(word) > 1

    def telling(self, word: str) -> bool:
        return self.count.get(word, 0) < self.most

    def record(self, r) -> dict:
        """What comparing needs of one market: rare words, which of them leads, codes of frequent words, signature, sort keys."""
        parts = [list(p) for p in r.parts]
        flat = [w for p in parts for w in p]
        names = list(dict.fromkeys(w for w in flat if self.telling(w)))
        rare = [w for w in names if self.rare(w)]
        unknown = sorted(w for w in rare if w not in self.code)
        twice = [w for w in rare if flat.count(w) > 1]
        first = [next(w for w in p if self.rare(w)) for p in parts if any(map(self.rare, p))]
        spelled = [w for w in r.words if self.rare(w)]
        extra = sorted((w for w in names if not self.rare(w) and len(w) > 1), key=lambda w: (self.count.get(w, 0), w))
        sorted_by = list(dict.fromkeys([*rare, *spelled, *extra[: max(0, 3 - len(rare))]])) or flat[:3] or [""]
        facts = [",".join(map(str, x)) for x in (r.years, r.levels, r.months)] + [str(int(r.nomination))]
        keys = []
        for w in sorted_by:
            others = " ".join(sorted(x for x in sorted_by if x != w))
            keys += [f"1|{w}|{'|'.join(facts)}|{others}", f"2|{w}|{others}|{'|'.join(facts)}", f"3|{w[::-1]}|{others}"]
        return {
            "flat": flat, "spelled": [w for w in r.words if w not in self.code], "names": names, "rare": rare, "lead": list(dict.fromkeys(twice or first)),
            "name_codes": sorted({self.code[w] for w in names if w in self.code}), "codes": sorted({self.code[w] for w in r.words if w in self.code and self.telling(w)}),
            "signature": _trigrams(rare or names),
            "masks": [_mask(r.years), _mask(r.months), _mask(r.days), _mask(r.levels, True), 1 + int(r.nomination)],
            "keys": list(dict.fromkeys(keys)), "anchor": "|".join([" ".join(unknown), *facts]) if unknown else None,
        }


def frequent_words(markets: DataFrame) -> tuple[dict[str, int], int]:
    """Words in at least ``KNOWN`` of all markets (and in more than the 0.33th power of their number), and that number.

    There are at most (mean number of words of a market) / ``KNOWN`` such words, whatever the size of the tables.
    """
    n = markets.count()
    least = max(KNOWN * n, n**0.33)
    counts = markets.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return {r.word: r.n for r in counts.collect()}, n


def with_records(markets: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = pd.DataFrame([vocabulary.record(r) for r in b.itertuples(index=False)], index=b.index, columns=_NEW)
            yield pd.concat([b.drop(columns=["parts", "words"]), made], axis=1)

    return markets.mapInPandas(run, _RECORD)


_NEW = "flat spelled names rare lead name_codes codes signature masks keys anchor".split()


def anchors(records: DataFrame) -> DataFrame:
    """Pairs of markets that are alone in their venue with their unknown words, years, levels and stage: ids and codes of both."""
    of = lambda v, c: F.max(F.when(F.col("venue") == v, F.col(c))).alias(f"{v.lower()}_{c}")
    groups = records.where(F.col("anchor").isNotNull()).groupBy("anchor").agg(
        F.count_if(F.col("venue") == "K").alias("k"), F.count_if(F.col("venue") == "P").alias("p"),
        *[of(v, c) for v in "KP" for c in ("market_id", "name_codes", "codes")],
    )
    return groups.where("k = 1 AND p = 1").drop("k", "p", "anchor")


def associations(found: DataFrame, least: int = 4) -> dict[str, dict[int, dict[int, float]]]:
    """How strongly frequent words of one venue's names go with words of the other venue's texts, by normalised pointwise mutual
    information over all anchors, each word's strongest partner being 1: ``K`` and ``P``, {code: {code: strength}}.

    Words are frequent words of either venue, so that the table's size has the bound of their number, not that of the data.
    """
    total = found.count()
    out = {}
    for mine, other in (("K", "P"), ("P", "K")):
        a, b = f"{mine.lower()}_name_codes", f"{other.lower()}_codes"
        single = lambda c: {r.x: r.n for r in found.select(F.explode(c).alias("x")).groupBy("x").agg(F.count("*").alias("n")).collect()}
        one, two = single(a), single(b)
        both = found.select(F.explode(a).alias("a"), F.col(b).alias("b")).select("a", F.explode("b").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
        table: dict[int, dict[int, float]] = {}
        for r in both.collect():
            if r.n < total and (s := math.log(r.n * total / (one[r.a] * two[r.b])) / -math.log(r.n / total)) > 0.1:
                table.setdefault(r.a, {})[r.b] = s
        out[mine] = {x: {y: s / max(v.values()) for y, s in v.items()} for x, v in table.items()}
    return out


def _compare(window: int, least: float):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("position", kind="stable")
        ids, venue = block["market_id"].to_numpy(), (block["venue"] == "K").to_numpy()
        masks, marks = np.array(block["masks"].tolist(), np.int64).reshape(-1, 5), np.array(block["signature"].tolist(), np.int64).view(np.uint64).reshape(-1, 4)
        bits = np.bitwise_count(marks).sum(1)
        owned = (block["block"] == block["home"]).to_numpy()
        out = []
        for d in range(1, window):
            ok = (venue[d:] != venue[:-d]) & owned[:-d]
            for i in range(5):
                x, y = masks[d:, i], masks[:-d, i]
                ok &= (x == 0) | (y == 0) | ((x & y) != 0)
            at = np.flatnonzero(ok)
            shared = np.bitwise_count(marks[at] & marks[at + d]).sum(1)
            at = at[shared >= least * np.minimum(bits[at], bits[at + d])]
            first = venue[at]
            out.append(pd.DataFrame({"k_id": np.where(first, ids[at], ids[at + d]), "p_id": np.where(first, ids[at + d], ids[at])}))
        return pd.concat(out, ignore_index=True).drop_duplicates()

    return run


def sorted_neighbours(records: DataFrame, window: int = 24, least: float = 0.5) -> DataFrame:
    """Pairs (``k_id``, ``p_id``) of records within ``window`` positions under any sort key that contradict each other in nothing and
    share ``least`` of the trigrams of their rare words."""
    keyed = records.select("venue", "market_id", "signature", "masks", F.explode("keys").alias("key"))
    n = max(8, int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut_lineage(keyed.repartitionByRange(n, "key", "market_id").withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("range").agg(F.count("*").alias("size")).select("range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    at = F.row_number().over(Window.partitionBy("range").orderBy("key", "venue", "market_id")) - 1
    placed = ranged.withColumn("rank", at).join(F.broadcast(sizes), "range").withColumn("position", F.col("rank") + F.col("offset")).drop("range", "rank", "offset", "key")
    home = F.floor(F.col("position") / BLOCK).cast("long")
    early = (F.col("position") % BLOCK < window) & (home > 0)
    doubled = placed.withColumn("home", home).withColumn("block", F.explode(F.when(early, F.array(home, home - 1)).otherwise(F.array(home))))
    return doubled.groupBy("block").applyInPandas(_compare(window, least), "k_id string, p_id string").distinct()


def _contradict(a, b) -> bool:
    return bool(a.nomination) != bool(b.nomination) or any(len(x) and len(y) and not set(x) & set(y) for x, y in ((getattr(a, c), getattr(b, c)) for c in _FACTS))


def _reversed(a, b) -> bool:
    """Whether two markets name the same things but lead with different ones, as a game's two sides."""
    if not len(a.lead) or not len(b.lead) or any(alike(x, y) for x in a.lead for y in b.lead):
        return False
    return all(any(alike(x, y) for y in b.rare) for x in a.lead) and all(any(alike(x, y) for y in a.rare) for x in b.lead)


class Judge:
    """Confidence that a market of K and one of P ask the same."""

    def __init__(self, vocabulary: Vocabulary, partners: dict[str, dict[int, dict[int, float]]]):
        self.v, self.partners = vocabulary, partners

    def cover(self, a, b, venue: str) -> tuple[float, float]:
        """Weighted share of the words of a's name that b's texts account for, and how well its worst rare word is."""
        codes, partners, known = set(b.codes), self.partners.get(venue, {}), self.v.code
        spelled, of_codes = list(b.spelled), [self.v.word[c] for c in b.codes]
        others = {*spelled, *of_codes}
        joined_a, joined_b = list(zip(a.flat, a.flat[1:])), [x + y for x, y in zip(b.flat, b.flat[1:])]
        got = total = 0.0
        worst = 1.0
        for w in sorted(a.names, key=known.__contains__):  # unknown words first: most pairs end there
            s = 1.0 if w in others else 0.0
            if len(w) == 1 and not s and any(v[0] == w for v in (*spelled, *of_codes)):
                continue
            if not s and w in known:
                s = max((x for c, x in partners.get(known[w], {}).items() if c in codes), default=0.0)
            if s < 1:  # two known words that differ by a letter are two words
                s = max(s, max((alike(w, v) for v in spelled), default=0.0))
                if w not in known:
                    s = max(s, max((alike(w, v) for v in of_codes), default=0.0))
                if s < 0.75 and len(w) >= 6:
                    s = max(s, max((close(w, v) for v in joined_b), default=0.0))
                if s < 0.75:
                    s = max(s, 0.9 * any(w in pair and any(close("".join(pair), v) for v in (*spelled, *of_codes) if len(v) >= 6) for pair in joined_a))
            weight = self.v.weight(w)
            got += weight * s
            total += weight
            if self.v.rare(w):
                worst = min(worst, s)
                if worst < 0.8:
                    return 0.0, worst
        return (got / total if total else 0.0), worst

    def confidence(self, k, p) -> float:
        """0 where they contradict each other or a rare word of either has no counterpart."""
        if _contradict(k, p) or _reversed(k, p) or not len(k.names) or not len(p.names):
            return 0.0
        a, worst = self.cover(k, p, "K")
        if worst < 0.8:
            return 0.0
        b, worst = self.cover(p, k, "P")
        if worst < 0.8:
            return 0.0
        known = len(k.years) > 0 and len(p.years) > 0
        days = abs(k.ends_day - p.ends_day) if k.ends_day == k.ends_day and p.ends_day == p.ends_day else 400
        off = min(days, abs(days - 365))  # the venues often name days a year apart
        return round(0.8 * min(a, b) + 0.1 * (1.0 if known else 0.5) + 0.1 / (1 + off / 30), 6)


def judged_pairs(pairs: DataFrame, records: DataFrame, judge: Judge, least: float) -> DataFrame:
    """``pairs`` of at least that confidence, with what assigning needs of both sides."""
    columns = ["ends_day", "flat", "spelled", *_FACTS, "nomination", "names", "rare", "lead", "codes"]
    of = lambda v: records.where(F.col("venue") == v).select(F.col("market_id").alias(f"{v.lower()}_id"), F.struct(*columns).alias(v.lower()))
    both = pairs.join(of("K"), "k_id").join(of("P"), "p_id")
    flat = both.select("k_id", "p_id", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "kp" for c in columns]).repartition(_parts(pairs), "k_id", "p_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            k, p = ([_Side(*x) for x in b[[f"{s}_{c}" for c in columns]].itertuples(index=False)] for s in "kp")
            sure = np.array([judge.confidence(x, y) for x, y in zip(k, p)], float)
            yield b.assign(confidence=sure)[sure >= least][[f.split()[0] for f in _EDGE.split(", ")]]

    return flat.mapInPandas(run, _EDGE)


class _Side:
    __slots__ = ("ends_day", "flat", "spelled", *_FACTS, "nomination", "names", "rare", "lead", "codes")

    def __init__(self, *values):
        for c, v in zip(self.__slots__, values):
            setattr(self, c, v)


_LIGHT = ["years", "months", "days", "levels", "nomination", "rare", "lead"]
_TYPES = {"years": "array<int>", "months": "array<int>", "days": "array<int>", "levels": "array<string>", "nomination": "boolean", "rare": "array<string>", "lead": "array<string>"}
_EDGE = "k_id string, p_id string, confidence double, " + ", ".join(f"{s}_{c} {_TYPES[c]}" for s in "kp" for c in _LIGHT)


def components(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``component``: the smallest K id that they are connected to. Labels travel along pairs until none changes, after
    some rounds also from market to market of a label and along labels, so that a long chain takes few rounds."""
    pairs = cut_lineage(pairs)
    at, rounds = pairs.select("k_id", "p_id", F.col("k_id").alias("component")), 0
    while True:
        by_p = at.groupBy("p_id").agg(F.min("component").alias("x"))
        by_k = at.join(by_p, "p_id").groupBy("k_id").agg(F.min("component").alias("c"), F.min("x").alias("y"))
        if rounds >= 3:
            own = cut_lineage(by_k.join(by_k.groupBy("c").agg(F.min("y").alias("z")), "c").select("k_id", "c", F.col("z").alias("y")))
            by_k = own.join(own.select(F.col("k_id").alias("y"), F.col("y").alias("z")), "y").select("k_id", "c", F.col("z").alias("y"))
        by_k = cut_lineage(by_k)
        if by_k.where("c <> y").isEmpty():
            return pairs.join(by_k.select("k_id", F.col("y").alias("component")), "k_id")
        at, rounds = pairs.select("k_id", "p_id").join(by_k.select("k_id", F.col("y").alias("component")), "k_id"), rounds + 1


def heaviest(weights: np.ndarray | list[dict[int, float]]) -> list[tuple[int, int]]:
    """One-to-one pairs (row, column) of the largest total, none of weight 0; ``weights`` of six decimals: a matrix, or {column: weight}
    of every row.

    Shortest augmenting paths from row to row, each over the weights that it meets alone and in whole numbers, so that totals are
    compared exactly. ``gain`` and ``price`` are the duals: gain + price >= weight, and equal for pairs. In a tie the rows before
    keep their columns, and a row takes the first free column.
    """
    rows = [{j: c for j, x in (r.items() if isinstance(r, dict) else enumerate(r)) if (c := round(float(x) * 1_000_000)) > 0} for r in weights]
    gain, price, owner, column = [0] * len(rows), {}, {}, {}
    for start, row in enumerate(rows):
        gain[start] = max((x - price.get(j, 0) for j, x in row.items()), default=0)
        if gain[start] <= 0:
            gain[start] = 0
            continue
        least, way, reached, passed, heap = {}, {}, {start: 0}, set(), []
        i, best, alone, end = start, gain[start], start, None  # the path ends with a row that stays alone, or with a free column
        while True:
            if reached[i] + gain[i] < best:
                best, alone = reached[i] + gain[i], i
            for j, x in rows[i].items():
                d = reached[i] + gain[i] - x + price.get(j, 0)
                if d < best and d < least.get(j, best) and j not in passed:
                    least[j], way[j] = d, i
                    heapq.heappush(heap, (d, j in owner, j))
            while heap and (heap[0][-1] in passed or heap[0][0] > least[heap[0][-1]]):
                heapq.heappop(heap)
            if not heap or heap[0][0] >= best:
                break
            d, _, j = heapq.heappop(heap)
            if j not in owner:
                best, end = d, j
                break
            passed.add(j)
            i = owner[j]
            reached[i] = d
        for i, d in reached.items():
            gain[i] -= best - d
        for j in passed:
            price[j] = price.get(j, 0) + best - least[j]
        j = column.pop(alone, None) if end is None else end
        while j is not None:
            i = owner[j] = way[j]
            j, column[i] = column.get(i), j
    return sorted(column.items())


def _classes(ids: list[str], sides: dict, partners: dict[str, dict[str, float]]) -> dict[str, str]:
    """Markets of a venue that ask the same question, by their smallest id: those that a common partner goes with about as well as with
    any (``SAME``) and that contradict each other in nothing."""
    root = {i: i for i in ids}

    def top(i: str) -> str:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    members: dict[str, list[str]] = {}
    best: dict[str, float] = {}
    for i in ids:
        for q, c in partners[i].items():
            best[q] = max(best.get(q, 0.0), c)
    for i in ids:
        for q, c in sorted(partners[i].items()):
            if c >= best[q] - SAME:
                members.setdefault(q, []).append(i)
    for group in members.values():
        heads: list[str] = []
        for i in group:
            a = sides[i]
            for h in heads:
                b = sides[h]
                alone = [w for w in a.rare if not any(alike(w, x) >= 0.8 for x in b.rare)], [w for w in b.rare if not any(alike(w, x) >= 0.8 for x in a.rare)]
                if not _contradict(a, b) and not _reversed(a, b) and not (alone[0] and alone[1]):
                    x, y = sorted((top(i), top(h)))
                    root[y] = x
                    break
            else:
                heads.append(i)
    return {i: top(i) for i in ids}


class _Light:
    __slots__ = ("id", *_LIGHT)

    def __init__(self, id: str, values):
        self.id = id
        for c, v in zip(_LIGHT, values):
            setattr(self, c, v)


def solve(partners: tuple[dict, dict], sides: tuple[dict, dict]) -> Iterator[tuple[str, str, float]]:
    """All pairs of members of the classes of one component that are assigned to each other. ``partners``: {id: {id of the other venue:
    confidence}} of K and of P, ``sides``: what ``_Light`` knows of every id."""
    first = list(dict.fromkeys(p for k in sorted(partners[0]) for p in sorted(partners[0][k])))
    of = [_classes(ids, sides[s], partners[s]) for s, ids in enumerate((sorted(partners[0]), first))]
    at = [{h: i for i, h in enumerate(sorted(set(of[s].values())))} for s in (0, 1)]
    weights: list[dict[int, float]] = [{} for _ in at[0]]
    members: tuple[dict, dict] = ({}, {})
    for k, found in partners[0].items():
        row = weights[at[0][of[0][k]]]
        for p, c in found.items():
            j = at[1][of[1][p]]
            row[j] = max(row.get(j, 0.0), c)
    for s in (0, 1):
        for i, h in of[s].items():
            members[s].setdefault(at[s][h], []).append(i)
    for i, j in heaviest([dict(sorted(row.items())) for row in weights]):
        for k in members[0][i]:
            for p in members[1][j]:
                yield k, p, partners[0][k].get(p, weights[i][j])


def _solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Components one after the other; rows come in order of their component. Of one, its pairs and what is known of every market are held once."""
    columns, n = ["component", *[f.split()[0] for f in _EDGE.split(", ")]], len(_LIGHT)

    def components_of_rows() -> Iterator[tuple[str, str, float]]:
        current, partners, sides = None, ({}, {}), ({}, {})
        for b in batches:
            for component, k, p, c, *known in b[columns].itertuples(index=False, name=None):
                if component != current:
                    yield from solve(partners, sides)
                    current, partners, sides = component, ({}, {}), ({}, {})
                for s, i in enumerate((k, p)):
                    if i not in sides[s]:
                        sides[s][i] = _Light(i, known[s * n : (s + 1) * n])
                k, p = sides[0][k].id, sides[1][p].id
                partners[0].setdefault(k, {})[p] = partners[1].setdefault(p, {})[k] = c
        yield from solve(partners, sides)

    rows = components_of_rows()
    while done := list(islice(rows, BATCH)):
        yield pd.DataFrame(done, columns=["k_id", "p_id", "confidence"])


def assign_rounds(pairs: DataFrame) -> DataFrame:
    """One-to-one pairs (k_id, p_id, confidence) in rounds: those that are best for both sides; ties by id, so that every round settles
    the best pair left. At least half of the largest total."""
    done = None
    left = cut_lineage(pairs)
    while not left.isEmpty():
        by_k = F.row_number().over(Window.partitionBy("k_id").orderBy(F.desc("confidence"), "p_id"))
        by_p = F.row_number().over(Window.partitionBy("p_id").orderBy(F.desc("confidence"), "k_id"))
        won = cut_lineage(left.select("*", by_k.alias("i"), by_p.alias("j")).where("i = 1 AND j = 1").drop("i", "j"))
        done = won if done is None else done.unionByName(won)
        left = cut_lineage(left.join(won.select("k_id"), "k_id", "left_anti").join(won.select("p_id"), "p_id", "left_anti"))
    return left if done is None else done


def assign(edges: DataFrame, large: int | None = None) -> DataFrame:
    """Pairs of the assignment with the largest total confidence, exactly for every component. Only a caller who names ``large`` gets
    components of more pairs than that in rounds of mutually best pairs instead."""
    at = components(edges)
    exact = lambda df: df.repartition("component").sortWithinPartitions("component").mapInPandas(_solved, "k_id string, p_id string, confidence double")
    if large is None:
        return exact(at)
    sized = at.join(at.groupBy("component").agg(F.count("*").alias("size")), "component")
    beyond = cut_lineage(sized.where(F.col("size") > large).select("k_id", "p_id", "confidence"))
    few = exact(sized.where(F.col("size") <= large))
    return few if beyond.isEmpty() else few.unionByName(assign_rounds(beyond))


def link_markets(k_markets: DataFrame, p_markets: DataFrame, window: int = 24, least: float = 0.65, ends_day: str = "ends_day") -> DataFrame:
    """Pairs (``k_id``, ``p_id``, ``confidence``) of markets that ask the same question.

    Both inputs have ``market_id``, ``name``, ``event_title``, ``description`` and ``ends_day`` (int days, null where unknown).
    Null and empty texts say nothing; a market without a name is known by its event title, and one without either has no
    pair. Listings of one market count as one (that with most texts). Markets of a venue that ask the same question as one
    of the other come out all, in all pairs. Ties go to the smaller id. Empty sides give no pairs; further columns are ignored.
    """
    markets = cut_lineage(read_markets(k_markets, "K", ends_day).unionByName(read_markets(p_markets, "P", ends_day)))
    vocabulary = Vocabulary(*frequent_words(markets))
    records = cut_lineage(with_records(markets, vocabulary))
    found = cut_lineage(anchors(records))
    judge = Judge(vocabulary, associations(found))
    pairs = sorted_neighbours(records, window).unionByName(found.select(F.col("k_market_id").alias("k_id"), F.col("p_market_id").alias("p_id"))).distinct()
    return assign(judged_pairs(pairs, records, judge, least))
