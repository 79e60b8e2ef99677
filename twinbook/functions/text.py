"""Text features of market names: tokens, rule features and similarity parts.

Everything but the NFKD folding and the block-matching ratio is built-in expressions; those two are Arrow functions.
"""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Words that say nothing of the outcome, and those that say nothing of what must happen.
FILLERS = "a an and are be by do does for happen happens in is of on or the to whether who will win wins winning".split()
PHRASE_FILLERS = "a an and are at be by do does for happen happens in is of on or s the to whether who will".split()
#: The patterns of the rules on names and descriptions.
THRESHOLDS = [r"\btop\s+(\d+)\b", r"\bat\s+least\s+(\d+)\b", r"\bover\s+(\d+)\b", r"\bunder\s+(\d+)\b", r"\bexactly\s+(\d+)\b"]
YEAR = r"\b(?:19|20)\d{2}\b"
_UNIT = r"(?:%|percent(?:age)?(?:\s+points?)?|points?|votes?|goals?|runs?|seats?|games?|sets?|strokes?|seconds?|minutes?)"
_COUNT = r"\d+(?:\.\d+)?(?:\s*(?:[-–—]|to)\s*\d+(?:\.\d+)?)?"
MARGIN = rf"\bby\s+(?:(?:at\s+least|at\s+most|more\s+than|less\s+than|over|under|exactly)\s+{_COUNT}\s*(?:{_UNIT})?|{_COUNT}\s*{_UNIT})(?:\W|$)"
STAGE = r"\bstage\s+(\d+)\b"
BEFORE_YEAR = r"\bbefore\s+((?:19|20)\d{2})\b"
DISTRICT = r"\b([A-Za-z]{2}-\d{1,2})\b"
CAMPAIGN = r"\b(?:run|running)\s+for\b|\bannounce(?:s|d|ment|ing)?\s+(?:a\s+)?(?:presidential\s+)?campaign\b"
NOMINATION_WIN = r"\bwin(?:s|ning)?\b[^?]*\b(?:nomination|nominee)\b"
BALLOT = r"\b(?:be|appear|get|qualify)\b[^?]*\bon\s+the\s+ballot\b"
ELECTION_WIN = r"\bwin(?:s|ning)?\b[^?]*\b(?:election|presidency)\b"
PHASES = {
    "first_round": r"\b(?:first|1st)[\s-]+round\b", "second_round": r"\b(?:second|2nd)[\s-]+round\b", "runoff": r"\brun(?:[\s-]?off)\b",
    "primary": r"\bprimar(?:y|ies)\b",
}
ELECTION_CONTEXT = (
    r"\b(?:election|electoral|president(?:ial)?|senat(?:e|or|orial)|house|congress(?:ional)?|governor|gubernatorial|mayor|mayoral|"
    r"democrat(?:ic)?|republican|candidate|ballot|vote|voting|nominee|nomination)\b|\b[A-Z]{2}-\d{1,2}\b"
)
NOMINATION = r"\b(?:nominee|nomination)\b"
RESOLVES = r"\b(?:market|contract)\s+(?:will\s+)?resolve(?:s|d)?\b"
TITLES = {
    "ballon_dor": r"\bballon\s+d[\s'’]*or\b", "golden_ball": r"\bgolden\s+ball\b", "silver_ball": r"\bsilver\s+ball\b",
    "bronze_ball": r"\bbronze\s+ball\b", "golden_boot": r"\bgolden\s+boot\b", "young_player_award": r"\b(?:best\s+)?young\s+player\s+award\b",
    "golden_glove": r"\bgolden\s+glove\b", "fair_play_award": r"\bfair\s+play\s+award\b", "the_open_championship": r"\bthe\s+open\s+championship\b",
    "tour_championship": r"\btour\s+championship\b", "us_open": r"\bu\.?s\.?\s+open\b", "masters": r"\bmasters(?:\s+tournament)?\b",
    "pga_championship": r"\bpga\s+championship\b", "ryder_cup": r"\bryder\s+cup\b",
}
PAIR_CONTEXT = r"\b(?:couple|pair|duo)\b"
SEVERAL = r"(?:\band\b|&)"


@F.pandas_udf(StringType())
def ascii_fold(values: pd.Series) -> pd.Series:
    """NFKD, and what is not ASCII then left out; null stays null."""
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode())


@F.pandas_udf(DoubleType())
def block_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Share of matching blocks (Ratcliff-Obershelp) of two texts; not symmetric; null with a null side."""
    return pd.Series([None if a is None or b is None else SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)], dtype="float64")


@F.pandas_udf(DoubleType())
def best_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """The larger block ratio of two texts as they are and with sorted words; equal pairs of a batch are compared once."""
    known: dict[tuple[str, str], float] = {}
    out = []
    for a, b in zip(left, right):
        if a is None or b is None:
            out.append(None)
            continue
        if (r := known.get((a, b))) is None:
            x, y = " ".join(sorted(a.split(" "))), " ".join(sorted(b.split(" ")))
            r = SequenceMatcher(None, a, b).ratio()
            if r < 1 and (x, y) != (a, b):
                r = max(r, SequenceMatcher(None, x, y).ratio())
            known[a, b] = r
        out.append(r)
    return pd.Series(out, dtype="float64")


def _i(pattern: str) -> str:
    """The pattern without regard to case and, as in Unicode texts, to the kind of letters and blanks."""
    return f"(?iuU){pattern}"


def tokens(folded: Column) -> Column:
    return F.regexp_extract_all(F.lower(folded), F.lit(r"[a-z0-9]+"), F.lit(0))


def normalize(folded: Column) -> Column:
    """Tokens but for fillers, in order, in one text; the empty text for null."""
    return F.coalesce(F.array_join(F.filter(tokens(folded), lambda t: ~t.isin(*FILLERS)), " "), F.lit(""))


def words(normalized: Column) -> Column:
    """Distinct words of a normalized text."""
    return F.array_distinct(F.filter(F.split(normalized, " "), lambda t: t != ""))


def numbers(text: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(_i(pattern)), F.lit(1)), lambda x: x.try_cast("int"))


def thresholds(text: Column) -> Column:
    """Numbers after top, at least, over, under and exactly, by pattern and then by place."""
    return F.flatten(F.array(*[numbers(text, p) for p in THRESHOLDS]))


def districts(text: Column) -> Column:
    """District codes in capitals without leading zeros."""
    codes = F.regexp_extract_all(text, F.lit(_i(DISTRICT)), F.lit(1))
    return F.transform(codes, lambda x: F.concat(F.upper(F.substring(x, 1, 3)), F.regexp_extract(x, r"-0?(\d+)$", 1)))


def has(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(_i(pattern)), F.lit(False))


def titles(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(has(text, p), k) for k, p in TITLES.items()]))


def years(*texts: Column) -> Column:
    """Distinct years named by any of the texts, ascending."""
    found = F.regexp_extract_all(F.concat_ws(" ", *texts), F.lit(_i(YEAR)), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int"))))


#: A sentence on how a contract resolves: from the text's start or a mark and a blank on, without a mark before its verb.
RESOLUTION = rf"(?:^|[.!?]\s+)([^.!?]*{RESOLVES}[^.!?]*)"


def _any_matches(texts: Column, pattern: str) -> Column:
    return F.coalesce(F.exists(texts, lambda s: s.rlike(_i(pattern))), F.lit(False))


def phases(title: Column, description: Column) -> Column:
    """Phases of an election that define the contract: those of the title, and those of sentences on how it resolves."""
    found_in = F.regexp_extract_all(F.coalesce(description, F.lit("")), F.lit(_i(RESOLUTION)), F.lit(1))
    sentences = F.filter(found_in, lambda s: s.rlike(_i(ELECTION_CONTEXT)))
    found = []
    for k, p in PHASES.items():
        hit = has(title, p) | _any_matches(sentences, p)
        if k == "primary":
            hit = hit | (has(title, NOMINATION) & has(title, ELECTION_CONTEXT))
        found.append(F.when(hit, k))
    return F.array_compact(F.array(*found))


def phrase(folded_name: Column, folded_title: Column, shared: Column) -> Column:
    """What must happen: the name without shared entity words, fillers and years, or the event title, if nothing is left."""
    def kept(text: Column) -> Column:
        all_ = F.coalesce(tokens(text), F.array().cast("array<string>"))
        return F.array_join(F.filter(all_, lambda t: ~F.array_contains(shared, t) & ~t.isin(*PHRASE_FILLERS) & ~t.rlike(r"^(?:19|20)[0-9]{2}$")), " ")

    return F.coalesce(F.nullif(kept(folded_name), F.lit("")), kept(folded_title))


def overlap(a: Column, b: Column) -> Column:
    """Shared words over the larger number of words; 0 without words."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / most)
