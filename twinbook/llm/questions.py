"""What a market's texts say, read without knowing their wording: words, and the numbers, dates, directions and stage that
markets on the same question cannot differ in."""

from __future__ import annotations

import re
import unicodedata

#: Comparisons that put a figure above or below a level, the months, and what names a vote within a party.
ABOVE = ("more than", "higher than", "greater than", "at least", "above", "over", "exceeds", "exceed", "exceeding", ">")
BELOW = ("less than", "lower than", "fewer than", "falls short of", "fall short of", "at most", "below", "under", "<")
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_FULL = "january|february|march|april|june|july|august|september|october|november|december"
_SHORT = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sept?|oct|nov|dec)\.?"
NOMINATION = re.compile(r"\b(?:primar(?:y|ies)|nomin\w+)\b")
DIRECTION = re.compile(rf"(?<![a-z])({'|'.join(map(re.escape, ABOVE + BELOW))})\s*([+-]?\d+(?:[.,]\d+)*)")
#: Short names of months, and May, count only next to a number.
MONTH = re.compile(rf"\b(?:{_FULL})\b|\b{_SHORT}(?=,?\s+\d)|(?<=\d)\s+{_SHORT}(?![a-z])")
DAY = re.compile(rf"(?:\b(?:{_FULL})|\b{_SHORT})\s+(\d{{1,2}})(?![\d.])|(?<![\d.])(\d{{1,2}})\s+(?:{_FULL}|{_SHORT})(?![a-z])")
YEAR = re.compile(r"(?<![\d.])((?:19|20)\d\d)(?![\d.]\d|\d)")
#: Before a year, before its first day, and by the last day of the year before are one.
YEAR_END = re.compile(r"\bbefore (?:(?:january|jan)\.? 1,? )?((?:19|20)\d\d)\b|\b(?:december|dec)\.? 31,? ((?:19|20)\d\d)\b")
WORD = re.compile(r"[a-z]+|[^\W\d_a-z]+")
PART = re.compile(r": | - ")


def plain(text: str | None) -> str:
    """Lower case without accents, typographic marks and surplus blanks, and with ends of years in one form; empty for null."""
    if not text:
        return ""
    text = unicodedata.normalize("NFKD", text.replace("’", "'").replace("‘", "'").replace("–", "-").replace("—", "-"))
    text = re.sub(r"\s+", " ", "".join(c for c in text if not unicodedata.combining(c)).casefold()).strip()
    return YEAR_END.sub(lambda m: str(int(m[1]) - 1) if m[1] else m[2], text)


def words(text: str) -> list[str]:
    """Words in order, without comparisons and months, which ``read_question`` reads."""
    return WORD.findall(MONTH.sub(" ", DIRECTION.sub(r" \2", text)))


def _level(direction: str, number: str) -> str:
    try:
        return f"{'+' if direction in ABOVE else '-'}{float(number.replace(',', '').rstrip('.')):g}"
    except ValueError:
        return f"{'+' if direction in ABOVE else '-'}{number}"


def read_question(name: str | None, event_title: str | None, description: str | None) -> dict:
    """``parts``: words of the name by its parts; ``words``: all different words; ``years``, ``months``, ``days``, ``levels`` (signed:
    above or below); ``nomination``: whether name or title speak of a vote within a party. Empty where nothing is said."""
    n, t, d = plain(name) or plain(event_title), plain(event_title), plain(description)
    every = f"{n} . {t} . {d}"
    months = {MONTHS.index(m.strip()[:3]) + 1 for m in MONTH.findall(f"{n} . {d}") or MONTH.findall(t)}
    levels = [_level(*x) for x in DIRECTION.findall(n) or DIRECTION.findall(d) if not YEAR.fullmatch(x[1])]
    return {
        "parts": [p for p in (words(x) for x in PART.split(n)) if p],
        "words": list(dict.fromkeys(words(every))),
        "years": sorted(set(map(int, YEAR.findall(every)))), "months": sorted(months),
        "days": sorted({int(a or b) for a, b in DAY.findall(f"{n} . {d}")}), "levels": sorted(set(levels)),
        "nomination": bool(NOMINATION.search(f"{n} . {t}")),
    }
