"""Timestamps of mixed forms, precisions and zones as one UTC instant.

All forms are branches of one regular expression with named groups. One ``regexp_replace`` rewrites a matching text to
its components (Java replaces a group that took no part by nothing), one ``split`` takes them apart, and everything
after that is integer arithmetic in the JVM: calendar ranges, days from the civil date, offset. Only wall times in a
named zone consult zone rules (``to_utc_timestamp``: a wall time that never occurs keeps the offset before the change,
one that occurs twice is the earlier instant; with ``near`` given, the instant nearer to it).
"""

from __future__ import annotations


from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Hours or hours and minutes ahead of UTC of zone abbreviations that name one offset.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "UT": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "MSK": 180, "IST": 330, "SGT": 480, "HKT": 480, "AWST": 480, "JST": 540, "KST": 540, "ACST": 570, "ACDT": 630,
    "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360,
    "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
#: General names: they leave open whether summer time holds, so the row's own zone decides.
GENERAL = ("ET", "CT", "MT", "PT", "AET", "ACT", "AWT", "LOCAL")

#: Fixed values of the calendar.
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
MONTH_DAYS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
DAYS_BEFORE = tuple(sum(MONTH_DAYS[:i]) for i in range(12))

_SP = r"[\s\u00a0\u2007\u202f\u3000\ufeff\u200b]"
_MON = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
_DAY = r"(?:mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?\.?"
_TIME = rf"(?<h>\d{{1,2}})(?::(?<mi>\d{{2}})(?::(?<s>\d{{2}})(?:[.,](?<f>\d+))?)?)?(?:{_SP}*(?<ap>[ap])\.?m\.?)?"
_ZONE = (
    rf"(?:(?:(?:utc|gmt){_SP}*)?(?<zs>[+−-])(?<zh>\d{{1,2}})(?::?(?<zm>\d{{2}}))?"
    rf"|(?<zn>[a-z]{{1,5}})|(?<zi>[a-z_]+(?:/[a-z0-9_+-]+)+))(?:{_SP}*[\[(](?<zb>[a-z0-9_/+ -]+)[\])])?"
    rf"|[\[(](?<zc>[a-z0-9_/+-]+)[\])]"
)
_DATES = "|".join(
    (
        r"(?<ya>\d{4})(?<sa>[-/.])(?<ma>\d{1,2})\k<sa>(?<da>\d{1,2})",
        r"(?<na>\d{1,2})(?<sb>[-/.])(?<nb>\d{1,2})\k<sb>(?<nc>\d{4}|\d{2})",
        rf"(?:{_DAY},?{_SP}+)?(?<db>\d{{1,2}})(?:st|nd|rd|th)?(?:-|{_SP}+)(?<mb>{_MON})(?:-|,?{_SP}+)(?<yb>\d{{4}}|\d{{2}})",
        rf"(?:{_DAY},?{_SP}+)?(?<mc>{_MON}){_SP}+(?<dc>\d{{1,2}})(?:st|nd|rd|th)?,?{_SP}+(?<yc>\d{{4}})",
    )
)
#: The one alternation: counts of seconds or finer units since 1970, packed digits, or a date with or without time and zone.
PATTERN = (
    rf"(?i)^{_SP}*(?:(?<es>-?\d{{10}}|-?\d{{13}}|-?\d{{16}}|-?\d{{19}})(?:\.(?<ef>\d+))?"
    rf"|(?<py>\d{{4}})(?<pm>\d{{2}})(?<pd>\d{{2}})(?:t?(?<ph>\d{{2}})(?<pi>\d{{2}})(?:(?<ps>\d{{2}})(?:[.,](?<pf>\d+))?)?"
    rf"{_SP}*(?:(?<pz>z|utc|gmt)|(?<pzs>[+-])(?<pzh>\d{{2}}):?(?<pzm>\d{{2}})?)?)?"
    rf"|(?:{_DATES})(?:(?:t|,?{_SP}+(?:at{_SP}+)?){_TIME}{_SP}*(?:{_ZONE})?)?){_SP}*$"
)
_MARK, _SEP = "\u0001", "\u0002"
_PARTS = {
    "es": "es", "ef": "ef", "year": "ya yb yc py", "month": "ma pm", "name": "mb mc", "day": "da db dc pd", "n1": "na", "n2": "nb", "n3": "nc",
    "hour": "h ph", "minute": "mi pi", "second": "s ps", "fraction": "f pf", "half": "ap", "sign": "zs pzs", "zone_h": "zh pzh", "zone_m": "zm pzm",
    "zone_name": "zn pz", "zone_id": "zi zc", "zone_note": "zb",
}
_REPLACEMENT = _MARK + _SEP.join("".join(f"${{{g}}}" for g in groups.split()) for groups in _PARTS.values())
#: The form that is plain already and no case of the first problem.
PLAIN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?Z$"


def components(text: Column) -> Column:
    """Array of the components in the order of ``_PARTS``, or null where no branch matches. Evaluate once, in its own select."""
    packed = F.regexp_replace(text, F.lit(PATTERN), F.lit(_REPLACEMENT))
    return F.when(packed.startswith(_MARK), F.split(F.substr(packed, F.lit(2)), _SEP))


def _lookup(pairs: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def known_zones(spark: SparkSession) -> list[str]:
    """The zone names that this JVM has rules for."""
    return sorted(x for x in spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds() if "/" in x or x in ("UTC", "GMT"))


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


def epoch_days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a civil date, by integer arithmetic on the columns ``y``, ``m``, ``d``."""
    before = F.get(F.array(*[F.lit(x) for x in DAYS_BEFORE]), (m - 1).cast("int"))
    past = F.when(m > 2, y).otherwise(y - 1)
    return y * 365 + _div(past, 4) - _div(past, 100) + _div(past, 400) + before + d - 719_528


def _micros(fraction: Column) -> Column:
    return F.coalesce(F.rpad(F.substring(fraction, 1, 6), 6, "0").try_cast("long"), F.lit(0))


#: Steps of the reading; each is its own projection, so that later steps refer to finished columns.
def steps(text: Column, date_order: Column, zones: list[str], feed_zone: Column, near_us: Column | None) -> list[dict[str, Column]]:
    p = {k: F.nullif(F.get(F.col("__ts_parts"), F.lit(i)), F.lit("")) for i, k in enumerate(_PARTS)}
    c = lambda k: F.col(f"__ts_{k}")
    raw = {k: p[k].try_cast("long") for k in ("es", "year", "month", "day", "n1", "n2", "n3", "hour", "minute", "second")}
    named = F.position(F.lower(F.substring(p["name"], 1, 3)), F.lit(MONTHS))
    code = F.upper(p["zone_name"])
    fixed = F.try_element_at(F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv]), code)
    taken = raw | {
        "named": named,
        "digits": F.length(F.ltrim(p["es"], F.lit("-"))),
        "sub": _micros(p["ef"]),
        "short_year": F.coalesce(F.length(p["year"]), F.length(p["n3"])) == 2,
        "micros": _micros(p["fraction"]),
        "half": F.lower(p["half"]),
        "ahead": F.when(p["sign"] == "+", 1).when(p["sign"].isNotNull(), -1),
        "zone_h": p["zone_h"].try_cast("int"),
        "zone_m": F.coalesce(p["zone_m"].try_cast("int"), F.lit(0)),
        "code": code,
        "fixed": fixed,
        "zone_id": F.coalesce(p["zone_id"], feed_zone),
        "order": F.lower(date_order),
    }
    order = c("order")
    year_first = (order == "ymd") & c("short_year")
    civil = {
        "y": F.coalesce(c("year"), F.when(year_first, c("n1")).otherwise(c("n3"))) + F.when(c("short_year"), 2000).otherwise(0),
        "mo": F.when(c("named") > 0, F.floor((c("named") + 2) / 3)).otherwise(
            F.coalesce(c("month"), F.when(order == "mdy", c("n1")).when((order == "dmy") | year_first, c("n2")))
        ),
        "d": F.coalesce(c("day"), F.when(order == "mdy", c("n2")).when(order == "dmy", c("n1")).when(year_first, c("n3"))),
        "h": F.when(c("half").isNull(), F.coalesce(c("hour"), F.lit(0))).when(
            c("hour").between(1, 12), c("hour") % 12 + F.when(c("half") == "p", 12).otherwise(0)
        ),
        "whole": c("hour").isNull() | c("minute").isNotNull() | c("half").isNotNull(),
        "of_day": F.coalesce(c("minute"), F.lit(0)) * 60 + F.coalesce(c("second"), F.lit(0)),
        "clock": (F.coalesce(c("minute"), F.lit(0)) <= 59) & (F.coalesce(c("second"), F.lit(0)) <= 59),
        "counted": F.when(c("digits") == 10, c("es") * 1_000_000 + F.when(c("es") < 0, -c("sub")).otherwise(c("sub")))
        .when(c("digits") == 13, c("es") * 1_000 + _div(c("sub"), 1_000))
        .when(c("digits") == 16, c("es"))
        .when(c("digits") == 19, _div(c("es"), 1_000)),
        "offset": F.when(c("ahead").isNotNull(), F.when((c("zone_h") <= 18) & (c("zone_m") <= 59), (c("zone_h") * 3_600 + c("zone_m") * 60) * c("ahead")))
        .when(c("code").isNotNull(), c("fixed") * 60),
        "zone": F.when(c("ahead").isNull() & (c("code").isNull() | c("code").isin(*GENERAL)) & c("zone_id").isin(*zones), c("zone_id")),
    }
    leap = ((c("y") % 4 == 0) & (c("y") % 100 != 0)) | (c("y") % 400 == 0)
    last = F.when((c("mo") == 2) & leap, 29).otherwise(F.get(F.array(*[F.lit(x) for x in MONTH_DAYS]), (c("mo") - 1).cast("int")))
    real = c("whole") & c("clock") & (c("y") >= 1) & c("mo").between(1, 12) & (c("d") >= 1) & (c("d") <= last) & c("h").between(0, 23)
    wall = (epoch_days(c("y"), c("mo"), c("d")) * 86_400 + c("h") * 3_600 + c("of_day")) * 1_000_000 + c("micros")
    found = [
        {"parts": components(text)}, taken, civil, {"wall": F.when(real, wall).cast("long")},
        {"early": F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(c("wall")), c("zone")))},
    ]
    in_zone = c("early")
    if near_us is not None:
        day_on = c("early") + 86_400_000_000
        found += [
            {"late": c("wall") - (F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(day_on), c("zone"))) - day_on)},
            {"twice": F.when(c("late") > c("early"), F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(c("late")), c("zone"))) == c("wall"))},
        ]
        in_zone = F.when(c("twice") & (F.abs(c("late") - near_us) < F.abs(c("early") - near_us)), c("late")).otherwise(c("early"))
    found.append({"utc": F.coalesce(c("counted"), c("wall") - c("offset").cast("long") * 1_000_000, in_zone).cast("long")})
    return found
