"""The reading of timestamps once more, in SQL: the counterpart that the queries on instants are compared with."""

from __future__ import annotations

from twinbook.functions.timestamps import ABBREVIATIONS, GENERAL

_SPACE = r"[\s\x{00a0}\x{2007}\x{202f}\x{3000}\x{feff}\x{200b}]+"
_MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
_WEEKDAY = r"(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?\.?,? )?"
_TAIL = r"(?:(?:t|,? (?:at )?)(\d{1,2})(?::(\d{2})(?::(\d{2})(?:[.,](\d+))?)?)?(?: ?([ap])\.?m\.?)? ?((?:(?:utc|gmt) ?)?[+−-]\d{1,2}(?::?\d{2})?(?: ?[\[(][a-z0-9_/+ -]+[\])])?|[a-z]{1,5}(?: ?[\[(][a-z0-9_/+ -]+[\])])?|[a-z_]+(?:/[a-z0-9_+-]+)+(?: ?[\[(][a-z0-9_/+ -]+[\])])?|[\[(][a-z0-9_/+-]+[\])])?)?"
_REST = ["h", "mi", "s", "f", "ap", "z"]
_FORMS = [
    (r"(\d{4})([-/.])(\d{1,2})([-/.])(\d{1,2})", ["y", "s1", "m", "s2", "d"]),
    (r"(\d{1,2})([-/.])(\d{1,2})([-/.])(\d{4}|\d{2})", ["n1", "s1", "n2", "s2", "n3"]),
    (rf"{_WEEKDAY}(\d{{1,2}})(?:st|nd|rd|th)?(?:-| )({_MONTH})(?:-|,? )(\d{{4}}|\d{{2}})", ["d", "mon", "y"]),
    (rf"{_WEEKDAY}({_MONTH}) (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})", ["mon", "d", "y"]),
]
_COUNT = r"(-?\d{10}|-?\d{13}|-?\d{16}|-?\d{19})(?:\.(\d+))?"
_PACKED = r"(\d{4})(\d{2})(\d{2})(?:t?(\d{2})(\d{2})(?:(\d{2})(?:[.,](\d+))?)? ?(?:(z|utc|gmt)|([+-]\d{2}:?(?:\d{2})?))?)?"
_FIELDS = ["es", "ef", "y", "m", "mon", "d", "s1", "s2", "n1", "n2", "n3", "h", "mi", "s", "f", "ap", "z"]


def _extracted(pattern: str, names: list[str]) -> str:
    """Struct of all fields, null where the form has none or the text is of another form."""
    groups = "[" + ", ".join(f"'{n}'" for n in names) + "]"
    got = f"regexp_extract(x, '(?i)^(?:{pattern})$', {groups})"
    fields = ", ".join(f"'{n}': " + (f"nullif(({got}).{n}, '')" if n in names else "NULL::VARCHAR") for n in _FIELDS)
    return "{" + fields + "}"


def instants(name: str, source: str, text: str, columns: str, near: str | None = None) -> str:
    """CTEs that end in ``name``: ``columns`` of ``source`` (with its ``feed_id``) and ``utc_us`` of ``text``; ``near`` settles wall times that occur twice."""
    forms = [("es", _COUNT, ["es", "ef"]), ("p", _PACKED, ["y", "m", "d", "h", "mi", "s", "f", "z", "zz"])] + [(f"d{i}", p + _TAIL, n + _REST) for i, (p, n) in enumerate(_FORMS)]
    cases = []
    for key, pattern, names in forms:
        struct = _extracted(pattern, names)
        if key == "p":
            groups = "[" + ", ".join(f"'{n}'" for n in names) + "]"
            got = f"regexp_extract(x, '(?i)^(?:{pattern})$', {groups})"
            struct = struct.replace(f"'z': nullif(({got}).z, '')", f"'z': coalesce(nullif(({got}).z, ''), nullif(({got}).zz, ''))")
        cases.append(f"WHEN regexp_matches(x, '(?i)^(?:{pattern})$') THEN {struct}")
    codes = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in ABBREVIATIONS.items()) + "}"
    general = ", ".join(f"'{g}'" for g in GENERAL)
    micros = lambda c: f"coalesce(TRY_CAST(rpad(substr({c}, 1, 6), 6, '0') AS BIGINT), 0)"
    i = lambda c: f"TRY_CAST({c} AS BIGINT)"
    later = "late_us" if near is None else f"CASE WHEN abs(late_us - epoch_us({near})) < abs(early_us - epoch_us({near})) THEN late_us ELSE early_us END"
    chosen = "early_us" if near is None else later
    return f"""
  {name}_0 AS (SELECT {columns}, f.zone_name AS fz, lower(f.date_order) AS fo, trim(regexp_replace({text}, '{_SPACE}', ' ', 'g')) AS x
     FROM {source} b LEFT JOIN (SELECT feed_id AS fid, min(zone_name) AS zone_name, min(date_order) AS date_order FROM feeds WHERE feed_id IS NOT NULL GROUP BY 1) f ON b.feed_id = f.fid),
  {name}_1 AS (SELECT *, CASE {' '.join(cases)} END AS g FROM {name}_0),
  {name}_2 AS (SELECT * EXCLUDE (g), g.* FROM {name}_1 WHERE g IS NOT NULL),
  {name}_3 AS (SELECT *, coalesce(length(y), length(n3)) = 2 AS short, nullif(regexp_extract(z, '(?i)^(?:(?:utc|gmt) ?)?([+−-])\\d', 1), '') AS sg,
     {i("regexp_extract(z, '[+−-](\\d{1,2})', 1)")} AS zh, {i("nullif(regexp_extract(z, '[+−-]\\d{1,2}:?(\\d{2})', 1), '')")} AS zm,
     upper(nullif(regexp_extract(z, '(?i)^([a-z]{{1,5}})(?: ?[\\[(].*)?$', 1), '')) AS code,
     coalesce(nullif(regexp_extract(z, '(?i)^([a-z_]+(?:/[a-z0-9_+-]+)+)', 1), ''), nullif(regexp_extract(z, '(?i)^[\\[(]([a-z0-9_/+-]+)[\\])]$', 1), ''), fz) AS zid FROM {name}_2),
  {name}_4 AS (SELECT *, CASE WHEN short THEN 2000 ELSE 0 END + coalesce({i('y')}, CASE WHEN fo = 'ymd' AND short THEN {i('n1')} ELSE {i('n3')} END) AS yy,
     CASE WHEN mon IS NOT NULL THEN (instr('janfebmaraprmayjunjulaugsepoctnovdec', lower(substr(mon, 1, 3))) + 2) // 3
          ELSE coalesce({i('m')}, CASE WHEN fo = 'mdy' THEN {i('n1')} WHEN fo = 'dmy' OR (fo = 'ymd' AND short) THEN {i('n2')} END) END AS mm,
     coalesce({i('d')}, CASE WHEN fo = 'mdy' THEN {i('n2')} WHEN fo = 'dmy' THEN {i('n1')} WHEN fo = 'ymd' AND short THEN {i('n3')} END) AS dd,
     CASE WHEN ap IS NULL THEN coalesce({i('h')}, 0) WHEN {i('h')} BETWEEN 1 AND 12 THEN {i('h')} % 12 + CASE WHEN lower(ap) = 'p' THEN 12 ELSE 0 END END AS hh,
     coalesce({i('mi')}, 0) AS mn, coalesce({i('s')}, 0) AS sc,
     CASE length(ltrim(es, '-')) WHEN 10 THEN {i('es')} * 1000000 + CASE WHEN {i('es')} < 0 THEN -{micros('ef')} ELSE {micros('ef')} END WHEN 13 THEN {i('es')} * 1000 + {micros('ef')} // 1000
          WHEN 16 THEN {i('es')} WHEN 19 THEN CAST(trunc({i('es')}::DECIMAL(38,0) / 1000) AS BIGINT) END AS counted FROM {name}_3),
  {name}_5 AS (SELECT *, CASE WHEN es IS NULL AND s1 IS NOT DISTINCT FROM s2 AND (h IS NULL OR mi IS NOT NULL OR ap IS NOT NULL) AND yy >= 1 AND hh BETWEEN 0 AND 23 AND mn <= 59 AND sc <= 59
     THEN TRY_CAST(printf('%04d-%02d-%02d', yy, mm, dd) AS DATE)::TIMESTAMP + to_microseconds(((hh * 60 + mn) * 60 + sc) * 1000000 + {micros('f')}) END AS wall FROM {name}_4),
  {name}_6 AS (SELECT *, CASE WHEN sg IS NULL AND (code IS NULL OR code IN ({general})) AND zid IN (SELECT name FROM pg_timezone_names()) THEN zid END AS zone FROM {name}_5),
  {name}_7 AS (SELECT *, CASE WHEN wall IS NOT NULL AND zone IS NOT NULL THEN epoch_us(timezone(zone, wall)) END AS at_us FROM {name}_6),
  {name}_8 AS (SELECT *, coalesce(list_filter([at_us - 3600000000, at_us - 1800000000, at_us, at_us + 1800000000, at_us + 3600000000], lambda u: timezone(zone, make_timestamptz(u)) = wall), []) AS us FROM {name}_7),
  {name}_9 AS (SELECT *, coalesce(list_min(us), at_us) AS early_us, coalesce(list_max(us), at_us) AS late_us FROM {name}_8),
  {name} AS (SELECT * EXCLUDE (utc), utc AS utc_us FROM (SELECT {columns.replace('b.', '')}, coalesce(counted, epoch_us(wall) - CASE WHEN sg IS NOT NULL THEN CASE WHEN zh <= 18 AND coalesce(zm, 0) <= 59 THEN (zh * 3600 + coalesce(zm, 0) * 60) * CASE WHEN sg = '+' THEN 1 ELSE -1 END END
     WHEN code IS NOT NULL AND code NOT IN ({general}) THEN ({codes})[code] * 60 END * 1000000, {chosen}) AS utc FROM {name}_9) WHERE utc IS NOT NULL)"""
