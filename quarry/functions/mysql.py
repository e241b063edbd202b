"""Functions of the MySQL dialect that Spark lacks or gives another meaning, as column expressions."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


# strings
def field(value, *options) -> Column:
    """FIELD: the first place of the value among the options, 0 if there is none or it is NULL."""
    return F.coalesce(F.array_position(F.array(*[F.lit(o) for o in options]), _c(value)), F.lit(0)).cast("long")


def substring_index(text, mark: str, n: int) -> Column:
    return F.substring_index(_c(text), mark, n)


def to_base64(text) -> Column:
    return F.base64(_c(text).cast("binary"))


def from_base64(text) -> Column:
    return F.unbase64(_c(text)).cast("string")


def instr(text, part: str) -> Column:
    return F.instr(_c(text), part)


def insert(text, at: int, n: int, new: str) -> Column:
    """INSERT(): unchanged if ``at`` is outside the text."""
    t = _c(text)
    done = F.concat(F.substring(t, F.lit(1), F.lit(at - 1)), F.lit(new), F.substring(t, F.lit(at + max(n, 0)), F.length(t)))
    return F.when(F.lit(at).between(1, F.length(t)), done).otherwise(t)


def strcmp(a, b) -> Column:
    return F.when(_c(a) < _c(b), -1).when(_c(a) > _c(b), 1).when(_c(a) == _c(b), 0)


def locate(part, text, start: int = 1) -> Column:
    """LOCATE: 0 if it isn't there or the start is below 1."""
    return F.when(F.lit(start) >= 1, F.locate(part, _c(text), max(start, 1))).otherwise(F.lit(0)).cast("long")


def elt(n, *texts) -> Column:
    """ELT: the n-th of the texts, NULL if there is none."""
    return F.try_element_at(F.array(*[F.lit(t) if isinstance(t, str) else t for t in texts]), F.when(_c(n) >= 1, _c(n).cast("int")))


def find_in_set(text, joined) -> Column:
    """FIND_IN_SET: the place of the text among comma-separated ones; 0 if it holds a comma or isn't there."""
    return F.find_in_set(_c(text), _c(joined)).cast("long")


def hexed(x) -> Column:
    """HEX of a number's integer part or of a text's bytes."""
    return F.hex(_c(x))


def trimmed(text, what: str = " ", side: str = "both") -> Column:
    """TRIM([BOTH | LEADING | TRAILING] what FROM text): whole repeats of ``what``, not its characters."""
    mark, out = f"(?:{re.escape(what)})+", _c(text)
    if side in ("both", "leading"):
        out = F.regexp_replace(out, f"^{mark}", "")
    return F.regexp_replace(out, f"{mark}$", "") if side in ("both", "trailing") else out


def rpad(text, n: int, fill: str) -> Column:
    return F.rpad(_c(text), n, fill)


def concat_ws(mark: str, *parts) -> Column:
    """CONCAT_WS: NULLs are left out."""
    return F.concat_ws(mark, *[_c(x).cast("string") for x in parts])


# numbers
def truncate(x, digits: int = 0) -> Column:
    """TRUNCATE: towards zero."""
    scale = float(10**digits)
    scaled = _c(x) * F.lit(scale)
    return F.when(scaled >= 0, F.floor(scaled)).otherwise(F.ceil(scaled)) / scale


def divide(a, b) -> Column:
    """Division that gives NULL for a zero divisor."""
    return F.try_divide(_c(a), _c(b))


def int_divide(a, b) -> Column:
    """DIV: the quotient towards zero, NULL for a zero divisor."""
    b = _c(b)
    return F.when(b != 0, truncate(F.try_divide(_c(a), b))).cast("long")


def mod(a, b) -> Column:
    """MOD with the sign of the dividend, NULL for a zero divisor."""
    return F.try_mod(_c(a), _c(b))


def logical_xor(a, b) -> Column:
    return _c(a) != _c(b)


# conversion
def to_number(text) -> Column:
    """The number that a string begins with; 0 if it begins with none."""
    head = F.regexp_extract(_c(text), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.when(_c(text).isNull(), F.lit(None).cast("double")).otherwise(F.coalesce(head.try_cast("double"), F.lit(0.0)))


def truth(x) -> Column:
    """A boolean as the integer that the dialect makes of it."""
    return _c(x).cast("int")


# dates
#: The format letters of the dialect and their patterns.
_FORMATS = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%c": "M", "%d": "dd", "%e": "d", "%H": "HH", "%k": "H", "%h": "hh", "%I": "hh", "%l": "h", "%i": "mm",
    "%s": "ss", "%S": "ss", "%f": "SSSSSS", "%p": "a", "%M": "MMMM", "%b": "MMM", "%W": "EEEE", "%a": "EEE", "%j": "DDD", "%T": "HH:mm:ss", "%r": "hh:mm:ss a",
}


def pattern(form: str) -> str:
    """A DATE_FORMAT string as a datetime pattern; other text is quoted."""
    out = []
    for part in re.findall(r"%.|[^%]+", form):
        if part == "%%":
            out.append("%")
        elif part[0] == "%":
            if part not in _FORMATS:
                raise ValueError(f"format {part} has no pattern")
            out.append(_FORMATS[part])
        else:
            out.append(re.sub(r"[A-Za-z']+", lambda m: "'" + m.group().replace("'", "''") + "'", part))
    return "".join(out)


def week(t, mode: int = 0) -> Column:
    """WEEK with mode 0 (from Sunday, 0-53), 1 (from Monday, 4 days in the year, 0-53), 2 (from Sunday, 1-53) or
    3 (from Monday, 4 days, 1-53: the ISO week)."""
    day = _c(t).cast("date")
    first = F.trunc(day, "year")
    if mode in (0, 2):
        sunday = lambda d: F.date_add(d, F.pmod(F.lit(8) - F.dayofweek(d), F.lit(7)))  # noqa: E731  the first Sunday from d
        since = lambda y: F.floor(F.datediff(day, sunday(y)) / 7) + 1
        last = F.trunc(F.date_sub(first, 1), "year")
        return F.when(day >= sunday(first), since(first)).otherwise(F.lit(0) if mode == 0 else since(last)).cast("long")
    iso = F.weekofyear(day)
    if mode == 3:
        return iso.cast("long")
    # the last days of the year may be in week 1 of the next, the first ones in the last of the year before
    return F.when((iso >= 52) & (F.month(day) == 1), 0).when((iso == 1) & (F.month(day) == 12), F.weekofyear(F.date_sub(day, 7)) + 1).otherwise(iso).cast("long")


def week_year(t, mode: int = 3) -> Column:
    """The year that the week of mode 2 or 3 belongs to."""
    day = _c(t).cast("date")
    if mode == 3:
        return F.year(F.date_add(day, F.lit(4) - F.weekday(day) - 1)).cast("long")
    begins = F.date_sub(day, F.dayofweek(day) - 1)  # its Sunday
    return F.year(begins).cast("long")


def date_format(t, form: str) -> Column:
    """DATE_FORMAT. The letters of weeks, weekdays and ordinal days have no pattern and are computed."""
    at, out = _c(t), []
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    day = F.dayofmonth(at)
    tail = F.when(day.between(11, 13), "th").when(day % 10 == 1, "st").when(day % 10 == 2, "nd").when(day % 10 == 3, "rd").otherwise("th")
    own = {
        "%U": lambda: two(week(at, 0)), "%u": lambda: two(week(at, 1)), "%V": lambda: two(week(at, 2)), "%v": lambda: two(week(at, 3)), "%X": lambda: week_year(at, 2).cast("string"), "%x": lambda: week_year(at, 3).cast("string"),
        "%w": lambda: (F.dayofweek(at) - 1).cast("string"), "%D": lambda: F.concat(day.cast("string"), tail),
    }
    for part in re.findall(r"%[UuVvXxwD]|(?:(?!%[UuVvXxwD])(?:%.|[^%]))+", form):
        out.append(own[part]() if part in own else F.date_format(at, pattern(part)))
    return F.concat(*out) if out else F.lit("")


def timestampdiff(unit: str, a, b) -> Column:
    """TIMESTAMPDIFF: whole units from ``a`` to ``b``, towards zero."""
    a, b = _c(a).cast("timestamp"), _c(b).cast("timestamp")
    months = {"MONTH": 1, "QUARTER": 3, "YEAR": 12}
    if unit.upper() in months:
        whole = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
        inner = lambda t: F.unix_micros(t) - F.unix_micros(F.date_trunc("month", t))
        whole = F.when((whole > 0) & (inner(b) < inner(a)), whole - 1).when((whole < 0) & (inner(b) > inner(a)), whole + 1).otherwise(whole)
        return truncate(whole / months[unit.upper()]).cast("long")
    size = {"MICROSECOND": 1, "SECOND": 10**6, "MINUTE": 6 * 10**7, "HOUR": 36 * 10**8, "DAY": 864 * 10**8, "WEEK": 6048 * 10**8}[unit.upper()]
    return _div(F.unix_micros(b) - F.unix_micros(a), size)


def _div(x: Column, by: int) -> Column:
    return F.when(x >= 0, F.floor(x / by)).otherwise(F.ceil(x / by)).cast("long")


def date_add(t, n: int, unit: str) -> Column:
    """DATE_ADD(t, INTERVAL n unit); the last day of a shorter month is not passed."""
    unit = unit.lower()
    unit, n = {"quarter": ("month", 3 * n), "week": ("day", 7 * n)}.get(unit, (unit, n))
    parts = {"year": "years", "month": "months", "day": "days", "hour": "hours", "minute": "mins", "second": "secs"}
    return _c(t).cast("timestamp_ntz") + F.make_interval(**{parts[unit]: F.lit(n)})


def date_sub(t, n: int, unit: str) -> Column:
    return date_add(t, -n, unit)


def extract(unit: str, t) -> Column:
    """EXTRACT(unit FROM t), with the joined units too (YEAR_MONTH is 202401)."""
    at = _c(t).cast("timestamp_ntz")
    own = {"YEAR": F.year, "QUARTER": F.quarter, "MONTH": F.month, "DAY": F.dayofmonth, "HOUR": F.hour, "MINUTE": F.minute, "SECOND": F.second}
    if unit.upper() == "WEEK":
        return week(at, 0)
    out = F.lit(0).cast("long")
    names = list(own)
    first, last = (unit.upper().split("_") * 2)[:2]
    chain = [u for u in names[names.index(first) : names.index(last) + 1] if u != "QUARTER" or first == "QUARTER"]
    for u in chain:
        out = out * 100 + own[u](at)
    return out


def str_to_date(text, form: str) -> Column:
    """NULL for what doesn't have the format."""
    return F.try_to_timestamp(_c(text), F.lit(pattern(form)))


def dayname(t) -> Column:
    return F.date_format(_c(t), "EEEE")


def sec_to_time(seconds) -> Column:
    """Text hh:mm:ss, negative and over a day as well."""
    s = F.abs(_c(seconds).cast("long"))
    sign = F.when(_c(seconds) < 0, "-").otherwise("")
    hours = F.floor(s / 3600).cast("long")
    return F.concat(sign, F.when(hours < 10, F.lpad(hours.cast("string"), 2, "0")).otherwise(hours.cast("string")), F.date_format(F.timestamp_seconds(s % 3600), ":mm:ss"))


def time_to_sec(text) -> Column:
    """Seconds of a text [-]h:m:s."""
    m = lambda i: F.regexp_extract(_c(text), r"^(-?)(\d+):(\d+):(\d+)", i)
    s = m(2).try_cast("long") * 3600 + m(3).try_cast("long") * 60 + m(4).try_cast("long")
    return F.when(m(1) == "-", -s).otherwise(s)


# JSON
def json_extract(doc, path: str) -> Column:
    return F.get_json_object(_c(doc), path)


_OBJECT = "map<string,variant>"


def json_object(doc) -> Column:
    """A JSON object as map of its keys to typed values; NULL for anything else."""
    return F.try_parse_json(_c(doc)).try_cast(_OBJECT)


def _path(path: str) -> list[str]:
    """The keys of a path, $.a."b c".d or a bare key."""
    return [q or w for q, w in re.findall(r'"([^"]*)"|([^.$"]+)', path)]


def _variant(value) -> Column:
    return value.cast("variant") if isinstance(value, Column) else F.parse_json(F.lit(json.dumps(value)))


def _edited(obj: Column, keys: list[str], value: Column | None, mode: str) -> Column:
    """A map with the value at the keys set, inserted, replaced or (without a value) removed; an inner key that
    is no object leaves all as it is."""
    key, there = F.lit(keys[0]), F.map_contains_key(obj, keys[0])
    rest = F.map_filter(obj, lambda k, _: k != key)
    if len(keys) > 1:
        inner = F.try_element_at(obj, key).try_cast(_OBJECT)
        return F.when(inner.isNotNull(), F.map_concat(rest, F.create_map(key, F.to_variant_object(_edited(inner, keys[1:], value, mode))))).otherwise(obj)
    if value is None:
        return rest
    done = F.map_concat(rest, F.create_map(key, value))
    return {"set": done, "insert": F.when(there, obj).otherwise(done), "replace": F.when(there, done).otherwise(obj)}[mode]


def _edit(doc, path: str, value: Column | None, mode: str) -> Column:
    obj = json_object(doc)
    return F.when(obj.isNotNull(), F.to_json(F.to_variant_object(_edited(obj, _path(path), value, mode)))).otherwise(_c(doc))


def json_set(doc, path: str, value) -> Column:
    """JSON_SET of an object's member, at any depth; values keep their types. A Python value is a literal."""
    return _edit(doc, path, _variant(value), "set")


def json_insert(doc, path: str, value) -> Column:
    """Only if the member is not there."""
    return _edit(doc, path, _variant(value), "insert")


def json_replace(doc, path: str, value) -> Column:
    """Only if the member is there."""
    return _edit(doc, path, _variant(value), "replace")


def json_remove(doc, path: str) -> Column:
    return _edit(doc, path, None, "remove")


def json_keys(doc) -> Column:
    return F.array_sort(F.json_object_keys(_c(doc)))


def json_table(df: DataFrame, doc, path: str, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """JSON_TABLE: a row for each element of the array at ``path``, with ``columns`` (name: path, type) and its
    place from 1 as ``ordinality``; a document without one gives no row."""
    rows = df.withColumn("_doc", F.try_parse_json(_c(doc))).withColumn("_all", F.try_variant_get("_doc", path, "array<variant>"))
    rows = rows.select(*[F.col(f"`{c}`") for c in df.columns], F.posexplode("_all").alias("_at", "_one"))
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_at") + 1).alias("ordinality"), *[F.try_variant_get("_one", p, t).alias(n) for n, (p, t) in columns.items()])
