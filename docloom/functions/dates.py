"""Dates, in UTC unless a timezone (an offset or a region) is given."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..context import SpecError, register
from ..plans.scope import Scope
from ..plans.values import kind

UNITS = ("year", "quarter", "month", "week", "day", "hour", "minute", "second", "millisecond")
MS = {"week": 604_800_000, "day": 86_400_000, "hour": 3_600_000, "minute": 60_000, "second": 1000, "millisecond": 1}


def zone(tz: str) -> str:
    """An offset as Spark takes it: +05:30; regions stay."""
    m = re.fullmatch(r"([+-])(\d{2}):?(\d{2})?", tz)
    return f"{m[1]}{m[2]}:{m[3] or '00'}" if m else tz


def moment(s: Scope, spec: Any) -> Column:
    """A date operand as a timestamp; numbers are epoch milliseconds."""
    c, t = s.typed(spec)
    return F.timestamp_millis(c.cast("long")) if kind(t) == "number" else c.cast("timestamp")


def _local(s: Scope, arg: Any) -> Column:
    """The timestamp of {date, timezone} or of a bare operand, shifted to local time."""
    if isinstance(arg, (list, tuple)) and len(arg) == 1:
        arg = arg[0]
    if isinstance(arg, dict) and "date" in arg:
        c = moment(s, arg["date"])
        return F.from_utc_timestamp(c, zone(arg["timezone"])) if "timezone" in arg else c
    return moment(s, arg)


def week(c: Column) -> Column:
    """0 to 53; weeks start on Sunday, and what comes before the first Sunday is week 0."""
    return F.floor((F.dayofyear(c) + 6 - (F.dayofweek(c) - 1)) / 7).cast("int")


PARTS = {
    "$year": F.year, "$month": F.month, "$dayOfMonth": F.dayofmonth, "$dayOfWeek": F.dayofweek, "$dayOfYear": F.dayofyear, "$hour": F.hour, "$minute": F.minute, "$second": F.second,
    "$millisecond": lambda c: F.pmod(F.unix_millis(c), F.lit(1000)).cast("int"), "$isoDayOfWeek": lambda c: F.weekday(c) + 1, "$isoWeek": F.weekofyear,
    "$isoWeekYear": lambda c: F.extract(F.lit("YEAROFWEEK"), c), "$week": week,
}
for _name, _f in PARTS.items():
    register("expression", _name, lambda s, arg, f=_f: f(_local(s, arg)))


def _shift(s: Scope, arg: dict, sign: int) -> Column:
    """startDate moved by amount units; a day that the month lacks becomes its last."""
    if arg["unit"] not in UNITS:
        raise SpecError(f"no such unit: {arg['unit']}")
    c, tz = moment(s, arg["startDate"]), arg.get("timezone")
    c = F.from_utc_timestamp(c, zone(tz)) if tz else c
    out = F.timestamp_add(arg["unit"].upper(), (s.compile(arg["amount"]) * sign).cast("long"), c)
    return F.to_utc_timestamp(out, zone(tz)) if tz else out


register("expression", "$dateAdd", lambda s, arg: _shift(s, arg, 1))
register("expression", "$dateSubtract", lambda s, arg: _shift(s, arg, -1))


@register("expression", "$dateDiff")
def _diff(s: Scope, arg: dict) -> Column:
    """Whole units between the dates, by the boundaries crossed; weeks start on startOfWeek (Sunday)."""
    a, b, unit = moment(s, arg["startDate"]), moment(s, arg["endDate"]), arg["unit"]
    if tz := arg.get("timezone"):
        a, b = F.from_utc_timestamp(a, zone(tz)), F.from_utc_timestamp(b, zone(tz))
    if unit == "year":
        return (F.year(b) - F.year(a)).cast("long")
    if unit == "quarter":
        return ((F.year(b) * 4 + F.quarter(b)) - (F.year(a) * 4 + F.quarter(a))).cast("long")
    if unit == "month":
        return ((F.year(b) * 12 + F.month(b)) - (F.year(a) * 12 + F.month(a))).cast("long")
    if unit == "week":
        first = ("sun", "mon", "tue", "wed", "thu", "fri", "sat").index(arg.get("startOfWeek", "sunday").lower()[:3])
        place = lambda c: F.floor((F.unix_date(c.cast("date")) + 4 - first) / 7)
        return (place(b) - place(a)).cast("long")
    if unit not in MS:
        raise SpecError(f"no such unit: {unit}")
    return (F.floor(F.unix_millis(b) / MS[unit]) - F.floor(F.unix_millis(a) / MS[unit])).cast("long")


@register("expression", "$dateFromParts")
def _from_parts(s: Scope, arg: dict) -> Column:
    """Parts beyond their range carry over."""
    n = lambda k, d: s.compile(arg[k]).cast("int") if k in arg else F.lit(d)
    if "isoWeekYear" in arg:
        fourth = F.make_date(n("isoWeekYear", 1970), F.lit(1), F.lit(4))
        day = F.date_add(fourth, (n("isoWeek", 1) - 1) * 7 + n("isoDayOfWeek", 1) - 1 - F.weekday(fourth))
    else:
        day = F.date_add(F.add_months(F.make_date(n("year", 1970), F.lit(1), F.lit(1)), n("month", 1) - 1), n("day", 1) - 1)
    ms = ((n("hour", 0).cast("long") * 60 + n("minute", 0)) * 60 + n("second", 0)) * 1000 + n("millisecond", 0)
    out = F.timestamp_add("MILLISECOND", ms, day.cast("timestamp"))
    return F.to_utc_timestamp(out, zone(arg["timezone"])) if "timezone" in arg else out


#: Format specifiers with a counterpart among Spark's patterns.
PATTERN = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%L": "SSS", "%j": "DDD", "%z": "xx", "%b": "MMM", "%B": "MMMM"}


#: What specifiers stand for in a text, for formats that Spark's patterns can't read.
SCAN = {"%Y": r"(\d{4})", "%G": r"(\d{4})", "%m": r"(\d{2})", "%d": r"(\d{2})", "%H": r"(\d{2})", "%M": r"(\d{2})", "%S": r"(\d{2})", "%L": r"(\d{3})", "%V": r"(\d{1,2})", "%u": r"([1-7])", "%z": r"([+-]\d{2}):?(\d{2})", "%Z": r"([+-]\d{3})"}


def _scanned(c: Column, parts: list[str]) -> Column:
    """The timestamp in a text with ISO weeks (%G, %V, %u) or an offset in minutes (%Z); null if the text isn't of the format or no date."""
    pattern, groups = "", {}
    for p in parts:
        if p.startswith("%") and p != "%%":
            if p not in SCAN:
                raise SpecError(f"$dateFromString can't read {p}")
            groups[p] = 1 + sum(SCAN[k].count("(") for k in groups)
            pattern += SCAN[p]
        else:
            pattern += re.sub(r"([^A-Za-z0-9 ])", r"\\\1", "%" if p == "%%" else p)
    held = c.rlike(f"^{pattern}$")
    part = lambda p, default=0, more=0: F.try_to_number(F.regexp_extract(c, f"^{pattern}$", groups[p] + more), F.lit("S9999")).cast("int") if p in groups else F.lit(default)
    if "%G" in groups or "%V" in groups:
        fourth = F.make_date(F.when(held, part("%G" if "%G" in groups else "%Y", 1970)), F.lit(1), F.lit(4))
        day = F.when(part("%V", 1).between(1, 53), F.date_add(fourth, (part("%V", 1) - 1) * 7 + part("%u", 1) - 1 - F.weekday(fourth)))
        out = F.timestamp_add("SECOND", (part("%H") * 60 + part("%M")) * 60 + part("%S"), day.cast("timestamp"))
    else:
        out = F.try_make_timestamp(part("%Y", 1970), part("%m", 1), part("%d", 1), part("%H"), part("%M"), part("%S").cast("decimal(8,6)"))
    out = F.timestamp_add("MILLISECOND", part("%L"), out)
    minutes = part("%Z")
    if "%z" in groups:
        hours = F.regexp_extract(c, f"^{pattern}$", groups["%z"])
        minutes = minutes + F.when(F.startswith(hours, F.lit("-")), -1).otherwise(1) * (F.abs(part("%z")) * 60 + part("%z", 0, 1))
    return F.when(held, F.timestamp_add("MINUTE", -minutes, out))


@register("expression", "$dateFromString")
def _from_string(s: Scope, arg: dict) -> Column:
    """onNull for null, onError for what isn't a date (null without it)."""
    c, tz = s.compile(arg["dateString"]).cast("string"), arg.get("timezone")
    if "format" in arg:
        parts = re.findall(r"%.|[^%]+", arg["format"])
        out = _scanned(c, parts) if {"%G", "%V", "%u", "%U", "%Z"} & set(parts) else F.try_to_timestamp(c, F.lit("".join(PATTERN[p] if p in PATTERN else "'" + p.replace("'", "''") + "'" if re.search("[A-Za-z]", p) else p for p in parts)))
    else:
        out = F.try_to_timestamp(c)
    out = F.to_utc_timestamp(out, zone(tz)) if tz else out
    if "onError" in arg:
        out = F.coalesce(out, F.when(c.isNotNull(), s.compile(arg["onError"])))
    return F.when(c.isNull(), s.compile(arg["onNull"])).otherwise(out) if "onNull" in arg else out


@register("expression", "$dateToParts")
def _to_parts(s: Scope, arg: dict) -> Column:
    c = _local(s, arg)
    names = ("isoWeekYear", "isoWeek", "isoDayOfWeek") if arg.get("iso8601") else ("year", "month", "dayOfMonth")
    first = [PARTS["$" + n](c).cast("int").alias("day" if n == "dayOfMonth" else n) for n in names]
    return F.struct(*first, *[PARTS["$" + n](c).alias(n) for n in ("hour", "minute", "second", "millisecond")])


@register("expression", "$dateToString")
def _to_string(s: Scope, arg: dict) -> Column:
    c, tz = _local(s, arg), arg.get("timezone")
    fmt = arg.get("format", "%Y-%m-%dT%H:%M:%S.%LZ")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    minutes = F.timestamp_diff("MINUTE", moment(s, arg["date"]), c) if tz else F.lit(0).cast("long")
    ahead = F.abs(minutes)
    offset = F.concat(F.when(minutes < 0, "-").otherwise("+"), two(F.floor(ahead / 60)), two(ahead % 60))
    special = {
        "%G": lambda: PARTS["$isoWeekYear"](c).cast("string"), "%V": lambda: two(F.weekofyear(c)), "%u": lambda: (F.weekday(c) + 1).cast("string"), "%U": lambda: two(week(c)), "%w": lambda: F.dayofweek(c).cast("string"),
        "%z": lambda: offset, "%Z": lambda: minutes.cast("string"), "%%": lambda: F.lit("%"),
    }
    out = [special[p]() if p in special else F.date_format(c, PATTERN[p]) if p in PATTERN else F.lit(p) for p in re.findall(r"%.|[^%]+", fmt)]
    text = F.concat(*out) if out else F.lit("")
    return F.when(c.isNull(), s.compile(arg["onNull"])).otherwise(text) if "onNull" in arg else F.when(c.isNotNull(), text)
