"""Arithmetic, trigonometry, bits, truth, comparison, conditions, strings and types."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..context import SpecError, register
from ..plans.scope import Scope
from ..plans.values import before, kind, literal, once, regex


def _unary(name: str, function) -> None:
    register("expression", name, lambda s, arg: function(s.compile(s.args(arg, 1, 1)[0])))


_double = lambda f: lambda c: f(c.cast("double"))
for _name, _f in {
    "$abs": F.abs, "$ceil": F.ceil, "$floor": F.floor, "$exp": _double(F.exp), "$ln": _double(F.ln), "$log10": _double(F.log10), "$sqrt": _double(F.sqrt),
    "$sin": _double(F.sin), "$cos": _double(F.cos), "$tan": _double(F.tan), "$asin": _double(F.asin), "$acos": _double(F.acos), "$atan": _double(F.atan),
    "$sinh": _double(F.sinh), "$cosh": _double(F.cosh), "$asinh": _double(F.asinh), "$acosh": _double(F.acosh), "$atanh": _double(F.atanh),
    "$degreesToRadians": _double(F.radians), "$radiansToDegrees": _double(F.degrees), "$bitNot": F.bitwise_not,
    "$strLenBytes": F.octet_length, "$strLenCP": F.char_length,
    "$toLower": lambda c: F.coalesce(F.lower(c), F.lit("")), "$toUpper": lambda c: F.coalesce(F.upper(c), F.lit("")),
}.items():
    _unary(_name, _f)


def _operator(name: str, least: int = 1, most: int | None = None):
    """Register f(scope, *operands)."""
    return lambda f: register("expression", name, lambda s, arg: f(s, *s.args(arg, least, most))) or f


@_operator("$atan2", 2, 2)
def _atan2(s: Scope, y: Any, x: Any) -> Column:
    return F.atan2(s.compile(y).cast("double"), s.compile(x).cast("double"))


def _fold(s: Scope, specs: tuple, f) -> Column:
    out = s.compile(specs[0])
    for x in specs[1:]:
        out = f(out, s.compile(x))
    return out


@_operator("$add")
def _add(s: Scope, *specs: Any) -> Column:
    """Numbers, or one date and milliseconds; null if any operand is."""
    dates = [x for x in specs if kind(s.type_of(x)) == "date"]
    if len(dates) > 1:
        raise SpecError("$add takes one date at most")
    if not dates:
        return _fold(s, specs, F.try_add)
    rest = [x for x in specs if x is not dates[0]]
    ms = _fold(s, tuple(rest), F.try_add) if rest else F.lit(0)
    return F.timestamp_add("MILLISECOND", ms.cast("long"), s.compile(dates[0]))


@_operator("$subtract", 2, 2)
def _subtract(s: Scope, a: Any, b: Any) -> Column:
    """Numbers; two dates give milliseconds; a date and milliseconds give a date."""
    x, y = kind(s.type_of(a)) == "date", kind(s.type_of(b)) == "date"
    if x and y:
        return F.unix_millis(s.compile(a).cast("timestamp")) - F.unix_millis(s.compile(b).cast("timestamp"))
    if x:
        return F.timestamp_add("MILLISECOND", -s.compile(b).cast("long"), s.compile(a))
    return F.try_subtract(s.compile(a), s.compile(b))


_operator("$multiply")(lambda s, *specs: _fold(s, specs, F.try_multiply))
_operator("$divide", 2, 2)(lambda s, a, b: F.try_divide(s.compile(a).cast("double"), s.compile(b).cast("double")))
_operator("$mod", 2, 2)(lambda s, a, b: F.try_mod(s.compile(a), s.compile(b)))
_operator("$pow", 2, 2)(lambda s, a, b: F.pow(s.compile(a).cast("double"), s.compile(b).cast("double")))
_operator("$log", 2, 2)(lambda s, a, b: F.try_divide(F.ln(s.compile(a).cast("double")), F.ln(s.compile(b).cast("double"))))


@_operator("$round", 1, 2)
def _round(s: Scope, x: Any, place: int = 0) -> Column:
    """To a number of decimal places, half to even."""
    return F.bround(s.compile(x), int(place))


@_operator("$trunc", 1, 2)
def _trunc(s: Scope, x: Any, place: int = 0) -> Column:
    """Towards zero at a number of decimal places."""
    if not -20 <= int(place) <= 100:
        raise SpecError("$trunc goes to places from -20 to 100")
    c, by = s.compile(x), float(10 ** abs(int(place)))
    scaled = F.abs(c) * by if place >= 0 else F.abs(c) / by
    whole = F.floor(scaled.cast("double")).cast("double")
    return F.signum(c.cast("double")) * (whole / by if place >= 0 else whole * by)


for _name, _method in {"$bitAnd": "bitwiseAND", "$bitOr": "bitwiseOR", "$bitXor": "bitwiseXOR"}.items():
    _operator(_name)(lambda s, *specs, m=_method: _fold(s, specs, lambda a, b: getattr(a, m)(b)))


@_operator("$and", 0)
def _and(s: Scope, *specs: Any) -> Column:
    out = F.lit(True)
    for x in specs:
        out = out & s.truth(x)
    return out


@_operator("$or", 0)
def _or(s: Scope, *specs: Any) -> Column:
    out = F.lit(False)
    for x in specs:
        out = out | s.truth(x)
    return out


_operator("$not", 1, 1)(lambda s, x: ~s.truth(x))


def compared(s: Scope, a: Any, b: Any, f) -> Column:
    """f on two values of one bracket; false otherwise, and if either is null."""
    ka, kb = kind(s.type_of(a)), kind(s.type_of(b))
    return F.coalesce(f(s.compile(a), s.compile(b)), F.lit(False)) if ka == kb and ka != "null" else F.lit(False)


def equal(s: Scope, a: Any, b: Any) -> Column:
    ka, kb = kind(s.type_of(a)), kind(s.type_of(b))
    x, y = s.compile(a), s.compile(b)
    return x.eqNullSafe(y) if ka == kb or "null" in (ka, kb) else x.isNull() & y.isNull()


def _both_null(s: Scope, a: Any, b: Any) -> Column:
    return s.compile(a).isNull() & s.compile(b).isNull()


_operator("$eq", 2, 2)(equal)
_operator("$ne", 2, 2)(lambda s, a, b: ~equal(s, a, b))
_operator("$gt", 2, 2)(lambda s, a, b: compared(s, a, b, lambda x, y: x > y))
_operator("$lt", 2, 2)(lambda s, a, b: compared(s, a, b, lambda x, y: x < y))
_operator("$gte", 2, 2)(lambda s, a, b: compared(s, a, b, lambda x, y: x >= y) | _both_null(s, a, b))
_operator("$lte", 2, 2)(lambda s, a, b: compared(s, a, b, lambda x, y: x <= y) | _both_null(s, a, b))


@_operator("$cmp", 2, 2)
def _cmp(s: Scope, a: Any, b: Any) -> Column:
    """-1, 0 or 1; null comes before everything."""
    x, y = s.compile(a), s.compile(b)
    return F.when(x.eqNullSafe(y), 0).when(x.isNull(), -1).when(y.isNull(), 1).when(x < y, -1).otherwise(1)


@register("expression", "$cond")
def _cond(s: Scope, arg: Any) -> Column:
    a, b, c = (arg["if"], arg["then"], arg["else"]) if isinstance(arg, dict) else arg
    return F.when(s.truth(a), s.compile(b)).otherwise(s.compile(c))


_operator("$ifNull", 2)(lambda s, *specs: F.coalesce(*[s.compile(x) for x in specs]))


@register("expression", "$switch")
def _switch(s: Scope, arg: dict) -> Column:
    out = F
    for b in arg["branches"]:
        out = out.when(s.truth(b["case"]), s.compile(b["then"]))
    return out.otherwise(s.compile(arg["default"])) if "default" in arg else out


# strings

_operator("$concat")(lambda s, *specs: F.concat(*[s.compile(x).cast("string") for x in specs]))


@_operator("$strcasecmp", 2, 2)
def _strcasecmp(s: Scope, a: Any, b: Any) -> Column:
    x, y = (F.upper(F.coalesce(s.compile(v).cast("string"), F.lit(""))) for v in (a, b))
    return F.when(x == y, 0).when(x < y, -1).otherwise(1)


@_operator("$indexOfBytes", 2, 4)
def _index_of(s: Scope, text: Any, sub: Any, start: Any = 0, end: Any = None) -> Column:
    """The first place of sub in text from start to end, -1 if there is none, null if text is null."""
    t, a = s.compile(text), s.compile(start)
    t = t if end is None else F.substring(t, F.lit(1), s.compile(end).cast("int"))
    return F.call_function("locate", s.compile(sub), t, (a + 1).cast("int")) - 1


#: What $trim and its kin take off by default.
BLANKS = "\0 \t\n\x0b\x0c\r\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"

for _name, _f in {"$trim": F.btrim, "$ltrim": F.ltrim, "$rtrim": F.rtrim}.items():
    register("expression", _name, lambda s, arg, f=_f: f(s.compile(arg["input"]), s.compile(arg["chars"]) if "chars" in arg else F.lit(BLANKS)))


@register("expression", "$replaceAll")
def _replace_all(s: Scope, arg: dict) -> Column:
    return F.replace(s.compile(arg["input"]), s.compile(arg["find"]), s.compile(arg["replacement"]))


@register("expression", "$replaceOne")
def _replace_one(s: Scope, arg: dict) -> Column:
    t, a, b = s.compile(arg["input"]), s.compile(arg["find"]), s.compile(arg["replacement"])
    at = F.instr(t, a)
    return F.when(at > 0, F.concat(F.substring(t, F.lit(1), at - 1), b, F.substring(t, at + F.char_length(a), F.char_length(t)))).otherwise(F.when(a.isNotNull() & b.isNotNull(), t))


@_operator("$split", 2, 2)
def _split(s: Scope, text: Any, by: str) -> Column:
    return F.split(s.compile(text), re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", by))


def _substr(s: Scope, text: Any, start: Any, n: Any) -> Column:
    """By code points; a negative start gives an empty string, a negative length the rest."""
    t, a, k = F.coalesce(s.compile(text).cast("string"), F.lit("")), s.compile(start).cast("int"), s.compile(n).cast("int")
    return F.when(a < 0, F.lit("")).otherwise(F.substring(t, a + 1, F.when(k < 0, F.char_length(t)).otherwise(k)))


_operator("$substr", 3, 3)(_substr)
_operator("$substrCP", 3, 3)(_substr)


@_operator("$substrBytes", 3, 3)
def _substr_bytes(s: Scope, text: Any, start: Any, n: Any) -> Column:
    """By bytes of UTF-8."""
    t, a, k = F.encode(F.coalesce(s.compile(text).cast("string"), F.lit("")), "UTF-8"), s.compile(start).cast("int"), s.compile(n).cast("int")
    return F.decode(F.when(a < 0, F.encode(F.lit(""), "UTF-8")).otherwise(F.substring(t, a + 1, F.when(k < 0, F.octet_length(t)).otherwise(k))), "UTF-8")


def _pattern(arg: dict) -> tuple[str, int]:
    p = regex(arg["regex"], arg.get("options", ""))
    return p, re.compile(re.sub(r"\(\?<([A-Za-z])", r"(?P<\1", re.sub(r"^\(\?[a-z]+\)", "", p))).groups


def _found(t: Column, p: str, groups: int) -> Column:
    """array of (match, idx, captures): what lies between the matches gives their places."""
    found = F.struct(F.split(t, p, -1).alias("gaps"), *[F.regexp_extract_all(t, F.lit(p), F.lit(g)).alias(f"g{g}") for g in range(groups + 1)])

    def placed(z: Column) -> Column:
        lengths = F.zip_with(z["g0"], F.slice(z["gaps"], F.lit(1), F.size(z["g0"])), lambda m, g: F.char_length(m) + F.char_length(g))
        captures = lambda i: F.array(*[F.get(z[f"g{g}"], i) for g in range(1, groups + 1)]) if groups else F.array().cast("array<string>")
        one = lambda at: lambda m, i: F.struct(m.alias("match"), (at(i) + F.char_length(F.get(z["gaps"], i))).alias("idx"), captures(i).alias("captures"))
        return before(lengths, lambda at: F.transform(z["g0"], one(at)))

    return once(found, placed)


@register("expression", "$regexFindAll")
def _regex_find_all(s: Scope, arg: dict) -> Column:
    return F.coalesce(_found(s.compile(arg["input"]), *_pattern(arg)), F.array().cast("array<struct<match:string,idx:int,captures:array<string>>>"))


@register("expression", "$regexFind")
def _regex_find(s: Scope, arg: dict) -> Column:
    """match, idx and captures of the first match, or null."""
    t, (p, groups) = s.compile(arg["input"]), _pattern(arg)
    at = F.char_length(F.get(F.split(t, p, 2), F.lit(0)))
    captures = F.array(*[F.regexp_extract(t, p, g) for g in range(1, groups + 1)]) if groups else F.array().cast("array<string>")
    return F.when(t.rlike(p), F.struct(F.regexp_extract(t, p, 0).alias("match"), at.alias("idx"), captures.alias("captures")))


register("expression", "$regexMatch", lambda s, arg: F.coalesce(s.compile(arg["input"]).rlike(_pattern(arg)[0]), F.lit(False)))

# types

#: Names and numbers of types that conversions know.
CODES = {1: "double", 2: "string", 8: "bool", 9: "date", 16: "int", 18: "long", 19: "decimal"}


def type_name(t: T.DataType) -> str:
    """The name that $type gives a column's type."""
    if isinstance(t, (T.LongType,)):
        return "long"
    if isinstance(t, T.IntegralType):
        return "int"
    if isinstance(t, T.DecimalType):
        return "decimal"
    return {"number": "double", "null": "null"}.get(kind(t), kind(t))


def converted(c: Column, t: T.DataType, to: str) -> Column:
    """c as another type; null where it can't be."""
    k = kind(t)
    if to in ("double", "decimal"):
        return F.unix_millis(c.cast("timestamp")).cast("double") if k == "date" else c.try_cast("double")
    if to in ("int", "long"):
        least, most = (-(2**31), 2**31 - 1) if to == "int" else (-(2**53) + 1, 2**53 - 1)
        n = F.unix_millis(c.cast("timestamp")) if k == "date" else c.try_cast("decimal(38,10)") if k == "string" else c
        whole = n.try_cast("bigint")
        fits = (whole >= least) & (whole <= most)
        if k == "string":
            fits = fits & (n == whole)
        return F.when(fits, whole).cast(to if to == "int" else "bigint")
    if to == "bool":
        return F.when(c.isNotNull(), F.lit(True)) if k in ("string", "date") else c if k == "bool" else c != 0
    if to == "date":
        return F.timestamp_millis(c.cast("long")) if k == "number" else c.try_cast("timestamp")
    if to == "string":
        return F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") if k == "date" else c.cast("string")
    raise SpecError(f"no conversion to {to}")


@register("expression", "$convert")
def _convert(s: Scope, arg: dict) -> Column:
    """onNull for null, onError for what can't be converted (null without it)."""
    c, t = s.typed(arg["input"])
    to = CODES.get(arg["to"], arg["to"])
    out = converted(c, t, to)
    if "onError" in arg:
        out = F.coalesce(out, F.when(c.isNotNull(), s.compile(arg["onError"])))
    return F.when(c.isNull(), s.compile(arg["onNull"])).otherwise(out) if "onNull" in arg else out


for _name, _to in {"$toBool": "bool", "$toDate": "date", "$toDecimal": "decimal", "$toDouble": "double", "$toInt": "int", "$toLong": "long", "$toString": "string"}.items():
    _operator(_name, 1, 1)(lambda s, x, to=_to: converted(*s.typed(x), to))
_operator("$isNumber", 1, 1)(lambda s, x: s.compile(x).isNotNull() if kind(s.type_of(x)) == "number" else F.lit(False))
_operator("$type", 1, 1)(lambda s, x: F.when(s.compile(x).isNull(), "null").otherwise(type_name(s.type_of(x))))

# the rest

register("expression", "$literal", lambda s, arg: literal(arg))
register("expression", "$rand", lambda s, arg: F.rand())
_operator("$sampleRate", 1, 1)(lambda s, x: F.rand() <= s.compile(x))


@register("expression", "$let")
def _let(s: Scope, arg: dict) -> Column:
    return s.bind(**{k: s.typed(v) for k, v in arg["vars"].items()}).compile(arg["in"])


@register("expression", "$function")
def _function(s: Scope, arg: dict) -> Column:
    """A Python function of args, in Arrow batches; returns: the type of its value as DDL."""
    s.options.need_scripts("$function")
    return F.udf(arg["body"], arg.get("returns", "string"), useArrow=True)(*[s.compile(x) for x in arg.get("args", [])])
