"""Columns for literals, paths, truth and comparison, from types known before anything runs."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..context import SpecError

NULL = T.NullType()


def kind(t: T.DataType) -> str:
    """The bracket within which values of a type compare."""
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "date"
    if isinstance(t, T.ArrayType):
        return "array"
    if isinstance(t, (T.StructType, T.MapType)):
        return "object"
    return "null" if isinstance(t, T.NullType) else type(t).__name__


def kind_of(v: Any) -> str:
    """The same for a literal."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, (int, float, Decimal)):
        return "number"
    if isinstance(v, (dt.datetime, dt.date)):
        return "date"
    if isinstance(v, (list, tuple)):
        return "array"
    if isinstance(v, dict):
        return "object"
    return "regex" if isinstance(v, re.Pattern) else "string" if isinstance(v, str) else type(v).__name__


def literal(v: Any, t: T.DataType | None = None) -> Column:
    """A value as a Column; t: the type of the column that it is held against, whose field order and element type it then has."""
    if isinstance(v, dict):
        if isinstance(t, T.MapType):
            return F.create_map(*[x for k, y in v.items() for x in (F.lit(k), literal(y, t.valueType))]).cast(t)
        fields = {f.name: f.dataType for f in t.fields} if isinstance(t, T.StructType) else {}
        names = [n for n in fields if n in v] + [n for n in v if n not in fields]
        return F.struct(*[literal(v[n], fields.get(n)).alias(n) for n in names])
    if isinstance(v, (list, tuple)):
        e = t.elementType if isinstance(t, T.ArrayType) else None
        mixed = e is None and len({kind_of(x) for x in v} - {"null"}) > 1
        out = F.array(*[literal(x, e).cast("string") if mixed else literal(x, e) for x in v])
        return out.cast(t) if e is not None and not isinstance(e, T.NullType) else out
    out = F.lit(v)
    if v is None:
        return out if t is None or isinstance(t, T.NullType) else out.cast(t)
    return out.cast(t) if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)) and kind_of(v) == "date" else out


def truthy(c: Column, t: T.DataType, strict: bool = True) -> Column:
    """True unless null, false or zero; an empty string counts as true only if strict."""
    if kind(t) == "bool":
        return F.coalesce(c, F.lit(False))
    if kind(t) == "number":
        return F.coalesce(c != 0, F.lit(False))
    if kind(t) == "string" and not strict:
        return F.coalesce(c != "", F.lit(False))
    return F.lit(False) if kind(t) == "null" else c.isNotNull()


def regex(v: Any, options: str = "") -> str:
    """A Java pattern with inline flags from a string or re.Pattern."""
    flags = set(options)
    if isinstance(v, re.Pattern):
        flags |= {f for f, bit in (("i", re.I), ("m", re.M), ("s", re.S), ("x", re.X)) if v.flags & bit}
        v = v.pattern
    if bad := flags - set("imsx"):
        raise ValueError(f"no such regular expression option: {', '.join(sorted(bad))}")
    return (f"(?{''.join(sorted(flags))})" if flags else "") + v


def field(c: Column, t: T.DataType, name: str) -> tuple[Column, T.DataType] | None:
    """A field of a struct, a key of a map or a place of an array; None if the type can't have it."""
    if isinstance(t, T.StructType):
        found = next((f for f in t.fields if f.name == name), None)
        return (c.getField(name), found.dataType) if found else None
    if isinstance(t, T.MapType):
        return F.try_element_at(c, F.lit(name)), t.valueType
    if isinstance(t, T.ArrayType) and name.isdigit():
        return F.get(c, F.lit(int(name))), t.elementType
    return None


def follow(c: Column, t: T.DataType, parts: list[str]) -> tuple[Column, T.DataType]:
    """The value at a path: an array without the wanted place is gone through by element, and what has no value is left out."""
    for i, name in enumerate(parts):
        found = field(c, t, name)
        if found is None and isinstance(t, T.ArrayType):
            return _fan_out(c, t.elementType, parts[i:])
        if found is None:
            return F.lit(None), NULL
        c, t = found
    return c, t


def _fan_out(c: Column, element: T.DataType, rest: list[str]) -> tuple[Column, T.DataType]:
    inner: list[T.DataType] = []

    def each(x: Column) -> Column:
        out, t = follow(x, element, rest)
        inner.append(t)
        return out

    out = F.transform(c, each)
    if isinstance(inner[0], T.NullType):
        return F.when(c.isNotNull(), F.array()), T.ArrayType(NULL)
    return F.filter(out, lambda x: x.isNotNull()), T.ArrayType(inner[0])


def anywhere(c: Column, t: T.DataType, parts: list[str], test: Callable[[Column, T.DataType], Column]) -> Column:
    """Whether the value at a path, or any of those that a path through arrays leads to, passes test."""
    for i, name in enumerate(parts):
        found = field(c, t, name)
        if found is None and isinstance(t, T.ArrayType):
            element, rest = t.elementType, parts[i:]
            return F.exists(c, lambda x: anywhere(x, element, rest, test))
        c, t = found or (F.lit(None), NULL)
    return test(c, t)


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), with c computed once however often use names it."""
    return F.transform(F.array(c), lambda v: use(v))[0]


#: Elements of an array that are summed together first in before().
STEP = 256


def before(numbers: Column, use: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """use(f), where f(i) is the sum of the ints that stand before place i: of whole steps, then of single numbers."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    step = lambda i: (i / STEP).cast("int")

    def placed(a: Column, heads: Column) -> Column:
        return use(lambda i: F.get(heads, step(i)) + total(F.slice(a, step(i) * STEP + 1, i % STEP)))

    steps = lambda a: F.transform(F.sequence(F.lit(0), step(F.size(a))), lambda b: total(F.slice(a, b * STEP + 1, F.lit(STEP))))
    return once(numbers, lambda a: once(steps(a), lambda b: once(F.transform(b, lambda _, i: total(F.slice(b, F.lit(1), i))), lambda heads: placed(a, heads))))


def closed(c: Column) -> Column:
    """False where a predicate is null: for what negates or shows it. A filter needs none, and its plain comparisons reach the scan."""
    return F.coalesce(c, F.lit(False))


def same(c: Column, t: T.DataType, v: Any) -> Column:
    """Deep equality with a literal; null equals null. Like all predicates here it may be null where it doesn't hold: closed() makes that false."""
    if v is None:
        return c.isNull()
    if kind(t) != kind_of(v):
        return F.lit(False)
    if isinstance(t, T.StructType):
        if set(v) != set(t.fieldNames()):
            return F.lit(False)
        out = c.isNotNull()
        for n, x in v.items():
            out = out & same(c.getField(n), t[n].dataType, x)
        return out
    if isinstance(t, T.MapType):
        return F.sort_array(F.map_entries(c)) == F.sort_array(F.map_entries(literal(v, t)))
    if isinstance(t, T.ArrayType):
        out = F.size(c) == len(v)
        for i, x in enumerate(v):
            out = out & same(F.get(c, F.lit(i)), t.elementType, x)
        return out
    return c == literal(v, t)


def collated(c: Column, t: T.DataType, spec: str | dict | None) -> list[Column]:
    """What to sort by: the column, or for strings and a collation (see Options) its key and, where that leaves ties to the case, one for these."""
    if not spec or kind(t) != "string":
        return [c]
    if isinstance(spec, str):
        return [F.collate(c, spec)]
    if spec["locale"] == "simple":
        return [c]
    if unknown := set(spec) - {"locale", "strength", "caseLevel", "caseFirst", "numericOrdering", "alternate"}:
        raise SpecError(f"unknown collation options: {', '.join(sorted(unknown))}")
    strength, case = spec.get("strength", 3), spec.get("caseLevel", False) or spec.get("strength", 3) > 2
    if spec.get("alternate") == "shifted":
        c = F.regexp_replace(c, r"[\s\p{P}]+", "")
    key = c
    if spec.get("numericOrdering"):  # a run of digits sorts by its length without leading zeros first
        runs = F.regexp_extract_all(c, F.lit("[0-9]+|[^0-9]+"), F.lit(0))
        number = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
        key = F.array_join(F.transform(runs, lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lpad(F.char_length(number(x)).cast("string"), 10, "0"), number(x))).otherwise(x)), "")
    first = spec.get("caseFirst", "off") if case else "off"
    name = spec["locale"].replace("-", "_").split("_")[0] + ("_CI" if not case or first != "off" else "") + ("_AI" if strength < 2 else "")
    if first == "off":
        return [F.collate(key, name)]
    ties = c if first == "upper" else F.transform(F.split(c, ""), lambda x: F.when(x == F.lower(x), F.lit(0)).otherwise(F.lit(1)))
    return [F.collate(key, name), ties]
