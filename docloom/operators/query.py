"""Criteria: from a filter document to a boolean Column, which is true where a document matches and false or null elsewhere."""

from __future__ import annotations

import re
from dataclasses import replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..context import SpecError, register
from ..functions.scalar import CODES, type_name
from ..plans.scope import Scope
from ..plans.values import anywhere, closed, kind, kind_of, literal, regex, same

#: Operators that stand where a field's name would.
TOP = ("$and", "$or", "$nor", "$expr", "$jsonSchema", "$where")


def compile_query(s: Scope, criteria: dict) -> Column:
    """All of the criteria."""
    out = F.lit(True)
    for key, value in criteria.items():
        if key.startswith("$"):
            found = s.options.context.get("query", key)
            if key not in TOP or found is None:
                raise SpecError(f"unknown top-level operator {key}")
            out = out & found(s, None, value)
        else:
            out = out & at_path(s, key, value)
    return out


def _is_ops(value: Any) -> bool:
    return isinstance(value, dict) and bool(value) and all(isinstance(k, str) and k.startswith("$") for k in value)


def normal(value: Any) -> dict:
    """A condition as operators: a pattern means $regex, a value $eq, $options belongs to $regex."""
    if isinstance(value, re.Pattern):
        return {"$regex": value}
    if not _is_ops(value):
        return {"$eq": value}
    if "$options" in value:
        value = {k: v for k, v in value.items() if k != "$options"} | {"$regex": regex(value["$regex"], value["$options"])}
    return value


def at_path(s: Scope, path: str, value: Any) -> Column:
    """The condition on what stands at a path; negations are complements of the whole, so null and missing values pass them."""
    parts = path.split(".")
    if s.current is not None:
        c, t = s.current
    elif path in s.df.columns:
        c, t, parts = F.col(f"`{path}`"), s.df.schema[path].dataType, []
    elif parts[0] in s.df.columns:
        c, t, parts = F.col(f"`{parts[0]}`"), s.df.schema[parts[0]].dataType, parts[1:]
    else:
        c, t, parts = F.lit(None), T.NullType(), []
    return conditions(s, (c, t, parts), value)


def conditions(s: Scope, at: tuple[Column, T.DataType, list[str]], value: Any) -> Column:
    out = F.lit(True)
    for op, arg in normal(value).items():
        found = s.options.context.get("query", op)
        if found is None or op in TOP:
            raise SpecError(f"unknown query operator {op}")
        out = out & found(s, at, arg)
    return out


def _any_element(c: Column, t: T.DataType, test) -> Column:
    """test on the value, or on some element of an array, however deep."""
    if isinstance(t, T.ArrayType):
        return F.exists(c, lambda x: _any_element(x, t.elementType, test))
    return test(c, t)


def _predicate(name: str):
    """Register test(c, t, arg) on any value or element at the path."""

    def add(test):
        register("query", name, lambda s, at, arg: anywhere(*at, lambda c, t: _any_element(c, t, lambda x, e: test(x, e, arg))))
        return test

    return add


def equals(c: Column, t: T.DataType, v: Any) -> Column:
    """Equality with the value itself, or with an element of an array."""
    if isinstance(v, re.Pattern):
        return _any_element(c, t, lambda x, e: _matches(x, e, v))
    out = same(c, t, v)
    return out | F.exists(c, lambda x: equals(x, t.elementType, v)) if isinstance(t, T.ArrayType) else out


def is_in(c: Column, t: T.DataType, values: list) -> Column:
    if isinstance(t, T.ArrayType) or any(kind_of(v) in ("array", "object", "regex") for v in values):
        out = F.lit(False)
        for v in values:
            out = out | (F.lit(False) if isinstance(v, re.Pattern) else equals(c, t, v))
        return out
    have = [v for v in values if kind_of(v) == kind(t)]
    out = c.isin(*[literal(v, t) for v in have]) if have else F.lit(False)
    return out | c.isNull() if None in values else out


register("query", "$eq", lambda s, at, v: anywhere(*at, lambda c, t: equals(c, t, v)))


@register("query", "$ne")
def _ne(s: Scope, at: tuple, v: Any) -> Column:
    c, t, parts = at
    if not parts and kind(t) == kind_of(v) and kind(t) in ("number", "string", "bool", "date"):
        return c.isNull() | (c != literal(v, t))  # as a scan can take it
    return ~closed(anywhere(*at, lambda c, t: equals(c, t, v)))


register("query", "$in", lambda s, at, v: anywhere(*at, lambda c, t: is_in(c, t, v)))
register("query", "$nin", lambda s, at, v: ~closed(anywhere(*at, lambda c, t: is_in(c, t, v))))


def _ordered(name: str, f, null_too: bool) -> None:
    @_predicate(name)
    def test(c: Column, t: T.DataType, v: Any) -> Column:
        if v is None:
            return c.isNull() if null_too else F.lit(False)
        return f(c, literal(v, t)) if kind(t) == kind_of(v) else F.lit(False)


_ordered("$gt", lambda a, b: a > b, False)
_ordered("$gte", lambda a, b: a >= b, True)
_ordered("$lt", lambda a, b: a < b, False)
_ordered("$lte", lambda a, b: a <= b, True)


@_predicate("$mod")
def _mod(c: Column, t: T.DataType, v: Any) -> Column:
    divisor, remainder = v
    return (F.try_mod(c, F.lit(divisor)) == remainder) if kind(t) == "number" else F.lit(False)


@_predicate("$regex")
def _matches(c: Column, t: T.DataType, v: Any) -> Column:
    return c.rlike(regex(v)) if kind(t) == "string" else F.lit(False)


def _mask(v: Any) -> int:
    return sum(1 << b for b in v) if isinstance(v, (list, tuple)) else int(v)


for _name, _test in {
    "$bitsAllClear": lambda got, m: got == 0,
    "$bitsAllSet": lambda got, m: got == m,
    "$bitsAnyClear": lambda got, m: got != m,
    "$bitsAnySet": lambda got, m: got != 0,
}.items():
    _predicate(_name)(lambda c, t, v, f=_test: f(c.cast("long").bitwiseAND(F.lit(_mask(v)).cast("long")), _mask(v)) if kind(t) == "number" else F.lit(False))


@register("query", "$exists")
def _exists(s: Scope, at: tuple, v: Any) -> Column:
    """A value that is there; null counts as missing."""
    found = anywhere(*at, lambda c, t: c.isNotNull())
    return found if v else ~closed(found)


@register("query", "$type")
def _type(s: Scope, at: tuple, v: Any) -> Column:
    wanted = [CODES.get(x, x) for x in (v if isinstance(v, (list, tuple)) else [v])]

    def test(c: Column, t: T.DataType) -> Column:
        hit = type_name(t) in wanted or ("number" in wanted and kind(t) == "number")
        own = c.isNotNull() if hit else F.lit(False)
        own = own | c.isNull() if "null" in wanted else own
        return own | F.exists(c, lambda x: test(x, t.elementType)) if isinstance(t, T.ArrayType) else own

    return anywhere(*at, test)


@register("query", "$size")
def _size(s: Scope, at: tuple, v: Any) -> Column:
    return anywhere(*at, lambda c, t: (F.size(c) == v) if isinstance(t, T.ArrayType) else F.lit(False))


def element_query(s: Scope, x: Column, t: T.DataType, spec: Any) -> Column:
    """A condition on one array element: operators on itself, or criteria on its fields."""
    if _is_ops(spec) and not set(spec) <= {"$and", "$or", "$nor"}:
        return conditions(s, (x, t, []), spec)
    return compile_query(replace(s, current=(x, t)), spec)


def _some(s: Scope, c: Column, e: T.DataType, spec: Any) -> Column:
    """Whether an element meets a condition."""
    return F.exists(c, lambda x: element_query(s, x, e, spec))


@register("query", "$elemMatch")
def _elem_match(s: Scope, at: tuple, v: Any) -> Column:
    return anywhere(*at, lambda c, t: _some(s, c, t.elementType, v) if isinstance(t, T.ArrayType) else F.lit(False))


@register("query", "$all")
def _all(s: Scope, at: tuple, v: list) -> Column:
    """An array with each of the values, patterns or $elemMatch conditions."""

    def test(c: Column, t: T.DataType) -> Column:
        if not isinstance(t, T.ArrayType) or not v:
            return F.lit(False)
        out = F.lit(True)
        for x in v:
            out = out & (_some(s, c, t.elementType, x["$elemMatch"]) if isinstance(x, dict) and "$elemMatch" in x else equals(c, t, x))
        return out

    return anywhere(*at, test)


@register("query", "$not")
def _not(s: Scope, at: tuple, v: Any) -> Column:
    return ~closed(conditions(s, at, v))


def _joined(s: Scope, specs: list, any_: bool) -> Column:
    out = F.lit(not any_)
    for x in specs:
        out = out | compile_query(s, x) if any_ else out & compile_query(s, x)
    return out


register("query", "$and", lambda s, at, v: _joined(s, v, False))
register("query", "$or", lambda s, at, v: _joined(s, v, True))
register("query", "$nor", lambda s, at, v: ~closed(_joined(s, v, True)))
register("query", "$expr", lambda s, at, v: s.truth(v))


def _host(s: Scope, f) -> Column:
    """A Python predicate on the document as a dict, in Arrow batches."""
    plain = F.udf(lambda row: bool(f(row.asDict(recursive=True) if hasattr(row, "asDict") else row)), "boolean", useArrow=True)
    return F.coalesce(plain(s.root()[0]), F.lit(False))


@register("query", "$where")
def _where(s: Scope, at: Any, v: Any) -> Column:
    s.options.need_scripts("$where")
    return _host(s, v)


@register("query", "$jsonSchema")
def _json_schema(s: Scope, at: Any, v: dict) -> Column:
    if s.options.validator is None:
        raise SpecError("$jsonSchema needs a validator among the options")
    return _host(s, s.options.validator(v))
