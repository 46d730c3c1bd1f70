"""Update operators: each rewrites the columns at its paths for every row that the condition accepts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..context import Options, SpecError, register
from ..functions.collections import sorted_by
from ..plans.scope import Scope
from ..plans.values import closed, kind, kind_of, literal, same
from .paths import Change, put_all
from .query import compile_query, conditions, element_query, equals, is_in


def _each(name: str):
    """Register f(scope, operand) -> Change for an operator of {path: operand}."""

    def add(f: Callable[[Scope, Any], Change]):
        register("update", name, lambda s, arg: {path: f(s, x) for path, x in arg.items()})
        return f

    return add


def _array(c: Column, t: T.DataType, name: str) -> T.DataType:
    if not isinstance(t, (T.ArrayType, T.NullType)):
        raise SpecError(f"{name} needs an array")
    return t.elementType if isinstance(t, T.ArrayType) else T.NullType()


def _numeric(t: T.DataType, name: str) -> None:
    if kind(t) not in ("number", "null"):
        raise SpecError(f"{name} needs a number")


@_each("$set")
def _set(s: Scope, v: Any) -> Change:
    return lambda c, t: literal(v, t if kind(t) == kind_of(v) else None)


@_each("$unset")
def _unset(s: Scope, v: Any) -> Change:
    return lambda c, t: None


@_each("$currentDate")
def _current_date(s: Scope, v: Any) -> Change:
    """Epoch milliseconds."""
    return lambda c, t: F.unix_millis(F.lit(s.now).cast("timestamp"))


@_each("$inc")
def _inc(s: Scope, v: Any) -> Change:
    def run(c: Column, t: T.DataType) -> Column:
        _numeric(t, "$inc")
        return F.lit(v) if kind(t) == "null" else F.coalesce(c, F.lit(0)) + F.lit(v)

    return run


@_each("$mul")
def _mul(s: Scope, v: Any) -> Change:
    """A missing value becomes 0."""

    def run(c: Column, t: T.DataType) -> Column:
        _numeric(t, "$mul")
        return F.lit(0) * F.lit(v) if kind(t) == "null" else F.coalesce(c, F.lit(0)) * F.lit(v)

    return run


@_each("$max")
def _max(s: Scope, v: Any) -> Change:
    return lambda c, t: literal(v) if kind(t) == "null" else F.greatest(c, literal(v, t))


@_each("$min")
def _min(s: Scope, v: Any) -> Change:
    return lambda c, t: literal(v) if kind(t) == "null" else F.least(c, literal(v, t))


@_each("$bit")
def _bit(s: Scope, v: dict) -> Change:
    ((op, n),) = v.items()
    method = {"and": "bitwiseAND", "or": "bitwiseOR", "xor": "bitwiseXOR"}[op]
    return lambda c, t: getattr(F.coalesce(c, F.lit(0)) if kind(t) != "null" else F.lit(0), method)(F.lit(n))


@_each("$pop")
def _pop(s: Scope, v: int) -> Change:
    """1 takes the last element, -1 the first."""

    def run(c: Column, t: T.DataType) -> Column:
        _array(c, t, "$pop")
        n = F.greatest(F.size(c) - 1, F.lit(0))
        return F.slice(c, F.lit(1 if v == 1 else 2), n)

    return run


@_each("$pull")
def _pull(s: Scope, v: Any) -> Change:
    """Elements equal to a value, or that meet a condition, go."""

    def run(c: Column, t: T.DataType) -> Column:
        e = _array(c, t, "$pull")
        if isinstance(v, dict):
            return F.filter(c, lambda x: ~closed(element_query(s, x, e, v)))
        return F.filter(c, lambda x: ~closed(equals(x, e, v)))

    return run


@_each("$pullAll")
def _pull_all(s: Scope, v: list) -> Change:
    def run(c: Column, t: T.DataType) -> Column:
        e = _array(c, t, "$pullAll")
        return F.filter(c, lambda x: ~closed(is_in(x, e, v)))

    return run


@_each("$addToSet")
def _add_to_set(s: Scope, v: Any) -> Change:
    """A value, or each of $each, unless the array has it."""
    values = v["$each"] if isinstance(v, dict) and "$each" in v else [v]
    distinct = [x for i, x in enumerate(values) if x not in values[:i]]

    def run(c: Column, t: T.DataType) -> Column:
        e = _array(c, t, "$addToSet")
        out = c if isinstance(t, T.ArrayType) else None
        if out is None:
            return literal(distinct)
        out = F.coalesce(out, F.array().cast(t))
        for x in distinct:
            out = _with(out, e, x)
        return out

    return run


def _with(c: Column, e: T.DataType, x: Any) -> Column:
    """An array with x at its end, unless it holds x."""
    return F.when(F.exists(c, lambda y: same(y, e, x)), c).otherwise(F.concat(c, F.array(literal(x, e))))


@_each("$push")
def _push(s: Scope, v: Any) -> Change:
    """A value, or $each with $position, $sort and $slice, in this order."""
    spec = v if isinstance(v, dict) and "$each" in v else {"$each": [v]}

    def run(c: Column, t: T.DataType) -> Column:
        e = _array(c, t, "$push")
        new = literal(list(spec["$each"]), t if isinstance(t, T.ArrayType) else None)
        old = F.coalesce(c, F.array().cast(t)) if isinstance(t, T.ArrayType) else None
        if old is None:
            out = new
        elif "$position" in spec:
            p = int(spec["$position"])
            at = F.least(F.lit(p), F.size(old)) if p >= 0 else F.greatest(F.size(old) + p, F.lit(0))
            out = F.concat(F.slice(old, F.lit(1), at), new, F.slice(old, at + 1, F.size(old)))
        else:
            out = F.concat(old, new)
        if "$sort" in spec:
            out = sorted_by(out, e if isinstance(t, T.ArrayType) else s.type_of_column(new).elementType, spec["$sort"])
        if "$slice" in spec:
            n = int(spec["$slice"])
            out = F.slice(out, F.lit(1), F.lit(n)) if n >= 0 else F.slice(out, F.greatest(F.size(out) + n + 1, F.lit(1)), F.lit(-n))
        return out

    return run


def _rename(s: Scope, arg: dict) -> dict[str, Change]:
    """Paths move; the old one goes."""
    out: dict[str, Change] = {}
    for old, new in arg.items():
        value, t = s.field(old)
        if not isinstance(t, T.NullType):
            out[old] = lambda c, t: None
            out[new] = lambda c, t, v=value: v
    return out


register("update", "$rename", _rename)


def both(a: T.DataType, b: T.DataType) -> T.DataType:
    """A type that holds the values of two: objects have the fields of either."""
    if isinstance(a, T.NullType) or isinstance(b, T.NullType):
        return b if isinstance(a, T.NullType) else a
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        names = [*b.fieldNames(), *[n for n in a.fieldNames() if n not in b.fieldNames()]]
        none = T.NullType()
        return T.StructType([T.StructField(n, both(a[n].dataType if n in a.fieldNames() else none, b[n].dataType if n in b.fieldNames() else none)) for n in names])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(both(a.elementType, b.elementType))
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType) and a != b:
        return T.LongType() if isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType) else T.DoubleType()
    return b


def shaped(c: Column, t: T.DataType, to: T.DataType) -> Column:
    """A value of one type in another that holds it; fields that it lacks are null."""
    if t == to:
        return c
    if isinstance(t, T.StructType) and isinstance(to, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[(shaped(c.getField(f.name), t[f.name].dataType, f.dataType) if f.name in t.fieldNames() else F.lit(None).cast(f.dataType)).alias(f.name) for f in to.fields]))
    if isinstance(t, T.ArrayType) and isinstance(to, T.ArrayType):
        return F.transform(c, lambda x: shaped(x, t.elementType, to.elementType))
    return c.cast(to)


def update(df: DataFrame, spec: dict, array_filters: list[dict] | None = None, condition: dict | None = None, options: Options | None = None, modified: str | None = None) -> DataFrame:
    """df with one update operator applied where condition holds.

    array_filters: criteria on an identifier (`{"e.score": {"$lt": 3}}`) that paths name as `[e]`. modified: the name of a column
    that holds the operator's paths where the document changed, and an empty array elsewhere.
    """
    if len(spec) != 1:
        raise SpecError("an update holds one operator")
    ((name, arg),) = spec.items()
    options = options or Options()
    found = options.context.get("update", name)
    if found is None:
        raise SpecError(f"unknown update operator {name}")
    s = Scope(df, options)
    filters = {}
    for f in array_filters or []:
        for path, test in f.items():
            identifier, _, rest = path.partition(".")
            filters[identifier] = lambda x, t, rest=rest, test=test: compile_query(replace(s, current=(x, t)), {rest: test}) if rest else conditions(s, (x, t, []), test)
    changes = {p.replace("$[", "["): c for p, c in found(s, arg).items()}
    out = put_all(df, changes, filters)
    hit = compile_query(s, condition) if condition else F.lit(True)
    if condition or modified:
        # old and new side by side, so that the condition and the comparison see the document before
        pair = df.withColumns({"__old": F.struct(*[F.col(f"`{c}`") for c in df.columns]), "__hit": hit})
        new = put_all(pair, changes, filters)
        kept = [n for n in new.columns if n not in ("__old", "__hit")]
        every = kept + [c for c in df.columns if c not in kept]
        none = T.NullType()
        types = {n: both(new.schema[n].dataType if n in kept else none, df.schema[n].dataType if n in df.columns else none) for n in every}
        have = {n: shaped(F.col(f"__old.`{n}`"), df.schema[n].dataType, types[n]) if n in df.columns else F.lit(None) for n in every}
        now = {n: shaped(F.col(f"`{n}`"), new.schema[n].dataType, types[n]) if n in kept else F.lit(None) for n in every}
        cols = [F.when(F.col("__hit"), now[n]).otherwise(have[n]).alias(n) for n in (every if condition else kept)]
        if modified:
            moved = F.lit(False)
            for p in {p.split(".")[0] for p in changes} & set(every):
                moved = moved | ~now[p].eqNullSafe(have[p])
            cols.append(F.when(F.col("__hit") & moved, F.array(*[F.lit(p) for p in found(s, arg)])).otherwise(F.array().cast("array<string>")).alias(modified))
        out = new.select(*cols)
    return out
