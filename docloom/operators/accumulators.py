"""Accumulators: as aggregates of a group, over a window, and as expressions over an array."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..context import SpecError, register
from ..functions.collections import last_n, merged, over
from ..plans.scope import Scope
from ..plans.values import kind

#: Accumulators whose value depends on the order of documents.
ORDERED = {"$first", "$last", "$firstN", "$lastN", "$push", "$mergeObjects", "$accumulator", "$addToSet"}


@dataclass
class Group:
    """Where an accumulator runs: over makes an aggregate of a Column (grouped: itself; windowed: over a frame), order are sort keys (Column, descending)."""

    order: list[tuple[Column, bool]]
    over: Callable[[Column], Column] = lambda c: c


def _number(s: Scope, arg: Any) -> Column | None:
    """A numeric operand; None if its type has no numbers."""
    c, t = s.typed(arg)
    return c if kind(t) == "number" else None


def _keys(order: list[tuple[Column, bool]]) -> list[Column]:
    return [c.alias(f"k{i}") for i, (c, _) in enumerate(order)]


def _by(keys: list[bool]) -> Callable[[Column, Column], Column]:
    """A comparator of structs on fields k0, k1, ..., null first, last if descending."""

    def order(x: Column, y: Column) -> Column:
        out = F.lit(0)
        for i in reversed(range(len(keys))):
            a, b, way = x[f"k{i}"], y[f"k{i}"], -1 if keys[i] else 1
            out = F.when(a.eqNullSafe(b), out).when(a.isNull(), -way).when(b.isNull(), way).when(a < b, -way).otherwise(way)
        return out.cast("int")

    return order


def gathered(g: Group, value: Column, order: list[tuple[Column, bool]] | None = None, comparable: bool = True) -> Column:
    """The group's values as an array in order, nulls too. comparable: whether values can stand in a sort (maps can't)."""
    order = g.order if order is None else order
    rows = g.over(F.collect_list(F.struct(*_keys(order), value.alias("v"))))
    if order:
        down = {d for _, d in order}
        rows = F.sort_array(rows, not down.pop()) if len(down) == 1 and comparable else F.array_sort(rows, _by([d for _, d in order]))
    return F.transform(rows, lambda r: r["v"])


def extreme(g: Group, value: Column, last: bool) -> Column:
    """The first or last value in order, by one comparison a row."""
    if not g.order:
        return g.over(F.last(value) if last else F.first(value))
    if len({d for _, d in g.order}) == 1:
        key = F.struct(*_keys(g.order))
        return g.over(F.max_by(F.struct(value.alias("v")), key) if last != g.order[0][1] else F.min_by(F.struct(value.alias("v")), key))["v"]
    return F.try_element_at(gathered(g, value), F.lit(-1 if last else 1))


def sort_keys(s: Scope, by: dict) -> list[tuple[Column, bool]]:
    return [(s.field(k)[0], v in (-1, "desc")) for k, v in by.items()]


def _simple(name: str, f: Callable[[Column], Column], empty: Any = None) -> None:
    """Numbers only; empty: the value of a group without any."""

    def run(s: Scope, arg: Any, g: Group) -> Column:
        c = _number(s, arg)
        if c is None:
            return F.lit(empty)
        out = g.over(f(c))
        return out if empty is None else F.coalesce(out, F.lit(empty))

    register("accumulator", name, run)


_simple("$avg", F.avg, 0.0)
_simple("$stdDevPop", F.stddev_pop, 0.0)
_simple("$stdDevSamp", F.stddev_samp)


@register("accumulator", "$sum")
def _sum(s: Scope, arg: Any, g: Group) -> Column:
    """A literal counts once a document."""
    if isinstance(arg, int) and not isinstance(arg, bool):
        out = g.over(F.count(F.lit(1)))
        return out if arg == 1 else out * arg
    c = _number(s, arg)
    return F.lit(0) if c is None else F.coalesce(g.over(F.sum(c)), F.lit(0))


register("accumulator", "$count", lambda s, arg, g: g.over(F.count(F.lit(1))))
register("accumulator", "$max", lambda s, arg, g: g.over(F.max(s.compile(arg))))
register("accumulator", "$min", lambda s, arg, g: g.over(F.min(s.compile(arg))))
register("accumulator", "$first", lambda s, arg, g: extreme(g, s.compile(arg), False))
register("accumulator", "$last", lambda s, arg, g: extreme(g, s.compile(arg), True))
register("accumulator", "$push", lambda s, arg, g: gathered(g, s.compile("$$ROOT" if arg is None else arg)))


@register("accumulator", "$addToSet")
def _add_to_set(s: Scope, arg: Any, g: Group) -> Column:
    """Distinct values, null too, sorted: partial sets are merged, so repeated values are never gathered."""
    c = F.struct(s.compile(arg).alias("v"))
    return F.transform(F.sort_array(g.over(F.collect_set(c))), lambda x: x["v"])


def _covariance(f) -> Callable:
    def run(s: Scope, arg: Any, g: Group) -> Column:
        x, y = (s.compile(a).cast("double") for a in arg)
        return g.over(f(x, y))

    return run


register("accumulator", "$covariancePop", _covariance(F.covar_pop))
register("accumulator", "$covarianceSamp", _covariance(F.covar_samp))


def _n(s: Scope, arg: dict) -> Column:
    return s.compile(arg["n"]).cast("int")


register("accumulator", "$firstN", lambda s, arg, g: F.slice(gathered(g, s.compile(arg["input"])), F.lit(1), _n(s, arg)))
register("accumulator", "$lastN", lambda s, arg, g: last_n(gathered(g, s.compile(arg["input"])), _n(s, arg)))
register("accumulator", "$maxN", lambda s, arg, g: F.slice(F.sort_array(g.over(F.collect_list(s.compile(arg["input"]))), False), F.lit(1), _n(s, arg)))
register("accumulator", "$minN", lambda s, arg, g: F.slice(F.sort_array(g.over(F.collect_list(s.compile(arg["input"])))), F.lit(1), _n(s, arg)))


def _sorted_output(s: Scope, arg: dict, g: Group) -> Column:
    return gathered(g, s.compile(arg["output"]), sort_keys(s, arg["sortBy"]))


register("accumulator", "$topN", lambda s, arg, g: F.slice(_sorted_output(s, arg, g), F.lit(1), _n(s, arg)))
register("accumulator", "$bottomN", lambda s, arg, g: last_n(_sorted_output(s, arg, g), _n(s, arg)))


#: Accumulators that return n of a group's values, and whether these are the last in their order.
BOUNDED = {"$firstN": False, "$lastN": True, "$maxN": True, "$minN": False, "$topN": False, "$bottomN": True}


def wanted(s: Scope, spec: Any, order: list[tuple[Column, bool]]) -> tuple[int, Column, list[Column]] | None:
    """n, which documents count, and the order in which the first n of them hold all that the accumulator returns; None if n isn't known beforehand."""
    ((name, arg),) = spec.items() if isinstance(spec, dict) and len(spec) == 1 else ((None, None),)
    if name not in BOUNDED or not isinstance(arg["n"], int) or isinstance(arg["n"], bool) or arg["n"] < 1 or s.options.context.own["accumulator"].get(name):
        return None
    if name in ("$maxN", "$minN"):
        value = s.compile(arg["input"])
        keys, counts = [(value, False)], value.isNotNull()
    else:
        value = s.compile(arg["output" if "sortBy" in arg else "input"])
        keys, counts = list(sort_keys(s, arg["sortBy"]) if "sortBy" in arg else order), F.lit(True)
        if len({down for _, down in keys}) == 1:  # as gathered() settles ties
            keys.append((value, keys[0][1]))
    return arg["n"], counts, [c.desc_nulls_last() if down != BOUNDED[name] else c.asc_nulls_first() for c, down in keys]


def _one(last: bool) -> Callable:
    """An array of the one value; rows are compared, not gathered."""
    return lambda s, arg, g: F.array(extreme(Group(sort_keys(s, arg["sortBy"]), g.over), s.compile(arg["output"]), last))


register("accumulator", "$top", _one(False))
register("accumulator", "$bottom", _one(True))


def _rank(s: Scope, arg: dict, g: Group, p: float) -> Column:
    c = s.compile(arg["input"]).cast("double")
    if arg.get("method", "approximate") == "exact":
        return g.over(F.percentile(c, F.lit(float(p))))
    return g.over(F.percentile_approx(c, F.lit(float(p)), F.lit(10_000)))


register("accumulator", "$percentile", lambda s, arg, g: F.array(*[_rank(s, arg, g, p) for p in arg["p"]]))
register("accumulator", "$median", lambda s, arg, g: _rank(s, arg, g, 0.5))


@register("accumulator", "$mergeObjects")
def _merge_objects(s: Scope, arg: Any, g: Group) -> Column:
    """Later documents over earlier ones; a field of a struct has its last value that isn't null."""
    c, t = s.typed(arg)
    if isinstance(t, T.MapType):
        empty = F.map_from_arrays(F.array().cast("array<string>"), F.array()).cast(t)
        return F.aggregate(F.filter(gathered(g, c, comparable=False), lambda m: m.isNotNull()), empty, over)
    if not isinstance(t, T.StructType):
        raise SpecError("$mergeObjects needs objects")
    rows = gathered(g, c)
    last = lambda name: F.try_element_at(F.filter(F.transform(rows, lambda m: m.getField(name)), lambda x: x.isNotNull()), F.lit(-1))
    return F.struct(*[last(n).alias(n) for n in t.fieldNames()])


@register("accumulator", "$accumulator")
def _accumulator(s: Scope, arg: dict, g: Group) -> Column:
    """A Python fold over the group in order: init(*initArgs), accumulate(state, *args), finalize(state); returns: the result's type as DDL."""
    s.options.need_scripts("$accumulator")
    init, step, finish = arg["init"], arg["accumulate"], arg.get("finalize", lambda x: x)
    first = arg.get("initArgs", [])

    def fold(rows):
        state = init(*first)
        for r in rows:
            state = step(state, *[r[f"a{i}"] for i in range(len(r))])
        return finish(state)

    values = F.struct(*[s.compile(x).alias(f"a{i}") for i, x in enumerate(arg["accumulateArgs"])])
    return F.udf(fold, arg.get("returns", "double"), useArrow=True)(gathered(g, values))


def accumulate(s: Scope, spec: dict, g: Group) -> Column:
    """The Column of {accumulator: operand}."""
    if len(spec) != 1:
        raise SpecError("an output field holds one accumulator")
    ((name, arg),) = spec.items()
    found = s.options.context.get("accumulator", name)
    if found is None:
        raise SpecError(f"unknown accumulator {name}")
    return found(s, arg, g)


def over_array(s: Scope, name: str, arg: Any) -> Column:
    """An accumulator as an expression: over an array, or over a list of operands."""
    if name in ("$topN", "$bottomN", "$top", "$bottom"):
        raise SpecError(f"{name} aggregates groups only")
    specs = list(arg) if isinstance(arg, (list, tuple)) else [arg]
    if len(specs) == 1 and isinstance(s.type_of(specs[0]), T.ArrayType):
        c, e = s.compile(specs[0]), s.type_of(specs[0]).elementType
    elif name == "$mergeObjects":
        return merged([s.typed(x) for x in specs])
    else:
        c, e = s.compile(specs), s.type_of(specs).elementType
    have = F.array_compact(c)
    if name == "$max":
        return F.array_max(have)
    if name == "$min":
        return F.array_min(have)
    if name == "$push":
        return c
    if name == "$addToSet":
        return F.array_distinct(c)
    if name in ("$covariancePop", "$covarianceSamp"):
        if not isinstance(e, T.ArrayType):
            raise SpecError(f"{name} takes pairs")
        at = lambda i: F.transform(have, lambda p: F.get(p, F.lit(i)).cast("double"))
        n = F.size(have)
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
        co = total(F.zip_with(at(0), at(1), lambda a, b: a * b)) - total(at(0)) * total(at(1)) / n
        return F.when(n > 1, co / n).otherwise(0.0) if name == "$covariancePop" else F.when(n > 1, co / (n - 1))
    if kind(e) != "number":
        return F.lit(None if name == "$stdDevSamp" else 0)
    wide = "bigint" if isinstance(e, T.IntegralType) else "double"
    total = lambda a, t="double": F.aggregate(a, F.lit(0).cast(t), lambda x, y: x + y.cast(t))
    n = F.size(have)
    mean = total(have) / n
    spread = F.aggregate(have, F.lit(0.0), lambda x, y: x + (y - mean) * (y - mean))
    if name == "$sum":
        return F.coalesce(total(have, wide), F.lit(0))
    if name == "$avg":
        return F.when(n > 0, mean).otherwise(0.0)
    if name == "$count":
        return F.size(c)
    if name == "$stdDevPop":
        return F.when(n > 0, F.sqrt(spread / n)).otherwise(0.0)
    if name == "$stdDevSamp":
        return F.when(n > 1, F.sqrt(spread / (n - 1)))
    raise SpecError(f"unknown expression operator {name}")
