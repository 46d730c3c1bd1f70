"""Arrays, sets and objects."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..context import SpecError, register
from ..plans.scope import REMOVE, Scope
from ..plans.values import NULL, field, kind, once, truthy
from .scalar import _operator


def _array(s: Scope, spec: Any) -> tuple[Column, T.DataType]:
    """An array operand and its elements' type; anything else is null."""
    c, t = s.typed(spec)
    return (c, t.elementType) if isinstance(t, T.ArrayType) else (F.lit(None), NULL)


@_operator("$arrayElemAt", 2, 2)
def _element(s: Scope, arr: Any, at: Any) -> Column:
    c, i = s.compile(arr), s.compile(at).cast("int")
    return F.when(i < 0, F.get(c, F.size(c) + i)).otherwise(F.get(c, i))


_operator("$concatArrays")(lambda s, *specs: F.concat(*[s.compile(x) for x in specs]))
_operator("$size", 1, 1)(lambda s, x: F.size(s.compile(x)) if isinstance(s.type_of(x), T.ArrayType) else F.lit(None).cast("int"))
_operator("$isArray", 1, 1)(lambda s, x: s.compile(x).isNotNull() if isinstance(s.type_of(x), T.ArrayType) else F.lit(False))
_operator("$reverseArray", 1, 1)(lambda s, x: F.reverse(s.compile(x)))


def _first(s: Scope, x: Any) -> Column:
    return F.get(s.compile(x), F.lit(0))


def _last(s: Scope, x: Any) -> Column:
    return F.try_element_at(s.compile(x), F.lit(-1))


_operator("$first", 1, 1)(_first)
_operator("$last", 1, 1)(_last)


@register("expression", "$filter")
def _filter(s: Scope, arg: dict) -> Column:
    c, e = _array(s, arg["input"])
    name = arg.get("as", "this")
    kept = F.filter(c, lambda x: s.bind(**{name: (x, e)}).truth(arg["cond"]))
    return F.slice(kept, F.lit(1), s.compile(arg["limit"])) if "limit" in arg else kept


@register("expression", "$map")
def _map(s: Scope, arg: dict) -> Column:
    c, e = _array(s, arg["input"])
    return F.transform(c, s.each(arg.get("as", "this"), e, arg["in"]))


@register("expression", "$reduce")
def _reduce(s: Scope, arg: dict) -> Column:
    """The running value takes the type that one step gives it."""
    c, e = _array(s, arg["input"])
    start = s.type_of(arg["initialValue"])
    t = s.bind(value=(F.lit(None).cast(start) if not isinstance(start, T.NullType) else F.lit(None), start), this=(F.lit(None).cast(e) if not isinstance(e, T.NullType) else F.lit(None), e)).type_of(arg["in"])
    cast = (lambda x: x) if isinstance(t, T.NullType) else (lambda x: x.cast(t))
    return F.aggregate(c, cast(s.compile(arg["initialValue"])), lambda a, x: cast(s.bind(value=(a, t), this=(x, e)).compile(arg["in"])))


def _n_of(s: Scope, arg: dict, f) -> Column:
    return f(s.compile(arg["input"]), s.compile(arg["n"]).cast("int"))


def last_n(c: Column, n: Column) -> Column:
    return F.slice(c, F.greatest(F.size(c) - n + 1, F.lit(1)), n)


register("expression", "$firstN", lambda s, arg: _n_of(s, arg, lambda c, n: F.slice(c, F.lit(1), n)))
register("expression", "$lastN", lambda s, arg: _n_of(s, arg, last_n))
register("expression", "$maxN", lambda s, arg: _n_of(s, arg, lambda c, n: F.slice(F.sort_array(F.array_compact(c), False), F.lit(1), n)))
register("expression", "$minN", lambda s, arg: _n_of(s, arg, lambda c, n: F.slice(F.sort_array(F.array_compact(c)), F.lit(1), n)))


def contains(s: Scope, value: Any, arr: Any) -> Column:
    """Whether an array holds a value; null is a value."""
    v, (c, e) = s.compile(value), _array(s, arr)
    if isinstance(e, T.NullType) and not isinstance(s.type_of(arr), T.ArrayType):
        raise SpecError("$in needs an array")
    return F.coalesce(F.exists(c, lambda x: x.eqNullSafe(v)), F.lit(False))


_operator("$in", 2, 2)(contains)
_operator("$nin", 2, 2)(lambda s, v, a: ~contains(s, v, a))


@_operator("$indexOfArray", 2, 4)
def _index(s: Scope, arr: Any, value: Any, start: Any = 0, end: Any = None) -> Column:
    """The first place of value from start to end (exclusive), -1 if there is none."""
    c, v, a = s.compile(arr), s.compile(value), s.compile(start).cast("int")
    part = F.slice(c, a + 1, F.greatest((F.size(c) if end is None else F.least(s.compile(end).cast("int"), F.size(c))) - a, F.lit(0)))
    at = F.array_position(part, v).cast("int")
    return F.when(at > 0, at - 1 + a).otherwise(F.when(c.isNotNull(), F.lit(-1)))


@_operator("$range", 2, 3)
def _range(s: Scope, start: Any, end: Any, step: Any = 1) -> Column:
    a, z, by = (s.compile(x).cast("int") for x in (start, end, step))
    last = F.when(by > 0, z - 1).otherwise(z + 1)
    return F.when(((by > 0) & (a < z)) | ((by < 0) & (a > z)), F.sequence(a, last, by)).otherwise(F.when(by == 0, F.raise_error(F.lit("$range: the step is 0"))).otherwise(F.array().cast("array<int>")))


@_operator("$slice", 2, 3)
def slice_of(s: Scope, arr: Any, a: Any, n: Any = None) -> Column:
    """The first n, the last n (negative), or n from a place, which counts from the end if negative."""
    return sliced(s.compile(arr), s.compile(a).cast("int"), None if n is None else s.compile(n).cast("int"))


def sliced(c: Column, a: Column, n: Column | None = None) -> Column:
    if n is None:
        return F.when(a >= 0, F.slice(c, F.lit(1), F.greatest(a, F.lit(0)))).otherwise(last_n(c, F.abs(a)))
    begin = F.when(a < 0, F.greatest(F.size(c) + a, F.lit(0))).otherwise(a)
    return F.slice(c, begin + 1, n)


@register("expression", "$sortArray")
def _sort_array(s: Scope, arg: dict) -> Column:
    c, e = _array(s, arg["input"])
    return sorted_by(c, e, arg["sortBy"])


def sorted_by(c: Column, e: T.DataType, by: Any) -> Column:
    """By the elements themselves (1 or -1) or by their fields; null first, last if descending."""
    if not isinstance(by, dict):
        return F.sort_array(c, by > 0)
    from ..plans.values import follow

    def order(x: Column, y: Column) -> Column:
        out = F.lit(0)
        for path, way in reversed(by.items()):
            a, b = follow(x, e, path.split("."))[0], follow(y, e, path.split("."))[0]
            less = F.when(a.eqNullSafe(b), out).when(a.isNull(), -way).when(b.isNull(), way).when(a < b, -way).otherwise(way)
            out = less
        return out.cast("int")

    return F.array_sort(c, order)


@register("expression", "$zip")
def _zip(s: Scope, arg: dict) -> Column:
    """Arrays of the elements at each place, as far as the shortest goes, or the longest with defaults."""
    arrays = [s.compile(x) for x in arg["inputs"]]
    sizes = [F.size(c) for c in arrays]
    longest = arg.get("useLongestLength", False)
    n = (F.greatest if longest else F.least)(*sizes) if len(sizes) > 1 else sizes[0]
    defaults = [s.compile(x) for x in arg.get("defaults", [])]
    place = lambda c, i, k: F.when(i < sizes[k], F.get(c, i)).otherwise(defaults[k]) if defaults else F.get(c, i)
    everywhere = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(F.concat(*[c.isNull().cast("string") for c in arrays]).contains("true"), None).otherwise(F.transform(everywhere, lambda i: F.array(*[place(c, i, k) for k, c in enumerate(arrays)])))


# sets


@_operator("$allElementsTrue", 1, 1)
def _all_true(s: Scope, x: Any) -> Column:
    c, e = _array(s, x)
    return F.forall(c, lambda v: truthy(v, e, s.options.strict))


@_operator("$anyElementTrue", 1, 1)
def _any_true(s: Scope, x: Any) -> Column:
    c, e = _array(s, x)
    return F.exists(c, lambda v: truthy(v, e, s.options.strict))


_operator("$setDifference", 2, 2)(lambda s, a, b: F.array_except(s.compile(a), s.compile(b)))
_operator("$setIsSubset", 2, 2)(lambda s, a, b: F.size(F.array_except(s.compile(a), s.compile(b))) == 0)


@_operator("$setEquals", 2)
def _set_equals(s: Scope, *specs: Any) -> Column:
    a = s.compile(specs[0])
    out = F.lit(True)
    for x in specs[1:]:
        b = s.compile(x)
        out = out & (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
    return out


def _folded(f):
    def run(s: Scope, *specs: Any) -> Column:
        out = F.array_distinct(s.compile(specs[0]))
        for x in specs[1:]:
            out = f(out, s.compile(x))
        return out

    return run


_operator("$setIntersection")(_folded(F.array_intersect))
_operator("$setUnion")(_folded(F.array_union))

# objects


def entries(c: Column, t: T.DataType) -> Column:
    """array of (k, v) of a struct or map."""
    if isinstance(t, T.MapType):
        return F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
    return F.when(c.isNotNull(), F.array(*[F.struct(F.lit(f.name).alias("k"), c.getField(f.name).alias("v")) for f in t.fields]))


@_operator("$objectToArray", 1, 1)
def _object_to_array(s: Scope, x: Any) -> Column:
    c, t = s.typed(x)
    if kind(t) != "object":
        raise SpecError("$objectToArray needs an object")
    return entries(c, t)


@_operator("$arrayToObject", 1, 1)
def _array_to_object(s: Scope, x: Any) -> Column:
    """A map from (k, v) objects or [k, v] pairs; of equal keys the last counts."""
    c, e = _array(s, x)
    pair = (lambda p: F.struct(F.get(p, F.lit(0)).cast("string").alias("k"), F.get(p, F.lit(1)).alias("v"))) if isinstance(e, T.ArrayType) else (lambda p: F.struct(p["k"].cast("string").alias("k"), p["v"].alias("v")))
    return merged_entries(F.transform(c, pair))


def merged_entries(pairs: Column) -> Column:
    """A map of (k, v) pairs, each key where it first stands, with its last value."""
    differs = lambda x, y: ~x["k"].eqNullSafe(y["k"])

    def picked(p: Column, order: Column) -> Column:
        first = F.filter(order, lambda x, i: (i == 0) | differs(x, F.get(order, i - 1)))
        last = F.filter(order, lambda x, i: (i == F.size(order) - 1) | differs(x, F.get(order, i + 1)))
        keys = F.sort_array(F.zip_with(first, last, lambda f, z: F.struct(f["at"].alias("first"), z["at"].alias("last"))))
        return once(keys, lambda ks: F.map_from_arrays(F.transform(ks, lambda x: F.get(p, x["first"])["k"]), F.transform(ks, lambda x: F.get(p, x["last"])["v"])))

    ordered = lambda p: F.sort_array(F.transform(p, lambda x, i: F.struct(x["k"].alias("k"), i.alias("at"))))
    return once(pairs, lambda p: once(ordered(p), lambda o: picked(p, o)))


def over(a: Column, b: Column) -> Column:
    """Map b laid over map a."""
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def merged(parts: list[tuple[Column, T.DataType]]) -> Column:
    """Objects joined, later ones over earlier ones; nulls are left out."""
    if any(isinstance(t, T.MapType) for _, t in parts):
        out = None
        for c, t in parts:
            m = c if isinstance(t, T.MapType) else F.map_from_entries(entries(c, t))
            m = F.coalesce(m, F.map_from_arrays(F.array().cast("array<string>"), F.array()).cast(t)) if isinstance(t, T.MapType) else m
            out = m if out is None else over(out, m)
        return out
    names: dict[str, Column] = {}
    for c, t in parts:
        for f in getattr(t, "fields", []):
            own = c.getField(f.name)
            names[f.name] = F.when(c.isNotNull(), own).otherwise(names[f.name]) if f.name in names else own
    return F.struct(*[v.alias(k) for k, v in names.items()])


_operator("$mergeObjects")(lambda s, *specs: merged([s.typed(x) for x in specs]))


@register("expression", "$getField")
def _get_field(s: Scope, arg: Any) -> Column:
    """A field by its literal name, of input or the document."""
    name, c, t = (arg["field"], *s.typed(arg.get("input", "$$CURRENT"))) if isinstance(arg, dict) else (arg, *s.root())
    if isinstance(name, dict):
        name = name["$literal"]
    found = field(c, t, name)
    return found[0] if found else F.lit(None)


def _set_field(s: Scope, arg: dict, value: Any) -> Column:
    c, t = s.typed(arg["input"])
    name = arg["field"]
    if value is REMOVE or value == "$$REMOVE":
        if isinstance(t, T.MapType):
            return F.map_filter(c, lambda k, v: k != name)
        return c.dropFields(f"`{name}`") if name in t.fieldNames() else c
    if isinstance(t, T.MapType):
        return F.map_concat(F.map_filter(c, lambda k, v: k != name), F.create_map(F.lit(name), s.compile(value).cast(t.valueType)))
    return c.withField(f"`{name}`", s.compile(value))


register("expression", "$setField", lambda s, arg: _set_field(s, arg, arg["value"]))
register("expression", "$unsetField", lambda s, arg: _set_field(s, arg, REMOVE))


def nearest_rank(c: Column, p: float) -> Column:
    """The element of a sorted array at a share p of it."""
    return F.get(c, F.greatest(F.ceil(F.size(c) * F.lit(float(p))).cast("int") - 1, F.lit(0)))


@register("expression", "$percentile")
def _percentile(s: Scope, arg: dict) -> Column:
    c = F.sort_array(F.array_compact(s.compile(arg["input"]))).cast("array<double>")
    return F.array(*[nearest_rank(c, p) for p in arg["p"]])


@register("expression", "$median")
def _median(s: Scope, arg: dict) -> Column:
    return nearest_rank(F.sort_array(F.array_compact(s.compile(arg["input"]))).cast("array<double>"), 0.5)
