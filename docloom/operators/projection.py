"""Projections: inclusion, exclusion and computed fields, nested and through arrays."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..context import SpecError, register
from ..functions.collections import sliced
from ..plans.scope import Scope
from ..plans.values import field
from .query import element_query


@register("projection", "$elemMatch")
def _elem_match(s: Scope, at: tuple[Column, T.DataType], arg: Any) -> Column:
    """The first element that matches, in an array; null if none does."""
    c, t = at
    if not isinstance(t, T.ArrayType):
        return F.lit(None)
    found = F.filter(c, lambda x: element_query(s, x, t.elementType, arg))
    found = F.slice(found, F.lit(1), F.lit(1)) if s.options.strict else found
    return F.when(F.size(found) > 0, found)


@register("projection", "$slice")
def _slice(s: Scope, at: tuple[Column, T.DataType], arg: Any) -> Column:
    """n, or [skip, n], of an array; anything else stays as it is."""
    c, t = at
    if not isinstance(t, T.ArrayType):
        return c
    a, n = arg if isinstance(arg, (list, tuple)) else (arg, None)
    return sliced(c, F.lit(int(a)), None if n is None else F.lit(int(n)))


def _tree(spec: dict) -> dict:
    """Dotted names as nested ones."""
    out: dict = {}
    for k, v in spec.items():
        at, (*path, last) = out, k.split(".")
        for name in path:
            at = at.setdefault(name, {})
            if not isinstance(at, dict):
                raise SpecError(f"paths collide at {k}")
        at[last] = dict(v) if isinstance(v, dict) else v
    return out


def _flag(v: Any) -> bool | None:
    return bool(v) if isinstance(v, (bool, int)) and v in (0, 1) else None


def _is_place(arg: Any) -> bool:
    """n or [skip, n], the operand of the projection $slice; the expression's begins with an array."""
    return all(isinstance(x, int) for x in (arg if isinstance(arg, (list, tuple)) else [arg]))


def excludes(spec: dict, id_key: str) -> bool:
    """Whether a projection names what to leave out; mixing both (but for the id) is an error."""
    flags = {_flag(v) for k, v in _leaves(spec) if k != id_key and _flag(v) is not None}
    if len(flags) > 1:
        raise SpecError("a projection includes fields or excludes them, not both")
    computed = any(_flag(v) is None and not (isinstance(v, dict) and "$slice" in v and _is_place(v["$slice"])) for k, v in _leaves(spec) if k != id_key)
    if flags == {False} and computed:
        raise SpecError("an exclusion has no computed fields")
    return flags == {False} or (not flags and not computed)


def _leaves(spec: dict, path: str = "") -> list[tuple[str, Any]]:
    out = []
    for k, v in spec.items():
        if isinstance(v, dict) and v and not any(x.startswith("$") for x in v):
            out += _leaves(v, f"{path}{k}.")
        else:
            out.append((path + k, v))
    return out


def without(c: Column, t: T.DataType, tree: dict) -> Column:
    """A value less the fields that tree marks; elements of arrays too."""
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: without(x, t.elementType, tree))
    if not isinstance(t, T.StructType):
        return c
    kept = []
    for f in t.fields:
        v = tree.get(f.name)
        if isinstance(v, dict):
            kept.append(without(c.getField(f.name), f.dataType, v).alias(f.name))
        elif v is None or _flag(v) is not False:
            kept.append(c.getField(f.name).alias(f.name))
    return F.when(c.isNotNull(), F.struct(*kept)) if kept else F.lit(None)


def _value(s: Scope, at: tuple[Column, T.DataType] | None, v: Any) -> Column | None:
    """The projected value of one field; None if it is left out. at: the field in the document, if it is there."""
    if _flag(v) is not None:
        return at[0] if v and at else None
    if isinstance(v, dict) and v and not any(k.startswith("$") for k in v):
        if at is None:
            return None if all(_flag(x) is not None for _, x in _leaves(v)) else s.compile(v)
        return nested(s, *at, _tree(v))
    if isinstance(v, dict) and len(v) == 1:
        ((name, arg),) = v.items()
        own = s.options.context.get("projection", name)
        if own and at and (name != "$slice" or _is_place(arg)):
            return own(s, at, arg)
    return s.compile(v)


def nested(s: Scope, c: Column, t: T.DataType, tree: dict) -> Column:
    """A value with the fields of tree only; elements of arrays too."""
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: nested(s, x, t.elementType, tree))
    out = []
    for k, v in tree.items():
        value = _value(s, field(c, t, k), v)
        if value is not None:
            out.append(value.alias(k))
    return F.when(c.isNotNull(), F.struct(*out)) if out else F.lit(None)


def project(df: DataFrame, spec: dict, s: Scope) -> DataFrame:
    """The id stays unless it is excluded; included fields come in the document's order, then computed ones."""
    if not spec:
        raise SpecError("a projection names at least one field")
    tree, key = _tree(spec), s.options.id_key
    top = lambda n: (F.col(f"`{n}`"), df.schema[n].dataType)
    if excludes(spec, key):
        out = []
        for n in df.columns:
            v = tree.get(n)
            if isinstance(v, dict) and any(x.startswith("$") for x in v):
                out.append(_value(s, top(n), v).alias(n))
            elif isinstance(v, dict):
                out.append(without(*top(n), v).alias(n))
            elif v is None or _flag(v) is not False:
                out.append(F.col(f"`{n}`"))
        return df.select(*out)
    tree = {k: v for k, v in tree.items() if not (k == key and _flag(v) is False)}
    names = [n for n in df.columns if n in tree or (n == key and _flag(spec.get(key, 1)) is not False)]
    out = []
    for n in names + [k for k in tree if k not in df.columns]:
        value = _value(s, top(n) if n in df.columns else None, tree.get(n, 1))
        if value is not None:
            out.append(value.alias(n))
    return df.select(*out)
