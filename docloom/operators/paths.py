"""Writing at paths: columns with a value put, changed or taken out somewhere inside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.values import NULL

#: From the value at a path (and its type) to the new one; None takes the field out.
Change = Callable[[Column, T.DataType], Column | None]


def changed(c: Column, t: T.DataType, parts: list[str], change: Change, filters: dict | None = None) -> Column | None:
    """c with change applied at the path. `[]` is every element, `[id]` those that filters[id] accepts, a number a place; a name on an array is that field of every element."""
    if not parts:
        return change(c, t)
    head, rest = parts[0], parts[1:]
    if isinstance(t, T.ArrayType):
        inner = lambda x: changed(x, t.elementType, rest, change, filters)
        as_is = lambda y: F.lit(None).cast(t.elementType) if y is None else y
        if head in ("[]", "$[]"):
            return F.transform(c, lambda x: as_is(inner(x)))
        if head.strip("$").startswith("["):
            test = (filters or {})[head.strip("$")[1:-1]]
            return F.transform(c, lambda x: F.when(test(x, t.elementType), as_is(inner(x))).otherwise(x))
        if head.isdigit():
            return F.transform(c, lambda x, i: F.when(i == int(head), as_is(inner(x))).otherwise(x))
        return F.transform(c, lambda x: changed(x, t.elementType, parts, change, filters))
    if isinstance(t, T.MapType):
        now = changed(F.try_element_at(c, F.lit(head)), t.valueType, rest, change, filters)
        rest_of = F.map_filter(c, lambda k, v: k != head)
        return rest_of if now is None else F.map_concat(rest_of, F.create_map(F.lit(head), now.cast(t.valueType)))
    fields = {f.name: f.dataType for f in t.fields} if isinstance(t, T.StructType) else {}
    now = changed(c.getField(head) if head in fields else F.lit(None), fields.get(head, NULL), rest, change, filters)
    out = []
    for n in fields:
        if n != head:
            out.append(c.getField(n).alias(n))
        elif now is not None:
            out.append(now.alias(n))
    if head not in fields and now is not None:
        out.append(now.alias(head))
    return F.struct(*out) if out else None


def put(df: DataFrame, path: str, change: Change, filters: dict | None = None) -> DataFrame:
    """df with change applied at a dotted path of its columns."""
    return put_all(df, {path: change}, filters)


def put_all(df: DataFrame, changes: dict[str, Change], filters: dict | None = None) -> DataFrame:
    """All changes at once: each sees the values before."""
    now: dict[str, tuple[Column, T.DataType]] = {}
    gone: set[str] = set()
    for path, change in changes.items():
        name, rest = (path, []) if path in df.columns else (path.split(".")[0], path.split(".")[1:])
        c, t = now.get(name) or ((F.col(f"`{name}`"), df.schema[name].dataType) if name in df.columns else (F.lit(None), NULL))
        new = changed(c, t, rest, change, filters)
        if new is None:
            gone.add(name)
            now.pop(name, None)
        else:
            gone.discard(name)
            now[name] = (new, df.select(new.alias("x")).schema[0].dataType)
    out = [now[n][0].alias(n) if n in now else F.col(f"`{n}`") for n in df.columns if n not in gone]
    return df.select(*out, *[c.alias(n) for n, (c, _) in now.items() if n not in df.columns])
