"""Expressions: from a specification to a Column."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..context import Options, SpecError
from .values import NULL, follow, kind, literal, truthy

#: What $$REMOVE compiles to until a stage takes it out.
REMOVE = object()


@dataclass
class Scope:
    """What names mean while an expression is compiled: the fields of df (or of current), and variables as (Column, type)."""

    df: DataFrame
    options: Options = field(default_factory=Options)
    now: dt.datetime = field(default_factory=lambda: dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))
    vars: dict[str, tuple[Column, T.DataType]] = field(default_factory=dict)
    current: tuple[Column, T.DataType] | None = None
    redact: bool = False

    def root(self) -> tuple[Column, T.DataType]:
        if self.current is not None:
            return self.current
        return F.struct(*[F.col(f"`{c}`") for c in self.df.columns]), self.df.schema

    def field(self, path: str) -> tuple[Column, T.DataType]:
        """The value at a dotted path of the document; null if there is none."""
        parts = path.split(".")
        if self.current is not None:
            return follow(*self.current, parts)
        if path in self.df.columns:
            return F.col(f"`{path}`"), self.df.schema[path].dataType
        if parts[0] not in self.df.columns:
            return F.lit(None), NULL
        return follow(F.col(f"`{parts[0]}`"), self.df.schema[parts[0]].dataType, parts[1:])

    def variable(self, name: str) -> tuple[Column, T.DataType]:
        head, _, rest = name.partition(".")
        if head in ("ROOT", "CURRENT"):
            found = self.root()
        elif head == "NOW":
            found = F.lit(self.now).cast("timestamp"), T.TimestampType()
        elif head in self.vars:
            found = self.vars[head]
        elif head in self.options.variables:
            value = self.options.variables[head]
            found = literal(value), self.type_of_column(literal(value))
        elif self.redact and head in ("KEEP", "PRUNE", "DESCEND"):
            found = F.lit(head), T.StringType()
        elif head == "REMOVE":
            found = F.lit(None), NULL
        else:
            raise SpecError(f"no such variable: $${head}")
        return follow(*found, rest.split(".")) if rest else found

    def bind(self, **names: tuple[Column, T.DataType]) -> Scope:
        return replace(self, vars=self.vars | names)

    def compile(self, spec: Any) -> Column:
        if isinstance(spec, Column):
            return spec
        if isinstance(spec, str) and spec.startswith("$$"):
            return self.variable(spec[2:])[0]
        if isinstance(spec, str) and spec.startswith("$"):
            return self.field(spec[1:])[0]
        if isinstance(spec, (list, tuple)):
            return self.array(list(spec))
        if isinstance(spec, dict):
            names = [k for k in spec if k.startswith("$")]
            if names:
                if len(spec) != 1:
                    raise SpecError(f"an expression holds one operator: {', '.join(spec)}")
                return self.call(names[0], spec[names[0]])
            return F.struct(*[self.compile(v).alias(k) for k, v in spec.items()])
        return literal(spec)

    def array(self, specs: list) -> Column:
        """An array of values; those of different brackets become strings, as an array has one type."""
        parts = [self.compile(x) for x in specs]
        if len(parts) > 1 and len({kind(self.type_of(x)) for x in specs} - {"null"}) > 1:
            parts = [c.cast("string") for c in parts]
        return F.array(*parts)

    def call(self, name: str, arg: Any) -> Column:
        context = self.options.context
        if found := context.get("expression", name):
            return found(self, arg)
        if found := context.get("accumulator", name):
            from ..operators.accumulators import over_array

            return over_array(self, name, arg)
        raise SpecError(f"unknown expression operator {name}")

    def type_of_column(self, c: Column) -> T.DataType:
        return self.df.select(c.alias("x")).schema[0].dataType

    def probe(self) -> Scope:
        """The same names with typed nulls for lambda variables, so that types can be found before the lambda exists."""
        known = lambda t: F.lit(None) if isinstance(t, T.NullType) else F.lit(None).cast(t)
        return replace(self, vars={k: (known(t), t) for k, (_, t) in self.vars.items()}, current=self.current and (known(self.current[1]), self.current[1]))

    def type_of(self, spec: Any) -> T.DataType:
        """The type of an expression's value, by analysis alone."""
        if isinstance(spec, str) and spec.startswith("$$"):
            return self.variable(spec[2:])[1]
        if isinstance(spec, str) and spec.startswith("$"):
            return self.field(spec[1:])[1]
        return self.type_of_column(self.probe().compile(spec))

    def typed(self, spec: Any) -> tuple[Column, T.DataType]:
        return self.compile(spec), self.type_of(spec)

    def truth(self, spec: Any) -> Column:
        return truthy(*self.typed(spec), self.options.strict)

    def args(self, arg: Any, least: int = 1, most: int | None = None) -> list[Any]:
        """An operator's operands: a list, or one alone."""
        out = list(arg) if isinstance(arg, (list, tuple)) else [arg]
        if len(out) < least or (most is not None and len(out) > most):
            raise SpecError(f"wrong number of operands: {len(out)}")
        return out

    def each(self, name: str, element: T.DataType, spec: Any) -> Callable[[Column], Column]:
        """A lambda over array elements with the element under a variable's name."""
        return lambda x: self.bind(**{name: (x, element)}).compile(spec)
