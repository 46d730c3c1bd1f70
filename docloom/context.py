"""Operator registry and options."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

#: The kinds of operator that can be registered.
KINDS = ("expression", "accumulator", "pipeline", "projection", "query", "window", "update")
_NAME = re.compile(r"\$[A-Za-z0-9_]+")
_global: dict[str, dict[str, Callable]] = {k: {} for k in KINDS}


class SpecError(ValueError):
    """A query specification that can't be compiled."""


def _checked(kind: str, name: str) -> None:
    if kind not in KINDS:
        raise SpecError(f"no such kind of operator: {kind}")
    if not _NAME.fullmatch(name):
        raise SpecError(f"an operator's name is $ and letters, digits or underscores: {name}")


def register(kind: str, name: str, function: Callable | None = None):
    """Add an operator for every query; refuses to redefine one. Usable as a decorator."""
    _checked(kind, name)
    if function is None:
        return lambda f: register(kind, name, f) or f
    if _global[kind].get(name, function) is not function:
        raise SpecError(f"{name} is defined already")
    _global[kind][name] = function
    return None


@dataclass
class Context:
    """Operators of one query, looked up before the global ones; an entry is never overridden. Update operators are global only.

    use_global: whether operators that the query doesn't bring are those registered for all queries, or unknown.
    """

    own: dict[str, dict[str, Callable]] = field(default_factory=lambda: {k: {} for k in KINDS})
    use_global: bool = True

    def add(self, kind: str, name: str, function: Callable) -> Context:
        _checked(kind, name)
        if kind == "update":
            raise SpecError("update operators are registered for all queries")
        self.own[kind].setdefault(name, function)
        return self

    def get(self, kind: str, name: str) -> Callable | None:
        return self.own[kind].get(name) or (_global[kind].get(name) if self.use_global else None)


@dataclass
class Options:
    """id_key: the key that projections keep; strict: whether an empty string is true and the projection $elemMatch stops at its first match; collation: for sorting strings, a Spark collation's name or a dict of locale, strength (1 letters, 2 accents too, 3 case too), caseLevel, caseFirst (upper, lower, off), numericOrdering and alternate (shifted: blanks and punctuation don't count); collections: names to DataFrames, or a
    function; variables: values for $$name; validator: from a JSON schema to a Python predicate on a row as dict; script_enabled: allow host functions."""

    id_key: str = "_id"
    collation: str | dict | None = None
    collections: Any = None
    variables: dict[str, Any] = field(default_factory=dict)
    validator: Callable | None = None
    script_enabled: bool = True
    strict: bool = True
    context: Context = field(default_factory=Context)

    def need_scripts(self, name: str) -> None:
        if not self.script_enabled:
            raise SpecError(f"{name} needs script_enabled")


def operators(kind: str) -> list[str]:
    """The names registered for all queries."""
    return sorted(_global[kind])
