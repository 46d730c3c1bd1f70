"""$setWindowFields and $fill: window operators and frames."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..context import SpecError, register
from ..functions.dates import MS
from ..plans.scope import Scope
from ..plans.values import kind
from .accumulators import Group, accumulate

#: Operators that need sortBy, and those that go over the whole partition and take no window.
NEED_SORT = {"$denseRank", "$documentNumber", "$first", "$last", "$linearFill", "$locf", "$rank", "$shift", "$expMovingAvg", "$derivative", "$integral"}
WHOLE = {"$denseRank", "$documentNumber", "$rank", "$shift", "$expMovingAvg", "$linearFill", "$locf"}


#: Natural logarithm of the share to which weights of a moving average fall within a block.
REACH = 250.0

#: A window operator that takes more than one window over another: adds the column of a name to a DataFrame.
Step = Callable[[DataFrame, str], DataFrame]


class Frame:
    """A partition in order: parts and keys of the window, and what a field's own window adds."""

    def __init__(self, s: Scope, parts: list[Column], by: dict, spec: dict | None):
        self.s, self.parts, self.by, self.spec = s, parts, by, spec or {}
        self.keys = [(s.field(k)[0], v in (-1, "desc")) for k, v in by.items()]
        self.first = s.field(next(iter(by))) if by else None

    def ordered(self) -> WindowSpec:
        w = Window.partitionBy(*self.parts) if self.parts else Window.partitionBy(F.lit(1))
        return w.orderBy(*[c.desc_nulls_last() if d else c.asc_nulls_first() for c, d in self.keys]) if self.keys else w

    def rank(self) -> WindowSpec:
        """In the order of the first key alone."""
        c, d = self.keys[0]
        w = Window.partitionBy(*self.parts) if self.parts else Window.partitionBy(F.lit(1))
        return w.orderBy(c.desc_nulls_last() if d else c.asc_nulls_first())

    def position(self) -> tuple[Column, float]:
        """The first sort key as a number, and how many of it make one of the window's units."""
        c, t = self.first
        unit = self.spec.get("unit")
        if kind(t) == "date":
            return F.unix_millis(c.cast("timestamp")).cast("double"), MS[unit] if unit else 1
        return c.cast("double"), 1

    def framed(self) -> WindowSpec:
        """The frame of documents (rows) or range (values of the first key, in units if it is a date); the whole partition without one."""
        at = lambda v, none: none if v == "unbounded" else 0 if v == "current" else v
        if "documents" in self.spec:
            a, z = self.spec["documents"]
            return self.ordered().rowsBetween(at(a, Window.unboundedPreceding), at(z, Window.unboundedFollowing))
        if "range" in self.spec:
            a, z = self.spec["range"]
            if len(self.keys) != 1:
                raise SpecError("a range goes with one sort key")
            c, t = self.first
            unit = self.spec.get("unit")
            if kind(t) == "date":
                if unit not in MS:
                    raise SpecError(f"a range over dates has a unit of fixed length: {', '.join(MS)}")
                c, by = F.unix_millis(c.cast("timestamp")), MS[unit]
            else:
                by = 1
            w = Window.partitionBy(*self.parts) if self.parts else Window.partitionBy(F.lit(1))
            w = w.orderBy(c.desc_nulls_last() if self.keys[0][1] else c.asc_nulls_first())
            scaled = lambda v, none: at(v, none) if isinstance(v, str) else int(v * by)
            return w.rangeBetween(scaled(a, Window.unboundedPreceding), scaled(z, Window.unboundedFollowing))
        return self.ordered().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


register("window", "$denseRank", lambda f, arg: F.dense_rank().over(f.rank()))
register("window", "$rank", lambda f, arg: F.rank().over(f.rank()))
register("window", "$documentNumber", lambda f, arg: F.row_number().over(f.ordered()))


@register("window", "$shift")
def _shift(f: Frame, arg: dict) -> Column:
    c, by = f.s.compile(arg["output"]), int(arg["by"])
    default = arg.get("default")
    return (F.lead(c, by, default) if by >= 0 else F.lag(c, -by, default)).over(f.ordered())


@register("window", "$locf")
def _locf(f: Frame, arg: Any) -> Column:
    return F.last(f.s.compile(arg), ignorenulls=True).over(f.ordered().rowsBetween(Window.unboundedPreceding, 0))


@register("window", "$linearFill")
def _linear_fill(f: Frame, arg: Any) -> Column:
    """Between the known values on either side, by the first sort key."""
    y, (x, _) = f.s.compile(arg).cast("double"), f.position()
    known = F.when(y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))
    a = F.last(known, ignorenulls=True).over(f.ordered().rowsBetween(Window.unboundedPreceding, 0))
    z = F.first(known, ignorenulls=True).over(f.ordered().rowsBetween(0, Window.unboundedFollowing))
    return F.coalesce(y, a["y"] + (z["y"] - a["y"]) * F.try_divide(x - a["x"], z["x"] - a["x"]))


@register("window", "$derivative")
def _derivative(f: Frame, arg: dict) -> Column:
    """The slope from the frame's first document to its last, per unit; null for one document."""
    y = f.s.compile(arg["input"]).cast("double")
    x, t = f.position()[0], f.first[1]
    by = MS[arg["unit"]] if arg.get("unit") and kind(t) == "date" else 1
    w = f.framed()
    return F.try_divide(F.last(y).over(w) - F.first(y).over(w), (F.last(x).over(w) - F.first(x).over(w)) / by)


@register("window", "$integral")
def _integral(f: Frame, arg: dict) -> Column:
    """The area under the frame's values by trapezoids, per unit; null if one isn't a number."""
    y = f.s.compile(arg["input"]).cast("double")
    x, t = f.position()[0], f.first[1]
    by = MS[arg["unit"]] if arg.get("unit") and kind(t) == "date" else 1
    step = (x - F.lag(x).over(f.ordered())) / by * (y + F.lag(y).over(f.ordered())) / 2
    w = f.framed()
    area = F.coalesce(F.sum(step).over(w), F.lit(0.0)) - F.first(F.coalesce(step, F.lit(0.0))).over(w)
    return F.when(F.count(y).over(w) == F.count(F.lit(1)).over(w), area)


@register("window", "$expMovingAvg")
def _exp_moving_avg(f: Frame, arg: dict) -> Step:
    """alpha, or 2 / (N + 1), times the value plus the rest of the average before; null throughout if one isn't a number.

    The average of row n is (1 - alpha)^n y0 plus the sum of alpha (1 - alpha)^(n - i) yi: a running sum of values with growing weights,
    scaled back. So that weights stay within a double, rows are cut into blocks at whose length a weight has fallen by e^REACH; a block
    starts from the average at the end of the one before, and what lies before that is far below a double's last digit.
    """
    if ("N" in arg) == ("alpha" in arg):
        raise SpecError("$expMovingAvg takes N or alpha")
    alpha = float(arg["alpha"]) if "alpha" in arg else 2 / (arg["N"] + 1)
    y = f.s.compile(arg["input"]).cast("double")
    parts = f.parts or [F.lit(1)]
    whole = f.ordered().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fall = -math.log1p(-alpha) if alpha < 1 else REACH
    length = math.ceil(REACH / fall)

    def step(df: DataFrame, name: str) -> DataFrame:
        at, y_, local, full = (F.col(f"{name}_{x}") for x in ("at", "y", "local", "full"))
        i = at % length
        held = df.withColumns({f"{name}_at": F.row_number().over(f.ordered()) - 1, f"{name}_y": y, f"{name}_full": F.count(y).over(whole) == F.count(F.lit(1)).over(whole)})
        if alpha >= 1:
            return held.withColumn(name, F.when(full, y_)).drop(f"{name}_at", f"{name}_y", f"{name}_full")
        block = Window.partitionBy(*parts, F.floor(at / length)).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
        held = held.withColumn(f"{name}_local", F.sum(F.when(at == 0, y_).otherwise(y_ * alpha) * F.exp(i * fall)).over(block) * F.exp(-i * fall))
        before = F.last(F.when(i == length - 1, local), ignorenulls=True).over(Window.partitionBy(*parts).orderBy(at).rowsBetween(Window.unboundedPreceding, -1))
        held = held.withColumn(name, F.when(full, local + F.coalesce(before, F.lit(0.0)) * F.exp(-(i + 1) * fall)))
        return held.drop(*[f"{name}_{x}" for x in ("at", "y", "local", "full")])

    return step


def window_field(s: Scope, parts: list[Column], by: dict, spec: dict) -> Column | Step:
    """The Column, or the step that adds it, of {operator: operand, window: {documents | range, unit}}."""
    ops = [k for k in spec if k != "window"]
    if len(ops) != 1:
        raise SpecError("a window field holds one operator")
    name, window = ops[0], spec.get("window")
    if name in NEED_SORT and not by:
        raise SpecError(f"{name} needs sortBy")
    if name in WHOLE and window:
        raise SpecError(f"{name} takes no window")
    if window and not by and "documents" in window and window["documents"] != ["unbounded", "unbounded"]:
        raise SpecError("a bounded window needs sortBy")
    f = Frame(s, parts, by, window)
    context = s.options.context
    if found := context.get("window", name):
        return found(f, spec[name])
    if context.get("accumulator", name) is None:
        raise SpecError(f"unknown window operator {name}")
    w = f.framed()
    return accumulate(s, {name: spec[name]}, Group(f.keys, lambda c: c.over(w)))
