"""Merge policies: how two or more values on one cell become one.

A policy resolves two columns (overlays) and aggregates a group (transforms). Integer sums saturate at the bounds of
the value's type. Order-dependent policies take an explicit order column: they never depend on the plan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncated_division(a: Column, b: Column) -> Column:
    """Integer division that truncates toward zero, exact at 64 bits."""
    return F.call_function("div", a, b)


#: Bounds of the integer types.
_BOUNDS = {"tinyint": (-(1 << 7), (1 << 7) - 1), "smallint": (-(1 << 15), (1 << 15) - 1), "int": (-(1 << 31), (1 << 31) - 1), "bigint": (-(1 << 63), (1 << 63) - 1)}


class MergePolicy:
    """Subclass this for policies of your own; ``kind`` is the value's Spark type name."""

    name = "custom"
    #: Whether the result of a group does not depend on its order.
    commutative = False

    def resolve(self, a: Column, b: Column, kind: str) -> Column:
        raise NotImplementedError

    def aggregate(self, value: Column, order: Column, kind: str) -> Column:
        """A fold of ``resolve`` in the given order; subclasses replace it by a built-in aggregate where there is one."""
        rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
        rest = F.slice(rows, F.lit(2), F.size(rows) - 1)
        return F.aggregate(rest, rows[0]["v"], lambda acc, r: self.resolve(acc, r["v"], kind).cast(kind))

    def __eq__(self, other) -> bool:
        return type(self) is type(other)

    def __hash__(self) -> int:
        return hash(type(self))

    def __repr__(self) -> str:
        return self.name


class Max(MergePolicy):
    name, commutative = "Max", True

    def resolve(self, a, b, kind):
        return F.greatest(a, b)

    def aggregate(self, value, order, kind):
        return F.max(value)


class Min(MergePolicy):
    name, commutative = "Min", True

    def resolve(self, a, b, kind):
        return F.least(a, b)

    def aggregate(self, value, order, kind):
        return F.min(value)


class Sum(MergePolicy):
    name, commutative = "Sum", True

    def _clamped(self, total: Column, rough: Column, kind: str) -> Column:
        low, high = _BOUNDS[kind]
        edge = F.when(rough > 0, F.lit(high)).otherwise(F.lit(low))
        return F.when(total.isNull(), edge).otherwise(F.least(F.greatest(total, F.lit(low)), F.lit(high))).cast(kind)

    def resolve(self, a, b, kind):
        if kind not in _BOUNDS:
            return a + b
        wide = a.cast("long"), b.cast("long")
        return self._clamped(F.try_add(*wide), wide[0].cast("double") + wide[1].cast("double"), kind)

    def aggregate(self, value, order, kind):
        if kind not in _BOUNDS:
            return F.sum(value)
        if kind != "bigint":  # fewer than 2**31 values of 32 bits cannot leave 64
            low, high = _BOUNDS[kind]
            return F.least(F.greatest(F.sum(value.cast("long")), F.lit(low)), F.lit(high)).cast(kind)
        return self._clamped(F.try_sum(value), F.sum(value.cast("double")), kind)


class Average(MergePolicy):
    """Two values: their mean; a group: sum over true count. Integers truncate."""

    name = "Average"

    def resolve(self, a, b, kind):
        total = Sum().resolve(a, b, kind)
        return truncated_division(total, F.lit(2)).cast(kind) if kind in _BOUNDS else total / 2

    def aggregate(self, value, order, kind):
        if kind not in _BOUNDS:
            return F.avg(value)
        if kind != "bigint":
            return truncated_division(F.sum(value.cast("long")), F.count(value)).cast(kind)
        total, n = F.sum(value.cast("decimal(19,0)")), F.count(value)  # wide: sums of 64 bits may leave them
        return ((total - total % n) / n).cast(kind)


class Difference(MergePolicy):
    """a - b where a >= b, else the type's zero."""

    name = "Difference"

    def resolve(self, a, b, kind):
        return F.when(a >= b, a - b).otherwise(F.lit(0).cast(kind))


class KeepExisting(MergePolicy):
    name = "KeepExisting"

    def resolve(self, a, b, kind):
        return a

    def aggregate(self, value, order, kind):
        return F.min_by(value, order)


class Overwrite(MergePolicy):
    name = "Overwrite"

    def resolve(self, a, b, kind):
        return b

    def aggregate(self, value, order, kind):
        return F.max_by(value, order)


MAX, MIN, SUM, AVERAGE, DIFFERENCE, KEEP_EXISTING, OVERWRITE = Max(), Min(), Sum(), Average(), Difference(), KeepExisting(), Overwrite()
