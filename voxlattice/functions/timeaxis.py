"""Time: buckets, spans, units, dyadic segments."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxlattice.domain import CALENDAR, MAX_TIME_ZOOM, SECOND, WHOLE
from voxlattice.errors import IdError
from voxlattice.functions.ids import shift_left, shift_right


def bucket(unix: Column, interval: int) -> Column:
    """Index of the interval that holds a second."""
    return F.floor(unix / F.lit(interval)).cast("long")


def span(t: Column, interval: Column | int) -> Column:
    """``struct<t0, t1>`` of the t-th interval."""
    i = F.lit(interval) if isinstance(interval, int) else interval
    return F.struct((t * i).cast("long").alias("t0"), ((t + 1) * i).cast("long").alias("t1"))


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (a0 < b1) & (b0 < a1)


def allowed_units(units: tuple[int, ...]) -> tuple[int, ...]:
    """Descending units; the whole and the second are always among them."""
    if any(not 1 <= u <= WHOLE for u in units):
        raise IdError(f"units must lie in 1..{WHOLE}")
    return tuple(sorted({*units, WHOLE, SECOND}, reverse=True))


def coarsest_allowed(t0: Column, t1: Column, units: tuple[int, ...] = CALENDAR) -> Column:
    """The largest allowed unit that divides both ends."""
    out = F.lit(SECOND).cast("long")
    for u in sorted(allowed_units(units)):
        out = F.when((t0 % u == 0) & (t1 % u == 0), F.lit(u).cast("long")).otherwise(out)
    return out


def coarsest_unit(t0: Column, t1: Column) -> Column:
    """gcd(start, width), by Euclid's steps unrolled over an array (48 steps suffice below 2**35)."""
    width = t1 - t0
    step = lambda acc, _: F.struct(acc["b"].alias("a"), F.when(acc["b"] == 0, F.lit(0).cast("long")).otherwise(acc["a"] % acc["b"]).alias("b"))
    last = lambda acc, _: F.when(acc["b"] == 0, acc).otherwise(step(acc, _))
    start = F.struct(t0.cast("long").alias("a"), width.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(52)), start, last)["a"]


def relabel(t0: Column, t1: Column, unit: Column) -> Column:
    """``struct<i, lo, hi>``: the same seconds as closed indices of another unit; null where it does not divide."""
    fits = (t0 % unit == 0) & (t1 % unit == 0)
    return F.when(fits, F.struct(unit.alias("i"), (t0 / unit).cast("long").alias("lo"), ((t1 / unit).cast("long") - 1).alias("hi")))


def dyadic(lo: int, hi: int, zoom: int) -> list[tuple[int, int]]:
    """Minimal dyadic cover (zoom, index) of the half-open index range lo..hi at ``zoom``; also below zero."""
    out = []
    while lo < hi:
        free = (lo & -lo).bit_length() - 1 if lo else zoom
        k = min(free, (hi - lo).bit_length() - 1, zoom)
        out.append((zoom - k, lo >> k))
        lo += 1 << k
    return out


def segments(start: int, end: int) -> list[tuple[int, int]]:
    """Minimal dyadic segments of a span of seconds."""
    if not 0 <= start < end <= WHOLE:
        raise IdError(f"[{start}, {end}) is not a span")
    return dyadic(start, end, MAX_TIME_ZOOM)


def dyadic_column(lo: Column, hi: Column, zoom: Column | int) -> Column:
    """``array<struct<zoom, index>>``: the same cover as a native expression, level by level, up to what fits the range.

    A level has at most two segments: the first in the range if its index is odd, and the last if it is even.
    """
    kind = "array<struct<zoom:int,index:bigint>>"
    lo, hi, zoom = lo.cast("long"), hi.cast("long"), (F.lit(zoom) if isinstance(zoom, int) else zoom).cast("int")
    low, high = (lambda k: -shift_right(-lo, k)), (lambda k: shift_right(hi, k))
    odd = lambda c: c.bitwiseAND(F.lit(1).cast("long")) == 1
    piece = lambda k, i: F.struct((zoom - k).cast("int").alias("zoom"), i.alias("index"))
    deepest = F.least(zoom, F.length(F.bin(hi - lo)) - 1)
    levels = F.sequence(F.lit(0), deepest)
    first = F.transform(F.filter(levels, lambda k: (k < zoom) & (low(k) < high(k)) & odd(low(k))), lambda k: piece(k, low(k)))
    last = F.transform(F.reverse(F.filter(levels, lambda k: (k < zoom) & (low(k) < high(k)) & odd(high(k)))), lambda k: piece(k, high(k) - 1))
    whole = F.when((deepest == zoom) & (low(zoom) < high(zoom)), F.transform(F.sequence(low(zoom), high(zoom) - 1), lambda i: piece(zoom, i))).otherwise(F.array().cast(kind))
    return F.when(lo < hi, F.concat(first.cast(kind), whole.cast(kind), last.cast(kind))).otherwise(F.array().cast(kind))


def gcd_unit(t0: int, t1: int) -> int:
    return math.gcd(t0, t1 - t0)


def span_difference(a: tuple[int, int], b: tuple[int, int]) -> list[tuple[int, int]]:
    """What of span a is not in span b: at most two spans."""
    return [s for s in ((a[0], min(a[1], b[0])), (max(a[0], b[1]), a[1])) if s[0] < s[1]]


def span_intersection(a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int] | None:
    lo, hi = max(a[0], b[0]), min(a[1], b[1])
    return (lo, hi) if lo < hi else None
