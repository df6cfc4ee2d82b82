"""Identifiers of single cells, as Column functions over columns z, f, x, y (and i, t).

A cell is ``struct<z, f, x, y>``. Equality of identifiers is that of their fields, not of the region they name.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxlattice.domain import MAX_ZOOM, WHOLE

CELL = "struct<z:int,f:int,x:int,y:int>"
_SINGLE = r"^(\d+)/(-?\d+)/(\d+)/(\d+)(?:_(\d+)/(\d+))?$"
_RANGE = r"^(\d+)/(-?\d+)(?::(-?\d+))?/(\d+)(?::(\d+))?/(\d+)(?::(\d+))?(?:_(\d+)/(\d+)(?::(\d+))?)?$"
_FLEX = r"^(\d+)/(-?\d+)\|(\d+)/(\d+)\|(\d+)/(\d+)(?:\|(\d+)/(\d+))?$"


def shift_left(value: Column, bits: Column) -> Column:
    """Shift by a column's number of bits."""
    return F.call_function("shiftleft", value, bits.cast("int"))


def shift_right(value: Column, bits: Column) -> Column:
    return F.call_function("shiftright", value, bits.cast("int"))


def side(z: Column) -> Column:
    """2**z, as long."""
    return shift_left(F.lit(1).cast("long"), z)


def cell(z: Column, f: Column, x: Column, y: Column) -> Column:
    return F.struct(z.cast("int").alias("z"), f.cast("int").alias("f"), x.cast("int").alias("x"), y.cast("int").alias("y"))


def is_valid(z: Column, f: Column, x: Column, y: Column) -> Column:
    n = side(z)
    return z.between(0, MAX_ZOOM) & (f >= -n) & (f < n) & (x >= 0) & (x < n) & (y >= 0) & (y < n)


def checked(z: Column, f: Column, x: Column, y: Column) -> Column:
    """The cell, or an error at run time where it is out of range."""
    return F.when(is_valid(z, f, x, y), cell(z, f, x, y)).otherwise(
        F.raise_error(F.concat_ws("/", F.lit("not a cell: "), z, f, x, y)).cast(CELL)
    )


def range_checked(z, f0, f1, x0, x1, y0, y1) -> Column:
    """A range; f and y are put in order, x keeps its order (first > last wraps around)."""
    n = side(z)
    ok = z.between(0, MAX_ZOOM) & (F.least(f0, f1) >= -n) & (F.greatest(f0, f1) < n) & (F.least(x0, x1, y0, y1) >= 0) & (F.greatest(x0, x1, y0, y1) < n)
    made = F.struct(z.alias("z"), F.least(f0, f1).alias("f0"), F.greatest(f0, f1).alias("f1"), x0.alias("x0"), x1.alias("x1"), F.least(y0, y1).alias("y0"), F.greatest(y0, y1).alias("y1"))
    return F.when(ok, made).otherwise(F.raise_error(F.lit("range out of bounds")).cast("struct<z:int,f0:int,f1:int,x0:int,x1:int,y0:int,y1:int>"))


# Text ----------------------------------------------------------------------------------------------------------------


def single_text(z: Column, f: Column, x: Column, y: Column, i: Column | None = None, t: Column | None = None) -> Column:
    """``z/f/x/y``, with ``_i/t`` unless the time is whole."""
    space = F.concat_ws("/", z, f, x, y)
    return space if i is None else F.when(i == WHOLE, space).otherwise(F.concat(space, F.lit("_"), i, F.lit("/"), t))


def _dim(a: Column, b: Column) -> Column:
    return F.when(a == b, a.cast("string")).otherwise(F.concat_ws(":", a, b))


def range_text(z, f0, f1, x0, x1, y0, y1, i: Column | None = None, t0: Column | None = None, t1: Column | None = None) -> Column:
    space = F.concat_ws("/", z, _dim(f0, f1), _dim(x0, x1), _dim(y0, y1))
    return space if i is None else F.when(i == WHOLE, space).otherwise(F.concat(space, F.lit("_"), i, F.lit("/"), _dim(t0, t1)))


def flex_text(fz, fi, xz, xi, yz, yi, tz: Column | None = None, ti: Column | None = None) -> Column:
    pair = lambda z, i: F.concat_ws("/", z, i)
    space = F.concat_ws("|", pair(fz, fi), pair(xz, xi), pair(yz, yi))
    return space if tz is None else F.when(tz == 0, space).otherwise(F.concat_ws("|", space, pair(tz, ti)))


def _group(text: Column, pattern: str, k: int, kind: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).try_cast(kind)


def parse_single(text: Column) -> Column:
    """``struct<z,f,x,y,i,t>``; null where the text is not a valid cell."""
    z, f, x, y = (_group(text, _SINGLE, k, "int") for k in (1, 2, 3, 4))
    i, t = F.coalesce(_group(text, _SINGLE, 5, "long"), F.lit(WHOLE)), F.coalesce(_group(text, _SINGLE, 6, "long"), F.lit(0).cast("long"))
    ok = text.rlike(_SINGLE) & is_valid(z, f, x, y) & i.between(1, WHOLE) & ((t + 1) <= F.floor(F.lit(WHOLE) / i))
    return F.when(ok, F.struct(z.alias("z"), f.alias("f"), x.alias("x"), y.alias("y"), i.alias("i"), t.alias("t")))


def parse_range(text: Column) -> Column:
    """``struct<z,f0,f1,x0,x1,y0,y1,i,t0,t1>``; null where the text is not a valid range."""
    g = lambda k, kind="int": _group(text, _RANGE, k, kind)
    z, f0, x0, y0 = g(1), g(2), g(4), g(6)
    f1, x1, y1 = F.coalesce(g(3), f0), F.coalesce(g(5), x0), F.coalesce(g(7), y0)
    i, t0 = F.coalesce(g(8, "long"), F.lit(WHOLE)), F.coalesce(g(9, "long"), F.lit(0).cast("long"))
    t1 = F.coalesce(g(10, "long"), t0)
    ok = text.rlike(_RANGE) & is_valid(z, f0, x0, y0) & is_valid(z, f1, x1, y1) & i.between(1, WHOLE) & ((F.greatest(t0, t1) + 1) <= F.floor(F.lit(WHOLE) / i))
    pick = F.struct(
        z.alias("z"), F.least(f0, f1).alias("f0"), F.greatest(f0, f1).alias("f1"), x0.alias("x0"), x1.alias("x1"), F.least(y0, y1).alias("y0"),
        F.greatest(y0, y1).alias("y1"), i.alias("i"), F.least(t0, t1).alias("t0"), F.greatest(t0, t1).alias("t1"),
    )
    return F.when(ok, pick)


def parse_flex(text: Column) -> Column:
    """``struct<fz,fi,xz,xi,yz,yi,tz,ti>``; null where the text is not a valid block."""
    names = ("fz", "fi", "xz", "xi", "yz", "yi")
    v = {n: _group(text, _FLEX, k + 1, "int") for k, n in enumerate(names)}
    tz, ti = F.coalesce(_group(text, _FLEX, 7, "int"), F.lit(0)), F.coalesce(_group(text, _FLEX, 8, "long"), F.lit(0).cast("long"))
    zero = F.lit(0)
    ok = text.rlike(_FLEX) & is_valid(v["fz"], v["fi"], zero, zero) & is_valid(v["xz"], zero, v["xi"], zero) & is_valid(v["yz"], zero, zero, v["yi"]) & tz.between(0, 35) & (ti < side(tz))
    return F.when(ok, F.struct(*[v[n].alias(n) for n in names], tz.alias("tz"), ti.alias("ti")))


# Family --------------------------------------------------------------------------------------------------------------


def parent(z: Column, f: Column, x: Column, y: Column, to: Column | int) -> Column:
    """The ancestor at zoom ``to``; arithmetic shift, so f = -1 stays -1. Null where ``to`` is deeper than z."""
    to = F.lit(to) if isinstance(to, int) else to
    d = z - to
    up = cell(to, shift_right(f, d), shift_right(x, d), shift_right(y, d))
    return F.when((d >= 0) & (to >= 0), up)


def parents(z: Column, f: Column, x: Column, y: Column) -> Column:
    """Ancestors from z - 1 to 0."""
    up = F.transform(F.sequence(z - 1, F.lit(0), F.lit(-1)), lambda k: cell(k, shift_right(f, z - k), shift_right(x, z - k), shift_right(y, z - k)))
    return F.when(z > 0, up).otherwise(F.array().cast(f"array<{CELL}>"))


def children(z: Column, f: Column, x: Column, y: Column, to: Column | int) -> Column:
    """The 8**(to - z) descendants at zoom ``to`` in f, x, y order."""
    to = F.lit(to) if isinstance(to, int) else to
    n = side(to - z)
    every = F.sequence(F.lit(0).cast("long"), n * n * n - 1)
    at = lambda k: cell(to, f * n + (k / (n * n)).cast("long"), x * n + ((k / n).cast("long") % n), y * n + k % n)
    return F.when(to >= z, F.transform(every, at))


def siblings(z: Column, f: Column, x: Column, y: Column) -> Column:
    """The 7 other cells of the same parent; null at zoom 0."""
    own = cell(z, f, x, y)
    up = parent(z, f, x, y, z - 1)
    return F.when(z > 0, F.filter(children(up["z"], up["f"], up["x"], up["y"], z), lambda c: c != own))


NEIGHBOURS = {"face": (1,), "edge": (2,), "vertex": (3,), "all": (1, 2, 3)}


def offsets(kind: str) -> list[tuple[int, int, int]]:
    axis = (-1, 0, 1)
    return [(a, b, c) for a in axis for b in axis for c in axis if abs(a) + abs(b) + abs(c) in NEIGHBOURS[kind]]


def neighbours(z: Column, f: Column, x: Column, y: Column, kind: str = "all") -> Column:
    """Neighbours by face (6), edge (12), vertex (8) or all (26); x wraps, cells beyond f or y are left out."""
    n = side(z)
    every = F.array(*[cell(z, f + a, F.pmod(x + b, n), y + c) for a, b, c in offsets(kind)])
    return F.filter(every, lambda c: (c["f"] >= -n) & (c["f"] < n) & (c["y"] >= 0) & (c["y"] < n))


def moved(axis: str, z: Column, index: Column, by: Column | int) -> Column:
    """The index moved along its axis; x wraps, f and y raise an error when they leave it."""
    n, to = side(z), index + (F.lit(by) if isinstance(by, int) else by)
    if axis == "x":
        return F.pmod(to, n).cast("int")
    low = -n if axis == "f" else F.lit(0).cast("long")
    return F.when((to >= low) & (to < n), to.cast("int")).otherwise(F.raise_error(F.lit(f"{axis} leaves its range")).cast("int"))


#: Every third bit, from the lowest on.
_THIRDS = 0x1249249249249249


def spread_thirds(c: Column) -> Column:
    """Bit k of the low 21 at place 3k: binary digits read as octal ones, so ``c`` occurs once in the expression."""
    return F.conv(F.bin(c.bitwiseAND(F.lit(0x1FFFFF))), 8, 10).cast("long")


def gather_thirds(c: Column) -> Column:
    """Bit 3k at place k: the inverse of ``spread_thirds``; other bits are ignored."""
    return F.conv(F.conv(c.bitwiseAND(F.lit(_THIRDS)).cast("string"), 10, 8), 2, 10).cast("long")


def morton(z: Column, f: Column, x: Column, y: Column, bits: int = 20) -> Column:
    """A 63-bit Z-order key of the top ``bits`` bits of f, x and y: for range partitioning and clustered files."""
    top = lambda c, extra: shift_right(shift_left(c.cast("long"), F.greatest(F.lit(bits) - z - extra, F.lit(0))), F.greatest(z + extra - bits, F.lit(0)))
    above = f.cast("long") + side(z)  # one bit more than x and y
    return F.shiftleft(spread_thirds(top(above, 1)), 2).bitwiseOR(F.shiftleft(spread_thirds(top(x, 0)), 1)).bitwiseOR(spread_thirds(top(y, 0)))


# Time of a cell ------------------------------------------------------------------------------------------------------


def with_time(i: Column | int, t: Column) -> Column:
    """``struct<i, t>``, or an error where the interval or the index does not exist."""
    i = F.lit(i).cast("long") if isinstance(i, int) else i.cast("long")
    ok = i.between(1, WHOLE) & (t >= 0) & ((t + 1) * i <= WHOLE)
    made = F.struct(i.alias("i"), t.cast("long").alias("t"))
    return F.when(ok, made).otherwise(F.raise_error(F.lit("time out of range")).cast("struct<i:bigint,t:bigint>"))


def with_time_at(i: int, unix: Column) -> Column:
    return with_time(i, F.floor(unix / i))


def without_time() -> Column:
    return F.struct(F.lit(WHOLE).alias("i"), F.lit(0).cast("long").alias("t"))


def relabel_time(i: Column, t: Column, to: Column | int) -> Column:
    """The same seconds as one index of another interval, or an error where there is none."""
    to = F.lit(to).cast("long") if isinstance(to, int) else to
    made = F.struct(to.alias("i"), (t * i / to).cast("long").alias("t"))
    return F.when((i == to) & (t * i % to == 0), made).otherwise(F.raise_error(F.lit("the span is not one interval of that length")).cast("struct<i:bigint,t:bigint>"))


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two non-negative whole numbers below 2**35: Euclid takes at most 52 steps."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.greatest(s["b"], F.lit(1))).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(52)), start, step)["a"]


def range_time_span(t0: Column, t1: Column) -> Column:
    """``struct<i, t0, t1>``: the half-open seconds as closed indices of the largest interval that divides both ends."""
    i = gcd(t0, t1 - t0)
    ok = (t0 >= 0) & (t1 > t0) & (t1 <= WHOLE)
    made = F.struct(i.alias("i"), (t0 / i).cast("long").alias("t0"), (t1 / i - 1).cast("long").alias("t1"))
    return F.when(ok, made).otherwise(F.raise_error(F.lit("time out of range")).cast("struct<i:bigint,t0:bigint,t1:bigint>"))


def with_time_span(t0: Column, t1: Column) -> Column:
    """``struct<i, t>`` of half-open seconds that are exactly one interval, or an error."""
    span = range_time_span(t0, t1)
    made = F.struct(span["i"].alias("i"), span["t0"].alias("t"))
    return F.when(span["t0"] == span["t1"], made).otherwise(F.raise_error(F.lit("the span is not one interval")).cast("struct<i:bigint,t:bigint>"))


def checked_index(axis: str, z: Column, index: Column) -> Column:
    """The index, or an error where the axis has no such index at that zoom."""
    n = side(z)
    low = -n if axis == "f" else F.lit(0).cast("long")
    return F.when((index >= low) & (index < n), index.cast("int")).otherwise(F.raise_error(F.lit(f"{axis} out of range")).cast("int"))


# Ranges of one axis, as Columns: closed indices lo..hi at zoom z --------------------------------------------------------


def fine_range_column(lo: Column, hi: Column, z: Column, to: Column | int) -> Column:
    """``struct<lo, hi>`` at a finer zoom; null where ``to`` is coarser."""
    d = (F.lit(to) if isinstance(to, int) else to) - z
    up = F.greatest(d, F.lit(0))
    return F.when(d >= 0, F.struct(shift_left(lo.cast("long"), up).alias("lo"), (shift_left(hi.cast("long") + 1, up) - 1).alias("hi")))


def edges_shift_column(axis: str, lo: Column, hi: Column, z: Column, down: int, up: int, to: Column | int) -> Column:
    """``struct<lo, hi>``: widened by ``down`` and ``up`` cells, then coarsened to zoom ``to``.

    x wraps and becomes the full axis when it meets itself; f and y are clamped.
    """
    to = F.lit(to) if isinstance(to, int) else to
    a, b, n, d = lo.cast("long") - down, hi.cast("long") + up, side(z), z - to
    pair = lambda p, q: F.struct(p.alias("lo"), q.alias("hi"))
    if axis == "x":
        width = F.pmod(hi.cast("long") - lo, n) + 1 + down + up
        return F.when(width >= n, pair(F.lit(0).cast("long"), side(to) - 1)).otherwise(pair(shift_right(F.pmod(a, n), d), shift_right(F.pmod(b, n), d)))
    low = -n if axis == "f" else F.lit(0).cast("long")
    return pair(shift_right(F.greatest(a, low), d), shift_right(F.least(b, n - 1), d))


def stretch_column(axis: str, z: Column, index: Column, by: int) -> Column:
    """``array<bigint>``: indices of a cell grown by ``by`` cells to one side; x wraps, f and y end at their limits."""
    i, n = index.cast("long"), side(z)
    run = F.sequence(i, i + by) if by >= 0 else F.sequence(i + by, i)
    if axis == "x":
        return F.array_distinct(F.transform(run, lambda k: F.pmod(k, n)))
    low = -n if axis == "f" else F.lit(0).cast("long")
    return F.filter(run, lambda k: (k >= low) & (k < n))


# Range and block arithmetic, for bounds that the driver plans with ----------------------------------------------------


def fine_range(lo: int, hi: int, z: int, to: int) -> tuple[int, int]:
    """A closed index range at a finer zoom."""
    return lo << (to - z), ((hi + 1) << (to - z)) - 1


def edges_shift(axis: str, lo: int, hi: int, z: int, down: int, up: int, to: int) -> tuple[int, int]:
    """Widen a closed range by ``down`` and ``up`` cells, then coarsen it to zoom ``to``.

    x wraps and becomes the full axis when it meets itself; f and y are clamped.
    """
    a, b, n = lo - down, hi + up, 1 << z
    d = z - to
    if axis == "x":
        width = (hi - lo) % n + 1 + down + up
        if width >= n:
            return 0, (1 << to) - 1
        return ((a % n) >> d), ((b % n) >> d)
    low, high = (-n, n - 1) if axis == "f" else (0, n - 1)
    return max(a, low) >> d, min(b, high) >> d


def stretch(axis: str, zoom: int, index: int, by: int) -> list[int]:
    """Indices of a cell grown by ``by`` cells to one side (negative: to the lower side)."""
    low, high = (-(1 << zoom), (1 << zoom) - 1) if axis == "f" else (0, (1 << zoom) - 1)
    run: Iterable[int] = range(index, index + by + 1) if by >= 0 else range(index + by, index + 1)
    if axis == "x":
        return list(dict.fromkeys(k % (high + 1) for k in run))
    return [k for k in run if low <= k <= high]


def halves(zoom: int, index: int) -> tuple[tuple[int, int], tuple[int, int]]:
    """Lower and upper child of a block along one axis."""
    return (zoom + 1, 2 * index), (zoom + 1, 2 * index + 1)
