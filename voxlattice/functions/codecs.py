"""Binary keys of cells and blocks.

A cell's key is 12 bytes: the bits of f (offset to be unsigned), x and y interleaved from the top, the zoom in the low
five bits. A parent's descendants lie between its key and ``prefix_max``, so regions are range scans on the key.
A block's key is 23 bytes: three 5-bit zooms, the indices in big-endian order, the time zoom and index.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxlattice.domain import MAX_ZOOM
from voxlattice.errors import IdError
from voxlattice.functions.ids import CELL, gather_thirds, shift_left, shift_right, side, spread_thirds

_FLEX = "struct<fz:int,fi:int,xz:int,xi:int,yz:int,yi:int,tz:int,ti:bigint>"
_LOW15, _LOW43, _LOW45 = (1 << 15) - 1, (1 << 43) - 1, (1 << 45) - 1


def _bits(z: int, f: int, x: int, y: int) -> tuple[int, int]:
    """(the interleaved bits, how many)."""
    v, up = (f + (1 << z)) >> z & 1, f + (1 << z)
    for i in reversed(range(z)):
        v = v << 3 | (up >> i & 1) << 2 | (x >> i & 1) << 1 | (y >> i & 1)
    return v, 3 * z + 1


def encode_cell(z: int, f: int, x: int, y: int) -> bytes:
    v, n = _bits(z, f, x, y)
    return (v << (96 - n) | z).to_bytes(12, "big")


def cell_prefix_max(z: int, f: int, x: int, y: int) -> bytes:
    v, n = _bits(z, f, x, y)
    free = 96 - n
    return (v << free | (((1 << (free - 5)) - 1) << 5 if free > 5 else 0)).to_bytes(12, "big")


def decode_cell(key: bytes) -> tuple[int, int, int, int]:
    v = int.from_bytes(key, "big")
    z = v & 31
    if z > MAX_ZOOM:
        raise IdError(f"zoom {z} in a key")
    f, x, y, at = v >> 95 & 1, 0, 0, 94
    for _ in range(z):
        f, x, y = f << 1 | (v >> at & 1), x << 1 | (v >> (at - 1) & 1), y << 1 | (v >> (at - 2) & 1)
        at -= 3
    return z, f - (1 << z), x, y


def encode_flex(fz: int, fi: int, xz: int, xi: int, yz: int, yi: int, tz: int = 0, ti: int = 0) -> bytes:
    head = (fz << 10 | xz << 5 | yz) << 1
    return b"".join((head.to_bytes(2, "big"), (fi + (1 << fz)).to_bytes(4, "big"), xi.to_bytes(4, "big"), yi.to_bytes(4, "big"), bytes([tz]), ti.to_bytes(8, "big")))


def decode_flex(key: bytes) -> tuple[int, ...]:
    head = int.from_bytes(key[:2], "big") >> 1
    fz, xz, yz = head >> 10 & 31, head >> 5 & 31, head & 31
    if max(fz, xz, yz) > MAX_ZOOM:
        raise IdError("zoom in a key")
    number = lambda a, b: int.from_bytes(key[a:b], "big")
    return fz, number(2, 6) - (1 << fz), xz, number(6, 10), yz, number(10, 14), key[14], number(15, 23)


# The same as Columns -----------------------------------------------------------------------------------------------------


def _hex(v: Column, digits: int) -> Column:
    return F.lpad(F.hex(v), digits, "0")


def _number(text: Column, first: int, digits: int) -> Column:
    """``digits`` hex digits from the (zero-based) ``first`` on, as long."""
    return F.conv(F.substring(text, first + 1, digits), 16, 10).cast("long")


def _interleaved(f: Column, x: Column, y: Column, low: Column) -> Column:
    """Key of indices at zoom 30 (f from zero on) over the ``low`` five bits: 1 + 90 + 5 bits in two halves of 48."""
    fifteen = lambda c, by: F.shiftright(c, by).bitwiseAND(F.lit(_LOW15))
    three = lambda by: F.shiftleft(spread_thirds(fifteen(f, by)), 2).bitwiseOR(F.shiftleft(spread_thirds(fifteen(x, by)), 1)).bitwiseOR(spread_thirds(fifteen(y, by)))
    deep = three(0)
    high = F.shiftleft(F.shiftleft(F.shiftright(f, 30), 45).bitwiseOR(three(15)), 2).bitwiseOR(F.shiftright(deep, 43))
    return F.unhex(F.concat(_hex(high, 12), _hex(F.shiftleft(deep.bitwiseAND(F.lit(_LOW43)), 5).bitwiseOR(low), 12)))


def _at_finest(z: Column, f: Column, x: Column, y: Column) -> list[Column]:
    up = F.lit(MAX_ZOOM) - z
    return [shift_left(f.cast("long") + side(z), up), shift_left(x.cast("long"), up), shift_left(y.cast("long"), up)]


def cell_key(z: Column, f: Column, x: Column, y: Column) -> Column:
    return _interleaved(*_at_finest(z, f, x, y), z.cast("long"))


def cell_key_max(z: Column, f: Column, x: Column, y: Column) -> Column:
    """The largest key that a descendant can have; no zoom in it."""
    rest = shift_left(F.lit(1).cast("long"), F.lit(MAX_ZOOM) - z) - 1
    return _interleaved(*[c.bitwiseOR(rest) for c in _at_finest(z, f, x, y)], F.lit(0).cast("long"))


def cell_of_key(key: Column) -> Column:
    """``struct<z, f, x, y>``, or an error for what is no key."""
    text = F.hex(key)
    high, low = _number(text, 0, 12), _number(text, 12, 12)
    z = low.bitwiseAND(F.lit(31))
    deep = F.shiftleft(high.bitwiseAND(F.lit(3)), 43).bitwiseOR(F.shiftright(low, 5))
    coarse = F.shiftright(high, 2).bitwiseAND(F.lit(_LOW45))
    down = F.lit(MAX_ZOOM) - F.least(z, F.lit(MAX_ZOOM))
    index = lambda by: F.shiftleft(gather_thirds(F.shiftright(coarse, by)), 15).bitwiseOR(gather_thirds(F.shiftright(deep, by)))
    f = F.shiftleft(F.shiftright(high, 47), 30).bitwiseOR(index(2))
    made = F.struct(z.cast("int").alias("z"), (shift_right(f, down) - side(z)).cast("int").alias("f"), shift_right(index(1), down).cast("int").alias("x"), shift_right(index(0), down).cast("int").alias("y"))
    return F.when((F.length(key) == 12) & (z <= MAX_ZOOM), made).otherwise(F.raise_error(F.lit("not the key of a cell")).cast(CELL))


def flex_key(fz: Column, fi: Column, xz: Column, xi: Column, yz: Column, yi: Column, tz: Column, ti: Column) -> Column:
    head = F.shiftleft(F.shiftleft(fz.cast("long"), 10).bitwiseOR(F.shiftleft(xz.cast("long"), 5)).bitwiseOR(yz.cast("long")), 1)
    return F.unhex(F.concat(_hex(head, 4), _hex(fi.cast("long") + side(fz), 8), _hex(xi, 8), _hex(yi, 8), _hex(tz, 2), _hex(ti, 16)))


def flex_of_key(key: Column) -> Column:
    """``struct<...FLEX>``, or an error for what is no key."""
    text = F.hex(key)
    zoom = lambda by: F.shiftright(_number(text, 0, 4), by).bitwiseAND(F.lit(31)).cast("int")
    fz, xz, yz = zoom(11), zoom(6), zoom(1)
    made = F.struct(
        fz.alias("fz"), (_number(text, 4, 8) - side(fz)).cast("int").alias("fi"), xz.alias("xz"), _number(text, 12, 8).cast("int").alias("xi"),
        yz.alias("yz"), _number(text, 20, 8).cast("int").alias("yi"), _number(text, 28, 2).cast("int").alias("tz"), _number(text, 30, 16).alias("ti"),
    )
    return F.when((F.length(key) == 23) & (F.greatest(fz, xz, yz) <= MAX_ZOOM), made).otherwise(F.raise_error(F.lit("not the key of a block")).cast(_FLEX))
