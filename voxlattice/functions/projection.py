"""Coordinates: Web Mercator cells, earth-centred positions, distances. Native Column arithmetic throughout.

A coordinate is ``struct<lat, lon, alt>`` in degrees and metres, an earth-centred position ``struct<x, y, z>``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxlattice.domain import EARTH_A, EARTH_E2, MAX_ALTITUDE
from voxlattice.functions.ids import cell


def coordinate(lat: Column, lon: Column, alt: Column) -> Column:
    return F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon"), alt.cast("double").alias("alt"))


def fractional(lat: Column, lon: Column, alt: Column, z: int) -> Column:
    """``struct<f, x, y>`` as real indices at zoom z."""
    n = float(1 << z)
    r = F.radians(lat)
    return F.struct(
        (alt * F.lit(n / MAX_ALTITUDE)).alias("f"),
        ((lon + 180.0) / 360.0 * n).alias("x"),
        ((1.0 - F.log(F.tan(r) + 1.0 / F.cos(r)) / math.pi) / 2.0 * n).alias("y"),
    )


def cell_of(lat: Column, lon: Column, alt: Column, z: int) -> Column:
    """The cell of a coordinate; upper edges belong to the last cell."""
    at, n = fractional(lat, lon, alt, z), 1 << z
    clamp = lambda c, low: F.least(F.greatest(F.floor(c), F.lit(low)), F.lit(n - 1))
    return cell(F.lit(z), clamp(at["f"], -n), clamp(at["x"], 0), clamp(at["y"], 0))


def longitude(x: Column, z: Column) -> Column:
    return F.lit(360.0) * (x / F.pow(F.lit(2.0), z)) - 180.0


def latitude(y: Column, z: Column) -> Column:
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (F.lit(1.0) - F.lit(2.0) * (y / F.pow(F.lit(2.0), z))))))


def altitude(f: Column, z: Column) -> Column:
    return F.lit(MAX_ALTITUDE) * (f / F.pow(F.lit(2.0), z))


def center(z: Column, f: Column, x: Column, y: Column) -> Column:
    return coordinate(latitude(y + 0.5, z), longitude(x + 0.5, z), altitude(f + 0.5, z))


def vertices(z: Column, f: Column, x: Column, y: Column) -> Column:
    """The 8 corners, altitude slowest and longitude fastest."""
    return F.array(*[coordinate(latitude(y + b, z), longitude(x + c, z), altitude(f + a, z)) for a in (0, 1) for b in (0, 1) for c in (0, 1)])


def ecef(lat: Column, lon: Column, alt: Column) -> Column:
    p, q = F.radians(lat), F.radians(lon)
    s, c = F.sin(p), F.cos(p)
    n = F.lit(EARTH_A) / F.sqrt(F.lit(1.0) - F.lit(EARTH_E2) * s * s)
    return F.struct(((n + alt) * c * F.cos(q)).alias("x"), ((n + alt) * c * F.sin(q)).alias("y"), ((n * (1.0 - EARTH_E2) + alt) * s).alias("z"))


def from_ecef(x: Column, y: Column, z: Column) -> Column:
    """Ten unrolled fixed-point steps for the latitude."""
    p = F.sqrt(x * x + y * y)
    step = lambda lat, _: F.atan2(z + F.lit(EARTH_E2) * (F.lit(EARTH_A) / F.sqrt(F.lit(1.0) - F.lit(EARTH_E2) * F.sin(lat) * F.sin(lat))) * F.sin(lat), p)
    lat = F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.atan2(z, p * (1.0 - EARTH_E2)), step)
    n = F.lit(EARTH_A) / F.sqrt(F.lit(1.0) - F.lit(EARTH_E2) * F.sin(lat) * F.sin(lat))
    return coordinate(F.degrees(lat), F.degrees(F.atan2(y, x)), p / F.cos(lat) - n)


def distance(a: Column, b: Column) -> Column:
    """Metres between two earth-centred positions."""
    d = [a[k] - b[k] for k in "xyz"]
    return F.sqrt(sum((v * v for v in d[1:]), d[0] * d[0]))


def near(a: Column, b: Column, epsilon: float) -> Column:
    """Whether two earth-centred positions are less than ``epsilon`` metres apart."""
    return distance(a, b) < epsilon


def minus(a: Column, b: Column) -> Column:
    return F.struct(*[(a[k] - b[k]).alias(k) for k in "xyz"])


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def norm_squared(a: Column) -> Column:
    return dot(a, a)


def cross(a: Column, b: Column) -> Column:
    turn = (("x", "y", "z"), ("y", "z", "x"), ("z", "x", "y"))
    return F.struct(*[(a[p] * b[q] - a[q] * b[p]).alias(k) for k, p, q in turn])


def project_2d(a: Column, u: str, v: str) -> Column:
    """Two of the three components."""
    return F.struct(a[u].alias("u"), a[v].alias("v"))


def scaled(a: Column, by: Column | float) -> Column:
    return F.struct(*[(a[k] * by).alias(k) for k in "xyz"])


def norm(a: Column) -> Column:
    return F.sqrt(norm_squared(a))


def normalized(a: Column) -> Column:
    """The vector of length one; null for the zero vector."""
    return F.when(norm_squared(a) > 0, scaled(a, F.lit(1.0) / norm(a)))


def orthonormal_basis(a: Column) -> Column:
    """``struct<u, v>``: two unit vectors that span the plane across ``a``; the x and y axes where it is upright or zero."""
    axis = lambda *v: F.struct(*[F.lit(float(c)).alias(k) for k, c in zip("xyz", v, strict=True)])
    level = F.struct((-a["y"]).alias("x"), a["x"].alias("y"), F.lit(0.0).alias("z"))
    upright = (a["x"] == 0) & (a["y"] == 0)
    pick = lambda other, made: F.when(upright, other).otherwise(normalized(made))
    return F.struct(pick(axis(1, 0, 0), level).alias("u"), pick(axis(0, 1, 0), cross(a, level)).alias("v"))


def triangle_sides(a: Column, b: Column, c: Column) -> Column:
    """Metres from the first corner to the second, on to the third, and back."""
    return F.array(distance(a, b), distance(b, c), distance(c, a))


def triangle_parts(a: Column, b: Column, c: Column, steps: int) -> Column:
    """``array<array<position>>``: the triangle cut into ``steps ** 2`` equal ones, row by row from the first corner."""
    along, across = scaled(minus(b, a), 1 / steps), scaled(minus(c, b), 1 / steps)
    at = lambda i, j: F.struct(*[(a[k] + along[k] * i + across[k] * j).alias(k) for k in "xyz"])
    rows = [
        part
        for i in range(steps)
        for j in range(i + 1)
        for part in ([(i, j), (i + 1, j), (i + 1, j + 1)], *([[(i, j - 1), (i, j), (i + 1, j)]] if j else []))
    ]
    return F.array(*[F.array(*[at(i, j) for i, j in part]) for part in rows])


def triangle_area(a: Column, b: Column, c: Column) -> Column:
    """Square metres of the triangle of three earth-centred positions."""
    return F.sqrt(norm_squared(cross(minus(b, a), minus(c, a)))) / 2


def length_f(z: Column) -> Column:
    return F.pow(F.lit(2.0), F.lit(25) - z)


def length_xy(z: Column, f: Column, x: Column, y: Column) -> Column:
    """Metres of a cell's side along x and y: the circle of latitude through its centre, divided."""
    c = center(z, f, x, y)
    e = ecef(c["lat"], c["lon"], c["alt"])
    return F.sqrt(e["x"] * e["x"] + e["y"] * e["y"]) * 2.0 * math.pi / F.pow(F.lit(2.0), z)


def center_of_gravity(lat: Column, lon: Column, alt: Column) -> Column:
    """Aggregate: the mean; zero for no point."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return F.struct(mean(lat).alias("lat"), mean(lon).alias("lon"), mean(alt).alias("alt"))
