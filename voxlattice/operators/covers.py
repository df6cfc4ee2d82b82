"""Covers: a table of shapes to a table of voxels, one row to many.

A shape row is ``shape_id, kind, points array<struct<lat, lon, alt>>, radius`` (faces of a solid:
``faces array<array<struct>>``). Rows are dealt evenly over Python workers, which cover many small shapes at once and
large ones by themselves: what a worker holds is bounded by ``_HELD`` voxels or one shape. Points and spheres have native forms.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlattice.domain import EARTH_A
from voxlattice.errors import GeometryError
from voxlattice.frame import tasks_for
from voxlattice.functions import projection as P
from voxlattice.operators import shapes

_POINT = "struct<lat:double,lon:double,alt:double>"
SHAPES = f"shape_id long, kind string, points array<{_POINT}>, faces array<array<{_POINT}>>, radius double"
_BATCH = 100_000
#: Voxels and shapes that are covered at once.
_HELD, _TOGETHER = 500_000, 256
#: Edges of a solid that are expected.
_EDGES = 24


def _array(points) -> np.ndarray:
    return np.array([[p["lat"], p["lon"], p["alt"]] for p in points or ()], float).reshape(-1, 3)


def cover_one(kind: str, points: np.ndarray, faces: list[np.ndarray], radius: float | None, z: int, surface: bool = False) -> np.ndarray:
    if kind == "point":
        return np.unique(shapes.cells(points, z), axis=0)
    if kind == "line":
        return np.unique(shapes.line(points, z), axis=0)
    if kind == "triangle":
        return shapes.triangle(points, z)
    if kind == "polygon":
        return shapes.polygon(points, z)
    if kind == "sphere":
        return shapes.sphere(points[0], radius, z)
    if kind == "cylinder":
        return shapes.cylinder(points, radius, z)
    if kind == "tube":
        return shapes.tube(points, radius, z)
    if kind == "solid":
        return shapes.triangles_cover([t for f in faces for t in shapes.polygon_triangles(f)], z) if surface else shapes.solid(faces, z)
    raise GeometryError(f"no shape {kind}")


def _ragged(lists) -> tuple[np.ndarray, np.ndarray]:
    """(rows of lat, lon, alt, how many of each list) of an Arrow array of lists of points."""
    flat = lists.flatten()
    rows = [pc.struct_field(flat, c).to_numpy(zero_copy_only=False).astype(float) for c in ("lat", "lon", "alt")]
    return np.stack(rows, 1).reshape(-1, 3), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _reach(points: np.ndarray, lengths: np.ndarray, radius: np.ndarray, z: int) -> np.ndarray:
    """About how many voxels the box around each shape has: at most ``_HELD`` counts."""
    own = np.repeat(np.arange(len(lengths)), lengths)
    with np.errstate(all="ignore"):
        at = shapes.fractional(points, z)
        size = np.ones((len(lengths), 3))
        for k in range(3):
            low, high = np.full(len(lengths), np.inf), np.full(len(lengths), -np.inf)
            np.minimum.at(low, own, at[:, k])
            np.maximum.at(high, own, at[:, k])
            size[:, k] = high - low
        flat = np.full(len(lengths), 1.0)
        np.minimum.at(flat, own, np.cos(np.radians(points[:, 0])))
        wide = 2 * np.nan_to_num(radius)[:, None] * (1 << z) / np.stack([np.full(len(lengths), 2.0**25), *[2 * math.pi * EARTH_A * np.maximum(flat, 1e-6)] * 2], 1)
        n = (np.where(np.isfinite(size), size, 0) + wide + 3).prod(1)
    return np.minimum(n, _HELD).astype(np.int64)


def _solids(points: np.ndarray, corners: np.ndarray, owner: np.ndarray, n: int, z: int, surface: bool) -> np.ndarray:
    """(owner, f, x, y) of n solids, whose faces have ``corners`` (0 is none) of the points."""
    first = np.cumsum(corners) - corners
    if not surface:
        open_ = shapes.open_edges_of(points, corners[corners > 0], owner[corners > 0], n, 1e-6)
        bare = np.bincount(owner[corners > 0], minlength=n) == 0
        if open_.any() or bare.any():
            raise GeometryError(f"the solid is open at {0 if bare.any() else open_[open_ > 0][0]} edges")
    parts, whose = [], []
    for m in np.unique(corners):
        face = np.flatnonzero(corners == m)
        cut, of = shapes.polygons_triangles(points[first[face][:, None] + np.arange(m)])
        parts.append(cut)
        whose.append(owner[face][of])
    found = shapes.covers_of_triangles(np.concatenate(parts), np.concatenate(whose), z) if parts else np.zeros((0, 4), np.int64)
    return found if surface else shapes.filled(found)


def _cover_alike(kind: str, points: np.ndarray, lengths: np.ndarray, faces, radius: np.ndarray, z: int, surface: bool) -> np.ndarray:
    """(shape, f, x, y) of shapes of one kind, by their place."""
    own, first = np.arange(len(lengths)), np.cumsum(lengths) - lengths
    if kind == "solid":
        return _solids(*faces, len(lengths), z, surface)
    if kind == "tube" and (lengths > 0).all():
        return shapes.tubes(points, lengths, radius, z)
    if kind == "sphere" and (lengths > 0).all():
        return shapes.spheres(points[first], radius, own, z)
    if kind == "cylinder" and (lengths == 2).all():
        return shapes.cylinders(points.reshape(-1, 2, 3), radius, own, z)
    if kind in ("triangle", "polygon"):
        parts, whose = [np.zeros((0, 3, 3))], [np.zeros(0, np.int64)]
        for m in np.unique(lengths):
            same = np.flatnonzero(lengths == m)
            cut, of = shapes.polygons_triangles(points[first[same][:, None] + np.arange(m)])
            parts.append(cut)
            whose.append(same[of])
        return shapes.covers_of_triangles(np.concatenate(parts), np.concatenate(whose), z)
    each = [cover_one(kind, points[a : a + n], [], r, z, surface) for a, n, r in zip(first, lengths, radius, strict=True)]
    return np.concatenate([np.zeros((0, 4), np.int64), *(np.column_stack([np.full(len(v), k), v]) for k, v in enumerate(each))])


def cover_batch(batch: pa.RecordBatch, z: int, surface: bool = False):
    """Pairs of ``shape_id``s and (shape, f, x, y), the shape as its place among them; a shape's voxels are in one pair."""
    for kind in pc.unique(batch["kind"]).to_pylist():
        rows = batch.filter(pc.equal(batch["kind"], kind)) if kind is not None else batch.filter(pc.is_null(batch["kind"]))
        if kind == "solid":
            rings = rows["faces"].flatten()
            corners, n = _ragged(rings)
            of = np.repeat(np.arange(len(rows)), pc.fill_null(pc.list_value_length(rows["faces"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            lengths = np.bincount(of, n, len(rows)).astype(np.int64)
        else:
            corners, lengths = _ragged(rows["points"])
        radius = rows["radius"].to_numpy(zero_copy_only=False).astype(float)
        weight = np.maximum(_reach(corners, lengths, radius, z), _HELD // _TOGETHER)
        shape_ids, ends = rows["shape_id"].to_numpy(zero_copy_only=False), np.append(0, np.cumsum(lengths))
        for run in shapes._runs_of(weight, _HELD):
            faces = None
            if kind == "solid":
                mine = (of >= run.start) & (of < run.stop)
                faces = corners[ends[run.start] : ends[run.stop]], n[mine], of[mine] - run.start
            yield shape_ids[run], _cover_alike(kind, corners[ends[run.start] : ends[run.stop]], lengths[run], faces, radius[run], z, surface)


def cover(table: DataFrame, z: int, surface: bool = False) -> DataFrame:
    """``shape_id, z, f, x, y``, each voxel of a shape once."""

    def run(batches):
        for batch in batches:
            for shape_ids, v in cover_batch(batch, z, surface):
                for a in range(0, len(v), _BATCH):
                    part = v[a : a + _BATCH]
                    yield _rows(shape_ids[part[:, 0]], z, part[:, 1:], ["f", "x", "y"])

    return _dealt(table).mapInArrow(run, "shape_id long, z int, f int, x int, y int")


def _dealt(table: DataFrame) -> DataFrame:
    """Shapes are small and their covers are not: they are spread over all cores before they grow.

    The number of partitions is given, as AQE would put such small rows back into one.
    """
    return table.select("shape_id", "kind", "points", "faces", "radius").repartition(_deals(table), "shape_id")


def _deals(table: DataFrame) -> int:
    return 4 * table.sparkSession.sparkContext.defaultParallelism


def _rows(shape_ids: np.ndarray, z: int, v: np.ndarray, names: list[str]) -> pa.RecordBatch:
    columns = [pa.array(shape_ids, pa.int64()), pa.array(np.full(len(v), z, np.int32)), *(pa.array(v[:, k].astype(np.int32)) for k in range(len(names)))]
    return pa.record_batch(columns, names=["shape_id", "z", *names])


def cover_ranges(table: DataFrame, z: int) -> DataFrame:
    """``shape_id, z, f0, f1, x, y``: a shape's voxels as runs along f."""

    def run(batches):
        for batch in batches:
            for shape_ids, v in cover_batch(batch, z):
                runs = shapes.voxel_runs(v[:, 1:], v[:, 0])
                for a in range(0, len(runs), _BATCH):
                    part = runs[a : a + _BATCH]
                    yield _rows(shape_ids[part[:, 0]], z, part[:, 1:], ["f0", "f1", "x", "y"])

    return _dealt(table).mapInArrow(run, "shape_id long, z int, f0 int, f1 int, x int, y int")


def cover_points(table: DataFrame, z: int) -> DataFrame:
    """Adds ``z, f, x, y`` to a table with lat, lon, alt: Column arithmetic only."""
    at = P.cell_of(F.col("lat"), F.col("lon"), F.col("alt"), z)
    return table.withColumn("cell", at).select(*table.columns, "cell.*")


def cover_ecef_points(table: DataFrame, z: int) -> DataFrame:
    """Adds ``z, f, x, y`` to a table with earth-centred ``ex, ey, ez``."""
    at = P.from_ecef(F.col("ex"), F.col("ey"), F.col("ez"))
    found = table.withColumn("at", at)
    found = found.withColumn("cell", P.cell_of(F.col("at.lat"), F.col("at.lon"), F.col("at.alt"), z))
    return found.select(*table.columns, "cell.*")


def expand_polygons(table: DataFrame) -> DataFrame:
    """``shape_id, part, ring``: the faces of a solid, or a shape's own corners as its only ring."""
    rings = F.when(F.size("faces") > 0, F.col("faces")).otherwise(F.array("points"))
    return table.select("shape_id", F.posexplode(rings).alias("part", "ring"))


def expand_coordinates(table: DataFrame) -> DataFrame:
    """``shape_id, part, lat, lon, alt``: corners in order, those of a solid face by face."""
    corners = F.when(F.size("faces") > 0, F.flatten("faces")).otherwise(F.col("points"))
    return table.select("shape_id", F.posexplode(corners).alias("part", "c")).select("shape_id", "part", "c.*")


def expand_lines(table: DataFrame) -> DataFrame:
    """``shape_id, part, a, b``: sides of closed shapes, links of lines and tubes."""
    open_kind = F.col("kind").isin("line", "tube", "cylinder")
    rings = expand_polygons(table.where(~open_kind)).select("shape_id", "ring", F.size("ring").alias("n"))
    chains = table.where(open_kind).select("shape_id", F.col("points").alias("ring"), (F.size("points") - 1).alias("n"))
    side = lambda k: F.struct(F.get("ring", k).alias("a"), F.get("ring", (k + 1) % F.size("ring")).alias("b"))
    every = rings.unionByName(chains).where("n > 0").groupBy("shape_id").agg(F.flatten(F.collect_list(F.transform(F.sequence(F.lit(0), F.col("n") - 1), side))).alias("s"))
    return every.select("shape_id", F.posexplode("s").alias("part", "s")).select("shape_id", "part", "s.a", "s.b")


def cover_spheres(table: DataFrame, z: int) -> DataFrame:
    """``shape_id, z, f, x, y`` of a table ``shape_id, lat, lon, alt, radius``: candidate box, then distance; native."""
    dealt = table.select("shape_id", "lat", "lon", "alt", "radius").repartition(_deals(table), "shape_id")
    e = dealt.withColumn("e", P.ecef(F.col("lat"), F.col("lon"), F.col("alt")))
    corners = F.array(*[
        P.from_ecef(F.col("e.x") + a * F.col("radius"), F.col("e.y") + b * F.col("radius"), F.col("e.z") + c * F.col("radius"))
        for a in (1, -1) for b in (1, -1) for c in (1, -1)
    ])
    e = e.withColumn("at", F.transform(corners, lambda c: P.cell_of(c["lat"], c["lon"], c["alt"], z)))
    for k in "fxy":
        ends = F.col(f"at.{k}")
        e = e.withColumn(k, F.explode(F.sequence(F.array_min(ends), F.array_max(ends))))
    c = P.center(F.lit(z), F.col("f"), F.col("x"), F.col("y"))
    far = P.distance(P.ecef(c["lat"], c["lon"], c["alt"]), F.col("e"))
    reach = F.col("radius") + 2 * math.pi * EARTH_A / (1 << z) * math.sqrt(3) / 2
    return e.where(far <= reach).select("shape_id", F.lit(z).alias("z"), "f", "x", "y")


def open_edges(table: DataFrame, epsilon: float) -> DataFrame:
    """``shape_id, open_edges`` of solids: edges that occur an odd number of times, counted by aggregation."""
    # All edges of a shape are dealt with it, before they grow: what follows needs no other exchange.
    owners = table.select("shape_id", "faces").repartition(max(_deals(table), tasks_for(table, _EDGES) or 0), "shape_id")
    faces = owners.select("shape_id", F.posexplode("faces").alias("face", "ring"))
    n = F.size("ring")
    edge = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.get("ring", k).alias("a"), F.get("ring", (k + 1) % n).alias("b")))
    edges = faces.where(n >= 3).select("shape_id", F.explode(edge).alias("e"))

    def grid(p):
        e = P.ecef(p["lat"], p["lon"], p["alt"])
        return F.struct(*[F.round(e[k] / epsilon).cast("long").alias(k) for k in "xyz"])

    edges = edges.select("shape_id", grid(F.col("e.a")).alias("a"), grid(F.col("e.b")).alias("b")).where("a <> b")
    odd = edges.groupBy("shape_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return odd.groupBy("shape_id").agg(F.sum(F.col("n") % 2).alias("open_edges"))


def expand_triangles(table: DataFrame) -> DataFrame:
    """``shape_id, part, corners``: polygons and solids cut into triangles."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                rings = [_array(f) for f in r["faces"] or ()] or [_array(r["points"])]
                parts = [t for ring in rings for t in shapes.polygon_triangles(ring)]
                corners = [[{"lat": a, "lon": b, "alt": c} for a, b, c in t.tolist()] for t in parts]
                kind = pa.list_(pa.struct([("lat", pa.float64()), ("lon", pa.float64()), ("alt", pa.float64())]))
                yield pa.record_batch(
                    [pa.array([r["shape_id"]] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array(corners, kind)],
                    names=["shape_id", "part", "corners"],
                )

    return table.select("shape_id", "points", "faces").mapInArrow(run, f"shape_id long, part int, corners array<{_POINT}>")
