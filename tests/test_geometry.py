import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlattice.errors import GeometryError
from voxlattice.functions import projection as P
from voxlattice.operators import covers, shapes
from voxlattice.queries import solid_table


def at(*p):
    return np.array(p, float)


def test_earth_centred_positions(spark):
    want = {(35.681382, 139.766084, 10): (-3959603.80135368, 3350144.3678688137, 3699539.029081585), (43.068564, 41.3507138, 30): (3503254.6369501497, 3083182.6924748584, 4333089.862951963)}
    for c, e in want.items():
        assert np.allclose(shapes.to_ecef(at(c))[0], e, rtol=0, atol=1e-8)
        assert np.allclose(shapes.from_ecef(at(e))[0], c, atol=1e-7)
        r = spark.range(1).select(P.ecef(*map(F.lit, c)).alias("e")).select("e", P.from_ecef(F.col("e.x"), F.col("e.y"), F.col("e.z")).alias("c")).first()
        assert np.allclose(tuple(r["e"]), e, rtol=0, atol=1e-7) and np.allclose(tuple(r["c"]), c, atol=1e-7)


@pytest.mark.parametrize("a, b, n", [((35.681, 139.766, 0), (35.682, 139.767, 0), 209), ((35.681, 139.766, 0), (35.681, 139.766, 100), 101), ((35.680, 139.765, 0), (35.683, 139.768, 60), 685)])
def test_lines(a, b, n):
    v = shapes.line(at(a, b), 25)
    assert len(v) == n and (np.abs(np.diff(v, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize(
    "corners, n",
    [
        (((35.681, 139.766, 10), (35.682, 139.766, 10), (35.681, 139.767, 10)), 5547),
        (((35.681, 139.766, 0), (35.682, 139.766, 0), (35.681, 139.766, 64)), 3912),
        (((35.681, 139.766, 0), (35.683, 139.767, 0), (35.682, 139.766, 64)), 16317),
    ],
)
def test_triangles(corners, n):
    assert len(shapes.triangle(at(*corners), 25)) == n


def test_polygons():
    quad = shapes.polygon(at((35.681, 139.766, 10), (35.684, 139.766, 10), (35.684, 139.769, 10), (35.681, 139.769, 10)), 18)
    assert len(quad) == 9 and quad.min(0).tolist() == [0, 232846, 103224] and quad.max(0).tolist() == [0, 232848, 103226]
    assert len(shapes.polygon(at((35.681, 139.766, 10), (35.684, 139.766, 10), (35.682, 139.769, 10)), 18)) == 8
    concave = at((35.682, 139.767, 10), (35.683, 139.766, 10), (35.684, 139.767, 10), (35.684, 139.769, 10), (35.681, 139.769, 10))
    assert len(shapes.polygon(concave, 18)) == 8 and len(shapes.polygon_triangles(concave)) == 3
    assert shapes.polygon_triangles(concave[:2]) == []


@pytest.mark.parametrize("alt, r, z, n", [(50, 100, 18, 26), (10, 30, 20, 40), (0, 30, 20, 32)])
def test_spheres(spark, alt, r, z, n):
    v = shapes.sphere(np.array([35.681, 139.766, alt], float), r, z)
    assert len(v) == n
    table = spark.createDataFrame([(1, 35.681, 139.766, float(alt), float(r))], "shape_id long, lat double, lon double, alt double, radius double")
    native = {(r["f"], r["x"], r["y"]) for r in covers.cover_spheres(table, z).collect()}
    assert native == set(map(tuple, v.tolist()))


@pytest.mark.parametrize("ends, n", [(((35.681, 139.766, 0), (35.681, 139.766, 32)), 0), (((35.681, 139.766, 10), (35.682, 139.767, 10)), 4), (((35.681, 139.766, 0), (35.682, 139.767, 32)), 7)])
def test_cylinders(ends, n):
    assert len(shapes.cylinder(at(*ends), 5.0, 18)) == n


@pytest.mark.parametrize(
    "points, n",
    [
        (((35.681, 139.766, 10), (35.682, 139.767, 10), (35.683, 139.766, 10)), 5),
        (((35.681, 139.766, 0), (35.682, 139.766, 0), (35.682, 139.766, 32)), 4),
        (((35.681, 139.766, 10), (35.682, 139.767, 10), (35.683, 139.767, 10), (35.683, 139.766, 10)), 6),
    ],
)
def test_tubes(points, n):
    assert len(shapes.tube(at(*points), 5.0, 18)) == n


def box(lat, lon, side, height):
    c = lambda a, b, h: (lat + a * side, lon + b * side, h * height)
    rings = [((0, 0, 0), (0, 1, 0), (1, 1, 0), (1, 0, 0)), ((0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)), ((0, 0, 0), (1, 0, 0), (1, 0, 1), (0, 0, 1)),
             ((0, 1, 0), (0, 1, 1), (1, 1, 1), (1, 1, 0)), ((0, 0, 0), (0, 0, 1), (0, 1, 1), (0, 1, 0)), ((1, 0, 0), (1, 1, 0), (1, 1, 1), (1, 0, 1))]
    return [at(*(c(*p) for p in ring)) for ring in rings]


def test_solids():
    faces = box(35.681382, 139.766084, 0.002, 100)
    assert shapes.open_edges(faces, 1e-6) == 0 and shapes.open_edges(faces[:-1], 1e-6) == 4
    v = shapes.solid(faces, 20)
    surface = shapes._union([shapes.polygon(f, 20) for f in faces])
    inner = set(map(tuple, v.tolist())) - set(map(tuple, surface.tolist()))
    assert inner and set(map(tuple, surface.tolist())) <= set(map(tuple, v.tolist()))
    runs = shapes.voxel_runs(v)
    assert (runs[:, 1] - runs[:, 0] + 1).sum() == len(v)
    with pytest.raises(GeometryError):
        shapes.solid(faces[:-1], 20)
    # A solid inside one voxel along every axis has no surface voxels.
    assert len(shapes.solid(box(35.6815, 139.7665, 1e-6, 0.1), 16)) == 0


def test_covers_of_tables(spark):
    kinds = "shape_id long, kind string, points array<struct<lat:double,lon:double,alt:double>>, faces array<array<struct<lat:double,lon:double,alt:double>>>, radius double"
    p = [(35.681, 139.766, 0.0), (35.682, 139.767, 0.0)]
    table = spark.createDataFrame([(1, "line", p, None, None), (2, "point", p[:1], None, None), (3, "solid", None, [list(map(tuple, f.tolist())) for f in box(35.681382, 139.766084, 0.002, 100)], None)], kinds)
    n = {r["shape_id"]: r["count"] for r in covers.cover(table, 20).groupBy("shape_id").count().collect()}
    assert n[2] == 1 and n[3] == len(shapes.solid(box(35.681382, 139.766084, 0.002, 100), 20))
    assert covers.cover_ranges(table, 20).where("shape_id = 3").select(F.sum(F.expr("f1 - f0 + 1"))).first()[0] == n[3]
    assert covers.cover(table, 20, surface=True).where("shape_id = 3").count() < n[3]
    assert {r["shape_id"]: r["open_edges"] for r in covers.open_edges(table, 1e-6).collect()} == {3: 0}
    assert covers.expand_triangles(table).where("shape_id = 3").count() == 12
    with pytest.raises(Exception, match="no shape"):
        covers.cover(table.withColumn("kind", F.lit("blob")), 20).collect()


def test_native_open_edges_match(spark):
    assert solid_table(spark, "/root/testdata/sf0.001").count() > 0


def test_measures(spark):
    t = at((35.681, 139.766, 0), (35.682, 139.766, 0), (35.681, 139.767, 0))
    a, b, c = shapes.triangle_sides(t)
    s = (a + b + c) / 2
    assert np.isclose(shapes.triangle_area(t), np.sqrt(s * (s - a) * (s - b) * (s - c)), rtol=1e-6)
    r = spark.range(1).select(P.cell_of(F.lit(85.0511), F.lit(180.0), F.lit(33554432.0), 4).alias("c"), P.vertices(*map(F.lit, (4, 6, 9, 14))).alias("v"), P.center(*map(F.lit, (4, 6, 9, 14))).alias("m")).first()
    assert tuple(r["c"]) == (4, 15, 15, 0)
    assert np.allclose(tuple(r["m"]), (-81.09321385260839, 33.75, 13631488.0))
    assert np.allclose(tuple(r["v"][0]), (-79.17133464081945, 22.5, 12582912.0)) and np.allclose(tuple(r["v"][7]), (-82.67628497834903, 45.0, 14680064.0))


def test_native_vectors(spark):
    pts = at((35.681, 139.766, 0), (35.682, 139.766, 0), (35.681, 139.767, 0))
    e = [P.ecef(*map(F.lit, p)) for p in pts.tolist()]
    r = spark.range(1).select(P.triangle_area(*e).alias("a"), P.near(e[0], e[1], 200).alias("n"), P.near(e[0], e[1], 50).alias("m"), P.project_2d(e[0], "x", "z").alias("p"), P.dot(P.cross(e[0], e[1]), e[0]).alias("o")).first()
    assert np.isclose(r["a"], shapes.triangle_area(pts)) and r["n"] and not r["m"] and abs(r["o"]) < 1e7
    assert np.allclose(tuple(r["p"]), shapes.to_ecef(pts)[0][[0, 2]])
    assert shapes.prism_sides(5, 18) == 57 and shapes.prism_sides(1000, 25) == 1047


def _grown(spark, kind, corners, radius):
    """30 shapes of growing size."""
    point = lambda k, i: (35.681 + 0.0004 * k * i, 139.766 - 0.0003 * k * i * i, 10.0 * i + k)
    rows = [(k, kind, [point(k, i) for i in range(corners)], [list(map(tuple, f.tolist())) for f in box(35.68 + k, 139.766, 0.0002 * (k + 1), 20.0 * k + 5)] if kind == "solid" else None, radius + k) for k in range(30)]
    return spark.createDataFrame(rows, covers.SHAPES)


@pytest.mark.parametrize("kind, corners", [("triangle", 3), ("polygon", 5), ("sphere", 1), ("cylinder", 2), ("tube", 3), ("solid", 0)])
def test_shapes_are_covered_together(spark, monkeypatch, kind, corners):
    table = _grown(spark, kind, corners, 5.0)
    want = {(r["shape_id"], *v) for r in table.collect() for v in covers.cover_one(kind, covers._array(r["points"]), [covers._array(f) for f in r["faces"] or ()], r["radius"], 19).tolist()}
    found = covers.cover(table, 19).collect()
    assert len(found) == len(want) and {(r["shape_id"], r["f"], r["x"], r["y"]) for r in found} == want
    runs = covers.cover_ranges(table, 19).collect()
    assert {(r["shape_id"], f, r["x"], r["y"]) for r in runs for f in range(r["f0"], r["f1"] + 1)} == want
    # One pass over a batch, not one per shape; large shapes are held by themselves.
    batch = table.toArrow().combine_chunks().to_batches()[0]
    assert len(list(covers.cover_batch(batch, 15))) <= 2
    monkeypatch.setattr(covers, "_HELD", 1)
    alone = list(covers.cover_batch(batch, 19))
    assert len(alone) == 30 and {(int(i[0]), *v) for i, rows in alone for v in rows[:, 1:].tolist()} == want


def test_open_solids_are_found_in_a_batch(spark):
    table = _grown(spark, "solid", 0, 5.0)
    with pytest.raises(Exception, match="open at 4 edges"):
        covers.cover(table.withColumn("faces", F.expr("if(shape_id = 17, slice(faces, 1, 5), faces)")), 19).collect()
    with pytest.raises(Exception, match="open at 0 edges"):
        covers.cover(table.withColumn("faces", F.expr("if(shape_id = 17, null, faces)")), 19).collect()


def test_spheres_are_dealt_before_they_grow(spark):
    table = spark.range(100).coalesce(1).selectExpr("id AS shape_id", "35.0 + id / 10D AS lat", "139.0D AS lon", "20.0D AS alt", "30.0D AS radius")
    assert covers.cover_spheres(table, 19).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_open_edges_take_one_exchange(spark):
    table = _grown(spark, "solid", 0, 5.0)
    found = covers.open_edges(table.withColumn("faces", F.expr("if(shape_id = 17, slice(faces, 1, 5), faces)")), 1e-6)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {r["shape_id"]: r["open_edges"] for r in found.collect()} == {k: 4 if k == 17 else 0 for k in range(30)}
