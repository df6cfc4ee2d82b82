"""The registered queries of the engine, with their SQL where DuckDB can express it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlattice.domain import CALENDAR
from voxlattice.frame import VoxelFrame, dealt, to_blocks
from voxlattice.functions import codecs, flex, ids, timeaxis
from voxlattice.functions import projection as P
from voxlattice.operators import coalesce, lookups, sets, shards, transforms, writes
from voxlattice.operators import covers as C
from voxlattice.operators.canonical import canonicalize
from voxlattice.operators.lookups import Range
from voxlattice.operators.policies import AVERAGE, DIFFERENCE, KEEP_EXISTING, MAX, MIN, OVERWRITE, SUM, MergePolicy
from voxlattice.operators.transforms import LINEAR, QUADRATIC_IN, QUADRATIC_OUT, Bound
from voxlattice.plans.nodes import BinaryOp, UnaryOp
from voxlattice.plans.query import Query
from voxlattice.sources import generators, jsonio, tables, views
from voxlattice.sources.views import cells_ev, cells_li, cells_li_b, cells_ord, points_cust, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(name: str, run: Callable[[SparkSession, str], DataFrame | VoxelFrame], sql: str | None = None) -> None:
    def call(spark, sf_dir):
        out = run(spark, sf_dir)
        return out.cells() if isinstance(out, VoxelFrame) else out

    call.__name__ = name
    QUERIES[name] = call
    if sql is not None:
        ORACLES[name] = with_views(sql)


def _on(view, step) -> Callable:
    """A query of one frame: ``step`` gets a Query over the view."""
    return lambda s, d: step(Query.of(view(s, d), view.__name__)).run()


def _two(step) -> Callable:
    return lambda s, d: step(Query.of(cells_li(s, d)), Query.of(cells_li_b(s, d))).run()


# Shift, extrude ----------------------------------------------------------------------------------------------------------

_register("shift_x", _on(cells_li, lambda q: q.shift_x(16, 5)), "SELECT 16 z, f, CAST(x + 5 AS INT) x, y, value FROM cells_li")
_register(
    "shift_x_wrap",
    _on(cells_li, lambda q: q.shift_x(16, -1000)),
    "SELECT 16 z, f, CAST(((x - 1000) % 65536 + 65536) % 65536 AS INT) x, y, value FROM cells_li",
)
_register("shift_y", _on(cells_li, lambda q: q.shift_y(14, 3)), "SELECT 16 z, f, x, CAST(y + 12 AS INT) y, value FROM cells_li")
_register("shift_f", _on(cells_li, lambda q: q.shift_f(16, -7)), "SELECT 16 z, CAST(f - 7 AS INT) f, x, y, value FROM cells_li")
_register(
    "extrude_f_max",
    _on(cells_li, lambda q: q.extrude_f(16, -2, 2, MAX)),
    "SELECT 16 z, CAST(r.f AS INT) f, x, y, value FROM (SELECT x, y, max(value) AS value FROM cells_li GROUP BY x, y) c, range(-2, 3) r(f)",
)
_register(
    "extrude_x_wrap_sum",
    _on(cells_li, lambda q: q.extrude_x(16, 65534, 1, SUM)),
    "SELECT 16 z, f, CAST(r.x AS INT) x, y, value FROM (SELECT f, y, CAST(sum(value) AS BIGINT) AS value FROM cells_li GROUP BY f, y) c, (VALUES (65534), (65535), (0), (1)) r(x)",
)
_register(
    "extrude_y_min",
    _on(cells_li, lambda q: q.extrude_y(15, 10, 11, MIN)),
    "SELECT 16 z, f, x, CAST(r.y AS INT) y, value FROM (SELECT f, x, min(value) AS value FROM cells_li GROUP BY f, x) c, range(20, 24) r(y)",
)

# Falloff -------------------------------------------------------------------------------------------------------------------


def _falloff_sql(view: str, axis: str, lo: int, hi: int, value: str, agg: str, z: int = 16) -> str:
    n = 1 << z
    to = {"x": f"((x + d) % {n} + {n}) % {n}", "y": "y + d", "f": "f + d"}[axis]
    cols = ", ".join(f"CAST({to if a == axis else a} AS INT) {a}" for a in "fxy")
    keep = "" if axis == "x" else f" WHERE {axis} BETWEEN {-n if axis == 'f' else 0} AND {n - 1}"
    return f"SELECT {z} z, f, x, y, CAST({agg}(v) AS BIGINT) AS value FROM (SELECT {cols}, {value} AS v FROM {view} , range({lo}, {hi + 1}) r(d)) q{keep} GROUP BY f, x, y"


_register("falloff_x_linear_sum", _on(cells_li, lambda q: q.falloff_x(16, 2, "both", LINEAR, SUM)), _falloff_sql("cells_li", "x", -2, 2, "(value * (2 - abs(d))) // 2", "sum"))
_register("falloff_y_linear_max", _on(cells_li, lambda q: q.falloff_y(16, 3, "both", LINEAR, MAX)), _falloff_sql("cells_li", "y", -3, 3, "(value * (3 - abs(d))) // 3", "max"))
_register("falloff_f_upper_max", _on(cells_li, lambda q: q.falloff_f(16, 4, "upper", LINEAR, MAX)), _falloff_sql("cells_li", "f", 0, 4, "(value * (4 - abs(d))) // 4", "max"))
_register("falloff_f_lower_min", _on(cells_li, lambda q: q.falloff_f(16, 2, "lower", LINEAR, MIN)), _falloff_sql("cells_li", "f", -2, 0, "(value * (2 - abs(d))) // 2", "min"))
_register("falloff_x_quad_in", _on(cells_li, lambda q: q.falloff_x(16, 2, "both", QUADRATIC_IN, MAX)), _falloff_sql("cells_li", "x", -2, 2, "(value * (4 - d * d)) // 4", "max"))
_register("falloff_x_quad_out", _on(cells_li, lambda q: q.falloff_x(16, 3, "both", QUADRATIC_OUT, SUM)), _falloff_sql("cells_li", "x", -3, 3, "(value * (3 - abs(d)) * (3 - abs(d))) // 9", "sum"))
_register(
    "falloff_x_coarse_step",
    _on(cells_li, lambda q: q.falloff_x(14, 1, "both", LINEAR, MAX)),
    _falloff_sql("cells_li", "x", -1, 1, "value * (1 - abs(d))", "max").replace("(x + d)", "(x + d * 4)"),
)

# Zoom out, filters, maps -------------------------------------------------------------------------------------------------


def _zoom_sql(view: str, z: int, d: int, agg: str) -> str:
    return f"SELECT {z} z, CAST(f >> {d} AS INT) f, CAST(x >> {d} AS INT) x, CAST(y >> {d} AS INT) y, {agg} AS value FROM {view} GROUP BY ALL"


_register("zoom_out_max", _on(cells_li, lambda q: q.zoom_out(12, MAX)), _zoom_sql("cells_li", 12, 4, "max(value)"))
_register("zoom_out_min", _on(cells_li, lambda q: q.zoom_out(13, MIN)), _zoom_sql("cells_li", 13, 3, "min(value)"))
_register("zoom_out_sum", _on(cells_ord, lambda q: q.zoom_out(14, SUM)), _zoom_sql("cells_ord", 14, 6, "CAST(sum(value) AS BIGINT)"))
_register("zoom_out_avg", _on(cells_ord, lambda q: q.zoom_out(12, AVERAGE)), _zoom_sql("cells_ord", 12, 8, "CAST(sum(value) // count(*) AS BIGINT)"))
_register("zoom_out_block_sum", _on(cells_ord, lambda q: q.zoom_out(14, SUM, "block")), _zoom_sql("cells_ord", 14, 6, "CAST(sum(value) AS BIGINT)"))
_register("zoom_out_keep", _on(cells_ord, lambda q: q.zoom_out(14, KEEP_EXISTING)), _zoom_sql("cells_ord", 14, 6, "arg_min(value, (f, x, y))"))
_register("zoom_out_overwrite", _on(cells_ord, lambda q: q.zoom_out(14, OVERWRITE)), _zoom_sql("cells_ord", 14, 6, "arg_max(value, (f, x, y))"))
_register(
    "pyramid_max",
    lambda s, d: transforms.pyramid(cells_li(s, d), [10, 12, 14], MAX),
    " UNION ALL ".join(_zoom_sql("cells_li", z, 16 - z, "max(value)") for z in (10, 12, 14)),
)
_register("filter_eq", _on(cells_li, lambda q: q.filter_eq(25)), "SELECT 16 z, * FROM cells_li WHERE value = 25")
_register("filter_in", _on(cells_li, lambda q: q.filter_in(10, Bound(20, False))), "SELECT 16 z, * FROM cells_li WHERE value >= 10 AND value < 20")
_register("filter_not_in", _on(cells_li, lambda q: q.filter_not_in(10, 40)), "SELECT 16 z, * FROM cells_li WHERE NOT (value >= 10 AND value <= 40)")
_register("map_values_bool", _on(cells_li, lambda q: q.map_values(lambda v: v > 25)), "SELECT 16 z, f, x, y, value > 25 AS value FROM cells_li")
_register(
    "map_values_text",
    _on(cells_li, lambda q: q.map_values(lambda v: F.when(v > 25, "high").otherwise("low"))),
    "SELECT 16 z, f, x, y, CASE WHEN value > 25 THEN 'high' ELSE 'low' END AS value FROM cells_li",
)

# Overlays ------------------------------------------------------------------------------------------------------------------

_FULL = "(SELECT f, x, y, a.value AS va, b.value AS vb FROM cells_li a FULL JOIN cells_li_b b USING (f, x, y)) q"
_register("merge_sum_default", _two(lambda a, b: a.merge(b, 0, SUM)), f"SELECT 16 z, f, x, y, CAST(coalesce(va, 0) + coalesce(vb, 0) AS BIGINT) AS value FROM {_FULL}")
_register("merge_max", _two(lambda a, b: a.merge(b, 10, MAX)), f"SELECT 16 z, f, x, y, greatest(coalesce(va, 10), coalesce(vb, 10)) AS value FROM {_FULL}")
_register("merge_min", _two(lambda a, b: a.merge(b, 10, MIN)), f"SELECT 16 z, f, x, y, least(coalesce(va, 10), coalesce(vb, 10)) AS value FROM {_FULL}")
_register("merge_average", _two(lambda a, b: a.merge(b, 0, AVERAGE)), f"SELECT 16 z, f, x, y, CAST((coalesce(va, 0) + coalesce(vb, 0)) // 2 AS BIGINT) AS value FROM {_FULL}")
_register(
    "merge_difference",
    _two(lambda a, b: a.merge(b, 7, DIFFERENCE)),
    f"SELECT 16 z, f, x, y, CASE WHEN coalesce(va, 7) >= coalesce(vb, 7) THEN coalesce(va, 7) - coalesce(vb, 7) ELSE 0 END AS value FROM {_FULL}",
)
_register("merge_overwrite", _two(lambda a, b: a.merge(b, -1, OVERWRITE)), f"SELECT 16 z, f, x, y, coalesce(vb, -1) AS value FROM {_FULL}")
_register("merge_keep_existing", _two(lambda a, b: a.merge(b, -1, KEEP_EXISTING)), f"SELECT 16 z, f, x, y, coalesce(va, -1) AS value FROM {_FULL}")
_register("merge_with_resolve", lambda s, d: sets.merge_with(cells_li(s, d), cells_li_b(s, d), lambda a, b: a * b), f"SELECT 16 z, f, x, y, CASE WHEN va IS NULL THEN vb WHEN vb IS NULL THEN va ELSE va * vb END AS value FROM {_FULL}")
_register("query_intersection", _two(lambda a, b: a.intersection(b)), "SELECT 16 z, a.* FROM cells_li a SEMI JOIN cells_li_b b USING (f, x, y)")
_register("query_difference", _two(lambda a, b: a.difference(b)), "SELECT 16 z, a.* FROM cells_li a ANTI JOIN cells_li_b b USING (f, x, y)")
_register("set_union", lambda s, d: sets.union(cells_li(s, d).without_values(), cells_li_b(s, d).without_values()), "SELECT 16 z, f, x, y FROM cells_li UNION SELECT 16, f, x, y FROM cells_li_b")
_register("set_intersection", lambda s, d: sets.set_intersection(cells_li(s, d), cells_li_b(s, d)), "SELECT 16 z, f, x, y FROM cells_li INTERSECT SELECT 16, f, x, y FROM cells_li_b")
_register("set_difference", lambda s, d: sets.set_difference(cells_li(s, d), cells_li_b(s, d)), "SELECT 16 z, f, x, y FROM cells_li EXCEPT SELECT 16, f, x, y FROM cells_li_b")
_register("value_union", lambda s, d: sets.union(cells_li_b(s, d), cells_li(s, d)), f"SELECT 16 z, f, x, y, coalesce(vb, va) AS value FROM {_FULL}")

# Writes ----------------------------------------------------------------------------------------------------------------------

_register("upsert", lambda s, d: writes.upsert(cells_li_b(s, d), cells_li(s, d)), f"SELECT 16 z, f, x, y, coalesce(vb, va) AS value FROM {_FULL}")
_register("insert_overwrite", lambda s, d: writes.insert(cells_li(s, d), cells_li_b(s, d)), f"SELECT 16 z, f, x, y, coalesce(vb, va) AS value FROM {_FULL}")
_register("insert_with_max", lambda s, d: writes.insert_with(cells_li(s, d), cells_li_b(s, d), F.greatest), f"SELECT 16 z, f, x, y, greatest(va, vb) AS value FROM {_FULL}")
_register("remove", lambda s, d: writes.remove(cells_li(s, d), cells_li_b(s, d))[0], "SELECT 16 z, a.* FROM cells_li a ANTI JOIN cells_li_b b USING (f, x, y)")
_register("removed", lambda s, d: writes.remove(cells_li(s, d), cells_li_b(s, d))[1], "SELECT 16 z, a.* FROM cells_li a SEMI JOIN cells_li_b b USING (f, x, y)")
_register(
    "insert_batch",
    lambda s, d: writes.bulk_load(VoxelFrame(views._lines(s, d).withColumn("seq", F.struct("value", "l_returnflag")), 16), "seq"),
    "SELECT 16 z, f, x, y, value FROM cells_li",
)

# Lookups ---------------------------------------------------------------------------------------------------------------------

_TARGET = Range(12, f=(-1, 0), x=(3, 40), y=(0, 3))
_IN_TARGET = "f >= -16 AND f < 16 AND x >= 48 AND x < 656 AND y >= 0 AND y < 64"
_register("get_clip", lambda s, d: lookups.get(cells_li(s, d), _TARGET), f"SELECT 16 z, * FROM cells_li WHERE {_IN_TARGET}")
_register("get_overlapping", lambda s, d: lookups.get_overlapping(cells_li(s, d), [_TARGET, Range(18, f=(0, 3), x=(400, 4000), y=(4, 90))]), f"SELECT 16 z, * FROM cells_li WHERE ({_IN_TARGET}) OR (f = 0 AND x >= 100 AND x <= 1000 AND y >= 1 AND y <= 22)")
_register("get_wrapped", lambda s, d: lookups.get_overlapping(cells_li(s, d), [Range(16, x=(65000, 99))]), "SELECT 16 z, * FROM cells_li WHERE x >= 65000 OR x <= 99")


def _target_blocks(s, d) -> DataFrame:
    """Blocks of the cells with value 50, one zoom coarser along every axis."""
    b = to_blocks(cells_li(s, d).over(cells_li(s, d).df.where("value = 50")).without_values())
    for a in "fxy":
        b = b.withColumns({f"{a}z": F.lit(15), f"{a}i": F.shiftright(f"{a}i", 1)})
    return b.distinct()


_T15 = "(SELECT DISTINCT f >> 1 AS tf, x >> 1 AS tx, y >> 1 AS ty FROM cells_li WHERE value = 50) t"
_BLOCK = "16 AS fz, f AS fi, 16 AS xz, x AS xi, 16 AS yz, y AS yi, 0 AS tz, CAST(0 AS BIGINT) AS ti, value"
_register("blocks_overlapping", lambda s, d: lookups.blocks_overlapping(to_blocks(cells_li(s, d)), _target_blocks(s, d)), f"SELECT {_BLOCK} FROM cells_li SEMI JOIN {_T15} ON f >> 1 = tf AND x >> 1 = tx AND y >> 1 = ty")
_register("blocks_remove_overlapping", lambda s, d: lookups.blocks_remove_overlapping(to_blocks(cells_li(s, d)), _target_blocks(s, d)), f"SELECT {_BLOCK} FROM cells_li ANTI JOIN {_T15} ON f >> 1 = tf AND x >> 1 = tx AND y >> 1 = ty")
_register("blocks_clipped", lambda s, d: lookups.blocks_clipped(_target_blocks(s, d).withColumn("value", F.lit(1)), to_blocks(cells_li(s, d))), f"SELECT 16 AS fz, f AS fi, 16 AS xz, x AS xi, 16 AS yz, y AS yi, 0 AS tz, CAST(0 AS BIGINT) AS ti, 1 AS value FROM cells_li SEMI JOIN {_T15} ON f >> 1 = tf AND x >> 1 = tx AND y >> 1 = ty")
_register(
    "neighbors_face",
    lambda s, d: lookups.blocks_sharing_face(to_blocks(cells_li(s, d)), to_blocks(cells_li(s, d).over(cells_li(s, d).df.where("value = 50")))),
    f"""SELECT {_BLOCK} FROM cells_li c WHERE value <> 50 AND EXISTS (SELECT 1 FROM cells_li t WHERE t.value = 50 AND
        ((t.f = c.f AND t.y = c.y AND (t.x = (c.x + 1) % 65536 OR c.x = (t.x + 1) % 65536)) OR
         (t.f = c.f AND t.x = c.x AND abs(t.y - c.y) = 1) OR (t.x = c.x AND t.y = c.y AND abs(t.f - c.f) = 1)))""",
)
_register("bounding_box", lambda s, d: lookups.bounding_box(cells_li(s, d)), "SELECT 16 z, min(f) f0, max(f) f1, min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM cells_li")
_register("max_zoom", lambda s, d: lookups.max_zoom(_target_blocks(s, d)), "SELECT 15 AS max_zoom")
_register("value_get", lambda s, d: lookups.value_get(cells_li(s, d), 7), "SELECT 16 z, * FROM cells_li WHERE value = 7")
_register("value_range", _on(cells_li, lambda q: q.filter_in(Bound(3, False), 9)), "SELECT 16 z, * FROM cells_li WHERE value > 3 AND value <= 9")
_register("distinct_values", lambda s, d: lookups.values(cells_li(s, d)), "SELECT DISTINCT value FROM cells_li")
_register("cell_count", lambda s, d: cells_li(s, d).df.agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM cells_li")
_register(
    "single_ids",
    lambda s, d: lookups.single_ids(_target_blocks(s, d).withColumns({"xz": F.lit(16), "xi": F.col("xi") * 2})).select("z", "f", "x", "y").distinct(),
f"SELECT DISTINCT 16 AS z, CAST(tf * 2 + i AS INT) f, CAST(tx * 2 AS INT) x, CAST(ty * 2 + j AS INT) y FROM {_T15} , range(0, 2) a(i), range(0, 2) b(j)",
)

# Identifiers -----------------------------------------------------------------------------------------------------------------


def _cell() -> list[Column]:
    return [F.col(c) for c in ("z", "f", "x", "y")]



def _cells(s, d) -> DataFrame:
    return cells_li(s, d).cells()


_register("parents", lambda s, d: _cells(s, d).select(F.col("value"), F.explode(ids.parents(*_cell())).alias("c")).select("value", "c.*"), "SELECT value, CAST(k AS INT) z, CAST(f >> CAST(16 - k AS INT) AS INT) f, CAST(x >> CAST(16 - k AS INT) AS INT) x, CAST(y >> CAST(16 - k AS INT) AS INT) y FROM cells_li , range(0, 16) r(k)")
_register("children", lambda s, d: _cells(s, d).select(F.explode(ids.children(*_cell(), 17)).alias("c")).select("c.*"), "SELECT 17 z, CAST(f * 2 + a AS INT) f, CAST(x * 2 + b AS INT) x, CAST(y * 2 + c AS INT) y FROM cells_li , range(0, 2) p(a), range(0, 2) q(b), range(0, 2) r(c)")
_register("siblings", lambda s, d: _cells(s, d).select(F.explode(ids.siblings(*_cell())).alias("c")).select("c.*"), "SELECT 16 z, CAST((f >> 1) * 2 + a AS INT) f, CAST((x >> 1) * 2 + b AS INT) x, CAST((y >> 1) * 2 + c AS INT) y FROM cells_li , range(0, 2) p(a), range(0, 2) q(b), range(0, 2) r(c) WHERE NOT ((f >> 1) * 2 + a = f AND (x >> 1) * 2 + b = x AND (y >> 1) * 2 + c = y)")


def _neighbours_sql(kinds: str) -> str:
    return f"SELECT 16 z, CAST(f + a AS INT) f, CAST(((x + b) % 65536 + 65536) % 65536 AS INT) x, CAST(y + c AS INT) y FROM cells_li , range(-1, 2) p(a), range(-1, 2) q(b), range(-1, 2) r(c) WHERE abs(a) + abs(b) + abs(c) IN ({kinds}) AND y + c BETWEEN 0 AND 65535"


for _kind, _sums in (("face", "1"), ("edge", "2"), ("vertex", "3"), ("all", "1, 2, 3")):
    _register(
        f"neighbors_{_kind}" if _kind != "face" else "neighbors_of_cells",
        lambda s, d, k=_kind: _cells(s, d).select(F.explode(ids.neighbours(*_cell(), k)).alias("c")).select("c.*"),
        _neighbours_sql(_sums),
    )
_register("move_cells", lambda s, d: _cells(s, d).select("z", ids.moved("f", F.col("z"), F.col("f"), 3).alias("f"), ids.moved("x", F.col("z"), F.col("x"), -20).alias("x"), ids.moved("y", F.col("z"), F.col("y"), 9).alias("y"), "value"), "SELECT 16 z, CAST(f + 3 AS INT) f, CAST(((x - 20) % 65536 + 65536) % 65536 AS INT) x, CAST(y + 9 AS INT) y, value FROM cells_li")
_register("single_id_text", lambda s, d: cells_ev(s, d).cells().select(ids.single_text(*_cell(), F.lit(3600), (F.col("t0") / 3600).cast("long")).alias("id")), "SELECT '12/' || f || '/' || x || '/' || y || '_3600/' || (t0 // 3600) AS id FROM cells_ev")
_register("parse_id", lambda s, d: cells_ev(s, d).cells().select(ids.parse_single(ids.single_text(*_cell(), F.lit(3600), (F.col("t0") / 3600).cast("long"))).alias("p")).select("p.*"), "SELECT 12 z, f, x, y, CAST(3600 AS BIGINT) i, t0 // 3600 AS t FROM cells_ev")
_register("parse_range_id", lambda s, d: _cells(s, d).select(ids.parse_range(ids.range_text(F.col("z"), F.col("f"), F.col("f") + 1, F.col("x"), F.col("x"), F.col("y"), F.col("y") + 2)).alias("p")).select("p.*"), "SELECT 16 z, f AS f0, f + 1 AS f1, x AS x0, x AS x1, y AS y0, y + 2 AS y1, CAST(34359738368 AS BIGINT) i, CAST(0 AS BIGINT) t0, CAST(0 AS BIGINT) t1 FROM cells_li")
_register("flex_id_text", lambda s, d: to_blocks(cells_li(s, d)).select(ids.flex_text(*[F.col(c) for c in ("fz", "fi", "xz", "xi", "yz", "yi", "tz", "ti")]).alias("id")), "SELECT '16/' || f || '|16/' || x || '|16/' || y AS id FROM cells_li")
_register("encode_round_trip", lambda s, d: _cells(s, d).select(codecs.cell_key(*_cell()).alias("k"), "value").select(codecs.cell_of_key(F.col("k")).alias("c"), "value").select("c.*", "value"), "SELECT 16 z, f, x, y, value FROM cells_li")
_register("flex_encode_round_trip", lambda s, d: to_blocks(cells_ev(s, d)).select(codecs.flex_key(*[F.col(c) for c in flex.FLEX]).alias("k")).select(codecs.flex_of_key(F.col("k")).alias("c")).groupBy("c.fi", "c.xi", "c.yi").agg(F.sum(ids.shift_left(F.lit(1).cast("long"), 35 - F.col("c.tz"))).alias("seconds")), "SELECT f AS fi, x AS xi, y AS yi, CAST(sum(t1 - t0) AS BIGINT) AS seconds FROM cells_ev GROUP BY ALL")
_register("dyadic_segments", lambda s, d: to_blocks(cells_ev(s, d)).groupBy("xi", "yi", "value").agg(F.sum(ids.shift_left(F.lit(1).cast("long"), 35 - F.col("tz"))).alias("seconds"), F.min(F.col("ti") * ids.shift_left(F.lit(1).cast("long"), 35 - F.col("tz"))).alias("start")), "SELECT x AS xi, y AS yi, value, CAST(sum(t1 - t0) AS BIGINT) AS seconds, min(t0) AS start FROM cells_ev GROUP BY ALL")

_register(
    "morton_order",
    lambda s, d: _cells(s, d).select(ids.morton(*_cell()).alias("k")).groupBy(F.expr("shiftright(k, 54)").alias("top")).agg(F.count(F.lit(1)).alias("n")),
    "SELECT CAST(((f + 65536) >> 16 & 1) * 32 + (x >> 15 & 1) * 16 + (y >> 15 & 1) * 8 + ((f + 65536) >> 15 & 1) * 4 + (x >> 14 & 1) * 2 + (y >> 14 & 1) AS BIGINT) AS top, count(*) n FROM cells_li GROUP BY 1",
)
_register("range_blocks", lambda s, d: flex.from_ranges(_cells(s, d).select("z", F.col("f").alias("f0"), F.col("f").alias("f1"), F.col("x").alias("x0"), (F.col("x") + 4).alias("x1"), F.col("y").alias("y0"), F.col("y").alias("y1"))).groupBy(F.col("fi").alias("f"), F.col("yi").alias("y")).agg(F.sum(F.pow(F.lit(2.0), 16 - F.col("xz"))).cast("bigint").alias("cells")), "SELECT f, y, CAST(5 * count(*) AS BIGINT) AS cells FROM cells_li GROUP BY f, y")
_register("block_shards", lambda s, d: flex.to_shards(to_blocks(cells_li(s, d)), (10, 10, 10)).groupBy("sf", "sx", "sy").agg(F.count(F.lit(1)).alias("n")), "SELECT CAST(f >> 6 AS INT) sf, CAST(x >> 6 AS INT) sx, CAST(y >> 6 AS INT) sy, count(*) n FROM cells_li GROUP BY ALL")
_register("block_ancestors", lambda s, d: dealt(flex.clamp_zoom(to_blocks(cells_li(s, d)), 12), ["fi", "xi", "yi"]).groupBy(*flex.FLEX[:6]).agg(F.max("value").alias("value")), "SELECT 12 fz, CAST(f >> 4 AS INT) fi, 12 xz, CAST(x >> 4 AS INT) xi, 12 yz, CAST(y >> 4 AS INT) yi, max(value) AS value FROM cells_li GROUP BY ALL")
_register("with_time_at", lambda s, d: views._table(s, d, "events").select("event_id", ids.with_time_at(3600, F.unix_timestamp("ts")).alias("c")).select("event_id", "c.*"), "SELECT event_id, CAST(3600 AS BIGINT) i, CAST(floor(epoch(ts) / 3600) AS BIGINT) t FROM events")

_SPAN = "SELECT event_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS t0, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 + 3600 * (1 + event_id % 4) AS t1 FROM events"


def _spans(s, d) -> DataFrame:
    """One to four whole hours from each event's on."""
    t0 = F.floor(F.unix_timestamp("ts") / 3600) * 3600
    return views._table(s, d, "events").select("event_id", t0.alias("t0"), (t0 + 3600 * (1 + F.col("event_id") % 4)).cast("long").alias("t1"))


_register("range_time_span", lambda s, d: _spans(s, d).select("event_id", ids.range_time_span(F.col("t0"), F.col("t1")).alias("c")).select("event_id", "c.*"), f"SELECT event_id, CAST(gcd(t0, t1 - t0) AS BIGINT) i, CAST(t0 // gcd(t0, t1 - t0) AS BIGINT) t0, CAST(t1 // gcd(t0, t1 - t0) - 1 AS BIGINT) t1 FROM ({_SPAN})")
_register("with_time_span", lambda s, d: _spans(s, d).select("event_id", ids.with_time_span(F.col("t0"), F.col("t0") + 3600).alias("c")).select("event_id", "c.*"), f"SELECT event_id, CAST(3600 AS BIGINT) i, CAST(t0 // 3600 AS BIGINT) t FROM ({_SPAN})")
_register("fine_range", lambda s, d: _cells(s, d).select(ids.fine_range_column(F.col("x"), F.col("x") + 2, F.col("z"), 20).alias("x"), ids.fine_range_column(F.col("f"), F.col("f"), F.col("z"), 18).alias("f")).select(F.col("x.lo").alias("x0"), F.col("x.hi").alias("x1"), F.col("f.lo").alias("f0"), F.col("f.hi").alias("f1")), "SELECT CAST(x * 16 AS BIGINT) x0, CAST((x + 3) * 16 - 1 AS BIGINT) x1, CAST(f * 4 AS BIGINT) f0, CAST(f * 4 + 3 AS BIGINT) f1 FROM cells_li")
_register("edges_shift", lambda s, d: _cells(s, d).select(ids.edges_shift_column("x", F.col("x"), F.col("x"), F.col("z"), 30, 5000, 13).alias("x"), ids.edges_shift_column("y", F.col("y"), F.col("y"), F.col("z"), 40000, 3, 14).alias("y"), ids.edges_shift_column("x", F.col("x"), F.col("x"), F.col("z"), 40000, 30000, 10).alias("w")).select(F.col("x.lo").alias("x0"), F.col("x.hi").alias("x1"), F.col("y.lo").alias("y0"), F.col("y.hi").alias("y1"), F.col("w.lo").alias("w0"), F.col("w.hi").alias("w1")), "SELECT CAST((x - 30 + 65536) % 65536 >> 3 AS BIGINT) x0, CAST((x + 5000) % 65536 >> 3 AS BIGINT) x1, CAST(greatest(y - 40000, 0) >> 2 AS BIGINT) y0, CAST(least(y + 3, 65535) >> 2 AS BIGINT) y1, CAST(0 AS BIGINT) w0, CAST(1023 AS BIGINT) w1 FROM cells_li")
_register("stretch_x", lambda s, d: _cells(s, d).select("x", F.explode(ids.stretch_column("x", F.col("z"), F.col("x"), 3)).alias("to")), "SELECT x, CAST((x + k) % 65536 AS BIGINT) AS to FROM cells_li , range(0, 4) r(k)")
_register("stretch_y", lambda s, d: _cells(s, d).select("y", F.explode(ids.stretch_column("y", F.col("z"), F.col("y"), -2)).alias("to")), "SELECT y, CAST(y + k AS BIGINT) AS to FROM cells_li , range(-2, 1) r(k) WHERE y + k >= 0")
_register("checked_index", lambda s, d: _cells(s, d).select(ids.checked_index("x", F.col("z"), F.pmod(F.col("x") * 3, F.lit(65536))).alias("x"), ids.checked_index("f", F.col("z"), -F.col("f")).alias("f")), "SELECT CAST(x * 3 % 65536 AS INT) x, CAST(-f AS INT) f FROM cells_li")


def _timed_pairs(s, d) -> DataFrame:
    """Every event cell's hour against its parent's first half of that day."""
    ev = cells_ev(s, d).cells()
    own = F.struct(*[F.lit(12).alias(f"{k}z") if p == "z" else F.col(k).alias(f"{k}i") for k in "fxy" for p in "zi"], "t0", "t1")
    day = (F.floor(F.col("t0") / 86400) * 86400).cast("long")
    up = F.struct(*[F.lit(11).alias(f"{k}z") if p == "z" else F.shiftright(k, 1).alias(f"{k}i") for k in "fxy" for p in "zi"], day.alias("t0"), (day + 43200).alias("t1"))
    return ev.select(own.alias("a"), up.alias("b"))


_EV_DAY = "(SELECT f, x, y, t0, t1, t0 // 86400 * 86400 AS d0 FROM cells_ev)"
_register("timed_intersection", lambda s, d: _timed_pairs(s, d).select(flex.timed_intersection(F.col("a"), F.col("b")).alias("c")).where("c is not null").select("c.*"), f"SELECT 12 fz, f fi, 12 xz, x xi, 12 yz, y yi, greatest(t0, d0) AS t0, least(t1, d0 + 43200) AS t1 FROM {_EV_DAY} WHERE t0 < d0 + 43200")
_register(
    "timed_difference",
    lambda s, d: _timed_pairs(s, d).select(F.explode(flex.timed_difference(F.col("b"), F.col("a"))).alias("c")).agg(F.sum((F.col("c.t1") - F.col("c.t0")) * F.pow(F.lit(2.0), 36 - F.col("c.fz") - F.col("c.xz") - F.col("c.yz"))).cast("bigint").alias("cell_seconds"), F.count(F.lit(1)).alias("pieces")),
    f"SELECT CAST(sum(8 * 43200 - greatest(0, least(t1, d0 + 43200) - t0)) AS BIGINT) AS cell_seconds, CAST(sum(CASE WHEN t0 >= d0 + 43200 THEN 1 ELSE 3 + (t0 > d0)::INT + (t1 < d0 + 43200)::INT END) AS BIGINT) AS pieces FROM {_EV_DAY}",
)

# Time ------------------------------------------------------------------------------------------------------------------------

_register("time_bucket", lambda s, d: views._table(s, d, "events").select("event_id", timeaxis.bucket(F.unix_timestamp("ts"), 86400).alias("day"), timeaxis.bucket(F.unix_timestamp("ts"), 1800).alias("half_hour")), "SELECT event_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, CAST(floor(epoch(ts) / 1800) AS BIGINT) AS half_hour FROM events")
_EV_T = "(SELECT min(t0) FROM cells_ev)"


def _time_overlap(s, d) -> DataFrame:
    """Pairs of spans on one cell that meet: the hours of a cell against its days."""
    ev = cells_ev(s, d)
    day = ev.df.withColumns({"t0": F.floor(F.col("t0") / 86400) * 86400, "t1": F.floor(F.col("t0") / 86400) * 86400 + 86400})
    days = ev.over(day.groupBy("f", "x", "y", "t0", "t1").agg(F.max("value").alias("value")))
    return lookups.overlap_join(ev, days)


_register("time_overlap", _time_overlap, """
    SELECT e.f, e.x, e.y, e.t0, e.t1, e.value, g.value AS other_value FROM cells_ev e JOIN
    (SELECT f, x, y, t0 // 86400 AS day, max(value) AS value FROM cells_ev GROUP BY ALL) g ON e.f = g.f AND e.x = g.x AND e.y = g.y AND e.t0 // 86400 = g.day""")


def _coarse_ev(s, d) -> VoxelFrame:
    return transforms.zoom_out(transforms.map_values(cells_ev(s, d), lambda v: F.when(v > 50, 1).otherwise(0).cast("bigint")), 4, MAX)


_RUNS = """WITH c AS (SELECT CAST(f >> 8 AS INT) f, CAST(x >> 8 AS INT) x, CAST(y >> 8 AS INT) y, t0, t1, max(CASE WHEN value > 50 THEN 1 ELSE 0 END)::BIGINT AS value FROM cells_ev GROUP BY ALL),
    n AS (SELECT *, CASE WHEN lag(t1) OVER w >= t0 THEN 0 ELSE 1 END AS fresh FROM c WINDOW w AS (PARTITION BY f, x, y, value ORDER BY t0)),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY f, x, y, value ORDER BY t0) AS island FROM n),
    runs AS (SELECT f, x, y, value, min(t0) AS t0, max(t1) AS t1 FROM r GROUP BY f, x, y, value, island)"""
_register("coalesce_time", lambda s, d: coalesce.coalesce_time(_coarse_ev(s, d)), f"{_RUNS} SELECT 4 z, f, x, y, t0, t1, value FROM runs")
_register("range_ids", lambda s, d: coalesce.range_ids(_coarse_ev(s, d)), f"{_RUNS} SELECT 4 z, f, x, y, gcd(t0, t1 - t0) AS i, t0 // gcd(t0, t1 - t0) AS lo, t1 // gcd(t0, t1 - t0) - 1 AS hi, value FROM runs")
_unit = "CASE WHEN t0 % 86400 = 0 AND t1 % 86400 = 0 THEN 86400 ELSE 3600 END"
_register("calendar_relabel", lambda s, d: coalesce.calendar_ids(_coarse_ev(s, d)), f"{_RUNS} SELECT 4 z, f, x, y, CAST({_unit} AS BIGINT) i, CAST(t0 // ({_unit}) AS BIGINT) lo, CAST(t1 // ({_unit}) - 1 AS BIGINT) hi, value FROM runs")
_register("flat_single_ids", lambda s, d: coalesce.flat_single_ids(_coarse_ev(s, d), CALENDAR[2:]), f"{_RUNS} SELECT 4 z, f, x, y, CAST(3600 AS BIGINT) i, CAST(k AS BIGINT) t, value FROM runs, LATERAL (SELECT unnest(range(t0 // 3600, t1 // 3600)) AS k)")
_register("timed_merge_sum", lambda s, d: sets.merge(cells_ev(s, d), cells_ev(s, d).over(cells_ev(s, d).df.where("value > 60")), 0, SUM), "SELECT 12 z, f, x, y, t0, t1, CAST(value + CASE WHEN value > 60 THEN value ELSE 0 END AS BIGINT) AS value FROM cells_ev")

# Plans -----------------------------------------------------------------------------------------------------------------------

_LAZY = Range(12, f=(-1, 0), x=(3, 40), y=(0, 3))


def _chain(q: Query) -> Query:
    return q.shift_x(16, 2).falloff_x(16, 2, "upper", LINEAR, SUM).shift_f(16, 1)


_LAZY_SQL = f"""SELECT 16 z, f, x, y, value FROM (SELECT CAST(f + 1 AS INT) f, CAST((x + 2 + d) % 65536 AS INT) x, y, CAST(sum((value * (2 - d)) // 2) AS BIGINT) AS value
    FROM cells_li , range(0, 3) r(d) GROUP BY 1, 2, 3) q WHERE {_IN_TARGET}"""
_register("lazy_get", lambda s, d: _chain(Query.of(cells_li(s, d))).lazy_get(_LAZY), _LAZY_SQL)
_register(
    "lazy_get_default",
    lambda s, d: _chain(Query.of(cells_li(s, d))).lazy_get_with_default(Range(16, f=(-3, 4), x=(48, 200), y=(0, 63)), 0),
    f"""SELECT 16 z, CAST(a AS INT) f, CAST(b AS INT) x, CAST(c AS INT) y, coalesce(value, 0) AS value FROM (SELECT a, b, c FROM range(-3, 5) p(a), range(48, 201) q(b), range(0, 64) r(c)) t
    LEFT JOIN ({_LAZY_SQL.replace(_IN_TARGET, "true")}) v ON v.f = a AND v.x = b AND v.y = c""",
)


def risk_diffusion(spark: SparkSession, sf_dir: str) -> VoxelFrame:
    """The flagship workflow: coarsen, then spread upward and along both horizontal axes."""
    q = Query.of(cells_li(spark, sf_dir)).zoom_out(14, MAX)
    return q.falloff_f(14, 2, "upper", LINEAR, MAX).falloff_x(14, 2, "both", LINEAR, MAX).falloff_y(14, 2, "both", LINEAR, MAX).run()


_register("risk_diffusion", risk_diffusion, """
    WITH z14 AS (SELECT f >> 2 AS f, x >> 2 AS x, y >> 2 AS y, max(value) AS value FROM cells_li GROUP BY 1, 2, 3),
    a AS (SELECT f + d AS f, x, y, max((value * (2 - d)) // 2) AS value FROM z14, range(0, 3) r(d) GROUP BY 1, 2, 3),
    b AS (SELECT f, ((x + d) % 16384 + 16384) % 16384 AS x, y, max((value * (2 - abs(d))) // 2) AS value FROM a, range(-2, 3) r(d) GROUP BY 1, 2, 3),
    c AS (SELECT f, x, y + d AS y, max((value * (2 - abs(d))) // 2) AS value FROM b, range(-2, 3) r(d) GROUP BY 1, 2, 3)
    SELECT 14 z, CAST(f AS INT) f, CAST(x AS INT) x, CAST(y AS INT) y, CAST(value AS BIGINT) AS value FROM c WHERE y BETWEEN 0 AND 16383""")

_register(
    "falloff_chain",
    lambda s, d: Query.of(cells_li(s, d)).falloff_f(16, 2, "upper", LINEAR, MAX).falloff_x(16, 2, "both", LINEAR, MAX).falloff_y(16, 2, "both", LINEAR, MAX).run(),
    """
    WITH a AS (SELECT f + d AS f, x, y, max((value * (2 - d)) // 2) AS value FROM cells_li, range(0, 3) r(d) GROUP BY 1, 2, 3),
    b AS (SELECT f, ((x + d) % 65536 + 65536) % 65536 AS x, y, max((value * (2 - abs(d))) // 2) AS value FROM a, range(-2, 3) r(d) GROUP BY 1, 2, 3),
    c AS (SELECT f, x, y + d AS y, max((value * (2 - abs(d))) // 2) AS value FROM b, range(-2, 3) r(d) GROUP BY 1, 2, 3)
    SELECT 16 z, CAST(f AS INT) f, CAST(x AS INT) x, CAST(y AS INT) y, CAST(value AS BIGINT) AS value FROM c WHERE y BETWEEN 0 AND 65535""",
)

# Geometry --------------------------------------------------------------------------------------------------------------------


def _point() -> list[Column]:
    return [F.col("lat"), F.col("lon"), F.col("alt")]


_RAD = "lat * pi() / 180"
_register("point_to_cell", lambda s, d: C.cover_points(points_cust(s, d), 18).select("c_custkey", "z", "f", "x", "y"), f"SELECT c_custkey, 18 z, CAST(floor(alt / 128.0) AS INT) f, CAST(least(floor((lon + 180) / 360 * 262144), 262143) AS INT) x, CAST(floor((1 - ln(tan({_RAD}) + 1 / cos({_RAD})) / pi()) / 2 * 262144) AS INT) y FROM points_cust")
_DEG = "180 / pi()"
_register("cell_center", lambda s, d: _cells(s, d).select("f", "x", "y", P.center(*_cell()).alias("c")).select("f", "x", "y", F.round("c.lat", 9).alias("lat"), F.round("c.lon", 9).alias("lon"), F.round("c.alt", 6).alias("alt")), f"SELECT f, x, y, round(atan(sinh(pi() * (1 - 2 * (y + 0.5) / 65536))) * {_DEG}, 9) AS lat, round(360.0 * (x + 0.5) / 65536 - 180, 9) AS lon, round((f + 0.5) * 512, 6) AS alt FROM cells_li")
_PHI = "atan(sinh(pi() * (1 - 2 * (y + 0.5) / 65536)))"
_register("cell_size", lambda s, d: _cells(s, d).select("f", "x", "y", P.length_f(F.col("z")).alias("length_f"), F.round(P.length_xy(*_cell()), 5).alias("length_xy")), f"SELECT f, x, y, 512.0::DOUBLE AS length_f, round((6378137.0 / sqrt(1 - 0.0066943799901413165 * sin({_PHI}) ** 2) + (f + 0.5) * 512) * cos({_PHI}) * 2 * pi() / 65536, 5) AS length_xy FROM cells_li")


def _ecef(s, d) -> DataFrame:
    p = points_cust(s, d).select("c_custkey", P.ecef(*_point()).alias("e"))
    origin = F.struct(F.lit(6378137.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return p.select("c_custkey", *[F.round(f"e.{k}", 4).alias(f"e{k}") for k in "xyz"], F.round(P.distance(F.col("e"), origin), 4).alias("distance"))


_E2 = "0.0066943799901413165"
_register("ecef_distance", _ecef, f"""
    WITH e AS (SELECT c_custkey, lat * pi() / 180 AS p, lon * pi() / 180 AS q, alt, 6378137.0 / sqrt(1 - {_E2} * sin(lat * pi() / 180) ** 2) AS n FROM points_cust),
    g AS (SELECT c_custkey, (n + alt) * cos(p) * cos(q) AS ex, (n + alt) * cos(p) * sin(q) AS ey, (n * (1 - {_E2}) + alt) * sin(p) AS ez FROM e)
    SELECT c_custkey, round(ex, 4) ex, round(ey, 4) ey, round(ez, 4) ez, round(sqrt((ex - 6378137.0) ** 2 + ey ** 2 + ez ** 2), 4) AS distance FROM g""")
_register("ecef_round_trip", lambda s, d: points_cust(s, d).select("c_custkey", *_point(), P.ecef(*_point()).alias("e")).select("c_custkey", P.from_ecef(F.col("e.x"), F.col("e.y"), F.col("e.z")).alias("c")).select("c_custkey", F.round("c.lat", 6).alias("lat"), F.round("c.lon", 6).alias("lon"), F.round("c.alt", 2).alias("alt")), "SELECT c_custkey, round(lat, 6) lat, round(lon, 6) lon, round(alt, 2) alt FROM points_cust")


def _corners(s, d) -> DataFrame:
    """``shape_id, p``: the earth-centred corners of the triangles."""
    return shape_table(s, d, "triangle", 3).select("shape_id", F.transform("points", lambda p: P.ecef(p["lat"], p["lon"], p["alt"])).alias("p"))


def _ecef_sql(lat: str, lon: str, alt: str) -> str:
    """x, y and z of coordinates in radians, as a DuckDB list."""
    n = f"(6378137.0 / sqrt(1 - {_E2} * sin({lat}) ** 2))"
    return f"[({n} + ({alt})) * cos({lat}) * cos({lon}), ({n} + ({alt})) * cos({lat}) * sin({lon}), ({n} * (1 - {_E2}) + ({alt})) * sin({lat})]"


_CORNERS = "k AS (SELECT c_custkey AS shape_id, i, (lat + 0.0007 * sin(2.4 * i) * i) * pi() / 180 AS p, (lon * 0.99 + 0.0009 * cos(1.7 * i) * i) * pi() / 180 AS q, c_custkey % 50 + 10.0 * i AS h FROM points_cust, range(0, 3) r(i))"
_SIDES = f"""WITH {_CORNERS}, e AS (SELECT shape_id, i, {_ecef_sql("p", "q", "h")} AS e FROM k),
    t AS (SELECT a.shape_id, list_distance(a.e, b.e) AS ab, list_distance(b.e, c.e) AS bc, list_distance(c.e, a.e) AS ca FROM e a JOIN e b USING (shape_id) JOIN e c USING (shape_id) WHERE a.i = 0 AND b.i = 1 AND c.i = 2),
    h AS (SELECT *, (ab + bc + ca) / 2 AS s FROM t), g AS (SELECT *, sqrt(s * (s - ab) * (s - bc) * (s - ca)) AS area FROM h)"""
_register("triangle_area", lambda s, d: _corners(s, d).select("shape_id", F.round(P.triangle_area(F.col("p")[0], F.col("p")[1], F.col("p")[2]), 2).alias("area")), f"{_SIDES} SELECT shape_id, round(area, 2) AS area FROM g")
_register("triangle_sides", lambda s, d: _corners(s, d).select("shape_id", P.triangle_sides(F.col("p")[0], F.col("p")[1], F.col("p")[2]).alias("l")).select("shape_id", *[F.round(F.col("l")[k], 4).alias(n) for k, n in enumerate(("ab", "bc", "ca"))]), f"{_SIDES} SELECT shape_id, round(ab, 4) ab, round(bc, 4) bc, round(ca, 4) ca FROM g")
_register(
    "triangle_parts",
    lambda s, d: _corners(s, d).select("shape_id", F.posexplode(P.triangle_parts(F.col("p")[0], F.col("p")[1], F.col("p")[2], 3)).alias("part", "c")).select("shape_id", "part", F.round(P.triangle_area(F.col("c")[0], F.col("c")[1], F.col("c")[2]), 2).alias("area")),
    f"{_SIDES} SELECT shape_id, CAST(n AS INT) AS part, round(area / 9, 2) AS area FROM g, range(0, 9) r(n)",
)
_register(
    "vector_algebra",
    lambda s, d: points_cust(s, d).select("c_custkey", P.ecef(*_point()).alias("e"), F.struct(F.lit(1.0).alias("x"), F.lit(-2.0).alias("y"), F.lit(0.5).alias("z")).alias("w"))
    .select("c_custkey", "e", "w", P.cross(F.col("e"), F.col("w")).alias("c"), P.normalized(F.col("e")).alias("n"), P.orthonormal_basis(F.col("e")).alias("b"))
    .select(
        "c_custkey", F.round(P.dot(F.col("e"), F.col("w")), 3).alias("dot"), *[F.round(f"c.{k}", 3).alias(f"c{k}") for k in "xyz"], *[(F.round(f"n.{k}", 9) + 0.0).alias(f"n{k}") for k in "xyz"],
        *[(F.round(f"b.u.{k}", 9) + 0.0).alias(f"u{k}") for k in "xy"], (F.round(P.dot(F.col("b.v"), F.col("e")), 6) + 0.0).alias("across"), F.round("b.v.z", 9).alias("vz"), F.round(P.norm(F.col("e")), 3).alias("norm"),
        F.round(P.project_2d(F.col("e"), "z", "x")["u"], 3).alias("pz"),
    ),
    f"""WITH e AS (SELECT c_custkey, {_ecef_sql("lat * pi() / 180", "lon * pi() / 180", "alt")} AS e FROM points_cust),
        v AS (SELECT c_custkey, e[1] AS x, e[2] AS y, e[3] AS z, sqrt(e[1] ** 2 + e[2] ** 2) AS r, sqrt(e[1] ** 2 + e[2] ** 2 + e[3] ** 2) AS l FROM e)
        SELECT c_custkey, round(x - 2 * y + 0.5 * z, 3) AS dot, round(0.5 * y + 2 * z, 3) cx, round(z - 0.5 * x, 3) cy, round(-2 * x - y, 3) cz, round(x / l, 9) + 0 nx, round(y / l, 9) + 0 ny, round(z / l, 9) + 0 nz,
        round(-y / r, 9) + 0 ux, round(x / r, 9) + 0 uy, 0.0::DOUBLE AS across, round(r / l, 9) vz, round(l, 3) AS norm, round(z, 3) AS pz FROM v""",
)
_register(
    "ecef_points_cover",
    lambda s, d: C.cover_ecef_points(points_cust(s, d).select("c_custkey", P.ecef(F.col("lat") + 0.00037, F.col("lon") * 0.99 + 0.00013, F.col("alt") + 0.003).alias("e")).select("c_custkey", *[F.col(f"e.{k}").alias(f"e{k}") for k in "xyz"]), 18).select("c_custkey", "z", "f", "x", "y"),
    "SELECT c_custkey, 18 z, CAST(floor((alt + 0.003) / 128.0) AS INT) f, CAST(floor((lon * 0.99 + 0.00013 + 180) / 360 * 262144) AS INT) x, CAST(floor((1 - ln(tan(radians(lat + 0.00037)) + 1 / cos(radians(lat + 0.00037))) / pi()) / 2 * 262144) AS INT) y FROM points_cust",
)
_register("center_of_gravity", lambda s, d: points_cust(s, d).agg(P.center_of_gravity(*_point()).alias("c")).select(*[F.round(f"c.{k}", 6).alias(k) for k in ("lat", "lon", "alt")]), "SELECT round(avg(lat), 6) lat, round(avg(lon), 6) lon, round(avg(alt), 6) alt FROM points_cust")


def shape_table(spark: SparkSession, sf_dir: str, kind: str, n: int) -> DataFrame:
    """Shapes around every customer's point; ``n`` neighbouring corners each."""
    p = points_cust(spark, sf_dir)
    k = F.col("c_custkey")
    corner = [F.struct((F.col("lat") + 0.0007 * math.sin(2.4 * i) * i).alias("lat"), (F.col("lon") * 0.99 + 0.0009 * math.cos(1.7 * i) * i).alias("lon"), (k % 50 + 10.0 * i).cast("double").alias("alt")) for i in range(n)]
    return p.select(k.alias("shape_id"), F.lit(kind).alias("kind"), F.array(*corner).alias("points"), F.lit(None).cast(f"array<array<{C._POINT}>>").alias("faces"), (10.0 + k % 30).alias("radius"))


def solid_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box above every customer's point."""
    p = points_cust(spark, sf_dir)
    at = lambda a, b, c: F.struct((F.col("lat") + 0.001 * a).alias("lat"), (F.col("lon") * 0.99 + 0.001 * b).alias("lon"), F.lit(60.0 * c).alias("alt"))
    ring = lambda *corners: F.array(*[at(*c) for c in corners])
    faces = F.array(
        ring((0, 0, 0), (0, 1, 0), (1, 1, 0), (1, 0, 0)), ring((0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)), ring((0, 0, 0), (1, 0, 0), (1, 0, 1), (0, 0, 1)),
        ring((0, 1, 0), (0, 1, 1), (1, 1, 1), (1, 1, 0)), ring((0, 0, 0), (0, 0, 1), (0, 1, 1), (0, 1, 0)), ring((1, 0, 0), (1, 1, 0), (1, 1, 1), (1, 0, 1)),
    )
    return p.select(F.col("c_custkey").alias("shape_id"), F.lit("solid").alias("kind"), F.lit(None).cast(f"array<{C._POINT}>").alias("points"), faces.alias("faces"), F.lit(None).cast("double").alias("radius"))


_PHI_OF = f"list_reduce(list_transform(range(10), lambda n: 0.0::DOUBLE), lambda p, n: atan2(kz + {_E2} * (6378137.0 / sqrt(1 - {_E2} * sin(p) ** 2)) * sin(p), r), atan2(kz, r * (1 - {_E2})))"
_register(
    "sphere_cover",
    lambda s, d: C.cover_spheres(points_cust(s, d).select(F.col("c_custkey").alias("shape_id"), "lat", (F.col("lon") * 0.99).alias("lon"), F.lit(20.0).alias("alt"), (20.0 + F.col("c_custkey") % 40).alias("radius")), 19),
    f"""WITH e AS (SELECT c_custkey AS shape_id, (20.0 + c_custkey % 40)::DOUBLE AS radius, {_ecef_sql("lat * pi() / 180", "lon * 0.99 * pi() / 180", "20.0")} AS e FROM points_cust),
        k AS (SELECT shape_id, radius, e, e[1] + a * radius AS kx, e[2] + b * radius AS ky, e[3] + c * radius AS kz, sqrt((e[1] + a * radius) ** 2 + (e[2] + b * radius) ** 2) AS r FROM e, (VALUES (1), (-1)) p(a), (VALUES (1), (-1)) q(b), (VALUES (1), (-1)) o(c)),
        l AS (SELECT *, {_PHI_OF} AS p FROM k),
        i AS (SELECT shape_id, radius, e, floor((r / cos(p) - 6378137.0 / sqrt(1 - {_E2} * sin(p) ** 2)) / 64) AS f, floor((atan2(ky, kx) / pi() * 180 + 180) / 360 * 524288) AS x, floor((1 - ln(tan(p) + 1 / cos(p)) / pi()) / 2 * 524288) AS y FROM l),
        b AS (SELECT shape_id, radius, any_value(e) AS e, min(f)::BIGINT AS f0, max(f)::BIGINT AS f1, min(x)::BIGINT AS x0, max(x)::BIGINT AS x1, min(y)::BIGINT AS y0, max(y)::BIGINT AS y1 FROM i GROUP BY 1, 2),
        fs AS (SELECT *, unnest(range(f0, f1 + 1)) AS f FROM b), xs AS (SELECT *, unnest(range(x0, x1 + 1)) AS x FROM fs), ys AS (SELECT *, unnest(range(y0, y1 + 1)) AS y FROM xs)
        SELECT shape_id, 19 z, CAST(f AS INT) f, CAST(x AS INT) x, CAST(y AS INT) y FROM ys
        WHERE list_distance({_ecef_sql("atan(sinh(pi() * (1 - 2 * (y + 0.5) / 524288)))", "(2 * pi() * (x + 0.5) / 524288 - pi())", "(f + 0.5) * 64")}, e) <= radius + 2 * pi() * 6378137.0 / 524288 * sqrt(3) / 2""",
)
_register("line_cover", lambda s, d: C.cover(shape_table(s, d, "line", 2), 20))
_register("triangle_cover", lambda s, d: C.cover(shape_table(s, d, "triangle", 3), 20))
_register("polygon_cover", lambda s, d: C.cover(shape_table(s, d, "polygon", 4), 19))
_register("cylinder_cover", lambda s, d: C.cover(shape_table(s, d, "cylinder", 2), 20))
_register("tube_cover", lambda s, d: C.cover(shape_table(s, d, "tube", 3), 19))
_register("solid_cover", lambda s, d: C.cover(solid_table(s, d), 20))
_register("solid_ranges", lambda s, d: C.cover_ranges(solid_table(s, d), 20))
_register("solid_open_edges", lambda s, d: C.open_edges(solid_table(s, d), 1e-6), "SELECT c_custkey AS shape_id, CAST(0 AS BIGINT) AS open_edges FROM points_cust")

# Storage forms -----------------------------------------------------------------------------------------------------------------

_register("canonical_blocks", lambda s, d: canonicalize(transforms.zoom_out(cells_li(s, d).without_values().over(cells_li(s, d).df.withColumn("value", F.lit(1)), valued=True), 11, MAX)))
_register("canonical_count", lambda s, d: canonicalize(cells_ord(s, d)).agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM cells_ord")
_register("canonical_volume", lambda s, d: canonicalize(transforms.zoom_out(cells_li(s, d), 11, MAX)).groupBy("value").agg(F.sum(F.pow(F.lit(2.0), 33 - F.col("fz") - F.col("xz") - F.col("yz"))).cast("bigint").alias("cells")), "SELECT value, count(*) AS cells FROM (SELECT f >> 5 AS f, x >> 5 AS x, y >> 5 AS y, max(value) AS value FROM cells_li GROUP BY 1, 2, 3) q GROUP BY value")


def _json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame's document parsed again by Spark, as cells."""
    doc = jsonio.document(_coarse_ev(spark, sf_dir))
    found = doc.select(F.from_json("document", jsonio.document_schema("bigint")).alias("d")).select(F.explode("d.data").alias("d"))
    rows = found.select(F.col("d.value").alias("values"), F.explode("d.ids").alias("id"))
    return rows.select("id.z", F.col("id.f")[0].alias("f"), F.col("id.x")[0].alias("x"), F.col("id.y")[0].alias("y"), "id.i", F.col("id.t")[0].alias("lo"), F.element_at("id.t", -1).alias("hi"), F.get("values", F.col("id.ref")).alias("value"))


_register("json_round_trip", _json_round_trip, f"{_RUNS} SELECT 4 z, f, x, y, CAST({_unit} AS BIGINT) i, CAST(t0 // ({_unit}) AS BIGINT) lo, CAST(t1 // ({_unit}) - 1 AS BIGINT) hi, value FROM runs")


def _stored(frame: VoxelFrame, read) -> DataFrame | VoxelFrame:
    """``read(path)`` of the frame's document."""
    path = tables.working_folder(frame.df.sparkSession)
    jsonio.write_document(frame, path)
    return read(path)


_register("document_read", lambda s, d: _stored(_coarse_ev(s, d), lambda path: jsonio.read_frame(s, path, 4)), f"{_RUNS} SELECT 4 z, f, x, y, t0, t1, value FROM runs")
_Z11 = "CAST(f >> 5 AS INT) f, CAST(x >> 5 AS INT) x, CAST(y >> 5 AS INT) y"
_ALWAYS = "CAST(0 AS BIGINT) t0, CAST(34359738368 AS BIGINT) t1"
_register("document_read_set", lambda s, d: _stored(transforms.zoom_out(cells_li(s, d), 11, MAX).without_values(), lambda path: jsonio.read_frame(s, path, 11, None)), f"SELECT DISTINCT 11 z, {_Z11}, {_ALWAYS} FROM cells_li")
_register("document_read_untimed", lambda s, d: _stored(transforms.map_values(transforms.zoom_out(cells_li(s, d), 11, MAX), lambda v: (v / 10).cast("bigint")), lambda path: jsonio.read_frame(s, path, 11)), f"SELECT 11 z, {_Z11}, {_ALWAYS}, max(value) // 10 AS value FROM cells_li GROUP BY 2, 3, 4")


def _stored_cells(s, d) -> VoxelFrame:
    path = tables.working_folder(s)
    tables.write_cells(cells_li(s, d), path, 8)
    return Query.of(tables.CellTable(s, path, 16, 8), "stored").shift_x(16, 2).lazy_get(_LAZY)


def _stored_blocks(s, d) -> DataFrame:
    path = tables.working_folder(s)
    tables.write_blocks(to_blocks(cells_li(s, d)), path)
    return tables.read_blocks(s, path)


_register("stored_cells", _stored_cells, f"SELECT 16 z, * FROM (SELECT f, CAST(x + 2 AS INT) x, y, value FROM cells_li) q WHERE {_IN_TARGET}")
_register("stored_blocks", _stored_blocks, f"SELECT {_BLOCK} FROM cells_li")

_PATTERNS = {
    "dense": "id // 484, id // 22 % 22, id % 22",
    "linear": "0, id, id",
    "clusters": "id % 1250 // 121, id % 1250 // 11 % 11 + id // 1250 % 4 * 44, id % 1250 % 11 + id // 5000 * 44",
    "layered": "id // 1000 * 5, id % 1000 // 32, id % 1000 % 32",
    "checkerboard": "id // 22 // 44, id // 22 % 44, id % 22 * 2 + (id // 22 // 44 + id // 22 % 44) % 2",
}


def _patterns(s, d) -> DataFrame:
    every = [generators.pattern(s, kind, 10_000).select(F.lit(kind).alias("kind"), "*") for kind in _PATTERNS]
    out = every[0]
    for one in every[1:]:
        out = out.unionByName(one)
    return out


_register("generated_patterns", _patterns, " UNION ALL ".join(
    "SELECT '{}' AS kind, id, CAST({} AS INT) f, CAST({} AS INT) x, CAST({} AS INT) y FROM range(0, 10000) r(id)".format(kind, *sql.split(", "))
    for kind, sql in _PATTERNS.items()
))

# Keys, halves, shards ----------------------------------------------------------------------------------------------------------

_KEY_BITS = "list_sum(list_transform(range(0, 16), lambda i: (((f + 65536) >> i & 1) * 4 + (x >> i & 1) * 2 + (y >> i & 1))::HUGEINT << (3 * i)))::HUGEINT + (((f + 65536) >> 16 & 1)::HUGEINT << 48)"
_register(
    "cell_keys",
    lambda s, d: _cells(s, d).select("f", "x", "y", F.hex(codecs.cell_key(*_cell())).alias("key"), F.hex(codecs.cell_key_max(*_cell())).alias("key_max")),
    f"SELECT f, x, y, lpad(to_hex((({_KEY_BITS})::HUGEINT << 47) + 16), 24, '0') AS key, lpad(to_hex((({_KEY_BITS})::HUGEINT << 47) + (((1::HUGEINT << 42) - 1) << 5)), 24, '0') AS key_max FROM cells_li",
)
_register(
    "block_halves",
    lambda s, d: flex.halved(flex.halved(to_blocks(cells_li(s, d)), "y", True), "t", False),
    "SELECT 16 AS fz, f AS fi, 16 AS xz, x AS xi, 17 AS yz, y * 2 + 1 AS yi, 1 AS tz, CAST(0 AS BIGINT) AS ti, value FROM cells_li",
)
_register(
    "block_difference",
    lambda s, d: to_blocks(cells_li(s, d)).select(F.struct(*[(F.lit(14) if c[1] == "z" else F.shiftright(c, 2)).alias(c) if c[0] != "t" else F.col(c) for c in flex.FLEX]).alias("a"), F.struct(*flex.FLEX).alias("b")).select(F.explode(flex.difference_column(F.col("a"), F.col("b"))).alias("c")).select("c.*"),
    " UNION ALL ".join(
        f"SELECT {fz} fz, CAST({fi} AS INT) fi, {xz} xz, CAST({xi} AS INT) xi, {yz} yz, CAST({yi} AS INT) yi, 0 AS tz, CAST(0 AS BIGINT) AS ti FROM cells_li"
        for fz, fi, xz, xi, yz, yi in (
            (15, "xor(f >> 1, 1)", 14, "x >> 2", 14, "y >> 2"), (16, "xor(f, 1)", 14, "x >> 2", 14, "y >> 2"), (16, "f", 15, "xor(x >> 1, 1)", 14, "y >> 2"),
            (16, "f", 16, "xor(x, 1)", 14, "y >> 2"), (16, "f", 16, "x", 15, "xor(y >> 1, 1)"), (16, "f", 16, "x", 16, "xor(y, 1)"),
        )
    ),
)
_REGION: shards.Region = {"f": (14, 0), "x": (8, 0), "y": (11, 0)}
_IN_REGION = "f BETWEEN 0 AND 3 AND x BETWEEN 0 AND 255 AND y BETWEEN 0 AND 31"
_register("in_shard", lambda s, d: shards.in_shard(cells_li(s, d), _REGION), f"SELECT 16 z, * FROM cells_li WHERE {_IN_REGION}")


def _shard_halves(s, d) -> DataFrame:
    low, high = (half.cells().withColumn("half", F.lit(k)) for k, (_, half) in enumerate(shards.split_shard(cells_li(s, d), _REGION)))
    return low.unionByName(high)


_register("split_shard", _shard_halves, f"SELECT 16 z, *, CASE WHEN x < 128 THEN 0 ELSE 1 END AS half FROM cells_li WHERE {_IN_REGION}")
_register("merge_shards", lambda s, d: shards.merge_shards(_REGION, shards.split_shard(cells_li(s, d), _REGION)), f"SELECT 16 z, * FROM cells_li WHERE {_IN_REGION}")

# Steps, sources and policies of one's own ----------------------------------------------------------------------------------------


class _Rolling(MergePolicy):
    """Depends on the order of its values."""

    name = "Rolling"

    def resolve(self, a, b, kind):
        return (a * 31 + b) % 1009


class _Scaled(UnaryOp):
    def run(self, frame):
        return transforms.map_values(frame, lambda v: v * 10)


class _Later(BinaryOp):
    def run(self, left, right):
        return sets.merge_with(left, right, lambda a, b: a - b)


class _Returned:
    """A source that reads itself."""

    def __init__(self, spark, sf_dir):
        self.of = spark, sf_dir

    def read(self, ranges=None):
        frame = cells_li_b(*self.of)
        return frame if ranges is None else lookups.get_overlapping(frame, ranges)


_register("zoom_out_custom", _on(cells_ord, lambda q: q.zoom_out(14, _Rolling())), _zoom_sql("cells_ord", 14, 6, "list_reduce(list(value ORDER BY f, x, y), lambda a, b: (a * 31 + b) % 1009)"))
_register("custom_steps", lambda s, d: Query.of(cells_li(s, d)).then(_Scaled()).with_other(_Later(), Query.of(_Returned(s, d), "returned")).run(), f"SELECT 16 z, f, x, y, CASE WHEN va IS NULL THEN vb WHEN vb IS NULL THEN va * 10 ELSE va * 10 - vb END AS value FROM {_FULL}")
_register("raw_run", lambda s, d: _chain(Query.of(cells_li(s, d))).raw_run(), _LAZY_SQL.replace(_IN_TARGET, "true"))
_register("map_in_place", lambda s, d: writes.map_in_place(cells_li(s, d), lambda v: v * v), "SELECT 16 z, f, x, y, value * value AS value FROM cells_li")
_register("clear", lambda s, d: writes.clear(cells_li(s, d)), "SELECT 16 z, * FROM cells_li WHERE false")
_register("is_empty", lambda s, d: lookups.is_empty(cells_li(s, d)).unionByName(lookups.is_empty(writes.clear(cells_li(s, d)))), "SELECT count(*) = 0 AS is_empty FROM cells_li UNION ALL SELECT true")
_register("relabel_time", lambda s, d: _spans(s, d).select("event_id", ids.relabel_time(F.lit(3600).cast("long"), (F.col("t0") / 3600).cast("long"), 3600).alias("c"), ids.without_time().alias("w")).select("event_id", "c.*", F.col("w.i").alias("whole"), F.col("w.t").alias("first")), f"SELECT event_id, CAST(3600 AS BIGINT) i, CAST(t0 // 3600 AS BIGINT) t, CAST(34359738368 AS BIGINT) AS whole, CAST(0 AS BIGINT) AS first FROM ({_SPAN})")
_register("time_span", lambda s, d: _spans(s, d).select("event_id", timeaxis.span((F.col("t0") / 3600).cast("long"), 3600).alias("c")).select("event_id", "c.*"), f"SELECT event_id, CAST(t0 AS BIGINT) t0, CAST(t0 + 3600 AS BIGINT) t1 FROM ({_SPAN})")
_register("expand_coordinates", lambda s, d: C.expand_coordinates(shape_table(s, d, "tube", 3)).select("shape_id", "part", *[F.round(c, 9).alias(c) for c in ("lat", "lon", "alt")]), "SELECT c_custkey AS shape_id, CAST(i AS INT) AS part, round(lat + 0.0007 * sin(2.4 * i) * i, 9) lat, round(lon * 0.99 + 0.0009 * cos(1.7 * i) * i, 9) lon, round(c_custkey % 50 + 10.0::DOUBLE * i, 9) alt FROM points_cust, range(0, 3) r(i)")
_register("expand_lines", lambda s, d: C.expand_lines(shape_table(s, d, "triangle", 3)).select("shape_id", "part", F.round("a.alt", 6).alias("a"), F.round("b.alt", 6).alias("b")), "SELECT c_custkey AS shape_id, CAST(i AS INT) AS part, round(c_custkey % 50 + 10.0::DOUBLE * i, 6) a, round(c_custkey % 50 + 10.0::DOUBLE * ((i + 1) % 3), 6) b FROM points_cust, range(0, 3) r(i)")
_register("expand_polygons", lambda s, d: C.expand_polygons(solid_table(s, d)).select("shape_id", "part", F.size("ring").alias("corners")), "SELECT c_custkey AS shape_id, CAST(i AS INT) AS part, 4 AS corners FROM points_cust, range(0, 6) r(i)")
