import random

import pytest
from helpers import along_x, as_dict, frame

from voxlattice.errors import Cancelled
from voxlattice.operators.lookups import Range
from voxlattice.operators.policies import AVERAGE, MAX, MIN, SUM
from voxlattice.operators.transforms import LINEAR
from voxlattice.plans import optimizer
from voxlattice.plans.nodes import BinaryOp, Extrude, Falloff, Shift, UnaryOp
from voxlattice.plans.query import CancellationToken, Query


def test_optimized_equals_raw(spark):
    q = Query.of(frame(spark, [(0, 100, 100, 4)], z=10)).shift_x(10, 3).shift_y(10, 4).shift_f(10, 1).falloff_x(10, 2, "both", LINEAR, SUM)
    assert as_dict(q.run()) == as_dict(q.raw_run())


def test_commuting_extrudes_run_by_cost():
    ops = [Extrude("f", 10, 0, 20, MAX), Extrude("x", 10, 0, 2, MAX), Extrude("y", 10, 0, 10, MAX)]
    assert [o.expansion() for o in optimizer.ordered(ops)] == [3, 11, 21]
    assert [o.axis for o in optimizer.ordered([Extrude("f", 10, 0, 20, AVERAGE), Extrude("x", 10, 0, 2, AVERAGE)])] == ["f", "x"]


def test_what_commutes():
    fall = Falloff("y", 10, 2, "both", LINEAR, MAX)
    assert [len(g) for g in optimizer.commuting_groups([fall, Shift("x", 10, 1)])] == [2]
    assert [len(g) for g in optimizer.commuting_groups([fall, Shift("y", 10, 1)])] == [1, 1]
    assert [len(g) for g in optimizer.commuting_groups([fall, Falloff("x", 10, 2, "both", LINEAR, MAX)])] == [1, 1]


def test_noops_go_and_the_plan_prints(spark):
    q = Query.of(frame(spark, [(0, 1, 1, 1)])).shift_x(20, 0).falloff_y(20, 0, "both", LINEAR, MAX).shift_x(20, 2)
    assert q.explain_optimized().splitlines() == ["shift_x(z=20, n=2)", "  Source(frame)"]
    assert len(q.explain().splitlines()) == 4


def test_merge(spark):
    a, b = frame(spark, [(0, 100, 0, 7), (0, 101, 0, 3)]), frame(spark, [(0, 101, 0, 4), (0, 102, 0, 5)])
    q = Query.of(a).merge(Query.of(b), 0, SUM)
    assert along_x(q.run()) == {100: 7, 101: 7, 102: 5}
    assert along_x(q.lazy_get(Range(20, x=(101, 102)))) == {101: 7, 102: 5}
    assert Query.of(a.over(a.df.limit(0))).merge(Query.of(b.over(b.df.limit(0))), 0, SUM).run().df.isEmpty()
    assert along_x(Query.of(a).intersection(Query.of(b)).run()) == {101: 3}
    assert along_x(Query.of(a).difference(Query.of(b)).run()) == {100: 7}


def test_lazy_get(spark):
    q = Query.of(frame(spark, [(10, 10, 10, 42)], z=10)).shift_x(10, 1).shift_y(10, 2)
    assert as_dict(q.lazy_get(Range(10, (10, 10), (11, 11), (12, 12)))) == {(10, 11, 12): 42}
    got = as_dict(Query.of(frame(spark, [(10, 10, 10, 100)], z=10)).lazy_get_with_default(Range(10, (10, 10), (10, 11), (10, 10)), 0))
    assert got == {(10, 10, 10): 100, (10, 11, 10): 0}


def test_lazy_get_around_the_seam(spark):
    q = Query.of(frame(spark, [(0, 3, 0, 7)], z=2)).shift_x(2, 1)
    assert along_x(q.lazy_get(Range(1, x=(1, 0)))) == along_x(q.run()) == {0: 7}


def test_lazy_get_of_cells_off_the_axis(spark):
    q = Query.of(frame(spark, [(0, 20, 0, 4), (0, 16 + 3, 0, 7), (0, -10, 0, 9)], z=4)).shift_x(4, 1).falloff_x(4, 2, "upper", LINEAR, SUM)
    whole, part = along_x(q.run()), Range(4, x=(4, 6))
    assert along_x(q.lazy_get(part)) == {x: v for x, v in whole.items() if 4 <= x <= 6} == {4: 7, 5: 7, 6: 2}
    assert along_x(q.lazy_get_with_default(Range(4, f=(0, 0), x=(4, 6), y=(0, 0)), 0)) == {4: 7, 5: 7, 6: 2}
    assert along_x(Query.of(frame(spark, [(0, 20, 0, 4)], z=4)).lazy_get(part)) == {}


@pytest.mark.parametrize("seed", range(5))
def test_within_equals_clipped_run(spark, seed):
    rng = random.Random(seed)
    cells = {(rng.randint(-4, 4), rng.randint(0, 15), rng.randint(5, 10)): rng.randint(1, 100) for _ in range(15)}
    q = Query.of(frame(spark, [(*k, v) for k, v in cells.items()], z=4))
    for _ in range(2):
        step = rng.randrange(4)
        axis = rng.choice("fxy")
        if step == 0:
            q = getattr(q, f"shift_{axis}")(4, rng.randint(-2, 2))
        elif step == 1:
            q = getattr(q, f"falloff_{axis}")(4, 2, rng.choice(("both", "upper", "lower")), LINEAR, rng.choice((MAX, MIN, SUM)))
        elif step == 2:
            q = getattr(q, f"extrude_{axis}")(4, 2, 6, SUM)
        else:
            q = q.zoom_out(3, SUM)
    target = Range(4, (-2, 3), (12, 4), (3, 9))
    full = as_dict(q.run())
    part = as_dict(q.run_within([target]))
    from voxlattice.operators.lookups import get_overlapping

    assert part == as_dict(get_overlapping(q.run(), [target]))
    assert set(part) <= set(full)


def test_demand_reaches_the_scan(spark, tmp_path):
    from voxlattice.sources.tables import CellTable, write_cells

    f = frame(spark, [(0, x, y, x + y) for x in range(0, 1024, 64) for y in range(0, 1024, 64)], z=10)
    write_cells(f, str(tmp_path / "t"))
    table = CellTable(spark, str(tmp_path / "t"), 10)
    q = Query.of(table).shift_x(10, 64)
    part = q.run_within([Range(10, x=(128, 255), y=(0, 63))])
    assert as_dict(part) == {(0, 128, 0): 64, (0, 192, 0): 128}
    plan = part.df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "sx" in plan.split("PartitionFilters")[1][:200]
    assert as_dict(Query.of(table).run()) == as_dict(f)


def test_own_operators(spark):
    class Mirror(UnaryOp):
        def run(self, frame):
            return frame.over(frame.df.withColumn("x", (1 << frame.z) - 1 - frame.df.x))

    class Left(BinaryOp):
        def run(self, left, right):
            return left

    f = frame(spark, [(0, 1, 0, 5)], z=3)
    assert along_x(Query.of(f).then(Mirror()).run()) == {6: 5}
    assert along_x(Query.of(f).with_other(Left(), Query.of(f).then(Mirror())).run()) == {1: 5}


def test_cancellation(spark):
    token = CancellationToken(spark)
    assert token.run(lambda: spark.range(3).count()) == 3
    token.cancel()
    with pytest.raises(Cancelled):
        token.run(lambda: spark.range(3).count())


def test_falloffs_in_a_row_share_one_exchange(spark):
    cells = [(f, x, y, 7 * (f + x) + y) for f in (-2, 0, 1) for x in (0, 1, 63, 64, 255) for y in (0, 63, 64, 130, 255)]
    f = frame(spark, cells, z=8)
    q = Query.of(f).falloff_f(8, 2, "upper", LINEAR, MAX).falloff_x(8, 3, "both", LINEAR, MAX).falloff_y(7, 1, "both", LINEAR, SUM).falloff_x(8, 2, "lower", LINEAR, SUM)
    single = f
    for op in nodes_of(q):
        single = op.run(single)
    assert as_dict(q.run()) == as_dict(single)
    assert q.run().df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def nodes_of(q):
    ops, node = [], q.node
    while hasattr(node, "op"):
        ops, node = [node.op, *ops], node.input
    return ops


def test_tasks_follow_the_input(spark, tmp_path, monkeypatch):
    from voxlattice import frame as frames
    from voxlattice.sources import views

    spark.range(50_000).selectExpr("id % 7 + 1 AS l_linenumber", "id % 900 AS l_partkey", "id % 800 AS l_suppkey", "id % 50 AS l_quantity", "'R' AS l_returnflag").write.parquet(str(tmp_path / "lineitem.parquet"))
    tasks = lambda f: f.df.rdd.getNumPartitions()
    few = as_dict(views.cells_li(spark, str(tmp_path)))
    assert frames.tasks_for(views.cells_li(spark, str(tmp_path)).df) is None
    monkeypatch.setattr(frames, "TASK_BYTES", 2048)
    many = views.cells_li(spark, str(tmp_path))
    assert tasks(many) >= 20 and as_dict(many) == few
    assert tasks(Query.of(many).falloff_x(16, 2, "both", LINEAR, SUM).run()) >= 4 * tasks(many)


def test_tasks_of_coarsenings_follow_the_input(spark, tmp_path, monkeypatch):
    from voxlattice import frame as frames
    from voxlattice import queries
    from voxlattice.operators import transforms
    from voxlattice.sources import views

    spark.range(50_000).selectExpr("id % 7 + 1 AS l_linenumber", "id % 900 AS l_partkey", "id % 800 AS l_suppkey", "id % 50 AS l_quantity", "'R' AS l_returnflag").write.parquet(str(tmp_path / "lineitem.parquet"))

    def coarse():
        f = views.cells_li(spark, str(tmp_path))
        outs = [transforms.zoom_out(f, 12, MAX).cells(), transforms.zoom_out(f, 4, AVERAGE).cells(), transforms.pyramid(f, [10, 12, 14], MAX), transforms.pyramid(f, [4, 14], AVERAGE), queries.QUERIES["block_ancestors"](spark, str(tmp_path))]
        return [sorted(map(tuple, df.collect())) for df in outs], [df.rdd.getNumPartitions() for df in outs]

    few, _ = coarse()
    monkeypatch.setattr(frames, "TASK_BYTES", 2048)
    many, tasks = coarse()
    assert many == few
    assert min(tasks[0], tasks[4]) >= 20 and tasks[2] >= 3 * tasks[0] - 3


def test_directories_follow_the_size(spark, tmp_path):
    from voxlattice.sources.tables import CellTable, write_cells

    f = frame(spark, [(0, x, y, x + y) for x in range(0, 4096, 128) for y in range(0, 4096, 128)], z=12)
    write_cells(f, str(tmp_path / "t"), 8)
    assert len(list((tmp_path / "t").glob("sz=*/sx=*/sy=*"))) <= 64
    table = CellTable(spark, str(tmp_path / "t"), 12, 8)
    target = Range(12, x=(3000, 200), y=(100, 700))
    assert as_dict(Query.of(table).lazy_get(target)) == {k: v for k, v in as_dict(f).items() if (k[1] >= 3000 or k[1] <= 200) and 100 <= k[2] <= 700}
    # A table of before, without ``sz``.
    f.cells().selectExpr("*", "shiftright(x, 4) AS sx", "shiftright(y, 4) AS sy").where("x % 1024 = 0 and y % 1024 = 0").write.partitionBy("sx", "sy").parquet(str(tmp_path / "old"))
    assert set(as_dict(Query.of(CellTable(spark, str(tmp_path / "old"), 12, 8)).lazy_get(Range(12, x=(3000, 200), y=(1000, 2000))))) == {(0, 0, 1024), (0, 3072, 1024)}
