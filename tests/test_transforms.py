import random

import pytest
from helpers import along_x, as_dict, frame
from pyspark.sql import functions as F

from voxlattice.domain import limits
from voxlattice.errors import InvalidQueryParameter, SpatialError
from voxlattice.operators.policies import AVERAGE, DIFFERENCE, KEEP_EXISTING, MAX, MIN, OVERWRITE, SUM, MergePolicy
from voxlattice.operators.transforms import LINEAR, QUADRATIC_IN, QUADRATIC_OUT, Bound, inside, outside
from voxlattice.plans.query import Query


def test_falloff_single(spark):
    q = Query.of(frame(spark, [(0, 100, 0, 4)])).falloff_x(20, 2, "both", LINEAR, SUM)
    assert along_x(q.run()) == {98: 0, 99: 2, 100: 4, 101: 2, 102: 0}


@pytest.mark.parametrize("policy, expected", [(SUM, {98: 0, 99: 2, 100: 4, 101: 4, 102: 4, 103: 2, 104: 0}), (MAX, {98: 0, 99: 2, 100: 4, 101: 2, 102: 4, 103: 2, 104: 0})])
def test_falloff_overlap(spark, policy, expected):
    q = Query.of(frame(spark, [(0, 100, 0, 4), (0, 102, 0, 4)])).falloff_x(20, 2, "both", LINEAR, policy)
    assert along_x(q.run()) == expected


def test_falloff_radius_zero_is_the_input(spark):
    assert along_x(Query.of(frame(spark, [(0, 100, 0, 7)])).falloff_x(20, 0, "both", LINEAR, SUM).run()) == {100: 7}


def test_falloff_clips_y_and_wraps_x(spark):
    q = Query.of(frame(spark, [(0, 0, 0, 4)], z=3))
    assert {k[2] for k in as_dict(q.falloff_y(3, 2, "both", LINEAR, SUM).run())} == {0, 1, 2}
    assert set(along_x(q.falloff_x(3, 2, "both", LINEAR, SUM).run())) == {6, 7, 0, 1, 2}


def test_shift(spark):
    f = frame(spark, [(0, 100, 0, 9), (0, 200, 0, 3)])
    assert along_x(Query.of(f).shift_x(20, 5).run()) == {105: 9, 205: 3}
    assert along_x(Query.of(f).shift_x(19, -60).run()) == {(100 - 120) % (1 << 20): 9, 80: 3}


def test_shift_off_the_axis_fails(spark):
    with pytest.raises(Exception, match="leaves the y axis"):
        Query.of(frame(spark, [(0, 1, 0, 9)])).shift_y(20, -1).run().df.collect()


def test_zoom_out(spark):
    cells = [(a, b, c, 10 * (1 + 4 * a + 2 * b + c)) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    assert as_dict(Query.of(frame(spark, cells)).zoom_out(19, AVERAGE).run()) == {(0, 0, 0): 45}
    assert as_dict(Query.of(frame(spark, [(0, 0, 0, 10), (0, 1, 0, 99), (1, 0, 1, 5)])).zoom_out(19, MAX).run()) == {(0, 0, 0): 99}


def test_zoom_out_of_equal_children_by_block(spark):
    cells = [(a, b, c, 3) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    q = Query.of(frame(spark, cells))
    assert as_dict(q.zoom_out(19, SUM, "block").run()) == {(0, 0, 0): 3}
    assert as_dict(q.zoom_out(19, SUM).run()) == {(0, 0, 0): 24}


def test_extrude(spark):
    got = as_dict(Query.of(frame(spark, [(0, 100, 100, 10), (1, 100, 100, 20)], z=10)).extrude_f(10, -1, 1, MAX).run())
    assert got == {(f, 100, 100): 20 for f in (-1, 0, 1)}
    assert set(along_x(Query.of(frame(spark, [(0, 3, 0, 1)], z=3)).extrude_x(3, 6, 1, SUM).run())) == {6, 7, 0, 1}


def test_filters(spark):
    q = Query.of(frame(spark, [(0, x, 100, v) for x, v in ((10, 1), (11, 5), (12, 10), (13, 20))]))
    assert set(along_x(q.filter_eq(10).run())) == {12}
    assert set(along_x(q.filter_in(5, 10).run())) == {11, 12}
    assert set(along_x(q.filter_in(10).run())) == {12, 13}
    assert set(along_x(q.filter_in(Bound(5, False), Bound(20, False)).run())) == {12}
    assert set(along_x(q.filter_not_in(5, 10).run())) == {10, 13}
    with pytest.raises(InvalidQueryParameter):
        q.filter_in(100, 1).run()
    text = Query.of(frame(spark, [(0, x, 0, v) for x, v in ((1, "apple"), (2, "banana"), (3, "cherry"))], value="string"))
    assert along_x(text.filter_values(inside("b", "bz")).run()) == {2: "banana"}
    assert set(along_x(text.filter_values(outside("b", "bz")).run())) == {1, 3}


def test_map_values(spark):
    q = Query.of(frame(spark, [(0, 10, 200, 1), (0, 11, 200, 15)]))
    assert along_x(q.map_values(lambda v: v > 10).run()) == {10: False, 11: True}
    assert along_x(q.map_values(lambda v: F.when(v > 10, "high").otherwise("low")).run()) == {10: "low", 11: "high"}


def test_bad_parameters_fail_when_run(spark):
    q = Query.of(frame(spark, [(0, 1, 1, 1)]))
    for bad in (q.shift_x(100, 3), q.shift_x(3, 8), q.extrude_f(3, 0, 9, MAX), q.falloff_x(3, 1, "north", LINEAR, MAX)):
        with pytest.raises(SpatialError):
            bad.shift_x(1, 0).run()


def test_integer_sums_saturate(spark):
    f = frame(spark, [(0, 0, 0, 2**31 - 1), (0, 1, 0, 5)], value="int")
    assert as_dict(Query.of(f).zoom_out(19, SUM).run()) == {(0, 0, 0): 2**31 - 1}
    big = frame(spark, [(0, 0, 0, 2**63 - 1), (0, 1, 0, 5)])
    assert as_dict(Query.of(big).zoom_out(19, SUM).run()) == {(0, 0, 0): 2**63 - 1}
    other = frame(spark, [(0, 0, 0, 9)])
    assert as_dict(Query.of(big).merge(Query.of(other), 0, SUM).run())[0, 0, 0] == 2**63 - 1


def test_float_values(spark):
    f = frame(spark, [(0, 100, 0, 1.0)], value="double")
    assert along_x(Query.of(f).falloff_x(20, 2, "upper", LINEAR, SUM).run()) == {100: 1.0, 101: 0.5, 102: 0.0}
    assert along_x(Query.of(f).zoom_out(19, AVERAGE).run()) == {50: 1.0}


def test_order_dependent_and_custom_policies(spark):
    f = frame(spark, [(0, 0, 0, 7), (0, 1, 0, 3), (1, 0, 0, 1)])
    q = Query.of(f)
    assert as_dict(q.zoom_out(19, KEEP_EXISTING).run()) == {(0, 0, 0): 7}
    assert as_dict(q.zoom_out(19, OVERWRITE).run()) == {(0, 0, 0): 1}
    assert as_dict(q.zoom_out(19, DIFFERENCE).run()) == {(0, 0, 0): 3}

    class Product(MergePolicy):
        name, commutative = "Product", False

        def resolve(self, a, b, kind):
            return a * b

    assert as_dict(q.zoom_out(19, Product()).run()) == {(0, 0, 0): 21}


def _model(cells, op, z):
    """The same step on a dict, cell by cell."""
    kind, axis, n, pattern, policy = op
    k, out = "fxy".index(axis), {}
    low, high = limits(axis, z)
    for key, v in sorted(cells.items()):
        for d in range(-n, n + 1) if kind == "falloff" else (n,):
            to = list(key)
            to[k] = (key[k] + d) % (high + 1) if axis == "x" else key[k] + d
            if not low <= to[k] <= high:
                continue
            w = v
            if kind == "falloff":
                r, a = n, abs(d)
                w = {"Linear": v * (r - a) // r, "QuadraticIn": v * (r * r - a * a) // (r * r), "QuadraticOut": v * (r - a) ** 2 // (r * r)}[pattern.name]
            out.setdefault(tuple(to), []).append(w)
    return {c: {"Max": max, "Min": min, "Sum": sum}[policy.name](vs) for c, vs in out.items()}


@pytest.mark.parametrize("seed", range(6))
def test_random_queries_against_a_model(spark, seed):
    rng = random.Random(seed)
    z = 4
    cells = {(rng.randint(-4, 4), rng.randint(0, 15), rng.randint(4, 11)): rng.randint(1, 100) for _ in range(12)}
    q, want = Query.of(frame(spark, [(*k, v) for k, v in cells.items()], z=z)), cells
    for _ in range(2):
        axis, policy, pattern = rng.choice("fxy"), rng.choice((MAX, MIN, SUM)), rng.choice((LINEAR, QUADRATIC_IN, QUADRATIC_OUT))
        if rng.random() < 0.4:
            n = rng.randint(-3, 3)
            q, want = getattr(q, f"shift_{axis}")(z, n), _model(want, ("shift", axis, n, None, MAX), z)
        else:
            q, want = getattr(q, f"falloff_{axis}")(z, 2, "both", pattern, policy), _model(want, ("falloff", axis, 2, pattern, policy), z)
    assert as_dict(q.run()) == want
    assert as_dict(q.raw_run()) == want


def test_falloff_shuffles_the_input_once(spark):
    plan = Query.of(frame(spark, [(0, 100, 0, 4)])).falloff_x(20, 2, "both", LINEAR, SUM).run().df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


@pytest.mark.parametrize("axis", "fxy")
def test_falloff_over_tiles_equals_falloff_without(spark, monkeypatch, axis):
    from voxlattice.operators import transforms

    rng = random.Random(5)
    n = 64
    cells = {(rng.randint(-n, n - 1), rng.randrange(n), rng.randrange(n)) for _ in range(300)} | {(0, 0, 0), (-n, n - 1, n - 1), (-1, 15, 16)}
    f = frame(spark, [(*c, 1 + sum(c) % 50) for c in sorted(cells)], z=6)
    for direction in ("both", "upper", "lower"):
        q = getattr(Query.of(f), f"falloff_{axis}")(6, 3, direction, LINEAR, SUM)
        whole = as_dict(q.run())
        monkeypatch.setattr(transforms, "LANE_TILE", 16)
        assert as_dict(q.run()) == whole
        monkeypatch.setattr(transforms, "LANE_TILE", 1 << 16)
