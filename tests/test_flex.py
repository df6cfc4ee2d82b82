"""Block algebra against boxes."""

import random

import pytest
from pyspark.sql import functions as F

from voxlattice.errors import IdError
from voxlattice.frame import FLEX
from voxlattice.functions import flex, ids


def _random_block(rng, top=3):
    z = [rng.randint(0, top) for _ in range(4)]
    return flex.block((z[0], rng.randint(-(1 << z[0]), (1 << z[0]) - 1)), *((zz, rng.randrange(1 << zz)) for zz in z[1:]))


def _points(b, top=3):
    runs = [range(i << (top - z), (i + 1) << (top - z)) for z, i in b]
    return {(f, x, y, t) for f in runs[0] for x in runs[1] for y in runs[2] for t in runs[3]}


@pytest.mark.parametrize("seed", range(3))
def test_algebra(seed):
    rng = random.Random(seed)
    for _ in range(60):
        a, b = _random_block(rng), _random_block(rng)
        both = flex.intersection(a, b)
        assert (_points(both) if both else set()) == _points(a) & _points(b)
        pieces = flex.difference(a, b)
        assert sum(len(_points(p)) for p in pieces) == len(_points(a) - _points(b)) and set().union(*map(_points, pieces)) == _points(a) - _points(b)
        parts = flex.shards(a, (2, 2, 2))
        assert set().union(*(_points(p) for _, p in parts)) == _points(a) and all(flex.intersection(c, p) == p for c, p in parts)


def test_difference_of_tables(spark):
    rng = random.Random(7)
    pairs = [(_random_block(rng), _random_block(rng)) for _ in range(80)]
    flat = lambda b: tuple(v for s in b for v in s)
    kind = ", ".join(f"{p}{c} {'long' if c == 'ti' else 'int'}" for p in "ab" for c in FLEX)
    df = spark.createDataFrame([flat(a) + flat(b) for a, b in pairs], kind)
    struct = lambda p: F.struct(*[F.col(p + c).alias(c) for c in FLEX])
    got = df.select(struct("a").alias("a"), struct("b").alias("b")).select("a", "b", flex.difference_column(F.col("a"), F.col("b")).alias("d")).collect()
    for r in got:
        back = lambda v: tuple(zip(v[0::2], v[1::2], strict=True))
        assert sorted(map(tuple, r["d"])) == sorted(map(flat, flex.difference(back(tuple(r["a"])), back(tuple(r["b"])))))


def test_split_and_parent():
    b = flex.block((2, -1), (3, 5), (1, 0), (4, 9))
    assert flex.split(b, 1) == (flex.block((2, -1), (4, 10), (1, 0), (4, 9)), flex.block((2, -1), (4, 11), (1, 0), (4, 9)))
    assert flex.parent(b, 1) == ((1, -1), (1, 1), (1, 0), (4, 9))
    with pytest.raises(IdError):
        flex.split(flex.block((30, 0), (0, 0), (0, 0)), 0)
    with pytest.raises(IdError):
        flex.block((1, 2), (0, 0), (0, 0))


def test_ranges_become_minimal_blocks(spark):
    df = spark.createDataFrame([(3, -3, 2, 6, 1, 0, 7, 0, 96, "v")], "z int, f0 int, f1 int, x0 int, x1 int, y0 int, y1 int, t0 long, t1 long, value string")
    rows = flex.from_ranges(df).collect()
    axis = lambda a: sorted({(r[f"{a}z"], r[f"{a}i"]) for r in rows})
    assert axis("f") == [(2, -1), (2, 0), (3, -3), (3, 2)]
    assert axis("x") == [(2, 0), (2, 3)] and axis("y") == [(0, 0)] and axis("t") == [(29, 0), (30, 2)]
    assert len(rows) == 4 * 2 * 2 and {r["value"] for r in rows} == {"v"}


def test_halves_of_tables(spark):
    df = spark.createDataFrame([(2, -1, 3, 5, 1, 0, 0, 0)], "fz int, fi int, xz int, xi int, yz int, yi int, tz int, ti long")
    assert tuple(flex.halved(df, "x", True).first())[2:4] == (4, 11)
    assert flex.to_shards(df, (3, 3, 3)).count() == 2 * 1 * 4


def test_time_labels(spark):
    one = lambda c: spark.range(1).select(c.alias("c")).first()["c"]
    assert tuple(one(ids.with_time_at(3600, F.lit(7300)))) == (3600, 2)
    assert tuple(one(ids.relabel_time(F.lit(3600), F.lit(2), 3600))) == (3600, 2)
    with pytest.raises(Exception, match="not one interval"):
        one(ids.relabel_time(F.lit(3600), F.lit(2), 1800))
    with pytest.raises(Exception, match="time out of range"):
        one(ids.with_time(3600, F.lit(-1)))
    assert tuple(one(ids.without_time())) == (1 << 35, 0)


def test_morton_keys_keep_prefixes(spark):
    key = lambda *c: spark.range(1).select(ids.morton(*map(F.lit, c)).alias("k")).first()["k"]
    parent, inside, after = key(10, 3, 500, 700), key(14, 53, 8001, 11215), key(10, 3, 501, 700)
    assert parent <= inside and inside != after and key(10, 3, 500, 700) == key(14, 48, 8000, 11200)


def test_native_covers_at_any_zoom(spark):
    from voxlattice.functions import timeaxis

    rows = [(z, lo, lo + n) for z in (0, 1, 4, 16, 30) for lo in (-(1 << z), -3, -1, 0, 1, 5, (1 << z) - 1) for n in (0, 1, 2, 5, 1 << z)]
    df = spark.createDataFrame(rows, "z int, lo long, hi long").withColumn("c", timeaxis.dyadic_column(F.col("lo"), F.col("hi"), F.col("z")))
    for r in df.collect():
        assert [tuple(c) for c in r["c"]] == timeaxis.dyadic(r["lo"], r["hi"], r["z"])
