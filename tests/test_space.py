"""Lookups, writes, set algebra, canonical blocks, shards, identifiers."""

import random

import numpy as np
import pytest
from helpers import along_x, as_dict, frame
from pyspark.sql import functions as F

from voxlattice.domain import WHOLE
from voxlattice.errors import IdError, InvalidQueryParameter, InvalidShardMerge, UnsupportedFormat
from voxlattice.frame import FLEX, cells_frame, from_blocks, to_blocks
from voxlattice.functions import codecs, ids
from voxlattice.operators import lookups, sets, shards, writes
from voxlattice.operators.canonical import canonicalize
from voxlattice.operators.lookups import Range
from voxlattice.sources import generators, tables


def blocks(spark, rows):
    """Rows of FLEX plus a value."""
    return spark.createDataFrame(rows, "fz int, fi int, xz int, xi int, yz int, yi int, tz int, ti long, value long")


def test_overlay_of_coarse_and_fine(spark):
    a, b = frame(spark, [(0, 0, 0, 1)], z=18), frame(spark, [(0, 0, 0, 10)], z=20)
    got = as_dict(sets.merge_with(a, b, lambda x, y: x + y))
    assert len(got) == 64 and sorted(got.values()) == [1] * 63 + [11]


def test_overlay_sum(spark):
    a, b = frame(spark, [(0, 0, 0, 3), (0, 1, 0, 5)]), frame(spark, [(0, 1, 0, 7), (0, 2, 0, 9)])
    assert along_x(sets.merge_with(a, b, lambda x, y: x + y)) == {0: 3, 1: 12, 2: 9}
    assert along_x(sets.union(a, b)) == {0: 3, 1: 5, 2: 9}
    text = frame(spark, [(0, 1, 0, "b")], value="string"), frame(spark, [(0, 1, 0, "c"), (0, 3, 0, "d")], value="string")
    assert along_x(sets.merge_with(*text, F.concat)) == {1: "bc", 3: "d"}


@pytest.mark.parametrize("seed", range(4))
def test_set_algebra_against_python(spark, seed):
    rng = random.Random(seed)
    pick = lambda: {(rng.randint(-2, 1), rng.randint(0, 3), rng.randint(0, 3)) for _ in range(12)}
    a, b = pick(), pick()
    fa, fb = (cells_frame(spark.createDataFrame(sorted(s), "f int, x int, y int"), 2) for s in (a, b))
    rows = lambda f: sorted(map(tuple, f.df.collect()))
    assert rows(sets.union(fa, fb)) == sorted(a | b)
    assert rows(sets.set_intersection(fa, fb)) == sorted(a & b)
    assert rows(sets.set_difference(fa, fb)) == sorted(a - b)


def test_writes(spark):
    old = frame(spark, [(0, 0, 0, 1)], z=2)
    new = frame(spark, [(0, 0, 0, 2), (0, 1, 0, 2)], z=2)
    assert along_x(writes.upsert(old, new)) == {0: 1, 1: 2}
    assert along_x(writes.insert(old, new)) == {0: 2, 1: 2}
    assert along_x(writes.insert_with(old, new, lambda a, b: a * 10 + b)) == {0: 12, 1: 2}
    kept, cut = writes.remove(new, old)
    assert along_x(kept) == {1: 2} and along_x(cut) == {0: 2}
    assert writes.clear(new).df.isEmpty()
    log = spark.createDataFrame([(0, 0, 0, 5, 1), (0, 0, 0, 6, 2), (0, 1, 0, 7, 1)], "f int, x int, y int, value long, seq int")
    from voxlattice.frame import VoxelFrame

    assert along_x(writes.insert_batch(VoxelFrame(log, 2), "seq")) == along_x(writes.bulk_load(VoxelFrame(log, 2), "seq")) == {0: 6, 1: 7}


def test_wrapped_range_equals_full_axis(spark):
    f = frame(spark, [(0, 2, 0, 42)], z=2)
    assert along_x(lookups.get_overlapping(f, [Range(2, x=(1, 0))])) == along_x(lookups.get_overlapping(f, [Range(2)])) == {2: 42}
    assert along_x(lookups.get_overlapping(f, [Range(2, x=(3, 1))])) == {}


def test_get_clips_in_space_and_time(spark):
    f = frame(spark, [(0, 0, 0, 0, 7200, 1)], z=1, timed=True)
    got = lookups.get(f, Range(2, (0, 0), (0, 0), (0, 1), (3600, 90000)))
    assert as_dict(got) == {(0, 0, y, 3600, 7200): 1 for y in (0, 1)}


def test_bounds_are_deduplicated(spark):
    f = frame(spark, [(0, 100, 100, 7)], z=18)
    near = [Range(20, (0, 0), (400 + i, 400 + i), (400, 400)) for i in range(3)]
    assert len(as_dict(lookups.get_overlapping(f, near))) == 1


def test_bounding_box(spark):
    f = frame(spark, [(0, 0, 0, 1), (0, 2, 3, 1)])
    assert tuple(lookups.bounding_box(f).first()) == (20, 0, 0, 0, 2, 0, 3)
    assert lookups.bounding_box(writes.clear(f)).isEmpty()


def _region(row):
    """Half-open boxes of a block at zoom 4."""
    return [(row[2 * k + 1] << (4 - row[2 * k]), (row[2 * k + 1] + 1) << (4 - row[2 * k])) for k in range(3)]


@pytest.mark.parametrize("seed", range(4))
def test_block_joins_against_boxes(spark, seed):
    rng = random.Random(seed)

    def one(v):
        z = [rng.randint(1, 4) for _ in range(3)]
        return (z[0], rng.randint(-(1 << z[0]), (1 << z[0]) - 1), z[1], rng.randrange(1 << z[1]), z[2], rng.randrange(1 << z[2]), 0, 0, v)

    a, b = [one(i) for i in range(40)], [one(i) for i in range(6)]
    meet = lambda p, q: all(s < v and u < t for (s, t), (u, v) in zip(_region(p), _region(q), strict=True))

    def touch(p, q):
        n = 0
        for k, ((s, t), (u, v)) in enumerate(zip(_region(p), _region(q), strict=True)):
            if s < v and u < t:
                continue
            if t == u or v == s or (k == 1 and (t % 16 == u or v % 16 == s)):
                n += 1
            else:
                return False
        return n == 1

    fa, fb = blocks(spark, a), blocks(spark, b)
    values = lambda df: sorted({r["value"] for r in df.collect()})
    hit = sorted(p[8] for p in a if any(meet(p, q) for q in b))
    assert values(lookups.blocks_overlapping(fa, fb)) == hit
    assert values(lookups.blocks_remove_overlapping(fa, fb)) == sorted(set(range(40)) - set(hit))
    assert values(lookups.blocks_sharing_face(fa, fb)) == sorted(p[8] for p in a if p[8] not in hit and any(touch(p, q) for q in b))
    for r in lookups.blocks_clipped(fa, fb).collect():
        assert any(meet(r, q) and all(q[2 * k] <= r[2 * k] for k in range(3)) for q in b)


def test_lookups_of_far_zooms(spark):
    """Whole axes and blocks of the world against cells of zoom 25: no block is cut into finer ones."""
    fine = [(25, 5, 25, 2**24 + k, 25, 7, 0, 0, k) for k in range(50)] + [(25, 5, 25, 0, 25, 7, 0, 0, 50), (25, 5, 25, 2**25 - 1, 25, 9, 0, 0, 51)]
    zones = [(0, 0, 1, 1, 25, 7, 0, 0, 0), (25, 5, 25, 2**25 - 1, 25, 7, 0, 0, 1)]
    fa, fb = blocks(spark, fine), blocks(spark, zones)
    values = lambda df: sorted(r["value"] for r in df.collect())
    assert values(lookups.blocks_overlapping(fa, fb)) == list(range(50))
    assert values(lookups.blocks_remove_overlapping(fa, fb)) == [50, 51]
    assert [tuple(r)[:6] for r in lookups.blocks_clipped(fb.limit(1), fa.where("value = 3")).collect()] == [(25, 5, 25, 2**24 + 3, 25, 7)]
    assert values(lookups.blocks_sharing_face(fa, fb)) == [50], "around the seam"
    assert values(lookups.blocks_overlapping(fa, fb.limit(0))) == []


def test_faces_of_blocks_off_the_axis(spark):
    """x past the axis is taken around it where blocks meet end to end, and as it stands where they overlap."""
    cells = [(4, 0, 4, 20, 4, 7, 0, 0, 1), (4, 1, 4, 20, 4, 6, 0, 0, 2), (4, 0, 4, 5, 4, 6, 0, 0, 3), (4, 0, 4, 3, 4, 6, 0, 0, 4), (4, 0, 4, 4, 4, 7, 0, 0, 5)]
    found = lookups.blocks_sharing_face(blocks(spark, cells), blocks(spark, [(4, 0, 4, 20, 4, 6, 0, 0, 9)]))
    assert sorted(r["value"] for r in found.collect()) == [1, 2, 3]


def test_labels_of_nodes():
    from voxlattice.operators.canonical import _labels

    rng = random.Random(7)
    for ends in ((-2, 2), (-(1 << 31), (1 << 31) - 1)):
        pool = [rng.randint(*ends) for _ in range(6)] + list(ends)
        rows = np.array([[rng.choice(pool) for _ in range(3)] for _ in range(400)], np.int64)
        own, by_rows = _labels(list(rows.T)), np.unique(rows, axis=0, return_inverse=True)[1].reshape(-1)
        assert len(set(own)) == len(set(zip(own, by_rows))) == len(set(by_rows)) and own.max() + 1 == len(set(own))
    assert len(_labels([np.zeros(0, np.int64)] * 3)) == 0


def test_canonical_form(spark):
    cube = [(a, b, c, 5) for a in (0, 1) for b in (2, 3) for c in (6, 7)]
    got = [tuple(r) for r in canonicalize(frame(spark, cube, z=4), 2, 0).collect()]
    assert got == [(3, 0, 3, 1, 3, 3, 0, 0, 5)]
    row = [(0, x, 0, 1) for x in range(4)]
    assert [tuple(r)[:6] for r in canonicalize(frame(spark, row, z=4), 1, 1).collect()] == [(4, 0, 2, 0, 4, 0)]
    ground = [(f, x, y, 1) for f in range(-2, 2) for x in (0, 1) for y in (0, 1)]
    assert sorted(tuple(r)[:6] for r in canonicalize(frame(spark, ground, z=1), 1, 0).collect()) == [(0, -1, 0, 0, 0, 0), (0, 0, 0, 0, 0, 0)]


@pytest.mark.parametrize("seed", range(5))
def test_canonical_form_covers_the_same_space(spark, seed):
    rng = random.Random(seed)
    z = 4
    cells = {}
    for _ in range(6):
        w = 1 << rng.randint(0, 3)
        f, x, y = (rng.randrange(-1, 2) * w if k == 0 else rng.randrange(16 // w) * w for k in range(3))
        v = rng.randint(1, 2)
        cells |= {(f + a, x + b, y + c): v for a in range(w) for b in range(w) for c in range(w)}
    f = frame(spark, [(*k, v) for k, v in cells.items()], z=z)
    coarse = canonicalize(f, 2, 1)
    assert as_dict(from_blocks(coarse, z)) == cells
    # The levels are an implementation detail: every choice of them gives the same blocks.
    sets_of = [sorted(map(tuple, canonicalize(f, *p).collect())) for p in ((1, 0), (2, 0), (6, 4), (3, 2), (6, 0))]
    assert all(s == sorted(map(tuple, coarse.collect())) for s in sets_of)
    assert coarse.count() <= len(cells)


def test_shards(spark):
    f = frame(spark, [(0, x, y, x * 4 + y) for x in range(4) for y in range(4)], z=2)
    whole = {"f": (0, 0), "x": (0, 0), "y": (0, 0)}
    assert shards.split_region(whole)[0]["f"] == (1, 0)
    left = shards.split_shard(f, {"f": (1, 0), "x": (0, 0), "y": (0, 0)})
    assert [as_dict(s).keys() & {(0, 0, 0), (0, 3, 3)} for _, s in left] == [{(0, 0, 0)}, {(0, 3, 3)}]
    assert as_dict(shards.merge_shards(whole, left)) == as_dict(f)
    assert shards.should_split(f, 15) and not shards.should_split(f, 16)
    with pytest.raises(InvalidShardMerge):
        shards.merge_shards(whole, [left[0], left[0]])
    with pytest.raises(InvalidShardMerge):
        shards.merge_shards(left[1][0], [left[0]])
    assert as_dict(lookups.get_overlapping(f, [shards.region_range(left[0][0])])) == as_dict(left[0][1])


def test_refinement_is_guarded(spark):
    with pytest.raises(InvalidQueryParameter):
        frame(spark, [(0, 0, 0, 1)], z=0).refine(20)


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


def L(*v):
    return [F.lit(x) for x in v]


def test_family(spark):
    kids = one(spark, ids.children(*L(3, 3, 2, 7), 4))
    assert len(kids) == 8 and tuple(kids[0]) == (4, 6, 4, 14)
    assert tuple(one(spark, ids.parent(*L(4, 6, 9, 14), 3))) == (3, 3, 4, 7)
    assert tuple(one(spark, ids.parent(*L(4, -1, 9, 14), 0))) == (0, -1, 0, 0)
    assert one(spark, ids.parent(*L(4, 6, 9, 14), 5)) is None
    sib = one(spark, ids.siblings(*L(3, 3, 2, 7)))
    assert len(sib) == 7 and (3, 3, 2, 7) not in map(tuple, sib)
    assert one(spark, ids.siblings(*L(0, 0, 0, 0))) is None
    assert [r["z"] for r in one(spark, ids.parents(*L(3, 3, 2, 7)))] == [2, 1, 0]
    assert one(spark, ids.parents(*L(0, 0, 0, 0))) == []
    for kind, n in (("face", 6), ("edge", 12), ("vertex", 8), ("all", 26)):
        assert len(one(spark, ids.neighbours(*L(5, 0, 0, 9), kind))) == n
    assert len(one(spark, ids.neighbours(*L(5, 0, 0, 0), "all"))) == 17
    assert {c["x"] for c in one(spark, ids.neighbours(*L(5, 0, 0, 9), "face"))} == {31, 0, 1}


def test_text_round_trips(spark):
    assert one(spark, ids.single_text(*L(4, -3, 9, 14))) == "4/-3/9/14"
    assert one(spark, ids.single_text(*L(4, -3, 9, 14), F.lit(3600), F.lit(7))) == "4/-3/9/14_3600/7"
    assert tuple(one(spark, ids.parse_single(F.lit("4/-3/9/14_3600/7")))) == (4, -3, 9, 14, 3600, 7)
    assert tuple(one(spark, ids.parse_single(F.lit("4/-3/9/14")))) == (4, -3, 9, 14, WHOLE, 0)
    for bad in ("4/-3/9", "4/-3/16/0", "31/0/0/0", "4/a/0/0", "4/0/0/0_3600", "4/17/0/0", " 4/0/0/0", "4/0/0/0_0/0"):
        assert one(spark, ids.parse_single(F.lit(bad))) is None
    assert one(spark, ids.range_text(*L(4, -3, 2, 9, 1, 5, 5))) == "4/-3:2/9:1/5"
    assert tuple(one(spark, ids.parse_range(F.lit("4/2:-3/9:1/5_60/4:6"))))[:10] == (4, -3, 2, 9, 1, 5, 5, 60, 4, 6)
    assert one(spark, ids.flex_text(*L(3, -1, 4, 2, 5, 7), F.lit(20), F.lit(12345))) == "3/-1|4/2|5/7|20/12345"
    assert tuple(one(spark, ids.parse_flex(F.lit("3/-1|4/2|5/7|20/12345")))) == (3, -1, 4, 2, 5, 7, 20, 12345)


def test_keys():
    assert codecs.decode_cell(codecs.encode_cell(25, -7, 29804351, 13213023)) == (25, -7, 29804351, 13213023)
    assert codecs.decode_flex(codecs.encode_flex(18, -5, 18, 232848, 18, 103242, 20, 12345)) == (18, -5, 18, 232848, 18, 103242, 20, 12345)
    assert len(codecs.encode_cell(0, 0, 0, 0)) == 12 and len(codecs.encode_flex(0, 0, 0, 0, 0, 0)) == 23
    parent = (10, 3, 500, 700)
    inside = codecs.encode_cell(14, 3 * 16 + 5, 500 * 16 + 1, 700 * 16 + 15)
    assert codecs.encode_cell(*parent) <= inside <= codecs.cell_prefix_max(*parent)
    assert not codecs.encode_cell(*parent) <= codecs.encode_cell(14, 3 * 16, 501 * 16, 700 * 16) <= codecs.cell_prefix_max(*parent)


def test_keys_as_columns(spark):
    cells = [(z, f, x, y) for z in (0, 1, 7, 15, 16, 30) for f in (-(1 << z), -1, 0, (1 << z) - 1) for x in (0, (1 << z) - 1) for y in (0, (1 << z) // 2)]
    c = [F.col(k) for k in "zfxy"]
    keyed = spark.createDataFrame(cells, "z int, f int, x int, y int").select(*c, codecs.cell_key(*c).alias("k"), codecs.cell_key_max(*c).alias("m"))
    for r in keyed.withColumn("back", codecs.cell_of_key(F.col("k"))).collect():
        cell = (r.z, r.f, r.x, r.y)
        assert bytes(r.k) == codecs.encode_cell(*cell) and bytes(r.m) == codecs.cell_prefix_max(*cell) and tuple(r.back) == cell
    blocks_ = [(18, -5, 18, 232848, 17, 103242, 20, 12345), (0, -1, 30, (1 << 30) - 1, 0, 0, 35, (1 << 35) - 1), (30, (1 << 30) - 1, 0, 0, 1, 1, 0, 0)]
    names = ["fz", "fi", "xz", "xi", "yz", "yi", "tz", "ti"]
    rows = spark.createDataFrame(blocks_, "fz int, fi int, xz int, xi int, yz int, yi int, tz int, ti long").withColumn("k", codecs.flex_key(*map(F.col, names)))
    for r in rows.withColumn("back", codecs.flex_of_key(F.col("k"))).collect():
        assert bytes(r.k) == codecs.encode_flex(*r[:8]) and tuple(r.back) == tuple(r[:8])
    with pytest.raises(Exception, match="not the key"):
        spark.createDataFrame([(b"\x00" * 11 + b"\x1f",)], "k binary").select(codecs.cell_of_key(F.col("k"))).collect()


def test_range_arithmetic():
    assert ids.fine_range(1, 2, 3, 5) == (4, 11)
    assert ids.edges_shift("x", 0, 1, 3, 1, 0, 3) == (7, 1)
    assert ids.edges_shift("x", 0, 5, 3, 2, 2, 2) == (0, 3)
    assert ids.edges_shift("y", 0, 1, 3, 5, 1, 2) == (0, 1)
    assert ids.edges_shift("f", -8, -7, 3, 5, 1, 2) == (-4, -3)
    assert ids.stretch("x", 2, 3, 2) == [3, 0, 1] and ids.stretch("y", 2, 3, 2) == [3] and ids.stretch("f", 2, -3, -2) == [-4, -3]
    assert ids.halves(3, -1) == ((4, -2), (4, -1))
    with pytest.raises(IdError):
        Range(3, x=(0, 8))


def test_moves_and_checks(spark):
    assert one(spark, ids.moved("x", F.lit(3), F.lit(0), -1)) == 7
    with pytest.raises(Exception, match="leaves its range"):
        one(spark, ids.moved("y", F.lit(3), F.lit(7), 1))
    with pytest.raises(Exception, match="not a cell"):
        one(spark, ids.checked(*L(3, 0, 8, 0)))
    assert tuple(one(spark, ids.range_checked(*L(3, 5, -2, 6, 1, 4, 2)))) == (3, -2, 5, 6, 1, 2, 4)


def test_generators_stay_in_range(spark):
    df = generators.random_cells(spark, 200, 5)
    assert df.where(ids.is_valid(*map(F.col, ("z", "f", "x", "y")))).count() == 200
    assert df.collect() == generators.random_cells(spark, 200, 5).collect()
    assert generators.random_any_zoom(spark, 200).where(~ids.is_valid(*map(F.col, ("z", "f", "x", "y")))).count() == 0
    assert generators.random_ranges(spark, 50, 4).where("f0 > f1 or y0 > y1").count() == 0
    for kind in ("dense", "sparse", "linear", "clusters", "layered", "checkerboard"):
        df = generators.pattern(spark, kind, 500)
        n = df.select("f", "x", "y").distinct().count()
        assert df.count() == 500 and (n == 500 or kind == "sparse")
    odd = generators.pattern(spark, "checkerboard", 500).where("(f + x + y) % 2 <> 0").count()
    assert odd == 0
    with pytest.raises(IdError):
        generators.pattern(spark, "spiral", 5)


def test_stored_blocks(spark, tmp_path):
    f = frame(spark, [(0, x, 0, x // 2) for x in range(8)], z=4)
    path = str(tmp_path / "blocks")
    tables.write_blocks(canonicalize(f), path)
    assert as_dict(from_blocks(tables.read_blocks(spark, path), 4)) == as_dict(f)
    spark.read.parquet(path).withColumn("format_version", F.lit(99)).write.parquet(path + "2")
    for bad in (path + "2",):
        with pytest.raises(UnsupportedFormat):
            tables.read_blocks(spark, bad)
    to_blocks(f).drop("tz").write.parquet(path + "3")
    with pytest.raises(UnsupportedFormat):
        tables.read_blocks(spark, path + "3")
    assert set(FLEX) <= set(to_blocks(f).columns)
