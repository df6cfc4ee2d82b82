"""Blocks (a zoom and index per axis): algebra on single blocks and on tables of them.

Two dyadic segments of an axis are nested or disjoint, so two blocks meet in the block of the deeper segment of each
axis, and their difference is what is peeled off axis by axis: at most one piece per halving.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlattice.domain import MAX_TIME_ZOOM, MAX_ZOOM, check_index, check_zoom
from voxlattice.errors import IdError
from voxlattice.frame import FLEX
from voxlattice.functions.ids import halves, shift_left, shift_right

#: A segment of one axis: (zoom, index). A block: four of them, f, x, y, t.
Segment = tuple[int, int]
Block = tuple[Segment, Segment, Segment, Segment]
WHOLE_TIME: Segment = (0, 0)


def block(f: Segment, x: Segment, y: Segment, t: Segment = WHOLE_TIME) -> Block:
    for axis, (z, i) in zip("fxy", (f, x, y), strict=True):
        check_index(axis, check_zoom(z), i)
    if not (0 <= t[0] <= MAX_TIME_ZOOM and 0 <= t[1] < 1 << t[0]):
        raise IdError(f"time segment {t}")
    return f, x, y, t


def nested(a: Segment, b: Segment) -> Segment | None:
    """The deeper of two segments if one holds the other."""
    if a[0] > b[0]:
        a, b = b, a
    return b if b[1] >> (b[0] - a[0]) == a[1] else None


def intersection(a: Block, b: Block) -> Block | None:
    parts = tuple(nested(p, q) for p, q in zip(a, b, strict=True))
    return None if None in parts else parts


def _peel(outer: Segment, inner: Segment) -> Iterator[Segment]:
    """Segments of ``outer`` beside ``inner``, from the largest down."""
    for z in range(outer[0] + 1, inner[0] + 1):
        yield z, (inner[1] >> (inner[0] - z)) ^ 1


def difference(a: Block, b: Block) -> list[Block]:
    """Disjoint blocks that cover a without b."""
    common = intersection(a, b)
    if common is None:
        return [a]
    out, rest = [], list(a)
    for k in range(4):
        for piece in _peel(rest[k], common[k]):
            out.append(tuple(piece if j == k else rest[j] for j in range(4)))
        rest[k] = common[k]
    return out


def split(a: Block, axis: int) -> tuple[Block, Block]:
    """Lower and upper half along f, x, y or t (0..3)."""
    top = MAX_TIME_ZOOM if axis == 3 else MAX_ZOOM
    if a[axis][0] >= top:
        raise IdError("a segment of the finest zoom cannot be split")
    low, high = halves(*a[axis])
    return tuple(low if k == axis else s for k, s in enumerate(a)), tuple(high if k == axis else s for k, s in enumerate(a))


def parent(a: Block, z: int) -> Block:
    """Spatial zooms clamped to at most z."""
    return (*(((min(s[0], z)), s[1] >> max(0, s[0] - z)) for s in a[:3]), a[3])


def shards(a: Block, zooms: tuple[int, int, int]) -> list[tuple[Block, Block]]:
    """(cell of the shard grid, what of the block is in it) for every shard that the block reaches."""
    spans = []
    for (z, i), s in zip(a[:3], zooms, strict=True):
        if z >= s:
            spans.append([((s, i >> (z - s)), (z, i))])
        else:
            first = i << (s - z)
            spans.append([((s, first + k), (s, first + k)) for k in range(1 << (s - z))])
    return [((f[0], x[0], y[0], WHOLE_TIME), (f[1], x[1], y[1], a[3])) for f in spans[0] for x in spans[1] for y in spans[2]]


# Tables of blocks ------------------------------------------------------------------------------------------------------


def clamp_zoom(blocks: DataFrame, z: int) -> DataFrame:
    """Every block's ancestor with spatial zooms of at most z."""
    out = {}
    for a in "fxy":
        d = F.greatest(F.col(f"{a}z") - z, F.lit(0))
        out[f"{a}i"], out[f"{a}z"] = shift_right(F.col(f"{a}i"), d), F.least(F.col(f"{a}z"), F.lit(z))
    return blocks.withColumns(out)


def halved(blocks: DataFrame, axis: str, upper: bool) -> DataFrame:
    """The lower or upper half of every block along f, x, y or t."""
    return blocks.withColumns({f"{axis}z": F.col(f"{axis}z") + 1, f"{axis}i": F.col(f"{axis}i") * 2 + int(upper)})


def to_shards(blocks: DataFrame, zooms: tuple[int, int, int]) -> DataFrame:
    """Blocks cut at a shard grid, with the shard's indices ``sf, sx, sy``: the partition key of a stored table."""
    df = blocks
    for a, s in zip("fxy", zooms, strict=True):
        z, i = F.col(f"{a}z"), F.col(f"{a}i")
        first = shift_left(i.cast("long"), F.greatest(F.lit(s) - z, F.lit(0)))
        n = shift_left(F.lit(1).cast("long"), F.greatest(F.lit(s) - z, F.lit(0)))
        df = df.withColumn("piece", F.explode(F.sequence(first, first + n - 1).cast("array<int>")))
        df = df.withColumns({f"{a}i": F.col("piece"), f"s{a}": shift_right(F.col("piece"), F.greatest(z - s, F.lit(0))), f"{a}z": F.greatest(z, F.lit(s))})
    return df.drop("piece")


def from_ranges(ranges: DataFrame) -> DataFrame:
    """Minimal blocks of ``z, f0, f1, x0, x1, y0, y1[, t0, t1]`` (closed; x may wrap; half-open seconds), native."""
    from voxlattice.functions.timeaxis import dyadic_column

    df = ranges
    for a in "fxy":
        # Cut at the range's own zoom, whose levels above the range's length hold no segment of it.
        lo, hi = F.col(f"{a}0").cast("long"), F.col(f"{a}1").cast("long") + 1
        segments = dyadic_column(lo, hi, F.col("z"))
        if a == "x":
            n = shift_left(F.lit(1).cast("long"), F.col("z"))
            segments = F.when(F.col("x0") > F.col("x1"), F.concat(dyadic_column(lo, n, F.col("z")), dyadic_column(F.lit(0), hi, F.col("z")))).otherwise(segments)
        df = df.withColumn("seg", F.explode(segments))
        df = df.withColumns({f"{a}z": F.col("seg.zoom"), f"{a}i": F.col("seg.index").cast("int")})
    if "t0" in ranges.columns:
        df = df.withColumn("seg", F.explode(dyadic_column(F.col("t0"), F.col("t1"), MAX_TIME_ZOOM))).withColumns({"tz": F.col("seg.zoom"), "ti": F.col("seg.index")})
    else:
        df = df.withColumns({"tz": F.lit(0), "ti": F.lit(0).cast("long")})
    rest = [c for c in ranges.columns if c not in ("z", "f0", "f1", "x0", "x1", "y0", "y1", "t0", "t1")]
    return df.select(*FLEX, *rest)


def timed_intersection(a: Column, b: Column) -> Column:
    """Two blocks with seconds, ``struct<fz, fi, xz, xi, yz, yi, t0, t1>``: what both cover, null if nothing."""
    parts, meets = [], (a["t0"] < b["t1"]) & (b["t0"] < a["t1"])
    for k in "fxy":
        az, ai, bz, bi = a[f"{k}z"], a[f"{k}i"], b[f"{k}z"], b[f"{k}i"]
        meets = meets & F.when(az <= bz, shift_right(bi, F.greatest(bz - az, F.lit(0))) == ai).otherwise(shift_right(ai, F.greatest(az - bz, F.lit(0))) == bi)
        parts += [F.greatest(az, bz).alias(f"{k}z"), F.when(az >= bz, ai).otherwise(bi).alias(f"{k}i")]
    return F.when(meets, F.struct(*parts, F.greatest(a["t0"], b["t0"]).alias("t0"), F.least(a["t1"], b["t1"]).alias("t1")))


def timed_difference(a: Column, b: Column) -> Column:
    """``array<struct<fz, fi, xz, xi, yz, yi, t0, t1>>``: disjoint pieces of block a that b does not cover.

    What lies beside b in space keeps all of a's time; the common block keeps a's time before and after b's.
    """
    whole = lambda c: F.struct(*[c[f"{k}{p}"].cast("int").alias(f"{k}{p}") for k in "fxy" for p in "zi"], F.lit(0).alias("tz"), F.lit(0).cast("long").alias("ti"))
    space = [f"{k}{p}" for k in "fxy" for p in "zi"]
    piece = lambda c, t0, t1: F.struct(*[c[k].cast("int").alias(k) for k in space], t0.cast("long").alias("t0"), t1.cast("long").alias("t1"))
    beside = F.transform(difference_column(whole(a), whole(b)), lambda c: piece(c, a["t0"], a["t1"]))
    common = timed_intersection(a, b)
    ends = F.filter(F.array(piece(common, a["t0"], common["t0"]), piece(common, common["t1"], a["t1"])), lambda c: c["t0"] < c["t1"])
    return F.when(common.isNull(), F.array(piece(a, a["t0"], a["t1"]))).otherwise(F.concat(beside, ends))


def difference_column(a: Column, b: Column) -> Column:
    """``array<struct<...FLEX>>``: ``difference`` of two blocks given as structs, native."""
    axes = ("f", "x", "y", "t")
    common, meets = {}, F.lit(True)
    for k in axes:
        az, ai, bz, bi = a[f"{k}z"], a[f"{k}i"].cast("long"), b[f"{k}z"], b[f"{k}i"].cast("long")
        meets = meets & F.when(az <= bz, shift_right(bi, F.greatest(bz - az, F.lit(0))) == ai).otherwise(shift_right(ai, F.greatest(az - bz, F.lit(0))) == bi)
        common[k] = (F.greatest(az, bz), F.when(az >= bz, ai).otherwise(bi))
    pieces = []
    for n, k in enumerate(axes):
        cz, ci = common[k]

        def piece(z, n=n, k=k, cz=cz, ci=ci):
            fields = []
            for m, j in enumerate(axes):
                jz, ji = (common[j] if m < n else (a[f"{j}z"], a[f"{j}i"].cast("long"))) if j != k else (z, shift_right(ci, cz - z).bitwiseXOR(F.lit(1).cast("long")))
                fields += [jz.cast("int").alias(f"{j}z"), ji.cast("long" if j == "t" else "int").alias(f"{j}i")]
            return F.struct(*fields)

        zooms = F.when(cz > a[f"{k}z"], F.sequence(a[f"{k}z"] + 1, cz)).otherwise(F.array().cast("array<int>"))
        pieces.append(_transform(zooms, piece))
    whole = F.struct(*[a[c].cast("long" if c == "ti" else "int").alias(c) for c in FLEX])
    return F.when(meets, F.concat(*pieces)).otherwise(F.array(whole))


def _transform(zooms: Column, piece) -> Column:
    return F.transform(zooms, lambda z: piece(z))
