"""Random identifiers and the workload patterns of benchmarks, from ``spark.range``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlattice.domain import limits
from voxlattice.errors import IdError


def _between(low: int, high: int, seed: int) -> Column:
    return (F.floor(F.rand(seed) * (high - low + 1)) + low).cast("int")


def random_cells(spark: SparkSession, n: int, z: int, seed: int = 42, within: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """``id, z, f, x, y``: uniform over the zoom, or over closed index ranges of some axes."""
    df = spark.range(n).withColumn("z", F.lit(z))
    for k, a in enumerate("fxy"):
        low, high = (within or {}).get(a, limits(a, z))
        if not limits(a, z)[0] <= low <= high <= limits(a, z)[1]:
            raise IdError(f"{a} range {low}..{high} at zoom {z}")
        df = df.withColumn(a, _between(low, high, seed + k))
    return df


def random_any_zoom(spark: SparkSession, n: int, seed: int = 42, max_zoom: int = 30) -> DataFrame:
    """``id, z, f, x, y`` with random zooms as well."""
    df = spark.range(n).withColumn("z", _between(0, max_zoom, seed + 3))
    side = F.pow(F.lit(2.0), F.col("z"))
    return df.withColumns({
        "f": (F.floor(F.rand(seed) * 2 * side) - side).cast("int"),
        "x": F.floor(F.rand(seed + 1) * side).cast("int"),
        "y": F.floor(F.rand(seed + 2) * side).cast("int"),
    })


def random_ranges(spark: SparkSession, n: int, z: int, seed: int = 42) -> DataFrame:
    """``id, z, f0, f1, x0, x1, y0, y1``; x may wrap."""
    a, b = random_cells(spark, n, z, seed), random_cells(spark, n, z, seed + 10)
    b = b.withColumnsRenamed({"f": "g", "x": "u", "y": "v"}).drop("z")
    return a.join(b, "id").select("id", "z", F.least("f", "g").alias("f0"), F.greatest("f", "g").alias("f1"), F.col("x").alias("x0"), F.col("u").alias("x1"), F.least("y", "v").alias("y0"), F.greatest("y", "v").alias("y1"))


def pattern(spark: SparkSession, kind: str, n: int, z: int = 20, seed: int = 42) -> DataFrame:
    """``id, f, x, y`` of n cells: dense, sparse, linear, clusters, layered or checkerboard."""
    i = F.col("id")
    side = max(1, round(n ** (1 / 3)))
    while side**3 < n:
        side += 1
    cube = lambda k, s: (F.floor(k / (s * s)), F.floor(k / s) % s, k % s)
    if kind == "dense":
        f, x, y = cube(i, side)
    elif kind == "sparse":
        return random_cells(spark, n, z, seed, {"f": (-500, 499)}).drop("z")
    elif kind == "linear":
        f, x, y = F.lit(0), i, i
    elif kind == "clusters":
        each = -(-n // 8)
        s = max(1, round(each ** (1 / 3)))
        while s**3 < each:
            s += 1
        c = F.floor(i / each)
        f, x, y = cube(i % each, s)
        x, y = x + (c % 4) * (4 * s), y + F.floor(c / 4) * (4 * s)
    elif kind == "layered":
        each = -(-n // 10)
        s = max(1, round(each**0.5))
        while s * s < each:
            s += 1
        k = i % each
        f, x, y = F.floor(i / each) * 5, F.floor(k / s), k % s
    elif kind == "checkerboard":
        s = side * 2
        half = F.floor(i / F.lit(s // 2 or 1))
        f, x = F.floor(half / s), half % s
        y = (i % F.lit(s // 2 or 1)) * 2 + (f + x) % 2
    else:
        raise IdError(f"no pattern {kind}")
    return spark.range(n).select("id", f.cast("int").alias("f"), x.cast("int").alias("x"), y.cast("int").alias("y"))
