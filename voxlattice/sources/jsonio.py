"""The JSON document: one data entry of values and ranges that refer to them.

``{"$schema", "meta": {...}, "option": {}, "data": [{"name", "value": [...], "ids": [{"z", "f", "x", "y", "i", "t", "ref"}]}]}``;
an axis array has one element where its ends are equal and may be missing (the full axis); ``i`` and ``t`` come together or
not at all. Documents are read by Spark's JSON reader and exploded; one document is written per table.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxlattice.domain import MAX_ZOOM, WHOLE
from voxlattice.errors import SourceReadError, UnsupportedFormat
from voxlattice.frame import VoxelFrame, cells_frame
from voxlattice.functions.ids import side
from voxlattice.operators.canonical import canonicalize
from voxlattice.operators.coalesce import calendar_ids

_ID = "struct<z:int,f:array<int>,x:array<int>,y:array<int>,i:bigint,t:array<bigint>,ref:int>"
VERSION = "1"


def document_schema(value: str | None) -> str:
    data = f"struct<name:string,{f'value:array<{value}>,' if value else ''}ids:array<{_ID}>>"
    return f"`$schema` string, meta struct<version:string,description:string>, option map<string,string>, data array<{data}>"


def _within(low, n):
    return lambda v: (v >= low) & (v < n)


def read_ranges(spark: SparkSession, path: str, value: str | None = "bigint") -> DataFrame:
    """``z, f0, f1, x0, x1, y0, y1, t0, t1[, value]``: closed indices, half-open seconds. Malformed documents are errors."""
    docs = spark.read.schema(document_schema(value)).option("multiLine", True).option("mode", "FAILFAST").json(path)
    if docs.where(F.coalesce(F.size("data") != 1, F.lit(True))).limit(1).count():
        raise UnsupportedFormat("a document has exactly one data entry")
    d = docs.select(F.explode("data").alias("d"))
    rows = d.select(*((F.col("d.value").alias("values"),) if value else ()), F.explode("d.ids").alias("id"))
    n = side(F.col("id.z"))
    z = F.col("id.z")
    out = [F.when(z.between(0, MAX_ZOOM), z).otherwise(F.raise_error(F.lit("zoom out of range")).cast("int")).alias("z")]
    for a in "fxy":
        axis, low = F.col(f"id.{a}"), -n if a == "f" else F.lit(0)
        sound = axis.isNull() | (F.size(axis).between(1, 2) & F.forall(axis, _within(low, n)))
        axis = F.when(sound, axis).otherwise(F.raise_error(F.lit(f"{a} out of range")).cast("array<int>"))
        missing = F.col(f"id.{a}").isNull()
        out += [F.when(missing, low).otherwise(F.get(axis, F.lit(0))).cast("int").alias(f"{a}0"), F.when(missing, n - 1).otherwise(F.element_at(axis, -1)).cast("int").alias(f"{a}1")]
    i, t = F.col("id.i"), F.col("id.t")
    half = i.isNull() != t.isNull()
    bad = lambda test, text, c: F.when(test, F.raise_error(F.lit(text)).cast("bigint")).otherwise(c)
    out.append(bad(half, "i and t come together", F.coalesce(i * F.get(t, F.lit(0)), F.lit(0).cast("long"))).alias("t0"))
    out.append(bad(half, "i and t come together", F.coalesce(i * (F.element_at(t, -1) + 1), F.lit(WHOLE))).alias("t1"))
    if value:
        ref = F.col("id.ref")
        known = ref.isNotNull() & (ref >= 0) & (ref < F.size("values"))
        out.append(F.when(known, F.get("values", ref)).otherwise(F.raise_error(F.lit("ref out of range")).cast(value)).alias("value"))
    return rows.select(*out)


def read_frame(spark: SparkSession, path: str, z: int, value: str | None = "bigint") -> VoxelFrame:
    """A document's ranges as cells at zoom z (at least that of every range)."""
    rows = read_ranges(spark, path, value)
    if rows.where(F.col("z") > z).limit(1).count():
        raise SourceReadError(f"the document has ranges finer than zoom {z}")
    for a in "fxy":
        lo, hi = F.col(f"{a}0").cast("long"), F.col(f"{a}1").cast("long")
        s = side(F.lit(z) - F.col("z"))
        run = F.sequence(lo * s, (hi + 1) * s - 1)
        if a == "x":
            run = F.when(lo <= hi, run).otherwise(F.concat(F.sequence(lo * s, F.lit((1 << z) - 1).cast("long")), F.sequence(F.lit(0).cast("long"), (hi + 1) * s - 1)))
        rows = rows.withColumn(a, F.explode(run))
    return cells_frame(rows, z, timed=True, valued=value is not None)


def _entries(frame: VoxelFrame) -> DataFrame:
    """``z, f, x, y, i, t`` as in the document, ``value`` and their order ``o``.

    Frames without time are written as their canonical blocks, timed ones as runs in calendar units.
    """
    pair = lambda lo, hi: F.when(lo == hi, F.array(lo)).otherwise(F.array(lo, hi))
    if frame.timed:
        ids = calendar_ids(frame)
        timed = F.col("i") != WHOLE
        axes = [F.array(a).alias(a) for a in "fxy"]
        time = [F.when(timed, F.col("i")).alias("i"), F.when(timed, pair(F.col("lo"), F.col("hi"))).alias("t")]
        order = F.struct("z", "f", "x", "y", "i", "lo")
    else:
        ids = canonicalize(frame).withColumn("z", F.greatest("fz", "xz", "yz"))
        axes = []
        for a in "fxy":
            s = side(F.col("z") - F.col(f"{a}z"))
            axes.append(pair((F.col(f"{a}i") * s).cast("int"), ((F.col(f"{a}i") + 1) * s - 1).cast("int")).alias(a))
        time = [F.lit(None).cast("bigint").alias("i"), F.lit(None).cast("array<bigint>").alias("t")]
        order = F.struct("z", "fi", "xi", "yi", "fz", "xz", "yz")
    return ids.select("z", *axes, *time, *(("value",) if frame.valued else ()), order.alias("o"))


def document(frame: VoxelFrame, name: str = "data", description: str = "") -> DataFrame:
    """One row ``document``: the frame as JSON text.

    Values are numbered in order of their first cell. The document is one string by nature; partition large tables and
    write one for each part.
    """
    ids = _entries(frame)
    entry = ["z", "f", "x", "y", "i", "t"]
    meta = F.struct(F.lit(VERSION).alias("version"), F.lit(description).alias("description"))
    if frame.valued:
        # The distinct values are in the document itself, so they are numbered by a window over them alone.
        first = ids.groupBy("value").agg(F.min("o").alias("first"))
        numbered = first.select(F.col("value").alias("v"), (F.row_number().over(W.orderBy("first")) - 1).alias("ref"))
        rows = ids.join(numbered, F.col("value") == F.col("v"))
        listed = rows.select("o", F.struct(*entry, "ref").alias("id"), F.struct("ref", "v").alias("v"))
        data = listed.agg(F.array_sort(F.collect_list(F.struct("o", "id"))).alias("l"), F.array_sort(F.collect_set("v")).alias("values"))
        body = F.struct(F.lit(name).alias("name"), F.transform("values", lambda v: v["v"]).alias("value"), F.transform("l", lambda r: r["id"]).alias("ids"))
    else:
        data = ids.select("o", F.struct(*entry).alias("id")).agg(F.array_sort(F.collect_list(F.struct("o", "id"))).alias("l"))
        body = F.struct(F.lit(name).alias("name"), F.transform("l", lambda r: r["id"]).alias("ids"))
    envelope = F.struct(F.lit("").alias("$schema"), meta.alias("meta"), F.create_map().cast("map<string,string>").alias("option"), F.array(body).alias("data"))
    return data.select(F.to_json(envelope).alias("document"))


def write_document(frame: VoxelFrame, path: str, **kw) -> None:
    document(frame, **kw).coalesce(1).write.mode("overwrite").text(path)


def parse_document(text: str) -> dict:
    """A document as Python values, checked like ``read_ranges`` does."""
    found = json.loads(text)
    if len(found.get("data", ())) != 1:
        raise UnsupportedFormat("a document has exactly one data entry")
    return found
