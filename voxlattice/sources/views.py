"""Voxel frames derived from the relational test tables, by integer arithmetic that SQL can repeat."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlattice.frame import AXES, VoxelFrame, cells_frame, dealt


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark, sf_dir) -> DataFrame:
    cell = [(F.col("l_linenumber") - 4).cast("int").alias("f"), F.col("l_partkey").cast("int").alias("x"), F.col("l_suppkey").cast("int").alias("y")]
    return _table(spark, sf_dir, "lineitem").select(*cell, F.col("l_quantity").cast("bigint").alias("value"), "l_returnflag")


def cells_li(spark: SparkSession, sf_dir: str) -> VoxelFrame:
    """Zoom 16: largest quantity per line number, part and supplier."""
    return cells_frame(dealt(_lines(spark, sf_dir), list(AXES)).groupBy("f", "x", "y").agg(F.max("value").alias("value")), 16)


def cells_li_b(spark: SparkSession, sf_dir: str) -> VoxelFrame:
    """Zoom 16: smallest quantity of returned lines."""
    return cells_frame(dealt(_lines(spark, sf_dir).where("l_returnflag = 'R'"), list(AXES)).groupBy("f", "x", "y").agg(F.min("value").alias("value")), 16)


def cells_ord(spark: SparkSession, sf_dir: str) -> VoxelFrame:
    """Zoom 20: one cell per order, each with its own value."""
    o = _table(spark, sf_dir, "orders")
    return cells_frame(o.select((F.col("o_orderkey") % 16 - 8).alias("f"), (F.col("o_custkey") * 7).alias("x"), F.col("o_orderkey").alias("y"), F.col("o_orderkey").cast("bigint").alias("value")), 20)


def cells_ev(spark: SparkSession, sf_dir: str) -> VoxelFrame:
    """Zoom 12 with hours: largest rounded value per user, event modulo 64 and hour."""
    e = _table(spark, sf_dir, "events")
    hour = F.floor(F.unix_timestamp("ts") / 3600)
    rows = e.select(F.lit(0).alias("f"), F.col("user_id").alias("x"), (F.col("event_id") % 64).alias("y"), (hour * 3600).alias("t0"), ((hour + 1) * 3600).alias("t1"), F.round("value").cast("bigint").alias("value"))
    return cells_frame(dealt(rows, [*AXES, "t0", "t1"]).groupBy("f", "x", "y", "t0", "t1").agg(F.max("value").alias("value")), 12)


def points_cust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``c_custkey, lat, lon, alt``."""
    c = _table(spark, sf_dir, "customer")
    k = F.col("c_custkey").cast("bigint")
    return c.select(k.alias("c_custkey"), ((k * 7919) % 160001 / 1000.0 - 80).alias("lat"), ((k * 104729) % 360001 / 1000.0 - 180).alias("lon"), F.col("c_acctbal").alias("alt"))


#: The same views for DuckDB.
SQL = {
    "cells_li": "SELECT CAST(l_linenumber - 4 AS INT) f, CAST(l_partkey AS INT) x, CAST(l_suppkey AS INT) y, max(CAST(l_quantity AS BIGINT)) AS value FROM lineitem GROUP BY 1, 2, 3",
    "cells_li_b": "SELECT CAST(l_linenumber - 4 AS INT) f, CAST(l_partkey AS INT) x, CAST(l_suppkey AS INT) y, min(CAST(l_quantity AS BIGINT)) AS value FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2, 3",
    "cells_ord": "SELECT CAST(o_orderkey % 16 - 8 AS INT) f, CAST(o_custkey * 7 AS INT) x, CAST(o_orderkey AS INT) y, CAST(o_orderkey AS BIGINT) AS value FROM orders",
    "cells_ev": "SELECT 0 AS f, CAST(user_id AS INT) x, CAST(event_id % 64 AS INT) y, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS t0, (CAST(floor(epoch(ts) / 3600) AS BIGINT) + 1) * 3600 AS t1, max(CAST(round(value) AS BIGINT)) AS value FROM events GROUP BY 1, 2, 3, 4, 5",
    "points_cust": "SELECT CAST(c_custkey AS BIGINT) c_custkey, (CAST(c_custkey AS BIGINT) * 7919) % 160001 / 1000.0::DOUBLE - 80 AS lat, (CAST(c_custkey AS BIGINT) * 104729) % 360001 / 1000.0::DOUBLE - 180 AS lon, c_acctbal AS alt FROM customer",
}


def with_views(sql: str) -> str:
    """``sql`` preceded by the views that it names."""
    used = [f"{k} AS ({v})" for k, v in SQL.items() if re.search(rf"\b{k}\b", sql)]
    body = sql.strip()
    if not used:
        return body
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(used) + ", " + body[5:]
    return "WITH " + ", ".join(used) + " " + body
