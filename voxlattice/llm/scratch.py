"""Shared-folder staging: the only way in which these operators cut lineage.

A staged table is ordinary Parquet below the folder that the cluster names in ``spark.checkpoint.dir``, so it
survives the loss of any executor. Nothing here writes to a machine-local folder unless that setting is unset.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager, suppress

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders made for sessions whose setting is unset, by application.
_own: dict[str, str] = {}
#: Scratch folders of the applications that this process has driven; they go when it ends.
_used: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset (tests), a temporary one per application."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="voxlattice-")
        root = _own[app]
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    folder = f"{shared_root(spark)}/{spark.sparkContext.applicationId}"
    _used.add(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it; ``discard`` deletes it again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def numbered(docs: DataFrame, *names: str) -> tuple:
    """``docs`` with its columns named c0, c1, ... and the new names of the given ones; ``toDF(*docs.columns)`` undoes it.

    Whatever columns a table has, a dot in a name or a name twice, they do not meet those that an operator adds.
    """
    plain = [f"c{i}" for i in range(len(docs.columns))]
    lower = [c.lower() for c in docs.columns]
    return docs.toDF(*plain), *(plain[docs.columns.index(n) if n in docs.columns else lower.index(n.lower())] for n in names)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more. Those that a result still reads go with the process."""
    for table in tables:
        _delete(table.sparkSession.sparkContext, table.staged_at)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _delete(context: SparkContext, path: str) -> None:
    """Through the file system that holds it."""
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _leave_nothing() -> None:
    context = SparkContext._active_spark_context
    for folder in _used if context is not None else ():
        with suppress(Exception):  # the cluster may be gone before this process
            _delete(context, folder)


#: Rows that a small table will not match are kept out of a join's shuffle by a Bloom filter on its keys, at any size.
BLOOM_JOIN = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": str(8 << 30),
}


def veiled(key: Column) -> Column:
    """A whole-number join key behind an expression that the optimizer leaves alone.

    With it on both sides each gets an exchange of its own, which AQE can split where one key has very many rows; the
    exchange of an aggregate below the join would be used instead, and cannot be split.
    """
    return key.bitwiseXOR(F.lit(1))


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for what runs (not only: is planned) inside the block."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
