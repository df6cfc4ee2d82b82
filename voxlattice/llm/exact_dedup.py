"""Exact dedup [native]: a keyed state on disk, without expiry, that each arriving document is held against.

The documents' keys (digest, stable identifier, content locator) are appended to a log in the shared folder and
pass through Structured Streaming. The state store is RocksDB: state lives on the executors' disks, is
checkpointed to the shared folder and has no watermark, so a key that has been seen is never forgotten. Per
digest it holds the number of documents, the stable identifier of the one that stays (the largest id) and the
locator of its bytes. A hit, that is a document whose digest the state already held for another one, is then
read again with the keeper's bytes through the locator, and the full bytes are compared; only equal bytes make
it a duplicate. Documents that share a digest but not the bytes are grouped again by their bytes.

A state that outlives one call (``KeyedState(spark, folder)``) takes batches by name. It keeps the bytes of its documents
beside the log, so a hit is compared with the keeper whatever batch that came in; the locator names the batch. A batch is
written under its name before the stream runs: after a failure the same call goes on where it stopped, and
repeating a finished call changes nothing. A call returns the rows of its own batch against all batches so far; where a later
batch brings a larger id, ``KeyedState.table`` names the new keeper.

Only DataFrame functions run here: hashing, streaming aggregation, joins.

Defined results: null text counts as the empty text; null ids sort below all others; among repeated rows (equal
id and text) exactly one stays; an empty table gives an empty result; other columns are ignored by
``exact_dedup`` and carried whole by ``drop_exact_duplicates``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlattice.llm.scratch import BLOOM_JOIN, discard, exists, numbered, scratch_path, settings, staged

_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    "spark.sql.streaming.minBatchesToRetain": "2",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


class KeyedState:
    """The state of one dedup stream; batches may be added over the life of the corpus.

    ``log`` is the folder of keys, one below it for each batch, ``state`` the query's checkpoint. With a ``folder`` of the
    caller's the documents' bytes are kept too, in ``content``.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, files_per_batch: int = 1000):
        self.spark, self.lasting = spark, folder is not None
        self.folder = (folder or scratch_path(spark, "exact-dedup")).rstrip("/")
        self.log, self.state, self.content = f"{self.folder}/log", f"{self.folder}/state", f"{self.folder}/content"
        self.files_per_batch = files_per_batch

    def _written(self, rows: DataFrame, path: str) -> DataFrame:
        """Write once: a folder with its success mark is complete, one without it is begun anew."""
        if not exists(self.spark, f"{path}/_SUCCESS"):
            rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def keep(self, rows: DataFrame, batch: str) -> DataFrame:
        """The bytes of a batch, ``rows(uid, id, digest, locator, body)``."""
        return self._written(rows, f"{self.content}/{batch}")

    def kept(self, rows: DataFrame) -> DataFrame:
        """The bytes of all batches, with the columns of ``rows``."""
        return self.spark.read.schema(rows.schema).parquet(f"{self.content}/*")

    def add(self, keys: DataFrame, batch: str = "0") -> DataFrame:
        """Log ``keys(uid, id, digest, ...)`` of a batch and run the stream over what it has not seen; returns the batch's log."""
        log = self._written(keys, f"{self.log}/{batch}")
        with settings(self.spark, _STORE):
            stream = (
                self.spark.readStream.schema(keys.schema)
                .option("maxFilesPerTrigger", self.files_per_batch)
                .parquet(f"{self.log}/*")
                .groupBy("digest")
                .agg(
                    F.count(F.lit(1)).alias("n"),
                    F.max(F.struct(F.col("id").isNotNull().alias("known"), "id", "uid", "locator")).alias("keeper"),
                )
            )
            query = (
                stream.writeStream.outputMode("update").format("noop").option("checkpointLocation", self.state).trigger(availableNow=True).start()
            )
            query.awaitTermination()
        return log

    def table(self) -> DataFrame:
        """``(digest, n, keeper_id, keeper_uid, locator)`` of every key that has been seen."""
        with settings(self.spark, _STORE):
            held = self.spark.read.format("statestore").load(self.state)
        count, keeper = (f.name for f in held.schema["value"].dataType.fields)
        best = F.col("value")[keeper]
        return held.select(
            F.col("key.digest").alias("digest"),
            F.col("value")[count].alias("n"),
            best["id"].alias("keeper_id"),
            best["uid"].alias("keeper_uid"),
            best["locator"].alias("locator"),
        )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256_hex, state: KeyedState | None = None, batch: str = "0") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``digest`` makes the state's key from the text (tests pass a weak one to force collisions). ``batch`` names these rows in
    a lasting ``state``; a name stands for the same rows whenever it is used.
    """
    spark = docs.sparkSession
    state = state or KeyedState(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    uid = F.concat_ws("-", F.lit(batch), F.monotonically_increasing_id())
    locator = F.lit(batch) if state.lasting else F.input_file_name()
    bodies = rows.select(uid.alias("uid"), "id", digest(F.col("body")).alias("digest"), locator.alias("locator"), "body")
    if state.lasting:
        bodies = state.keep(bodies, batch)
    keys = bodies.select("uid", "id", "digest", sha256_hex(F.col("body")).alias("sha256"), "locator")
    log = state.add(keys, batch)
    if state.lasting:
        bodies = state.kept(bodies)
    # An expression as join key keeps the join's own exchange on both sides, which AQE can split under skew.
    held = staged(state.table(), "state")
    many = held.where("n > 1")
    if state.lasting:
        many = many.join(log.select(F.concat("digest", F.lit("")).alias("l")).distinct(), F.col("digest") == F.col("l"), "left_semi")

    # Full bytes on hits: the members of groups of two or more, each against the keeper's bytes.
    members = bodies.select("id", "body", "digest", "locator")
    with settings(spark, BLOOM_JOIN):
        hits = staged(members.join(many.select(F.col("digest").alias("d")), F.col("digest") == F.col("d"), "left_semi"), "hits")
    keeper = (
        many.select(F.col("digest").alias("d"), "keeper_id", F.col("locator").alias("at"))
        .join(hits.select(F.col("digest").alias("d2"), F.col("id").alias("i2"), F.col("body").alias("kept_body"), "locator"), F.expr("d = d2 and keeper_id <=> i2 and at <=> locator"))
        .groupBy("d")
        .agg(F.max("kept_body").alias("kept_body"))
    )
    unequal = staged(
        hits.join(keeper.withColumn("d", F.concat("d", F.lit(""))), F.concat("digest", F.lit("")) == F.col("d"))
        .where("body <> kept_body")
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("misses")),
        "unequal",
    )

    collided = not unequal.isEmpty()
    plain = held.join(unequal, "digest", "left_anti") if collided else held
    found = log.join(
        plain.select(F.concat("digest", F.lit("")).alias("d"), "keeper_id", "keeper_uid", "n"), F.concat("digest", F.lit("")) == F.col("d")
    ).select(
        F.col("id").alias("doc_id"),
        F.col("keeper_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("uid") == F.col("keeper_uid")).alias("kept"),
        F.col("sha256").alias("text_sha256"),
    )
    if collided:
        found = found.unionByName(_by_bytes(hits.join(unequal, "digest", "left_semi"), F.col("locator") == batch if state.lasting else F.lit(True)))
    else:
        discard(hits, unequal)
    return found


def _by_bytes(hits: DataFrame, own: Column) -> DataFrame:
    """The groups whose digest stands for different bytes, grouped by the bytes; the rows that are the call's ``own``."""
    again = staged(hits.withColumn("place", F.monotonically_increasing_id()), "collided")
    best = again.groupBy("digest", "body").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct(F.col("id").isNotNull().alias("known"), "id", "place")).alias("keeper"))
    return (
        again.where(own)
        .join(best, ["digest", "body"])
        .select(
            F.col("id").alias("doc_id"),
            F.col("keeper.id").alias("keep_id"),
            "group_size",
            (F.col("place") == F.col("keeper.place")).alias("kept"),
            sha256_hex(F.col("body")).alias("text_sha256"),
        )
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group of equal texts."""
    plain, doc_id, text = numbered(docs, id_col, text_col)
    found = staged(exact_dedup(docs, id_col, text_col), "exact")
    kept = found.where("kept").select(F.col("doc_id").alias("keep_id"), F.col("text_sha256").alias("sha"))
    out = plain.withColumn("body", sha256_hex(F.coalesce(F.col(text), F.lit(""))))
    out = out.join(kept, (F.col("body") == F.col("sha")) & F.col(doc_id).cast("long").eqNullSafe(F.col("keep_id")), "left_semi")
    # Rows repeated whole all match their keeper; only then is a second pass needed.
    repeated = found.where("group_size > 1").groupBy("doc_id", "text_sha256").count().where("count > 1")
    if not repeated.isEmpty():
        out = out.dropDuplicates([doc_id, "body"])
    return out.drop("body").toDF(*docs.columns)
