"""Mixing sources to target weights [native]: capped water-filling, then seeded repetitions.

Targets. Source s has size n_s (words) and weight w_s; all targets together are the sum of sizes. A target stops
at ``max_epochs`` times its source's size and the excess goes to the others by weight, until none is above.
The end of that process is target_s = min(cap_s, level * w_s) with one water level, which is found in one pass
over the sources in order of cap_s / w_s with running sums: no loop, nothing collected.

Sampling. target_s / n_s = whole epochs plus a fraction. Every document is taken whole that many times; the
fraction takes further documents once more, whole as well, in a seeded pseudo-random order while they fit in the rest of the
target. What is left where the first one does not fit goes to the documents after it that are not larger, in the same
order; the one on which this ends is taken if that is nearer to the target. So no document is cut, and a source's words miss
its target by half of one such document at most, unless no document is left.
The order is by a hash of seed, id and text hash: reruns agree. Running sums are made in two levels (within
small hash buckets, then over the buckets' totals), so no task ever holds a source, however hot.

Defined results: null text has size 0; null sources are a source of their own, last in order; sources of size
0 have target 0; a null id is hashed as a value of its own; repeated rows (equal id and text) count as separate
documents and share their order; an empty table gives an empty result; other columns are carried by ``mix``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxlattice.llm.scratch import numbered, staged

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: float = 3.0, share: float = 1.0) -> DataFrame:
    """``(source, size, docs)`` with one row per source -> plus ``weight, cap, target``.

    Sources rank by code point, null last, and take ``weights`` in turn. One row per source goes through two
    windows without partition key: bounded by the number of sources.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("size") * F.lit(float(max_epochs)))
    fill = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    rows = rows.withColumn("place", F.row_number().over(fill))
    up_to = fill.rowsBetween(W.unboundedPreceding, W.currentRow)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.sum("size").over(everything) * F.lit(float(share))
    # The level if exactly the sources before this one are clamped; the first that it does not reach sets it.
    before_cap = F.sum("cap").over(up_to) - F.col("cap")
    open_weight = F.sum("weight").over(everything) - F.sum("weight").over(up_to) + F.col("weight")
    rows = rows.withColumn("level", (total - before_cap) / open_weight)
    rows = rows.withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    level = F.min(F.when(F.col("free"), F.struct("place", "level"))).over(everything)["level"]
    rows = rows.withColumn("water", level)
    return rows.withColumn("target", F.coalesce(F.least("cap", F.col("water") * F.col("weight")), F.col("cap"))).drop("place", "level", "free", "water")


def _running(rows: DataFrame, name: str, bucket_rows: int) -> DataFrame:
    """Adds ``name``: the sizes of the rows of the same ``key`` that come before, in order of ``order_key``.

    ``docs`` is the key's number of rows (or more): it sets the number of hash buckets, which come one after the other.
    """
    tagged = rows.withColumn("bucket", F.pmod(F.col("order_key"), F.greatest(F.ceil(F.col("docs") / bucket_rows), F.lit(1))))
    totals = tagged.groupBy("key", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(F.col("key").alias("k"), F.col("bucket").alias("b"), F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("before_bucket"))
    inside = W.partitionBy("key", "bucket").orderBy("order_key", F.col("doc_id").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = tagged.withColumn("own", F.sum("size").over(inside) - F.col("size")).join(totals, F.expr("key = k and bucket = b"))
    return placed.withColumn(name, F.col("own") + F.col("before_bucket")).drop("bucket", "own", "k", "b", "before_bucket")


def sampled_sizes(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 7,
                  weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: float = 3.0, share: float = 1.0, bucket_rows: int = 1000) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, source, order_key, size, source_size, target, whole, taken``.

    ``whole`` repetitions of the document; ``taken`` = whole * size.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.coalesce(F.col(text_col), F.lit(""))).alias("order_key"),
    )
    rows = staged(rows, "sizes")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs"))
    goal = F.least(F.round("target").cast("long"), F.floor(F.col("size") * max_epochs).cast("long"))
    targets = source_targets(per_source, weights, max_epochs, share).withColumn("goal", goal)
    epochs = F.when(F.col("size") > 0, F.floor(F.col("goal") / F.col("size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.select(_source_key(), F.col("size").alias("source_size"), "docs", "target", epochs.alias("epochs"), (F.col("goal") - epochs * F.col("size")).alias("rest"))
    # The join key is built from the source, so that both sides get exchanges that AQE can split.
    tagged = rows.withColumn("tag", _source_key()).join(staged(targets, "targets"), F.col("tag") == F.col("key")).drop("tag")
    placed = staged(_running(tagged, "before", bucket_rows), "placed")

    # First the documents that fit one after the other; then, after the first that does not, smaller ones.
    fits = F.col("before") + F.col("size") <= F.col("rest")
    first = placed.where(fits).groupBy("key").agg(F.max(F.col("before") + F.col("size")).alias("reached")).select(F.col("key").alias("f"), "reached")
    late = placed.where(~fits).join(first, F.col("key") == F.col("f"), "left").drop("f").withColumn("left", F.col("rest") - F.coalesce("reached", F.lit(0)))
    small = F.col("size") <= F.col("left")
    again = _running(late.where(small), "then", bucket_rows)
    # Of the document on which the rest ends, half must fit.
    more = F.col("then") + F.col("size") / 2 <= F.col("left")
    chosen = placed.where(fits).select(*_SAMPLED, (F.col("size") > 0).cast("long").alias("more"))
    chosen = chosen.unionByName(again.select(*_SAMPLED, more.cast("long").alias("more")))
    chosen = chosen.unionByName(late.where(~small).select(*_SAMPLED, F.lit(0).cast("long").alias("more")))
    whole = F.col("epochs") + F.col("more")
    return chosen.select("doc_id", "source", "order_key", "size", "source_size", "target", whole.alias("whole"), (whole * F.col("size")).alias("taken"))


_SAMPLED = ("doc_id", "source", "order_key", "size", "source_size", "target", "epochs")


def _source_key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("key")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 7, **kw) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: each document, whole, as often as it is taken.

    Documents without words have nothing to give and are taken as often as their source's whole epochs say.
    """
    spread = lambda key: W.partitionBy(key).orderBy(F.lit(0))
    rows, doc_id, text = numbered(docs, id_col, text_col)
    plan = sampled_sizes(docs, id_col, source_col, text_col, seed, **kw).select(_row_key(F.col("doc_id"), F.col("order_key")).alias("plan_key"), "whole")
    plan = plan.withColumn("plan_place", F.row_number().over(spread("plan_key"))).where("whole > 0")
    order_key = F.xxhash64(F.lit(seed), F.col(doc_id).cast("string"), F.coalesce(F.col(text), F.lit("")))
    rows = rows.withColumn("row_key", _row_key(F.col(doc_id).cast("long"), order_key))
    # Repeated rows are paired one to one by their place among themselves; the equality of the places is kept
    # out of the join keys, so that the texts are shuffled once for the window and the join.
    rows = rows.withColumn("row_place", F.row_number().over(spread("row_key")))
    joined = rows.join(plan, F.expr("row_key = plan_key and row_place - plan_place = 0"))
    out = joined.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("whole").cast("int"))))
    return out.drop("row_key", "row_place", "plan_key", "plan_place", "whole", "copy").toDF(*docs.columns)


def _row_key(doc_id: Column, order_key: Column) -> Column:
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("none")), order_key.cast("string"))
