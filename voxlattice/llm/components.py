"""Connected components over an edge table, by repeated contraction in an order that changes every round."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlattice.llm.groups import spanning_forest
from voxlattice.llm.scratch import discard, staged, veiled

#: So many edges, a few MB, are finished in one task instead of by further rounds.
FINISH_EDGES = 100_000


def _rank(name: str, turn: int) -> Column:
    """Where a name stands in the order of this round; different names have different ranks."""
    return F.xxhash64(F.lit(turn), F.col(name))


def _finish(batches):
    """All remaining edges at once: every node and the root of its component."""
    ends = [np.stack([b.column(c).to_numpy() for c in ("a", "b")]) for b in batches if b.num_rows]
    if ends:
        nodes, place = np.unique(np.concatenate(ends, axis=1), return_inverse=True)
        place, root = place.reshape(2, -1), np.arange(len(nodes))
        for child, top in spanning_forest(place[0], place[1], len(nodes)):
            root[child] = top
        yield pa.record_batch([pa.array(nodes), pa.array(nodes[root])], names=["u", "p"])


def connected_components(edges: DataFrame, finish_edges: int = FINISH_EDGES) -> DataFrame:
    """``edges(a, b)`` of ids -> ``(node, component)``, component being the smallest id of the node's component.

    Each round renames every node to the first of itself and its neighbours, in an order drawn anew by hash, and
    keeps the edges that still join two names. On any graph, chains of ascending ids among them, a round is expected
    to leave at most two thirds of the names that have edges; the last one of every component always goes, so the
    rounds end by themselves. Names of a round are mapped to those of the last one backwards, from small tables to
    large ones, and the smallest id of each class is taken at the end. All steps are aggregates and equi-joins, so a
    node with very many edges is pre-aggregated before the shuffle and split by AQE in the join. Nothing is collected; the
    last ``finish_edges`` edges are finished in one task.
    Self loops only name their node. An empty table gives an empty result; rows with a null end are ignored.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null")
    live = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    steps = []
    while n_edges := live.count():
        if n_edges <= finish_edges:
            steps.append(staged(live.coalesce(1).mapInArrow(_finish, "u long, p long"), "names"))
            break
        turn = len(steps)
        both = live.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(live.select(F.col("b"), F.col("a")))
        first = both.groupBy("u").agg(F.min_by("v", _rank("v", turn)).alias("m"))
        step = staged(first.select("u", F.when(_rank("m", turn) < _rank("u", turn), F.col("m")).otherwise(F.col("u")).alias("p")), "names")
        steps.append(step)
        left = step.select(F.col("u").alias("a"), F.col("p").alias("pa"))
        right = step.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        moved = live.join(left, "a").join(right, "b").where("pa <> pb")
        before, live = live, staged(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        discard(before)
    discard(live)
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    names = steps.pop()
    while steps:
        later = names.select(F.col("u").alias("k"), F.col("p").alias("q"))
        step, shorter = steps.pop(), names
        names = staged(step.join(later, F.col("p") == F.col("k"), "left").select("u", F.coalesce("q", "p").alias("p")), "components")
        discard(step, shorter)
    least = names.groupBy("p").agg(F.min("u").alias("component")).select(veiled(F.col("p")).alias("k"), "component")
    out = staged(names.join(least, veiled(F.col("p")) == F.col("k")).select(F.col("u").alias("node"), "component"), "components")
    discard(names)
    return out
