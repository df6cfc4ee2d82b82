"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside cells, one representative each.

Vectors are compared within a label only. A label with more than ``cell_rows`` vectors is cut into cells by spherical
k-means fitted on a bounded sample; every vector is assigned. Two unit vectors with cosine >= t are at most
d = sqrt(2 - 2t) apart. If their nearest centroids are A and B, the distances of the two from the bisecting plane of A
and B add up to at most d, so one of them is within d / 2 of it. Each vector therefore also visits every cell to
whose plane it is within d / 2, and a pair across cells is compared where one visits the other: no link is lost.

Equal vectors are collapsed first and counted with their number. A cell larger than ``block_rows`` is cut into
blocks and compared block by block, so a hot group is many bounded tasks. A block pair gives each vector's number
of links and a spanning forest of them, never the pairs; components come from contraction of these forests.

Defined results: a row with null label, or whose vector is null, empty, zero or has null or non-finite components,
links with nothing (0 links, its own component, kept); so does a row with a null id, whose component is null
and which is kept; vectors of different length never link; repeated rows are vectors of their own (an id that
occurs twice names one component); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlattice.llm.components import connected_components
from voxlattice.llm.groups import map_groups, spanning_forest
from voxlattice.llm.scratch import staged

#: Vectors that k-means reads at most.
SAMPLE_ROWS = 20_000


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows in double precision."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Unit centroids (at most k) of unit rows."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        best = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, best, x)
        norms = np.linalg.norm(sums, axis=1)
        used = norms > 1e-9
        centres = np.unique(sums[used] / norms[used, None], axis=0)
    return centres


def visits(x: np.ndarray, centres: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each row and, as a boolean matrix, the other cells that it visits."""
    dots = x @ centres.T
    home = dots.argmax(axis=1)
    own = dots[np.arange(len(x)), home][:, None]
    apart = np.sqrt(np.maximum(0, 2 - 2 * (centres @ centres.T)))[home]
    reach = np.sqrt(max(0.0, 2 - 2 * threshold)) / 2 + 1e-9
    also = (own - dots) <= reach * apart
    also[np.arange(len(x)), home] = False
    return home, also


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    cell_rows: int = 2048, block_rows: int = 2048, seed: int = 0) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row per row of ``vectors``."""
    spark = vectors.sparkSession
    v = F.col("v")
    sound = (
        F.col("label").isNotNull()
        & F.coalesce(F.size(v) > 0, F.lit(False))
        & ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
        & F.exists(v, lambda e: e != 0)
    )
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("label", F.when(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)), F.concat_ws("/", F.size(v), "label")))
    rows = staged(rows.withColumn("same", F.when(F.col("label").isNotNull(), F.sha2(F.concat_ws(",", "label", v.cast("array<string>")), 256))), "vectors")
    usable = rows.where("label is not null")
    distinct = staged(
        usable.groupBy("same").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("v").alias("v")), "distinct"
    )

    # Labels with more than one cell; their number is below rows / cell_rows.
    large = {r["label"]: r["n"] for r in distinct.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell_rows).collect()}
    centres: dict[str, np.ndarray] = {}
    if large:
        share = min(1.0, SAMPLE_ROWS / sum(large.values()))
        wanted = distinct.where(F.col("label").isin(list(large)) & (F.pmod(F.xxhash64("same"), F.lit(1 << 30)) < int(share * (1 << 30))))
        sample = wanted.select("label", "v").limit(2 * SAMPLE_ROWS).toArrow()
        names = np.array(sample.column("label").to_pylist())
        for label, n in sorted(large.items()):
            mine = sample.filter(pa.array(names == label))
            if mine.num_rows:
                centres[label] = spherical_kmeans(_matrix(mine.column("v")), -(-n // cell_rows), seed=seed)
    held = spark.sparkContext.broadcast(centres)

    def assign(batches):
        for batch in batches:
            labels = np.array(batch.column("label").to_pylist(), dtype=object)
            for label in dict.fromkeys(labels.tolist()):
                part = batch.filter(pa.array(labels == label))
                if label not in held.value:
                    at, cell = np.arange(part.num_rows), np.zeros(part.num_rows, np.int32)
                    home, lists = cell, [[]] * part.num_rows
                else:
                    nearest, also = visits(_matrix(part.column("v")), held.value[label], threshold)
                    r, c = np.nonzero(also)
                    lists = [c[a:b].tolist() for a, b in zip(*(np.searchsorted(r, np.arange(part.num_rows), side=s) for s in ("left", "right")), strict=True)]
                    at = np.concatenate([np.arange(part.num_rows), r])
                    cell, home = np.concatenate([nearest, c]), nearest[at]
                    lists = [lists[i] for i in at]
                yield pa.record_batch(
                    [
                        *(part.column(x).take(pa.array(at)) for x in ("rep", "n", "label", "v")),
                        pa.array(cell, pa.int32()), pa.array(home, pa.int32()), pa.array(lists, pa.list_(pa.int32())),
                    ],
                    names=["rep", "n", "label", "v", "cell", "home", "visits"],
                )

    members = distinct.select("rep", "n", "label", "v").mapInArrow(assign, "rep long, n long, label string, v array<double>, cell int, home int, visits array<int>")
    members = staged(members, "members")
    blocks = members.groupBy("label", "cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks")).select(F.col("label").alias("l"), F.col("cell").alias("c"), "blocks")
    # Both sides of a block pair meet under one key; a cell of one block is one group.
    members = members.join(blocks, F.concat("label", F.lit("")).eqNullSafe(F.concat("l", F.lit(""))) & (F.col("cell") == F.col("c")))
    members = members.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pair = F.concat_ws("/", F.least("block", "other"), F.greatest("block", "other"))
    members = members.select(F.concat_ws("/", "label", "cell", pair).alias("gid"), "rep", "n", "v", "cell", "home", "visits", (F.col("block") <= F.col("other")).alias("low"), (F.col("block") >= F.col("other")).alias("high"))

    def compare(groups):
        out = [[], [], []]
        for g in groups:
            n = g.num_rows
            if n < 2:
                continue
            x = _matrix(g.column("v"))
            rep, weight, home = (g.column(c).to_numpy() for c in ("rep", "n", "home"))
            cell = g.column("cell")[0].as_py()
            low, high = (g.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("low", "high"))
            both = bool((low & high).all())
            left, right = (np.arange(n), np.arange(n)) if both else (np.flatnonzero(low & ~high), np.flatnonzero(high & ~low))
            if not len(left) or not len(right):
                continue
            guest = home != cell
            # A pair of a guest and a resident may also meet in the guest's home; the smaller cell counts it.
            back = [set(s or ()) for s in g.column("visits").to_pylist()]
            links, ea, eb = np.zeros(n, np.int64), [], []
            for a in range(0, len(left), 1024):
                la = left[a : a + 1024]
                r, c = np.nonzero(x[la] @ x[right].T >= threshold)
                i, j = la[r], right[c]
                keep = (i < j) if both else np.ones(len(i), bool)
                keep &= ~(guest[i] & guest[j])
                i, j = i[keep], j[keep]
                mixed = np.flatnonzero(guest[i] ^ guest[j])
                if len(mixed):
                    ok = np.ones(len(i), bool)
                    for p in mixed.tolist():
                        stranger, host = (i[p], j[p]) if guest[i[p]] else (j[p], i[p])
                        ok[p] = not (home[stranger] in back[host] and home[stranger] < cell)
                    i, j = i[ok], j[ok]
                np.add.at(links, i, weight[j])
                np.add.at(links, j, weight[i])
                for child, root in spanning_forest(i, j, n):
                    ea.append(child)
                    eb.append(root)
            if ea:
                for child, root in spanning_forest(np.array(ea), np.array(eb), n):
                    out[0].append(int(rep[child])), out[1].append(int(rep[root])), out[2].append(0)
            for k in np.flatnonzero(links).tolist():
                out[0].append(int(rep[k])), out[1].append(None), out[2].append(int(links[k]))
        if out[0]:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in out], names=["a", "b", "links"])

    found = staged(map_groups(members, "gid", compare, "a long, b long, links long"), "links")
    counts = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("b is not null"))
    of_rep = (
        distinct.select("same", "rep", "n")
        .join(counts, F.col("rep") == F.col("a"), "left")
        .join(parts, F.col("rep") == F.col("node"), "left")
        .select(
            F.concat("same", F.lit("")).alias("s"),
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    out = rows.join(of_rep, F.concat("same", F.lit("")) == F.col("s"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")
    )
