"""N-gram Jaccard join: MinHash LSH forest over word shingles, then exact verification.

A document is the set of its runs of ``SHINGLE_WORDS`` words (a shorter one: the single run of all its words). The
forest has ``trees`` tries. A document's path in a trie is a sequence of up to ``LONGEST`` min-hashes, the first
``SHORTEST`` of them the trie's own, the further ones borrowed from the tries after it. Two documents with Jaccard similarity s share
the first r steps of a path with probability s ** r; prefixes of ``SHORTEST`` steps meet a pair at the threshold in some of 24
tries with probability 0.9999.

Prefixes are shortened on the data. Sorted by prefix, a trie's documents form nodes. In a trie, a document is matched at the
shortest prefix whose node holds at most ``node_rows`` documents; where common passages make a node larger, its
documents stay at a longer prefix, in its children. What that costs in recall is reckoned for each document from the
lengths at which it is matched: while a pair at the threshold would be missed with more than 1 - ``target_recall``, the
document goes back to the shortest prefixes, whatever the size of their nodes, and meets there all others that do. So
documents that share a passage are spread over deep nodes, and only those that are alike all over meet in large ones.

Every pair is looked at in the first node that both are matched in, once. Nodes are first read without texts: the pairs
whose sizes allow the threshold name the documents that are needed there, and only these bring their texts. They are verified on
their exact shingle sets (as 64-bit hashes). A node above a bound is cut into blocks that are compared pair by pair, each block
pair a bounded task; it gives every text's number of links and a spanning forest, never the pairs. Components are made of
verified links only. Equal texts are collapsed before, so only different texts meet.

Defined results: null texts, empty texts and texts without words link with nothing and are classes of their
own, as are rows with a null id (class null); equal texts are one class; repeated rows are copies; other
columns are ignored by ``jaccard_join`` and carried by ``drop_near_duplicates``, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlattice.llm.components import connected_components
from voxlattice.llm.groups import map_groups, spanning_forest
from voxlattice.llm.packing import slices
from voxlattice.llm.scratch import BLOOM_JOIN, discard, numbered, settings, staged, veiled

SHINGLE_WORDS = 5
#: Steps of the shortest and of the longest prefixes that are matched.
SHORTEST, LONGEST = 5, 8
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: pa.Array, words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """All texts' shingles as 64-bit hashes, sorted and distinct within each text, and where each text begins.

    Words are runs of anything but white space, compared as they are.
    """
    import xxhash

    split = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    flat = pc.list_flatten(split).dictionary_encode()
    seeds = np.array([xxhash.xxh3_64_intdigest(w) for w in flat.dictionary.to_pylist()], np.uint64)
    empty = np.array([len(w) == 0 for w in flat.dictionary.to_pylist()], bool)
    codes = flat.indices.to_numpy(zero_copy_only=False)
    offsets = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
    if empty.any():  # white space at the ends gives empty words
        real = ~empty[codes]
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        codes = codes[real]
    hashes = seeds[codes] if len(seeds) else np.zeros(0, np.uint64)
    n = np.diff(offsets)
    padded = np.concatenate([hashes, np.zeros(words, np.uint64)])
    total = np.zeros(len(hashes), np.uint64)
    place = np.arange(len(hashes)) - np.repeat(offsets[:-1], n)
    left = np.repeat(n, n) - place
    for k in range(words):
        # Beyond the end of a short text a step adds nothing but its length.
        w = padded[k : k + len(hashes)] * (left > k)
        total = _mix(total * _M + w + np.uint64(k + 1))
    whole = (left >= words) | (place == 0)
    doc = np.repeat(np.arange(len(n)), n)[whole]
    total = total[whole]
    order = np.lexsort((total, doc))
    doc, total = doc[order], total[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (total[1:] != total[:-1])
    doc, total = doc[new], total[new]
    return total, np.searchsorted(doc, np.arange(len(n) + 1))


def miss(threshold: float, lengths: list[int]) -> float:
    """Chance that a pair at the threshold shares no prefix when the tries are matched at these lengths."""
    return math.prod(1 - threshold**r for r in lengths)


def forest_paths(shingles: np.ndarray, begins: np.ndarray, trees: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(texts, trees): hash of each text's first ``SHORTEST`` steps in each trie, and its first step alone in 16 bits.

    Texts must not be empty.
    """
    rng = np.random.default_rng(seed)
    odd = rng.integers(0, 1 << 63, (trees, SHORTEST), np.uint64) * np.uint64(2) + np.uint64(1)
    xor = rng.integers(0, 1 << 63, (trees, SHORTEST), np.uint64)
    nodes = np.empty((len(begins) - 1, trees), np.uint64)
    heads = np.empty((len(begins) - 1, trees), np.uint16)
    high = shingles >> np.uint64(32)
    for t in range(trees):
        path = np.full(len(nodes), np.uint64(t + 1))
        for d in range(SHORTEST):
            h = (shingles ^ xor[t, d]) * odd[t, d]
            h ^= high
            h *= odd[t, d]
            least = np.minimum.reduceat(h, begins[:-1])
            if d == 0:
                heads[:, t] = _mix(least) & np.uint64(0xFFFF)
            path = _mix(path * _M + least)
        nodes[:, t] = path
    return nodes, heads


def _candidates(paths: np.ndarray, sizes: np.ndarray, index: int, left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """(left, right): pairs whose first common node is this one, at ``index`` of their paths, and whose sizes allow the threshold."""
    big, small = np.maximum(sizes[left][:, None], sizes[right][None]), np.minimum(sizes[left][:, None], sizes[right][None])
    near = (small >= threshold * big - 1e-9) & (left[:, None] != right[None])
    for k in range(index):
        a = paths[left, k]
        if a.any():
            near &= (a[:, None] != paths[right, k][None]) | (a == 0)[:, None]
    return near


def _jaccard_links(sets: list[np.ndarray], paths: np.ndarray, index: int, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs (i in left, j in right) of this node that have Jaccard >= threshold, exactly.

    Candidates that lie densely are verified by a product of 0/1 matrices over the shared shingles, others by
    counting common elements pair by pair.
    """
    sizes = np.array([len(s) for s in sets])
    ri, rj = [], []
    for a in range(0, len(left), 256):
        la = left[a : a + 256]
        for b in range(0, len(right), 1024):
            rb = right[b : b + 1024]
            near = _candidates(paths, sizes, index, la, rb, threshold)
            if left is right:
                near &= la[:, None] < rb[None]
            i, j = np.nonzero(near)
            if not len(i):
                continue
            if len(i) <= 64 or len(i) * 20 < near.size:
                common = np.array([_common(sets[la[p]], sets[rb[q]]) for p, q in zip(i.tolist(), j.tolist(), strict=True)])
            else:
                common = _products([sets[k] for k in la], [sets[k] for k in rb])[i, j]
            union = sizes[la[i]] + sizes[rb[j]] - common
            hit = common >= threshold * union - 1e-9
            ri.append(la[i[hit]])
            rj.append(rb[j[hit]])
    none = np.zeros(0, np.int64)
    return (np.concatenate(ri), np.concatenate(rj)) if ri else (none, none)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _products(rows: list[np.ndarray], columns: list[np.ndarray], most: int = 4096) -> np.ndarray:
    """Sizes of all intersections, by matrix products over slices of the shingles that both sides have."""
    shared = np.intersect1d(np.unique(np.concatenate(rows)), np.unique(np.concatenate(columns)))
    out = np.zeros((len(rows), len(columns)))
    for a in range(0, len(shared), most):
        part = shared[a : a + most]
        sides = []
        for side in (rows, columns):
            m = np.zeros((len(side), len(part)), np.float32)
            for k, s in enumerate(side):
                own = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], side="right")]
                at = np.searchsorted(part, own)
                ok = part[np.minimum(at, len(part) - 1)] == own
                m[k, at[ok]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _sign(rows: DataFrame, trees: int) -> DataFrame:
    """``doc_id, same, size, nodes, heads`` of ``rows(doc_id, same, text)``: number of shingles and paths."""

    def sign(batches):
        for whole in batches:
            for batch in slices(whole, "text", 2_000_000):
                shingles, begins = shingle_sets(batch.column("text"))
                size = np.diff(begins)
                some = np.flatnonzero(size)
                nodes, heads = [None] * batch.num_rows, [None] * batch.num_rows
                if len(some):
                    path, head = forest_paths(shingles, np.append(begins[:-1][some], begins[-1]), trees)
                    path, head = path.view(np.int64), head.astype(np.int32)
                    for k, i in enumerate(some.tolist()):
                        nodes[i], heads[i] = path[k], head[k]
                yield pa.record_batch(
                    [batch.column("doc_id"), batch.column("same"), pa.array(size, pa.int64()), pa.array(nodes, pa.list_(pa.int64())), pa.array(heads, pa.list_(pa.int32()))],
                    names=["doc_id", "same", "size", "nodes", "heads"],
                )

    return rows.mapInArrow(sign, "doc_id long, same string, size long, nodes array<long>, heads array<int>")


def _nodes(rows: DataFrame) -> DataFrame:
    """The rows of ``rows(key, ...)`` whose key others have too, with the number ``n`` of them."""
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(counts.select(veiled(F.col("key")).alias("k"), "n"), veiled(F.col("key")) == F.col("k")).drop("k")


def matched_paths(distinct: DataFrame, threshold: float, trees: int, target_recall: float, node_rows: int) -> DataFrame:
    """``(rep, path, nodes)``: where each text of ``distinct(rep, nodes, heads)`` is matched, if anyone else is there.

    ``path`` has one number per trie for the adaptive prefix and one for the shortest prefix that the text went back to
    (0: nobody else), ``nodes`` the keys of the same nodes by place with the number of their texts.
    """
    spark = distinct.sparkSession
    further = LONGEST - SHORTEST
    # The steps that lengthen the path in trie t are the first ones of the tries after it.
    longer = F.expr(f"transform(sequence(1, {further}), d -> heads[(t + d) % {trees}])")
    steps = distinct.select("rep", F.posexplode("nodes").alias("t", "key"))
    with settings(spark, BLOOM_JOIN):
        met = staged(_nodes(steps).select("rep", "t", "key", "n"), "met")
    fits = met.where(F.col("n") <= node_rows).select("rep", "t", "key", "n")
    large = met.where(F.col("n") > node_rows)
    held = [met]
    if not large.isEmpty():
        heads = distinct.select(veiled(F.col("rep")).alias("r"), "heads")
        large = level = staged(large.join(heads, veiled(F.col("rep")) == F.col("r")).select("rep", "t", "key", longer.alias("longer")), "large")
        held.append(large)
        lengths = None
        for d in range(further):
            down = level.select("rep", "t", F.xxhash64("key", F.col("longer")[d]).alias("key"), "longer")
            level = staged(_nodes(down), "level")
            held.append(level)
            last = d == further - 1
            stay = level if last else level.where(F.col("n") <= node_rows)
            fits = fits.unionByName(stay.select("rep", "t", "key", "n"))
            here = stay.select("rep", "t", F.lit(SHORTEST + d + 1).alias("length"))
            lengths = here if lengths is None else lengths.unionByName(here)
            level = level.where(F.col("n") > node_rows).select("rep", "t", "key", "longer")
        # Where nobody else has the longer prefix, it counts as the longest.
        lengths = large.select("rep", "t").join(lengths, ["rep", "t"], "left").withColumn("length", F.coalesce("length", F.lit(LONGEST)))
        gain = F.expr("sum(ln((1 - pow({s}, length)) / (1 - pow({s}, {r}))))".format(s=threshold, r=SHORTEST))
        worst = math.log(1 - target_recall) - math.log(miss(threshold, [SHORTEST] * trees))
        back = lengths.groupBy("rep").agg(gain.alias("gain")).where(F.col("gain") > worst).select("rep")
        again = large.join(back, "rep", "left_semi").select("rep", (F.col("t") + trees).alias("t"), F.xxhash64("key", F.lit("short")).alias("key"))
        fits = fits.unionByName(_nodes(again).select("rep", "t", "key", "n"))
    fits = staged(fits, "fits")
    discard(*held)
    paths = fits.groupBy("rep").agg(F.map_from_entries(F.collect_list(F.struct("t", F.struct("key", "n")))).alias("at"))
    # 31 bits tell nodes of one trie apart as far as pairs are concerned that meet in another one.
    number = F.expr(f"transform(sequence(0, {2 * trees - 1}), t -> coalesce(cast(at[t].key & 2147483646 as int) + 1, 0))")
    out = staged(paths.select("rep", number.alias("path"), F.col("at").alias("nodes")), "paths")
    discard(fits)
    return out


def _blocks(placed: DataFrame, blocks: Column) -> DataFrame:
    """``placed(key, rep, ...)`` -> one row per block pair: ``gid, low, high``; the number of blocks is ``blocks``."""
    placed = placed.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    gid = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    return placed.withColumn("gid", gid).withColumn("low", F.col("block") <= F.col("other")).withColumn("high", F.col("block") >= F.col("other")).drop("blocks", "block", "other")


def _sides(g: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The two blocks that a group compares; the same array twice if it is one block with itself."""
    low, high = (g.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("low", "high"))
    if (low & high).all():
        every = np.arange(g.num_rows)
        return every, every
    return np.flatnonzero(low & ~high), np.flatnonzero(high & ~low)


def _paths_of(g: pa.Table) -> np.ndarray:
    return g.column("path").combine_chunks().flatten().to_numpy().reshape(g.num_rows, -1)


def _links(docs: DataFrame, distinct: DataFrame, paths: DataFrame, texts: DataFrame, threshold: float, block_rows: int, block_words: int) -> DataFrame:
    """``(a, b, links)``: a spanning forest of the links (b not null), and each text's number of links by node (b null)."""
    spark = docs.sparkSession
    sized = paths.join(distinct.select(F.col("rep").alias("r"), "size"), F.col("rep") == F.col("r")).drop("r")
    at = sized.select("rep", "path", "size", F.explode("nodes").alias("t", "node")).select("rep", "path", "size", "t", "node.key", "node.n")

    def need(groups):
        out = [[], [], []]
        for g in groups:
            left, right = _sides(g)
            if g.num_rows < 2 or not len(left) or not len(right):
                continue
            size, path = g.column("size").to_numpy(), _paths_of(g)
            index, used = g.column("t")[0].as_py(), np.zeros(g.num_rows, bool)
            for a in range(0, len(left), 256):
                for b in range(0, len(right), 1024):
                    near = _candidates(path, size, index, left[a : a + 256], right[b : b + 1024], threshold)
                    used[left[a : a + 256]] |= near.any(1)
                    used[right[b : b + 1024]] |= near.any(0)
            some = np.flatnonzero(used)
            if len(some):
                rep = g.column("rep").to_numpy()
                out[0] += [g.column("key")[0].as_py()] * len(some)
                out[1] += [index] * len(some)
                out[2] += rep[some].tolist()
        if out[0]:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["key", "t", "rep"])

    looked = _blocks(at, F.ceil(F.col("n") / block_rows))
    needed = staged(map_groups(looked.select("gid", "key", "t", "rep", "size", "path", "low", "high"), "gid", need, "key long, t int, rep long").distinct(), "needed")

    extent = needed.join(distinct.select("rep", "size"), "rep").groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("words"))
    extent = extent.select(veiled(F.col("key")).alias("e"), "m", "words")
    brought = needed.join(extent, veiled(F.col("key")) == F.col("e")).join(paths.select(F.col("rep").alias("r"), "path"), F.col("rep") == F.col("r"))
    # Blocks hold at most ``block_rows`` texts and about ``block_words`` shingles.
    brought = _blocks(brought.drop("r"), F.greatest(F.ceil(F.col("m") / block_rows), F.ceil(F.col("words") / block_words)))
    # Texts come back for those needed only; a Bloom filter on their ids keeps the others out of the shuffle.
    reps = staged(needed.select("rep").distinct().join(distinct.select("rep", "rep0", "same"), "rep"), "reps")
    wanted = reps.where("same > ''")  # a filter, without which Spark makes no Bloom filter
    back = texts.join(wanted, (F.col("doc_id") == F.col("rep0")) & (F.col("body") == F.col("same"))).select(F.col("rep").alias("i"), "text").dropDuplicates(["i"])
    with settings(spark, BLOOM_JOIN):
        back = staged(back, "texts")
    brought = brought.join(back, F.col("rep") == F.col("i")).select("gid", "t", "rep", "path", "low", "high", "text")

    def verify(groups):
        out = [[], [], []]
        for g in groups:
            left, right = _sides(g)
            if g.num_rows < 2 or not len(left) or not len(right):
                continue
            n, rep = g.num_rows, g.column("rep").to_numpy()
            shingles, begins = shingle_sets(g.column("text").combine_chunks())
            sets = [shingles[a:b] for a, b in zip(begins[:-1], begins[1:], strict=True)]
            i, j = _jaccard_links(sets, _paths_of(g), g.column("t")[0].as_py(), left, right, threshold)
            links = np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
            for child, root in spanning_forest(i, j, n):
                out[0].append(int(rep[child])), out[1].append(int(rep[root])), out[2].append(0)
            for k in np.flatnonzero(links).tolist():
                out[0].append(int(rep[k])), out[1].append(None), out[2].append(int(links[k]))
        if out[0]:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in out], names=["a", "b", "links"])

    found = staged(map_groups(brought, "gid", verify, "a long, b long, links long"), "links")
    discard(needed, back, reps)
    return found


def _classes(docs: DataFrame, threshold: float, id_col: str, text_col: str, trees: int, target_recall: float, node_rows: int, block_rows: int, block_words: int) -> DataFrame:
    """What ``jaccard_join`` returns, with ``same``, the key of the row's text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.when(F.col(id_col).isNotNull(), F.col(text_col)).alias("text"))
    keyed = rows.withColumn("same", _text_key(F.col("text")))
    signed = staged(_sign(keyed, trees), "signed")
    # Of copies the smallest id stands for the text.
    distinct = signed.where("size > 0").groupBy("same")
    distinct = staged(distinct.agg(F.min("doc_id").alias("rep0"), F.count(F.lit(1)).alias("copies"), *(F.first(c).alias(c) for c in ("size", "nodes", "heads"))), "distinct")
    distinct = _told_apart(distinct)
    paths = matched_paths(distinct.select("rep", "nodes", "heads"), threshold, trees, target_recall, node_rows)
    texts = keyed.select("doc_id", F.col("same").alias("body"), "text")
    found = _links(docs, distinct, paths, texts, threshold, block_rows, block_words)
    discard(paths)
    counts = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("b is not null"))
    # The smallest id of a component, which is its name where ids and texts go together.
    least = parts.join(distinct.select("rep", "rep0"), F.col("node") == F.col("rep")).groupBy("component").agg(F.min("rep0").alias("class"))
    parts = parts.join(least.select(veiled(F.col("component")).alias("c"), "class"), veiled(F.col("component")) == F.col("c")).select("node", "class")
    of_text = (
        distinct.select("same", "rep", "rep0", "copies")
        .join(counts, F.col("rep") == F.col("a"), "left")
        .join(parts, F.col("rep") == F.col("node"), "left")
        .select(F.concat("same", F.lit("")).alias("s"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("class", "rep0").alias("class"), (F.col("copies") - 1).alias("others"))
    )
    out = signed.select("doc_id", F.when(F.col("size") > 0, F.concat("same", F.lit(""))).alias("same")).join(of_text, F.col("same") == F.col("s"), "left")
    return out.select(
        "doc_id",
        F.coalesce("class", "doc_id").alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("others", F.lit(0)).cast("long").alias("n_copies"),
        F.coalesce(F.col("doc_id") == F.coalesce("class", "doc_id"), F.lit(True)).alias("kept"),
        "same",
    )


def _told_apart(distinct: DataFrame) -> DataFrame:
    """``distinct(same, rep0, ...)`` with ``rep``: the id, or a number made of the text where an id has several texts."""
    several = distinct.groupBy("rep0").agg(F.min("same").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    if several.isEmpty():
        return distinct.withColumn("rep", F.col("rep0"))
    marked = distinct.join(several.select(F.col("rep0").alias("r"), "first"), F.col("rep0") == F.col("r"), "left")
    other = F.col("first").isNotNull() & (F.col("first") != F.col("same"))
    out = staged(marked.withColumn("rep", F.when(other, F.xxhash64("same", "rep0")).otherwise(F.col("rep0"))).drop("r", "first"), "distinct")
    discard(distinct)
    return out


def jaccard_join(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", trees: int = 24, target_recall: float = 0.9995,
                 node_rows: int = 1024, block_rows: int = 256, block_words: int = 500_000) -> DataFrame:
    """``doc_id, class_id, n_links, n_copies, kept`` for every row.

    ``class_id`` is the smallest id that links reach, ``n_links`` the number of different texts with similarity
    >= ``threshold``, ``n_copies`` the number of other rows with the same text, ``kept`` whether the row is the
    one of its class that stays (smallest id). Texts that share one id are told apart.
    """
    return _classes(docs, threshold, id_col, text_col, trees, target_recall, node_rows, block_rows, block_words).drop("same")


def _text_key(text: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32)


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns: the smallest id of each class. Rows with null id stay.

    Rows that repeat id and text are copies; one of them stays.
    """
    plain, doc_id, text = numbered(docs, id_col, text_col)
    options = {"trees": 24, "target_recall": 0.9995, "node_rows": 1024, "block_rows": 256, "block_words": 500_000} | kw
    found = staged(_classes(docs, threshold, id_col, text_col, **options), "classes")
    key = F.struct(F.col(doc_id).cast("long").alias("i"), _text_key(F.col(text)).alias("s"))
    gone = found.where("not kept").select(F.struct(F.col("doc_id").alias("i"), F.col("same").alias("s")).alias("gone")).distinct()
    out = plain.withColumn("key", key).join(gone, F.col("key") == F.col("gone"), "left_anti")
    # Only where rows repeat id and text is a second pass needed.
    if not found.where("kept and n_copies > 0 and doc_id is not null").groupBy("doc_id", "same").count().where("count > 1").isEmpty():
        again = out.where(F.col("key.i").isNotNull() & F.col(text).rlike(r"\S")).dropDuplicates(["key"])
        out = out.where(F.col("key.i").isNull() | ~F.coalesce(F.col(text).rlike(r"\S"), F.lit(False))).unionByName(again)
    return out.drop("key").toDF(*docs.columns)
