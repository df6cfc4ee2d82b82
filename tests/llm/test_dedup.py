"""Exact dedup, n-gram join, embeddings, components: against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from brute import SCHEMA, awkward, components, documents, jaccard_links, shingles
from pyspark.sql import functions as F

from voxlattice.llm import embedding_dedup, exact_dedup, groups, ngram_join
from voxlattice.llm.components import connected_components


def test_exact_dedup(spark):
    got = exact_dedup.exact_dedup(documents(spark)).collect()
    groups_ = defaultdict(list)
    for r in awkward():
        groups_[r[1] or ""].append(r[0])
    assert len(got) == len(awkward())
    for text, members in groups_.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        rows = [r for r in got if r["text_sha256"] == sha]
        best = max((m for m in members if m is not None), default=None)
        assert len(rows) == len(members) and {r["keep_id"] for r in rows} == {best} and {r["group_size"] for r in rows} == {len(members)}
        assert sum(r["kept"] for r in rows) == 1 and [r["doc_id"] for r in rows if r["kept"]] == [best]


def test_full_bytes_decide_when_digests_collide(spark):
    docs = documents(spark, [(i, f"text {i % 40}", "en", "a", 1) for i in range(120)])
    weak = lambda t: F.substring(exact_dedup.sha256_hex(t), 1, 1)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(exact_dedup.exact_dedup(docs, digest=weak)) == rows(exact_dedup.exact_dedup(docs))


def _batches_by_hand(batches):
    """For each batch, what its rows are among all rows so far."""
    seen, out = [], []
    for rows in batches:
        seen += rows
        want = []
        for i, t in rows:
            same = [j for j, u in seen if u == t]
            want.append((i, max(same), len(same), i == max(same), hashlib.sha256(t.encode()).hexdigest()))
        out.append(sorted(want))
    return out


@pytest.mark.parametrize("weak", [False, True])
def test_state_lasts_over_batches(spark, tmp_path, weak):
    """Also where one digest stands for many texts, of which the keepers came in earlier batches."""
    batches = [[(1, "a"), (2, "a"), (3, "b")], [(11, "a"), (12, "c"), (13, "b"), (5, "zzz")], [(20, "zzz"), (4, "c"), (21, "d")]]
    state = exact_dedup.KeyedState(spark, f"file://{tmp_path}/state")
    kw = {"digest": lambda t: F.lit("x")} if weak else {}
    for k, (rows, want) in enumerate(zip(batches, _batches_by_hand(batches), strict=True)):
        docs = documents(spark, [(i, t, "en", "a", 1) for i, t in rows])
        for _ in range(2):  # a repeated call changes nothing
            got = exact_dedup.exact_dedup(docs, state=state, batch=f"b{k}", **kw).collect()
            assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == want


def test_batch_goes_on_after_a_failure(spark, tmp_path, monkeypatch):
    docs = documents(spark, [(1, "a", "", "", 1), (2, "a", "", "", 1), (3, "b", "", "", 1)])
    state = exact_dedup.KeyedState(spark, f"file://{tmp_path}/state")

    def lost(*_):
        raise RuntimeError("between the log and the stream")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(exact_dedup, "settings", lost)
        exact_dedup.exact_dedup(docs, state=state, batch="one")
    assert (tmp_path / "state" / "log" / "one" / "_SUCCESS").exists()
    got = exact_dedup.exact_dedup(docs, state=state, batch="one").collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True)]
    # A batch that was lost while it was written is written anew.
    (tmp_path / "state" / "content" / "two").mkdir()
    (tmp_path / "state" / "content" / "two" / "part-0.parquet").write_bytes(b"cut")
    got = exact_dedup.exact_dedup(documents(spark, [(9, "b", "", "", 1)]), state=state, batch="two").collect()
    assert [(r["keep_id"], r["group_size"]) for r in got] == [(9, 2)]


def test_drop_exact_duplicates(spark):
    kept = exact_dedup.drop_exact_duplicates(documents(spark))
    assert kept.columns == SCHEMA.names
    assert Counter(r["text"] or "" for r in kept.collect()) == Counter({r[1] or "" for r in awkward()})
    assert exact_dedup.drop_exact_duplicates(documents(spark, [])).count() == 0
    assert exact_dedup.exact_dedup(documents(spark, [])).count() == 0


@pytest.mark.parametrize("finish", [0, 50, 100_000])
def test_components(spark, finish):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7), (5000, 4000)]
    df = spark.createDataFrame([*edges, (None, 1), (2, None)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df, finish_edges=finish).collect()}
    assert got == components({x for e in edges for x in e}, edges)
    assert connected_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("finish", [200, 100_000])
def test_components_of_long_chains(spark, finish):
    """Ascending ids, each linked to its predecessors only: names go by a share per round, not one by one."""
    n = 4000
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(n)] + [(i, i - rng.randint(1, 5)) for i in range(2 * n, 3 * n)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df, finish_edges=finish).collect()}
    assert got == components({x for e in edges for x in e}, edges)


def test_spanning_forest():
    a, b = np.array([0, 1, 5, 6, 2]), np.array([1, 2, 6, 7, 0])
    assert sorted(groups.spanning_forest(a, b, 9)) == [(1, 0), (2, 0), (6, 5), (7, 5)]
    assert groups.spanning_forest(np.array([], int), np.array([], int), 3) == []


def test_groups_are_whole_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.range(50).select((F.col("id") % 7).cast("string").alias("k"), "id")

        def count(tables):
            for t in tables:
                yield pa.record_batch([pa.array([t.column("k")[0].as_py()]), pa.array([t.num_rows])], names=["k", "n"])

        got = groups.map_groups(df, "k", count, "k string, n long").collect()
        assert sorted((r["k"], r["n"]) for r in got) == [(str(k), 8 if k == 0 else 7) for k in range(7)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def _near_texts(seed, n=60):
    """Families of near copies around the threshold, by replaced words."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for _ in range(n // 6):
        base = [word() for _ in range(rng.randint(30, 120))]
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = word()
            rows.append(" ".join(w))
    return rows


def _check_join(spark, rows, **kw):
    got = ngram_join.jaccard_join(spark.createDataFrame(rows, SCHEMA), **kw).collect()
    assert len(got) == len(rows)
    texts = defaultdict(list)
    for r in rows:
        if r[0] is not None and shingles(r[1]):
            texts[r[1]].append(r[0])
    rep = {t: min(v) for t, v in texts.items()}
    links = jaccard_links({v: k for k, v in rep.items()})
    comp, degree = components(set(rep.values()), links), Counter(x for p in links for x in p)
    text_of = {r[0]: r[1] for r in rows if r[0] is not None}
    for r in got:
        t = text_of.get(r["doc_id"])
        if r["doc_id"] is None or not shingles(t):
            assert (r["class_id"], r["n_links"], r["kept"]) == (r["doc_id"], 0, True)
        else:
            assert r["class_id"] == comp[rep[t]] and r["n_links"] == degree[rep[t]] and r["n_copies"] == len(texts[t]) - 1
            assert r["kept"] == (r["doc_id"] == comp[rep[t]])
    return links


@pytest.mark.parametrize("seed", range(3))
def test_jaccard_join(spark, seed):
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(_near_texts(seed))]
    assert _check_join(spark, rows)
    # Blocks of two documents give the same links.
    assert _check_join(spark, rows, block_rows=2)
    # Nodes of more than two documents keep long prefixes, or go back to short ones.
    assert _check_join(spark, rows, block_rows=2, node_rows=2)


def _templates(n=500):
    """Texts that share a third of their words with all others, some near copies, and one family of near copies."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    common = " ".join(word() for _ in range(60))
    rows = [f"{common} {' '.join(word() for _ in range(100))}" for _ in range(n)]
    rows += [r + " " + word() for r in rows[:20]]
    family = [word() for _ in range(200)]
    return rows + [" ".join(family[:k] + [word()] + family[k:]) for k in range(0, 200, 2)]


def test_common_passages_lengthen_prefixes(spark):
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(_templates())]
    assert len(_check_join(spark, rows, node_rows=16, block_rows=64)) > 20 + 4000
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("same", ngram_join._text_key(F.col("text")))
    signed = ngram_join._sign(docs.select("doc_id", "same", "text"), 24).withColumnRenamed("doc_id", "rep").select("rep", "nodes", "heads")
    sizes = {}
    for node_rows in (16, 10_000):
        paths = ngram_join.matched_paths(signed, 0.8, 24, 0.9995, node_rows)
        nodes = paths.select("rep", F.explode("nodes").alias("t", "node")).select("rep", "t", "node.*").collect()
        counted = Counter(r["key"] for r in nodes)
        assert all(counted[r["key"]] == r["n"] > 1 for r in nodes)
        sizes[node_rows] = max((r["n"] for r in nodes if r["rep"] < 500), default=0)
        # The family is alike all over: it goes back to the shortest prefixes, and only it.
        back = {r["rep"] for r in nodes if r["t"] >= 24}
        assert back <= set(range(520, 620)) and bool(back) == (node_rows == 16)
    assert sizes[16] <= 16 < sizes[10_000], "templates meet in small nodes at longer prefixes"


def test_jaccard_join_on_awkward_rows(spark):
    _check_join(spark, awkward())
    assert ngram_join.jaccard_join(documents(spark, [])).count() == 0
    kept = ngram_join.drop_near_duplicates(documents(spark))
    assert kept.columns == SCHEMA.names
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({1: 1, 3: 1, 4: 1, 5: 1, 7: 1, 8: 1, 9: 1, None: 2})


def test_recall_of_the_lengths():
    assert 1 - ngram_join.miss(0.8, [5] * 24) > 0.9999 > 1 - ngram_join.miss(0.8, [5] * 20 + [8] * 4) > 0.9995
    assert ngram_join.miss(1.0, [8]) == 0 and ngram_join.miss(0.5, [1, 1]) == 0.25


def test_one_id_with_several_texts(spark):
    """Each text has its own links; the id's rows stay or go one by one."""
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    other = "completely different words that have nothing to do with any other text in this small table of rows"
    rows = [(1, base, "en", "a", 1), (2, base + " x", "en", "a", 1), (2, other, "en", "a", 1), (3, other + " y", "en", "a", 1), (3, other + " y", "en", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r["doc_id"], r["class_id"], r["n_links"], r["kept"]) for r in ngram_join.jaccard_join(docs).collect())
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (2, 2, 1, True), (3, 2, 1, False), (3, 2, 1, False)]
    assert sorted((r["doc_id"], r["text"]) for r in ngram_join.drop_near_duplicates(docs).collect()) == [(1, base), (2, other)]


def test_shingle_sets():
    texts = ["a b c d e f", "a b c d e f  ", " a b", "", "a b c d e a b c d e", "é b c d e"]
    h, at = ngram_join.shingle_sets(pa.array(texts))
    sets = [set(h[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)]
    assert list(map(len, sets)) == [2, 2, 1, 0, 5, 1]
    assert sets[0] == sets[1] and len(sets[0] & sets[4]) == 1
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]


def _vectors(seed, n=400, dim=16):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    for i in range(n // 2, n):  # near copies of the first half, around the threshold
        x[i] = x[rng.integers(n // 2)] + rng.standard_normal(dim) * rng.choice([0, 0.02, 0.15, 0.25])
    return x.astype(np.float32)


@pytest.mark.parametrize("seed, cells, block", [(0, 2048, 2048), (1, 40, 2048), (2, 40, 16), (3, 60, 7)])
def test_embeddings(spark, seed, cells, block):
    x = _vectors(seed)
    labels = [i % 3 if i % 11 else None for i in range(len(x))]
    bad = [(9001, None, 0), (9002, [0.0] * 16, 0), (9003, [float("nan")] * 16, 0), (9004, [None] * 16, 0), (9005, [], 0), (9006, [float("inf")] + [1.0] * 15, 1), (None, x[0].tolist(), 0), (9007, x[0].tolist()[:5], 0)]
    rows = [(i, v.tolist(), lab) for i, (v, lab) in enumerate(zip(x, labels, strict=True))]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int")
    got = embedding_dedup.near_duplicates(df, cell_rows=cells, block_rows=block).collect()
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    cos = unit @ unit.T
    links = [(i, j) for i in range(len(x)) for j in range(i) if labels[i] is not None and labels[i] == labels[j] and cos[i, j] >= 0.98]
    degree, comp = Counter(k for p in links for k in p), components(range(len(x)), links)
    assert links and len(got) == len(rows) + len(bad)
    for r in got:
        k = r["vec_id"]
        if k is None or k > 9000:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, k, True)
        else:
            assert (r["n_links"], r["component_id"], r["kept"]) == (degree[k], comp[k], comp[k] == k), k
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_scratch_folder(spark):
    """The cluster's setting counts; without it, one temporary folder per application."""
    from types import SimpleNamespace

    from voxlattice.llm import scratch

    conf = lambda v: SimpleNamespace(get=lambda key, default=None: v)
    session = lambda v: SimpleNamespace(conf=conf(None), sparkContext=SimpleNamespace(getConf=lambda: conf(v), applicationId="app-x"))
    assert scratch.shared_root(session("hdfs:///shared/")) == "hdfs:///shared"
    own = scratch.shared_root(session(None))
    assert own.startswith("file:///") and own == scratch.shared_root(session(None))
    table = scratch.staged(spark.range(3), "t")
    assert table.count() == 3
    scratch.discard(table)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(table.staged_at)
