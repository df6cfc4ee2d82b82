"""The pipeline's stages against plain versions on a small corpus."""

from collections import Counter

from brute import SCHEMA, awkward, components, documents, jaccard_links

from pyspark.sql import functions as F

import corpus_pipeline
from voxlattice.llm import langid, mixing
from voxlattice.llm.scratch import staged


def test_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "ngram_jaccard_join", "source_mixing", "packing"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(documents(spark).withColumn("doc_id", F.col("doc_id") + 1000)).coalesce(2)
    start = docs = staged(docs, "docs")
    want = {r["doc_id"]: r for r in langid.identify(docs).collect() if r["lang_pred"] != "und" and r["score"] >= 0.3}
    docs = staged(corpus_pipeline.STAGES[0][1](spark, docs, ""), "s1")
    rows = docs.collect()
    assert docs.columns == SCHEMA.names and {r["doc_id"] for r in rows} == set(want)
    assert len(rows) >= start.count() - 6, "clean documents stay"

    last = {}
    for r in rows:
        last[r["text"]] = max(last.get(r["text"], -1), -1 if r["doc_id"] is None else r["doc_id"])
    docs = staged(corpus_pipeline.STAGES[1][1](spark, docs, ""), "s2")
    rows = docs.collect()
    assert Counter(-1 if r["doc_id"] is None else r["doc_id"] for r in rows) == Counter(last.values())

    texts = {r["doc_id"]: r["text"] for r in rows if r["doc_id"] is not None}
    comp = components(texts, jaccard_links(texts))
    docs = staged(corpus_pipeline.STAGES[2][1](spark, docs, ""), "s3")
    rows = docs.collect()
    assert {r["doc_id"] for r in rows if r["doc_id"] is not None} == {d for d, c in comp.items() if d == c}

    plan = {(r["doc_id"]): r for r in mixing.sampled_sizes(docs).collect()}
    docs = staged(corpus_pipeline.STAGES[3][1](spark, docs, ""), "s4")
    rows = docs.collect()
    copies = Counter(r["doc_id"] for r in rows)
    assert docs.columns == SCHEMA.names
    assert copies == Counter({d: p["whole"] for d, p in plan.items() if p["whole"]})

    packed = corpus_pipeline.STAGES[4][1](spark, docs, "").collect()
    first = Counter(r["doc_id"] for r in packed if r["start"] == 0)
    assert first == copies
    fill = Counter()
    for r in packed:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 4096


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert len(awkward()) > 0
