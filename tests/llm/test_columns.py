"""Operators on whole rows carry all columns, whatever their names; empty tables stay empty."""

import pytest
from brute import SCHEMA, awkward, documents

from pyspark.sql import functions as F

import corpus_pipeline
from voxlattice.llm import exact_dedup, langid, mixing, ngram_join

#: Names that operators use themselves, or that need quoting.
CLASHING = ["__body", "__keep_id", "__sha", "__pk", "__gone", "__text", "a.b", "c0", "c1", "key", "gone", "body", "sha", "keep_id", "kept", "row_key", "copy", "whole", "same", "rep",
            "size", "target", "lang_pred", "score", "class_id", "n", "group_size", "with space", "`tick`", "DOC", "id", "h"]


def wide(docs):
    return docs.select("*", *(F.concat(F.lit(f"{n}="), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in CLASHING))


OPERATORS = {
    "exact": exact_dedup.drop_exact_duplicates,
    "near": ngram_join.drop_near_duplicates,
    "mix": mixing.mix,
    "language": langid.drop_unidentified,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns(spark, name):
    narrow = documents(spark)
    got = OPERATORS[name](wide(narrow))
    assert got.columns == [*SCHEMA.names, *CLASHING]
    rows = [tuple(r) for r in got.collect()]
    assert sorted(map(str, (r[: len(SCHEMA)] for r in rows))) == sorted(str(tuple(r)) for r in OPERATORS[name](narrow).collect())
    for r in rows:
        assert list(r[len(SCHEMA) :]) == [f"{n}={'-' if r[0] is None else r[0]}" for n in CLASHING]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    got = OPERATORS[name](wide(documents(spark, [])))
    assert got.count() == 0 and got.columns == [*SCHEMA.names, *CLASHING]


def test_stages_on_an_empty_table_and_clashing_columns(spark):
    for rows in ([], awkward()):
        docs = wide(documents(spark, rows))
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "")
            assert docs.columns == [*SCHEMA.names, *CLASHING], name
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
        assert (packed.count() > 0) == bool(rows)
