"""Registered queries against DuckDB, and the pipeline."""
import numpy as np
import pytest

import __spark_entry__ as E
import corpus_pipeline
from millwright.llm import queries
from millwright.llm.ngram_join import ngram_jaccard_join
from oracle import duck, matches

SF = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    numbers = sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(E.queries())


@pytest.mark.parametrize("name", [k for k, v in queries.QUERIES.items() if v[1]])
def test_query_equals_sql(spark, name):
    query, sql = queries.QUERIES[name]
    assert matches(query(spark, SF), duck(SF), sql) > 0


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out, columns = docs, docs.columns
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, SF)
        assert out.columns == columns, name
        out = corpus_pipeline.settled(out, f"test-{name}")
        sizes.append(out.count())
        if name == "near_duplicates":
            assert ngram_jaccard_join(out).filter("n_links > 0").count() == 0
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = corpus_pipeline.quality(spark, docs, SF)
    kept = {r["doc_id"] for r in good.select("doc_id").collect()}
    assert np.mean([(i in kept) == (q == 1) for i, q in labels.items()]) > 0.9
    assert sizes[0] >= sizes[1] >= sizes[2] > 0
    pieces = corpus_pipeline.packed(spark, out, SF)
    assert pieces.select("doc_id").distinct().count() == out.select("doc_id").distinct().count()
