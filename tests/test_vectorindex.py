"""Vectors by cell against the scan of all."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import retrieve, vectorindex

QUERIES = "qid bigint, vec array<float>, doc_filter string"


def rows_of(df):
    return sorted((r["qid"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in df.collect())


def clustered(n, size, groups, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, size)) * 3
    return (centres[rng.integers(0, groups, n)] + rng.normal(size=(n, size))).astype(np.float32)


@pytest.fixture(scope="module")
def made(spark):
    x = clustered(1500, 16, 25, 3)
    x[7] = x[8] = x[9]  # ties
    x[10] = 0
    rows = [(f"c{i}", i % 9, [float(v) for v in r]) for i, r in enumerate(x)] + [("null", 1, None)]
    vectors = spark.createDataFrame(rows, "chunk_id string, doc_id bigint, embedding array<float>")
    asked = [(i, [float(v) for v in r], None if i % 4 else str(i % 9)) for i, r in enumerate(clustered(40, 16, 25, 3) + 0.1)] + [(99, [0.0] * 16, None), (98, [float(v) for v in x[9]], None)]
    return vectors, spark.createDataFrame(asked, QUERIES), vectorindex.build(vectors, cells=30, k=10)


def test_exact_search_equals_the_scan(made):
    vectors, queries, index = made
    whole = vectors.where("embedding is not null")
    for k, floor in ((10, 0.0), (3, 0.9), (2000, 0.0)):
        assert rows_of(index.search(queries, k, floor, exact=True)) == rows_of(retrieve.vector_topk(queries, whole, k, floor))


def test_probes_find_most_neighbours_and_read_few_cells(made, spark):
    vectors, queries, index = made
    free = queries.where("doc_filter is null and qid < 90")
    true = {(r["qid"], r["chunk_id"]) for r in retrieve.vector_topk(free, vectors.where("embedding is not null"), 10).collect()}
    found = {(r["qid"], r["chunk_id"]) for r in index.search(free, 10).collect()}
    assert len(true & found) / len(true) >= 0.9
    assert index.probes <= len(index.centres) / 3  # groups are far apart
    one = free.where("qid = 1")
    asked = vectorindex._nearest_cells(one, index.centres, index.probes)
    cells = asked.first()["cells"]
    assert len(cells) == index.probes
    read = index.table.where(F.col("cell").isin(cells))
    assert 0 < len(read.inputFiles()) < len(index.table.inputFiles()) or len(cells) < len(index.centres)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cell" in plan.split("PartitionFilters")[1][:200]


def test_many_questions_are_dealt_out_by_cell(made, monkeypatch):
    vectors, queries, index = made
    want = rows_of(index.search(queries, 5))
    monkeypatch.setattr(vectorindex, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(vectorindex, "VECTOR_BLOCK", 20)
    assert rows_of(index.search(queries, 5)) == want


def test_recall_on_the_given_vectors(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors = e.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("doc_id"), "embedding")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"), F.lit(None).cast("string").alias("doc_filter"))
    index = vectorindex.build(vectors)
    assert index.table.count() == e.count()  # every row is indexed
    true = {(r["qid"], r["chunk_id"]) for r in retrieve.vector_topk(queries, vectors, 15).collect()}
    found = {(r["qid"], r["chunk_id"]) for r in index.search(queries, 15).collect()}
    assert len(true & found) / len(true) >= 0.9


def test_tables_without_vectors(spark, made):
    none = spark.createDataFrame([], "chunk_id string, doc_id bigint, embedding array<float>")
    index = vectorindex.build(none)
    assert index.search(made[1], 5, exact=True).count() == 0
    full = made[2].search(made[1].limit(0), 5, exact=True)
    assert full.count() == 0
