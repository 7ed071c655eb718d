"""The jobs as queries: each runs twice into one new folder, and what stands there then is the result.

The second run finds nothing new, so the result is that of one run; tests let the input grow in between."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import ingest_documents, refresh_graph
from quarry.operators.shared import shared_folder
from quarry.plans.sql import CHUNKS, EDGES, ENTITIES, GRAPH, with_


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = ingest_documents.Settings(documents=f"{sf_dir}/documents.parquet", output=_folder(spark, "job1"))
    ingest_documents.run(spark, config)
    return ingest_documents.run(spark, config)


def job2_refresh_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = refresh_graph.Settings(tables=sf_dir, output=_folder(spark, "job2"))
    refresh_graph.run(spark, config)
    return refresh_graph.run(spark, config)


QUERIES = {"job1_ingest_documents": job1_ingest_documents, "job2_refresh_graph": job2_refresh_graph}

ORACLE_SQL = {
    "job1_ingest_documents": with_(
        CHUNKS,
        "words AS (SELECT DISTINCT chunk_id, doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM chunks)",
        "counted AS (SELECT doc_id, count(*) AS n_words FROM words WHERE length(w) BETWEEN 2 AND 20 GROUP BY 1)",
        "cut AS (SELECT doc_id, count(*) AS n_chunks FROM chunks GROUP BY 1)",
        "taken AS (SELECT d.doc_id, source, lang, sha256(d.text) AS content_hash, n_chunks, coalesce(n_words, 0) AS n_words FROM documents d JOIN cut USING (doc_id) LEFT JOIN counted USING (doc_id))",
        select="SELECT *, nullif(min(doc_id) OVER (PARTITION BY content_hash), doc_id) AS duplicate_of FROM taken",
        recursive=True,
    ),
    "job2_refresh_graph": with_(
        GRAPH, EDGES, ENTITIES,
        select="SELECT src_key, s.type AS src_type, relation, dst_key, d.type AS dst_type, weight, edges.n_chunks FROM edges JOIN entities s ON s.entity_key = src_key JOIN entities d ON d.entity_key = dst_key",
    ),
}
