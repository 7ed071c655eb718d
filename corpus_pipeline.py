"""A training-data pipeline over ``documents``: language ID, line dedup, near-dedup by word shingles,
pseudonyms for personal data, best-fit packing.

Every stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and
read back as the next one's docs.  All but the last return the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import langid, linededup, packing, pii, simhash
from quarry.llm.common import table, written
from quarry.llm.queries import tokenizer_file


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language go: those whose text is null, empty or without
    letters, or whose evidence is split.  Every row is judged on its own, whatever its doc_id; extra
    columns pass unchanged and an empty table stays empty."""
    return langid.keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal or similar lines the first stays, by doc_id (null first) and place.  Rows stay, null
    texts too; a text may become empty.  Rows that share an id, or have none, but differ in text are
    documents of their own; rows equal in both keep the same lines.  Extra columns pass unchanged."""
    return linededup.dedup_lines(docs).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (SimHash and MinHash candidates, five-word shingles at similarity
    0.8 or more) one row stays: the smallest doc_id, null last.  Texts without words are copies of each
    other; rows that share an id, or have none, go or stay on their own; extra columns pass unchanged."""
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms, in every row by itself; a null text stays null and extra
    columns pass unchanged."""
    return pii.pseudonymise(docs).select(*(F.col(f"`{c}`") for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of a document in the training sequences.  A null or empty text is one
    piece with the closing id alone; null ids and repeated rows are packed like others."""
    path, _ = tokenizer_file("word_bpe_49k.json")
    return packing.pack_documents(docs, path)


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("pack", pack),
]

#: SQL can't express MinHash lines, trie joins and tokenizers; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
