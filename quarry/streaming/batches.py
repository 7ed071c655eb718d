"""Tables that grow batch by batch under one folder.

A batch writes partitions of its own (``<table>/batch=<number>``); writing it again replaces them.  The
documents that it speaks of go to ``documents`` last, so a batch that broke off is not seen.  Readers
take a document's rows from the last batch that speaks of it: one that comes again replaces all it
had, and one that comes again without content has none."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

DOCUMENTS = "documents"
#: Age of files that a stream still takes.  By default files a week older than the newest are left out in
#: silence; the checkpoint keeps the names of younger ones.
OLDEST = "3650d"


def write(rows: DataFrame, root: str, table: str, number: int, *by: str) -> None:
    """One batch of a table, in sub-folders by the values of ``by``."""
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(f"{root}/{table}/batch={number}")


def read(spark: SparkSession, root: str, table: str, schema: StructType | None = None) -> DataFrame:
    """All batches of a table, with their numbers as ``batch``.  With a schema a table that nothing
    was written to is empty."""
    if schema is None:
        return spark.read.parquet(f"{root}/{table}").withColumn("batch", F.col("batch").cast("bigint"))
    schema = StructType([*schema.fields]).add("batch", LongType())
    try:
        return spark.read.schema(schema).parquet(f"{root}/{table}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def current_documents(spark: SparkSession, root: str, schema: StructType | None = None) -> DataFrame:
    """Every document as the last batch that speaks of it left it, with that batch."""
    rows = read(spark, root, DOCUMENTS, schema)
    last = rows.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["doc_id", "batch"], "left_semi")


def current(spark: SparkSession, root: str, table: str, schema: StructType | None = None, documents: DataFrame | None = None) -> DataFrame:
    """The rows (doc_id, ...) of a table that belong to the current state of their documents."""
    known = current_documents(spark, root) if documents is None else documents
    return read(spark, root, table, schema).join(known.select("doc_id", "batch"), ["doc_id", "batch"], "left_semi")


def latest_of_each(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of rows that share a key (not null) the last one by ``order``; partly aggregated before the shuffle."""
    rest = F.struct(*(F.col(f"`{c}`") for c in rows.columns if c != key))
    last = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(rest, F.struct(*order)).alias("x"))
    return last.select(key, "x.*")
