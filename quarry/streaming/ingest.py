"""Incremental ingest: a landing folder of files becomes tables, batch by batch.

Each run takes the files that are new since the last one (the checkpoint knows which) and stops; a
batch adds its own rows only (see streaming/batches.py).  A file's document is its name without suffix;
of several files of one document the last by time, then by path, counts, and one that comes again, be
it blank or unreadable, replaces all that the document had (Spark hands on no files of zero bytes).
Progress can be listened to (streaming/progress.py)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.config import IngestConfig
from quarry.operators import chunking
from quarry.operators.shared import written
from quarry.sources import parsers
from quarry.streaming import batches, progress

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def landing(spark: SparkSession, folder: str, largest_mb: int = 300, files_per_batch: int = 1000) -> DataFrame:
    """New supported files of a folder as a stream, however old their time is."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFileAge", batches.OLDEST).option("maxFilesPerTrigger", files_per_batch).load(folder)
    known = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1)).isin(*parsers.PARSERS)
    return files.where(known & (F.col("length") <= largest_mb << 20))


def document_of(path: str = "path"):
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[A-Za-z0-9]+$", "")


def last_files(files: DataFrame) -> DataFrame:
    """One file per document; contents are not shuffled."""
    named = files.withColumn("doc_id", document_of())
    last = named.groupBy("doc_id").agg(F.max(F.struct("modificationTime", "path")).alias("x")).select(F.col("x.path").alias("path"))
    return named.join(last, "path", "left_semi").drop("doc_id")


def ingest_files(files: DataFrame, config: IngestConfig = IngestConfig()) -> DataFrame:
    """Files -> chunks(chunk_id, doc_id, index, text, and what their blocks carry)."""
    return chunks_of(parsers.parse_files(files), config)


def chunks_of(blocks: DataFrame, config: IngestConfig = IngestConfig()) -> DataFrame:
    return chunking.chunk_documents(blocks.where("error is null").select(document_of().alias("doc_id"), *(c for c in blocks.columns if c not in ("path", "error"))), config)


def failures_of(blocks: DataFrame) -> DataFrame:
    """(path, error) of the files that could not be read."""
    return blocks.where("error is not null").select("path", "error")


def current_chunks(spark: SparkSession, root: str) -> DataFrame:
    """The chunks of all documents, each as the last batch that has a file of it left them."""
    return batches.current(spark, root, "chunks").drop("batch")


def run_available(spark: SparkSession, folder: str, root: str, config: IngestConfig = IngestConfig(), cancelled: Callable[[], bool] | None = None, files_per_batch: int = 1000) -> StreamingQuery:
    """Ingest what has arrived and stop, or earlier once ``cancelled`` says so; ``current_chunks`` is the
    state.  Files that could not be read are listed in ``failures`` with the reason."""

    def batch(files: DataFrame, number: int) -> None:
        last = last_files(files)
        blocks = written(parsers.parse_files(last), "blocks")
        batches.write(failures_of(blocks), root, "failures", number)
        batches.write(chunks_of(blocks, config), root, "chunks", number)
        batches.write(last.select(document_of().alias("doc_id"), "path"), root, batches.DOCUMENTS, number)

    files = landing(spark, folder, files_per_batch=files_per_batch)
    query = files.writeStream.queryName(f"ingest of {folder}").foreachBatch(batch).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    progress.wait(query, cancelled)
    return query
