"""Job 1: takes new documents into the searchable store, as a stream that ends with what is there.

    python -m jobs.ingest_documents --config jobs/ingest_documents.json --documents PATH --output PATH

``documents`` is a Parquet folder (doc_id, text, source, lang) to which files are added, or one file.  A run takes the
files that the checkpoint doesn't know, in batches, and writes under ``output``

* ``chunks/batch=N``: overlapping windows of the texts, with their ids;
* ``postings/batch=N/bucket=B``: the stored keyword index (word, chunk);
* ``rejected/batch=N``: rows without an id or with a blank text, with the reason;
* ``documents/batch=N``: what the batch says of each document; written last, so that a batch is seen
  whole or not at all, and a batch that is run again replaces what it wrote.

A document that comes again (in one batch: the one of the newer file) replaces what it had; equal texts
under several ids all stay, and all but the least id are noted as duplicates.  ``catalogue`` reads the
state: one row per document."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from jobs import settings
from quarry.config import IngestConfig
from quarry.functions import text as T
from quarry.operators import chunking, textindex
from quarry.streaming import batches

logger = logging.getLogger("ingest_documents")


@dataclass(frozen=True)
class Settings:
    documents: str = ""
    output: str = ""
    chunk_size: int = IngestConfig.chunk_size
    chunk_overlap: int = IngestConfig.chunk_overlap
    buckets: int = textindex.BUCKETS
    files_per_batch: int = 1000


def run(spark: SparkSession, config: Settings) -> DataFrame:
    """Take in the files that are new, wait for the stream to end, and return the catalogue."""
    if not config.documents or not config.output:
        raise ValueError("documents and output must be named")
    schema = spark.read.parquet(config.documents).schema
    # as a pattern of one name, so that the table may be a folder or a single file
    path = config.documents.rstrip("/")
    pattern = f"{path[:-1]}[{path[-1]}]"
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", config.files_per_batch).option("maxFileAge", batches.OLDEST).parquet(pattern)
    arrived = files.select("doc_id", "text", "source", "lang", F.col("_metadata.file_modification_time").alias("changed"), F.col("_metadata.file_path").alias("file"))
    query = arrived.writeStream.foreachBatch(lambda rows, number: take_in(rows, number, config)).option("checkpointLocation", f"{config.output}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    taken = [p for p in query.recentProgress if p["numInputRows"]]
    logger.info("read %d new rows of %s in %d batches", sum(p["numInputRows"] for p in taken), config.documents, len(taken))
    return catalogue(spark, config, schema)


def take_in(arrived: DataFrame, number: int, config: Settings) -> None:
    """One batch: chunks and postings, what was rejected, and at last its documents."""
    spark, root = arrived.sparkSession, config.output
    seen = Observation(f"batch {number}")
    reason = F.when(F.col("doc_id").isNull(), "no id").when(F.coalesce(F.length(T.strip(F.col("text"))), F.lit(0)) == 0, "blank text")
    judged = arrived.observe(seen, F.count("*").alias("rows"), F.count(reason).alias("rejected")).withColumn("reason", reason)
    batches.write(judged.where("reason is not null").select("doc_id", "source", "reason"), root, "rejected", number)

    good = arrived.where(reason.isNull()).withColumn("content_hash", T.content_hash(F.array("text")))
    cut = IngestConfig(chunk_size=config.chunk_size, chunk_overlap=config.chunk_overlap)
    blocks = lambda rows: rows.select("doc_id", F.lit(0).alias("block_no"), "text", "source", "lang", "content_hash")
    once, others = chunking.by_uniqueness(good, arrived.where("doc_id is not null").select("doc_id"))
    chunks = chunking.chunk_singles(blocks(once), cut)
    if others is not None:
        # a file that comes twice in a batch has rows equal in all of this, of which any will do
        latest = batches.latest_of_each(others, "doc_id", ["changed", "file", "content_hash"])
        chunks = chunks.unionByName(chunking.chunk_singles(blocks(latest), cut))
    batches.write(chunks, root, "chunks", number)

    stored = spark.read.schema(chunks.schema).parquet(f"{root}/chunks/batch={number}")
    batches.write(textindex.numbered_postings(stored, config.buckets), root, "postings", number, "bucket")
    words = F.size(T.tokens(F.col("text")))
    facts = stored.groupBy("doc_id").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("source", "lang", "content_hash")), F.count("*").alias("n_chunks"), F.sum(words).cast("bigint").alias("n_words"))
    wrote = Observation(f"documents of batch {number}")
    batches.write(facts.observe(wrote, F.count("*").alias("documents"), F.sum("n_chunks").alias("chunks"), F.sum("n_words").alias("postings")), root, batches.DOCUMENTS, number)
    logger.info("batch %d: read %s, wrote %s under %s", number, seen.get, wrote.get, root)


def catalogue(spark: SparkSession, config: Settings, schema: StructType) -> DataFrame:
    """(doc_id, source, lang, content_hash, n_chunks, n_words, duplicate_of), one row per document."""
    shape = StructType().add("doc_id", schema["doc_id"].dataType)
    for name in ("source", "lang", "content_hash"):
        shape = shape.add(name, StringType())
    now = batches.current_documents(spark, config.output, shape.add("n_chunks", LongType()).add("n_words", LongType()))
    groups = now.groupBy("content_hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    marked = now.join(groups.select("content_hash", "first_id"), "content_hash", "left")
    twin = F.when(F.col("first_id") != F.col("doc_id"), F.col("first_id"))
    return marked.select("doc_id", "source", "lang", "content_hash", "n_chunks", "n_words", twin.alias("duplicate_of"))


if __name__ == "__main__":
    settings.main("ingest_documents", Settings, run)
