"""A stored keyword index: which chunks hold a word.

postings(bucket, token, chunk_id, doc_id), one row per distinct word of a chunk, in folders by the
word's hash bucket and sorted by word in each file, so that a question reads the buckets of its words
and of their files only the blocks whose range (least and greatest word) holds one.  Frequencies of
words are counted over what a lookup finds, so they are exact after every change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T

BUCKETS = 64
#: Distinct words up to which a lookup hands them to the scan, where they prune blocks of files.
PUSHED_WORDS = 500


def bucket_of(token: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def words_of(chunks: DataFrame) -> DataFrame:
    """(token, chunk_id, doc_id), one row per distinct word of a chunk."""
    return chunks.select(F.explode(T.tokens(F.col("text"))).alias("token"), "chunk_id", "doc_id")


def postings(chunks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, token, chunk_id, doc_id), laid out for writing by bucket: large buckets are split over
    tasks, so that the files of one very common word are written by many."""
    placed = words_of(chunks).select(bucket_of(F.col("token"), buckets).alias("bucket"), "token", "chunk_id", "doc_id")
    return laid_out(placed)


def numbered_postings(chunks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The same for chunks(doc_id, index, text) whose ids are made of document and index (T.chunk_id): the long ids, which
    don't compress, are made after the rows were dealt out, and rows of a word are sorted by document and index."""
    words = chunks.select(F.explode(T.tokens(F.col("text"))).alias("token"), "doc_id", "index")
    placed = words.select(bucket_of(F.col("token"), buckets).alias("bucket"), "token", "doc_id", "index")
    dealt = placed.hint("rebalance", "bucket").sortWithinPartitions("bucket", "token", "doc_id", "index")
    return dealt.select("bucket", "token", T.chunk_id(F.col("doc_id"), F.col("index")).alias("chunk_id"), "doc_id")


def laid_out(rows: DataFrame) -> DataFrame:
    return rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "token", "chunk_id")


def lookup(index: DataFrame, terms: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The postings of the words of terms(token): other buckets are not read."""
    asked = terms.select("token").distinct().withColumn("bucket", bucket_of(F.col("token"), buckets))
    wanted = sorted(r["bucket"] for r in asked.select("bucket").distinct().collect())  # at most ``buckets`` numbers
    found = index.where(F.col("bucket").isin(wanted))
    words = [r["token"] for r in asked.select("token").limit(PUSHED_WORDS + 1).collect()]
    if len(words) <= PUSHED_WORDS:
        return found.where(F.col("token").isin(words))
    return found.join(asked, ["bucket", "token"], "left_semi")


def frequencies(index: DataFrame) -> DataFrame:
    """(token, n_chunks, n_docs) of postings; copies of a word in one document count once for n_docs."""
    by_doc = index.groupBy("token", "doc_id").agg(F.count("*").alias("n"))
    return by_doc.groupBy("token").agg(F.sum("n").alias("n_chunks"), F.count("*").alias("n_docs"))
