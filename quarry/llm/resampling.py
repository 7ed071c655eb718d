"""Target-distribution importance resampling by external sort-count.

Documents are drawn so that their features (hashed word n-grams) come to be distributed like those of
a target set.

1. *Streams.*  A task turns blocks of documents into packed streams of unsigned 16-bit bucket
   numbers with the documents' offsets, and writes them.  A block holds some 4 MB of text (one
   document at least), so memory is bounded by the longest document; a stream has two bytes per feature.
2. *Counts.*  Each stream is sorted and its runs are counted; a task adds up its blocks, so it sends at
   most one row per bucket to the sum over all tasks.
3. *Gains.*  ln of the smoothed target share by that of the documents, in floored thousandths, per bucket.
   There are at most 65,536, so they go to all tasks.
4. *Weights.*  The streams are read again; gains are gathered by bucket and summed between offsets
   (``np.add.reduceat``).  A document's weight is the floored mean over its features.
5. *Draw.*  A hash of seed and id gives Gumbel noise; the documents of the highest noisy weights are a
   sample without replacement.  They are numbered range by range, never in one task.

Odd rows: a null or empty text has no features and weighs 0; a null id is hashed as ``null``; repeated
rows are drawn on their own, rows equal in score and id in order of size; empty documents or an empty
target give an empty result or gains of the documents alone.  Other columns are not read."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, numbered, slices, written

BUCKETS = 10_000
LONGEST = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
#: Bytes of text in a block.
BLOCK_BYTES = 4 << 20

#: Lower-cases A-Z and blanks all ASCII but letters and digits; bytes of other characters stay.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_PLAIN).split()


def buckets_of(words: list[bytes], longest: int, buckets: int) -> np.ndarray:
    """Bucket of every run of 1 to ``longest`` words: crc32 of the words joined by one space.  The crc
    of a run goes on from that of the run without its last word."""
    crcs, found = list(map(zlib.crc32, words)), []
    spaced = [b" " + w for w in words] if longest > 1 else []
    for length in range(1, min(longest, len(words)) + 1):
        if length > 1:
            crcs = list(map(zlib.crc32, spaced[length - 1 :], crcs))
        found.append(np.fromiter(crcs, np.uint32, len(crcs)) % np.uint32(buckets))
    return np.concatenate(found).astype("<u2") if found else np.empty(0, "<u2")


def streams(docs: DataFrame, keys: list[str], longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """Blocks: stream binary (uint16, little endian), ends array<bigint> (where each document stops),
    words array<bigint>, and every key column as an array."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are 16-bit numbers")
    kinds = [docs.schema[k].dataType.simpleString() for k in keys]
    shape = ", ".join(["stream binary", "ends array<bigint>", "words array<bigint>", *(f"`{k}` array<{t}>" for k, t in zip(keys, kinds, strict=True))])

    def run(batches):
        for batch in batches:
            for part in slices(batch, 0, BLOCK_BYTES):
                made, words = [], []
                for text in part.column(0).to_pylist():
                    found = words_of(text)
                    made.append(buckets_of(found, longest, buckets))
                    words.append(len(found))
                whole = pa.array([0, part.num_rows], pa.int32())
                lists = [pa.array([np.cumsum([len(x) for x in made], dtype=np.int64)]), pa.array([words], pa.list_(pa.int64()))]
                lists += [pa.ListArray.from_arrays(whole, part.column(i + 1)) for i in range(len(keys))]
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(made).tobytes()], pa.binary()), *lists], ["stream", "ends", "words", *keys])

    return docs.select(F.col("text").cast("binary").alias("text"), *(F.col(f"`{k}`") for k in keys)).mapInArrow(run, shape)


def bucket_counts(blocks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of all streams: sorted, run-length encoded, summed in the task and then over all."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                ordered = np.sort(np.frombuffer(packed.as_buffer(), "<u2"))
                starts = np.flatnonzero(np.diff(ordered, prepend=np.int64(-1)))
                total[ordered[starts]] += np.diff(starts, append=len(ordered))
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met])], ["bucket", "n"])

    return blocks.select("stream").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(spark, own: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of every bucket (``buckets`` numbers): floor(1000 ln((t+1)(S+b) / ((s+1)(T+b))))."""
    rows = own.select("bucket", F.col("n").alias("s"), F.lit(0).cast("bigint").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("bigint").alias("s"), F.col("n").alias("t")))
    every = rows.unionByName(spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("t")))
    sums = written(every.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "bucket-counts")
    all_s, all_t = sums.agg(F.sum("s"), F.sum("t")).first()
    one = lambda column, plus: F.col(column).cast("double") + plus
    ratio = one("t", 1.0) * F.lit(float(all_s) + buckets) / (one("s", 1.0) * F.lit(float(all_t) + buckets))
    found = sums.select("bucket", F.floor(F.log(ratio) * 1000.0).alias("gain")).collect()
    discard(sums)
    out = np.zeros(buckets, np.int64)
    for bucket, gain in found:
        out[bucket] = gain
    return out


def weights(blocks: DataFrame, keys: list[str], gain: np.ndarray) -> DataFrame:
    """(keys, n_words, n_features, weight), one row per document."""
    kinds = {f.name: f.dataType.elementType.simpleString() for f in blocks.schema if f.name in keys}
    shape = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "n_words bigint, n_features bigint, weight bigint"])

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                stream = np.frombuffer(batch.column(0)[row].as_buffer(), "<u2")
                ends = batch.column(1)[row].values.to_numpy()
                starts = np.concatenate(([0], ends[:-1]))
                sizes = ends - starts
                full = sizes > 0
                weight = np.zeros(len(ends), np.int64)
                if full.any():
                    weight[full] = np.add.reduceat(gain[stream], starts[full]) // sizes[full]
                yield pa.RecordBatch.from_arrays([*(batch.column(3 + i)[row].values for i in range(len(keys))), batch.column(2)[row].values, pa.array(sizes), pa.array(weight)], [*keys, "n_words", "n_features", "weight"])

    return blocks.select("stream", "ends", "words", *(F.col(f"`{k}`") for k in keys)).mapInArrow(run, shape)


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """docs(doc_id, text), target(text) -> (doc_id, text_hash, n_words, n_features, weight, score, rank): every
    document, rank null where it is not drawn.  Of those with ``least_words`` or more, ``percent``
    in a hundred are drawn, rounded down."""
    spark = docs.sparkSession
    keys = ["doc_id", "text_hash"]
    blocks = written(streams(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), keys, longest, buckets), "bucket-streams")
    wanted = written(streams(target.select("text"), [], longest, buckets), "bucket-streams-target")
    gain = gains(spark, bucket_counts(blocks, buckets), bucket_counts(wanted, buckets), buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.log(-F.log((h + 0.5) / F.lit(4294967296.0))) * -1000.0)
    scored = written(weights(blocks, keys, gain).withColumn("score", F.col("weight") + noise).withColumn("row_id", F.monotonically_increasing_id()), "scores")
    discard(blocks, wanted)
    takes_part = F.col("n_words") >= least_words
    n = scored.where(takes_part).count()
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features"), F.asc("row_id")]
    ranked = numbered(scored.where(takes_part), order, "ranks")
    rank = F.when(F.col("n") <= percent * n // 100, F.col("n"))
    none = F.lit(None).cast("bigint")
    out = ranked.withColumn("rank", rank).drop("n").unionByName(scored.where(~takes_part).withColumn("rank", none))
    return out.select("doc_id", "text_hash", "n_words", "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, ranked: DataFrame) -> DataFrame:
    """The rows of ``docs`` that were drawn, with all their columns.  Rows equal in id and text are one
    document here: all stay if one was drawn."""
    chosen = ranked.where("rank is not null").select(F.col("doc_id").alias("r_id"), F.col("text_hash").alias("r_hash"))
    return docs.join(chosen, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.xxhash64("text") == F.col("r_hash")), "left_semi")
