"""Documents to chunks: overlapping windows that prefer to end at a paragraph or sentence."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.config import IngestConfig
from quarry.functions import text as T
from quarry.operators.shared import written


#: Texts whose pieces a task holds at a time.
TEXTS_AT_ONCE = 256


def _window_end(text: str, start: int, size: int) -> int:
    """Where the window from ``start`` stops: after the last paragraph break in it or, only where
    it has none, after the last sentence; a break in the first half is not taken."""
    end = min(start + size, len(text))
    for mark in ("\n\n", ". "):
        at = text.rfind(mark, start, end)
        if at >= 0:
            return at + 1 if 2 * (at - start) > size else end
    return end


def spans(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the windows over a text, the last one up to its end."""
    start = end = 0
    while end < len(text):
        end = _window_end(text, start, size)
        yield start, end
        start = max(start + 1, end - overlap)


def windows(text: str | None, size: int, overlap: int) -> Iterator[str]:
    """The non-empty chunks of one block of text."""
    body = (text or "").strip()
    return filter(None, (body[a:b].strip() for a, b in spans(body, size, overlap)))


def chunk_blocks(blocks: DataFrame, config: IngestConfig = IngestConfig()) -> DataFrame:
    """(doc_id, block_no, text, ...) -> (doc_id, block_no, ..., piece_no, text): never across blocks.  All
    other columns of a block (its page, section, rows ...) go to each of its pieces."""
    size, overlap = config.chunk_size or 800, config.chunk_overlap or 120
    kept = [c for c in blocks.columns if c != "text"]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema if f.name != "text")

    def run(batches):
        for batch in (whole.slice(at, TEXTS_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, TEXTS_AT_ONCE)):
            rows, numbers, pieces = [], [], []
            for row in range(batch.num_rows):
                for number, piece in enumerate(windows(batch.column("text")[row].as_py(), size, overlap)):
                    rows.append(row), numbers.append(number), pieces.append(piece)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in kept), pa.array(numbers, pa.int32()), pa.array(pieces, pa.string())], [*kept, "piece_no", "text"])
            pa.default_memory_pool().release_unused()

    return blocks.select(*(F.col(f"`{c}`") for c in kept), "text").mapInArrow(run, f"{shape}, piece_no int, text string")


def chunk_documents(blocks: DataFrame, config: IngestConfig = IngestConfig()) -> DataFrame:
    """(chunk_id, doc_id, index, text, ...), the index running over all blocks of a document; what blocks
    carry besides comes along."""
    pieces = chunk_blocks(blocks, config)
    order = Window.partitionBy("doc_id").orderBy("block_no", "piece_no")
    return _with_ids(pieces.withColumn("index", F.row_number().over(order) - 1), blocks)


def _with_ids(numbered: DataFrame, blocks: DataFrame) -> DataFrame:
    more = [c for c in blocks.columns if c not in ("doc_id", "block_no", "text")]
    return numbered.select(T.chunk_id(F.col("doc_id"), F.col("index")).alias("chunk_id"), "doc_id", "index", "text", *(F.col(f"`{c}`") for c in more))


def chunk_singles(blocks: DataFrame, config: IngestConfig = IngestConfig()) -> DataFrame:
    """The same for documents of one block each, no two with one id: pieces are numbered where they are made, so
    that no text is shuffled."""
    return _with_ids(chunk_blocks(blocks, config).withColumnRenamed("piece_no", "index"), blocks)


#: Ids that several rows share, up to which they go to every executor (checked by a count).
FEW_IDS = 100_000


def by_uniqueness(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """rows(doc_id, ...) apart: those whose id comes once in ids(doc_id), and all others (None if there are none).  The
    ids alone are counted, and where few are shared no row is shuffled."""
    shared = ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("shared_id"))
    found = shared.limit(FEW_IDS + 1).count()
    if not found:
        return rows, None
    shared = F.broadcast(shared) if found <= FEW_IDS else shared
    same = F.col("doc_id").eqNullSafe(F.col("shared_id"))
    return rows.join(shared, same, "left_anti"), rows.join(shared, same, "left_semi")


def chunk_texts(docs: DataFrame, config: IngestConfig = IngestConfig()) -> DataFrame:
    """Chunks of raw texts (doc_id, text), one block each; rows that share an id are numbered together."""
    once, others = by_uniqueness(single_blocks(docs), docs.select("doc_id"))
    made = chunk_singles(once, config)
    return made if others is None else made.unionByName(chunk_documents(others, config))


def single_blocks(docs: DataFrame) -> DataFrame:
    """Raw texts: one block per document; blank texts make none."""
    return docs.where(F.length(T.strip(F.col("text"))) > 0).select("doc_id", F.lit(0).alias("block_no"), "text")


def row_numbers(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add n, from 1 in each group by ``order``.  Rows are sorted into ranges, which are numbered side by
    side and moved on by the sizes of those before, so no group is in one task."""
    ranged = written(rows.repartitionByRange(group, *order).withColumn("in_range", F.spark_partition_id()), "row-ranges")
    sizes = ranged.groupBy(group, "in_range").agg(F.count("*").alias("size"))  # one row per range and group
    before = Window.partitionBy(group).orderBy("in_range").rowsBetween(Window.unboundedPreceding, -1)
    moved = sizes.select(group, "in_range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("moved"))
    place = F.row_number().over(Window.partitionBy(group, "in_range").orderBy(*order))
    return ranged.withColumn("place", place).join(moved, [group, "in_range"]).withColumn("n", F.col("place") + F.col("moved")).drop("in_range", "place", "moved")


def row_blocks(rows: DataFrame, group: str, order: list[str], columns: list[str], per_block: int = IngestConfig.rows_per_block) -> DataFrame:
    """Tabular rows as blocks: "name: value" pairs joined by "; ", ``per_block`` rows a block, with the
    rows' range (the header is row 1, so the first block starts at 1).  ``group`` names the file."""
    parts = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("None"))) for c in columns if c]
    lines = row_numbers(rows, group, order).select(group, F.floor((F.col("n") - 1) / per_block).cast("int").alias("block_no"), "n", F.concat_ws("; ", *parts).alias("line"))
    made = lines.groupBy(group, "block_no").agg(F.sort_array(F.collect_list(F.struct("n", "line"))).alias("lines"), F.max("n").alias("last"))
    first = F.when(F.col("block_no") == 0, 1).otherwise(F.col("block_no") * per_block + 2)
    return made.select(group, "block_no", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"), F.concat_ws("-", first.cast("string"), (F.col("last") + 1).cast("string")).alias("rows"))
