"""One very large file read by many tasks: JSON arrays and separated tables.

Spark's text reader cuts a file into byte ranges and hands each task whole fragments between
separators (commas of a JSON file, line ends of a table).  A fragment's separator ends a record only
outside quotes and, in JSON, at the array's own level, which depends on all that comes before.  So

1. every block of the file says what it does to that state, whichever state it starts in;
2. these effects, one row per block, are composed along each file, which gives every block its start;
3. the blocks are read again, each from its start, and cut into records.  What reaches over the end
   of a block meets its other parts by the record's number; only such records are shuffled.

Blocks are as large as Spark's splits, so a task holds one record at a time and a file's table of
blocks has a row per 128 MB.  A record is held whole by one task.  The results are those of
``parsers.json_blocks`` and ``parsers.separated``, but that a broken record is an error of its own
and quoted fields are in double quotes."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.config import IngestConfig
from quarry.operators import chunking
from quarry.operators.shared import written
from quarry.sources.parsers import json_text

#: (inside quotes, depth) after a fragment, from the state before it.
Effect = Callable[[bytes, int, int], tuple[int, int]]

_ESCAPED = re.compile(rb"\\.", re.S)
_CLOSING = re.compile(rb'[^"]*(?:""[^"]*)*"(?!")')


def json_effect(fragment: bytes, inside: int, depth: int) -> tuple[int, int]:
    """Brackets outside strings, in either of whose states the fragment may start."""
    parts = (_ESCAPED.sub(b"", fragment) if b"\\" in fragment else fragment).split(b'"')
    plain = b"".join(parts[inside::2])
    depth += plain.count(b"[") + plain.count(b"{") - plain.count(b"]") - plain.count(b"}")
    return (inside + len(parts) - 1) & 1, depth


def table_effect(delimiter: bytes) -> Effect:
    """Quotes count where a field starts with one; the depth stays."""

    def effect(line: bytes, inside: int, depth: int) -> tuple[int, int]:
        if b'"' not in line:
            return inside, depth
        at = 0
        while True:
            if inside or line[at : at + 1] == b'"':
                closing = _CLOSING.match(line, at + (not inside))
                if not closing:
                    return 1, depth
                at, inside = closing.end(), 0
            at = line.find(delimiter, at) + 1
            if not at:
                return 0, depth

    return effect


def _runs(batches) -> Iterator[tuple[tuple, list[tuple]]]:
    """The rows of each run of equal (path, block), batch by batch: ((path, block), rows)."""
    for batch in batches:
        rows, now = [], None
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:2] != now:
                if rows:
                    yield now, rows
                rows, now = [], row[:2]
            rows.append(row)
        if rows:
            yield now, rows


def _effects(effect: Effect):
    """Fragments (path, block, value) -> what each block makes of either start."""

    def run(batches):
        now, ends = None, []
        for key, rows in _runs(batches):
            if key != now:
                if now:
                    yield _row(now, ends)
                now, ends = key, [(0, 0), (1, 0)]
            for row in rows:
                ends = [effect(row[2], *end) for end in ends]
        if now:
            yield _row(now, ends)

    def _row(key, ends):
        values = [*key, *(x for end in ends for x in end)]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["path", "block", "in0", "by0", "in1", "by1"])

    return run


def _starts(blocks: DataFrame, depth: int) -> DataFrame:
    """(path, block, inside, depth): the state in which each block of a file starts."""

    def along(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        inside, level, out = 0, depth, []
        for r in rows:
            out.append({"path": r["path"], "block": r["block"], "inside": inside, "depth": level})
            inside, level = (r["in1"], level + r["by1"]) if inside else (r["in0"], level + r["by0"])
        return pa.Table.from_pylist(out, pa.schema([("path", pa.string()), ("block", pa.int64()), ("inside", pa.int64()), ("depth", pa.int64())]))

    return blocks.groupBy("path").applyInArrow(along, "path string, block bigint, inside bigint, depth bigint")


def _cut(effect: Effect, level: int, separator: bytes):
    """Fragments (path, block, value, inside, depth) -> the parts of records: k counts those that end in the
    block; a last row without text says how many did."""

    def run(batches):
        now, state, k, held, rows = None, (0, 0), 0, [], []

        def end_block():
            if held:
                rows.append((*now, k, separator.join(held), True))
            rows.append((*now, k, None, None))

        for key, some in _runs(batches):
            if key != now:
                if now:
                    end_block()
                now, state, k, held = key, some[0][3:5], 0, []
            for row in some:
                state = effect(row[2], *state)
                held.append(row[2])
                if state == (0, level):
                    rows.append((*now, k, separator.join(held), False))
                    k, held = k + 1, []
            yield _parts(rows)
            rows = []
        if now:
            end_block()
            yield _parts(rows)

    def _parts(rows):
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[c]) for c in range(5)], ["path", "block", "k", "part", "open"])

    return run


def records(spark: SparkSession, path: str, separator: str, effect: Effect, start: int, level: int) -> DataFrame:
    """(path, n, record binary): the records of each file in ``path``, numbered from 0.  They end at separators
    outside quotes at depth ``level``, where a file starts at depth ``start``."""
    text = spark.read.option("lineSep", separator).text(path)
    fragments = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    shape = "path string, block bigint, in0 bigint, by0 bigint, in1 bigint, by1 bigint"
    starts = written(_starts(written(fragments.mapInArrow(_effects(effect), shape), "block-effects"), start), "block-starts")
    dealt = fragments.join(F.broadcast(starts), ["path", "block"]).select("path", "block", "value", "inside", "depth")
    parts = written(dealt.mapInArrow(_cut(effect, level, separator.encode()), "path string, block bigint, k bigint, part binary, open boolean"), "record-parts")
    along = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counted = parts.where("part is null").select("path", "block", F.coalesce(F.sum("k").over(along), F.lit(0)).alias("before"), F.min("block").over(Window.partitionBy("path")).alias("first"))
    placed = parts.where("part is not null").join(F.broadcast(counted), ["path", "block"]).select("path", "block", (F.col("before") + F.col("k")).alias("n"), "part", (F.col("open") | (F.col("k") == 0) & (F.col("block") > F.col("first"))).alias("shared"))
    whole = placed.where("not shared").select("path", "n", F.col("part").alias("record"))
    joined = placed.where("shared").groupBy("path", "n").agg(F.sort_array(F.collect_list(F.struct("block", "part"))).alias("parts"))
    ends = F.aggregate(F.slice("parts", 2, F.size("parts")), F.get("parts", F.lit(0))["part"], lambda s, x: F.concat(s, F.lit(separator).cast("binary"), x["part"]))
    return whole.unionByName(joined.select("path", "n", ends.alias("record")))


def json_array_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(path, record, text, value, error): a block for each item, from 0, of the JSON array of each file; items
    that say nothing make none.  A file that is no array is an error."""

    def item(n: int, data: bytes):
        text = data.decode("utf-8").strip("\ufeff \t\n\r")
        if n == 0:
            if not text.startswith("["):
                raise ValueError("no array")
            text = text[1:]
        if not text.strip(" \t\n\r]"):
            return None
        try:
            return json.loads(text)
        except ValueError:
            if not text.endswith("]"):
                raise
            return json.loads(text[:-1])  # the last item has the array's end

    def run(batches):
        for batch in batches:
            rows = []
            for path, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    value = item(n, data)
                    lines = json_text(value) if value is not None or data.strip(b" \t\n\r[]") else ""
                    if lines.strip():
                        rows.append((path, n, lines, json.dumps(value), None))
                except (ValueError, RecursionError) as error:
                    rows.append((path, n, None, None, str(error)[:300]))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[c]) for c in range(5)], ["path", "record", "text", "value", "error"])

    return records(spark, path, ",", json_effect, 0, 1).mapInArrow(run, "path string, record bigint, text string, value string, error string")


def _cells(record: bytes, delimiter: str) -> list[str]:
    return next(csv.reader(io.StringIO(record.decode("utf-8").rstrip("\r"), newline=""), delimiter=delimiter), [])


def table_row_blocks(spark: SparkSession, path: str, delimiter: str = ",", size: int = IngestConfig.rows_per_block) -> DataFrame:
    """(path, block_no, text, rows) of separated tables with a header: ``size`` rows that have any value a
    block; the range counts all rows from the one after the block before (the header is row 1).  Rows end
    with a line feed, which a carriage return may stand before."""
    rows = written(records(spark, path, "\n", table_effect(delimiter.encode()), 1, 1), "table-rows")
    heads = rows.where("n = 0").select("path", F.col("record").alias("head"))

    def run(batches):
        for batch in batches:
            kept = []
            for path, n, data, head in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names = [h.strip() for h in _cells(head, delimiter)]
                pairs = [f"{h}: {v}" for h, v in zip(names, _cells(data, delimiter)) if h]
                if pairs:
                    kept.append((path, n + 1, "; ".join(pairs)))
            kinds = [pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in kept], kinds[c]) for c in range(3)], ["path", "row", "line"])

    lines = rows.where("n > 0").join(F.broadcast(heads), "path").select("path", "n", "record", "head").mapInArrow(run, "path string, row bigint, line string")
    ranked = written(chunking.row_numbers(lines, "path", ["row"]), "table-lines")
    block = F.floor((F.col("n") - 1) / size).cast("int")
    # the last row of each full block starts the range of the next one
    mine = ranked.select("path", block.alias("block_no"), "row", "line")
    after = ranked.where(F.col("n") % size == 0).select("path", (block + 1).alias("block_no"), (F.col("row") + 1).alias("first"))
    made = mine.groupBy("path", "block_no").agg(F.sort_array(F.collect_list(F.struct("row", "line"))).alias("lines"), F.max("row").alias("last"))
    ends = rows.groupBy("path").agg(F.max("n").alias("total"))
    joined = made.join(after, ["path", "block_no"], "left").join(F.broadcast(ends), "path")
    last = F.when(F.size("lines") < size, F.col("total") + 1).otherwise(F.col("last"))
    return joined.select("path", "block_no", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"), F.concat_ws("-", F.coalesce("first", F.lit(1)).cast("string"), last.cast("string")).alias("rows"))
