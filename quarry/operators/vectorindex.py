"""Vectors by cell: an inverted file for cosine search.

1. *Cells.*  Spherical k-means on a bounded sample (``SAMPLE_PER_CELL`` vectors per cell, those of the least
   hashes): every round is one scan in which tasks send one sum per cell.
2. *Table.*  Every vector goes to the cell of its nearest centre, in folders by cell; with it goes the
   greatest angle of a cell's vectors to its centre.
3. *Search.*  A question reads the cells whose centres are nearest to it.  The ``probes`` that the index needs
   are measured when it is built: so many cells hold ``RECALL`` of the true neighbours of sample questions.
   With ``exact`` a second pass reads the cells that could still hold a better vector than the k-th
   found: no vector of a cell is nearer than the angle to its centre less the cell's greatest angle.
   Questions that are limited to a document, or that get fewer than k vectors, are answered by a scan of
   all.

Centres, greatest angles and the questions' cells are bounded (``cells`` rows; questions beyond
``BROADCAST_BYTES`` are dealt out by cell).  A vector of zeros goes to cell 0 and is near nothing; null
vectors are not indexed."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.graph import top
from quarry.operators.retrieve import BROADCAST_BYTES, VECTOR_BLOCK, unit, vector_topk
from quarry.operators.shared import written

SAMPLE_PER_CELL = 256
ROUNDS = 8
RECALL = 0.95
#: Questions that the number of probes is measured on.
MEASURED = 200
#: Slack of angles, as scores are rounded to 12 digits.
SLACK = 1e-5


@dataclass
class VectorIndex:
    """table(cell, chunk_id, doc_id, embedding), one centre and greatest angle per cell, cells per question."""

    table: DataFrame
    vectors: DataFrame
    centres: np.ndarray
    reach: np.ndarray
    probes: int

    def search(self, queries: DataFrame, k: int, min_score: float = 0.0, exact: bool = False, probes: int | None = None) -> DataFrame:
        """(qid, chunk_id, score, rank) for queries(qid, vec, doc_filter or null)."""
        asked = written(queries.select("qid", "vec", F.col("doc_filter").cast("string").alias("doc_filter")), "asked")
        free, bound = asked.where("doc_filter is null"), asked.where("doc_filter is not null")
        if not len(self.centres):
            return vector_topk(asked, self.vectors, k, min_score)
        near = written(self._in_cells(_nearest_cells(free, self.centres, probes or self.probes), k, min_score), "near")
        if exact:
            further = self._in_cells(_further_cells(free.join(_kth(near, k), "qid", "left"), self.centres, self.reach, probes or self.probes, min_score), k, min_score)
            near = written(top(near.drop("rank").unionByName(further.drop("rank")), k), "near-exact")
        short = bound
        if not exact and min_score <= 0:  # with a floor fewer than k may be all there is
            full = near.groupBy("qid").count().where(F.col("count") >= k)
            short = bound.unionByName(free.join(full, "qid", "left_anti"))
        rest = vector_topk(short, self.vectors, k, min_score)
        return near.join(short.select("qid"), "qid", "left_anti").unionByName(rest)

    def _in_cells(self, asked: DataFrame, k: int, min_score: float) -> DataFrame:
        """Best of the cells that each of asked(qid, vec, cells array<int>) names."""
        facts = asked.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("size")).first()
        wanted = sorted(r["cell"] for r in asked.select(F.explode("cells").alias("cell")).distinct().collect())  # at most one row per cell
        shape = f"qid {asked.schema['qid'].dataType.simpleString()}, chunk_id {self.table.schema['chunk_id'].dataType.simpleString()}, score double"
        read = self.table.where(F.col("cell").isin(wanted))
        if facts["n"] * (facts["size"] or 0) * 8 <= BROADCAST_BYTES:
            held = asked.sparkSession.sparkContext.broadcast(asked.toArrow())

            def scan(batches):
                return _best_of(held.value, batches, k, min_score)

            return top(read.select("cell", "chunk_id", "embedding").mapInArrow(scan, shape), k)
        sizes = read.groupBy("cell").agg(F.ceil(F.count("*") / VECTOR_BLOCK).cast("int").alias("blocks"))
        sizes = written(sizes, "cell-sizes")  # at most one row per cell
        dealt = asked.select("qid", "vec", F.explode("cells").alias("cell")).join(F.broadcast(sizes), "cell")
        left = dealt.select("qid", "vec", F.array("cell").alias("cells"), "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        again = sizes.select(F.col("cell").alias("of_cell"), F.col("blocks").alias("n_blocks"))
        right = read.join(F.broadcast(again), F.col("cell") == F.col("of_cell")).select("cell", "chunk_id", "embedding", F.pmod(F.xxhash64("chunk_id"), F.col("n_blocks")).cast("int").alias("block"))

        def meet(queries: pa.Table, vectors: pa.Table) -> pa.Table:
            kinds = pa.schema([("qid", queries.schema.field("qid").type), ("chunk_id", vectors.schema.field("chunk_id").type), ("score", pa.float64())])
            return pa.Table.from_batches(list(_best_of(queries.select(["qid", "vec", "cells"]), vectors.select(["cell", "chunk_id", "embedding"]).to_batches(4096), k, min_score)), kinds)

        return top(left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInArrow(meet, shape), k)


def fit(vectors: DataFrame, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of at most ``cells`` cells (unit rows); a cell that loses all its vectors goes."""
    usable = vectors.where("embedding is not null").select("embedding", F.xxhash64("chunk_id").alias("h"))
    n = usable.count()
    share = min(1.0, cells * SAMPLE_PER_CELL / max(1, n))
    sample = written(usable.where(F.shiftrightunsigned("h", 1) / float(1 << 63) <= share), "vector-sample")
    first = sample.orderBy("h").limit(cells).select("embedding").toArrow()
    centres = unit(first.column("embedding"))
    if not len(centres):
        return np.zeros((0, 0))
    size = centres.shape[1]
    for _ in range(rounds):
        held = centres

        def sums(batches, held=held):
            total, count = np.zeros((len(held), size)), np.zeros(len(held), np.int64)
            for batch in batches:
                rows = unit(batch.column(0))
                cell = (rows @ held.T).argmax(axis=1) if len(rows) else np.zeros(0, np.int64)
                np.add.at(total, cell, rows)
                count += np.bincount(cell, minlength=len(held))
            met = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(list(total[met]), pa.list_(pa.float64()))], ["cell", "total"])

        parts = sample.select("embedding").mapInArrow(sums, "cell int, total array<double>")
        whole = parts.groupBy("cell").agg(F.array(*(F.sum(F.col("total")[i]) for i in range(size))).alias("total")).orderBy("cell").toArrow()
        moved = unit(whole.column("total"))
        if moved.shape == centres.shape and np.allclose(moved, centres, atol=1e-9):
            break
        centres = moved
    return centres


def build(vectors: DataFrame, cells: int | None = None, recall: float = RECALL, k: int = 15, label: str = "vector-index") -> VectorIndex:
    """Index all of vectors(chunk_id, doc_id, embedding); about the root of their number of cells."""
    some = vectors.where("embedding is not null").select("chunk_id", F.col("doc_id").cast("string").alias("doc_id"), "embedding")
    n = some.count()
    centres = fit(some, cells or max(1, min(1 << 14, round(n**0.5))))
    if not len(centres):
        return VectorIndex(some, vectors, centres, np.zeros(0), 0)
    kind = some.schema["chunk_id"].dataType.simpleString()

    def place(batches):
        for batch in batches:
            rows = unit(batch.column(2))
            near = rows @ centres.T
            cell = near.argmax(axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(rows)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(angle)], [*batch.schema.names, "cell", "angle"])

    placed = some.mapInArrow(place, f"chunk_id {kind}, doc_id string, embedding array<float>, cell int, angle double")
    table = written(placed.hint("rebalance", "cell").sortWithinPartitions("cell", "chunk_id"), label, "cell")
    reach = np.zeros(len(centres))
    for row in table.groupBy("cell").agg(F.max("angle").alias("angle")).collect():
        reach[row["cell"]] = row["angle"]
    index = VectorIndex(table.select("cell", "chunk_id", "doc_id", "embedding"), some, centres, reach, 1)
    index.probes = _needed(index, min(1.0, MEASURED / max(1, n)), recall, k)
    return index


def _needed(index: VectorIndex, share: float, recall: float, k: int) -> int:
    """The least number of cells in which sample questions find ``recall`` of their true neighbours."""
    chosen = F.shiftrightunsigned(F.xxhash64("chunk_id", F.lit("ask")), 1) / float(1 << 63) <= share
    asked = written(index.vectors.where(chosen).select(F.col("chunk_id").alias("qid"), F.col("embedding").alias("vec"), F.lit(None).cast("string").alias("doc_filter")), "measured")
    order = _nearest_cells(asked, index.centres, len(index.centres)).select("qid", F.posexplode("cells").alias("place", "cell"))
    true = vector_topk(asked, index.vectors, k).select("qid", "chunk_id")
    found = true.join(index.table.select("chunk_id", "cell"), "chunk_id").join(order, ["qid", "cell"])
    hits = np.zeros(len(index.centres))
    for row in found.groupBy("place").count().collect():  # at most one row per cell
        hits[row["place"]] = row["count"]
    if not hits.sum():
        return len(index.centres)
    return int(np.searchsorted(np.cumsum(hits) / hits.sum(), recall - 1e-12)) + 1


def _nearest_cells(queries: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """(qid, vec, cells): the numbers of the nearest centres, nearest first."""
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.select("qid", "vec").schema) + ", cells array<int>"

    def run(batches):
        for batch in batches:
            near = unit(batch.column(1)) @ centres.T
            cells = np.argsort(-near, axis=1, kind="stable")[:, :probes].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(cells), pa.list_(pa.int32()))], ["qid", "vec", "cells"])

    return queries.select("qid", "vec").mapInArrow(run, shape)


def _kth(found: DataFrame, k: int) -> DataFrame:
    """(qid, kth): the k-th score, null where there are fewer."""
    return found.groupBy("qid").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))


def _further_cells(queries: DataFrame, centres: np.ndarray, reach: np.ndarray, probes: int, min_score: float) -> DataFrame:
    """(qid, vec, cells): beyond the first ``probes`` the cells that could hold a vector as good as the k-th."""
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.select("qid", "vec").schema) + ", cells array<int>"

    def run(batches):
        for batch in batches:
            near = unit(batch.column(1)) @ centres.T
            kth = np.array([-2.0 if s is None else s for s in batch.column(2).to_pylist()])
            if min_score > 0:
                kth = np.maximum(kth, min_score)
            best = np.cos(np.maximum(0.0, np.arccos(np.clip(near, -1, 1)) - reach - SLACK))
            open_ = best >= kth[:, None] - SLACK
            rank = np.argsort(np.argsort(-near, axis=1, kind="stable"), axis=1)
            cells = [np.flatnonzero(row).astype(np.int32) for row in open_ & (rank >= probes)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(cells, pa.list_(pa.int32()))], ["qid", "vec", "cells"])

    return queries.select("qid", "vec", "kth").mapInArrow(run, shape)


def _best_of(queries: pa.Table, batches, k: int, floor: float):
    """(qid, chunk_id, score): each question's k best of the vectors in its cells; of equal ones the least chunk_id."""
    asked, by_cell = unit(queries.column("vec")), {}
    for row, cells in enumerate(queries.column("cells").to_pylist()):
        for cell in cells:
            by_cell.setdefault(cell, []).append(row)
    ids, rows, scores, held = [], [], [], 0

    def prune():
        nonlocal ids, rows, scores, held
        names, q, s = pa.chunked_array(ids).combine_chunks(), np.concatenate(rows), np.concatenate(scores)
        rank = np.empty(len(names), np.int64)
        rank[pc.array_sort_indices(names).to_numpy()] = np.arange(len(names))
        order = np.lexsort((rank, -s, q))
        order = order[np.arange(len(q)) - np.searchsorted(q[order], q[order]) < k]
        ids, rows, scores, held = [names.take(pa.array(order))], [q[order]], [s[order]], len(order)

    for batch in batches:
        cells = batch.column(0).to_numpy()
        vectors = unit(batch.column(2))
        for cell in np.unique(cells):
            who = np.array(by_cell.get(int(cell), ()), np.int64)
            if not len(who) or not k:
                continue
            inside = np.flatnonzero(cells == cell)
            found = np.round(asked[who] @ vectors[inside].T, 12)
            border = np.partition(found, -k, axis=1)[:, -k] if found.shape[1] > k else np.full(len(found), -np.inf)
            q, row = np.nonzero((found >= border[:, None]) & (found >= floor if floor > 0 else found > -np.inf))
            ids.append(batch.column(1).take(pa.array(inside[row]))), rows.append(who[q]), scores.append(found[q, row])
            held += len(q)
            if held > 8 * k * len(asked) + 100_000:
                prune()
    if held:
        prune()
        yield pa.RecordBatch.from_arrays([queries.column("qid").combine_chunks().take(pa.array(rows[0])), ids[0], pa.array(scores[0])], ["qid", "chunk_id", "score"])
