"""Shared pieces: written tables in the cluster's shared folder, and distributed union-find."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.  A folder made up here
    might be local to one machine, so a session without one is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut and the
    rows survive lost executors.  The schema is passed on, so empty tables work too."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables made by :func:`written` once no later step reads them."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._quarry_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_hash() -> Column:
    """64-bit hash of a row's text.  With doc_id it is the identity of a document: rows that share an
    id, or have none, but differ in text are different documents."""
    return F.xxhash64("text")


def keep_documents(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose identity stays, one row each.  verdicts(doc_id, t, stays, n): every
    identity once, with the number of its rows.

    Only identities that go or repeat are joined, so texts are not shuffled where these are few; of
    repeated rows one stays, whichever where their other columns differ."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", text_hash().alias("t"))
    listed = written(verdicts.where("not stays or n > 1").select(F.col("doc_id").alias("v_id"), F.col("t").alias("v_t"), "stays"), "verdicts")
    same = F.col("doc_id").eqNullSafe(F.col("v_id")) & (F.col("t") == F.col("v_t"))
    kept = rows.join(listed, same, "left_anti")
    repeated = listed.where("stays")
    if repeated.limit(1).count():
        kept = kept.unionByName(rows.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "t"]))
    return kept.select("row.*")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(rows: DataFrame, order: list[Column], label: str) -> DataFrame:
    """Add n, from 1 in the given order, without one task for all rows: ranges of rows are numbered on
    their own and moved on by the rows of the ranges before (one number per range)."""
    ranged = written(rows.repartitionByRange(*order).withColumn("in_range", F.spark_partition_id()), label)
    sizes = ranged.groupBy("in_range").agg(F.count("*").alias("size"))
    before = Window.orderBy("in_range").rowsBetween(Window.unboundedPreceding, -1)
    moved = sizes.select("in_range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("moved"))
    place = F.row_number().over(Window.partitionBy("in_range").orderBy(*order))
    return ranged.withColumn("place", place).join(F.broadcast(moved), "in_range").select(*rows.columns, (F.col("place") + F.col("moved")).alias("n"))


def local_labels(n: int, u: np.ndarray, v: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over edges u-v (vectorised union-find:
    hook the larger root under the smaller, then halve the paths)."""
    root = np.arange(n, dtype=np.int64) if labels is None else labels.copy()
    while len(u):
        ru, rv = root[u], root[v]
        open_ = ru != rv
        if not open_.any():
            break
        u, v, ru, rv = u[open_], v[open_], ru[open_], rv[open_]
        np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Distributed union-find: edges (a, b) of any orderable type -> (node, root), root being
    the smallest node of the component.  Nodes without an edge have no row.

    Alternating large-star and small-star rounds (Kiveris et al., 2014).  A star needs only the
    minimum of a neighbourhood, which is partly aggregated before the shuffle, and a join on the
    node, whose hot partitions AQE can split; no neighbourhood is gathered.  Every round is a
    written table, so a lost executor costs one round at most.
    """
    a, b = F.col("a"), F.col("b")
    now = written(
        edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), label
    )
    while not _is_star_forest(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.join(low, "u").select(F.inline(pairs)).where("u <> v").distinct()
        after = written(small, label)
        discard(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _is_star_forest(edges: DataFrame) -> bool:
    """Every node hangs under one root and no root hangs under another node."""
    roles = edges.select("u", F.lit(1).alias("below")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("below")))
    per_node = roles.groupBy("u").agg(F.sum("below").alias("ups"), F.min("below").alias("least"))
    bad = per_node.where("ups > 1 or (ups = 1 and least = 0)")
    return bad.limit(1).count() == 0


def slices(batch, column: int, limit: int = 4 << 20):
    """Cut an Arrow record batch into parts of about ``limit`` bytes in one column (one row at
    least), so that what a Python worker makes of them stays bounded even for very long texts."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at = 0
    ends = np.cumsum(sizes, dtype=np.int64)
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def frugal(run):
    """A function of Arrow batches that gives its worker's freed memory back at the end of a task: workers
    are used again by other tasks, and an allocator keeps what one of them needed for a moment."""

    def inner(batches):
        import ctypes

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
            if trim:
                trim(0)

    return inner


def release(spark: SparkSession) -> None:
    """Let the cluster drop the shuffle files of finished steps now: they go when the driver's JVM
    collects the plans that made them."""
    import gc

    gc.collect()
    spark._jvm.System.gc()
