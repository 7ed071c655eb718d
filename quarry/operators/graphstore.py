"""The entity graph kept up batch by batch, so that a batch costs its own keys and not the graph.

Under one folder, each with a partition per batch:

* ``mentions``, ``evidence``: the long form (see operators/graph.py) as it arrived;
* ``entity_parts``, ``edge_parts``: what the batch adds to each key it touches.  First names, the first type
  that says something and an edge's direction are minima by (batch, ord), weights and numbers of chunks
  are sums, so parts of a key can be merged in any grouping and give what a roll-up of everything in
  order of arrival would give;
* ``replaced``: documents whose earlier rows are void.  Parts can't be subtracted, so the keys that these
  rows touched are rolled up anew from the long form without them, in a part marked ``reset``, before
  which nothing of the key counts;
* ``entity_base``, ``edge_base``: all parts merged up to a batch (``compact``), for which older parts
  are no longer read;
* ``marks``: one row for every finished batch or base, appended last.  What has no mark is not read, and
  is overwritten when the batch is run again.

Chunk ids of different batches differ unless their document is named as replaced."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.streaming import batches

MARKS = "kind string, number bigint, mark string"
_FIRST = "struct<batch:bigint,ord:bigint,value:string>"
ENTITY_PART = f"entity_key string, name {_FIRST}, type {_FIRST}, n_chunks bigint, reset boolean"
EDGE_PART = "lo string, hi string, relation string, first struct<batch:bigint,ord:bigint,turned:boolean>, weight bigint, n_chunks bigint, reset boolean"
ENTITY_KEYS, EDGE_KEYS = ["entity_key"], ["lo", "hi", "relation"]


def marks(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(MARKS).json(f"{root}/marks")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MARKS)


def last(spark: SparkSession, root: str, kind: str = "batch") -> tuple[int, str | None]:
    """Number and mark of the last finished batch (or base); (-1, None) before the first."""
    row = marks(spark, root).where(F.col("kind") == kind).agg(F.max(F.struct("number", "mark")).alias("x")).first()["x"]
    return (row["number"], row["mark"]) if row else (-1, None)


def _finish(spark: SparkSession, root: str, kind: str, number: int, mark: str | None) -> None:
    row = spark.range(1).select(F.lit(kind).alias("kind"), F.lit(number).cast("bigint").alias("number"), F.lit(mark).cast("string").alias("mark"))
    row.coalesce(1).write.mode("append").json(f"{root}/marks")


def _table(spark: SparkSession, root: str, name: str, shape: str, after: int, upto: int) -> DataFrame:
    """Finished batches of a table, after and up to the numbers given (other folders are not read)."""
    schema = spark.createDataFrame([], shape).schema
    return batches.read(spark, root, name, schema).where((F.col("batch") > after) & (F.col("batch") <= upto))


def entity_parts(mentions: DataFrame) -> DataFrame:
    """(entity_key, name, type, n_chunks) of mentions with their batch (``alone`` and ``fresh``: see graph.entity_facts)."""
    alone = F.col("alone") & F.col("fresh") if "alone" in mentions.columns else F.lit(False)
    few = mentions.groupBy("entity_key", "name", "type", "batch").agg(F.min("ord").alias("ord"), F.count_if(alone).alias("n_chunks"))
    several = mentions.where("not alone") if "alone" in mentions.columns else mentions
    shared = several.select("entity_key", "chunk_id").distinct().select("entity_key", F.lit(1).cast("bigint").alias("n_chunks"))
    at = lambda value: F.struct("batch", "ord", F.col(value).alias("value"))
    named = F.col("batch").isNotNull()  # rows of shared chunks only count
    rows = few.unionByName(shared, allowMissingColumns=True)
    kind = F.min(F.when(named & (F.col("type") != "CONCEPT"), at("type")))
    return rows.groupBy("entity_key").agg(F.min(F.when(named, at("name"))).alias("name"), kind.alias("type"), F.sum("n_chunks").alias("n_chunks"))


def edge_parts(evidence: DataFrame) -> DataFrame:
    """(lo, hi, relation, first, weight, n_chunks) of evidence with its batch (``alone``: see graph.edge_rollup)."""
    turned = (F.col("src_key") > F.col("dst_key")).alias("turned")
    rows = evidence.select(F.least("src_key", "dst_key").alias("lo"), F.greatest("src_key", "dst_key").alias("hi"), "relation", "chunk_id", "batch", "ord", turned, *(["alone"] if "alone" in evidence.columns else []))
    alone = F.count_if(F.col("alone")) if "alone" in rows.columns else F.lit(0).cast("bigint")
    # numbers alone are aggregated in hash tables; what came first comes in where few rows are left
    few = rows.groupBy(*EDGE_KEYS, "batch", "turned").agg(F.min("ord").alias("ord"), F.count("*").alias("weight"), alone.alias("n_chunks"))
    several = rows.where("not alone") if "alone" in rows.columns else rows
    shared = several.select(*EDGE_KEYS, "chunk_id").distinct().select(*EDGE_KEYS, F.lit(0).cast("bigint").alias("weight"), F.lit(1).cast("bigint").alias("n_chunks"))
    first = F.min(F.when(F.col("batch").isNotNull(), F.struct("batch", "ord", "turned")))
    return few.unionByName(shared, allowMissingColumns=True).groupBy(*EDGE_KEYS).agg(first.alias("first"), F.sum("weight").alias("weight"), F.sum("n_chunks").alias("n_chunks"))


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, from its last reset on; keys whose rows were all taken back are gone."""
    resets = parts.where("reset").groupBy(*keys).agg(F.max("batch").alias("since"))
    counted = parts
    if parts.where("reset").limit(1).count():
        counted = parts.join(resets, keys, "left").where("since is null or batch >= since")
    numbers = [c for c in ("weight", "n_chunks") if c in parts.columns]
    firsts = [c for c in ("name", "type", "first") if c in parts.columns]
    merges = [*(F.min(c).alias(c) for c in firsts), *(F.sum(c).alias(c) for c in numbers)]
    return counted.groupBy(*keys).agg(*merges).where("n_chunks > 0")


def add_batch(spark: SparkSession, root: str, number: int, mentions: DataFrame, evidence: DataFrame, mark: str | None = None, replaced: DataFrame | None = None, kept: bool = True) -> None:
    """Add mentions and evidence that arrived together.  replaced(doc_id): documents of which all that
    came before is void.  A batch that has its mark is left alone; one that broke off is written anew.  With
    ``kept`` false the long form is read where it comes from and not written here: for batches that are stored
    elsewhere and of which no document is ever replaced."""
    done, _ = last(spark, root)
    if number <= done:
        return
    arrived = lambda rows: rows.withColumn("batch", F.lit(number).cast("bigint"))
    if not kept and replaced is not None:
        raise ValueError("documents can be replaced only where the long form is kept")
    if kept:
        batches.write(mentions, root, "mentions", number)
        batches.write(evidence, root, "evidence", number)
        mentions_here = spark.read.schema(mentions.schema).parquet(f"{root}/mentions/batch={number}")
        evidence_here = spark.read.schema(evidence.schema).parquet(f"{root}/evidence/batch={number}")
    own_mentions, own_evidence = (arrived(mentions_here), arrived(evidence_here)) if kept else (arrived(mentions), arrived(evidence))
    resets = lambda rows, flag: rows.withColumn("reset", F.lit(flag))
    entities, edges = resets(entity_parts(own_mentions), False), resets(edge_parts(own_evidence), False)
    gone = spark.createDataFrame([], "doc_id string") if replaced is None else replaced.select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
    batches.write(gone, root, "replaced", number)
    if replaced is not None:
        gone = spark.read.schema("doc_id string").parquet(f"{root}/replaced/batch={number}")
        old_m, old_e = long_form(spark, root, mentions, evidence, number - 1)
        void = old_m.join(gone, "doc_id", "left_semi")
        chunks = void.select("chunk_id").distinct()
        entities = entities.unionByName(_anew(void, old_m.join(gone, "doc_id", "left_anti"), ENTITY_KEYS, entity_parts))
        ends = lambda rows: rows.withColumns({"lo": F.least("src_key", "dst_key"), "hi": F.greatest("src_key", "dst_key")})
        keyed = ends(old_e)
        edges = edges.unionByName(_anew(keyed.join(chunks, "chunk_id", "left_semi"), keyed.join(chunks, "chunk_id", "left_anti"), EDGE_KEYS, edge_parts))
    batches.write(entities, root, "entity_parts", number)
    batches.write(edges, root, "edge_parts", number)
    _finish(spark, root, "batch", number, mark)


def _anew(void: DataFrame, kept: DataFrame, keys: list[str], parts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Parts marked reset of all keys that void rows touched: rolled up from what is kept, or with no
    chunks where nothing is."""
    touched = void.select(*keys).distinct()
    again = touched.join(parts(kept.join(touched, keys, "left_semi")), keys, "left")
    zeros = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_chunks", "weight") if c in again.columns}
    return again.withColumns(zeros).withColumn("reset", F.lit(True))


def long_form(spark: SparkSession, root: str, like_mentions: DataFrame, like_evidence: DataFrame, upto: int) -> tuple[DataFrame, DataFrame]:
    """Mentions and evidence that count after a batch, in the shapes of the tables given."""
    void = _table(spark, root, "replaced", "doc_id string", -1, upto).groupBy(F.col("doc_id").alias("void_doc")).agg(F.max("batch").alias("void_before"))
    all_mentions = batches.read(spark, root, "mentions", like_mentions.schema).where(F.col("batch") <= upto)
    all_evidence = batches.read(spark, root, "evidence", like_evidence.schema).where(F.col("batch") <= upto)
    old = F.col("void_before").isNotNull() & (F.col("batch") < F.col("void_before"))
    judged = all_mentions.join(void, F.col("doc_id").cast("string") == F.col("void_doc"), "left").drop("void_doc")
    lost = judged.where(old).select("chunk_id", "batch").distinct()
    return judged.where(~old).drop("void_before"), all_evidence.join(lost, ["chunk_id", "batch"], "left_anti")


def _state(spark: SparkSession, root: str, what: str, shape: str, keys: list[str]) -> DataFrame:
    base, upto = last(spark, root, "base")[0], last(spark, root)[0]
    parts = _table(spark, root, f"{what}_parts", shape, base, upto)
    if base >= 0:
        parts = parts.unionByName(_table(spark, root, f"{what}_base", shape, base - 1, base))
    return merged(parts, keys)


def entities(spark: SparkSession, root: str) -> DataFrame:
    """(entity_key, name, type, n_chunks) after the last finished batch."""
    rows = _state(spark, root, "entity", ENTITY_PART, ENTITY_KEYS)
    return rows.select("entity_key", F.col("name.value").alias("name"), F.coalesce("type.value", F.lit("CONCEPT")).alias("type"), "n_chunks")


def edges(spark: SparkSession, root: str) -> DataFrame:
    """(src_key, dst_key, relation, weight, n_chunks) after the last finished batch, between known entities."""
    return typed_edges(spark, root).select("src_key", "dst_key", "relation", "weight", "n_chunks")


def typed_edges(spark: SparkSession, root: str) -> DataFrame:
    """The edges with the types of their ends, src_type and dst_type."""
    rows = _state(spark, root, "edge", EDGE_PART, EDGE_KEYS)
    end: Callable[[str, str], Column] = lambda turned, plain: F.when(F.col("first.turned"), F.col(turned)).otherwise(F.col(plain))
    named = rows.select(end("hi", "lo").alias("src_key"), end("lo", "hi").alias("dst_key"), "relation", "weight", "n_chunks")
    known = entities(spark, root)
    kinds = lambda side: known.select(F.col("entity_key").alias(f"{side}_key"), F.col("type").alias(f"{side}_type"))
    return reduce(lambda df, side: df.join(kinds(side), f"{side}_key"), ("src", "dst"), named)


def compact(spark: SparkSession, root: str) -> int:
    """Merge all parts up to the last finished batch into a base; its number, -1 where there is none."""
    number, base = last(spark, root)[0], last(spark, root, "base")[0]
    if number > base:
        for what, shape, keys in (("entity", ENTITY_PART, ENTITY_KEYS), ("edge", EDGE_PART, EDGE_KEYS)):
            batches.write(_state(spark, root, what, shape, keys).withColumn("reset", F.lit(False)), root, f"{what}_base", number)
        _finish(spark, root, "base", number, None)
    return number
