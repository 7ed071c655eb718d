"""Mixing sources to target weights.

1. *Sizes.*  A document's size is the number of its words (runs of other than ASCII white space).
   Sizes are summed by source with partial sums before the shuffle, so a hot source costs one row
   per task.
2. *Targets.*  Sources share a budget of words by weight.  No target exceeds ``cap`` times the size of
   its source: what a capped source can't take goes to the others by weight, until none is above.
   All sources below their cap stand at one level of words per weight, so a round is one sum over
   the table of sources, and only two numbers come to the driver.
3. *Copies.*  A source's repetition rate is target / size.  A document is emitted floor(rate) times, and
   once more if its draw is below the rate's fraction.  The draw is a hash of seed, id and text, so
   reruns and lost tasks draw alike.

Odd rows: a null or blank text has size 0 and takes no words, whatever its copies; a null source is a
source of its own; a source that the weights don't list, or list as null, NaN or below zero, takes
nothing; rows equal in id and text get equally many copies; an empty table gives an empty mix.  Other
columns, whatever their names, are kept in ``row``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, numbered, written

#: A word: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
CAP = 3.0
SEED = "mix"
#: Bytes of the table of sources up to which it is broadcast whole.
BROADCAST_BYTES = 16 << 20
#: Beyond that a source with at least one in so many documents is broadcast: at most as many rows.
HEAVY = 1000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def draw(doc_id: Column, text: Column, seed: str) -> Column:
    """Uniform in [0, 1): the first 52 bits of a hash."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.sha2(key, 256), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def source_sizes(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """(source, source_size, documents), one row per source."""
    sized = docs.select(F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`")).alias("size"))
    return sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))


def cyclic_weights(sources: DataFrame, cycle: Sequence[float] = (1, 2, 3)) -> DataFrame:
    """Weights by rank: sources in code point order, null last, weigh the cycle's numbers in turn."""
    ranked = numbered(sources.select("source"), [F.col("source").asc_nulls_last()], "source-ranks")
    place = (F.col("n") - 1) % len(cycle)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in cycle)), (place + 1).cast("int"))
    return ranked.select("source", weight.alias("weight"))


def source_targets(sources: DataFrame, weights: DataFrame, cap: float = CAP, budget: float = 1.0) -> DataFrame:
    """(source, source_size, documents, target): ``budget`` times all words, shared by weight under the cap.

    Where even all caps together fall short of the budget, every weighted source is at its cap."""
    listed = weights.select(F.col("source").alias("w_source"), "weight")
    weight = F.when((F.col("weight") > 0) & ~F.isnan("weight"), F.col("weight").cast("double")).otherwise(0.0)
    both = sources.join(listed, F.col("source").eqNullSafe(F.col("w_source")), "left")
    table = written(both.select("source", "source_size", "documents", F.coalesce(weight, F.lit(0.0)).alias("weight")), "source-weights")
    most = F.col("source_size") * F.lit(float(cap))
    words = budget * (table.agg(F.sum("source_size")).first()[0] or 0)
    level, after = -1.0, 0.0
    while after > level:  # raising the level can only cap more sources, and the same ones give the same level
        level = after
        capped = (F.col("weight") > 0) & (most < F.col("weight") * F.lit(level))
        row = table.agg(F.sum(F.when(capped, most)).alias("taken"), F.sum(F.when(~capped, F.col("weight"))).alias("left")).first()
        after = (words - (row["taken"] or 0.0)) / row["left"] if row["left"] else float("inf")
    target = F.when(F.col("weight") > 0, F.least(most, F.col("weight") * F.lit(after))).otherwise(0.0)
    return table.select("source", "source_size", "documents", target.alias("target"))


def plan_mix(docs: DataFrame, targets: DataFrame, cap: float = CAP, seed: str = SEED, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """(row, size, source_size, target, copies): every document with the times that the mix emits it.

    The table of sources is broadcast where its checked size allows.  Else only the heavy sources are,
    whose number is bounded, and the documents of the others are shuffled by source."""
    text_of, source_of = F.col(f"`{text}`"), F.col(f"`{source}`")
    rows = docs.select(F.struct("*").alias("row"), source_of.alias("d_source"), word_count(text_of).alias("size"), draw(F.col(f"`{doc_id}`"), text_of, seed).alias("draw"))
    same = F.col("d_source").eqNullSafe(F.col("source"))
    known = targets.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 64).alias("bytes"), F.sum("documents").alias("documents")).first()
    if (known["bytes"] or 0) <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(targets), same)
    else:
        heavy = F.col("documents") * HEAVY >= known["documents"]
        marked = rows.join(F.broadcast(targets.where(heavy)), same, "left")
        found = F.col("documents").isNotNull()
        rest = marked.where(~found).select(*rows.columns).join(targets.where(~heavy).hint("merge"), same)
        joined = marked.where(found).unionByName(rest)
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(cap)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    copies = F.floor("rate") + (F.col("draw") < F.col("rate") - F.floor("rate")).cast("bigint")
    return joined.withColumn("rate", rate).select("row", "size", "source_size", "target", copies.alias("copies"))


def emit(planned: DataFrame) -> DataFrame:
    """The mix: every document as often as planned, with the columns it came with."""
    times = planned.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"))
    return times.select("row.*")


def mix(docs: DataFrame, weights: DataFrame | None = None, cap: float = CAP, budget: float = 1.0, seed: str = SEED) -> DataFrame:
    """Sizes, targets and plan in one: see :func:`plan_mix`.  weights(source, weight); without them
    sources weigh 1, 2, 3 in turn."""
    sources = written(source_sizes(docs), "sources")
    targets = written(source_targets(sources, cyclic_weights(sources) if weights is None else weights, cap, budget), "source-targets")
    discard(sources)
    return plan_mix(docs, targets, cap, seed)
