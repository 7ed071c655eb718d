"""Retrieval channels over chunks, their fusion and the selection of what is returned.

Every operator takes a table of queries and answers all of them in one plan, by ``qid``.
"""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.config import RetrievalConfig
from quarry.functions import text as T
from quarry.operators import textindex
from quarry.operators.extraction import string_list
from quarry.operators.graph import top
from quarry.operators.providers import ChatModel, Embedder, ask, embed
from quarry.operators.shared import written

logger = logging.getLogger(__name__)

#: Queries that are scored together against so many vectors: 4 MB of scores at a time.
QUERY_BLOCK = 512
SCORED_VECTORS = 1024
#: Bytes of all queries' vectors up to which they are sent to every executor; more are dealt out in blocks.
BROADCAST_BYTES = 64 << 20
#: Vectors that one task meets at a time where queries are dealt out.
VECTOR_BLOCK = 200_000


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vector columns, in built-in functions."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, min_score: float = 0.0) -> DataFrame:
    """(qid, chunk_id, score, rank): the k nearest of vectors(chunk_id, doc_id, embedding) to each of
    queries(qid, vec, doc_filter or null) by cosine; a floor above 0 drops lower scores.

    Queries whose vectors are small enough (checked) go to every executor, and one scan of the vectors
    answers them all; more of them are dealt out in blocks that meet blocks of vectors by a key.
    Either way a task keeps its own k best of each query, so only these are shuffled."""
    asked = queries.select("qid", "vec", F.col("doc_filter").cast("string").alias("doc_filter"))
    slim = vectors.select("chunk_id", F.col("doc_id").cast("string").alias("doc_id"), "embedding")
    shape = f"qid {asked.schema['qid'].dataType.simpleString()}, chunk_id {slim.schema['chunk_id'].dataType.simpleString()}, score double"
    facts = asked.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("size")).first()
    if facts["n"] * (facts["size"] or 0) * 8 <= BROADCAST_BYTES:
        held = asked.sparkSession.sparkContext.broadcast(asked.toArrow())

        def scan(batches):
            return _nearest(held.value, batches, k, min_score)

        return top(slim.mapInArrow(scan, shape), k)
    rows = vectors.count()
    n_q, n_v = -(-facts["n"] // (4 * QUERY_BLOCK)), max(1, -(-rows // VECTOR_BLOCK))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("q", F.pmod(F.xxhash64("qid"), F.lit(n_q)).cast("int")).withColumn("v", each(n_v))
    right = slim.withColumn("v", F.pmod(F.xxhash64("chunk_id"), F.lit(n_v)).cast("int")).withColumn("q", each(n_q))

    def meet(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        found = list(_nearest(queries.select(["qid", "vec", "doc_filter"]), vectors.select(["chunk_id", "doc_id", "embedding"]).to_batches(4096), k, min_score))
        kinds = pa.schema([("qid", queries.schema.field("qid").type), ("chunk_id", vectors.schema.field("chunk_id").type), ("score", pa.float64())])
        return pa.Table.from_batches(found, kinds)

    return top(left.groupBy("q", "v").cogroup(right.groupBy("q", "v")).applyInArrow(meet, shape), k)


def unit(column) -> np.ndarray:
    """Rows of unit length of a column of vectors."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-30)


def _nearest(queries: pa.Table, batches, k: int, floor: float):
    """(qid, chunk_id, score) of the k best of all batches for each query; of equal ones the least chunk_id."""
    asked, filters = unit(queries.column("vec")), queries.column("doc_filter").to_pylist()
    wanted = np.array([f is not None for f in filters], bool)
    names, rows, scores, held = [], [], [], 0
    kth = np.full(len(asked), -np.inf)  # what a vector must reach to be among the k best so far

    def best() -> None:
        """Only each query's k best stay."""
        nonlocal names, rows, scores, held
        ids, q, s = pa.chunked_array(names).combine_chunks(), np.concatenate(rows), np.concatenate(scores)
        rank = np.empty(len(ids), np.int64)
        rank[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(ids))
        order = np.lexsort((rank, -s, q))
        q = q[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        order = order[nth < k]
        names, rows, scores, held = [ids.take(pa.array(order))], [q[nth < k]], [s[order]], len(order)
        last = nth[nth < k] == k - 1
        kth[rows[0][last]] = scores[0][last]

    for batch in (whole.slice(at, SCORED_VECTORS) for whole in batches for at in range(0, whole.num_rows, SCORED_VECTORS)):
        if not len(asked) or not k:
            continue
        found = unit(batch.column(2))
        docs = np.array(batch.column(1).to_pylist(), object) if wanted.any() else None
        for at in range(0, len(asked), QUERY_BLOCK):
            part = np.round(asked[at : at + QUERY_BLOCK] @ found.T, 12)  # so that equal vectors tie
            for n in np.flatnonzero(wanted[at : at + QUERY_BLOCK]):
                part[n, docs != filters[at + n]] = -np.inf
            # ties at the border are kept here and settled by chunk_id
            least = kth[at : at + QUERY_BLOCK]
            border = np.partition(part, -k, axis=1)[:, -k] if part.shape[1] > k else np.full(len(part), -np.inf)
            border = np.maximum(border, least)
            q, row = np.nonzero((part >= border[:, None]) & (part >= floor if floor > 0 else part > -np.inf))
            names.append(batch.column(0).take(pa.array(row))), rows.append(q + at), scores.append(part[q, row])
            held += len(q)
            if held > 2 * k * len(asked) + 100_000:
                best()
    if held:
        best()
        yield pa.RecordBatch.from_arrays([queries.column("qid").combine_chunks().take(pa.array(rows[0])), names[0], pa.array(scores[0])], ["qid", "chunk_id", "score"])


def keyword_topk(queries: DataFrame, chunks: DataFrame, limit: int, pool: int = RetrievalConfig.keyword_pool, index: DataFrame | None = None) -> DataFrame:
    """(qid, chunk_id, score, rank) for queries(qid, text, doc_filter if there is one): chunks that hold a
    keyword as a word, of the wanted document only, the first ``pool`` by chunk_id (a limit of the operator
    itself), scored by how many keywords occur anywhere in their text.

    Candidates come from postings(bucket, token, chunk_id, doc_id): the stored ``index`` where there is one,
    of which only the words asked for are read, else made from the chunks.  Texts join last, and only
    those of the pooled candidates are lower-cased."""
    wanted = F.col("doc_filter").cast("string") if "doc_filter" in queries.columns else F.lit(None).cast("string")
    asked = queries.select("qid", T.keywords(F.col("text")).alias("kws"), wanted.alias("wanted")).where(F.size("kws") > 0)
    terms = written(asked.select("qid", "wanted", F.explode("kws").alias("token")), "terms")
    postings = textindex.words_of(chunks) if index is None else textindex.lookup(index, terms)
    postings = postings.select("token", "chunk_id", F.col("doc_id").cast("string").alias("of_doc"))
    # of a word's chunks no question takes more than its pool, so no more of them leave a task
    free = terms.where("wanted is null")
    by_token = Window.partitionBy("token").orderBy("chunk_id")
    each = postings.join(free.select("token").distinct(), "token", "left_semi").select("token", "chunk_id")
    least = each.withColumn("n", F.row_number().over(by_token)).where(F.col("n") <= max(pool, limit))
    hits = free.join(least, "token").select("qid", "chunk_id")
    if "doc_filter" in queries.columns and terms.where("wanted is not null").limit(1).count():
        bound = terms.where("wanted is not null").withColumnRenamed("wanted", "of_doc")
        hits = hits.unionByName(bound.join(postings, ["token", "of_doc"]).select("qid", "chunk_id"))
    found = hits.distinct()
    order = Window.partitionBy("qid").orderBy("chunk_id")
    pooled = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= max(pool, limit)).drop("n")
    pooled = written(pooled, "pooled")  # small on disk, so it goes to the texts and not they to it
    texts = pooled.join(chunks.select("chunk_id", "text"), "chunk_id").join(asked.select("qid", "kws"), "qid").withColumn("low", F.lower("text"))
    scored = texts.select("qid", "chunk_id", F.size(F.filter("kws", lambda w: F.contains(F.col("low"), w))).alias("score"))
    return top(scored.where("score > 0"), limit)


def fuzzy_entities(queries: DataFrame, entities: DataFrame, limit: int = 10, shortest: int = 3) -> DataFrame:
    """(qid, entity_key, name, score, rank) for queries(qid, text): entities with a word within edit
    distance 1 (words up to four letters) or 2 of a query word.  Score: over matched query words,
    one less distance by length; ties by longer name, then key.

    Words meet by equality of keys that near ones share, then the distance is checked."""
    terms = queries.select("qid", F.explode(T.fuzzy_terms(F.col("text"))).alias("t")).select("qid", "t.word", "t.within").distinct()
    named = entities.where(F.length("name") >= shortest).select("entity_key", "name", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("name"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("token"))
    left = terms.select("word", "within").distinct().select("word", "within", F.explode(T.near_probe(F.col("word"), F.col("within"))).alias("rest"))
    right = named.select("token").distinct().select("token", F.explode(T.near_index(F.col("token"))).alias("rest"))
    near = left.join(right, "rest").select("word", "within", "token").distinct()
    near = near.withColumn("d", F.levenshtein("word", "token", 2)).where("d >= 0 and d <= within")
    hits = terms.join(near, ["word", "within"]).join(named, "token")
    best = hits.groupBy("qid", "entity_key", "name", "word").agg(F.min("d").alias("d"))
    scored = best.groupBy("qid", "entity_key", "name").agg(F.round(F.sum(1 - F.col("d") / F.length("word")), 6).alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc(F.length("name")), "entity_key")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def entity_channel(found: DataFrame, mentions: DataFrame) -> DataFrame:
    """(qid, chunk_id, rank): the chunks of matched entities in the entities' order, each once."""
    named = mentions.join(found.select("entity_key"), "entity_key", "left_semi")  # no others are told apart by chunk
    links = named.groupBy("entity_key", "chunk_id").agg(F.min("ord").alias("ord"))
    placed = found.select("qid", "entity_key", F.col("rank").alias("entity_rank")).join(links, "entity_key")
    first = placed.groupBy("qid", "chunk_id").agg(F.min(F.struct("entity_rank", "ord", "chunk_id")).alias("at"))
    return first.select("qid", "chunk_id", F.row_number().over(Window.partitionBy("qid").orderBy("at")).alias("rank"))


def expand_variants(base: DataFrame, variants: DataFrame) -> DataFrame:
    """(qid, chunk_id, rank): hits of query variants (variant_no, rank) follow the base hits, new ids only."""
    rows = base.select("qid", "chunk_id", F.struct(F.lit(-1).alias("v"), F.col("rank").alias("r")).alias("at"))
    rows = rows.unionByName(variants.select("qid", "chunk_id", F.struct(F.col("variant_no").cast("int").alias("v"), F.col("rank").alias("r")).alias("at")))
    first = rows.groupBy("qid", "chunk_id").agg(F.min("at").alias("at"))
    return first.select("qid", "chunk_id", F.row_number().over(Window.partitionBy("qid").orderBy("at", "chunk_id")).alias("rank"))


def rrf(channels: dict[str, DataFrame], config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """(qid, chunk_id, score, source, pos): weighted reciprocal rank fusion of channels (qid, chunk_id,
    rank from 1), in the order given; an unknown channel weighs 1.  Ties go to the earlier channel,
    then the better rank there."""
    weights = dict(config.weights)
    rows = None
    for number, (name, hits) in enumerate(channels.items()):
        part = hits.select("qid", "chunk_id", F.lit(name).alias("channel"), F.struct(F.lit(number).alias("c"), F.col("rank").cast("int").alias("r")).alias("at"), (F.lit(weights.get(name, 1.0)) / (config.rrf_k + F.col("rank"))).alias("part"))
        rows = part if rows is None else rows.unionByName(part)
    fused = rows.groupBy("qid", "chunk_id").agg(F.sum("part").alias("score"), F.array_join(F.array_sort(F.collect_set("channel")), "+").alias("source"), F.min("at").alias("at"))
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 12)), "at")
    return fused.select("qid", "chunk_id", "score", "source", F.row_number().over(order).alias("pos"))


def contained(candidate: Column, other: Column) -> Column:
    """Share of the candidate's distinct words that the other text has; 0 for an empty candidate."""
    mine = F.array_distinct(T.words(F.lower(candidate)))
    theirs = F.array_distinct(T.words(F.lower(other)))
    return F.when(F.size(mine) > 0, F.size(F.array_intersect(mine, theirs)) / F.size(mine)).otherwise(0.0)


def greedy_select(ranked: DataFrame, size: int, near_dup: float = RetrievalConfig.near_dup, cap: int = RetrievalConfig.per_doc_cap, first: int = 64, chunks: DataFrame | None = None) -> DataFrame:
    """ranked(qid, pos, chunk_id, doc_id, text, ...) -> the rows kept, with ``place`` from 1.

    In order of pos: skip blank texts, then near copies of what was kept, then documents that have
    their share, until ``size`` rows are kept.  Each decision needs the ones before, so a query's
    candidates are folded in one row: of hashed words without texts, the ``first`` ones at once and
    those beyond in rising slices, for the queries only that are not full by then.  With ``chunks`` the
    ranked rows come without doc_id, index and text, and only the slices looked at get them."""
    bag = F.transform(F.array_distinct(T.words(F.lower("text"))), lambda w: F.xxhash64(w))
    more = [] if chunks is None else [c for c in ("doc_id", "index", "text") if c in chunks.columns]

    def with_texts(rows: DataFrame, label: str) -> DataFrame:
        return rows if chunks is None else written(rows, label).join(chunks.select("chunk_id", *more), "chunk_id")

    def slim_of(rows: DataFrame) -> DataFrame:
        found = with_texts(rows, "slice").where(F.length(T.strip(F.col("text"))) > 0)
        return written(found.select("qid", F.col("pos").cast("int").alias("pos"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?")).alias("doc"), bag.alias("bag")), "candidates")

    if chunks is None:
        ranked = written(ranked, "ranked")
    item = F.struct("pos", "doc", "bag")
    kind = "array<struct<pos:int,doc:string,bag:array<bigint>>>"

    def step(kept: Column, x: Column) -> Column:
        close = F.exists(kept, lambda k: F.size(F.array_intersect(x["bag"], k["bag"])) / F.size(x["bag"]) >= near_dup)
        full = F.size(F.filter(kept, lambda k: k["doc"] == x["doc"])) >= cap
        return F.when((F.size(kept) >= size) | close | full, kept).otherwise(F.concat(kept, F.array(x)))

    most = ranked.agg(F.max("pos").alias("most")).first()["most"] or 0
    done, low, high = None, 0, first
    rest = ranked
    while True:
        lists = slim_of(rest.where((F.col("pos") > low) & (F.col("pos") <= high))).groupBy("qid").agg(F.sort_array(F.collect_list(item)).alias("items"))
        if done is None:
            joined = lists.withColumn("kept", F.array().cast(kind))
        else:
            joined = done.join(lists, "qid", "full").withColumn("kept", F.coalesce("kept", F.array().cast(kind)))
        folded = F.when((F.size("kept") >= size) | F.col("items").isNull(), F.col("kept")).otherwise(F.aggregate(F.col("items").cast(kind), F.col("kept").cast(kind), step))
        done = joined.select("qid", folded.alias("kept"))
        if high >= most:
            break
        done = written(done, "kept")
        # queries that are full need none of their later candidates
        rest = ranked.join(done.where(F.size("kept") >= size).select("qid"), "qid", "left_anti")
        if not rest.where(F.col("pos") > high).limit(1).count():
            break
        low, high = high, 8 * high
    chosen = done.select("qid", F.posexplode(F.transform("kept", lambda x: x["pos"])).alias("place", "pos"))
    kept = ranked.join(written(chosen, "chosen"), ["qid", "pos"])
    return with_texts(kept, "kept-rows").select(*(F.col(f"`{c}`") for c in ranked.columns), *more, (F.col("place") + 1).alias("place"))


def per_doc_cap(ranked: DataFrame, cap: int) -> DataFrame:
    order = Window.partitionBy("qid", "doc_id").orderBy("pos")
    return ranked.withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap).drop("n")


def neighbours(hits: DataFrame, chunks: DataFrame, window: int) -> DataFrame:
    """(qid, place, chunk_id, doc_id, index, text): chunks within ``window`` of each hit (qid, place, doc_id,
    index), itself included: an equality join on (doc_id, index) for each offset."""
    offsets = F.explode(F.sequence(F.lit(-window), F.lit(window))) if window > 0 else F.explode(F.array().cast("array<int>"))
    asked = hits.select("qid", "place", "doc_id", F.col("index").alias("hit_index"), offsets.alias("o")).select("qid", "place", "doc_id", "hit_index", (F.col("hit_index") + F.col("o")).alias("index"))
    return asked.join(chunks.select("chunk_id", "doc_id", "index", "text"), ["doc_id", "index"])


def with_neighbours(kept: DataFrame, chunks: DataFrame, config: RetrievalConfig) -> DataFrame:
    """Append the unseen neighbours of the first hits, with their hit's score, after all hits."""
    near = neighbours(kept.where(F.col("place") <= config.neighbour_top), chunks, config.neighbour_window)
    scores = kept.select("qid", "place", "score")
    fresh = near.join(kept.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti").where(F.length(T.strip(F.col("text"))) > 0)
    first = fresh.withColumn("n", F.row_number().over(Window.partitionBy("qid", "chunk_id").orderBy("place", "index"))).where("n = 1")
    order = Window.partitionBy("qid").orderBy("place", "index", "chunk_id")
    size = kept.groupBy("qid").agg(F.max("place").alias("size"))
    added = first.join(scores, ["qid", "place"]).join(size, "qid").select("qid", (F.col("size") + F.row_number().over(order)).alias("place"), "chunk_id", "doc_id", "text", "score", F.lit("neighbor").alias("source"))
    return kept.select("qid", "place", "chunk_id", "doc_id", "text", "score", "source").unionByName(added)


def format_context(rows: DataFrame) -> DataFrame:
    """(qid, context): the rows in place order as one text."""
    line = F.concat(F.lit("["), F.upper("source"), F.lit(" | doc:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?")), F.lit("] "), F.col("text"))
    lists = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))
    return lists.select("qid", F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n---\n\n").alias("context"))


def rag_messages(queries: DataFrame, contexts: DataFrame, system: str = RetrievalConfig.system_prompt) -> DataFrame:
    """(qid, messages array<struct<role,content>>): system prompt with the context, the turns before
    (column history, if there is one), the question."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    context = F.coalesce(F.when(T.strip(F.col("context")) != "", T.strip(F.col("context"))), F.lit("(nothing was found)"))
    kind = "array<struct<role:string,content:string>>"
    before = F.coalesce(F.col("history").cast(kind), F.array().cast(kind)) if "history" in queries.columns else F.array().cast(kind)
    joined = queries.join(contexts.select("qid", "context"), "qid", "left")
    messages = F.concat(F.array(message("system", F.concat(F.lit(system + "\n\nContext:\n"), context))).cast(kind), before, F.array(message("user", F.col("text"))).cast(kind))
    return joined.select("qid", messages.alias("messages"))


#: What stands for a channel in the list of sources.
MARKS = (("vector", "[v]"), ("entity_name", "[e]"), ("graph", "[g]"), ("keyword", "[k]"), ("neighbor", "[n]"), ("path", "[p]"))


def source_line(number: Column, source: Column, doc_id: Column, text: Column) -> Column:
    """One source: number, marks of its channels, document, and the first hundred characters."""
    marks = F.create_map(*(F.lit(x) for pair in MARKS for x in pair))
    shown = F.array_join(F.array_distinct(F.transform(F.split(source, "[+]"), lambda s: F.coalesce(marks[s], F.lit("[?]")))), "")
    flat = F.replace(T.strip(F.coalesce(text, F.lit(""))), F.lit("\n"), F.lit(" "))
    snippet = F.when(F.length(flat) > 100, F.concat(F.substring(flat, 1, 100), F.lit("…"))).otherwise(flat)
    return F.concat(number.cast("string"), F.lit(". "), shown, F.lit(" `"), doc_id, F.lit("` — "), snippet)


def sources_footer(queries: DataFrame, results: DataFrame) -> DataFrame:
    """(qid, footer): the list of what was found for each question, to go below an answer."""
    lines = results.select("qid", "place", source_line(F.col("place"), F.col("source"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?")), F.col("text")).alias("line"))
    lists = lines.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    none = F.lit("\n\n---\n_Nothing in the collection fits this question._")
    return queries.select("qid").join(lists, "qid", "left").select("qid", F.coalesce(F.concat(F.lit("\n\n---\n**Sources:**\n"), F.col("lines")), none).alias("footer"))


def path_pairs(named: DataFrame, most: int = RetrievalConfig.path_pairs) -> DataFrame:
    """(pair_id, source, target): each of the first ``most`` named entities (qid, entity_key, rank) with the next."""
    after = named.select("qid", (F.col("rank") - 1).alias("rank"), F.col("entity_key").alias("target"))
    pair = F.concat_ws(":", F.col("qid").cast("string"), F.col("rank").cast("string"))
    return named.where(F.col("rank") <= most).join(after, ["qid", "rank"]).select(pair.alias("pair_id"), F.col("entity_key").alias("source"), "target")


def path_entries(named: DataFrame, edges: DataFrame, entities: DataFrame, config: RetrievalConfig = RetrievalConfig(), mentions: DataFrame | None = None, titles: DataFrame | None = None) -> DataFrame:
    """(qid, n, text): relationship paths between named entities that follow one another, numbered from 0;
    with ``through_documents`` also by the documents of mentions, shown with their titles(doc_id, title)."""
    from quarry.operators.graph import path_lines, shortest_paths

    appears = written(mentions.select("entity_key", "doc_id").distinct(), "appears") if config.through_documents and mentions is not None else None
    paths = written(shortest_paths(path_pairs(named, config.path_pairs), edges, config.path_hops, appears), "paths")
    parts = F.split("pair_id", ":")
    lines = path_lines(paths, edges, entities, appears, titles).select(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), ":").cast(named.schema["qid"].dataType).alias("qid"), F.element_at(parts, -1).cast("int").alias("nth"), "text")
    return lines.select("qid", (F.row_number().over(Window.partitionBy("qid").orderBy("nth")) - 1).alias("n"), "text")


@dataclass
class Retrieval:
    """What a retrieval gives: results (qid, place, chunk_id, doc_id, text, score, source), related entities
    (qid, name, type) and the seconds of each step."""

    results: DataFrame
    related: DataFrame
    timings: dict[str, float]


def condensed(queries: DataFrame, model: ChatModel, turns: int = RetrievalConfig.history_turns) -> DataFrame:
    """queries with a column history (array<struct<role,text>> or null): a follow-up becomes a question that
    stands alone, by a model's reply; without history or reply it stays."""
    last = F.slice("history", F.greatest(F.size("history") - turns + 1, F.lit(1)), turns)
    said = F.array_join(F.transform(last, lambda h: F.concat_ws(": ", h["role"], h["text"])), "\n")
    some = F.coalesce(F.size("history") > 0, F.lit(False))
    task = "\n\nWrite the question so that it can be understood without the conversation; leave it as it is if it can be already. Give the question alone."
    prompt = F.concat(F.lit("Conversation:\n"), said, F.lit("\n\nQuestion: "), F.col("text"), F.lit(task))
    replies = ask(queries.where(some).select("qid", prompt.alias("prompt")), model, "prompt").select("qid", T.strip(F.col("reply")).alias("fresh")).where("fresh <> ''")
    return queries.join(replies, "qid", "left").withColumn("text", F.coalesce("fresh", "text")).drop("fresh")


def variants_of(queries: DataFrame, model: ChatModel, most: int = RetrievalConfig.expansion_count) -> DataFrame:
    """(qid, variant_no, text): other wordings of each question, by a model; none where its reply is no list."""
    prompt = F.concat(F.lit(f"Word this question in {most} other ways that mean the same. Give a JSON array of {most} strings and nothing else.\n\nQuestion: "), F.col("text"))
    replies = ask(queries.select("qid", prompt.alias("prompt")), model, "prompt")
    return replies.select("qid", F.posexplode(string_list(F.col("reply"), most)).alias("variant_no", "text"))


def reranked(kept: DataFrame, queries: DataFrame, model: ChatModel, size: int) -> DataFrame:
    """The ``size`` rows of each question that a model scores highest; their order where its reply is no scores."""
    from quarry.operators.agentic import rerank

    line = F.concat(F.lit("["), (F.col("place") - 1).cast("string"), F.lit("] "), F.substring("text", 1, 400))
    lists = kept.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    task = '\n\nGive a JSON array like [{"index": 0, "score": 8}], one entry for each passage, with a score of 0 to 10 for how much it helps to answer the question.'
    prompts = lists.join(queries.select("qid", F.col("text").alias("question")), "qid").select("qid", F.concat(F.lit("Question: "), "question", F.lit("\n\nPassages:\n"), "lines", F.lit(task)).alias("prompt"))
    scored = rerank(kept.join(ask(prompts, model, "prompt").select("qid", "reply"), "qid"))
    return scored.drop("place").withColumnRenamed("new_place", "place").where(F.col("place") <= size)


def retrieval(queries: DataFrame, chunks: DataFrame, mentions: DataFrame, edges: DataFrame, entities: DataFrame, config: RetrievalConfig = RetrievalConfig(), strict_doc_filter: bool = False, model: ChatModel | None = None, embedder: Embedder | None = None, index: DataFrame | None = None, titles: DataFrame | None = None) -> Retrieval:
    """All channels for all queries(qid, text, vec, doc_filter, and history if there is one) over
    chunks(chunk_id, doc_id, index, text, embedding).

    With ``model`` (and ``embedder``, for new wordings) the steps that the settings switch on are taken:
    follow-ups are condensed, other wordings widen the vector channel, a wider pool is ranked anew.
    ``index``: stored postings of the chunks' words (operators/textindex.py).  ``titles``: (doc_id, title), for paths by documents.  Every channel is a written
    table; where one but the vectors' fails, it is left empty
    (``fail_soft``), but for mistakes in the code and a session that has ended.  A document filter holds for the vector and keyword channels, with
    ``strict_doc_filter`` for all.  Paths between named entities come last."""
    from quarry.operators.graph import expand, related_entities

    timings: dict[str, float] = {}
    began = time.perf_counter()

    def step(name: str, make, empty: str | None) -> DataFrame:
        """A written step; ``empty`` is the shape of what stands for one that fails."""
        start = time.perf_counter()
        try:
            return written(make(), name)
        except (AnalysisException, ArithmeticError, AssertionError, AttributeError, LookupError, NameError, TypeError):
            raise  # a mistake in the code, not a failing service
        except Exception:
            if empty is None or not config.fail_soft or queries.sparkSession.sparkContext._jsc.sc().isStopped():
                raise
            logger.warning("retrieval: %s failed, going on without it", name, exc_info=True)
            return queries.sparkSession.createDataFrame([], empty)
        finally:
            timings[name] = round(time.perf_counter() - start, 3)

    qid, chunk = (f"{name} {frame.schema[name].dataType.simpleString()}" for name, frame in (("qid", queries), ("chunk_id", chunks)))
    ranks = f"{qid}, {chunk}, score double, rank int"
    limit = config.top_k * config.candidate_factor
    reworded = lambda rows: embed(rows.drop("vec"), embedder, prefix="query: ").withColumnRenamed("embedding", "vec")
    if config.condense and model and embedder and "history" in queries.columns:
        queries = step("condense", lambda: reworded(condensed(queries, model, config.history_turns)), None)
    allowed = queries.select("qid", F.col("doc_filter").cast("string").alias("doc_filter"))
    of_doc = chunks.select("chunk_id", F.col("doc_id").cast("string").alias("of_doc"))

    def filtered(hits: DataFrame) -> DataFrame:
        if not strict_doc_filter:
            return hits
        return hits.join(of_doc, "chunk_id").join(allowed, "qid").where("doc_filter is null or doc_filter = of_doc").select(hits.columns)

    vector = step("vector", lambda: vector_topk(queries, chunks, limit, config.min_score).select("qid", "chunk_id", "rank"), None)
    if config.expansion and model and embedder:

        def widened() -> DataFrame:
            asked = variants_of(queries, model, config.expansion_count).join(allowed, "qid")
            each = F.struct("qid", "variant_no")
            hits = vector_topk(reworded(asked).select(each.alias("qid"), "vec", "doc_filter"), chunks, limit, config.min_score)
            return expand_variants(vector, hits.select("qid.qid", "qid.variant_no", "chunk_id", "rank"))

        wider = step("expansion", widened, f"{qid}, {chunk}, rank int")
        vector = wider if wider.limit(1).count() else vector
    named = step("named_entities", lambda: fuzzy_entities(queries, entities), f"{qid}, entity_key string, name string, score double, rank int")
    entity = step("entity_name", lambda: filtered(entity_channel(named, mentions)), ranks)
    keyword = step("keyword", lambda: keyword_topk(queries, chunks, limit, config.keyword_pool, index), ranks)
    seeds = vector.select("qid", "chunk_id").unionByName(entity.select("qid", "chunk_id")).distinct()
    graph = step("graph", lambda: filtered(expand(seeds, mentions, edges, entities, config.graph_expand, config.excluded_types)), ranks)
    fused = step("fusion", lambda: rrf({"vector": vector, "entity_name": entity, "graph": graph, "keyword": keyword}, config), None)
    pool = config.top_k * config.rerank_pool if config.rerank and model else config.top_k
    kept = step("selection", lambda: greedy_select(fused, pool, config.near_dup, config.per_doc_cap, chunks=chunks), None)
    if config.rerank and model:
        kept = step("rerank", lambda: reranked(kept, queries, model, config.top_k), None)
    plain = kept.select("qid", "place", "chunk_id", F.col("doc_id").cast("string").alias("doc_id"), "text", "score", "source")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    found = plain
    if config.neighbour_window > 0:
        found = plain.unionByName(step("neighbours", lambda: with_neighbours(kept, chunks, config).where("source = 'neighbor'").withColumn("doc_id", F.col("doc_id").cast("string")), kinds))
    paths = step("paths", lambda: path_entries(named, edges, entities, config, mentions, titles), f"{qid}, n int, text string")
    if chunks.schema["chunk_id"].dataType.simpleString() == "string":  # a path is no chunk; its id is a text
        size = found.groupBy("qid").agg(F.max("place").alias("size"))
        extra = paths.join(size, "qid", "left").select("qid", (F.coalesce("size", F.lit(0)) + F.col("n") + 1).alias("place"), F.concat(F.lit("path:"), F.col("n").cast("string")).alias("chunk_id"), F.lit("(graph relationship)").alias("doc_id"), "text", F.lit(1.0).alias("score"), F.lit("path").alias("source"))
        found = found.unionByName(extra)
    related = step("related", lambda: related_entities(seeds, mentions, entities), f"{qid}, name string, type string")
    timings["total"] = round(time.perf_counter() - began, 3)
    return Retrieval(found, related, timings)


def hybrid(queries: DataFrame, chunks: DataFrame, mentions: DataFrame, edges: DataFrame, entities: DataFrame, config: RetrievalConfig = RetrievalConfig(), strict_doc_filter: bool = False, model: ChatModel | None = None, embedder: Embedder | None = None) -> DataFrame:
    """The results of :func:`retrieval`."""
    return retrieval(queries, chunks, mentions, edges, entities, config, strict_doc_filter, model, embedder).results


def holders(docs: DataFrame, passages: DataFrame, width: int = 5) -> DataFrame:
    """(qid, doc_id) of the documents whose text contains a passage(qid, passage).

    Words inside a passage are words of a text that holds it, so the two meet on a run of ``width`` of
    them (fewer in a shorter passage); a passage without words inside meets on its first three
    characters.  Then the text is compared."""
    words = passages.select("qid", "passage", F.split("passage", r"(?U)\s+").alias("w"))
    inner = F.slice("w", F.lit(2), F.greatest(F.size("w") - 2, F.lit(0)))
    keyed = words.select("qid", "passage", F.slice(inner, 1, width).alias("run"))
    by_words = keyed.where(F.size("run") > 0).select("qid", "passage", F.size("run").alias("n"), F.xxhash64(F.array_join("run", " ")).alias("key"))
    by_start = keyed.where(F.size("run") == 0).select("qid", "passage", (-F.least(F.length("passage"), F.lit(3))).alias("n"), F.xxhash64(F.substring("passage", 1, 3)).alias("key"))
    asked = by_words.unionByName(by_start).where("passage <> ''")
    sizes = [r["n"] for r in asked.select("n").distinct().collect()]  # at most ``width`` + 3 numbers
    texts = docs.select("doc_id", "text")
    split = texts.select("doc_id", F.split("text", r"(?U)\s+").alias("w"), "text")

    def runs(n: int) -> Column:
        """Hashes of all runs of n words, or of -n characters."""
        if n > 0:
            return F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("w", i, F.lit(n)), " ")))
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1))), lambda i: F.xxhash64(F.substr("text", i, F.lit(-n))))

    found = None
    for n in sizes:
        keys = split.select("doc_id", F.explode(F.array_distinct(runs(n))).alias("key"))
        met = keys.join(asked.where(F.col("n") == n).select("qid", "key"), "key").select("doc_id", "qid")
        found = met if found is None else found.unionByName(met)
    if found is None:
        return texts.limit(0).join(passages.select("qid").limit(0)).select("qid", "doc_id")
    return found.distinct().join(texts, "doc_id").join(passages, "qid").where(F.contains("text", "passage")).select("qid", "doc_id")


def hit_rate_mrr(cases: DataFrame, results: DataFrame) -> DataFrame:
    """cases(case_id, expected) and results(case_id, place, doc_id) -> n, hit_rate, mrr."""
    found = results.select(F.col("case_id").alias("of_case"), F.col("doc_id").alias("of_doc"), "place")
    first = cases.join(found, (F.col("case_id") == F.col("of_case")) & (F.col("expected") == F.col("of_doc")), "left").groupBy("case_id").agg(F.min("place").alias("place"))
    return first.agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("place").isNotNull(), 1.0).otherwise(0.0)), 6).alias("hit_rate"), F.round(F.avg(F.coalesce(1 / F.col("place"), F.lit(0.0))), 6).alias("mrr"))
