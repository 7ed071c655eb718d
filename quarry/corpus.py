"""The library's front: a corpus of document, chunk and graph tables in one folder."""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import IngestConfig, RetrievalConfig
from quarry.functions import text as T
from quarry.operators import agentic, chunking, extraction, graph, providers, retrieve, store, textindex
from quarry.operators.shared import written

logger = logging.getLogger(__name__)

TABLES = ("documents", "chunks", "postings", "mentions", "evidence")
#: Columns of a block that its chunks keep, beside text and place.
CARRIED = ("page", "section", "table", "record", "rows", "sheet", "ocr")


def _titled(blocks: DataFrame, docs: DataFrame) -> DataFrame:
    """Blocks with the titles of their documents, where these have any."""
    return blocks.join(docs.select("doc_id", "title").distinct(), "doc_id", "left") if "title" in docs.columns else blocks


def _stored_postings(chunks: DataFrame) -> DataFrame:
    return written(textindex.postings(chunks), "postings", "bucket")


@dataclass
class Corpus:
    """documents(doc_id, title, content_hash, batch), chunks(chunk_id, doc_id, index, text, ..., embedding),
    postings(bucket, token, chunk_id, doc_id), mentions and evidence; every change gives a new Corpus over
    newly written tables and leaves the old ones alone."""

    spark: SparkSession
    documents: DataFrame
    chunks: DataFrame
    postings: DataFrame
    mentions: DataFrame
    evidence: DataFrame

    @classmethod
    def build(cls, spark: SparkSession, docs: DataFrame, embedder: providers.Embedder, mentions: DataFrame, evidence: DataFrame, config: IngestConfig = IngestConfig()) -> Corpus:
        """From raw texts (doc_id, text, and title if there is one) and a graph that is there already."""
        blocks = chunking.single_blocks(docs)
        chunks = written(providers.embed(chunking.chunk_documents(blocks, config), embedder, batch=config.batch), "chunks")
        documents = written(store.document_rows(_titled(blocks, docs)).withColumn("batch", F.lit(0).cast("bigint")), "documents")
        return cls(spark, documents, chunks, _stored_postings(chunks), written(mentions, "mentions"), written(evidence, "evidence")).checked()

    def checked(self) -> Corpus:
        """Ids are unique and all vectors of one size; raises where not."""
        store.assert_unique(self.documents, "doc_id")
        store.assert_unique(self.chunks, "chunk_id")
        store.assert_one_size(self.chunks, "embedding")
        return self

    def ingest(self, blocks: DataFrame, embedder: providers.Embedder, model: providers.ChatModel | None = None, config: IngestConfig = IngestConfig()) -> Corpus:
        """Take in documents as blocks (doc_id, block_no, text, and title, page, section ... value where a
        parser gives them) or raw texts (doc_id, text): chunks with vectors and postings, and the graph
        of their entities, which comes after all that is there already.

        Blocks of JSON whose fields are known well enough give entities by their structure, all others by
        ``model``.  A document whose content is here already is taken in all the same, with a warning
        (``duplicates`` lists them); one that comes again replaces all it had, so taking it in twice
        changes nothing."""
        if "block_no" not in blocks.columns:
            blocks = _titled(chunking.single_blocks(blocks), blocks)
        kind = self.chunks.schema["doc_id"].dataType
        fresh = written(blocks.withColumn("doc_id", F.col("doc_id").cast(kind)), "blocks")
        last = self.documents.agg(F.max("batch")).first()[0]
        documents = written(store.document_rows(fresh).withColumn("batch", F.lit(0 if last is None else last + 1).cast("bigint")), "documents-fresh")
        chunks = chunking.chunk_documents(fresh.drop("title"), config)
        if "value" not in chunks.columns:
            chunks = chunks.withColumn("value", F.lit(None).cast("string"))
        chunks = written(chunks, "chunks-plain")
        vectors = written(providers.embed(chunks.drop("value"), embedder, prefix="passage: ", batch=config.batch), "chunks-fresh")
        mentions, evidence = self._graph_of(chunks, model, config)
        left = self.delete(documents.select("doc_id"), keep_tables=True)
        merged = lambda old, new, name: written(old.unionByName(new, allowMissingColumns=True), name)
        postings = left.postings.unionByName(textindex.words_of(chunks).withColumn("bucket", textindex.bucket_of(F.col("token"))))
        after = Corpus(
            self.spark, merged(left.documents, documents, "documents"), merged(left.chunks, vectors, "chunks"), written(textindex.laid_out(postings), "postings", "bucket"),
            merged(left.mentions, mentions, "mentions"), merged(left.evidence, evidence, "evidence"),
        ).checked()
        twins = after.duplicates().join(documents.select("doc_id"), "doc_id", "left_semi").count()
        if twins:
            logger.warning("%d documents have the content of others", twins)
        return after

    def duplicates(self) -> DataFrame:
        """(doc_id, title, content_hash, batch, duplicate_of) of documents whose content came before."""
        return store.with_duplicates(self.documents).where("duplicate_of is not null")

    def _graph_of(self, chunks: DataFrame, model: providers.ChatModel | None, config: IngestConfig) -> tuple[DataFrame, DataFrame]:
        """Mentions and evidence of chunks, numbered on from what is there in the order of document, chunk
        and place in it."""
        model = model or providers.ScriptedChat(lambda prompt: "{}")
        found = written(extraction.gated_extraction(chunks.select("chunk_id", "doc_id", "index", "text", "value"), model, "text", config), "extracted")

        def numbered(rows: DataFrame, before: DataFrame) -> DataFrame:
            last = before.agg(F.max("ord")).first()[0]
            whole = chunking.row_numbers(rows.withColumn("whole", F.lit(0)), "whole", ["doc_id", "index", "pos"])
            return whole.withColumn("ord", F.col("n") + F.lit(0 if last is None else last).cast("bigint")).drop("n", "whole")

        names = found.select("chunk_id", "doc_id", "index", F.posexplode("entities").alias("pos", "e")).select("chunk_id", "doc_id", "index", "pos", "e.name", "e.type")
        ties = found.select("chunk_id", "doc_id", "index", F.posexplode("relations").alias("pos", "r")).select("chunk_id", "doc_id", "index", "pos", "r.source", "r.relation", "r.target")
        mentions = written(graph.mentions_of(numbered(names, self.mentions)), "mentions-fresh")
        return mentions, written(graph.known_ends(graph.evidence_of(numbered(ties, self.evidence)), mentions), "evidence-fresh")

    def retrieval(self, queries: DataFrame, config: RetrievalConfig = RetrievalConfig(), strict_doc_filter: bool = False, model: providers.ChatModel | None = None, embedder: providers.Embedder | None = None) -> retrieve.Retrieval:
        """Results, related entities and timings for queries(qid, text, vec, doc_filter, history)."""
        edges, entities = written(graph.edge_rollup(self.evidence), "edges"), written(graph.entity_facts(self.mentions), "entities")
        return retrieve.retrieval(queries, self.chunks, self.mentions, edges, entities, config, strict_doc_filter, model, embedder, self.postings, self.documents.select("doc_id", "title"))

    def retrieve(self, queries: DataFrame, config: RetrievalConfig = RetrievalConfig(), strict_doc_filter: bool = False, model: providers.ChatModel | None = None, embedder: providers.Embedder | None = None) -> DataFrame:
        """queries(qid, text, vec, doc_filter) -> (qid, place, chunk_id, doc_id, text, score, source)."""
        return self.retrieval(queries, config, strict_doc_filter, model, embedder).results

    def smart_retrieve(self, queries: DataFrame, model: providers.ChatModel, embedder: providers.Embedder, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
        return self.smart_retrieval(queries, model, embedder, config).results

    def smart_retrieval(self, queries: DataFrame, model: providers.ChatModel, embedder: providers.Embedder, config: RetrievalConfig = RetrievalConfig()) -> retrieve.Retrieval:
        """In several steps where the settings say so (``agentic``), else at once.  The related entities
        of a sub-question are those of its last search, each name once for a question."""
        if not config.agentic:
            return self.retrieval(queries, config, model=model, embedder=embedder)
        began = time.perf_counter()
        prompt = F.concat(F.lit(f"Split the question into at most {config.sub_questions} questions that can be answered one by one. Give a JSON array of strings and nothing else.\n\nQuestion: "), F.col("text"))
        replies = providers.ask(queries.select("qid", "text", prompt.alias("prompt")), model, "prompt").drop("prompt")
        asked = written(agentic.sub_questions(replies, config.sub_questions), "sub-questions")
        related: list[DataFrame] = []

        def search(some: DataFrame) -> DataFrame:
            vectors = written(providers.embed(some, embedder, prefix="query: ").withColumnRenamed("embedding", "vec").withColumn("doc_filter", F.lit(None).cast("string")), "sub-vectors")
            found = self.retrieval(vectors, config)
            # a search that finds no entities leaves none of the searches before
            related.append(vectors.select("qid").join(found.related, "qid", "left").withColumn("attempt", F.lit(len(related))))
            return found.results.select("qid", "place", "chunk_id", "doc_id", "text", "score", "source")

        found = agentic.run(asked, search, model, model, lambda df: written(df, "agentic"), config)
        results = found.select("qid", F.col("pos").alias("place"), "chunk_id", "doc_id", "text", F.coalesce("relevance", "score").alias("score"), "source")
        every = reduce(DataFrame.unionByName, related)
        last = every.groupBy("qid").agg(F.max("attempt").alias("attempt"))
        of_last = every.join(last, ["qid", "attempt"], "left_semi").where("name is not null").withColumnRenamed("qid", "key")
        keys = asked.withColumn("key", agentic.sub_key()).select("key", "qid", "sub_no")
        entities = agentic.merge_entities(of_last.join(keys, "key").select("qid", "sub_no", "name", "type")).select("qid", "name", "type")
        return retrieve.Retrieval(results, entities, {"total": round(time.perf_counter() - began, 3)})

    def context(self, queries: DataFrame, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
        return retrieve.format_context(self.retrieve(queries, config))

    def answer(self, queries: DataFrame, model: providers.ChatModel, config: RetrievalConfig = RetrievalConfig(), embedder: providers.Embedder | None = None) -> DataFrame:
        """(qid, reply): a model's answer to each question by its context and history; with the sources
        below it (``show_sources``)."""
        found = written(self.smart_retrieve(queries, model, embedder, config) if config.agentic else self.retrieve(queries, config, model=model, embedder=embedder), "results")
        messages = retrieve.rag_messages(queries, retrieve.format_context(found), config.system_prompt)
        prompt = F.array_join(F.transform("messages", lambda m: F.concat_ws(": ", m["role"], m["content"])), "\n\n")
        replies = providers.ask(messages.select("qid", prompt.alias("prompt")), model, "prompt").select("qid", "reply")
        if not config.show_sources:
            return replies
        return replies.join(retrieve.sources_footer(queries, found), "qid").select("qid", F.concat("reply", "footer").alias("reply"))

    def delete(self, doc_ids: DataFrame, keep_tables: bool = False) -> Corpus:
        """Without the given documents.  keep_tables: the result is read once and need not be written."""
        mentions, evidence, chunks = graph.delete_documents(doc_ids, self.mentions, self.evidence, self.chunks)
        gone = doc_ids.select("doc_id").distinct()
        documents, postings = (df.join(gone, "doc_id", "left_anti") for df in (self.documents, self.postings))
        if keep_tables:
            return Corpus(self.spark, documents, chunks, postings, mentions, evidence)
        return Corpus(self.spark, written(documents, "documents"), written(chunks, "chunks"), written(textindex.laid_out(postings), "postings", "bucket"), written(mentions, "mentions"), written(evidence, "evidence"))

    def merge_entities(self, merges: DataFrame) -> Corpus:
        mentions, evidence = graph.merge_entities(self.mentions, self.evidence, merges)
        return Corpus(self.spark, self.documents, self.chunks, self.postings, written(mentions, "mentions"), written(evidence, "evidence"))

    def merge_names(self, keep: str, absorb: str) -> Corpus:
        """Absorb the entity of one exact name into that of another; raises where one is not there."""
        pair = self.spark.range(1).select(T.normalize_key(F.lit(keep)).alias("keep"), T.normalize_key(F.lit(absorb)).alias("absorb"))
        keys = self.mentions.select("entity_key").distinct()
        for side in ("keep", "absorb"):
            if not pair.join(keys, F.col(side) == F.col("entity_key")).count():
                raise ValueError(f"no entity named {keep if side == 'keep' else absorb!r}")
        return self.merge_entities(pair)

    def dedupe_candidates(self, threshold: float = 0.85) -> DataFrame:
        return graph.similar_names(graph.entity_facts(self.mentions), threshold)

    def low_evidence(self, most: int = 1) -> DataFrame:
        return graph.entity_facts(self.mentions).where(F.col("n_chunks") <= most).orderBy("n_chunks", "entity_key")

    def evaluate(self, cases: DataFrame, embedder: providers.Embedder, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
        """cases(case_id, query, expected) -> n, hit_rate, mrr of retrieval by vectors, names and words."""
        asked = cases.select(F.col("case_id").alias("qid"), F.col("query").alias("text"), F.lit(None).cast("string").alias("doc_filter"))
        queries = written(providers.embed(asked, embedder, prefix="query: ").withColumnRenamed("embedding", "vec"), "cases")
        found = self.retrieve(queries, config).select(F.col("qid").alias("case_id"), "doc_id", "place")
        return retrieve.hit_rate_mrr(cases.select("case_id", F.col("expected").cast("string").alias("expected")), found)

    def save(self, folder: str) -> None:
        for name in TABLES:
            rows = textindex.laid_out(self.postings) if name == "postings" else getattr(self, name)
            rows.write.mode("overwrite").partitionBy(*(["bucket"] if name == "postings" else [])).parquet(f"{folder}/{name}")

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Corpus:
        return cls(spark, *(spark.read.parquet(f"{folder}/{name}") for name in TABLES))
