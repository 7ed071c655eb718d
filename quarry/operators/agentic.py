"""Retrieval in several steps: decompose, retrieve, grade, reformulate, merge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.config import RetrievalConfig
from quarry.functions import text as T
from quarry.operators.extraction import scores, string_list
from quarry.operators.providers import ChatModel, ask


def sub_questions(replies: DataFrame, most: int = 4) -> DataFrame:
    """(qid, sub_no, text) from (qid, text, reply): the parts of a question, or itself."""
    parts = string_list(F.col("reply"), most)
    chosen = F.when(F.size(parts) > 0, parts).otherwise(F.array("text"))
    return replies.select("qid", F.posexplode(chosen).alias("sub_no", "text"))


def grade(rows: DataFrame, threshold: float = RetrievalConfig.grade_threshold) -> DataFrame:
    """rows(qid, place, ..., reply) with one reply per qid: keep those that are graded ``threshold`` or
    more (missing grade: 0); a bad reply keeps all, ungraded."""
    table = scores(F.col("reply"))
    graded = rows.withColumn("_s", table).withColumn("relevance", F.when(F.size("_s") > 0, F.coalesce(F.try_element_at("_s", (F.col("place") - 1).cast("int")), F.lit(0.0))))
    return graded.where("relevance is null or relevance >= %f" % threshold).drop("_s", "reply")


def rerank(rows: DataFrame) -> DataFrame:
    """rows(qid, place, ..., reply): by grade, missing ones 0, ties in the old order; a bad reply keeps it."""
    table = scores(F.col("reply"))
    graded = rows.withColumn("_s", table).withColumn("_g", F.coalesce(F.try_element_at("_s", (F.col("place") - 1).cast("int")), F.lit(0.0)))
    order = Window.partitionBy("qid").orderBy(F.desc("_g"), "place")
    return graded.withColumn("new_place", F.row_number().over(order)).drop("_s", "_g", "reply")


def merge(found: DataFrame) -> DataFrame:
    """found(qid, sub_no, place, chunk_id, score, relevance): each chunk once, as first found, by
    relevance (else score), best first."""
    seen = Window.partitionBy("qid", "chunk_id").orderBy("sub_no", "place")
    first = found.withColumn("n", F.row_number().over(seen)).where("n = 1").drop("n")
    order = Window.partitionBy("qid").orderBy(F.desc(F.coalesce("relevance", "score")), "sub_no", "place")
    return first.withColumn("pos", F.row_number().over(order))


def merge_entities(related: DataFrame) -> DataFrame:
    """related(qid, sub_no, name, type): each name once for a question, by lower case, as first found."""
    first = Window.partitionBy("qid", F.lower("name")).orderBy("sub_no", "name", "type")
    return related.where("name <> ''").withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


#: The tasks that a model is given; what follows them changes from question to question.
GRADE_TASK = (
    "Judge how much each passage helps to answer the question. Give a JSON array with one entry for each passage, like "
    '[{"index": 0, "score": 7}], with a score of 0 (of no use) to 10 (answers it), and nothing else.'
)
REWORD_TASK = "A search with the words below found too little. Word the question in another way that may find more. Give the new wording alone."


def grading_prompt(question: Column, snippets: Column) -> Column:
    """Task, question, and the passages by number from 0."""
    passages = F.array_join(F.transform(snippets, lambda s, n: F.concat(F.lit("["), n.cast("string"), F.lit("] "), s)), "\n\x1e")
    return F.concat(F.lit(GRADE_TASK + "\n\nQuestion: "), question, F.lit("\n\x1e"), passages)


def rewording_prompt(question: Column, asked: Column) -> Column:
    """Task, the question as it was first and as it was last searched for."""
    return F.concat(F.lit(REWORD_TASK + "\n\nQuestion: "), question, F.lit("\n\nSearched for: "), asked)


def run(questions: DataFrame, retrieve: Callable[[DataFrame], DataFrame], grader: ChatModel, reformulate: ChatModel, checkpoint: Callable[[DataFrame], DataFrame], config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """All sub-questions (qid, sub_no, text) at once: each pass retrieves for those that have too
    little yet, grades against the original wording and rewords the rest; at most
    1 + max_retries passes.  ``retrieve`` takes (qid, text) and gives (qid, place, chunk_id,
    text, score); its qid is :func:`sub_key`.  ``checkpoint`` cuts lineage between passes by a
    written table."""
    enough = max(1, int(config.top_k * config.enough_ratio))
    todo = questions.withColumn("key", sub_key()).withColumn("asked", F.col("text"))
    held = None
    for attempt in range(1 + config.max_retries):
        hits = checkpoint(retrieve(todo.select(F.col("key").alias("qid"), F.col("asked").alias("text"))).withColumnRenamed("qid", "key"))
        snippet = F.array_sort(F.collect_list(F.struct("place", F.substring("text", 1, 500).alias("t"))))
        lists = hits.groupBy("key").agg(snippet.alias("s")).join(todo.select("key", "text"), "key")
        prompts = lists.select("key", grading_prompt(F.col("text"), F.transform("s", lambda x: x["t"])).alias("prompt"))
        replied = hits.join(ask(prompts, grader, "prompt").select("key", "reply"), "key")
        kept = grade(replied.withColumnRenamed("key", "qid"), config.grade_threshold).withColumnRenamed("qid", "key")
        kept = kept.withColumn("attempt", F.lit(attempt))
        held = kept if held is None else held.unionByName(kept)
        once = Window.partitionBy("key", "chunk_id").orderBy("attempt", "place")
        held = checkpoint(held.withColumn("n", F.row_number().over(once)).where("n = 1").drop("n"))
        counts = held.groupBy("key").count().where(F.col("count") >= enough).select("key")
        open_ = todo.join(counts, "key", "left_anti")
        words = ask(open_.select("key", "qid", "sub_no", "text", "asked", rewording_prompt(F.col("text"), F.col("asked")).alias("prompt")), reformulate, "prompt")
        fresh = T.strip(F.col("reply"))
        todo = checkpoint(words.where((fresh != "") & (fresh != F.col("asked"))).select("key", "qid", "sub_no", "text", fresh.alias("asked")))
        if attempt == config.max_retries or todo.limit(1).count() == 0:
            break
    ids = questions.withColumn("key", sub_key()).select("key", "qid", "sub_no")
    return merge(held.join(ids, "key").drop("key", "attempt"))


def sub_key() -> Column:
    """The id under which a sub-question (qid, sub_no) is searched for."""
    return F.concat_ws("/", F.col("qid").cast("string"), F.col("sub_no").cast("string"))
