"""Queries: conversations, model replies, jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.config import RetrievalConfig
from quarry.operators import agentic, extraction, retrieve, store
from quarry.plans.catalogue import query
from quarry.plans.data import Tables


@query("SELECT conv_id, coalesce(arg_max(text, turn) FILTER (WHERE role = 'user'), arg_max(text, turn)) AS text FROM conversations GROUP BY 1")
def last_user_message(t: Tables) -> DataFrame:
    user = F.when(F.col("role") == "user", F.col("turn"))
    return t.conversations.groupBy("conv_id").agg(F.coalesce(F.max_by("text", user), F.max_by("text", "turn")).alias("text"))


@query("""SELECT conv_id, turn, role, text FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations WHERE role <> 'system') WHERE NOT (role = 'user' AND turn = last)""")
def chat_history(t: Tables) -> DataFrame:
    """Without system messages and a closing user message."""
    rows = t.conversations.where("role <> 'system'")
    last = rows.groupBy("conv_id").agg(F.max("turn").alias("last"))
    return rows.join(last, "conv_id").where("not (role = 'user' and turn = last)").select("conv_id", "turn", "role", "text")


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history FROM (SELECT * FROM conversations WHERE role <> 'system' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4) GROUP BY 1")
def condense_input(t: Tables) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = t.conversations.where("role <> 'system'").withColumn("n", F.row_number().over(order)).where(F.col("n") <= RetrievalConfig.history_turns)
    lists = last.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line")))).alias("l"))
    return lists.select("conv_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("history"))


_PROMPT = RetrievalConfig.system_prompt.replace("'", "''")


@query(f"""WITH last AS (SELECT conv_id, max(turn) AS turn FROM conversations WHERE role <> 'system' GROUP BY 1),
 said AS (SELECT conv_id, 1 AS kind, turn, role, text AS content FROM conversations c WHERE role <> 'system' AND NOT EXISTS (SELECT 1 FROM last l WHERE l.conv_id = c.conv_id AND l.turn = c.turn)
   UNION ALL SELECT conv_id, 2, turn, 'user', text FROM conversations JOIN last USING (conv_id, turn)
   UNION ALL SELECT conv_id, 0, 0, 'system', '{_PROMPT}' || chr(10) || chr(10) || 'Context:' || chr(10) || CASE WHEN conv_id % 3 = 0 THEN '(nothing was found)' ELSE 'about ' || conv_id END FROM last)
 SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY kind, turn) - 1 AS INTEGER) AS n, role, content FROM said""")
def rag_messages(t: Tables) -> DataFrame:
    """System message with context, the turns before, the last turn as the question."""
    rows = t.conversations.where("role <> 'system'")
    last = rows.groupBy("conv_id").agg(F.max("turn").alias("last"))
    turns = rows.join(last, "conv_id")
    before = F.when(F.col("turn") < F.col("last"), F.struct("turn", F.struct("role", F.col("text").alias("content")).alias("m")))
    lists = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(before)).alias("l"), F.max_by("text", "turn").alias("text"))
    queries = lists.select(F.col("conv_id").alias("qid"), "text", F.transform("l", lambda x: x["m"]).alias("history"))
    contexts = last.where("conv_id % 3 <> 0").select(F.col("conv_id").alias("qid"), F.concat(F.lit(" about "), "conv_id").alias("context"))
    found = retrieve.rag_messages(queries, contexts).select(F.col("qid").alias("conv_id"), F.posexplode("messages").alias("n", "m"))
    return found.select("conv_id", "n", "m.role", "m.content")


@query("""WITH r AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS place, text, turn FROM conversations WHERE role = 'assistant'),
 s AS (SELECT *, replace(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), chr(10), ' ') AS flat FROM r)
 SELECT conv_id, chr(10) || chr(10) || '---' || chr(10) || '**Sources:**' || chr(10) || string_agg(place || '. ' || CASE WHEN turn % 4 = 1 THEN '[k][v]' ELSE '[g]' END || ' `d' || turn || '` — ' || CASE WHEN length(flat) > 100 THEN substr(flat, 1, 100) || '…' ELSE flat END, chr(10) ORDER BY place) AS footer FROM s GROUP BY 1
 UNION ALL SELECT conv_id, chr(10) || chr(10) || '---' || chr(10) || '_Nothing in the collection fits this question._' FROM conversations GROUP BY 1 HAVING count(*) FILTER (WHERE role = 'assistant') = 0""")
def sources_footer(t: Tables) -> DataFrame:
    """The assistant's turns as results of each conversation's question."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = t.conversations.where("role = 'assistant'")
    source = F.when(F.col("turn") % 4 == 1, "keyword+vector").otherwise("graph")
    results = rows.select(F.col("conv_id").alias("qid"), F.row_number().over(order).alias("place"), F.concat(F.lit("d"), "turn").alias("doc_id"), source.alias("source"), "text")
    queries = t.conversations.select(F.col("conv_id").alias("qid")).distinct()
    return retrieve.sources_footer(queries, results).withColumnRenamed("qid", "conv_id")


@query("SELECT user_id AS qid, min(name) AS name FROM (SELECT user_id, arg_min(event_type, (event_id % 3, event_type, CAST(event_id AS VARCHAR))) AS name FROM events GROUP BY user_id, event_type) GROUP BY 1, lower(name)")
def agentic_entities(t: Tables) -> DataFrame:
    """Entities of all sub-questions, each name once."""
    related = t.events.select(F.col("user_id").alias("qid"), (F.col("event_id") % 3).alias("sub_no"), F.col("event_type").alias("name"), F.col("event_id").cast("string").alias("type"))
    return agentic.merge_entities(related).select("qid", "name")


@query("SELECT item_id AS qid, CAST(i - 1 AS INTEGER) AS n, part AS text FROM (SELECT item_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM (SELECT item_id, string_split(text, '. ') AS parts FROM benchmark)) WHERE i <= 2")
def parse_variants(t: Tables) -> DataFrame:
    """Model replies as JSON arrays of strings, in code fences, the first two counting."""
    reply = F.concat(F.lit("```json\n"), F.to_json(F.split("text", r"\. ")), F.lit("\n```"))
    return t.benchmark.select(F.col("item_id").alias("qid"), F.posexplode(extraction.string_list(reply, 2)).alias("n", "text"))


@query("SELECT item_id AS qid, CAST(0 AS INTEGER) AS sub_no, text FROM benchmark WHERE item_id % 2 = 1 UNION ALL SELECT item_id, CAST(i - 1 AS INTEGER), part FROM (SELECT item_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM (SELECT item_id, string_split(text, '. ') AS parts FROM benchmark WHERE item_id % 2 = 0)) WHERE i <= 4")
def decompose_parse(t: Tables) -> DataFrame:
    """Every other reply is no JSON; the question then stays whole."""
    reply = F.when(F.col("item_id") % 2 == 0, F.to_json(F.split("text", r"\. "))).otherwise(F.lit("I can't do that."))
    return agentic.sub_questions(t.benchmark.select(F.col("item_id").alias("qid"), "text", reply.alias("reply")))


def _graded(t: Tables) -> DataFrame:
    """Turns as hits; each turn's length modulo 11 is its grade, every third conversation's reply is bad."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = t.conversations.select(F.col("conv_id").alias("qid"), "turn", F.row_number().over(order).alias("place"), F.length("text").alias("n"))
    score = F.struct((F.col("place") - 1).alias("index"), (F.col("n") % 11).cast("double").alias("score"))
    reply = rows.groupBy("qid").agg(F.to_json(F.collect_list(score)).alias("reply"))
    return rows.join(reply, "qid").withColumn("reply", F.when(F.col("qid") % 3 == 0, "no grades today").otherwise(F.col("reply")))


@query("SELECT conv_id AS qid, turn, CASE WHEN conv_id % 3 <> 0 THEN CAST(length(text) % 11 AS DOUBLE) END AS relevance FROM conversations WHERE conv_id % 3 = 0 OR length(text) % 11 >= 5")
def grade_filter(t: Tables) -> DataFrame:
    return agentic.grade(_graded(t)).select("qid", "turn", "relevance")


@query("SELECT conv_id AS qid, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN conv_id % 3 = 0 THEN 0 ELSE length(text) % 11 END DESC, turn) AS INTEGER) AS new_place FROM conversations")
def rerank_apply(t: Tables) -> DataFrame:
    return agentic.rerank(_graded(t)).select("qid", "turn", "new_place")


@query("""WITH f AS (SELECT user_id AS qid, event_type AS chunk_id, event_id AS place, value FROM events), u AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY qid, chunk_id ORDER BY place) = 1)
 SELECT qid, chunk_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY value DESC, place) AS INTEGER) AS pos FROM u""")
def agentic_merge(t: Tables) -> DataFrame:
    found = t.events.select(F.col("user_id").alias("qid"), F.lit(0).alias("sub_no"), F.col("event_id").alias("place"), F.col("event_type").alias("chunk_id"), F.col("value").alias("score"), F.lit(None).cast("double").alias("relevance"))
    return agentic.merge(found).select("qid", "chunk_id", "pos")


@query("SELECT event_id AS job_id, event_type AS status, ts AS created_at FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_jobs(t: Tables) -> DataFrame:
    jobs = t.events.select(F.col("event_id").alias("job_id"), F.col("event_type").alias("status"), F.col("ts").alias("created_at"))
    return store.recent(jobs, 20)


@query("SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS updates FROM events GROUP BY 1")
def job_status(t: Tables) -> DataFrame:
    log = t.events.select(F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    return store.latest_status(log).select("job_id", "status", "updates")


@query("WITH j AS (SELECT event_id AS job_id, CASE event_type WHEN 'click' THEN 'done' WHEN 'error' THEN 'error' ELSE 'processing' END AS status, ts AS ended FROM events) SELECT job_id, status FROM j WHERE status = 'processing' UNION ALL (SELECT job_id, status FROM j WHERE status <> 'processing' ORDER BY ended DESC, job_id DESC LIMIT 500)")
def prune_history(t: Tables) -> DataFrame:
    status = F.when(F.col("event_type") == "click", "done").when(F.col("event_type") == "error", "error").otherwise("processing")
    jobs = t.events.select(F.col("event_id").alias("job_id"), status.alias("status"), F.col("ts").alias("at"))
    return store.prune_finished(jobs, 500).select("job_id", "status")
