"""Tables as stores: keyed upserts, ingest batches and history."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Insert or replace rows by key: the new batch wins."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def replace_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of the documents in the new batch are replaced, so a second ingest changes nothing."""
    return upsert(old, new, "doc_id")


def document_rows(blocks: DataFrame) -> DataFrame:
    """(doc_id, title, content_hash) of documents as blocks (doc_id, block_no, text, and title if there is
    one; else the id is the title)."""
    title = F.min("title") if "title" in blocks.columns else F.lit(None)
    lists = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_no", F.coalesce("text", F.lit("")).alias("text")))).alias("l"), title.cast("string").alias("title"))
    return lists.select("doc_id", F.coalesce("title", F.col("doc_id").cast("string")).alias("title"), T.content_hash(F.transform("l", lambda x: x["text"])).alias("content_hash"))


def with_duplicates(documents: DataFrame) -> DataFrame:
    """Add duplicate_of: of documents(doc_id, content_hash, batch) with equal content the one that came
    first (of one batch the least id), null for itself.  Only repeated contents are joined."""
    groups = documents.groupBy("content_hash").agg(F.min(F.struct("batch", "doc_id")).alias("first"), F.count("*").alias("n")).where("n > 1")
    marked = documents.join(groups.select("content_hash", F.col("first.doc_id").alias("first_id")), "content_hash", "left")
    return marked.select(*documents.columns, F.when(F.col("first_id") != F.col("doc_id"), F.col("first_id")).alias("duplicate_of"))


def assert_unique(rows: DataFrame, key: str) -> None:
    """Raises where two rows share a key."""
    twice = rows.groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{key} {twice[0][key]!r} is not unique")


def assert_one_size(rows: DataFrame, vector: str) -> None:
    """Raises where vectors differ in size."""
    sizes = rows.agg(F.min(F.size(vector)).alias("least"), F.max(F.size(vector)).alias("most")).first()
    if sizes["least"] != sizes["most"]:
        raise ValueError(f"vectors of {sizes['least']} to {sizes['most']} numbers in one table")


def recent(jobs: DataFrame, limit: int) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), F.desc("job_id")).limit(limit)


def latest_status(events: DataFrame) -> DataFrame:
    """One row per job from its log of events (job_id, status, at, seq)."""
    last = F.max_by(F.struct("status", "at"), F.struct("at", "seq"))
    return events.groupBy("job_id").agg(last.alias("x"), F.count("*").alias("updates")).select("job_id", "x.status", "x.at", "updates")


def prune_finished(jobs: DataFrame, keep: int) -> DataFrame:
    """Without the oldest finished jobs beyond ``keep``; jobs in other states stay."""
    finished = F.col("status").isin("done", "error")
    old = jobs.where(finished).select("job_id", "at", "status").orderBy(F.desc("at"), F.desc("job_id")).limit(keep)
    return jobs.where(~finished).unionByName(jobs.where(finished).join(old.select("job_id"), "job_id", "left_semi").select(jobs.columns))


def can_cancel(status: str) -> bool:
    return status in ("queued", "processing")


class JobLog:
    """A job's events (job_id, status, detail, at, seq), appended to a folder as JSON lines.

    Changes of status are written at once, progress only every ``every``-th time.  A cancelled job is
    asked to stop: whoever works on it looks between batches."""

    SHAPE = "job_id string, status string, detail string, at timestamp, seq bigint"

    def __init__(self, spark: SparkSession, folder: str, every: int = 5):
        self.spark, self.folder, self.every, self.seq, self.steps = spark, folder, every, 0, 0

    def add(self, job_id: str, status: str, detail: str | None = None) -> None:
        self.seq += 1
        row = self.spark.range(1).select(F.lit(job_id).alias("job_id"), F.lit(status).alias("status"), F.lit(detail).cast("string").alias("detail"), F.current_timestamp().alias("at"), F.lit(self.seq).cast("bigint").alias("seq"))
        row.write.mode("append").json(self.folder)

    def progress(self, job_id: str, detail: str) -> bool:
        """Note progress; whether it was written."""
        self.steps += 1
        due = self.steps % self.every == 0
        if due:
            self.add(job_id, "processing", detail)
        return due

    def events(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SHAPE).json(self.folder)
        except AnalysisException:  # nothing was written yet
            return self.spark.createDataFrame([], self.SHAPE)

    def status(self, job_id: str) -> str | None:
        row = latest_status(self.events().where(F.col("job_id") == job_id)).first()
        return row and row["status"]

    def request_cancel(self, job_id: str) -> bool:
        """Whether there was something to cancel."""
        if not can_cancel(self.status(job_id) or ""):
            return False
        self.add(job_id, "cancelled")
        return True

    def is_cancelled(self, job_id: str) -> bool:
        return self.status(job_id) == "cancelled"
