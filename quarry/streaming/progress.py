"""Progress of streams as job events, and cancelling between or within batches."""

from __future__ import annotations

import datetime
import json
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

EVENTS = "job_id string, status string, detail string, at timestamp, seq bigint"
#: Events of one session that are kept until they are saved, the latest ones.
KEPT = 500


class StreamProgress(StreamingQueryListener):
    """Notes what the streams of a session do: when each run starts, every ``every``-th batch with its rows
    and seconds, and how it ends.  The job's id is the name of the query, or its id.  Nothing is
    written while a stream runs; ``save`` appends all at once."""

    def __init__(self, every: int = 1):
        self.every, self.seq = every, 0
        self.names: dict[str, str] = {}
        self.totals: dict[str, list[int]] = {}
        self.events: deque[tuple] = deque(maxlen=KEPT)

    def _note(self, run: str, status: str, detail: dict | None = None) -> None:
        self.seq += 1
        now = datetime.datetime.now(datetime.timezone.utc)
        self.events.append((self.names.get(run, run), status, json.dumps(detail) if detail else None, now, self.seq))

    def onQueryStarted(self, event) -> None:
        run = str(event.runId)
        self.names[run], self.totals[run] = event.name or str(event.id), [0, 0]
        self._note(run, "processing")

    def onQueryProgress(self, event) -> None:
        p, run = event.progress, str(event.progress.runId)
        total = self.totals.setdefault(run, [0, 0])
        total[0] += 1
        total[1] += p.numInputRows
        if total[0] % self.every == 0:
            self._note(run, "processing", {"batch": p.batchId, "rows": p.numInputRows, "seconds": round(p.batchDuration / 1000, 3)})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        run = str(event.runId)
        batches, rows = self.totals.pop(run, (0, 0))
        detail = {"batches": batches, "rows": rows} | ({"error": event.exception[:300]} if event.exception else {})
        self._note(run, "error" if event.exception else "done", detail)

    def table(self, spark: SparkSession) -> DataFrame:
        """The events (job_id, status, detail, at, seq) that are kept."""
        return spark.createDataFrame(list(self.events), EVENTS)

    def save(self, spark: SparkSession, folder: str) -> None:
        self.table(spark).coalesce(1).write.mode("append").json(folder)
        self.events.clear()


def wait(query: StreamingQuery, cancelled: Callable[[], bool] | None = None, seconds: float = 1.0) -> bool:
    """Wait for a stream to end, asking every few seconds whether it was cancelled; whether it ended by
    itself.  A batch that is stopped on its way was not finished: the next run takes it again."""
    while not query.awaitTermination(seconds):
        if cancelled is not None and cancelled():
            query.stop()
            return False
    return True
