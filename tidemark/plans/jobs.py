"""Runs as jobs: one at a time, with state, log tail, history and cancel."""

from __future__ import annotations

import threading
import uuid
from collections import deque
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark import InheritableThread
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

#: Lines of a job's log, and finished jobs, that are remembered.
LOG_LINES, HISTORY = 500, 25


class Job:
    def __init__(self, params: dict):
        self.id, self.params, self.state = uuid.uuid4().hex[:12], params, "running"
        self.started_at, self.finished_at = datetime.now(timezone.utc), None
        self.result, self.error, self.lines = None, "", deque(maxlen=LOG_LINES)
        self.cancelled = threading.Event()
        self.guard, self.said = threading.Lock(), 0
        self.done, self.total, self.label, self.rows = 0, 0, "starting", 0

    def log(self, line: str) -> None:
        with self.guard:
            self.lines.append(line)
            self.said += 1

    def progress(self, done: int, total: int, label: str) -> None:
        """How far the work is; ``plans.run.collect`` reports its steps to it."""
        self.done, self.total, self.label = done, total, label

    def status(self, tail: int = 50, offset: int | None = None) -> dict:
        """What a page shows; the newest lines last.

        Lines are numbered from 0 as they are logged.  With ``offset``, all remembered
        lines from that number on are given: ``log_from`` is the number of the first of
        them, which is larger than asked where older ones have been forgotten, and
        ``log_next`` the offset to ask for next."""
        with self.guard:
            lines, said = list(self.lines), self.said
        if offset is not None:
            lines = lines[max(offset - (said - len(lines)), 0) :]
        else:
            lines = lines[-tail:] if tail > 0 else []
        percent = round(100 * self.done / self.total) if self.total else 0
        return {
            "id": self.id, "state": self.state, "params": self.params, "started_at": self.started_at, "finished_at": self.finished_at, "result": self.result, "error": self.error,
            "progress": {"done": self.done, "total": self.total, "label": self.label, "percent": percent, "rows": self.rows}, "log": lines, "log_from": said - len(lines), "log_next": said,
        }


class Batches(StreamingQueryListener):
    """Notes the batches of the session's streams in the job that runs."""

    def __init__(self, job: Job):
        self.job = job

    def onQueryStarted(self, event) -> None:  # noqa: N802 (Spark's names)
        self.job.log(f"stream {event.name or event.id} started")

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.job.rows += p.numInputRows
        self.job.log(f"stream {p.name or p.id} batch {p.batchId}: {p.numInputRows} rows")

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.job.log(f"stream {event.id} ended" + (" with an error" if event.exception else ""))


class Jobs:
    """One job runs at a time; the newest finished ones are remembered."""

    def __init__(self, spark: SparkSession):
        self.spark, self.lock, self.current, self.done = spark, threading.Lock(), None, deque(maxlen=HISTORY)

    def start(self, work: Callable[[Job], dict], params: dict | None = None) -> Job:
        with self.lock:
            if self.current is not None:
                raise RuntimeError("a run is already in progress")
            job = self.current = Job(params or {})
        thread = InheritableThread(target=self._work, args=(job, work), daemon=True)
        job.thread = thread
        thread.start()
        return job

    def _work(self, job: Job, work: Callable[[Job], dict]) -> None:
        self.spark.sparkContext.setJobGroup(job.id, "collect run", interruptOnCancel=True)
        batches = Batches(job)
        self.spark.streams.addListener(batches)
        try:
            job.result = work(job)
            job.state = "cancelled" if job.cancelled.is_set() else "completed"
        except Exception as e:  # a job's failure is its state
            job.state, job.error = ("cancelled", "") if job.cancelled.is_set() else ("failed", f"{type(e).__name__}: {e}".split("\n")[0])
        self.spark.streams.removeListener(batches)
        job.finished_at = datetime.now(timezone.utc)
        with self.lock:
            self.done.appendleft(job)
            self.current = None

    def cancel(self, ident: str) -> bool:
        """Stops a running job and its Spark jobs; False if it does not run."""
        with self.lock:
            job = self.current
        if job is None or job.id != ident:
            return False
        job.cancelled.set()
        self.spark.sparkContext.cancelJobGroup(ident)
        return True

    def tasks(self, ident: str) -> dict[str, int]:
        """Tasks that the active Spark jobs of a run have done, and all of them."""
        tracker, done, total = self.spark.sparkContext.statusTracker(), 0, 0
        for number in tracker.getJobIdsForGroup(ident):
            job = tracker.getJobInfo(number)
            for stage in (tracker.getStageInfo(x) for x in job.stageIds) if job and job.status == "RUNNING" else ():
                if stage is not None:
                    done, total = done + stage.numCompletedTasks, total + stage.numTasks
        return {"done": done, "total": total}

    def list(self) -> list[dict]:
        """Newest first, the running one at the head."""
        with self.lock:
            return [j.status(0) for j in [*([self.current] if self.current else []), *self.done]]

    def get(self, ident: str) -> Job | None:
        with self.lock:
            return next((j for j in [*([self.current] if self.current else []), *self.done] if j.id == ident), None)
