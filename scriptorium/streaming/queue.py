"""A job queue with leases as one stateful operator (``transformWithState``).

Requests of a queue come in order of time: submit, claim, update, cancel, retry,
recover. The state is a row a job, open jobs apart from ended ones, which are only
looked up; every request gets an answer, and a timer answers for cancellations whose
lease runs out without any request. Rules:

* A claim gives a worker its own live lease again; else the oldest queued job, or
  the oldest whose lease has run out; a worker has one live lease at most.
* An update needs the job's worker, token and a live lease; else it is a conflict
  and changes nothing. A requested cancellation outlasts an update to ``running``.
  An accepted update extends the lease.
* Cancelling a queued job ends it; a running one is asked to stop, and is cancelled
  when its lease runs out. Only ended jobs can be tried again, as new jobs.
* Recovery puts running jobs back into the queue and ends those asked to stop.

A submission whose key was seen answers with the first job. Requests of unknown jobs,
null fields or unknown kinds answer ``invalid`` and change nothing. Times are in
milliseconds; requests later than the watermark are Spark's to drop. A queue is one
key: queues are many, and one queue's requests are serial by their meaning.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

LEASE_MS = 300_000
ENDED = ("completed", "failed", "cancelled")
ACTIVE = ("running", "cancel_requested")
REQUEST = "queue string, seq long, at long, kind string, job string, worker string, token string, status string, lease_ms long"
ANSWER = "queue string, seq long, at long, kind string, answer string, job string, status string, worker string, token string, until long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_JOB = "status string, worker string, token string, until long, created long, attempt int"


def token_of(queue: str, job: str, seq: int) -> str:
    """The token of a lease whose claim brought none: the same when a batch is run again."""
    return hashlib.sha256(f"{queue}|{job}|{seq}".encode()).hexdigest()[:16]


class Jobs:
    """The known jobs of a queue while requests come in order of time, so that none looks at all jobs.

    ``free`` is a heap of jobs to claim, ``leases`` one of the ends of leases; entries that a later
    change has made untrue are dropped when they come up.
    """

    def __init__(self, known: dict[str, list]):
        self.known, self.free, self.leases, self.held = known, [], [], defaultdict(set)
        for job, row in known.items():
            if row[0] == "queued":
                heapq.heappush(self.free, (row[4], job))
            elif row[0] in ACTIVE:
                self.leased(job)

    def leased(self, job: str) -> None:
        row = self.known[job]
        heapq.heappush(self.leases, (row[3], job))
        self.held[row[1]].add(job)

    def freed(self, job: str) -> None:
        heapq.heappush(self.free, (self.known[job][4], job))

    def ended(self, now: int) -> list[str]:
        """Jobs asked to stop whose lease has run out; running ones of which that is true become free."""
        out = set()
        while self.leases and self.leases[0][0] < now:
            until, job = heapq.heappop(self.leases)
            row = self.known[job]
            if row[0] in ACTIVE and row[3] == until:
                out.add(job) if row[0] == "cancel_requested" else self.freed(job)
        return sorted(out)

    def own(self, worker: str, now: int) -> str | None:
        """The worker's live lease, the oldest if there are more."""
        held = {j for j in self.held[worker] if self.known[j][0] in ACTIVE and self.known[j][1] == worker and self.known[j][3] >= now}
        self.held[worker] = held
        return min(((self.known[j][4], j) for j in held), default=(None, None))[1]

    def next(self, now: int) -> str | None:
        while self.free:
            created, job = heapq.heappop(self.free)
            row = self.known[job]
            if row[4] == created and (row[0] == "queued" or row[0] == "running" and row[3] < now):
                return job
        return None


class Queue(StatefulProcessor):
    def __init__(self, timers: bool):
        self.timers = timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "job string", _JOB)
        self.ended = handle.getMapState("ended", "job string", _JOB)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        requests = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")
        requests = requests.astype(object).where(requests.notna(), None).to_dict("records")
        known = self._load({r["job"] for r in requests if r["job"] is not None})
        before, out = {k: tuple(v) for k, v in known.items()}, []
        jobs = Jobs(known)
        for r in requests:
            out += self._expire(key[0], jobs, r["at"] or 0)
            out.append(self._answer(key[0], jobs, r))
        self._save(known, before)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ANSWER.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self._load(set())
        before = {k: tuple(v) for k, v in known.items()}
        out = self._expire(key[0], Jobs(known), int(expiredTimerInfo.getExpiryTimeInMs()) + 1)
        self._save(known, before)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ANSWER.split(", ")])

    def _load(self, named: set[str]) -> dict[str, list]:
        """Open jobs, and those of the ended ones that are named."""
        known = {k[0]: list(v) for k, v in self.open.iterator()}
        for job in named - set(known):
            if self.ended.containsKey((job,)):
                known[job] = list(self.ended.getValue((job,)))
        return known

    def _save(self, known: dict[str, list], before: dict[str, tuple]) -> None:
        for job, row in known.items():
            if before.get(job) == tuple(row):
                continue
            now, other = (self.ended, self.open) if row[0] in ENDED else (self.open, self.ended)
            now.updateValue((job,), tuple(row))
            if job in before and (before[job][0] in ENDED) != (row[0] in ENDED):
                other.removeKey((job,))
            if self.timers and row[0] == "cancel_requested":
                self.handle.registerTimer(int(row[3]))

    def close(self) -> None:
        pass

    @staticmethod
    def _expire(queue: str, jobs: Jobs, now: int) -> list[tuple]:
        """Jobs asked to stop whose lease has run out end, each with an answer of its own."""
        out = []
        for job in jobs.ended(now):
            row = jobs.known[job]
            row[0] = "cancelled"
            out.append((queue, None, int(row[3]), "expire", "expired", job, row[0], row[1], row[2], row[3]))
        return out

    @staticmethod
    def _answer(queue: str, jobs: Jobs, r: dict) -> tuple:
        known = jobs.known
        now, kind, job, lease = r["at"], r["kind"], r["job"], int(r["lease_ms"] or LEASE_MS)
        say = lambda answer, job=None: (queue, r["seq"], now, kind, answer, job, *(known[job][:3] if job in known else (None, None, None)), known[job][3] if job in known else None)
        if now is None or kind not in ("submit", "claim", "update", "cancel", "retry", "recover"):
            return say("invalid")
        if kind == "submit":
            if job is None:
                return say("invalid")
            if job in known:
                return say("known", job)
            known[job] = ["queued", None, None, None, int(now), 1]
            jobs.freed(job)
            return say("queued", job)
        if kind == "claim":
            if r["worker"] is None:
                return say("invalid")
            own = jobs.own(r["worker"], now)
            if own is not None:
                return say("again", own)
            job = jobs.next(now)
            if job is None:
                return say("none")
            known[job][:4] = ["running", r["worker"], r["token"] or token_of(queue, job, r["seq"]), int(now) + lease]
            jobs.leased(job)
            return say("leased", job)
        if kind == "recover":
            for j, row in known.items():
                if row[0] in ACTIVE:
                    row[:4] = ["queued" if row[0] == "running" else "cancelled", None, None, None]
                    if row[0] == "queued":
                        jobs.freed(j)
            return say("recovered")
        if job not in known:
            return say("invalid")
        row = known[job]
        if kind == "update":
            if row[0] not in ACTIVE or row[1] != r["worker"] or row[2] != r["token"] or row[3] < now:
                return say("conflict", job)
            wanted = r["status"] or row[0]
            if wanted not in ("running", *ENDED, row[0]):
                return say("invalid", job)
            row[0] = row[0] if row[0] == "cancel_requested" and wanted == "running" else wanted
            row[3] = int(now) + lease
            if row[0] in ACTIVE:
                jobs.leased(job)
            return say("updated", job)
        if kind == "cancel":
            if row[0] == "queued":
                row[0] = "cancelled"
            elif row[0] == "running":
                row[0] = "cancel_requested"
                jobs.leased(job)
            return say("cancelled" if row[0] == "cancelled" else "unchanged" if row[0] in ENDED else "asked", job)
        if row[0] not in ENDED:
            return say("active", job)
        row[:] = ["queued", None, None, None, int(now), row[5] + 1]
        jobs.freed(job)
        return say("queued", job)


def answers(requests: DataFrame, late: str | None = None) -> DataFrame:
    """An answer for each of the ``requests`` (``REQUEST``'s columns), in batch or as a stream.

    As a stream, ``ts`` (a timestamp equal to ``at``) carries the watermark and with it the
    timers; Spark must keep state in RocksDB. A batch is the replay of all requests.
    """
    spark = requests.sparkSession
    if not requests.isStreaming:
        spark.streams.active  # noqa: B018  (the state store's coordinator starts with the stream manager)
        if spark.conf.get(_PROVIDER, None) in (None, "") or "HDFSBacked" in spark.conf.get(_PROVIDER):
            spark.conf.set(_PROVIDER, _ROCKSDB)
    rows = requests.withWatermark("ts", late) if late else requests
    names = [c.split()[0] for c in REQUEST.split(", ")]
    rows = rows.select(*names, *(["ts"] if late else []))
    return rows.groupBy("queue").transformWithStateInPandas(statefulProcessor=Queue(bool(late)), outputStructType=ANSWER, outputMode="Append", timeMode="EventTime" if late else "None")
