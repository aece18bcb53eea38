"""The leased queue against a plain replay, in batch and as a stream whose timers fire."""

import random

import pytest

from scriptorium.streaming import queue as Q

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def replay(requests):
    """One queue's requests in order, by rules written down anew: (seq, answer, job, status)."""
    jobs, out = {}, []
    live = lambda j, now: j["lease"] is not None and j["lease"] >= now
    for r in sorted(requests, key=lambda r: (r["at"], r["seq"])):
        now = r["at"]
        for name in sorted(jobs):
            if jobs[name]["status"] == "cancel_requested" and jobs[name]["lease"] < now:
                jobs[name]["status"] = "cancelled"
                out.append((None, "expired", name, "cancelled"))
        j, name, answer = jobs.get(r["job"]), r["job"], None
        if r["kind"] == "submit" and name is not None:
            answer = "known" if j else "queued"
            jobs.setdefault(name, {"status": "queued", "worker": None, "token": None, "lease": None, "since": now})
        elif r["kind"] == "claim" and r["worker"] is not None:
            mine = sorted((v["since"], k) for k, v in jobs.items() if v["status"] in ("running", "cancel_requested") and v["worker"] == r["worker"] and live(v, now))
            free = sorted((v["since"], k) for k, v in jobs.items() if v["status"] == "queued" or v["status"] == "running" and not live(v, now))
            name, answer = (mine[0][1], "again") if mine else (free[0][1], "leased") if free else (None, "none")
            if answer == "leased":
                jobs[name] |= {"status": "running", "worker": r["worker"], "token": r["token"] or Q.token_of(r["queue"], name, r["seq"]), "lease": now + (r["lease_ms"] or Q.LEASE_MS)}
        elif r["kind"] == "recover":
            for v in jobs.values():
                if v["status"] in ("running", "cancel_requested"):
                    v |= {"status": "queued" if v["status"] == "running" else "cancelled", "worker": None, "token": None, "lease": None}
            name, answer = None, "recovered"
        elif r["kind"] == "update" and j:
            if j["status"] not in ("running", "cancel_requested") or (j["worker"], j["token"]) != (r["worker"], r["token"]) or not live(j, now):
                answer = "conflict"
            else:
                asked = r["status"] or j["status"]
                if not (j["status"] == "cancel_requested" and asked == "running"):
                    j["status"] = asked
                j["lease"], answer = now + (r["lease_ms"] or Q.LEASE_MS), "updated"
        elif r["kind"] == "cancel" and j:
            answer = {"queued": "cancelled", "running": "asked", "cancel_requested": "asked", "cancelled": "cancelled"}.get(j["status"], "unchanged")
            j["status"] = {"queued": "cancelled", "running": "cancel_requested"}.get(j["status"], j["status"])
        elif r["kind"] == "retry" and j:
            answer = "queued" if j["status"] in ("completed", "failed", "cancelled") else "active"
            if answer == "queued":
                j |= {"status": "queued", "worker": None, "token": None, "lease": None, "since": now}
        if answer is None:
            name, answer = None, "invalid"
        out.append((r["seq"], answer, name, jobs[name]["status"] if name else None))
    return out


def made(rng, n, queues=3):
    out = []
    for seq in range(n):
        kind = rng.choice(["submit", "submit", "claim", "claim", "claim", "update", "update", "update", "cancel", "retry", "recover" if rng.random() < 0.1 else "claim", "nonsense"])
        worker = rng.choice(["w1", "w2", "w3", None])
        out.append({"queue": f"q{rng.randrange(queues)}", "seq": seq, "at": seq * 100 + rng.randrange(300), "kind": kind, "job": rng.choice([*(f"j{k}" for k in range(12)), None]), "worker": worker, "token": worker, "status": rng.choice(["running", "running", "completed", "failed", None]), "lease_ms": rng.choice([300, 3000, 9000, None])})
    return out


@pytest.fixture
def rocks(spark):
    spark.conf.set(PROVIDER, Q._ROCKSDB)
    yield
    spark.conf.unset(PROVIDER)


def test_a_replay_in_batch(spark):
    requests = made(random.Random(1), 3000)
    got = Q.answers(spark.createDataFrame([tuple(r[c.split()[0]] for c in Q.REQUEST.split(", ")) for r in requests], Q.REQUEST)).collect()
    for q in ("q0", "q1", "q2"):
        want = replay([r for r in requests if r["queue"] == q])
        mine = [(r.seq, r.answer, r.job, r.status) for r in got if r.queue == q]
        assert sorted(mine, key=repr) == sorted(want, key=repr)
    assert {r.answer for r in got} >= {"queued", "known", "leased", "again", "none", "updated", "conflict", "asked", "cancelled", "unchanged", "active", "recovered", "invalid", "expired"}


def test_a_stream_in_batches_of_its_own(spark, rocks, tmp_path):
    """Requests arrive in files; the state carries over, and the answers are those of one replay."""
    requests = sorted(made(random.Random(2), 400, 2), key=lambda r: (r["at"], r["seq"]))
    names = [c.split()[0] for c in Q.REQUEST.split(", ")]
    for k in range(0, 400, 100):
        rows = [(*[r[n] for n in names], None) for r in requests[k : k + 100]]
        spark.createDataFrame(rows, Q.REQUEST + ", ts timestamp").selectExpr(*names, "timestamp_millis(at) AS ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(Q.REQUEST + ", ts timestamp").parquet(str(tmp_path / "in"))
        run = Q.answers(stream, "1 day").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
        run.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    want = [x for q in ("q0", "q1") for x in replay([r for r in requests if r["queue"] == q])]
    assert sorted(((r.seq, r.answer, r.job, r.status) for r in got), key=repr) == sorted(want, key=repr)


def test_a_timer_ends_what_was_asked_to_stop(spark, rocks, tmp_path):
    first = [("q", 1, 1000, "submit", "a", None, None, None, None), ("q", 2, 2000, "claim", None, "w", "t", None, 1000), ("q", 3, 2500, "cancel", "a", None, None, None, None)]
    later = [("other", 4, 90_000_000, "submit", "b", None, None, None, None)]
    for rows in (first, later, [("other", 5, 90_000_001, "submit", "b", None, None, None, None)]):
        spark.createDataFrame(rows, Q.REQUEST).selectExpr("*", "timestamp_millis(at) AS ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(Q.REQUEST + ", ts timestamp").parquet(str(tmp_path / "in"))
        run = Q.answers(stream, "1 second").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
        run.awaitTermination()
    got = {(r.queue, r.answer, r.job, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert ("q", "expired", "a", "cancelled") in got and ("q", "asked", "a", "cancel_requested") in got


def test_no_request_looks_at_all_jobs():
    """Fifty thousand claims and ends among as many open jobs, without a scan of them for each."""
    import time

    n = 50_000
    jobs = Q.Jobs({f"j{k:06}": ["queued", None, None, None, k, 1] for k in range(n)})
    request = {"seq": 1, "worker": None, "token": None, "status": "completed", "lease_ms": 10, "job": None}
    began = time.perf_counter()
    for k in range(n):
        assert Q.Queue._expire("q", jobs, k) == []
        got = Q.Queue._answer("q", jobs, request | {"kind": "claim", "at": k, "worker": f"w{k}", "token": "t"})
        assert got[4:6] == ("leased", f"j{k:06}")
        assert Q.Queue._answer("q", jobs, request | {"kind": "update", "at": k, "worker": f"w{k}", "token": "t", "job": got[5]})[4] == "updated"
    assert time.perf_counter() - began < 30
