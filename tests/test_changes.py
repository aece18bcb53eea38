"""Change feeds with cursors, quotas and pacing against plain loops."""

import random

import pytest

from scriptorium.operators import changes, index, quotas, revisions

ROW = "key string, version long, title string"


def feed_of(spark, log):
    """A source whose log holds (key, version, title or None for a deletion)."""

    def feed(since):
        said = [r for r in log if r[1] > since]
        if not said:
            return None
        live, gone = [r for r in said if r[2] is not None], [r[:2] for r in said if r[2] is None]
        return changes.Batch(spark.createDataFrame(live, ROW), spark.createDataFrame(gone, "key string, version long"), max(r[1] for r in said))

    return feed


def test_feeds_have_cursors_of_their_own_and_batches_may_come_twice(spark, tmp_path):
    items, boxes = str(tmp_path / "items"), str(tmp_path / "collections")
    log = [("a", 1, "one"), ("b", 2, "two"), (None, 2, "no key")]
    assert changes.sync(spark, items, feed_of(spark, log), "key", "version") == 2 and changes.cursor(spark, boxes) == 0
    assert changes.sync(spark, items, feed_of(spark, log), "key", "version") == 2  # nothing since
    assert index.load_json(spark, items)["number"] == 1
    assert changes.sync(spark, boxes, feed_of(spark, [("x", 7, "box")]), "key", "version") == 7 and changes.cursor(spark, items) == 2
    log += [("a", 3, "one more"), ("b", 4, None), ("c", 5, "three"), ("c", 5, None), ("d", 6, "in the bin")]
    whole = changes.Batch(spark.createDataFrame([r for r in log if r[2]], ROW), spark.createDataFrame([r[:2] for r in log if not r[2]], "key string, version long"), 6)
    assert changes.sync(spark, items, lambda since: whole, "key", "version") == 6  # a feed that says all again
    rows = sorted((tuple(r) for r in changes.rows(spark, items).select("key", "version", "title").collect()), key=repr)
    assert rows == sorted([("a", 3, "one more"), ("d", 6, "in the bin"), (None, 2, "no key")], key=repr)
    assert {r.key for r in changes.rows(spark, items, tombstones=True).where("_gone").collect()} == {"b", "c"}
    late = changes.Batch(spark.createDataFrame([("b", 3, "late")], ROW), spark.createDataFrame([], "key string, version long"), 8)
    changes.sync(spark, items, lambda since: late, "key", "version")
    assert "b" not in {r.key for r in changes.rows(spark, items).collect()} and changes.cursor(spark, items) == 8


def test_a_batch_that_dies_leaves_cursor_and_rows(spark, tmp_path, monkeypatch):
    path, log = str(tmp_path / "items"), [("a", 1, "one")]
    changes.sync(spark, path, feed_of(spark, log), "key", "version")
    real = index.publish_json
    monkeypatch.setattr(index, "publish_json", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        changes.sync(spark, path, feed_of(spark, [*log, ("a", 2, "two")]), "key", "version")
    assert changes.cursor(spark, path) == 1 and changes.rows(spark, path).first().title == "one"
    monkeypatch.setattr(index, "publish_json", real)
    assert changes.sync(spark, path, feed_of(spark, [*log, ("a", 2, "two")]), "key", "version") == 2 and changes.rows(spark, path).first().title == "two"
    with pytest.raises(LookupError):
        changes.rows(spark, str(tmp_path / "none"))


def test_quotas_equal_a_loop(spark):
    rng = random.Random(8)
    rows = [(k, f"2024-01-{rng.randint(1, 9):02}", rng.choice([None, *(f"r{i}" for i in range(150))]), rng.choice(["x", "x", "y", None])) for k in range(600)] + [(900, None, "r1", "x")]
    daily, total, per_day, seen, want, taken = 9, 60, {}, {}, {}, 0
    for k, day, name, content in sorted((r for r in rows if r[1] and r[2]), key=lambda r: (r[1], r[0])):
        if name in seen:
            want[k] = "again" if seen[name] == content else "conflict"
            continue
        seen[name] = content
        if taken >= total:
            want[k] = "total"
        elif per_day.get(day, 0) >= daily:
            want[k] = "daily"
        else:
            want[k], taken, per_day[day] = "admitted", taken + 1, per_day.get(day, 0) + 1
    df = spark.createDataFrame(rows, "k long, day string, id string, content string").selectExpr("k", "CAST(day AS DATE) AS day", "id", "content", "'clash' AS answer")
    got = {r.k: r.answer for r in quotas.admitted(df, "day", "k", "id", "content", daily, total).collect()}
    close = {k: v for k, v in want.items() if v not in ("total", "daily")}
    assert {k: got[k] for k in close} == close and all(got[k] in ("total", "daily") for k in want if k not in close)
    assert all(got[k] == "invalid" for k in got if k not in want) and sum(v == "admitted" for v in got.values()) == min(total, taken)


def test_pacing_equals_a_loop(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(k, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, rng.randint(0, 900)])) for k in range(500)]
    want, last = {}, {}
    for k, host, at in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
        want[k] = last[host] = max(at, last.get(host, -(10**9)) + 7)
    monkeypatch.setattr(quotas, "RANGE_ROWS", 20)
    got = quotas.paced(spark.createDataFrame(rows, "k long, host string, at long"), "host", "at", "k", 7)
    assert {r.k: r.start for r in got.collect()} == {k: want.get(k) for k, _, _ in rows}


def test_saves_equal_a_replay(spark):
    """Long chains, saves that expect an old revision, contents that come back, ids used again."""
    rng = random.Random(10)
    rows, current, sent = [], {}, []
    for k in range(500):
        path = rng.choice(["a", "a", "a", "b", "c"])
        known = [r[4] for r in rows if r[1] == path] or [None]
        expected = current.get(path) if rng.random() < 0.7 else rng.choice(known)
        rev = rng.choice(["same", f"v{k}", f"v{k}", f"v{k}"])
        row = (k, path, f"r{k}", expected, rev)
        if sent and rng.random() < 0.1:
            old = rng.choice(sent)
            row = (k, *old[1:]) if rng.random() < 0.5 else (k, path, old[2], expected, rev)
        elif current.get(path) == expected:
            current[path] = rev
        sent.append(row)
        rows.append(row)
    rows += [(900, None, "n", None, "v"), (901, "a", None, None, "v"), (None, "a", "m", None, "v")]
    state, seen, want = {}, {}, {}
    for k, path, name, expected, rev in rows:
        if path is None or name is None or k is None:
            want[k] = "invalid"
        elif name in seen:
            want[k] = "again" if seen[name] == (path, expected, rev) else "reused"
        else:
            seen[name] = (path, expected, rev)
            want[k] = "accepted" if state.get(path) == expected else "conflict"
            if want[k] == "accepted":
                state[path] = rev
    df = spark.createDataFrame([(*r, "clash") for r in rows], "k long, path string, id string, expected string, rev string, answer string").repartition(4)
    got = {r.k: r.answer for r in revisions.replayed(df, "path", "k", "id", "expected", "rev").collect()}
    assert got == want and sum(v == "accepted" for v in want.values()) > 100 and {"again", "reused", "conflict"} <= set(want.values())
