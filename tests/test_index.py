"""Deltas, tombstones, manifests and compaction of the stored index against an index built anew."""

import random

import pytest

from scriptorium.operators import index, search


def frame(spark, docs):
    return spark.createDataFrame([(i, t, b) for i, rows in docs.items() for t, b in rows], "id long, title string, body string")


def same(spark, handle, docs, tmp):
    """Postings, statistics and scores are those of a full build of ``docs``."""
    full = search.write_index(frame(spark, docs), tmp)
    rows = lambda h: sorted((tuple(r) for r in search.postings(spark, h).select("id", "col", "term", "tf", "len").collect()), key=repr)
    a, b = index.load(spark, handle), index.load(spark, full)
    assert rows(handle) == rows(full) and (a.n_docs, a.total_len) == (b.n_docs, b.total_len)
    score = lambda h: {r.id: round(r.score, 9) for r in search.bm25(spark, h, "red blue green").collect()}
    assert score(handle) == score(full)


def test_deltas_equal_a_full_build(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "DELTA_SHARE", 9.0)
    rng = random.Random(2)
    text = lambda: " ".join(rng.choice(["red", "blue", "green", "été", "x1"]) for _ in range(rng.randint(0, 8)))
    docs = {k: [(text(), text())] for k in range(30)} | {None: [("red", None)], 40: [("a", "red"), ("b", "blue")]}
    path, fresh = str(tmp_path / "index"), iter(range(99))
    handle = index.refresh(spark, path, search.rule(), frame(spark, docs), "0")
    first, before = handle, dict(docs)
    for step in range(3):
        for k in rng.sample(range(30), 4):
            docs[k] = [(text(), text())]
        docs.pop(rng.choice(sorted(k for k in docs if k is not None and k < 30)))
        docs[100 + step] = [(text(), text())] * (step + 1)
        if step == 1:
            docs.pop(None)
        handle = index.refresh(spark, path, search.rule(), frame(spark, docs), str(step + 1))
        m = index.load(spark, handle)
        assert len(m.segments) == step + 2 and m.segments[-1].ids <= 7
        same(spark, handle, docs, str(tmp_path / f"full-{next(fresh)}"))
    same(spark, first, before, str(tmp_path / "full-before"))  # an old handle still reads its own state
    monkeypatch.setattr(index, "BROADCAST_IDS", 0)
    same(spark, handle, docs, str(tmp_path / "full-joined"))
    whole = index.compact(spark, path, search.rule())
    assert len(index.load(spark, whole).segments) == 1
    same(spark, whole, docs, str(tmp_path / "full-compact"))
    gone = index.vacuum(spark, path, keep=1)
    assert len(gone) == 4 and index.load(spark, first) is None
    same(spark, whole, docs, str(tmp_path / "full-vacuum"))


def test_only_changed_text_is_indexed_again(spark, tmp_path):
    docs = {k: [(f"title {k}", "red")] for k in range(20)}
    path = str(tmp_path / "index")
    one = index.refresh(spark, path, search.rule(), frame(spark, docs), "a")
    assert index.refresh(spark, path, search.rule(), frame(spark, docs), "a") == one
    two = index.refresh(spark, path, search.rule(), frame(spark, docs), "b")  # another state of files, the same texts
    assert two != one and index.load(spark, two).segments == index.load(spark, one).segments
    docs[3] = [("title 3", "blue")]
    three = index.load(spark, index.refresh(spark, path, search.rule(), frame(spark, docs), "c"))
    assert [s.ids for s in three.segments] == [20, 1]
    assert sorted(r.id for r in spark.read.parquet(f"{path}/{three.segments[1].name}/postings").select("id").distinct().collect()) == [3]
    docs |= {k: [("t", "green")] for k in range(10)}  # half of them: a new base
    assert [s.ids for s in index.load(spark, index.refresh(spark, path, search.rule(), frame(spark, docs), "d")).segments] == [20]


def test_another_rule_builds_anew_and_an_empty_table_is_an_index(spark, tmp_path):
    docs = {1: [("a", "red")], 2: [("b", "blue")]}
    path = str(tmp_path / "index")
    old = index.build(spark, path, search.rule(("title",), search.VERSION - 1), frame(spark, docs), "s")
    new = index.refresh(spark, path, search.rule(), frame(spark, docs), "s")
    assert new != old and index.load(spark, new).rule == search.VERSION and search.bm25(spark, new, "blue").first().id == 2
    empty = search.write_index(frame(spark, {}), str(tmp_path / "none"))
    assert search.bm25(spark, empty, "red").count() == 0 and index.load(spark, empty).avg_len == 0


def test_two_builders_do_not_damage_each_other(spark, tmp_path, monkeypatch):
    docs = {k: [("t", "red")] for k in range(12)}
    path = str(tmp_path / "index")
    index.refresh(spark, path, search.rule(), frame(spark, docs), "0")
    real, other = index.publish, {"done": False}

    def late(session, where, manifest):
        if not other["done"]:  # another builder publishes between this one's reading and publishing
            other["done"] = True
            theirs = dict(docs) | {50: [("t", "blue")]}
            index.refresh(session, where, search.rule(), frame(session, theirs), "theirs")
        return real(session, where, manifest)

    monkeypatch.setattr(index, "publish", late)
    mine = dict(docs) | {60: [("t", "green")]}
    handle = index.refresh(spark, path, search.rule(), frame(spark, mine), "mine")
    same(spark, handle, mine, str(tmp_path / "full"))
    with pytest.raises(index.Conflict):
        real(spark, path, index.load(spark, handle))
    assert index.load(spark, path).state == "mine"
