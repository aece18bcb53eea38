"""The associative scan, the sections that it finds, and boxes of points, against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import automaton, boxes, sections
from scriptorium.plans import registry


@pytest.mark.parametrize("width", [2, 3, 64])
def test_scan_equals_a_loop(spark, width):
    rng = random.Random(width)
    rows = [(k, p, [rng.randrange(4) for _ in range(4)]) for k, n in ((1, 0), (2, 1), (3, 130), (None, 40), (4, 64)) for p in rng.sample(range(-20, 2 * n + 1 - 20), n)]
    want = {}
    for key in {r[0] for r in rows}:
        s = 2
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            want[r[0], r[1]], s = s, r[2][s]
    df = spark.createDataFrame(rows, "key long, place long, f array<int>").repartition(3)
    got = automaton.states_before(df, "key", "place", F.col("f"), 4, 2, width)
    assert {(r.key, r.place): r.state for r in got.collect()} == want and got.count() == len(rows)
    assert automaton.states_before(df.limit(0), "key", "place", F.col("f"), 4, 2, width).count() == 0


def plain_sections(segments):
    """One document's (text, narrator) in order, read one by one."""
    number = lambda t: (m := re.match(r"([0-9]{1,3})\. Xu S,", t or "")) and int(m[1])
    out, skipping, ended = [], False, False
    for i, (text, narrator) in enumerate(segments):
        text = text or ""
        if narrator or ended:
            out.append(narrator)
            continue
        if text in ("References", "3. Bibliography:"):
            skipping = True
            out.append(False)
            continue
        if skipping and text in ("Appendix A", "B2. More Tables"):
            skipping = False
        if skipping:
            out.append(False)
            continue
        if number(text):
            last, n = number(text), 1
            for later, _ in segments[i + 1 : i + 12]:
                if number(later) and last < number(later) <= last + 5:
                    last, n = number(later), n + 1
            if n >= 3:
                ended = True
                out.append(False)
                continue
        out.append(True)
    return out


@pytest.mark.parametrize("width", [2, 5, 64])
def test_sections_equal_a_loop(spark, width):
    rng = random.Random(width)
    docs = {}
    for d in range(30):
        n, pick = 0, ["Some words.", "Some words.", "References", "3. Bibliography:", "Appendix A", "B2. More Tables", None]
        docs[d] = []
        for _ in range(rng.randint(0, 40)):
            n += rng.choice([1, 2, 9])
            docs[d].append((f"{n}. Xu S, Pan Z." if rng.random() < 0.15 else rng.choice(pick), rng.random() < 0.1))
    rows = [(d, k, t, n) for d, s in docs.items() for k, (t, n) in enumerate(s)]
    df = spark.createDataFrame(rows, "d long, k long, t string, n boolean").repartition(5)
    got = {(r.d, r.k): r.kept for r in sections.without_bibliographies(df, "d", "k", "t", F.col("n"), width).collect()}
    assert got == {(d, k): kept for d, s in docs.items() for k, kept in enumerate(plain_sections(s))}


def test_headings_and_entries(spark):
    of = lambda f, *t: [r[0] for r in spark.createDataFrame(list(enumerate(t)), "k int, t string").select(f(F.col("t"))).collect()]
    assert of(sections.entry_number, "4. Xu S, Pan Z.", "12. van Dyk", "7. O’Neil JB. A title", "1. Van der Berg K. Title", "x", "1234. Xu S.") == [4, None, 7, 1, None, None]
    assert of(sections.is_reference_heading, "References", "6. REFERENCE LIST:", "References are many", " works cited. ") == [True, True, False, True]
    assert of(sections.is_appendix_heading, "Appendix", "A Proofs of Lemmas", "A1.2 Data", "A dog barks, loudly", "a note", "supplementary " + "x " * 12, "B", "") == [True, True, True, False, False, False, False, False]


def test_first_box_equals_all_pairs(spark):
    rng = random.Random(3)
    at = lambda: rng.choice([rng.uniform(-50, 50), float(rng.randint(-5, 5)), 0.0])
    shapes = [(o, rng.choice(["a", "a", "b"]), x := at(), y := at(), x + rng.choice([0.0, 0.5, 3.0, 80.0, -7.0]), y + rng.choice([0.0, 1.0, 200.0])) for o in range(120)]
    shapes += [(200, "a", None, 0.0, 1.0, 1.0), (201, "a", float("nan"), 0.0, 1.0, 1.0), (202, None, -99.0, -99.0, 99.0, 99.0)]
    points = [(k, rng.choice(["a", "b", None]), at(), at()) for k in range(400)] + [(900, "a", None, 0.0), (901, "a", float("inf"), 0.0)]
    box = spark.createDataFrame(shapes, "ord long, page string, x0 double, y0 double, x1 double, y1 double")
    dot = spark.createDataFrame(points, "id long, page string, x double, y double")
    got = boxes.first_box(dot, box, "page", "x", "y", "ord")
    within = lambda v, a, b: min(a, b) <= v <= max(a, b)
    want = {i: min((o for o, q, x0, y0, x1, y1 in shapes[:120] if q == p and x is not None and within(x, x0, x1) and within(y, y0, y1)), default=None) for i, p, x, y in points}
    assert {r.id: r.box for r in got.collect()} == want and sum(v is not None for v in want.values()) > 100
    assert "Cartesian" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()
    assert {r.box for r in boxes.first_box(dot, box.limit(0), "page", "x", "y", "ord").collect()} == {None}


def test_prose_is_no_heading(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "References", True), (1, 1, "A.\nSHER!", False), (1, 2, "THEM", False), (1, 3, "Appendix B", True), (1, 4, "more", False)], "d long, k long, t string, a boolean")
    kept = lambda alone: [r.kept for r in sections.without_bibliographies(df, "d", "k", "t", F.lit(False), alone=alone).orderBy("k").collect()]
    assert kept(F.col("a")) == [False, False, False, True, True]
    assert kept(None) == [False, True, True, True, True]
    spark.createDataFrame([(1, "THERE. A.\nSHER!. THEM")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.k: r.kept for r in registry.QUERIES["w7_reference_sections"](spark, str(tmp_path)).collect()} == {0: False, 1: False, 2: False}


@pytest.mark.parametrize(("few", "spread"), [(4, 1000), (2, 1)])
def test_dense_boxes_equal_all_pairs(spark, monkeypatch, few, spread):
    """Hundreds of boxes over each point: no row is made for a pair of them, whatever the cells."""
    monkeypatch.setattr(boxes, "FEW", few)
    monkeypatch.setattr(boxes, "SPREAD", spread)
    rng = random.Random(5)
    shapes = [(o, rng.choice("ab"), x := float(rng.randint(0, 40)), y := rng.uniform(0, 20), x + rng.choice([0.0, 3.0, 30.0]), y + rng.choice([0.0, 5.0, 9.0])) for o in range(600)]
    points = [(k, rng.choice("ab"), float(rng.randint(-1, 60)), rng.uniform(-1, 25)) for k in range(500)]
    box = spark.createDataFrame(shapes, "ord long, page string, x0 double, y0 double, x1 double, y1 double")
    dot = spark.createDataFrame(points, "id long, page string, x double, y double")
    got = boxes.first_box(dot, box, "page", "x", "y", "ord")
    want = {i: min((o for o, q, x0, y0, x1, y1 in shapes if q == p and x0 <= x <= x1 and y0 <= y <= y1), default=None) for i, p, x, y in points}
    assert {r.id: r.box for r in got.collect()} == want and sum(v is not None for v in want.values()) > 100
    assert "Generate explode" not in got._jdf.queryExecution().optimizedPlan().toString()
