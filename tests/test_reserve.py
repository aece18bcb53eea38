"""Reservations by phases against a plain loop."""

import random

import pytest

from scriptorium.operators.reserve import reserve


@pytest.mark.parametrize("budget, most", [(0, 3), (1, 3), (100, 120), (1000, 40), (977, 1500)])
def test_reservations_equal_a_loop(spark, budget, most):
    rng = random.Random(budget)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), k, rng.choice([None, 0, -4, 1, rng.randrange(most), most - rng.randrange(3)])) for k in rng.sample(range(5000), 600)]
    rows += [(f"one{k}", 1, budget + k - 2) for k in range(5)]
    left, want = {}, {}
    for s, o, n in sorted(rows, key=lambda r: (r[1], r[2] or 0)):
        n, room = max(n or 0, 0), left.get(s, budget)
        want[s, o], left[s] = n <= room, room - n * (n <= room)
    df = spark.createDataFrame(rows, "source string, id long, size long").repartition(5)
    got = reserve(df, "source", "id", "size", budget, range_rows=40).collect()
    assert {(r.source, r.id): r.accepted for r in got} == want and len(got) == len(rows)


def test_odd_reservations(spark):
    same = spark.createDataFrame([("a", 1, 6)] * 5 + [("a", None, 3)], "source string, id long, size long")
    assert sorted((r.id or 0, r.accepted) for r in reserve(same, "source", "id", "size", 15).collect()) == [(0, True), (1, False), (1, False), (1, False), (1, True), (1, True)]
    assert reserve(same.limit(0), "source", "id", "size", 15).count() == 0
