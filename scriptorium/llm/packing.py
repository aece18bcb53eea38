"""Best-fit packing with Martello-Toth dominance reduction.

Token sequences of at most ``capacity`` ids are packed into as few bins as can
be. What has to be packed is summed up by the counts of each length, which is at
most ``capacity`` numbers whatever the size of the corpus, so the plan is made
on the driver and only its short list of patterns is sent out:

1. Reduction. For the longest piece left, a set of pieces that provably
   dominates every other feasible set with it is fixed for good: alone if
   nothing fits with it; with the largest partner that fits, if that fills the
   bin or if no two further pieces fit; with the largest pair, if no three fit
   and it is at least as long, piece by piece, as every other pair. The instance shrinks by it, for all pieces of these lengths at once.
2. The rest is packed best-fit decreasing, bins with the same content together.

Then every piece takes the place of its rank among the pieces of its length.
Ranks are taken in lots, so that no length, however common, is sorted in one
task. Null and empty texts have the single id 0 that ends a document; repeated
rows are pieces of their own; an empty table has no sequence.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import rank_in

Pattern = tuple[int, tuple[tuple[int, int], ...]]  # how many bins; (length, pieces) by falling length


class _Stock:
    """Counts by length with the lengths that are left in order."""

    def __init__(self, counts: dict[int, int]):
        self.count = {k: v for k, v in counts.items() if v > 0}
        self.sizes = sorted(self.count)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            self.sizes.pop(bisect_left(self.sizes, size))

    def most(self, room: int, below: Counter | None = None) -> int:
        """The largest length up to ``room`` of which pieces are left beside those in ``below``; else 0."""
        i = bisect_left(self.sizes, room + 1) - 1
        while i >= 0 and below and self.count[self.sizes[i]] <= below[self.sizes[i]]:
            i -= 1
        return self.sizes[i] if i >= 0 else 0

    def least(self, n: int, used: Counter) -> int:
        """Least total of ``n`` pieces left beside ``used``; 0 if there are fewer."""
        got: list[int] = []
        for s in self.sizes:
            got += [s] * min(n, self.count[s] - used[s])
            if len(got) >= n:
                return sum(got[:n])
        return 0


def reduce(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Bins fixed by dominance, and the counts that are left undecided.

    A condition that holds for one piece of a length holds for the next as long as
    pieces of the lengths in its bin are left, so whole runs of bins are fixed.
    """
    fixed: list[Pattern] = []
    stock = _Stock(counts)
    for size in sorted(counts, reverse=True):
        while size in stock.count:
            used, room = Counter({size: 1}), capacity - size
            partner = stock.most(room, used)  # of all that is left, longer undecided pieces included
            content = Counter(used)
            if partner:
                two, three = stock.least(2, used), stock.least(3, used)
                if partner == room or not two or two > room:
                    content[partner] += 1
                elif not three or three > room:  # two more at most: does the largest pair dominate all pairs?
                    both = used + Counter({partner: 1})
                    second = stock.most(room - partner, both)
                    if second and second == stock.most(room // 2, both):
                        content = both + Counter({second: 1})
                if content == used:
                    break
            bins = min(stock.count[s] // k for s, k in content.items())
            for s, k in content.items():
                stock.take(s, bins * k)
            fixed.append((bins, tuple(sorted(content.items(), reverse=True))))
    return fixed, dict(stock.count)


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over runs of equal bins."""
    by_room: dict[int, list[tuple[int, tuple]]] = {}
    rooms: list[int] = []

    def put(room: int, bins: int, content: tuple) -> None:
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append((bins, content))

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            i = bisect_left(rooms, size)
            if i == len(rooms):
                fit = capacity // size
                if full := n // fit:
                    put(capacity - fit * size, full, ((size, fit),))
                if n % fit:
                    put(capacity - (n % fit) * size, 1, ((size, n % fit),))
                n = 0
                continue
            room = rooms[i]
            bins, content = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(i)
            fit = room // size
            full = min(bins, n // fit)
            if full:
                put(room - fit * size, full, (*content, (size, fit)))
                n -= full * fit
            if bins > full:
                if n and n < fit:
                    put(room - n * size, 1, (*content, (size, n)))
                    full, n = full + 1, 0
                if bins > full:
                    put(room, bins - full, content)
    return [p for group in by_room.values() for p in group]


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    fixed, left = reduce(counts, capacity)
    return fixed + best_fit(left, capacity)


def slots(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, pieces a bin, offset): where the pieces of a length go."""
    rank: Counter = Counter()
    out, sequence = [], 0
    for bins, content in patterns:
        offset = 0
        for size, k in content:
            out.append((size, rank[size], rank[size] + bins * k, sequence, k, offset))
            rank[size] += bins * k
            offset += size * k
        sequence += bins
    return out


def pack(pieces: DataFrame, capacity: int, order: list[str], lot_rows: int = 100_000) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` from 1 to ``capacity``.

    ``pieces`` is read twice and should be a written table. The broadcast list
    has at most a few rows for each length, so it is bounded by ``capacity``.
    The pieces of one length are ranked in lots of about ``lot_rows``, as many as their count asks for.
    """
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    rows = slots(plan(counts, capacity))
    schema = "array<array<bigint>>"
    packed = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), schema)).alias("s"))
    names = ["length", "lo", "hi", "seq", "k", "at"]
    # one row a length: its slots in order of rank
    table = packed.select(*[F.col("s")[i].alias(n) for i, n in enumerate(names)]).groupBy("length").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "seq", "k", "at"))).alias("slots"))
    lots = {str(length): -(-n // lot_rows) for length, n in counts.items()}
    salts = F.coalesce(F.element_at(F.from_json(F.lit(json.dumps(lots)), "map<string,bigint>"), F.col("length").cast("string")), F.lit(1))
    ranked = rank_in(pieces, "length", [F.col(c) for c in order], salts, "_rank")
    placed = ranked.join(F.broadcast(table), "length").withColumn("_s", F.filter("slots", lambda s: (s["lo"] <= F.col("_rank")) & (F.col("_rank") < s["hi"]))[0])
    index = F.col("_rank") - F.col("_s.lo")
    return placed.withColumn("sequence_id", (F.col("_s.seq") + F.floor(index / F.col("_s.k"))).cast("long")).withColumn(
        "offset", (F.col("_s.at") + F.pmod(index, F.col("_s.k")) * F.col("length")).cast("long")
    ).drop("_s", "_rank", "slots")


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that no packing can do without: the sum of lengths, and the pieces over half with what cannot join them."""
    best = -(-sum(s * n for s, n in counts.items()) // capacity)
    for a in sorted({0, *(s for s in counts if 2 * s <= capacity)}):
        big = sum(n for s, n in counts.items() if s > capacity - a)
        mid = {s: n for s, n in counts.items() if capacity / 2 < s <= capacity - a}
        small = sum(s * n for s, n in counts.items() if a <= s <= capacity / 2)
        free = sum((capacity - s) * n for s, n in mid.items())
        best = max(best, big + sum(mid.values()) + max(0, -(-(small - free) // capacity)))
    return best

