"""Storage of an inverted index: segments, tombstones and manifests.

An index is a folder of segments, each with a folder name of its own, and of numbered
manifests. A segment holds the postings of its documents, sorted by term, and a row
for every id that it speaks of: how many documents, their length and a digest of the
indexed text, or that the id is gone. Later segments win over earlier ones, id by id.
A manifest lists segments in order with the corpus statistics, which are carried on
from the rows of touched ids alone. It is published last, under the next number, by
whoever claims that number first; others begin again from it, so two builders never
write into one folder and a reader never sees half a change. A handle
``<path>@<number>`` reads one manifest's state for as long as its segments are kept.

Ids may be null or repeated: an id stands for all its documents. Only the indexed
columns count as a change (a status update writes nothing). Another rule for tokens
builds everything anew.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Deltas beyond this number, or this share of the documents in deltas, are folded into a new base.
MOST_DELTAS, DELTA_SHARE = 8, 0.25
#: Ids of deltas that are broadcast to a query at most; more are joined.
BROADCAST_IDS = 200_000
_ATTEMPTS = 5


class Conflict(RuntimeError):
    """Another builder has published first."""


@dataclass
class Segment:
    name: str
    ids: int  # ids that it speaks of


@dataclass
class Manifest:
    number: int
    rule: int
    state: str  # of the table that was indexed
    n_docs: int
    total_len: int
    segments: list[Segment] = field(default_factory=list)

    @property
    def avg_len(self) -> float:
        return self.total_len / max(self.n_docs, 1)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str, ending: str) -> list[int]:
    p, fs = _fs(spark, f"{path}/manifests")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]  # one call; a file or two a manifest
    return sorted(int(m[1]) for n in names if (m := re.fullmatch(rf"([0-9]+){re.escape(ending)}", n)))


def load_json(spark: SparkSession, handle: str) -> dict | None:
    """The manifest that a handle names, or the newest of a path; None where there is none."""
    path, _, number = handle.partition("@")
    known = _numbers(spark, path, ".json")
    if not known or number and int(number) not in known:
        return None
    p, fs = _fs(spark, f"{path}/manifests/{number or known[-1]}.json")
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def load(spark: SparkSession, handle: str) -> Manifest | None:
    raw = load_json(spark, handle)
    return raw and Manifest(**raw | {"segments": [Segment(**s) for s in raw["segments"]]})


def publish_json(spark: SparkSession, path: str, number: int, content: dict) -> str:
    """Makes ``content`` the newest state; ``Conflict`` where its number is taken. A claim whose builder died is passed over by the next number."""
    claim, fs = _fs(spark, f"{path}/manifests/{number}.claim")
    if not fs.createNewFile(claim):
        raise Conflict(f"manifest {number} of {path} is another builder's")
    part, _ = _fs(spark, f"{path}/manifests/{number}.{uuid.uuid4().hex}")
    out = fs.create(part)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    fs.rename(part, _fs(spark, f"{path}/manifests/{number}.json")[0])
    return f"{path}@{number}"


def publish(spark: SparkSession, path: str, new: Manifest) -> str:
    return publish_json(spark, path, new.number, asdict(new))


def next_number(spark: SparkSession, path: str) -> int:
    return max([0, *_numbers(spark, path, ".json"), *_numbers(spark, path, ".claim")]) + 1


def entries(spark: SparkSession, path: str, m: Manifest, first: int = 0) -> DataFrame:
    """(id, n, len, digest, gone, seq) of all segments from ``first`` on."""
    out = None
    for seq, s in enumerate(m.segments[first:], first):
        one = spark.read.parquet(f"{path}/{s.name}/docs").withColumn("seq", F.lit(seq))
        out = one if out is None else out.unionByName(one)
    return out


def documents(spark: SparkSession, handle: str) -> DataFrame:
    """(id, n, len, digest) of the ids that are there."""
    path, m = handle.partition("@")[0], load(spark, handle)
    last = entries(spark, path, m)
    if len(m.segments) > 1:
        last = last.groupBy("id").agg(F.max_by(F.struct("n", "len", "digest", "gone"), "seq").alias("r")).select("id", "r.*")
    return last.where("NOT gone").select("id", "n", "len", "digest")


def postings(spark: SparkSession, handle: str) -> DataFrame:
    """(id, len, col, term, tf) of the documents that are there; a filter on terms reaches the scans of all segments."""
    path, m = handle.partition("@")[0], load(spark, handle)
    out = None
    for seq, s in enumerate(m.segments):
        one = spark.read.parquet(f"{path}/{s.name}/postings").withColumn("seq", F.lit(seq))
        out = one if out is None else out.unionByName(one)
    if len(m.segments) == 1:
        return out.drop("seq")
    over = entries(spark, path, m, 1).groupBy(F.col("id").alias("_id")).agg(F.max("seq").alias("_over"))
    if sum(s.ids for s in m.segments[1:]) <= BROADCAST_IDS:
        over = F.broadcast(over)
    joined = out.join(over, F.col("id").eqNullSafe(F.col("_id")), "left")
    return joined.where(F.coalesce(F.col("seq") >= F.col("_over"), F.lit(True))).drop("seq", "_id", "_over")


@dataclass(frozen=True)
class Rule:
    """``terms`` gives (id, len, col, term, tf) of documents (id and ``columns``); ``version`` names the rule for tokens."""

    version: int
    columns: tuple[str, ...]
    terms: Callable[[DataFrame], DataFrame]

    def digests(self, docs: DataFrame) -> DataFrame:
        """(id, n, digest): equal as long as the id's indexed columns are, in any order of its rows."""
        one = F.xxhash64(F.lit(self.version), *[F.coalesce(F.col(c), F.lit("")) for c in self.columns], *[F.col(c).isNull() for c in self.columns])
        return docs.withColumn("_d", one).groupBy("id").agg(F.count("*").alias("n"), F.sum(F.col("_d").cast("decimal(38,0)")).cast("string").alias("digest"))


def _write(spark: SparkSession, path: str, rule: Rule, docs: DataFrame, digests: DataFrame, gone: DataFrame | None) -> tuple[str, DataFrame]:
    """A new segment of ``docs``; returns its name and its rows of ids as stored."""
    name = f"segment-{uuid.uuid4().hex}"
    terms = rule.terms(docs)
    terms.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.option("parquet.block.size", 8 << 20).parquet(f"{path}/{name}/postings")
    lens = spark.read.parquet(f"{path}/{name}/postings").groupBy(F.col("id").alias("_id")).agg(F.sum("tf").cast("long").alias("len"))
    rows = digests.join(lens, F.col("id").eqNullSafe(F.col("_id")), "left").select("id", "n", F.coalesce("len", F.lit(0)).cast("long").alias("len"), "digest", F.lit(False).alias("gone"))
    if gone is not None:
        rows = rows.unionByName(gone.select("id", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("len"), F.lit("").alias("digest"), F.lit(True).alias("gone")))
    rows.write.parquet(f"{path}/{name}/docs")
    return name, spark.read.parquet(f"{path}/{name}/docs")


def _sums(rows: DataFrame) -> tuple[int, int, int]:
    r = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("len"), F.lit(0))).first()
    return int(r[0]), int(r[1]), int(r[2])


def build(spark: SparkSession, path: str, rule: Rule, docs: DataFrame, state: str = "") -> str:
    """A base segment of all ``docs`` (id and the rule's columns) as the newest state; returns its handle."""
    number = next_number(spark, path)
    name, rows = _write(spark, path, rule, docs, rule.digests(docs), None)
    ids, n, total = _sums(rows)
    return publish(spark, path, Manifest(number, rule.version, state, n, total, [Segment(name, ids)]))


def apply(spark: SparkSession, path: str, rule: Rule, changed: DataFrame, gone: DataFrame, state: str = "") -> str:
    """A delta: all documents of new or changed ids, and the ids that are gone (in no document of ``changed``).

    Only their postings are written; statistics take what their ids had before from the rows of ids.
    """
    old = load(spark, path)
    number = next_number(spark, path)
    name, rows = _write(spark, path, rule, changed, rule.digests(changed), gone)
    ids, n, total = _sums(rows)
    touched = rows.select(F.col("id").alias("_id"))
    had = documents(spark, f"{path}@{old.number}").join(touched, F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    _, old_n, old_total = _sums(had)
    return publish(spark, path, Manifest(number, rule.version, state, old.n_docs - old_n + n, old.total_len - old_total + total, [*old.segments, Segment(name, ids)]))


def refresh(spark: SparkSession, path: str, rule: Rule, docs: DataFrame, state: str) -> str:
    """The handle of an index of ``docs`` whose table is in ``state``: as it is, after a delta, or built anew."""
    for _ in range(_ATTEMPTS):
        try:
            old = load(spark, path)
            if old is None or old.rule != rule.version:
                return build(spark, path, rule, docs, state)
            if old.state == state:
                return f"{path}@{old.number}"
            return _delta(spark, path, rule, docs, state, old)
        except Conflict:
            continue
    raise Conflict(f"{_ATTEMPTS} builders have been faster at {path}")


def _delta(spark: SparkSession, path: str, rule: Rule, docs: DataFrame, state: str, old: Manifest) -> str:
    now = rule.digests(docs)
    before = documents(spark, f"{path}@{old.number}").select(F.col("id").alias("_id"), F.col("digest").alias("_old"))
    both = now.join(before, F.col("id").eqNullSafe(F.col("_id")), "full")
    todo = f"{path}/plan-{uuid.uuid4().hex}"
    changes = both.where("NOT (digest <=> _old)").select(F.when(F.col("digest").isNotNull(), F.col("id")).otherwise(F.col("_id")).alias("id"), F.col("digest").isNull().alias("gone"))
    changes.write.parquet(todo)
    changes = spark.read.parquet(todo)
    n = changes.count()
    gone = changes.where("gone").select("id")
    ids = changes.where("NOT gone").select(F.col("id").alias("_id"))
    try:
        if not n:
            return publish(spark, path, Manifest(next_number(spark, path), rule.version, state, old.n_docs, old.total_len, old.segments))
        if n > DELTA_SHARE * max(old.n_docs, 1):
            return build(spark, path, rule, docs, state)
        side = F.broadcast(ids) if n <= BROADCAST_IDS else ids
        handle = apply(spark, path, rule, docs.join(side, F.col("id").eqNullSafe(F.col("_id")), "left_semi"), gone, state)
        new = load(spark, handle)
        deltas = sum(s.ids for s in new.segments[1:])
        if len(new.segments) - 1 > MOST_DELTAS or deltas > DELTA_SHARE * max(new.n_docs, 1):
            handle = compact(spark, path, rule)
        return handle
    finally:
        _drop(spark, todo)


def compact(spark: SparkSession, path: str, rule: Rule) -> str:
    """One segment in place of all: postings that are there, sorted anew; no text is read."""
    old = load(spark, path)
    number = next_number(spark, path)
    name = f"segment-{uuid.uuid4().hex}"
    handle = f"{path}@{old.number}"
    postings(spark, handle).repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.option("parquet.block.size", 8 << 20).parquet(f"{path}/{name}/postings")
    documents(spark, handle).withColumn("gone", F.lit(False)).write.parquet(f"{path}/{name}/docs")
    ids, n, total = _sums(spark.read.parquet(f"{path}/{name}/docs"))
    return publish(spark, path, Manifest(number, rule.version, old.state, n, total, [Segment(name, ids)]))


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Deletes manifests but the newest ``keep``, and the segments that none of them names. Not while a builder is at work."""
    numbers = _numbers(spark, path, ".json")
    kept = {s.name for n in numbers[-keep:] for s in load(spark, f"{path}@{n}").segments}
    p, fs = _fs(spark, path)
    old = [s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith("segment-") and s.getPath().getName() not in kept]
    for n in numbers[:-keep]:
        _drop(spark, f"{path}/manifests/{n}.json")
    for name in old:
        _drop(spark, f"{path}/{name}")
    return old


def _drop(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)
