"""A read-only SQLite table as a Spark data source.

``spark.dataSource.register(SqliteSource)`` and then
``spark.read.format("sqlite_table").options(path=..., table=...).schema(...).load()``.
A database that is locked is copied, with its write-ahead log, and the copy is
read and removed after use. Rows are dealt by rowid into ``partitions`` ranges.
Comparisons with literals, ``in`` and null tests go to SQLite where Spark hands them
over: with the option ``pushdown``, which needs ``spark.sql.python.filterPushdown.enabled``.
The columns that are read are those of the schema.

``items_of`` makes bibliographic items of the tables of an entity, attribute and value
database: one row an item, with its fields as columns, its creators in order and the
collections that it is in, with all that hold these.
"""

from __future__ import annotations

import os
import shutil
import sqlite3
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual


class Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


@contextmanager
def connected(path: str) -> Iterator[sqlite3.Connection]:
    """A read-only connection; a snapshot in its place where the database is locked, gone when this ends."""
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True, timeout=1)
    folder = None
    try:
        try:
            con.execute("SELECT 1 FROM sqlite_master LIMIT 1")
        except sqlite3.OperationalError:
            con.close()
            folder = tempfile.TemporaryDirectory()
            copy = os.path.join(folder.name, "snapshot.sqlite")
            for end in ("", "-wal", "-shm"):
                if os.path.exists(path + end):
                    shutil.copyfile(path + end, copy + end)
            con = sqlite3.connect(copy)
        yield con
    finally:
        con.close()
        if folder:
            folder.cleanup()


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


class SqliteReader(DataSourceReader):
    def __init__(self, schema, options):
        self.columns, self.path, self.table = schema.names, options["path"], options["table"]
        self.parts = int(options.get("partitions", "1"))
        self.where: list[str] = []
        self.values: list = []

    def partitions(self) -> list[Range]:
        with connected(self.path) as con:
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
        if low is None:
            return []
        step = -(-(high - low + 1) // self.parts)
        return [Range(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: Range) -> Iterator[tuple]:
        names = ", ".join(quoted(c) for c in self.columns)
        where = " AND ".join(["rowid >= ?", "rowid < ?", *self.where])
        with connected(self.path) as con:
            yield from con.execute(f"SELECT {names} FROM {quoted(self.table)} WHERE {where}", (partition.low, partition.high, *self.values))


class PushingReader(SqliteReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what SQLite decides as Spark does: numbers and texts compared with columns, in lists, null or not."""
        for f in filters:
            plain = isinstance(getattr(f, "value", None), (int, float, str)) or isinstance(f, In) and all(isinstance(v, (int, float, str)) for v in f.value)
            if len(getattr(f, "attribute", ())) == 1 and isinstance(f, (IsNull, IsNotNull)):
                self.where.append(f"{quoted(f.attribute[0])} IS {'NOT ' * isinstance(f, IsNotNull)}NULL")
            elif type(f) in _SIGNS and len(f.attribute) == 1 and plain:
                self.where.append(f"{quoted(f.attribute[0])} {_SIGNS[type(f)]} ?")
                self.values.append(f.value)
            elif isinstance(f, In) and len(f.attribute) == 1 and plain and f.value:
                self.where.append(f"{quoted(f.attribute[0])} IN ({', '.join('?' * len(f.value))})")
                self.values += f.value
            else:
                yield f


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def reader(self, schema) -> SqliteReader:
        kind = PushingReader if str(self.options.get("pushdown", "")).lower() == "true" else SqliteReader
        return kind(schema, self.options)


def items_of(tables: dict[str, DataFrame], fields: list[str], most_depth: int = 64) -> DataFrame:
    """(key, kind, one column for each of ``fields``, creators, collections) of the items that are no attachments or notes.

    ``tables``: items (itemID, key, itemTypeID), itemTypes (itemTypeID, typeName), itemData (itemID, fieldID, valueID),
    fields (fieldID, fieldName), itemDataValues (valueID, value), creators (creatorID, firstName, lastName), itemCreators
    (itemID, creatorID, orderIndex), collections (collectionID, collectionName, parentCollectionID), collectionItems
    (collectionID, itemID). Of values of one field the greatest is taken; circles of collections end where they close.
    """
    t = tables
    kinds = t["items"].join(t["itemTypes"], "itemTypeID").where(~F.col("typeName").isin("attachment", "note", "annotation"))
    values = t["itemData"].join(t["fields"].where(F.col("fieldName").isin(*fields)), "fieldID").join(t["itemDataValues"], "valueID")
    wide = values.groupBy("itemID").pivot("fieldName", fields).agg(F.max("value"))
    named = t["itemCreators"].join(t["creators"], "creatorID").select("itemID", F.struct("orderIndex", F.trim(F.concat_ws(" ", "firstName", "lastName")).alias("name")).alias("c"))
    people = named.groupBy("itemID").agg(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["name"]).alias("creators"))
    tree = t["collections"].select(F.col("collectionID").alias("id"), "collectionName", F.col("parentCollectionID").alias("up"))
    held = t["collectionItems"].select("itemID", F.col("collectionID").alias("id"))
    seen = held.distinct()
    for _ in range(most_depth):  # as deep as the tree of collections, which is small
        step = seen.join(tree.where("up IS NOT NULL"), "id").select("itemID", F.col("up").alias("id"))
        more = seen.unionByName(step).distinct().checkpoint() if seen.sparkSession.sparkContext.getCheckpointDir() else seen.unionByName(step).distinct().cache()
        if more.count() == seen.count():
            break
        seen = more
    boxes = seen.join(tree, "id").groupBy("itemID").agg(F.array_sort(F.collect_set("collectionName")).alias("collections"))
    out = kinds.join(wide, "itemID", "left").join(people, "itemID", "left").join(boxes, "itemID", "left")
    empty = F.array().cast("array<string>")
    return out.select("key", F.col("typeName").alias("kind"), *fields, F.coalesce("creators", empty).alias("creators"), F.coalesce("collections", empty).alias("collections"))
