"""The database source: filters that reach SQLite, snapshots that go, items of an entity, attribute and value database."""

import os
import sqlite3
import tempfile

import pytest
from pyspark.sql.datasource import EqualTo, In, IsNotNull, LessThan, StringContains
from pyspark.sql.types import StructType

from scriptorium.sources import sqlite

TABLES = {
    "items": ("itemID long, key string, itemTypeID long", [(1, "AAA", 1), (2, "BBB", 1), (3, "CCC", 2), (4, "DDD", 3)]),
    "itemTypes": ("itemTypeID long, typeName string", [(1, "journalArticle"), (2, "attachment"), (3, "book")]),
    "fields": ("fieldID long, fieldName string", [(1, "title"), (2, "DOI"), (3, "pages")]),
    "itemDataValues": ("valueID long, value string", [(1, "Rain"), (2, "10.1/a"), (3, "Roofs"), (4, "9")]),
    "itemData": ("itemID long, fieldID long, valueID long", [(1, 1, 1), (1, 2, 2), (2, 1, 3), (1, 3, 4)]),
    "creators": ("creatorID long, firstName string, lastName string", [(1, "Ada", "Berg"), (2, None, "Dyk"), (3, "Cy", "Eng")]),
    "itemCreators": ("itemID long, creatorID long, orderIndex long", [(1, 3, 1), (1, 2, 0), (2, 1, 0)]),
    "collections": ("collectionID long, collectionName string, parentCollectionID long", [(1, "Top", None), (2, "Mid", 1), (3, "Low", 2), (4, "Ring", 5), (5, "Round", 4)]),
    "collectionItems": ("collectionID long, itemID long", [(3, 1), (4, 2)]),
}


@pytest.fixture(scope="module")
def library(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("eav") / "library.sqlite")
    with sqlite3.connect(path) as con:
        for name, (schema, rows) in TABLES.items():
            con.execute(f"CREATE TABLE {name} ({', '.join(c.split()[0] for c in schema.split(', '))})")
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    return path


@pytest.fixture(scope="module")
def load(spark, library):
    spark.dataSource.register(sqlite.SqliteSource)
    return lambda name, **o: spark.read.format("sqlite_table").options(path=library, table=name, partitions="2", **o).schema(TABLES[name][0]).load()


def test_items_of_a_library(load):
    got = {r.key: r for r in sqlite.items_of({n: load(n) for n in TABLES}, ["title", "DOI"]).collect()}
    assert set(got) == {"AAA", "BBB", "DDD"} and (got["AAA"].title, got["AAA"].DOI, got["AAA"].kind) == ("Rain", "10.1/a", "journalArticle")
    assert got["AAA"].creators == ["Dyk", "Cy Eng"] and got["AAA"].collections == ["Low", "Mid", "Top"]
    assert got["BBB"].collections == ["Ring", "Round"] and got["BBB"].DOI is None and got["DDD"].creators == got["DDD"].collections == []


def test_filters_reach_the_database(spark, load, library):
    reader = sqlite.PushingReader(StructType.fromDDL(TABLES["items"][0]), {"path": library, "table": "items", "partitions": "2"})
    left = list(reader.pushFilters([EqualTo(("itemTypeID",), 1), IsNotNull(("key",)), In(("itemID",), (1, 2, 4)), LessThan(("itemID",), 2), StringContains(("key",), "A")]))
    assert left == [StringContains(("key",), "A")] and [r for p in reader.partitions() for r in reader.read(p)] == [(1, "AAA", 1)]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = load("items", pushdown="true").where("itemTypeID = 1 AND itemID > 1 AND key LIKE '%B%'")
        assert [r.key for r in some.collect()] == ["BBB"]
        plan = some._jdf.queryExecution().executedPlan().toString()
        assert "Filter Contains(key" in plan and "itemTypeID" not in next(x for x in plan.splitlines() if "Filter" in x)  # the rest is SQLite's
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_locked_database_is_copied_and_the_copy_goes(library, tmp_path, monkeypatch):
    monkeypatch.setattr(tempfile, "tempdir", str(tmp_path))
    with sqlite3.connect(library, isolation_level=None) as con:
        con.execute("BEGIN EXCLUSIVE")
        with sqlite.connected(library) as snapshot:
            assert snapshot.execute("SELECT count(*) FROM items").fetchone() == (4,) and len(os.listdir(tmp_path)) == 1
        con.execute("ROLLBACK")
    assert os.listdir(tmp_path) == []
