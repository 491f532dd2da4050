"""Every query with SQL gives the SQL's rows; the entry runs."""

import hashlib

import duckdb
import pytest

import __spark_entry__ as entry
from sparkloom import catalog, operators

SF = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(None if x != x else x for x in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents",):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = db.execute(catalog.oracle_sql()[name]).df()
    got = catalog.queries()[name](spark, SF).toPandas()
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_null_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b a")], "doc_id long, text string")
    assert [tuple(r) for r in operators.bm25(docs, ["a"], 5).select("doc_id").collect()] == [(3,)]
    assert operators.bm25(docs.limit(0), ["a"], 5).count() == 0
    assert operators.manifest(docs, "doc_id", "text").filter("size = 0").count() == 2
    assert operators.equal_content(docs, "doc_id", "text").count() == 1


def test_each_line_has_a_digest(spark):
    docs = spark.createDataFrame([(1, "a\nb\n"), (2, "a\nc\n"), (3, ""), (4, None)], "doc_id long, text string")
    got = {(r.doc_id, r.line): r.sha256 for r in operators.each_line_digest(docs).collect()}
    lines = {(1, 1): "a", (1, 2): "b", (1, 3): "", (2, 1): "a", (2, 2): "c", (2, 3): "", (3, 1): ""}
    assert got == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in lines.items()}
