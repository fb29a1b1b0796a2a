"""Predicates on and edits of JSON meta."""

import json

import pytest
from pyspark.sql import functions as F

from annalist.operators import meta as mm
from annalist.operators.catalog import Filters

TEXTS = ['{"kind":"plan","n":1.0,"docStatus":"archived"}', '{"n":1,"kind":"plan"}', '{"docStatus":null,"a":{"b":"x","c.d":[1,2]}}', "[1]", "not json", None, "{}"]


@pytest.fixture
def entries(spark):
    rows = [(k, "p", f"f{k % 2}", "doc" if k != 1 else "commit", t) for k, t in enumerate(TEXTS)]
    return mm.with_variant(spark.createDataFrame(rows, "id long, project string, source_path string, source_type string, meta string"))


def ids(df, column):
    return [r.id for r in df.where(column).select("id").orderBy("id").collect()]


def texts(df):
    return {r.id: None if r.t is None else json.loads(r.t) for r in df.select("id", F.to_json("meta").alias("t")).collect()}


def test_predicates(entries):
    m = F.col("meta")
    assert ids(entries, mm.equals(m, ("kind",), "plan")) == [0, 1]
    assert ids(entries, mm.equals(m, ("n",), "1")) == [0, 1]
    assert ids(entries, mm.equals(m, ("a", "b"), "x")) == [2]
    assert ids(entries, mm.equals(m, ("a", "c.d"), "[1,2]")) == [2]
    assert ids(entries, mm.differs(m, ("docStatus",), "archived")) == [1, 2, 3, 4, 5, 6]
    assert ids(entries, mm.has_key(m, "docStatus")) == [0, 2]
    assert ids(entries, Filters(meta=((("kind",), "plan"), (("docStatus",), "archived"))).column()) == [0]
    with pytest.raises(ValueError):
        mm.value(m, "a'\"b")


def test_edits(spark, entries):
    patch = F.parse_json(F.lit('{"docStatus":"new","a":1}'))
    got = texts(entries.withColumn("meta", mm.merged(F.col("meta"), patch)))
    assert got[0] == {"kind": "plan", "n": 1, "docStatus": "new", "a": 1} and got[2] == {"docStatus": "new", "a": 1}
    assert got[3] == got[4] == got[5] == got[6] == {"docStatus": "new", "a": 1}
    got = texts(entries.withColumn("meta", mm.without(F.col("meta"), "docStatus", "n")))
    assert got[0] == got[1] == {"kind": "plan"} and got[2] == {"a": {"b": "x", "c.d": [1, 2]}} and got[5] == {}


def test_doc_status(spark, entries):
    files = spark.createDataFrame([("p", "f0", True), ("p", "f0", False), ("p", "none", True)], "project string, source_path string, archived boolean")
    got = mm.sync_doc_status(entries, files)
    assert ids(got, "changed") == [2, 4, 6] and texts(got)[4] == {"docStatus": "archived"} and texts(got)[1] == {"n": 1, "kind": "plan"}
    back = mm.sync_doc_status(got.drop("changed"), files.limit(0).union(spark.createDataFrame([("p", "f0", False)], files.schema)))
    assert ids(back, "changed") == [0, 2, 4, 6] and not ids(back, mm.has_key(F.col("meta"), "docStatus"))
    assert got.count() == back.count() == len(TEXTS) and not ids(mm.sync_doc_status(entries, files.limit(0)), "changed")


def test_resync(spark, entries):
    fresh = mm.with_variant(spark.createDataFrame([(0, '{"docStatus":"archived","n":1,"kind":"plan"}'), (1, '{"kind":"other"}'), (1, '{"kind":"other"}'), (5, None), (99, "{}"), (None, "{}")], "id long, meta string"))
    got = mm.sync_meta(entries, fresh, ("id",))
    assert ids(got, "changed") == [1] and texts(got)[1] == {"kind": "other"} and texts(got)[5] is None and got.count() == len(TEXTS)


def test_paths_reach_the_scan(spark, entries, tmp_path):
    entries.write.parquet(str(tmp_path / "e"))
    plan = spark.read.parquet(str(tmp_path / "e")).where(mm.equals(F.col("meta"), ("kind",), "plan")).select("id")
    assert plan.count() == 2
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(meta.`0`,plan)" in text and "meta:struct<0:string>" in text
