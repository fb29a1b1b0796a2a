import datetime as dt

import pytest
from pyspark.sql import functions as F

from annalist.functions import text as tx


def one(spark, column_of, value):
    return spark.createDataFrame([(value,)], "v string").select(column_of(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("6.8MB", ["6.8mb", "6.8", "mb"]),
        ("6.8 MB", ["6.8", "6.8mb", "mb"]),
        ("v1.18.2 127.0.0.1", ["v1.18.2", "127.0.0.1"]),
        ("demo.example/api/tags", ["demo.example", "demo", "example", "api", "tags"]),
        ("3 s3 buckets", ["s3", "buckets"]),
        ("The end... of it.", ["end"]),
        ("10 ms ms", ["10", "10ms", "ms", "ms"]),
        ("", []),
        (None, []),
    ],
)
def test_tokenize(spark, text, tokens):
    assert one(spark, tx.tokenize, text) == tokens


def test_spaced_and_unspaced_measures_give_the_same_tokens(spark):
    assert sorted(one(spark, tx.tokenize, "500ms")) == sorted(one(spark, tx.tokenize, "500 ms"))


def test_fnv1a(spark):
    assert one(spark, tx.fnv1a, "video") == 0xCEF90B6C
    assert one(spark, tx.fnv1a, "") == 2166136261


def test_literal_tokens(spark):
    rows = spark.createDataFrame([(t,) for t in ("6.8mb", "a_b", "x.io", "621", "62", "word")], "t string")
    assert [r[0] for r in rows.select(tx.is_literal_token(F.col("t"))).collect()] == [True, True, True, True, False, False]


def test_chunks(spark):
    assert one(spark, tx.chunk, "short") == ["short"]
    assert one(spark, tx.chunk, "  \n ") == []
    paragraphs = "\n\n".join(c * 500 for c in "abcdefghij")
    pieces = one(spark, tx.chunk, paragraphs)
    assert len(pieces) > 2 and all(len(p) <= 1800 + 200 + 2 for p in pieces)
    assert pieces[1].startswith(pieces[0][-200:])
    assert len(one(spark, tx.chunk, "x" * 5000)) == 3


def test_ids(spark):
    uuid = one(spark, lambda v: tx.deterministic_uuid(tx.NAMESPACE, v, F.lit("b")), "a")
    assert uuid[14] == "5" and uuid[19] in "89ab" and len(uuid) == 36
    assert uuid != one(spark, lambda v: tx.deterministic_uuid(tx.NAMESPACE, F.lit("ab"), F.lit("")), "a")
    null, empty = (one(spark, lambda v: tx.deterministic_uuid(tx.NAMESPACE, v), x) for x in (None, ""))
    assert null == empty


@pytest.mark.parametrize(
    ("path", "archived"),
    [("docs/_legacy/a.md", True), ("docs/auth.deprecated.md", True), ("docs/goldilocks.md", False), ("old/x.md", True), ("scaffold/a.md", False)],
)
def test_archived(spark, path, archived):
    assert one(spark, tx.is_archived_path, path) is archived


@pytest.mark.parametrize(
    ("path", "name"),
    [
        ("/api/search?q=x", "query"),
        ("/api/projects/search/timeline", "read"),
        ("/api/projects/admin/timeline", "read"),
        ("/api/admin/usage", "admin"),
        ("/api/projects/x/backlog/verdict", "write"),
        ("/api/health/", "status"),
        ("/nope", "other"),
        ("", "other"),
        (None, "other"),
    ],
)
def test_routes(spark, path, name):
    assert one(spark, tx.route_class, path) == name


@pytest.mark.parametrize(
    ("text", "since", "until"),
    [
        ("what happened on 2026-07-21?", (2026, 7, 21), (2026, 7, 21)),
        ("between 21 July 2026 and Jul 23rd, 2026", (2026, 7, 21), (2026, 7, 23)),
        ("in July 2026", (2026, 7, 1), (2026, 7, 31)),
        ("in February 2024", (2024, 2, 1), (2024, 2, 29)),
        ("on 2026-02-30", None, None),
        ("version 1.2026-07-211", None, None),
        ("nothing", None, None),
    ],
)
def test_date_window(spark, text, since, until):
    got = one(spark, tx.date_window, text)
    if since is None:
        assert got is None
    else:
        assert got["since"] == dt.datetime(*since)
        assert got["until"] == dt.datetime(*until, 23, 59, 59, 999000)


def test_containment(spark):
    row = spark.createDataFrame([("persisted settings", "persist the settings now")], "a string, b string")
    assert row.select(tx.token_containment(F.col("a"), F.col("b"))).first()[0] == 1.0
    assert row.select(tx.token_containment(F.lit(""), F.col("b"))).first()[0] == 0.0


def test_ages(spark):
    now = F.lit("2024-01-31").cast("timestamp")
    rows = spark.createDataFrame([("2024-01-31",), (None,), ("2025-01-01",)], "t string").select(tx.recency_factor(F.col("t").cast("timestamp"), now).alias("f"))
    assert [round(r["f"], 6) for r in rows.collect()] == [1.12, 1.0, 1.12]
