"""Scores of variants, searches that fall back, catalog pages, mined tool calls."""

import math
from dataclasses import replace

import numpy as np

from annalist.operators import catalog as cat
from annalist.operators import evaluation as ev
from annalist.operators import mining as mi
from tests.test_more import engine  # noqa: F401

_RANKED = "query_id int, item int, rank int"


def _scores(spark, unjudged_as):
    queries = spark.createDataFrame([(1, "A", "x"), (2, "A", "x"), (3, "B", "y"), (4, "N", "y"), (5, "L", "y")], "query_id int, pool string, class string")
    context = spark.createDataFrame([(1, 10, 0), (1, 11, 1), (1, 12, 2), (2, 10, 0), (3, 30, 0), (3, 31, 1), (4, 1, 0)], _RANKED)
    found = spark.createDataFrame([(1, 10, 0), (1, 11, 1), (1, 12, 2), (1, 13, 3), (3, 30, 0), (3, 31, 1)], _RANKED)
    grades = spark.createDataFrame([(1, 10, 3), (1, 12, 0), (1, 14, 2)], "query_id int, item int, grade int")
    unjudged = spark.createDataFrame([(1, 11), (1, 10)], "query_id int, item int")
    gold = spark.createDataFrame([(3, 31)], "query_id int, item int")
    rows = ev.score_queries(queries, context, found, grades, unjudged, gold, k=1, cutoff=30, unjudged_as=unjudged_as)
    return {r.query_id: r for r in rows.collect()}


def test_score_queries_bounds(spark):
    low, high = _scores(spark, 0), _scores(spark, 3)
    assert set(low) == {1, 2, 3, 4, 5}
    ideal = 3 + 2 / math.log2(3)
    assert math.isclose(low[1].ndcg, 3 / ideal, abs_tol=1e-8)
    assert math.isclose(high[1].ndcg, (3 + 3 / math.log2(3)) / (3 + 3 / math.log2(3) + 2 / 2), abs_tol=1e-8)
    assert low[1].precision == 1.0 and low[1].recall == 0.5 and math.isclose(high[1].recall, 2 / 3, abs_tol=1e-8)
    assert low[1].unjudged == 2 and low[1].mrr is None  # item 11 in both lists; a grade settles item 10
    assert low[2].ndcg is None and low[2].precision is None and low[2].recall is None  # nobody has judged it
    assert (low[3].mrr, low[3].hit, low[3].ndcg) == (0.5, 0.0, None)
    assert low[4].hit is None and low[4].mrr is None
    assert (low[5].mrr, low[5].hit) == (0.0, 0.0)  # no gold item


_SCORED = "query_id int, pool string, class string, ndcg double, precision double, recall double, mrr double, hit double"


def test_compare_and_flips(spark):
    base = [(i, "A", "x" if i < 9 else "y", 0.1 * (i % 5), None, 0.5, 0.3, 1.0) for i in range(12)]
    better = [(i, p, c, n + (0.05 if i else 0.0), None, 0.5, 0.9, 1.0) for i, p, c, n, *_ in base]
    worse = [(i, p, c, n - 0.05, None, 0.5, 0.9, 1.0) for i, p, c, n, *_ in base]
    tables = [spark.createDataFrame(rows, _SCORED) for rows in (base, better, worse)]
    up, down = ev.compare(tables[0], tables[1], resamples=500), ev.compare(tables[0], tables[2], resamples=500)
    rows = {(r.pool, r["class"], r.metric): r for r in up.collect()}
    assert set(rows) == {("A", c, m) for c in ("x", "y", "all") for m in ("ndcg", "recall")}  # no pair of precision; mrr isn't of this pool
    every = rows["A", "all", "ndcg"]
    assert (every.n, every.wins, every.losses, every.ties, every.indicative) == (12, 11, 0, 1, False)
    assert math.isclose(every.mean_delta, 0.05 * 11 / 12, abs_tol=1e-9) and not every.straddles_zero and every.low <= every.mean_delta <= every.high
    assert rows["A", "y", "ndcg"].indicative and not rows["A", "x", "ndcg"].indicative and rows["A", "x", "recall"].straddles_zero
    assert ev.flipped(up, up).count() == 0
    assert {(r["class"], r.metric) for r in ev.flipped(up, down).collect()} == {(c, "ndcg") for c in ("x", "y", "all")}


def test_search_falls_back(spark, engine):  # noqa: F811
    asked = spark.createDataFrame([(1, "worker pool number7", [1.0, 0.0])], "query_id int, text string, embedding array<double>")
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 25)], "entry_id int, embedding array<double>")
    whole = replace(engine, vectors=vectors).search(asked, limit=5).collect()
    assert {(h.mode, h.degraded, h.reason) for h in whole} == {("hybrid", False, None)}
    bare = engine.search(asked, limit=5).collect()
    assert {(h.mode, h.degraded, h.reason) for h in bare} == {("sparse-only", True, "no vectors")}
    broken = replace(engine, vectors=vectors.withColumnRenamed("entry_id", "other")).search(asked, limit=5).collect()
    assert {(h.mode, h.degraded) for h in broken} == {("sparse-only", True)} and broken[0].reason.startswith("hybrid failed")
    assert {(h.mode, h.degraded) for h in engine.search(asked, limit=5, mode="sparse-only").collect()} == {("sparse-only", False)}


def test_pages_follow_each_other(spark):
    rows = spark.createDataFrame([(i, "now" if i % 3 else None) for i in range(1, 31)], "id int, vectorized_in string")
    seen, at = [], 0
    while page := [r.id for r in cat.page_after(rows, at, 7, "now", covered=True).collect()]:
        seen, at = seen + page, page[-1]
    assert seen == [i for i in range(1, 31) if i % 3]
    assert [r.id for r in cat.page_after(rows, 28, 7).collect()] == [29, 30] and [r.id for r in cat.newest(rows, 2).collect()] == [30, 29]


def test_first_of_batch(spark):
    batch = spark.createDataFrame([("k", "late", 2), ("k", "z first", 1), ("held", "x", 1)], "dedup_key string, body string, seq int")
    held = spark.createDataFrame([("held",)], "dedup_key string")
    assert [tuple(r) for r in cat.new_entries(batch, held, order="seq").collect()] == [("k", "z first", 1)]


def test_tool_queries_skip_what_is_no_call(spark):
    call = '{"type":"tool_use","name":"rec_ask","input":{"question":"%s","since":"2024-01-01"}}'
    lines = [f'{{"content":[{call % "why"}]}}', f'{{"message":{{"content":"{"rec_ask"}"}}}}', "rec_ask torn", "", f'{{"content":[{call % " "}]}}', '{"content":[{"type":"text","name":"rec_ask"}]}']
    rows = mi.tool_queries(spark.createDataFrame([("f", x) for x in lines], "ref string, line string"), ("rec_ask",)).collect()
    assert [(r.text, r.since, r.project, r["at"]) for r in rows] == [("why", "2024-01-01", None, None)]


def test_bootstrap_is_seeded(spark):
    deltas = spark.createDataFrame([("g", i, float(np.sin(i))) for i in range(20)], "group string, query_id int, delta double")
    a, b = (ev.bootstrap(deltas, 300, seed=4).first() for _ in range(2))
    assert a == b and a.low <= a.high and a.n == 20
