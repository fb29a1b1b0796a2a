import datetime as dt

import pytest
from pyspark.sql import functions as F

from annalist import api
from annalist.functions import describe as ds
from annalist.operators import maintenance as mt
from annalist.operators import mining as mi
from annalist.operators.catalog import Filters


def each(spark, values, column_of):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.r for r in rows.select("i", column_of(F.col("v")).alias("r")).orderBy("i").collect()]


def test_literals(spark):
    words = ["v1.18.2", "1.2.3", "6.8", "6.8MB", "4277bf0b", "1234567", "tags_with_counts", "demo.example", "2026", "plain", "x" * 41]
    assert each(spark, words, ds.literal_shape) == ["version", "version", None, "measurement", "sha", None, "identifier", "dotted", None, None, None]
    assert each(spark, ["see v1.2.3 at 6.8mb.", "tags_with_counts", "plain words"], ds.extract_literal) == ["6.8mb", "tags_with_counts", None]
    assert each(spark, ["It was 6.8MB big", "none"], lambda v: ds.spelling_in(v, F.lit("6.8mb"))) == ["6.8MB", None]


def test_described_queries(spark):
    raw = ["why does k=12 fail?", "limit=5&q=pool+resize&project=a%2Cb", "project=x", "", None, "q=only"]
    assert each(spark, raw, ds.summarize_query) == ["why does k=12 fail?", "pool resize — project: a,b · limit: 5", "project: x", "", "", "only"]
    rows = spark.createDataFrame([("/api/ask", " why "), ("/api/search", "q=x&project=a&limit=3"), ("/api/search", "project=a"), ("/api/ask/stream", " ")], "p string, q string")
    got = [r.u for r in rows.select(ds.parse_usage(F.col("p"), F.col("q")).alias("u")).collect()]
    assert [(g.text, [f.key for f in g.filters]) if g else None for g in got] == [("why", []), ("x", ["project"]), None, None]


def test_query_ids(spark):
    rows = spark.createDataFrame([("Why  THE pool", "project=b,a&kind=plan"), ("why the pool", "kind=plan&project=a,b"), ("why the pool", "kind=plan")], "t string, f string")
    ids = [r[0] for r in rows.select(ds.query_id(F.col("t"), ds.parameters(F.col("f")))).collect()]
    assert ids[0] == ids[1] != ids[2] and all(len(i) == 8 for i in ids)


def test_paths_and_markers(spark):
    mounts = [("/data", "/home/me"), ("/data/code", "/src")]
    assert each(spark, ["/data/code/a b.py", "/data/x", "/database/x", "/data"], lambda v: ds.host_path(v, mounts)) == ["/src/a b.py", "/home/me/x", "/database/x", "/home/me"]
    assert each(spark, ["/a b/c"], lambda v: ds.editor_url(v, F.lit(7))) == ["vscode://file/a%20b/c:7"]
    assert each(spark, ["line:12", "abc", None], ds.line_of) == [12, None, None]
    long = "word " * 60
    assert each(spark, ["a \n b", long, "x" * 200], ds.short_summary) == ["a b", ("word " * 23).strip() + "…", "x" * 119 + "…"]
    line = spark.range(1).select(ds.marker_line(F.lit("resolved"), F.lit(3), F.lit("a3f2c1"), F.lit("done"), F.lit("2026-07-01"), F.lit("seen"))).first()[0]
    assert line == "- [2026-07-01] RESOLVED [L3#a3f2c1]: done (evidence: seen)"


def test_replies(spark):
    known = F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))
    replies = ['```json {"status":"confirmed-open","confidence":7,"citations":[1,9]}```', "no json", '{"status":"maybe"}']
    got = each(spark, replies, lambda v: ds.judge_verdict(v, known))
    assert [(g.status, g.confidence, g.citations) for g in got] == [("confirmed-open", 1.0, [1]), ("inconclusive", 0.0, []), ("inconclusive", 0.0, [])]
    grades = each(spark, ['so: [{"n":1,"grade":3},{"n":1,"grade":0},{"n":2,"grade":9},{"n":3,"grade":0}]', "none"], ds.judge_grades)
    assert [[(x.n, x.grade) for x in g] for g in grades] == [[(1, 3), (3, 0)], []]


def test_ranges(spark):
    r = spark.range(1).select(ds.range_bounds(F.lit("2026-07-01").cast("date"), F.lit("2026-07-01").cast("date")).alias("r")).first().r
    assert (r.since, r.until, r.days) == (dt.datetime(2026, 7, 1), dt.datetime(2026, 7, 2), 1)


def entries(spark):
    rows = [(i, "p", f"f{i}", f"title {i}", "body " * (i * 200), "cur" if i % 2 else None) for i in range(1, 5)] + [(9, "p", "f9", "", "", None)]
    return spark.createDataFrame(rows, "id int, project string, source_path string, title string, body string, vectorized_in string")


def test_audit(spark):
    rows = entries(spark)
    points = mt.expected_points(rows)
    held = points.where("id <> 3 OR seq = 0").where("id <> 1")
    got = {r.id: (r.action, r.partial) for r in mt.audit(rows, held.select("point_id"), "cur").collect()}
    assert got == {1: ("clear", False), 2: ("adopt", False), 3: ("clear", True), 4: ("adopt", False), 9: ("adopt", False)}


def test_session_merge(spark):
    kind = "session_id string, cwd string, title string, first_prompt string, started_at timestamp, ended_at timestamp, prompt_count int, action_count int, files_touched array<string>, from_start boolean"
    a, b = dt.datetime(2026, 7, 1), dt.datetime(2026, 7, 2)
    held = spark.createDataFrame([("s", "/w", "Old", None, a, a, 2, 1, ["x"], False), ("t", None, None, None, a, a, 5, 5, None, False)], kind)
    new = spark.createDataFrame([("s", None, None, "hi", b, b, 3, 1, ["a"], False), ("t", None, "T", "hi", b, b, 1, 1, [], True), ("u", "/u", None, "first", b, b, 1, 0, [], True)], kind)
    got = {r.session_id: (r.title, r.started_at, r.ended_at, r.prompt_count, r.files_touched) for r in mt.merge_sessions(held, new).collect()}
    assert got == {"s": ("Old", a, b, 5, ["a", "x"]), "t": ("T", a, b, 1, []), "u": ("first", b, b, 1, [])}


def test_tail(spark):
    files = spark.createDataFrame([("a", b"one\ntwo\nto"), ("b", b"xy"), ("c", "é\nü\n".encode())], "path string, content binary")
    state = spark.createDataFrame([("a", 4), ("b", 99), ("c", 3)], "path string, byte_offset long")
    assert {r.path: (r.lines, r.byte_offset) for r in mt.tail_lines(files, state).collect()} == {"a": (["two"], 8), "b": ([], 0), "c": (["ü"], 6)}


def test_recorded_calls(spark):
    hit = "array<int>"
    rows = spark.createDataFrame(
        [(1, "c" * 60, None, "/api/search", "q", {"error": "e" * 600, "top_hits": list(range(9))}), (2, "c", "t", "/x", None, None)],
        f"id int, client string, tool string, path string, query string, reply struct<error:string,top_hits:{hit}>",
    )
    usage, reply = mt.recorded(rows)
    assert [(r.id, len(r.client), r.route_class) for r in usage.orderBy("id").collect()] == [(1, 40, "query"), (2, 1, "other")]
    assert [(r.call_id, len(r.error), r.top_hits) for r in reply.collect()] == [(1, 500, [0, 1, 2, 3, 4])]


def test_consolidation(spark):
    filters = "array<struct<key:string,value:string>>"
    rows = [(f"burst {i}", [], "usage", dt.datetime(2026, 7, 1)) for i in range(6)] + [("Why so slow?", [], "usage", dt.datetime(2026, 7, 2)), ("why  so slow?", [], "transcript", dt.datetime(2026, 7, 1))]
    queries, dropped = mi.consolidate(spark.createDataFrame(rows, f"text string, filters {filters}, source string, at timestamp"))
    (q,) = queries.collect()
    assert (q.source, q["class"]) == ("transcript", "intent") and [(d.template, d.n) for d in dropped.collect()] == [("burst #", 6)]


def test_strata_and_hash(spark):
    rows = spark.createDataFrame([("a", 0, i) for i in range(20)] + [("b", 3, 99)], "class string, grade int, item int")
    one, two = (sorted(tuple(r) for r in mi.stratified(rows, 0.25, 5).collect()) for _ in range(2))
    assert one == two and len(one) == 6 and ("b", 3, 99) in one
    labels = spark.createDataFrame([("q1", 2, 3), ("q1", 10, 1)], "query_id string, entry_id int, grade int")
    a, b = mi.judgement_hash(labels).first().hash, mi.judgement_hash(labels.orderBy(F.desc("entry_id"))).first().hash
    assert a == b and len(a) == 16


@pytest.fixture(scope="module")
def engine(spark):
    kinds = ["doc", "transcript", "changelog", "commit"]
    rows = [(i, "alpha" if i % 2 else "beta", kinds[i % 4], None, None, f"Pool note {i}", f"the worker pool resize procedure number{i} " + "filler " * i, "p", dt.datetime(2024, 1, 1 + i % 28), None, None, None) for i in range(1, 25)]
    table = spark.createDataFrame(rows, "id int, project string, source_type string, component string, session_id string, title string, body string, source_path string, occurred_at timestamp, kind string, doc_status string, vectorized_in string")
    projects = spark.createDataFrame([("alpha", None), ("beta", "alpha"), ("empty", None)], "slug string, alias_of string")
    usage = spark.createDataFrame([(1, dt.datetime(2024, 1, 30), "c", "search", "/api/search", "query", "pool", 200, 50)], "id int, called_at timestamp, client string, tool string, path string, route_class string, query string, status int, duration_ms int")
    reply = spark.createDataFrame([(1, 3, "m", 1, 2, 3, False)], "call_id int, result_count int, model string, prompt_tokens int, completion_tokens int, ttft_ms int, degraded boolean")
    return api.Engine(table, projects, usage, reply)


def test_engine_search(spark, engine):
    q = spark.createDataFrame([(1, "worker pool number7"), (2, "zzz nothing")], "query_id int, text string")
    hits = engine.search(q, limit=5).orderBy("rank").collect()
    assert hits[0].entry_id == 7 and {h.mode for h in hits} == {"sparse-only"} and {h.query_id for h in hits} == {1}
    assert {h.project for h in engine.search(q, Filters(projects=("beta",)), 5).collect()} == {"beta"}
    assert {h.entry_id for h in engine.search(q, mode="fts", limit=30).collect()} >= {7}


def test_engine_with_stored_indexes(spark, engine, tmp_path):
    from dataclasses import replace

    from annalist.operators.dense_index import DenseIndex
    from annalist.operators.index import SearchIndex

    stored = replace(engine, index=SearchIndex.build(engine.entries, f"file://{tmp_path}/index", buckets=2))
    q = spark.createDataFrame([(1, "worker pool number7", [7.0, 1.0]), (2, "zzz nothing", None)], "query_id int, text string, embedding array<double>")
    found = lambda e, *a, **k: sorted((r.query_id, r["rank"], r.entry_id, round(r.score, 9), r.mode) for r in e.search(q, *a, **k).collect())
    beta = Filters(projects=("beta",), source_types=("doc", "commit"), since="2024-01-03")
    for arguments in ((Filters(), 5, "sparse-only"), (beta, 5, "sparse-only"), (beta, 9, "fts")):
        assert found(stored, *arguments) == found(engine, *arguments) != []
    # the plan of keyword hits reads stored tables only, not the entries
    plan = stored._hits("sparse-only", q, None, beta, 30, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan.lower()
    vectors = engine.entries.select(F.col("id").cast("long").alias("entry_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    near = replace(stored, dense_index=DenseIndex.build(vectors, f"file://{tmp_path}/dense"))
    one = q.where("query_id = 1")
    got, want = (sorted((r["rank"], r.entry_id, r.mode) for r in e.search(one, limit=5).collect()) for e in (near, replace(stored, vectors=vectors)))
    assert got == want and got[0][1:] == (7, "hybrid")
    assert {r.mode for r in near.search(one, beta, 5).collect()} == {"sparse-only"}


def test_engine_context_and_ask(spark, engine):
    q = spark.createDataFrame([(1, "worker pool number8")], "query_id int, text string")
    got = engine.context(q, Filters(projects=("empty",)), 4).collect()
    assert len(got) == 4 and all(r.widened for r in got)
    said = engine.ask("What happened to the worker pool on 2024-01-08?", k=3, answer=lambda p: "see [1]")
    assert said["answer"] == "see [1]" and len(said["sources"]) == 3 and said["coverage"]["exact"] == 1 and "[1] " in said["prompt"]
    assert engine.ask("qqqq")["sources"] == []


def test_engine_lists(engine):
    assert [r.slug for r in engine.list_projects().collect()] == ["alpha", "beta", "empty"]
    assert engine.timeline(5).count() == 5 and engine.usage_report()["totals"].first().calls == 1
    assert engine.usage_insights()["search"].first().calls == 1 and engine.usage_calls()["page"].first().has_reply
    with pytest.raises(ValueError):
        engine.project_components("nope")
    assert api.listed('["a","b"]') == api.listed("a, b") == ("a", "b") and api.listed("") == ()


def test_token_counts_keep_literals(spark, tmp_path):
    from annalist.functions import text as tx
    from annalist.plans.queries import QUERIES

    spark.createDataFrame([(1, "took 768ms in core.query.ts"), (2, "plain words, 768ms")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.token: (r.n, r["items"]) for r in QUERIES["c1_tokens"](spark, str(tmp_path)).collect()}
    texts = spark.read.parquet(f"{tmp_path}/benchmark.parquet").select("item_id", tx.tokenize("text").alias("tokens")).collect()
    every = [(t, r.item_id) for r in texts for t in r.tokens]
    assert got == {t: (sum(x == t for x, _ in every), len({i for x, i in every if x == t})) for t, _ in every}
    assert "768ms" in got and any("." in t for t in got)
