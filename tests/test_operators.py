import datetime as dt
import math
import random

import numpy as np
import pytest

from annalist.operators import adoption as ad
from annalist.operators import backlog as bl
from annalist.operators import catalog as cat
from annalist.operators import evaluation as ev
from annalist.operators import retrieval as rt
from annalist.streaming import ingest

MARKER = "struct<kind:string,target_line:int,target_hash:string,legacy:boolean>"


def lines(spark, rows):
    data = [("p", "f", n, body, comp, h, dt.datetime(2026, 7, day), m) for n, body, comp, h, day, m in rows]
    return spark.createDataFrame(data, f"project string, path string, line int, body string, component string, line_hash string, at timestamp, marker {MARKER}")


def ref(kind, line, tag=None):
    return (kind, line, tag, False)


def old(kind="resolved"):
    return (kind, None, None, True)


def verdicts(spark, rows=()):
    return spark.createDataFrame([("p", "f", n, s, t) for n, s, t in rows], "project string, path string, line int, status string, reviewed_at timestamp")


def view(spark, rows, reviews=()):
    got = bl.backlog_view(lines(spark, rows), verdicts(spark, reviews), "2026-07-20").collect()
    return {r.line: (r.status, r.origin, r.lints) for r in got}


def test_backlog_references(spark):
    rows = [
        (1, "persist settings", None, "aaaaaa", 1, None), (2, "cache pages", None, "bbbbbb", 1, None), (3, "moved item", None, "cccccc", 1, None),
        (4, "RESOLVED [L1#aaaaaa]: persist settings", None, "m1", 2, ref("resolved", 1, "aaaaaa")),
        (5, "DROPPED [L9#cccccc]: moved item", None, "m2", 2, ref("dropped", 9, "cccccc")),
        (6, "RESOLVED [L2]: entirely different words", None, "m3", 2, ref("resolved", 2)),
        (7, "REOPENED [L1#aaaaaa]: again", None, "m4", 3, ref("reopened", 1, "aaaaaa")),
        (8, "RESOLVED [L77]: nothing", None, "m5", 3, ref("resolved", 77)),
    ]
    got = view(spark, rows)
    assert got[1] == ("open", "structured", ["superseded-marker"])
    assert got[2] == ("resolved", "structured", ["ref-mismatch"])
    assert got[3] == ("dropped", "structured", ["relocated"])
    assert {r.marker_line: r.how for r in bl.link_markers(lines(spark, rows)).collect()} == {4: "ref", 5: "relocated", 6: "ref", 7: "ref", 8: "broken-link"}


def test_backlog_words(spark):
    rows = [
        (1, "persist user settings across restarts", "api", "a", 1, None), (2, "persist user settings", "ui", "b", 1, None), (3, "unrelated thing entirely", None, "c", 1, None),
        (4, "DONE: persisted user settings", "ui", "d", 2, old()), (5, "DONE: rewrote the scheduler", None, "e", 2, old()), (6, "later: persist user settings", None, "f", 3, None),
    ]
    how = {r.marker_line: (r.how, r.line) for r in bl.link_markers(lines(spark, rows)).collect()}
    assert how == {4: ("fuzzy", 2), 5: ("unlinked", None)}
    tie = [(1, "persist user settings", None, "a", 1, None), (2, "persist user settings", None, "b", 1, None), (3, "DONE: persist user settings", None, "c", 2, old())]
    assert {r.marker_line: r.how for r in bl.link_markers(lines(spark, tie)).collect()} == {3: "ambiguous"}


def test_backlog_reviews(spark):
    rows = [(1, "a thing", None, "a", 1, None), (2, "b thing", None, "b", 1, None), (3, "RESOLVED [L2]: b thing", None, "c", 5, ref("resolved", 2)), (4, "c thing", None, "d", 1, None)]
    reviews = [(1, "confirmed-resolved", dt.datetime(2026, 7, 21)), (1, "confirmed-open", dt.datetime(2026, 7, 2)), (2, "confirmed-open", dt.datetime(2026, 7, 5, 23)), (4, "inconclusive", dt.datetime(2026, 7, 21))]
    got = view(spark, rows, reviews)
    assert got[1] == ("resolved", "review", ["not-written-back"])
    assert got[2] == ("resolved", "structured", ["stale-review"])
    assert got[4] == ("open", "default", ["inconclusive"])
    assert bl.counts(bl.backlog_view(lines(spark, rows), verdicts(spark, reviews), "2026-07-20")).first()[2:] == (1, 2, 0)


def test_adoption(spark):
    rules = [ad.Rule("guess", "search", r"(?i)\bprobably because\b", after_lookup=True), ad.Rule("claim", "review", r"(?i)\bI decided against\b")]
    tools = {"search": "^history__", "review": "^review__"}

    def session(name, *turns):
        return [(name, "proj", i, role, text, tool, given, dt.datetime(2026, 7, 1)) for i, (role, text, tool, given) in enumerate(turns)]

    say = lambda t: ("assistant", t, None, None)
    call = lambda t, given="{}": ("assistant", None, t, given)
    pad = [say("x")] * 5
    rows = session("s1", say("probably because"), call("Bash", "git log -3"), say("It was probably because of X"), *pad)
    rows += session("s2", call("Bash", "git log -3"), say("probably because"), call("history__find"), *pad)
    rows += session("s3", say("probably because"), ("user", "I decided against it", None, None), *pad)
    rows += session("s4", say("I decided against it"), *pad)
    rows += session("s5", say("I decided against it"))
    turns = spark.createDataFrame(rows, "session_id string, project string, pos int, role string, text string, tool string, tool_input string, at timestamp")
    per = ad.narrowed(ad.sessions(turns, rules, tools))
    assert {r.session_id: [(m.rule, m.pos) for m in r.met] for r in per.collect()} == {"s1": [("guess", 2)], "s2": [("guess", 1)], "s3": [], "s4": [("claim", 0)]}
    got = {r.tool: (r.used, r.missed, r.fire_rate) for r in ad.report(per, list(tools)).collect()}
    assert got == {"search": (1, 1, 0.5), "review": (0, 1, 0.0)}
    assert {r.rule: r.sessions for r in ad.missed_rules(per, list(tools)).collect()} == {"guess": 1, "claim": 1}
    none = ad.report(ad.narrowed(per, project="nowhere"), list(tools))
    both = {r.tool: (r.delta, r.significant) for r in ad.compare(ad.report(per, list(tools)), none).collect()}
    assert both == {"search": (None, False), "review": (None, False)}


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "c", 2), (2, "x", 0), (3, "n", 0)], "query_id int, item string, rank int")
    grades = spark.createDataFrame([(1, "a", 3), (1, "b", 3), (1, "z", 2), (2, "x", 0), (4, "q", 1)], "query_id int, item string, grade int")
    got = {r.query_id: r.ndcg for r in ev.ndcg(ranked, grades, 10).collect()}
    ideal = 3 + 3 / math.log2(3) + 2 / math.log2(4)
    assert got[1] == pytest.approx((3 + 3 / math.log2(3)) / ideal) and got[2] is None and got[3] is None and got[4] == 0
    rp = {r.query_id: (r.recall, r.precision) for r in ev.recall_precision(ranked, grades, 12).collect()}
    assert rp[1] == (pytest.approx(2 / 3), pytest.approx(2 / 3)) and rp[2] == (None, 0.0) and rp[4] == (None, 0.0)
    gold = spark.createDataFrame([(1, "b"), (2, "none")], "query_id int, item string")
    assert {r.query_id: (r.rr, r.hit) for r in ev.reciprocal_rank(ranked, gold, 1).collect()} == {1: (0.5, 0), 2: (0.0, 0)}


def test_comparisons(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.5), (4, None)], "query_id int, value double")
    b = spark.createDataFrame([(1, 0.7), (2, 0.3), (3, 0.5), (4, 0.1)], "query_id int, value double")
    assert ev.paired(a, b).first()[:3] == (1, 1, 1)
    deltas = spark.createDataFrame([("g", i, 0.1 * (i % 3)) for i in range(20)] + [("one", 1, 0.5)], "group string, query_id int, delta double")
    x, y = (ev.bootstrap(deltas, 500, 7).orderBy("group").collect() for _ in range(2))
    assert x == y and x[0].low <= 0.095 <= x[0].high and not x[0].straddles_zero and x[1].low is None


def test_mulberry32_counts_up_like_the_sequential_generator():
    def step(state):
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((state ^ (state >> 15)) * (state | 1)) & 0xFFFFFFFF
        t = (t ^ (t + (((t ^ (t >> 7)) * (t | 61)) & 0xFFFFFFFF))) & 0xFFFFFFFF
        return state, ((t ^ (t >> 14)) & 0xFFFFFFFF) / 4294967296

    state, want = 42, []
    for _ in range(50):
        state, value = step(state)
        want.append(value)
    assert ev.mulberry32(42, 50).tolist() == want


def test_kappa(spark):
    def kappa(pairs):
        return tuple(ev.weighted_kappa(spark.createDataFrame(pairs, "a int, b int")).first())

    assert kappa([(0, 0), (1, 1), (3, 3)]) == (3, 1.0) and kappa([(2, 2), (2, 2)]) == (2, 1.0) and kappa([]) == (0, 0.0)
    rng = random.Random(1)
    pairs = [(rng.randrange(4), rng.randrange(4)) for _ in range(60)]
    n = len(pairs)
    w = lambda i, j: ((i - j) / 3) ** 2
    observed = sum(w(*p) for p in pairs) / n
    expected = sum(w(i, j) * sum(a == i for a, _ in pairs) * sum(b == j for _, b in pairs) for i in range(4) for j in range(4)) / n / n
    assert kappa(pairs)[1] == pytest.approx(1 - observed / expected, abs=1e-8)


def test_percentiles_and_summary(spark):
    values = spark.createDataFrame([("g", float(i)) for i in range(10)] + [("g", None), ("h", 1.0)], "group string, value double")
    assert {r.group: (r.p50, r.p90) for r in ev.floor_percentiles(values, (0.5, 0.9)).collect()} == {"g": (5.0, 9.0), "h": (1.0, 1.0)}
    scores = spark.createDataFrame([("A", "x", 1.0), ("A", "y", None), ("A", "y", 0.0)], "pool string, class string, value double")
    assert {(r["pool"], r["class"]): (r.n, r["mean"]) for r in ev.summarise(scores).collect()} == {("A", "x"): (1, 1.0), ("A", "y"): (1, 0.0), ("A", "all"): (2, 0.5)}
    graded = spark.createDataFrame([(1, "a", "other", 1), (1, "a", "human", 3), (1, "b", "primary", 2), (1, "b", "x", 0)], "query_id int, item string, judge string, grade int")
    assert {r.item: r.grade for r in ev.precedence(graded).collect()} == {"a": 3, "b": 2}
    assert ev.resolution_floor(0.802) == pytest.approx(0.099)


def hits(spark, rows):
    data = [(1, e, float(s), i, src, "p", title, at) for i, (e, s, src, title, at) in enumerate(rows)]
    frame = spark.createDataFrame(data, "query_id int, entry_id int, score double, rank int, source_type string, project string, title string, occurred_at timestamp")
    return frame


def order(spark, rows, k, **more):
    return [r.entry_id for r in rt.rerank(hits(spark, rows), "2026-07-31", k, **more).orderBy("place").collect()]


def test_rerank(spark):
    talk = [(i, 0.99 - i / 100, "transcript", f"t{i}", None) for i in range(4)]
    assert order(spark, [*talk[:3], (9, 0.60, "doc", "d", None)], 4)[0] == 9
    got = order(spark, [*talk, (8, 0.3, "doc", "d", None), (9, 0.3, "component", "c", None)], 4)
    assert {8, 9} <= set(got) and sum(e < 4 for e in got) == 2
    assert sorted(order(spark, talk[:3], 3)) == [0, 1, 2]
    assert len(order(spark, [(i, 0.5, "doc", f"d{i}", None) for i in range(20)], 8)) == 8
    same = dt.datetime(2026, 7, 15)
    assert order(spark, [(1, 0.5, "session", "same", same), (2, 0.9, "session", "same", same)], 4) == [2]
    assert len([e for e in order(spark, [*talk, (9, 0.1, "doc", "d", None)], 4, floor=3) if e < 4]) == 3


def test_rerank_against_the_greedy_rule(spark):
    rng = random.Random(5)
    for _ in range(6):
        rows = [(i, round(rng.random(), 4), rng.choice(["transcript", "commit"]), f"t{i}", None) for i in range(rng.randrange(1, 25))]
        k = rng.randrange(1, 12)
        scored = sorted(rows, key=lambda r: -(r[1] * (0.8 if r[2] == "transcript" else 1.0)))
        picked, spare, n = [], [], 0
        for r in scored:
            if len(picked) >= k:
                break
            if r[2] == "transcript":
                if n >= max(1, k // 2):
                    spare.append(r[0])
                    continue
                n += 1
            picked.append(r[0])
        assert order(spark, rows, k) == (picked + spare)[:k]


def test_fusion_and_staleness(spark):
    a = spark.createDataFrame([(1, 10, 0, 0), (1, 11, 0, 1)], "query_id int, entry_id int, seq int, rank int")
    b = spark.createDataFrame([(1, 11, 0, 0)], "query_id int, entry_id int, seq int, rank int")
    assert [(r.entry_id, r.score) for r in rt.fuse([a, b], 5).orderBy("rank").collect()] == [(11, pytest.approx(1 / 2 + 1 / 3)), (10, 0.5)]
    rows = hits(spark, [(1, 0.5, "doc", "a", dt.datetime(2026, 7, 1)), (2, 0.5, "doc", "b", dt.datetime(2020, 1, 1)), (3, 0.4, "session", "c", dt.datetime(2020, 1, 1))])
    rows = rows.selectExpr("*", "CASE WHEN entry_id = 1 THEN 'archived' END AS doc_status")
    got = {r.entry_id: (r.rank, r.status, round(r.score, 6)) for r in rt.finalise(rows, "2026-07-31", 10).collect()}
    assert got == {2: (0, "aging", 0.5), 3: (1, None, 0.4), 1: (2, "archived", 0.3)}
    found = hits(spark, [(1, 0.5, "transcript", "a", None)])
    extra = hits(spark, [(7, 0.4, "doc", "d", None), (1, 0.4, "transcript", "a", None)])
    assert [r.entry_id for r in rt.top_up(found, extra, 4).orderBy("rank").collect()] == [1, 7]


def test_filters_and_merge(spark):
    rows = spark.createDataFrame([(1, "p", "doc", "archived"), (2, "p", "doc", None), (3, "q", "commit", None)], "id int, project string, source_type string, doc_status string")
    assert [r.id for r in rows.where(cat.Filters(projects=("p",), doc_status="active").column()).collect()] == [2]
    assert [r.id for r in rows.where(cat.Filters(doc_status="archived").column()).collect()] == [1] and rows.where(cat.Filters().column()).count() == 3
    held, new = (spark.createDataFrame(x, "id int, title string, cwd string") for x in ([(1, "a", "/w"), (2, "b", None)], [(1, None, "/z"), (2, "c", "/y"), (3, "d", "/x")]))
    assert sorted(tuple(r) for r in cat.merge_rows(held, new, ["id"], ["cwd"]).collect()) == [(1, "a", "/w"), (2, "c", None), (3, "d", "/x")]


def test_stream_ingest_is_idempotent(spark, tmp_path):
    from annalist.sources.readers import changelog

    inbox, table, check = tmp_path / "in", f"file://{tmp_path}/entries", f"file://{tmp_path}/check"
    inbox.mkdir()
    line = "- [DONE] - [2026-07-0{0}] - [Fix] - [api] - [Thing {0}]\n"
    (inbox / "a.log").write_text(line.format(1) + line.format(2))

    def run(checkpoint=check):
        ingest.ingest_stream(spark, f"file://{inbox}", "p", changelog, table, checkpoint).awaitTermination()
        return spark.read.parquet(table).count()

    assert run() == 2 and run() == 2
    (inbox / "b.log").write_text(line.format(3))
    assert run() == 3
    assert run(f"file://{tmp_path}/lost-checkpoint") == 3


def test_dense_search_in_slices(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 8))
    x[30:50] = x[30]  # equals are ordered by id
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows[::-1], "entry_id long, embedding array<double>").repartition(3)
    queries = spark.createDataFrame(rows, "query_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = np.round(unit @ unit.T, 9)
    expected = {(q, e, r) for q in range(60) for r, e in enumerate(sorted((e for e in range(60) if e != q), key=lambda e: (-score[q, e], e))[:4])}
    monkeypatch.setattr(rt, "FEW_QUERIES", 25)
    assert {(h.query_id, h.entry_id, h["rank"]) for h in rt.dense_search(queries, vectors, 4, exclude_self=True).collect()} == expected
