import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from annalist.sources import readers as rd


def files(spark, text, path="dir/part.log"):
    return spark.createDataFrame([("p", path, text)], "project string, source_path string, text string")


def test_stamp(spark):
    rows = spark.createDataFrame([("2026-07-08 22:37 UTC",), ("2026-07-03",), ("yesterday",), ("2026-07-08 22:37:45",)], "s string")
    got = [r[0] for r in rows.select(rd.stamp(F.col("s"))).collect()]
    assert got == [dt.datetime(2026, 7, 8, 22, 37), dt.datetime(2026, 7, 3), None, dt.datetime(2026, 7, 8, 22, 37)]


def test_changelog(spark):
    text = "- [DONE] - [2026-07-08 10:00 UTC] - [Fix] - [api] - [Mended it]\njunk\n- [WIP] - [2026-07-09] - [Feature] - [ui] - Plain"
    a, b = rd.changelog(files(spark, text)).collect()
    assert (a.component, a.body, a.source_ref, a.title) == ("api", "Mended it", "line:1", "[DONE] Fix — Mended it")
    assert json.loads(a.meta) == {"status": "DONE", "taskType": "Fix"}
    assert b.source_ref == "line:3" and b.occurred_at == dt.datetime(2026, 7, 9)


def test_session_log(spark):
    text = "---\n### [2026-07-08 10:00 UTC]\n**User Prompt Summary:**\n> Fix the\n  thing\n**Done:** yes\n---\n### [2026-07-09] - x\nbody\n---\nno header\n"
    a, b = rd.session_log(files(spark, text)).collect()
    assert a.title == "Fix the thing" and a.occurred_at == dt.datetime(2026, 7, 8, 10)
    assert b.title.startswith("### [2026-07-09]")


def test_component_log(spark):
    (a,) = rd.component_log(files(spark, "### [2026-07-08] - [New] pool\n**Status:**\n- Completed\n", "x/pool.log")).collect()
    assert (a.component, a.title) == ("pool", "pool: New pool") and json.loads(a.meta) == {"status": "Completed"}


def test_backlog(spark):
    text = "# head\n- [2026-07-01] [api] Persist settings\n\nloose thought\n- [2026-07-02] RESOLVED [L2#a3f2c1]: done\n- [2026-07-03] WONTFIX: no\n- [2026-07-03] REOPENED [L5]: again"
    rows = {r.source_ref: (r, json.loads(r.meta)) for r in rd.backlog(files(spark, text)).collect()}
    assert set(rows) == {"line:2", "line:4", "line:5", "line:6", "line:7"}
    assert rows["line:2"][0].component == "api" and "marker" not in rows["line:2"][1]
    assert rows["line:4"][1]["unstructured"] is True
    assert rows["line:5"][1]["marker"] == {"kind": "resolved", "target_line": 2, "target_hash": "a3f2c1", "legacy": False}
    assert rows["line:6"][1]["marker"] == {"kind": "dropped", "legacy": True}
    assert rows["line:7"][1]["marker"]["target_line"] == 5


def test_git_log(spark):
    text = "\x01abc\x1f2026-07-08T10:00:00Z\x1fAnn\x1fFirst\n\nM\ta.py\nR100\told.py\tnew.py\n\x01def\x1f2026-07-09T10:00:00Z\x1fBo\x1fSecond\n\x01\x1f\x1fx\x1fy"
    a, b = rd.git_log(files(spark, text)).orderBy("source_ref").collect()
    assert json.loads(a.meta)["files"] == ["a.py", "new.py"] and "Author: Ann" in a.body and b.title == "Second"
    assert rd.git_log(files(spark, "")).count() == 0


def test_markdown(spark):
    long = "word " * 30
    text = f"---\nt: 1\n---\n# Top\n{long}\n## Tiny\nx\n## Next one\n{long}"
    a, b = rd.markdown(files(spark, text, "docs/legacy/guide.md")).collect()
    assert (a.title, b.title, b.source_ref) == ("Top", "Next one", "#next-one") and json.loads(a.meta) == {"docStatus": "archived"}


LINES = [
    '{"type":"summary","summary":"Pool work"}',
    '{"type":"user","timestamp":"2026-07-08T10:00:00Z","cwd":"/w","message":{"content":"How does the pool resize?"}}',
    '{"type":"user","message":{"content":"<command>x</command>"}}',
    '{"type":"assistant","timestamp":"2026-07-08T10:01:00Z","message":{"content":[{"type":"text","text":"# Summary\\nDone"},'
    '{"type":"tool_use","name":"Edit","input":{"file_path":"a.py"}},{"type":"tool_use","name":"Bash","input":{"command":"ls -l\\nx"}}]}}',
    '{"type":"user","message":{"content":[{"type":"tool_result","content":"x"}]}}',
    '{"type":"assistant","message":{"content":[{"type":"text","text":"torn',
]


@pytest.fixture
def lines(spark):
    return spark.createDataFrame([("p", "t.jsonl", "s1", i, x) for i, x in enumerate(LINES)], "project string, source_path string, session_id string, pos int, line string")


def test_transcript(lines):
    rows = [(r.source_ref, json.loads(r.meta)["kind"], r.body) for r in rd.transcript(lines).orderBy("source_ref", "meta").collect()]
    assert rows == [("line:2", "prompt", "How does the pool resize?"), ("line:4", "action", "Edit a.py\nBash ls -l"), ("line:4", "summary", "# Summary\nDone")]


def test_sessions(lines):
    (s,) = rd.sessions(lines).collect()
    assert (s.cwd, s.title, s.prompt_count, s.action_count, s.files_touched) == ("/w", "Pool work", 1, 2, ["a.py"])
    assert s.started_at == dt.datetime(2026, 7, 8, 10) and s.first_prompt == "How does the pool resize?"


def test_changed(spark):
    now = spark.createDataFrame([("a", 10.7, 5), ("b", 20.0, 6), ("c", 1.0, 1)], "path string, mtime_ms double, size long")
    state = spark.createDataFrame([("a", 10, 5), ("b", 20, 5)], "path string, mtime_ms long, size long")
    assert {r.path for r in rd.changed(now, state).collect()} == {"b", "c"}


def test_folders_and_aliases(spark):
    projects = spark.createDataFrame([("deep", "-w-Deep"), ("harbor", "-w-Deep-Harbor")], "slug string, encoded string")
    folders = spark.createDataFrame([("-w-Deep-Harbor-src",), ("-w-Deep",), ("-w-Deeper",)], "dir string")
    assert {r.dir: r.slug for r in rd.match_folder(folders, projects).collect()} == {"-w-Deep-Harbor-src": "harbor", "-w-Deep": "deep"}
    ghosts = spark.createDataFrame([("users-x-deep-harbor",), ("notdeep",), ("users-deep",)], "slug string")
    known = spark.createDataFrame([("deep",), ("harbor",), ("deep-harbor",)], "slug string")
    assert {r.ghost: r.alias_of for r in rd.resolve_alias(ghosts, known).collect()} == {"users-x-deep-harbor": "deep-harbor", "users-deep": "deep"}
