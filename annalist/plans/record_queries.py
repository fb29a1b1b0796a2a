"""Registered queries of readers, backlogs, pages, literals, dates and paths.

Where an operator reads a format, its input is written from the test rows by number, so SQL can say what must come out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions import describe as ds
from annalist.functions import text as tx
from annalist.operators import backlog as bl
from annalist.operators import catalog as cat
from annalist.operators import evaluation as ev
from annalist.operators import maintenance as mt
from annalist.operators import mining as mi
from annalist.operators import retrieval as rt
from annalist.operators import telemetry as tel
from annalist.plans import more_queries  # noqa: F401  its queries are registered first
from annalist.plans.queries import ORACLE_SQL, QUERIES, _register, _register_raw, _tokens_sql
from annalist.sources import readers as rd

__all__ = ["ORACLE_SQL", "QUERIES"]

# ---- pages, counts and joins of the catalog


@_register("o5_uncovered_page", "SELECT id, vectorized_in FROM entries WHERE id > 100 AND vectorized_in IS DISTINCT FROM 'current' ORDER BY id LIMIT 50", "entries")
def _(entries):
    return cat.page_after(entries, 100, 50, "current", covered=False).select("id", "vectorized_in")


@_register("o5_covered_page", "SELECT id FROM entries WHERE id > 100 AND vectorized_in = 'current' ORDER BY id LIMIT 50", "entries")
def _(entries):
    return cat.page_after(entries, 100, 50, "current", covered=True).select("id")


@_register("o6_recent_errors", "SELECT id, path, status FROM usage WHERE status >= 400 ORDER BY id DESC LIMIT 50", "usage")
def _(usage):
    return cat.newest(tel.filter_calls(usage, failed=True), 50).select("id", "path", "status")


@_register("o7_backlog_order", "SELECT id, project, row_number() OVER (PARTITION BY project ORDER BY source_path, id) - 1 AS place FROM entries WHERE source_type = 'backlog'", "entries")
def _(entries):
    return cat.backlog_entries(entries).select("id", "project", F.col("place").cast("long").alias("place"))


@_register("o9_next_cursor", "SELECT called_at, id FROM (SELECT called_at, id, row_number() OVER (ORDER BY called_at DESC, id DESC) AS n FROM usage) WHERE n = 100", "usage", "reply")
def _(usage, reply):
    return tel.next_cursor(tel.call_page(usage, reply, 100), 100)


@_register("j1_entries_of_projects", "SELECT alias_of, count(*) AS n FROM entries JOIN projects ON slug = project GROUP BY 1", "entries", "projects")
def _(entries, projects):
    return cat.with_projects(entries, projects).groupBy("alias_of").agg(F.count(F.lit(1)).alias("n"))


@_register("j2_sessions_of_projects", """
    SELECT session_id, project, alias_of, n FROM (SELECT session_id, min(project) AS project, count(*) AS n FROM entries WHERE session_id IS NOT NULL GROUP BY 1)
    JOIN projects ON slug = project""", "entries", "projects")  # fmt: skip
def _(entries, projects):
    sessions = entries.where("session_id IS NOT NULL").groupBy("session_id").agg(F.min("project").alias("project"), F.count(F.lit(1)).alias("n"))
    return cat.with_projects(sessions, projects).select("session_id", "project", "alias_of", "n")


@_register("a20_record_counts", """
    SELECT count(*) AS entries, count(*) FILTER (id <= 500) AS up_to, count(*) FILTER (vectorized_in = 'current') AS covered,
        count(*) FILTER (vectorized_in IS DISTINCT FROM 'current') AS uncovered, count(*) FILTER (doc_status = 'archived') AS archived, max(occurred_at) AS latest,
        (SELECT count(*) FROM sessions) AS sessions FROM entries""", "entries", "sessions")  # fmt: skip
def _(entries, sessions):
    return cat.record_counts(entries, sessions, "current", 500)


@_register("a29_hour_strip", "SELECT h::INT AS hour, count(id) AS calls FROM range(24) r(h) LEFT JOIN usage ON hour(called_at) = h GROUP BY 1", "usage")
def _(usage):
    return tel.hour_strip(usage)


@_register("a29_iso_weekdays", "SELECT d::INT AS weekday, count(id) AS calls FROM range(1, 8) r(d) LEFT JOIN usage ON isodow(called_at) = d GROUP BY 1", "usage")
def _(usage):
    return tel.iso_weekdays(usage)


@_register("s15_first_of_batch", "SELECT id, project, 0 AS seq FROM entries WHERE id % 4 <> 0", "entries")
def _(entries):
    batch = entries.select("id", "project", F.explode(F.array(F.lit(1), F.lit(0))).alias("seq"))
    return cat.new_entries(batch, entries.where("id % 4 = 0"), "id", order="seq")


@_register("j9_meta_sync", "SELECT id, CASE WHEN id % 3 = 0 THEN 'meta' || id ELSE kind END AS meta FROM entries", "entries")
def _(entries):
    changes = entries.where("id % 3 = 0").select("id", F.concat(F.lit("meta"), F.col("id").cast("string")).alias("meta"))
    return mt.set_meta(entries.select("id", F.col("kind").alias("meta")), changes, "id")


@_register("f10_substring_matches", "SELECT project, count(*) FILTER (contains(lower(title), 'an')) AS hits, count(*) AS every FROM entries GROUP BY 1", "entries")
def _(entries):
    return entries.groupBy("project").agg(F.count_if(ds.matches(F.col("title"), "AN")).alias("hits"), F.count_if(ds.matches(F.col("title"), "")).alias("every"))


# ---- text functions

_LITERALS = "CASE doc_id % 8 WHEN 0 THEN 'err42' WHEN 1 THEN 'snake_case' WHEN 2 THEN 'a.b' WHEN 3 THEN '123' WHEN 4 THEN '12' WHEN 5 THEN 'plain' WHEN 6 THEN 'x1' ELSE 'ab' END"


@_register_raw("c3_literal_tokens", "SELECT doc_id, doc_id % 8 IN (0, 1, 2, 3, 6) AS literal FROM documents", "documents")
def _(documents):
    return documents.select("doc_id", tx.is_literal_token(F.expr(_LITERALS)).alias("literal"))


@_register_raw("c4_query_vectors", f"""
    SELECT query_id, list_reduce(list_transform(string_split(token, ''), lambda c: ascii(c)::BIGINT), lambda h, c: (xor(h, c) * 16777619) % 4294967296, 2166136261::BIGINT) AS term,
        round(1 + ln(count(*)), 9) AS weight FROM (SELECT item_id AS query_id, unnest({_tokens_sql("text")}) AS token FROM benchmark) GROUP BY query_id, token""", "benchmark")  # fmt: skip
def _(benchmark):
    return rt.query_terms(benchmark.select(F.col("item_id").alias("query_id"), "text")).select("query_id", "term", F.round("weight", 9).alias("weight"))


@_register("c8_dedup_keys", r"""
    SELECT id, concat_ws('-', substring(h, 1, 8), substring(h, 9, 4), '5' || substring(h, 14, 3),
        substring('89ab', (strpos('0123456789abcdef', substring(h, 17, 1)) - 1) % 4 + 1, 1) || substring(h, 18, 3), substring(h, 21, 12)) AS key
    FROM (SELECT id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(concat_ws(chr(31), project, source_path, coalesce(session_id, ''), title, substring(sha256(body), 1, 16)))) AS h
        FROM entries)""", "entries")  # fmt: skip
def _(entries):
    return entries.select("id", tx.dedup_key(*(F.col(c) for c in ("project", "source_path", "session_id", "title", "body"))).alias("key"))


_PATHS = (
    "CASE doc_id % 6 WHEN 0 THEN 'docs/old/plan.md' WHEN 1 THEN 'docs/bold/plan.md' WHEN 2 THEN 'docs/old-plan.md' WHEN 3 THEN 'docs/_Archive/plan.md' "
    "WHEN 4 THEN 'old.md/folder.md' ELSE 'a/plan.legacy.md' END"
)


@_register_raw("c9_archived_paths", "SELECT doc_id, doc_id % 6 IN (0, 2, 3, 5) AS archived FROM documents", "documents")
def _(documents):
    return documents.select("doc_id", tx.is_archived_path(F.expr(_PATHS)).alias("archived"))


_FIRST_DAY, _LAST_DAY = "(DATE '2024-01-01' + CAST(doc_id % 50 AS INT))", "(DATE '2024-01-01' + CAST(doc_id % 50 + doc_id % 9 AS INT))"


@_register_raw("c14_date_windows", f"""
    SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN NULL WHEN 2 THEN TIMESTAMP '2024-01-29' ELSE {_FIRST_DAY}::TIMESTAMP - INTERVAL 3 DAY END AS since,
        CASE doc_id % 4 WHEN 3 THEN NULL WHEN 2 THEN TIMESTAMP '2024-03-03 23:59:59.999' WHEN 1 THEN {_FIRST_DAY}::TIMESTAMP + INTERVAL 3 DAY + INTERVAL 86399999 MILLISECOND
            ELSE {_LAST_DAY}::TIMESTAMP + INTERVAL 3 DAY + INTERVAL 86399999 MILLISECOND END AS until FROM documents""", "documents")  # fmt: skip
def _(documents):
    asked = F.expr(
        f"CASE doc_id % 4 WHEN 0 THEN 'between ' || {_FIRST_DAY} || ' and ' || date_format({_LAST_DAY}, 'd MMMM yyyy') "
        f"WHEN 1 THEN 'on ' || date_format({_FIRST_DAY}, 'MMMM d, yyyy') || '?' WHEN 2 THEN 'all of February 2024' ELSE 'in 2024, version 1.2' END"
    )
    window = tx.padded_window(tx.date_window(asked), 3)
    return documents.select("doc_id", window["since"].alias("since"), window["until"].alias("until"))


def _stems_sql(column: str) -> str:
    stem = (
        "CASE WHEN length(w) > 5 AND ends_with(w, 'ing') THEN w[:-4] WHEN length(w) > 4 AND ends_with(w, 'ed') THEN w[:-3] "
        "WHEN length(w) > 3 AND ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN w[:-2] ELSE w END"
    )
    words = rf"list_filter(regexp_split_to_array(regexp_replace(lower({column}), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda w: length(w) >= 3)"
    return f"list_distinct(list_transform({words}, lambda w: {stem}))"


@_register("c16_token_containment", f"""
    SELECT id, round(coalesce(len(list_intersect(a, b))::DOUBLE / nullif(len(a), 0), 0), 9) AS share
    FROM (SELECT id, {_stems_sql("title")} AS a, {_stems_sql("substring(body, 31, 200)")} AS b FROM entries)""", "entries")  # fmt: skip
def _(entries):
    return entries.select("id", F.round(tx.token_containment(F.col("title"), F.substring("body", 31, 200)), 9).alias("share"))


@_register_raw("c18_fts_queries", f"SELECT item_id, array_to_string({_tokens_sql('text')}, ' | ') AS query FROM benchmark", "benchmark")
def _(benchmark):
    return benchmark.select("item_id", tx.fts_query(F.col("text")).alias("query"))


_SHAPES = (
    "CASE doc_id % 7 WHEN 0 THEN 'v1.' || doc_id || '.2' WHEN 1 THEN doc_id || 'ms' WHEN 2 THEN 'a1b2c3d' WHEN 3 THEN 'Foo_bar' WHEN 4 THEN 'foo.Bar' "
    "WHEN 5 THEN 'plain' ELSE CAST(doc_id AS STRING) END"
)


@_register_raw("c24_literals", """
    SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'version' WHEN 1 THEN 'measurement' WHEN 2 THEN 'sha' WHEN 3 THEN 'identifier' WHEN 4 THEN 'dotted' END AS shape,
        doc_id || 'ms' AS telling, 'Foo_Bar' AS spelling FROM documents""", "documents")  # fmt: skip
def _(documents):
    said = F.expr("'Took ' || doc_id || 'MS in Foo_Bar at v1.2.3, not a.b'")
    return documents.select(
        "doc_id", ds.literal_shape(F.expr(_SHAPES)).alias("shape"), ds.extract_literal(said).alias("telling"), ds.spelling_in(said, F.lit("foo_bar")).alias("spelling")
    )


@_register_raw("c25_query_summaries", """
    SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'plain words ' || doc_id WHEN 1 THEN 'why & how ' || doc_id || ' — project: ' || source || ' · limit: 5' ELSE 'kind: plan' END AS summary
    FROM documents""", "documents")  # fmt: skip
def _(documents):
    raw = F.expr("CASE doc_id % 3 WHEN 0 THEN ' plain words ' || doc_id WHEN 1 THEN 'limit=5&q=why+%26+how+' || doc_id || '&since=&project=' || source ELSE 'kind=plan' END")
    return documents.select("doc_id", ds.summarize_query(raw).alias("summary"))


@_register_raw("c26_ranges", f"""
    SELECT doc_id, {_FIRST_DAY}::TIMESTAMP AS since, {_LAST_DAY}::TIMESTAMP + INTERVAL 1 DAY AS until, (doc_id % 9 + 1)::INT AS days FROM documents""", "documents")  # fmt: skip
def _(documents):
    bounds = ds.range_bounds(F.expr(_FIRST_DAY), F.expr(_LAST_DAY))
    return documents.select("doc_id", *(bounds[c].alias(c) for c in ("since", "until", "days")))


@_register("c29_token_rates", """
    SELECT id, CASE WHEN duration_ms > ttft_ms THEN round(completion_tokens / ((duration_ms - ttft_ms) / 1000.0::DOUBLE), 1) END AS rate FROM usage JOIN reply ON id = call_id""", "usage", "reply")  # fmt: skip
def _(usage, reply):
    rows = usage.join(reply, F.col("id") == F.col("call_id"))
    return rows.select("id", tx.tokens_per_second(F.col("completion_tokens"), F.col("duration_ms"), F.col("ttft_ms")).alias("rate"))


@_register_raw("f13_host_paths", """
    SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '/home/me/a b/' || doc_id WHEN 1 THEN '/srv/logs/x' || doc_id ELSE '/database/' || doc_id END AS path,
        'vscode://file' || CASE doc_id % 3 WHEN 0 THEN '/home/me/a%20b/' || doc_id WHEN 1 THEN '/srv/logs/x' || doc_id ELSE '/database/' || doc_id END
            || CASE WHEN doc_id % 2 = 0 THEN ':' || doc_id ELSE '' END AS url FROM documents""", "documents")  # fmt: skip
def _(documents):
    inside = F.expr("CASE doc_id % 3 WHEN 0 THEN '/data/a b/' || doc_id WHEN 1 THEN '/data/logs/x' || doc_id ELSE '/database/' || doc_id END")
    path = ds.host_path(inside, [("/data", "/home/me"), ("/data/logs", "/srv/logs/")])
    line = ds.line_of(F.expr("CASE WHEN doc_id % 2 = 0 THEN 'line:' || doc_id ELSE '#part' END"))
    return documents.select("doc_id", path.alias("path"), ds.editor_url(path, line).alias("url"))


@_register_raw("e19_judge_grades", "SELECT doc_id, CASE WHEN doc_id % 5 <= 3 THEN '1:' || doc_id % 5 || ',' ELSE '' END || '2:0' AS grades FROM documents", "documents")
def _(documents):
    reply = F.expr("""'Grades: [{"n": 1, "grade": ' || doc_id % 5 || '}, {"n": 2, "grade": 0}, {"n": 2, "grade": 3}, {"n": 3, "grade": 1.5}] done'""")
    return documents.select("doc_id", F.array_join(F.transform(ds.judge_grades(reply), lambda g: F.concat_ws(":", g["n"], g["grade"])), ",").alias("grades"))


# ---- readers, over files written from the test rows


def _files(documents: DataFrame, path: str, text: str) -> DataFrame:
    return documents.select(F.col("source").alias("project"), F.expr(path).alias("source_path"), F.expr(text).alias("text"))


_READ = ("project", "source_type", "component", "title", "occurred_at", "source_path", "source_ref")


@_register_raw("s1_changelog", """
    SELECT source AS project, 'changelog' AS source_type, lang AS component, '[DONE] fix — change ' || doc_id AS title, TIMESTAMP '2024-02-03 10:20:00' AS occurred_at,
        'c' || doc_id AS source_path, 'line:2' AS source_ref FROM documents
    UNION ALL SELECT source, 'changelog', 'x', '[IN-PROGRESS] task — more', TIMESTAMP '2024-02-04', 'c' || doc_id, 'line:4' FROM documents""", "documents")  # fmt: skip
def _(documents):
    text = r"'# head\n- [DONE] - [2024-02-03 10:20 UTC] - [fix] - [' || lang || '] - [change ' || doc_id || ']\n- [done] - nothing\n- [IN-PROGRESS] - [2024-02-04] - [task] - [x] - more'"
    return rd.changelog(_files(documents, "'c' || doc_id", text)).select(*_READ)


@_register_raw("s4_component_log", """
    SELECT source AS project, 'component' AS source_type, lang AS component, lang || ': part ' || doc_id AS title, TIMESTAMP '2024-02-03 10:20:00' AS occurred_at,
        'components/' || lang || '.log' AS source_path, NULL::VARCHAR AS source_ref FROM documents""", "documents")  # fmt: skip
def _(documents):
    text = r"'intro\n---\n### [2024-02-03 10:20] - [part ' || doc_id || ']\n**Status:** done\n---\nno head'"
    return rd.component_log(_files(documents, "'components/' || lang || '.log'", text)).select(*_READ)


@_register_raw("s6_git_log", """
    SELECT source AS project, 'commit' AS source_type, NULL::VARCHAR AS component, 'subject ' || doc_id AS title, TIMESTAMP '2024-02-03 10:20:00' AS occurred_at, 'git' AS source_path,
        'sha' || doc_id AS source_ref, 'subject ' || doc_id || chr(10) || 'Author: me' || chr(10) || 'Files:' || chr(10) || 'a.py' || chr(10) || 'new.py' AS body FROM documents""", "documents")  # fmt: skip
def _(documents):
    text = r"char(1) || 'sha' || doc_id || char(31) || '2024-02-03T10:20:00Z' || char(31) || 'me' || char(31) || 'subject ' || doc_id || '\n\nM\ta.py\nR100\told.py\tnew.py\n'"
    return rd.git_log(_files(documents, "'git'", text)).select(*_READ, "body")


@_register_raw("s7_markdown", """
    SELECT source AS project, 'doc' AS source_type, 'Part ' || doc_id AS title, 'docs/old/n.md' AS source_path, '#part-' || doc_id AS source_ref, 'archived' AS status,
        length('# Part ' || doc_id) + 101 AS size FROM documents""", "documents")  # fmt: skip
def _(documents):
    text = r"'---\ntitle: x\n---\n# Short\nno\n# Part ' || doc_id || '\n' || repeat('w', 100) || '\n\n'"
    rows = rd.markdown(_files(documents, "'docs/old/n.md'", text))
    status = F.get_json_object("meta", "$.docStatus").alias("status")
    return rows.select("project", "source_type", "title", "source_path", "source_ref", status, F.length("body").cast("long").alias("size"))


@_register_raw("e22_tool_queries", """
    SELECT 's/' || doc_id AS ref, '2024-02-03T00:00:00Z' AS at, CASE doc_id % 3 WHEN 0 THEN 'why ' ELSE 'find ' END || doc_id AS text, CASE WHEN doc_id % 3 = 0 THEN source END AS project
    FROM documents WHERE doc_id % 3 < 2""", "documents")  # fmt: skip
def _(documents):
    call = F.expr("""CASE doc_id % 3
        WHEN 0 THEN '{"type":"tool_use","name":"rec_ask","input":{"question":" why ' || doc_id || '","project":"' || source || '"}}'
        WHEN 1 THEN '{"type":"text","text":"rec_search"},{"type":"tool_use","name":"rec_search","input":{"query":"find ' || doc_id || '"}}'
        ELSE '{"type":"tool_use","name":"other","input":{"query":"rec_ask"}}' END""")
    line = F.concat(F.lit('{"timestamp":"2024-02-03T00:00:00Z","message":{"content":['), call, F.expr("CASE WHEN doc_id % 5 = 0 THEN ']}}' ELSE ']}, \"x\": 1}' END"))
    lines = documents.select(F.concat(F.lit("s/"), F.col("doc_id").cast("string")).alias("ref"), line.alias("line"))
    return mi.tool_queries(lines.union(lines.select("ref", F.lit("rec_ask {torn"))), ("rec_ask", "rec_search")).select("ref", "at", "text", "project")


# ---- backlogs: an item for each document and, by its number, the markers and reviews that speak of it

_MARKER = "struct<kind:string,target_line:int,target_hash:string,legacy:boolean>"


def _backlog_lines(documents: DataFrame) -> DataFrame:
    file = ["'p' AS project", "'f' || doc_id DIV 40 AS path"]
    hashed, day = "lpad(CAST(doc_id AS STRING), 6, '0')", "TIMESTAMP '2024-01-01'"
    words = "'alpha' || doc_id || ' beta' || doc_id"
    none = f"CAST(NULL AS {_MARKER}) AS marker"
    items = documents.selectExpr(*file, "CAST(doc_id AS INT) AS line", f"{words} || ' gamma' AS body", "CAST(NULL AS STRING) AS component", f"{hashed} AS line_hash", f"{day} AS at", none)
    kind = "CASE doc_id % 6 WHEN 1 THEN 'dropped' ELSE 'resolved' END"
    target = "CAST(CASE WHEN doc_id % 6 IN (2, 3) THEN doc_id + 50000000 ELSE doc_id END AS INT)"
    tag = f"CASE doc_id % 6 WHEN 0 THEN {hashed} WHEN 2 THEN {hashed} WHEN 3 THEN 'ffffff' END"
    struct = f"CASE doc_id % 6 WHEN 4 THEN named_struct('kind', 'resolved', 'target_line', CAST(NULL AS INT), 'target_hash', CAST(NULL AS STRING), 'legacy', true) ELSE named_struct('kind', {kind}, 'target_line', {target}, 'target_hash', {tag}, 'legacy', false) END"
    said = f"CASE WHEN doc_id % 6 = 4 THEN 'DONE: ' || {words} WHEN doc_id % 5 = 0 THEN 'another thing' ELSE {words} END"
    markers = documents.where("doc_id % 6 < 5").selectExpr(*file, "CAST(doc_id + 100000000 AS INT)", said, "CAST(NULL AS STRING)", "'' ", day, f"CAST({struct} AS {_MARKER})")
    again = f"named_struct('kind', 'reopened', 'target_line', CAST(doc_id AS INT), 'target_hash', {hashed}, 'legacy', false)"
    reopened = documents.where("doc_id % 12 = 0").selectExpr(*file, "CAST(doc_id + 200000000 AS INT)", words, "CAST(NULL AS STRING)", "'' ", day, f"CAST({again} AS {_MARKER})")
    return items.union(markers).union(reopened)


def _reviews(documents: DataFrame) -> DataFrame:
    rows = documents.where("doc_id % 5 = 0").selectExpr(
        "'p' AS project", "'f' || doc_id DIV 40 AS path", "CAST(doc_id AS INT) AS line", "CASE WHEN doc_id % 10 = 0 THEN 'confirmed-resolved' ELSE 'confirmed-open' END AS status",
        "CASE WHEN doc_id % 10 = 0 THEN TIMESTAMP '2024-03-01' ELSE TIMESTAMP '2023-12-01' END AS reviewed_at",
    )
    return rows.union(rows.selectExpr("project", "path", "line", "'inconclusive'", "TIMESTAMP '2023-11-01'"))


_VIEW_SQL = """
    SELECT doc_id::INT AS line, 'f' || doc_id // 40 AS path,
        CASE WHEN doc_id % 10 = 0 THEN 'resolved' WHEN doc_id % 6 = 1 THEN 'dropped' WHEN doc_id % 12 = 0 OR doc_id % 6 IN (3, 5) THEN 'open' ELSE 'resolved' END AS status,
        CASE WHEN doc_id % 10 = 0 OR doc_id % 5 = 0 AND doc_id % 6 IN (3, 5) THEN 'review' WHEN doc_id % 6 IN (3, 5) THEN 'default' WHEN doc_id % 6 = 4 THEN 'heuristic' ELSE 'structured' END AS origin,
        array_to_string(list_sort(list_filter([CASE WHEN doc_id % 12 = 0 THEN 'superseded-marker' END, CASE WHEN doc_id % 6 = 1 AND doc_id % 5 = 0 THEN 'ref-mismatch' END,
            CASE WHEN doc_id % 6 = 2 THEN 'relocated' END, CASE WHEN doc_id % 10 = 5 THEN 'stale-review' END,
            CASE WHEN doc_id % 10 = 0 AND doc_id % 6 IN (1, 3, 5) THEN 'not-written-back' END], lambda x: x IS NOT NULL)), ',') AS lints FROM documents"""


@_register_raw("b2_marker_links", """
    SELECT (doc_id + 100000000)::INT AS marker_line, CASE WHEN doc_id % 6 <> 3 THEN doc_id::INT END AS line,
        CASE doc_id % 6 WHEN 2 THEN 'relocated' WHEN 3 THEN 'broken-link' WHEN 4 THEN 'fuzzy' ELSE 'ref' END AS how,
        CASE WHEN doc_id % 6 = 1 AND doc_id % 5 = 0 THEN 'ref-mismatch' WHEN doc_id % 6 = 2 THEN 'relocated' WHEN doc_id % 6 = 3 THEN 'broken-link' END AS lint
    FROM documents WHERE doc_id % 6 < 5
    UNION ALL SELECT (doc_id + 200000000)::INT, doc_id::INT, 'ref', NULL FROM documents WHERE doc_id % 12 = 0""", "documents")  # fmt: skip
def _(documents):
    return bl.link_markers(_backlog_lines(documents)).select("marker_line", "line", "how", "lint")


@_register_raw("b6_backlog_view", _VIEW_SQL, "documents")
def _(documents):
    view = bl.backlog_view(_backlog_lines(documents), _reviews(documents), "2024-02-01 00:00:00")
    return view.select("line", "path", "status", "origin", F.array_join("lints", ",").alias("lints"))


@_register_raw("a24_backlog_counts", f"""
    SELECT 'p' AS project, path, count(*) FILTER (status = 'open') AS open, count(*) FILTER (status = 'resolved') AS resolved, count(*) FILTER (status = 'dropped') AS dropped
    FROM ({_VIEW_SQL}) GROUP BY path""", "documents")  # fmt: skip
def _(documents):
    return bl.counts(bl.backlog_view(_backlog_lines(documents), _reviews(documents), "2024-02-01 00:00:00"))


@_register_raw("w1_latest_reviews", "SELECT doc_id::INT AS line, CASE WHEN doc_id % 10 = 0 THEN 'confirmed-resolved' ELSE 'confirmed-open' END AS status FROM documents WHERE doc_id % 5 = 0", "documents")
def _(documents):
    return bl.latest_verdicts(_reviews(documents)).select("line", "status")


# ---- sessions and scores


@_register_raw("t4_merged_sessions", """
    SELECT 's' || doc_id AS session_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 5 = 0 THEN 'new' WHEN doc_id % 2 = 0 THEN 'held' ELSE 'first' END AS title,
        CASE WHEN doc_id % 2 = 0 AND NOT (doc_id % 3 = 0 AND doc_id % 4 = 0) THEN 7 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS prompt_count,
        CASE WHEN doc_id % 6 = 0 THEN 'a,b,c' WHEN doc_id % 2 = 0 THEN 'a,b' ELSE 'b,c' END AS files
    FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0""", "documents")  # fmt: skip
def _(documents):
    common = ["'s' || doc_id AS session_id", "'/w' AS cwd", "TIMESTAMP '2024-01-01' AS started_at", "TIMESTAMP '2024-01-02' AS ended_at", "1 AS action_count"]
    held = documents.where("doc_id % 2 = 0").selectExpr(*common, "'held' AS title", "7 AS prompt_count", "array('a', 'b') AS files_touched")
    new = documents.where("doc_id % 3 = 0").selectExpr(
        *common, "CASE WHEN doc_id % 5 = 0 THEN 'new' END AS title", "'first' AS first_prompt", "2 AS prompt_count", "array('c', 'b') AS files_touched", "doc_id % 4 = 0 AS from_start"
    )
    return mt.merge_sessions(held, new).select("session_id", "title", "prompt_count", F.array_join("files_touched", ",").alias("files"))


@_register_raw("e7_paired", """
    SELECT count(*) FILTER (y > x) AS wins, count(*) FILTER (y < x) AS losses, count(*) FILTER (y = x) AS ties, avg(y - x) AS mean_delta
    FROM (SELECT CASE WHEN doc_id % 11 <> 0 THEN (doc_id % 5) * 0.25::DOUBLE END AS x, (doc_id % 3) * 0.5::DOUBLE AS y FROM documents) WHERE x IS NOT NULL""", "documents")  # fmt: skip
def _(documents):
    a = documents.selectExpr("doc_id AS query_id", "CASE WHEN doc_id % 11 <> 0 THEN (doc_id % 5) * 0.25D END AS value")
    return ev.paired(a, documents.selectExpr("doc_id AS query_id", "(doc_id % 3) * 0.5D AS value"))


@_register_raw("e9_grade_precedence", "SELECT doc_id AS query_id, CASE WHEN doc_id % 2 = 0 THEN 3 WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS grade FROM documents", "documents")
def _(documents):
    rows = documents.selectExpr("doc_id AS query_id", "1 AS item", "1 AS grade", "'other' AS judge")
    rows = rows.union(documents.where("doc_id % 2 = 0").selectExpr("doc_id", "1", "3", "'human'")).union(documents.where("doc_id % 3 = 0").selectExpr("doc_id", "1", "2", "'primary'"))
    return ev.precedence(rows).select("query_id", "grade")


@_register_raw("e11_summaries", """
    SELECT pool, class, count(value) AS n, round(avg(value), 9) AS mean, count(value) < 8 AS indicative FROM (
        SELECT CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'B' END AS pool, unnest([lang, 'all']) AS class, CASE WHEN doc_id % 7 <> 0 THEN (doc_id % 8) * 0.125::DOUBLE END AS value FROM documents)
    GROUP BY 1, 2""", "documents")  # fmt: skip
def _(documents):
    return ev.summarise(documents.selectExpr("CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'B' END AS pool", "lang AS class", "CASE WHEN doc_id % 7 <> 0 THEN (doc_id % 8) * 0.125D END AS value"))
