"""The engine's canonical tables laid over the test tables, for Spark and, as common table expressions, for DuckDB.

A deployment has these tables itself; the operators take them as DataFrames and know nothing of this module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SOURCE_TYPES = ("changelog", "session", "component", "backlog", "report", "transcript", "commit", "doc")
AS_OF = "2024-01-31 00:00:00"

_PICK = "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SOURCE_TYPES)) + " END"
_KIND = "CASE WHEN doc_id % 8 = 5 THEN CASE doc_id % 6 WHEN 0 THEN 'prompt' WHEN 1 THEN 'plan' WHEN 2 THEN 'insight' WHEN 3 THEN 'summary' WHEN 4 THEN 'action' ELSE 'response' END END"

_ENTRIES = f"""
    SELECT doc_id AS id, source AS project, {_PICK} AS source_type,
        CASE WHEN doc_id % 5 <> 0 THEN lang END AS component,
        CASE WHEN doc_id % 8 = 5 THEN 's' || CAST(doc_id % 50 AS VARCHAR(20)) END AS session_id,
        substring(text, 1, 60) AS title, text AS body,
        CASE WHEN doc_id % 17 <> 0 THEN %AT% END AS occurred_at,
        'path/' || CAST(doc_id % 97 AS VARCHAR(20)) AS source_path,
        {_KIND} AS kind,
        CASE WHEN doc_id % 8 = 7 AND doc_id % 3 = 0 THEN 'archived' END AS doc_status,
        CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 7 = 1 THEN 'old' ELSE 'current' END AS vectorized_in
    FROM documents
"""
_K = {"spark": "CAST(get_json_object(props, '$.k') AS INT)", "duckdb": "CAST(json_extract(props, '$.k') AS INT)"}
_USAGE = """
    SELECT event_id AS id, ts AS called_at, 'client' || CAST(user_id % 4 AS VARCHAR(20)) AS client,
        CASE event_type WHEN 'view' THEN 'search' WHEN 'click' THEN 'ask' WHEN 'signup' THEN 'timeline' WHEN 'error' THEN 'health' END AS tool,
        CASE event_type WHEN 'view' THEN '/api/search' WHEN 'click' THEN '/api/ask' WHEN 'signup' THEN '/api/projects/p1/timeline'
            WHEN 'error' THEN '/api/health' ELSE '/api/projects' END AS path,
        CASE event_type WHEN 'view' THEN 'query' WHEN 'click' THEN 'query' WHEN 'signup' THEN 'read' WHEN 'error' THEN 'status' ELSE 'read' END AS route_class,
        CASE WHEN event_type IN ('view', 'click') AND user_id % 11 <> 0 THEN 'q' || CAST(user_id % 40 AS VARCHAR(20)) END AS query,
        CASE WHEN %K% >= 90 THEN 500 WHEN %K% >= 80 THEN 499 WHEN %K% >= 75 THEN 404 ELSE 200 END AS status,
        CAST(round(value * 100) AS INT) AS duration_ms
    FROM events
"""
_REPLY = """
    SELECT event_id AS call_id, %K% % 5 AS result_count, CASE %K% % 3 WHEN 0 THEN 'model-a' WHEN 1 THEN 'model-b' END AS model,
        %K% * 3 AS prompt_tokens, %K% * 2 AS completion_tokens, CASE WHEN %K% % 4 <> 0 THEN %K% * 5 END AS ttft_ms, (%K% % 10 = 0) AS degraded
    FROM events WHERE event_id % 3 <> 0
"""
_PROJECTS = """
    SELECT slug, CASE WHEN slug LIKE 'src1_' THEN substring(slug, 1, 3) || substring(slug, 5, 1) END AS alias_of
    FROM (SELECT DISTINCT source AS slug FROM documents) s
    UNION ALL SELECT 'empty', NULL
"""
_SESSIONS = """
    SELECT conv_id AS session_id, min(turn) AS first_turn, max(turn) AS last_turn,
        CAST(count(CASE WHEN role = 'user' THEN 1 END) AS BIGINT) AS prompts, CAST(count(CASE WHEN role = 'assistant' THEN 1 END) AS BIGINT) AS replies
    FROM conversations GROUP BY conv_id
"""


def _in(dialect: str, sql: str) -> str:
    at = {"spark": "timestamp_seconds(1704067200 + doc_id * 3600)", "duckdb": "TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id)"}[dialect]
    return sql.replace("%AT%", at).replace("%K%", _K[dialect])


_SQL = {"entries": (_ENTRIES, "documents"), "usage": (_USAGE, "events"), "reply": (_REPLY, "events"), "projects": (_PROJECTS, "documents"), "sessions": (_SESSIONS, "conversations")}


def spark_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql, source = _SQL[name]
    base = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    return spark.sql(_in("spark", sql).replace(f"FROM {source}", "FROM {source_table}"), source_table=base)


def ctes(*names: str) -> str:
    """`WITH name AS (...), ...` in DuckDB's dialect."""
    return "WITH " + ", ".join(f"{n} AS ({_in('duckdb', _SQL[n][0])})" for n in names)
