"""Registered queries of JSON predicates and edits, and of session rows kept by a stream, over the tables; all with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.operators import meta as mm
from annalist.plans import fulltext_queries as held
from annalist.storage import shared_folder
from annalist.streaming.sessions import STORE, latest_sessions, session_rows, write_sessions

#: Props of events from this number on count as stale and lose their key below.
_STALE = 90


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their props as a VARIANT table in the shared folder, as a deployment holds them."""
    path = f"{shared_folder(spark)}/annalist-tables/meta-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "user_id", F.col("props").alias("meta"))
    mm.with_variant(events).write.parquet(path)
    return spark.read.parquet(path)


def f7_json_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by a value in their JSON; the scan reads that value's column alone."""
    meta = F.col("meta")
    return _events(spark, sf_dir).where(mm.equals(meta, ("k",), "42") | (mm.has_key(meta, "k") & mm.differs(meta, ("k",), "7") & (F.col("event_type") == "error"))).select("event_id", mm.value(meta, "k").alias("k"))


def f7_json_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors are marked as archived in their JSON, stale numbers leave it: the objects afterwards, keys sorted."""
    meta, events = F.col("meta"), _events(spark, sf_dir)
    patch = F.to_variant_object(F.struct(F.lit("archived").alias("docStatus"), F.col("user_id").alias("by")))
    marked = F.when(F.col("event_type") == "error", mm.merged(meta, patch)).otherwise(meta)
    rows = events.withColumn("meta", marked)
    stale = mm.value(meta, "k").cast("int") >= _STALE
    return rows.withColumn("meta", F.when(stale, mm.without(meta, "k")).otherwise(meta)).select("event_id", mm.text(meta).alias("meta"))


def j9_json_resync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Props after a resync that takes the numbers of clicks and views modulo 50; only rows that differ change."""
    meta, events = F.col("meta"), _events(spark, sf_dir)
    fresh = events.where("event_type IN ('click', 'view')").select("event_id", F.to_variant_object(F.struct((mm.value(meta, "k").cast("int") % 50).alias("k"))).alias("meta"))
    return mm.sync_meta(events, fresh, ("event_id",)).select("event_id", mm.text(meta).alias("meta"), "changed")


_LINES = """SELECT conv_id, turn, role, text,
    CASE WHEN role = 'user' THEN to_json(named_struct('type', 'user', 'timestamp', at, 'cwd', '/w/' || conv_id, 'message', named_struct('content', text)))
        WHEN role = 'assistant' THEN to_json(named_struct('type', 'assistant', 'timestamp', at, 'message', named_struct('content', array(
            named_struct('type', 'text', 'text', text, 'name', NULL, 'input', NULL),
            named_struct('type', 'tool_use', 'text', NULL, 'name', 'Edit', 'input', named_struct('file_path', 'f' || length(text) % 9))))))
        ELSE to_json(named_struct('type', 'summary', 'timestamp', at, 'summary', substring(text, 1, 40))) END AS line
    FROM (SELECT *, date_format(timestamp_seconds(1704067200 + turn * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'") AS at FROM {rows} WHERE text IS NOT NULL)"""


def t4_session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcript lines, read by a stream in two runs, the first with turns 0 to 2: the session rows it keeps."""
    folder = f"{shared_folder(spark)}/annalist-sessions/{uuid.uuid4().hex}"
    lines = spark.sql(_LINES, rows=spark.read.parquet(f"{sf_dir}/conversations.parquet")).select("conv_id", "turn", "line")
    before = spark.conf.get(STORE[0])
    spark.conf.set(*STORE)
    try:
        for early in (True, False):
            lines.where(F.col("turn") < 3 if early else F.col("turn") >= 3).write.mode("append").parquet(f"{folder}/lines")
            stream = spark.readStream.schema(lines.schema).parquet(f"{folder}/lines")
            stream = stream.select(F.lit("p").alias("project"), F.lit("").alias("source_path"), F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("pos"), "line")
            write_sessions(session_rows(stream), f"{folder}/sessions", f"{folder}/checkpoint").awaitTermination()
    finally:
        spark.conf.set(STORE[0], before)
    rows = latest_sessions(spark, f"{folder}/sessions")
    micros = [F.unix_micros(c).alias(c) for c in ("started_at", "ended_at")]
    return rows.select("session_id", "cwd", "title", *micros, "prompt_count", "action_count", F.array_join("files_touched", ",").alias("files"))


_TRIMMED = r"regexp_replace(text, '^\s+', '')"
_ASKED = f"(role = 'user' AND length({_TRIMMED}) >= 3 AND NOT (starts_with({_TRIMMED}, '<') OR starts_with({_TRIMMED}, 'Caveat:') OR starts_with({_TRIMMED}, '[Request interrupted')))"
_SUMMARY = "role NOT IN ('user', 'assistant')"

QUERIES = held.QUERIES | {f.__name__: f for f in (f7_json_filtered, f7_json_edited, j9_json_resync, t4_session_stream)}
ORACLE_SQL = held.ORACLE_SQL | {
    "f7_json_filtered": "SELECT event_id, props->>'k' AS k FROM events WHERE props->>'k' = '42' OR (json_exists(props, '$.k') AND event_type = 'error' AND (props->>'k') IS DISTINCT FROM '7')",
    "f7_json_edited": f"""SELECT event_id, '{{' || concat_ws(',', CASE WHEN event_type = 'error' THEN '"by":' || user_id || ',"docStatus":"archived"' END,
        CASE WHEN (props->>'k')::INT < {_STALE} THEN '"k":' || (props->>'k') END) || '}}' AS meta FROM events""",
    "j9_json_resync": """SELECT event_id, '{"k":' || CASE WHEN event_type IN ('click', 'view') THEN (props->>'k')::INT % 50 ELSE (props->>'k')::INT END || '}' AS meta,
        event_type IN ('click', 'view') AND (props->>'k')::INT >= 50 AS changed FROM events""",
    "t4_session_stream": f"""
    SELECT conv_id::VARCHAR AS session_id, max(CASE WHEN role = 'user' THEN '/w/' || conv_id END) AS cwd,
        coalesce(coalesce(arg_min(substring(text, 1, 40), turn) FILTER ({_SUMMARY} AND turn >= 3), arg_min(substring(text, 1, 40), turn) FILTER ({_SUMMARY} AND turn < 3)),
            arg_min(substring(text, 1, 120), turn) FILTER ({_ASKED})) AS title,
        (min(turn) * 60 + 1704067200)::BIGINT * 1000000 AS started_at, (max(turn) * 60 + 1704067200)::BIGINT * 1000000 AS ended_at,
        count(*) FILTER ({_ASKED}) AS prompt_count, count(*) FILTER (role = 'assistant') AS action_count,
        coalesce(string_agg(DISTINCT 'f' || length(text) % 9, ',' ORDER BY 'f' || length(text) % 9) FILTER (role = 'assistant'), '') AS files
    FROM conversations WHERE text IS NOT NULL GROUP BY conv_id""",
}
