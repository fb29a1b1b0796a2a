"""Session rows kept by a stream of transcript lines.

Each micro-batch folds its lines to one part a session and task, so a session that writes very much moves few rows. The state of a
session is its row and the place of its last line. Lines that begin at or before that place come from a file that was rewritten:
counts start over, as they do when a file is read whole; anything later adds up. The row is otherwise merged as
`operators.maintenance.merge_sessions` does. Each batch's changed rows are written as one folder, replaced when the batch is replayed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from annalist.sources.readers import FIRST_PROMPT_MOST, session_events
from annalist.sources.tail import register

#: The state store that states of this kind need; a session must be set to it before the stream starts.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Sessions whose parts a task holds before it gives them on.
HELD = 20_000

_PART = (
    "session_id string, low long, high long, cwd_at long, cwd string, title_at long, title string, asked_at long, asked string, "
    "started long, ended long, prompts long, actions long, files array<string>"
)
_ROW = "cwd string, title string, started long, ended long, prompts long, actions long, files array<string>, high long"
_OUT = f"session_id string, {_ROW}"
_FIRSTS = (("cwd_at", "cwd"), ("title_at", "title"), ("asked_at", "asked"))


def _least(a, b):
    return b if a is None else a if b is None else min(a, b)


def _most(a, b):
    return b if a is None else a if b is None else max(a, b)


def _united(a: dict, b: dict) -> dict:
    """Two parts of a session as one; in any order the same."""
    out = {"low": min(a["low"], b["low"]), "high": max(a["high"], b["high"]), "started": _least(a["started"], b["started"]), "ended": _most(a["ended"], b["ended"])}
    for at, what in _FIRSTS:
        first = b if a[at] is None or (b[at] is not None and (b[at], b[what]) < (a[at], a[what])) else a
        out[at], out[what] = first[at], first[what]
    return out | {"prompts": a["prompts"] + b["prompts"], "actions": a["actions"] + b["actions"], "files": a["files"] | b["files"]}


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, dict] = {}
    schema = pa.schema(
        [("session_id", pa.string())]
        + [(c, pa.string() if c in ("cwd", "title", "asked") else pa.list_(pa.string()) if c == "files" else pa.int64()) for c in (f.split()[0] for f in _PART.split(", ")[1:])]
    )

    def given() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"session_id": k, **v, "files": sorted(v["files"])} for k, v in held.items()], schema=schema)

    for batch in batches:
        for r in batch.to_pylist():
            at = r["pos"]
            of = lambda v: None if v is None else at  # noqa: E731, B023
            part = {
                "low": at, "high": at, "started": r["at"], "ended": r["at"], "cwd_at": of(r["cwd"]), "cwd": r["cwd"], "title_at": of(r["summary"]), "title": r["summary"],
                "asked_at": of(r["asked"]), "asked": r["asked"], "prompts": int(r["asked"] is not None), "actions": r["actions"] or 0, "files": set(r["paths"] or ()),
            }
            key = r["session_id"]
            held[key] = _united(held[key], part) if key in held else part
        if len(held) >= HELD:
            yield given()
            held.clear()
    if held:
        yield given()


def _plain(value):
    """A cell of pandas as Python has it; what is missing as None."""
    return None if value is None or value is pd.NaT or value != value else int(value) if isinstance(value, (int, float)) or hasattr(value, "dtype") else value


class SessionRows(StatefulProcessor):
    """Parts of a session in, its row as it now is out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = handle.getValueState("row", _ROW)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = None
        for some in rows:
            for r in some.to_dict("records"):
                part = {c: _plain(v) for c, v in r.items() if c not in ("session_id", "files")} | {"files": set(r["files"])}
                new = part if new is None else _united(new, part)
        if new is None:
            return
        held = dict(zip((f.split()[0] for f in _ROW.split(", ")), self.row.get(), strict=True)) if self.row.exists() else None
        either = lambda a, b: b if a is None else a
        old = held or {"cwd": None, "title": None, "started": None, "ended": None, "prompts": 0, "actions": 0, "files": [], "high": -1}
        anew = new["low"] <= old["high"]
        row = (
            either(new["cwd"], old["cwd"]), either(either(new["title"], old["title"]), new["asked"]), either(old["started"], new["started"]),
            either(new["ended"], old["ended"]), new["prompts"] + (0 if anew else old["prompts"]), new["actions"] + (0 if anew else old["actions"]),
            sorted(new["files"].union(old["files"])), new["high"],
        )
        self.row.update(row)
        out = pd.DataFrame([(key[0], *row)], columns=[f.split()[0] for f in _OUT.split(", ")])
        yield out.astype({c: "Int64" for c in ("started", "ended", "prompts", "actions", "high")})

    def close(self) -> None:
        pass


def session_rows(lines: DataFrame) -> DataFrame:
    """A stream of `lines(project, source_path, session_id, pos, line)` → rows of sessions as they change. Lines without a session and
    torn lines are left out; `pos` must grow within a session."""
    events = session_events(lines.where("session_id IS NOT NULL AND pos IS NOT NULL"))
    slim = events.select(
        "session_id", F.col("pos").cast("long").alias("pos"), F.unix_micros("at").alias("at"), "cwd", "summary",
        F.substring("asked", 1, FIRST_PROMPT_MOST).alias("asked"), F.col("actions").cast("long").alias("actions"), "paths",
    )
    parts = slim.mapInArrow(_parts, _PART)
    rows = parts.groupBy("session_id").transformWithStateInPandas(SessionRows(), _OUT, "Update", "None")
    return rows.select(
        "session_id", "cwd", "title", F.timestamp_micros("started").alias("started_at"), F.timestamp_micros("ended").alias("ended_at"),
        F.col("prompts").alias("prompt_count"), F.col("actions").alias("action_count"), F.col("files").alias("files_touched"),
    )


def write_sessions(rows: DataFrame, table_path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Start writing changed rows under `table_path`, a folder a batch. Without `every` it takes what is there and ends."""
    spark = rows.sparkSession
    if spark.conf.get(STORE[0], "") != STORE[1]:
        raise ValueError(f"{STORE[0]} must be {STORE[1]}")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table_path}/batch={number}")

    writer = rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def latest_sessions(spark: SparkSession, table_path: str) -> DataFrame:
    """The newest row of each session of a table that `write_sessions` keeps."""
    rows = spark.read.parquet(table_path)
    held = F.struct(*(c for c in rows.columns if c not in ("session_id", "batch")))
    return rows.groupBy("session_id").agg(F.max_by(held, "batch").alias("row")).select("session_id", "row.*")


def transcript_stream(spark: SparkSession, folder: str, project: str, table_path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Start keeping the sessions of growing transcripts (`<session>.jsonl`) under a folder; only what was appended is read."""
    register(spark)
    lines = spark.readStream.format("tail").option("pattern", "*.jsonl").load(folder)
    name = F.regexp_extract("path", r"([^/]+)\.jsonl$", 1)
    return write_sessions(
        session_rows(lines.select(F.lit(project).alias("project"), F.col("path").alias("source_path"), name.alias("session_id"), F.col("byte_offset").alias("pos"), F.col("value").alias("line"))),
        table_path, checkpoint, every,
    )
