"""Text formats → canonical entries, as native expressions over `files(project, source_path, text)`.

Entries have project, source_type, component, session_id, title, body, occurred_at, source_path, source_ref, meta (JSON
text). Files are read whole where line numbers count; a transcript is read by lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annalist.functions.text import is_archived_path

TITLE, SECTION_LEAST, SECTION_MOST, BODY_MOST, ENTRIES_MOST = 140, 80, 20_000, 8_000, 800


def read_files(spark: SparkSession, path: str, project: str) -> DataFrame:
    """Whole files under a path."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return rows.select(F.lit(project).alias("project"), F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("text"))


def stamp(text: Column) -> Column:
    """`2026-07-08 22:37 UTC` or a bare date as a timestamp of minute precision; anything else null."""
    pattern = r"^(\d{4}-\d{2}-\d{2})(?:[ T](\d{2}:\d{2})(?::\d{2})?\s*(?:UTC)?)?$"
    clean = F.trim(text)
    time = F.regexp_extract(clean, pattern, 2)
    return F.try_to_timestamp(
        F.concat(F.regexp_extract(clean, pattern, 1), F.lit(" "), F.when(time == "", F.lit("00:00")).otherwise(time)), F.lit("yyyy-MM-dd HH:mm")
    )


def _lines(files: DataFrame) -> DataFrame:
    return files.select("*", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).drop("text")


def _entry(rows: DataFrame, source_type: str, title: Column, body: Column, at: Column, *, component=None, session=None, ref=None, meta=None) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select(
        "project", F.lit(source_type).alias("source_type"), (none if component is None else component).alias("component"),
        (none if session is None else session).alias("session_id"), title.alias("title"), body.alias("body"), at.alias("occurred_at"), "source_path",
        (none if ref is None else ref).alias("source_ref"), (none if meta is None else F.to_json(meta)).alias("meta"),
    )


def _ref() -> Column:
    return F.concat(F.lit("line:"), (F.col("pos") + 1).cast("string"))


def changelog(files: DataFrame) -> DataFrame:
    """`- [STATUS] - [stamp] - [task] - [component] - text` lines; other lines are skipped."""
    pattern = r"^-\s*\[([A-Z-]+)\]\s*-\s*\[([^\]]+)\]\s*-\s*\[([^\]]+)\]\s*-\s*\[([^\]]+)\]\s*-\s*(.+)$"
    part = lambda i: F.regexp_extract("line", pattern, i)
    rows = _lines(files).where(F.col("line").rlike(pattern))
    text = F.regexp_replace(F.regexp_replace(part(5), r"^\[", ""), r"\]\s*$", "")
    title = F.concat(F.lit("["), part(1), F.lit("] "), part(3), F.lit(" — "), F.substring(text, 1, TITLE))
    meta = F.struct(part(1).alias("status"), part(3).alias("taskType"))
    return _entry(rows, "changelog", title, text, stamp(part(2)), component=F.trim(part(4)), ref=_ref(), meta=meta)


def _blocks(files: DataFrame) -> DataFrame:
    """Blocks between lone `---` lines."""
    rows = files.select("*", F.explode(F.split("text", r"(?m)^---\s*$", -1)).alias("raw")).drop("text")
    return rows.withColumn("block", F.regexp_replace("raw", r"^\s+|\s+$", ""))


def session_log(files: DataFrame) -> DataFrame:
    """`### [stamp]` blocks; the title is the prompt summary, else the block."""
    head = r"^###\s*\[([^\]]+)\]"
    rows = _blocks(files).where(F.col("block").rlike(head))
    said = F.regexp_extract("block", r"(?s)\*\*User Prompt Summary:\*\*\s*\n>\s*(.*?)(?=\n\*\*|$)", 1)
    flat = F.substring(F.trim(F.regexp_replace(F.when(said != "", said).otherwise(F.col("block")), r"\s+", " ")), 1, TITLE)
    day = F.regexp_extract("block", head, 1)
    return _entry(rows, "session", F.when(flat == "", F.concat(F.lit("Session "), day)).otherwise(flat), F.col("block"), stamp(day))


def component_log(files: DataFrame) -> DataFrame:
    """`### [stamp] - title` blocks of a component's file, named after the file."""
    head = r"^###\s*\[([^\]]+)\]\s*-\s*(.*)"
    rows = _blocks(files).where(F.col("block").rlike(head))
    name = F.regexp_replace(F.element_at(F.split("source_path", "/"), -1), r"\.[^.]+$", "")
    title = F.substring(F.trim(F.regexp_replace(F.regexp_extract("block", head, 2), r"[\[\]]", "")), 1, TITLE)
    status = F.regexp_extract("block", r"\*\*Status:\*\*\s*\n?-?\s*([A-Za-z-]+)", 1)
    meta = F.struct(F.when(status != "", status).alias("status"))
    return _entry(rows, "component", F.concat(name, F.lit(": "), title), F.col("block"), stamp(F.regexp_extract("block", head, 1)), component=name, meta=meta)


def line_hash(line: Column) -> Column:
    """First six hex digits of the SHA-256 of a line without its trailing white space."""
    return F.substring(F.sha2(F.regexp_replace(line, r"\s+$", ""), 256), 1, 6)


def marker(text: Column) -> Column:
    """struct(kind, target_line, target_hash, legacy) of a line that settles another line; null for work items."""
    named, legacy = r"^(RESOLVED|DROPPED|REOPENED)\s*\[L(\d+)(?:#([0-9a-fA-F]{6}))?\]\s*:", r"^(DONE|RESOLVED|FIXED|WONTFIX|OBSOLETE)\s*:"
    tag = F.regexp_extract(text, named, 3)
    word = F.regexp_extract(text, legacy, 1)
    none = F.lit(None)
    structured = F.struct(
        F.lower(F.regexp_extract(text, named, 1)).alias("kind"), F.regexp_extract(text, named, 2).cast("int").alias("target_line"),
        F.when(tag != "", F.lower(tag)).alias("target_hash"), F.lit(False).alias("legacy"),
    )
    old = F.struct(
        F.when(word.isin("WONTFIX", "OBSOLETE"), F.lit("dropped")).otherwise(F.lit("resolved")).alias("kind"),
        none.cast("int").alias("target_line"), none.cast("string").alias("target_hash"), F.lit(True).alias("legacy"),
    )
    return F.when(text.rlike(named), structured).when(text.rlike(legacy), old)


def backlog(files: DataFrame) -> DataFrame:
    """Every line that is neither blank nor a heading; undated lines are marked unstructured."""
    pattern = r"^-\s*\[(\d{4}-\d{2}-\d{2})\]\s*(?:\[([^\]]+)\])?\s*(.+)$"
    rows = _lines(files).where((F.trim("line") != "") & ~F.trim("line").startswith("#"))
    dated = F.col("line").rlike(pattern)
    part = lambda i: F.regexp_extract("line", pattern, i)
    loose = F.trim(F.regexp_replace("line", r"^\s*-\s*", ""))
    body = F.when(dated, F.trim(part(3))).otherwise(loose)
    component = F.when(dated & (part(2) != ""), F.trim(part(2)))
    meta = F.struct(line_hash(F.col("line")).alias("lineHash"), marker(body).alias("marker"), F.when(~dated, F.lit(True)).alias("unstructured"))
    return _entry(rows, "backlog", F.substring(body, 1, TITLE), body, F.when(dated, stamp(part(1))), component=component, ref=_ref(), meta=meta)


def git_log(files: DataFrame) -> DataFrame:
    """`\\x01sha\\x1fdate\\x1fauthor\\x1fsubject` records with name-status lines; a rename counts as its new path."""
    rows = files.select("*", F.explode(F.split("text", "\u0001", -1)).alias("record")).drop("text")
    lines = F.split("record", "\n", -1)
    head = F.split(F.get(lines, F.lit(0)), "\u001f", -1)
    sha, date, author, subject = (F.get(head, F.lit(i)) for i in range(4))
    files_of = F.transform(F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: x.contains("\t")), lambda x: F.element_at(F.split(x, "\t"), -1))
    rows = rows.where((F.coalesce(sha, F.lit("")) != "") & (F.coalesce(date, F.lit("")) != ""))
    listed = F.array_join(F.slice(files_of, 1, 100), "\n")
    body = F.concat_ws("\n", subject, F.concat(F.lit("Author: "), author), F.when(F.size(files_of) > 0, F.concat(F.lit("Files:\n"), listed)))
    meta = F.struct(sha.alias("sha"), author.alias("author"), F.slice(files_of, 1, 100).alias("files"))
    return _entry(rows, "commit", F.substring(subject, 1, TITLE), body, F.try_to_timestamp(date), ref=sha, meta=meta)


def markdown(files: DataFrame) -> DataFrame:
    """Sections cut at every `#` or `##` heading, without front matter; short ones are left out."""
    clean = F.regexp_replace("text", r"(?s)\A---\n.*?\n---\n", "")
    rows = files.select("*", F.explode(F.split(clean, r"(?m)(?=^#{1,2}\s)", -1)).alias("section")).drop("text")
    body = F.trim(F.regexp_replace("section", r"^\s+|\s+$", ""))
    heading = F.regexp_extract("section", r"^#{1,2}\s+(.*)", 1)
    name = F.regexp_replace(F.element_at(F.split("source_path", "/"), -1), r"\.[^.]+$", "")
    title = F.when(heading != "", F.trim(heading)).otherwise(name)
    slug = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    meta = F.struct(F.when(is_archived_path(F.col("source_path")), F.lit("archived")).alias("docStatus"))
    rows = rows.where(F.length(body) >= SECTION_LEAST)
    return _entry(rows, "doc", F.substring(title, 1, TITLE), F.substring(body, 1, SECTION_MOST), F.lit(None).cast("timestamp"), ref=F.concat(F.lit("#"), slug), meta=meta)


def is_noise(prompt: Column) -> Column:
    t = F.regexp_replace(prompt, r"^\s+", "")
    return (F.length(t) < 3) | t.startswith("<") | t.startswith("Caveat:") | t.startswith("[Request interrupted")


def prompt_kind(text: Column) -> Column:
    plan = r"(?im)(^(implement|execute) the following plan\b|^#+\s|\bhere is the (plan|spec)\b)"
    return F.when(F.substring(text, 1, 400).rlike(plan), F.lit("plan")).otherwise(F.lit("prompt"))


def reply_kind(text: Column) -> Column:
    return (
        F.when(text.rlike(r"★\s*Insight"), F.lit("insight"))
        .when(text.rlike(r"(?im)(^#{1,3}\s*Summary\b|^\*\*What I did\*\*)"), F.lit("summary"))
        .otherwise(F.lit("response"))
    )


_BLOCK = "type STRING, text STRING, name STRING, input STRING"
_EVENT = "type STRING, timestamp STRING, cwd STRING, summary STRING, message STRING"
# fixed values: tools whose calls say what was done
EDITS = ("Edit", "Write", "MultiEdit", "NotebookEdit")
ACTIONS = (*EDITS, "Bash", "Task", "Agent", "Skill")
# fixed value: characters of a first prompt
FIRST_PROMPT_MOST = 120


def transcript_events(lines: DataFrame) -> DataFrame:
    """`lines(project, source_path, session_id, pos, line)` of JSON → parsed events; torn lines are left out.

    A message's content is a string or a list of blocks; both become `blocks`.
    """
    parsed = lines.withColumn("e", F.from_json("line", _EVENT)).where(F.col("e.type").isNotNull())
    content = F.get_json_object("e.message", "$.content")
    listed = F.from_json(content, f"ARRAY<STRUCT<{_BLOCK.replace(' STRING', ': STRING')}>>")
    single = F.array(F.struct(F.lit("text").alias("type"), content.alias("text"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("input")))
    blocks = F.when(content.startswith("["), F.coalesce(listed, single)).otherwise(single)
    return parsed.select(
        "project", "source_path", "session_id", "pos", F.col("e.type").alias("type"), F.try_to_timestamp("e.timestamp").alias("at"),
        F.col("e.cwd").alias("cwd"), F.col("e.summary").alias("summary"), F.when(content.isNotNull(), blocks).alias("blocks"), content.startswith("[").alias("listed"),
    )


def _target(b: Column) -> Column:
    of = lambda k: F.get_json_object(b["input"], f"$.{k}")
    command = F.substring(F.trim(F.substring_index(of("command"), "\n", 1)), 1, 80)
    return F.coalesce(of("file_path"), of("notebook_path"), command, F.substring(of("description"), 1, 80), of("skill"))


def transcript(lines: DataFrame) -> DataFrame:
    """Prompts, replies and one action entry a turn, at most ENTRIES_MOST a session."""
    events = transcript_events(lines)
    texts = F.filter("blocks", lambda b: (b["type"] == "text") & (F.coalesce(b["text"], F.lit("")) != ""))
    said = F.array_join(F.transform(texts, lambda b: b["text"]), "\n\n")
    tools = F.filter("blocks", lambda b: (b["type"] == "tool_use") & b["name"].isin(*ACTIONS))
    done = F.array_join(F.transform(tools, lambda b: F.concat_ws(" ", b["name"], _target(b))), "\n")
    label = F.when(F.col("type") == "user", prompt_kind(F.col("said"))).otherwise(reply_kind(F.col("said")))
    rows = events.where("blocks IS NOT NULL AND type IN ('user', 'assistant')").withColumn("said", said).withColumn("done", done)
    talk = rows.where((F.trim("said") != "") & ((F.col("type") != "user") | ~is_noise(F.col("said")))).withColumn("kind", label).withColumn("what", F.col("said"))
    acts = rows.where((F.col("type") == "assistant") & (F.col("done") != "")).withColumn("kind", F.lit("action")).withColumn("what", F.col("done"))
    every = talk.unionByName(acts)
    order = Window.partitionBy("source_path", "session_id").orderBy("pos", (F.col("kind") == "action").cast("int"))
    kept = every.withColumn("n", F.row_number().over(order)).where(F.col("n") <= ENTRIES_MOST)
    title = F.substring(F.trim(F.regexp_replace("what", r"\s+", " ")), 1, TITLE)
    return _entry(kept, "transcript", title, F.substring("what", 1, BODY_MOST), F.col("at"), session=F.col("session_id"), ref=_ref(), meta=F.struct("kind"))


def session_events(lines: DataFrame) -> DataFrame:
    """What each line says of its session: pos, at, cwd, summary, the prompt (`asked`, null if none), `actions` and `paths` touched."""
    events = transcript_events(lines)
    prose = F.array_join(F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: b["text"]), "\n\n")
    rows = events.withColumn("prose", prose).withColumn("tools", F.filter("blocks", lambda b: (b["type"] == "tool_use") & b["name"].isin(*ACTIONS)))
    asked = (F.col("type") == "user") & (F.coalesce("prose", F.lit("")) != "") & ~is_noise(F.coalesce("prose", F.lit("")))
    paths = F.transform(F.filter("tools", lambda b: b["name"].isin(*EDITS)), _target)
    return rows.select(
        "project", "source_path", "session_id", "pos", "at", "cwd", "summary", F.when(asked, F.col("prose")).alias("asked"),
        F.when(F.col("tools").isNotNull(), F.size("tools")).alias("actions"), F.filter(paths, lambda p: p.isNotNull()).alias("paths"),
    )


def sessions(lines: DataFrame) -> DataFrame:
    """One row a session, folded over all its lines: times, folder, title, counts, files touched."""
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("pos")))
    return session_events(lines).groupBy("project", "source_path", "session_id").agg(
        first("cwd").alias("cwd"), first("summary").alias("title"), F.substring(first("asked"), 1, FIRST_PROMPT_MOST).alias("first_prompt"),
        F.min("at").alias("started_at"), F.max("at").alias("ended_at"), F.count_if(F.col("asked").isNotNull()).alias("prompt_count"),
        F.coalesce(F.sum("actions"), F.lit(0)).alias("action_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("paths")))).alias("files_touched"),
    )


def changed(listing: DataFrame, state: DataFrame, full: bool = False) -> DataFrame:
    """Files of `listing(path, mtime_ms, size)` that `state` doesn't hold as they are."""
    if full:
        return listing
    s = state.select("path", F.col("mtime_ms").alias("m"), F.col("size").alias("z"))
    joined = listing.join(s, "path", "left")
    return joined.where(F.col("m").isNull() | (F.col("m") != F.floor("mtime_ms")) | (F.col("z") != F.col("size"))).drop("m", "z")


def match_folder(folders: DataFrame, projects: DataFrame) -> DataFrame:
    """`folders(dir)` of transcripts → the deepest of `projects(slug, encoded)` whose encoded path is the folder or a parent of it.

    A folder is matched by all of its prefixes that end before a dash, so this is an equi-join on the prefix.
    """
    dashes = F.filter(F.sequence(F.lit(1), F.length("dir") + 1), lambda i: (i == F.length("dir") + 1) | (F.substr(F.col("dir"), i, F.lit(1)) == "-"))
    prefixes = folders.select("dir", F.explode(F.transform(dashes, lambda i: F.substr(F.col("dir"), F.lit(1), i - 1))).alias("encoded")).distinct()
    return prefixes.join(projects, "encoded").groupBy("dir").agg(F.max_by("slug", F.length("encoded")).alias("slug"))


def resolve_alias(ghosts: DataFrame, projects: DataFrame) -> DataFrame:
    """`ghosts(slug)` → the longest `projects(slug)` that the slug ends with after a dash, by equi-join on suffixes."""
    at = F.filter(F.sequence(F.lit(1), F.length("slug")), lambda i: F.substr(F.col("slug"), i, F.lit(1)) == "-")
    suffixes = ghosts.select(F.col("slug").alias("ghost"), F.explode(F.transform(at, lambda i: F.substr(F.col("slug"), i + 1))).alias("slug"))
    return suffixes.join(projects.select("slug"), "slug").groupBy("ghost").agg(F.max_by("slug", F.length("slug")).alias("alias_of"))
