"""Keeping derived tables true: point ids, coverage, session rows, recorded calls, resyncs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions.text import NAMESPACE, chunk, deterministic_uuid, route_class


def expected_points(entries: DataFrame) -> DataFrame:
    """entry id, seq and the id of every point an entry must have; entries without chunks have none."""
    rows = entries.select("id", "project", "source_path", F.posexplode(chunk(F.concat("title", F.lit("\n\n"), "body"))).alias("seq", "chunk"))
    return rows.select("id", "seq", deterministic_uuid(NAMESPACE, F.col("project"), F.col("source_path"), F.col("id"), F.col("seq")).alias("point_id"))


def audit(entries: DataFrame, present: DataFrame, collection: str) -> DataFrame:
    """Entries whose coverage mark is wrong: `adopt` those complete but not marked, `clear` those marked but incomplete
    (`partial` tells whether some of their points are there). `present(point_id)` are the points the index holds."""
    met = expected_points(entries).join(present.select("point_id", F.lit(1).alias("here")).dropDuplicates(["point_id"]), "point_id", "left")
    per = met.groupBy("id").agg(F.count(F.lit(1)).alias("wanted"), F.count("here").alias("found"))
    rows = entries.select("id", "vectorized_in").join(per, "id", "left").fillna(0, ["wanted", "found"])
    complete = F.col("wanted") == F.col("found")
    action = F.when(complete & ~F.col("vectorized_in").eqNullSafe(F.lit(collection)), F.lit("adopt")).when(~complete & F.col("vectorized_in").isNotNull(), F.lit("clear"))
    return rows.select("id", action.alias("action"), (~complete & (F.col("found") > 0)).alias("partial")).where("action IS NOT NULL")


def merge_sessions(held: DataFrame, new: DataFrame) -> DataFrame:
    """Session rows after a read: `new` has from_start where the file was read whole. Counts add up unless it was; a new summary is
    the title, else the held one, else the first prompt; the first start and the last end stay; files unite."""
    h, n = held.alias("h"), new.alias("n")
    joined = h.join(n, F.col("h.session_id") == F.col("n.session_id"), "full_outer")
    old = lambda c: F.when(F.coalesce("n.from_start", F.lit(False)), F.lit(0)).otherwise(F.coalesce(f"h.{c}", F.lit(0)))
    files = lambda t: F.coalesce(f"{t}.files_touched", F.array().cast("array<string>"))
    return joined.select(
        F.coalesce("n.session_id", "h.session_id").alias("session_id"), F.coalesce("n.cwd", "h.cwd").alias("cwd"),
        F.coalesce("n.title", "h.title", "n.first_prompt").alias("title"), F.coalesce("h.started_at", "n.started_at").alias("started_at"),
        F.coalesce("n.ended_at", "h.ended_at").alias("ended_at"),
        (old("prompt_count") + F.coalesce("n.prompt_count", F.lit(0))).alias("prompt_count"),
        (old("action_count") + F.coalesce("n.action_count", F.lit(0))).alias("action_count"),
        F.array_sort(F.array_union(files("h"), files("n"))).alias("files_touched"),
    )


# fixed values: lengths recorded fields are cut to
CLAMPS = {"client": 40, "tool": 80, "path": 300, "query": 500}
REPLY_CLAMPS = {"error": 500, "model": 120, "request_id": 120}
TOP_HITS = 5


def recorded(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One batch of calls with an optional `reply` struct → rows of the call table and of the reply table."""
    usage = calls.drop("reply").withColumns({c: F.substring(c, 1, n) for c, n in CLAMPS.items()}).withColumn("route_class", route_class(F.col("path")))
    reply = calls.where("reply IS NOT NULL").select(F.col("id").alias("call_id"), "reply.*")
    cut = {c: F.substring(c, 1, n) for c, n in REPLY_CLAMPS.items() if c in reply.columns}
    if "top_hits" in reply.columns:
        cut["top_hits"] = F.slice("top_hits", 1, TOP_HITS)
    return usage, reply.withColumns(cut)


def resync_routes(usage: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls with the class their path has today, and how many differ from what is held."""
    fresh = usage.withColumn("fresh", route_class(F.col("path")))
    changed = fresh.agg(F.count_if(~F.col("fresh").eqNullSafe(F.col("route_class"))).alias("changed"))
    return fresh.withColumn("route_class", F.col("fresh")).drop("fresh"), changed


def set_meta(entries: DataFrame, changes: DataFrame, key: str = "dedup_key") -> DataFrame:
    """Entries with the `meta` that `changes(key, meta)` gives them."""
    new = changes.select(key, F.col("meta").alias("new_meta"))
    return entries.join(new, key, "left").withColumn("meta", F.coalesce("new_meta", "meta")).drop("new_meta").select(*entries.columns)


def tail_lines(files: DataFrame, state: DataFrame) -> DataFrame:
    """`files(path, content)` of bytes and `state(path, byte_offset)` → path, whole new lines, the next offset. A torn last
    line waits; a file that shrank starts anew without lines."""
    rows = files.join(state, "path", "left").withColumn("at", F.coalesce("byte_offset", F.lit(0)))
    shrunk = F.octet_length("content") < F.col("at")
    fresh = F.substr("content", (F.col("at") + 1).cast("int"), F.octet_length("content"))
    text = F.decode(fresh, "UTF-8")
    whole = F.regexp_extract(text, r"(?s)^(.*\n)", 1)
    lines = F.filter(F.split(whole, "\n"), lambda x: x != "")
    return rows.select(
        "path", F.when(shrunk, F.array().cast("array<string>")).otherwise(lines).alias("lines"),
        F.when(shrunk, F.lit(0)).otherwise(F.col("at") + F.octet_length(whole)).cast("long").alias("byte_offset"),
    )
