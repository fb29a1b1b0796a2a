"""Browsing and counting entries, projects and sessions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annalist.operators import meta

#: Projects are few (a row a repository); joined by broadcast only below this many, else by shuffle.
FEW_PROJECTS = 100_000


@dataclass(frozen=True)
class Filters:
    """What a search or a list is narrowed to; empty means all. Time bounds are inclusive; 'active' means not archived."""

    projects: tuple[str, ...] = ()
    source_types: tuple[str, ...] = ()
    component: str | None = None
    kind: str | None = None
    doc_status: str | None = None
    since: str | None = None
    until: str | None = None
    #: (path of keys, text) that the VARIANT column `meta` must have; rows need that column only where this is given.
    meta: tuple[tuple[tuple[str, ...], str], ...] = ()

    def column(self) -> Column:
        out = F.lit(True)
        if self.projects:
            out &= F.col("project").isin(*self.projects)
        if self.source_types:
            out &= F.col("source_type").isin(*self.source_types)
        if self.component is not None:
            out &= F.col("component") == self.component
        if self.kind is not None:
            out &= F.col("kind") == self.kind
        if self.doc_status == "archived":
            out &= F.col("doc_status") == "archived"
        elif self.doc_status == "active":
            out &= ~F.col("doc_status").eqNullSafe("archived")
        if self.since:
            out &= F.col("occurred_at") >= F.lit(self.since).cast("timestamp")
        if self.until:
            out &= F.col("occurred_at") <= F.lit(self.until).cast("timestamp")
        for keys, text in self.meta:
            out &= meta.equals(F.col("meta"), keys, text)
        return out


def widen_projects(projects: DataFrame, slugs: list[str]) -> DataFrame:
    """The slugs and, one hop away, the projects that are aliases of them."""
    asked = projects.where(F.col("slug").isin(slugs)).select("slug")
    aliases = projects.where(F.col("alias_of").isin(slugs)).select("slug")
    return asked.union(aliases).distinct()


def project_counts(projects: DataFrame, entries: DataFrame) -> DataFrame:
    counts = entries.groupBy("project").agg(F.count(F.lit(1)).alias("n"))
    return projects.join(counts, projects["slug"] == counts["project"], "left").select("slug", "alias_of", F.coalesce("n", F.lit(0)).alias("entries"))


def coverage(entries: DataFrame, projects: list[str] | None = None) -> DataFrame:
    rows = entries.where(F.col("project").isin(projects)) if projects else entries
    return rows.groupBy("project").agg(F.count(F.lit(1)).alias("entries"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"))


def count_in_window(entries: DataFrame, since: str, until: str, pad_days: int = 3) -> DataFrame:
    """Entries in [since, until], and in that window widened on both sides."""
    low, high, pad = F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp"), F.make_dt_interval(F.lit(pad_days))
    at = F.col("occurred_at")
    return entries.agg(F.count_if(at.between(low, high)).alias("exact"), F.count_if(at.between(low - pad, high + pad)).alias("padded"))


def components(entries: DataFrame) -> DataFrame:
    return entries.where("component IS NOT NULL").groupBy("project", "component").agg(F.count(F.lit(1)).alias("entries"), F.max("occurred_at").alias("last_at"))


def source_detail(entries: DataFrame) -> DataFrame:
    return entries.groupBy("project", "source_type").agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_distinct("source_path").alias("files"),
        F.sum(F.length("body")).alias("characters"),
        F.max("occurred_at").alias("last_at"),
    )


def activity(entries: DataFrame) -> DataFrame:
    return entries.where("occurred_at IS NOT NULL").groupBy(F.date_format("occurred_at", "yyyy-MM-dd").alias("day"), "source_type").agg(F.count(F.lit(1)).alias("entries"))


def index_stats(entries: DataFrame, current: str | None) -> DataFrame:
    """One row of counts. Without a current collection nothing counts as unsearchable."""
    missing = ~F.col("vectorized_in").eqNullSafe(F.lit(current)) if current else F.lit(False)
    return entries.agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_distinct("project").alias("projects"),
        F.count_if(F.col("vectorized_in").isNotNull()).alias("vectorised"),
        F.count_if(missing).alias("unsearchable"),
        F.count_if(F.col("doc_status").eqNullSafe("archived")).alias("archived"),
        F.max("occurred_at").alias("latest"),
    )


def uncovered(entries: DataFrame, current: str) -> DataFrame:
    return entries.where(~F.col("vectorized_in").eqNullSafe(F.lit(current)))


def record_counts(entries: DataFrame, sessions: DataFrame, current: str, up_to: int) -> DataFrame:
    """One row: sessions, entries, those with ids up to `up_to`, those the current collection covers and lacks, archived documents, the latest time."""
    has = F.col("vectorized_in").eqNullSafe(F.lit(current))
    rows = entries.agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(F.col("id") <= up_to).alias("up_to"),
        F.count_if(has).alias("covered"),
        F.count_if(~has).alias("uncovered"),
        F.count_if(F.col("doc_status").eqNullSafe("archived")).alias("archived"),
        F.max("occurred_at").alias("latest"),
    )
    return rows.crossJoin(sessions.agg(F.count(F.lit(1)).alias("sessions")))  # one row each


def with_projects(rows: DataFrame, projects: DataFrame) -> DataFrame:
    """Entries or sessions of known projects, with what their project is an alias of."""
    return rows.join(projects.select(F.col("slug").alias("project"), "alias_of"), "project")


def page_after(entries: DataFrame, cursor: int, limit: int, current: str | None = None, covered: bool | None = None) -> DataFrame:
    """A page by ascending id after the cursor: of all entries, or of those that the current collection covers or lacks."""
    rows = entries.where(F.col("id") > cursor)
    if covered is not None:
        has = F.col("vectorized_in").eqNullSafe(F.lit(current))
        rows = rows.where(has if covered else ~has)
    return rows.orderBy("id").limit(limit)


def newest(rows: DataFrame, limit: int) -> DataFrame:
    """The rows of the highest ids: recent runs, recent errors."""
    return rows.orderBy(F.desc("id")).limit(limit)


def backlog_entries(entries: DataFrame) -> DataFrame:
    """Backlog lines with their place (from 0) in their project: by file, then by id."""
    order = Window.partitionBy("project").orderBy("source_path", "id")
    return entries.where(F.col("source_type") == "backlog").withColumn("place", F.row_number().over(order) - 1)


def timeline(entries: DataFrame, limit: int, before: tuple[str, int] | None = None, filters: Filters = Filters()) -> DataFrame:
    """Dated entries, newest first. The cursor is (time, id), so entries of equal time are never skipped."""
    rows = entries.where(filters.column() & F.col("occurred_at").isNotNull())
    if before:
        at = F.lit(before[0]).cast("timestamp")
        rows = rows.where((F.col("occurred_at") < at) | ((F.col("occurred_at") == at) & (F.col("id") < before[1])))
    return rows.orderBy(F.desc("occurred_at"), F.desc("id")).limit(max(1, min(limit, 200)))


def component_history(entries: DataFrame, project: str, component: str, limit: int = 100) -> DataFrame:
    rows = entries.where((F.col("project") == project) & (F.col("component") == component))
    return rows.orderBy(F.desc_nulls_last("occurred_at"), F.desc("id")).limit(limit)


def session_page(entries: DataFrame, session_id: str, offset: int, size: int) -> DataFrame:
    rows = entries.where(F.col("session_id") == session_id)
    return rows.orderBy(F.asc_nulls_last("occurred_at"), "id").offset(offset).limit(max(1, min(size, 1000)))


def capped(entries: DataFrame, most: int) -> DataFrame:
    """Bodies cut to `most` characters, and whether they were."""
    return entries.withColumn("body_truncated", F.length("body") > most).withColumn("body", F.substring("body", 1, most))


def merge_rows(held: DataFrame, new: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """Upsert: new values win where not null, but columns in `keep` stay as they were on rows already held."""
    left, right = held.alias("h"), new.alias("n")
    joined = left.join(right, [F.col(f"h.{k}") == F.col(f"n.{k}") for k in keys], "full_outer")
    known = F.col(f"h.{keys[0]}").isNotNull()
    out = []
    for c in held.columns:
        latest = F.coalesce(F.col(f"n.{c}"), F.col(f"h.{c}"))
        out.append((F.when(known, F.col(f"h.{c}")).otherwise(latest) if c in keep else latest).alias(c))
    return joined.select(*out)


def new_entries(batch: DataFrame, held: DataFrame, key: str = "dedup_key", order: str | None = None) -> DataFrame:
    """Rows of a batch to append: keys not held yet, each once: of repeats the first by `order` (a column without ties within a
    key), without one the row least by all its columns."""
    row = F.struct(*(c for c in batch.columns if c != key))
    once = batch.groupBy(key).agg((F.min_by(row, order) if order else F.min(row)).alias("row"))
    rows = once.select(key, "row.*").select(*batch.columns)
    return rows.join(held.select(key), key, "left_anti")
