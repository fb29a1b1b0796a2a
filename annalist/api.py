"""The engine's surface as functions over one set of tables: what a service or a command line calls.

Parameters are clamped as documented with each call; an unknown project raises ValueError instead of giving nothing.
Answers come as lazy DataFrames. Writing an answer's prose is left to a callback.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions.text import date_window
from annalist.operators import backlog as bl
from annalist.operators import catalog as cat
from annalist.operators import fulltext as ft
from annalist.operators import retrieval as rt
from annalist.operators import telemetry as tel
from annalist.operators.catalog import Filters
from annalist.operators.dense_index import DenseIndex
from annalist.operators.index import SearchIndex

SEARCH_MOST, ASK_MOST, EVIDENCE_MOST, TIMELINE_MOST, DAYS_MOST = 100, 30, 20, 200, 365
REASON_MOST = 200


def clamp(value: int, least: int, most: int) -> int:
    return max(least, min(value, most))


def listed(value: str | None) -> tuple[str, ...]:
    """A parameter that is a JSON array or comma-separated."""
    if not value:
        return ()
    if value.lstrip().startswith("["):
        return tuple(str(v) for v in json.loads(value))
    return tuple(v.strip() for v in value.split(",") if v.strip())


@dataclass
class Engine:
    entries: DataFrame
    projects: DataFrame
    usage: DataFrame
    reply: DataFrame
    sessions: DataFrame | None = None
    vectors: DataFrame | None = None
    backlog_lines: DataFrame | None = None
    verdicts: DataFrame | None = None
    as_of: str = "2024-01-31 00:00:00"
    #: Stored indexes of the entries and of their vectors; without them a search makes its postings anew and scans all vectors.
    index: SearchIndex | None = None
    dense_index: DenseIndex | None = None

    def _known(self, slug: str) -> str:
        if self.projects.where(F.col("slug") == slug).isEmpty():
            raise ValueError(f"unknown project {slug!r}")
        return slug

    def _widened(self, f: Filters) -> Filters:
        if not f.projects:
            return f
        return replace(f, projects=tuple(r["slug"] for r in cat.widen_projects(self.projects, list(f.projects)).collect()))

    def health(self) -> DataFrame:
        return cat.index_stats(self.entries, None).select(F.lit(True).alias("ok"), "entries", "latest")

    def stats(self, collection: str | None = None) -> DataFrame:
        return cat.index_stats(self.entries, collection)

    def list_projects(self) -> DataFrame:
        return cat.project_counts(self.projects, self.entries).orderBy(F.desc("entries"), "slug")

    def search(self, queries: DataFrame, filters: Filters = Filters(), limit: int = 20, mode: str = "hybrid") -> DataFrame:
        """`queries(query_id, text[, embedding])` → hits. `hybrid` needs vectors and embeddings and else becomes
        `sparse-only`; where a search can't be made the next lesser one is: hybrid, sparse-only, fts, which needs no index. `mode` is the
        one taken, `degraded` whether it is less than asked for, `reason` why."""
        limit = clamp(limit, 1, SEARCH_MOST)
        fetch = min(2 * limit, SEARCH_MOST)
        branch = max(3 * fetch, 30)
        narrowed = self._widened(filters)
        rows = self.entries.where(narrowed.column())
        reason, chain = None, ("hybrid", "sparse-only", "fts")
        for taken in chain[chain.index(mode) :]:
            if taken == "hybrid" and ((self.vectors is None and self.dense_index is None) or "embedding" not in queries.columns):
                reason = "no vectors"
                continue
            try:
                hits = self._hits(taken, queries, rows, narrowed, branch, fetch)
                break
            except Exception as failure:  # the caller reads why in `reason`
                if taken == "fts":
                    raise
                reason = f"{taken} failed: {failure}".splitlines()[0][:REASON_MOST]
        out = rt.finalise(rt.hydrate(hits, rows), self.as_of, limit)
        return out.withColumns({"mode": F.lit(taken), "degraded": F.lit(taken != mode), "reason": F.lit(reason).cast("string")})

    def _hits(self, mode: str, queries: DataFrame, rows: DataFrame, filters: Filters, branch: int, fetch: int) -> DataFrame:
        # entries of the index are those of the table; their columns for filters stand beside each posting, so no entry is read here
        where = None if filters == Filters() else filters.column()
        if mode == "fts":
            if self.index:
                return self.index.ranked_search(queries, fetch, where)
            words = ft.entry_words(rows.withColumnRenamed("id", "entry_id"), "entry_id")
            return ft.ranked_search(ft.query_stems(queries), ft.vocabulary(words), words, fetch)
        if self.index:
            branches = [self.index.sparse_search(queries, branch, where)]
        else:
            everything = rt.points(self.entries)
            weights = rt.idf(rt.postings(everything), everything)
            branches = [rt.sparse_search(queries, rt.postings(rt.points(rows)), weights, branch)]
        if mode == "hybrid":
            branches.append(self._near(queries, rows, where is not None, branch).withColumn("seq", F.lit(0)))
        return rt.fuse(branches, fetch)

    def _near(self, queries: DataFrame, rows: DataFrame, filtered: bool, limit: int) -> DataFrame:
        """Hits by vectors: of the stored index where there is one and no filter, which has to hold before ranking; else of a scan."""
        if self.dense_index and not filtered:
            return self.dense_index.search(queries, limit)
        if self.vectors is None:
            raise ValueError("a filtered search by vectors needs the table of vectors")
        return rt.dense_search(queries, self.vectors.join(rows.select(F.col("id").alias("entry_id")), "entry_id", "left_semi"), limit)

    def context(self, queries: DataFrame, filters: Filters = Filters(), k: int = 12) -> DataFrame:
        """Hits for an answer: searched, topped up with explaining sources, reranked. A scoped question without any hit is
        asked again of all projects, told by `widened`."""
        k = clamp(k, 1, ASK_MOST)
        pool = clamp(3 * k, 24, 60)
        found = self.search(queries, filters, pool).withColumn("widened", F.lit(False))
        if filters.projects:
            missed = queries.join(found.select("query_id").distinct(), "query_id", "left_anti")
            found = found.unionByName(self.search(missed, replace(filters, projects=()), pool).withColumn("widened", F.lit(True)))
        if not filters.source_types:
            extra = self.search(queries, replace(filters, source_types=rt.EXPLANATORY), pool).withColumn("widened", F.lit(False))
            found = rt.top_up(found, extra, k)
        return rt.rerank(found, self.as_of, k)

    def ask(self, question: str, filters: Filters = Filters(), k: int = 12, answer: Callable[[str], str] | None = None) -> dict:
        """The prompt and sources of one question, how many entries its dates cover, and an answer if a callback gives one."""
        spark = self.entries.sparkSession
        hits = self.context(spark.createDataFrame([(0, question)], "query_id int, text string"), filters, k)
        sources = [r.asDict() for r in hits.withColumn("block", rt.prompt_block()).orderBy("place").collect()]
        window = spark.range(1).select(date_window(F.lit(question)).alias("w")).first()["w"]
        covered = cat.count_in_window(self.entries, str(window["since"]), str(window["until"])).first().asDict() if window else None
        if not sources:
            return {"answer": "Nothing in the record matches this question.", "sources": [], "coverage": covered, "prompt": ""}
        prompt = "\n\n".join(["Answer from the numbered blocks only and cite them.", *(s["block"] for s in sources), f"Question: {question}"])
        return {"answer": answer(prompt) if answer else None, "sources": sources, "coverage": covered, "prompt": prompt}

    def timeline(self, limit: int = 50, before: tuple[str, int] | None = None, filters: Filters = Filters()) -> DataFrame:
        return cat.timeline(self.entries, clamp(limit, 1, TIMELINE_MOST), before, self._widened(filters))

    def project_components(self, slug: str) -> DataFrame:
        return cat.components(self.entries.where(F.col("project") == self._known(slug))).orderBy(F.desc_nulls_last("last_at"), "component")

    def component(self, slug: str, name: str, limit: int = 100) -> DataFrame:
        return cat.component_history(self.entries, self._known(slug), name, limit)

    def list_sessions(self, limit: int = 50) -> DataFrame:
        if self.sessions is None:
            raise ValueError("no sessions table")
        return self.sessions.orderBy(F.desc_nulls_last("started_at"), "session_id").limit(limit)

    def session(self, session_id: str, offset: int = 0, size: int = 100) -> DataFrame:
        return cat.session_page(self.entries, session_id, offset, size)

    def entry(self, entry_id: int) -> DataFrame:
        return self.entries.where(F.col("id") == entry_id)

    def backlog(self, slug: str, latest_activity: str | None = None) -> DataFrame:
        if self.backlog_lines is None or self.verdicts is None:
            raise ValueError("no backlog tables")
        own = lambda t: t.where(F.col("project") == slug)
        return bl.backlog_view(own(self.backlog_lines), own(self.verdicts), latest_activity or self.as_of)

    def evidence(self, queries: DataFrame, slug: str, k: int = 10) -> DataFrame:
        """Hits that may settle backlog items of one project."""
        wanted = Filters((self._known(slug),), ("changelog", "component", "session", "commit", "transcript"))
        return self.search(queries, wanted, clamp(k, 1, EVIDENCE_MOST)).withColumn("snippet", F.substring("snippet", 1, 300))

    def usage_report(self, days: int = 7, classes: list[str] | None = None) -> dict[str, DataFrame]:
        days = clamp(days, 1, DAYS_MOST)
        rows, every = tel.recent(self.usage, self.as_of, days, classes), tel.recent(self.usage, self.as_of, days)
        return {
            "by_tool": tel.by_tool(rows).orderBy(F.desc("calls"), "client", "tool"), "by_day": tel.by_day(rows), "by_class": tel.by_class(every),
            "by_hour": tel.by_hour(rows), "totals": tel.totals(rows),
        }

    def usage_insights(self, days: int = 7) -> dict[str, DataFrame]:
        rows = tel.recent(self.usage, self.as_of, clamp(days, 1, DAYS_MOST))
        return {
            "ask": tel.ask_insights(rows, self.reply), "search": tel.search_insights(rows, self.reply), "latency": tel.latency_histogram(rows).orderBy("place"),
            "top_queries": tel.top_queries(rows), "models": tel.models(rows, self.reply), "by_weekday": tel.by_weekday(rows),
        }

    def usage_calls(self, size: int = 100, before: tuple[str, int] | None = None, **filters) -> dict[str, DataFrame]:
        """A page, and counts and facets of everything the filters let through (whatever the page)."""
        rows = tel.filter_calls(self.usage, **filters)
        page = tel.call_page(rows, self.reply, size, before)
        return {"page": page, "next": tel.next_cursor(page, max(1, min(size, 500))), "facets": tel.facets(rows), "total": rows.agg(F.count(F.lit(1)).alias("calls"))}

    def call(self, call_id: int) -> DataFrame:
        return self.usage.where(F.col("id") == call_id).join(self.reply, F.col("id") == F.col("call_id"), "left")
