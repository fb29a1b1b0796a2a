"""Usage telemetry over `usage` (one row a call) and `reply` (at most one row a call); the clock is a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERY, READ, WRITE = "query", "read", "write"
LATENCY_BUCKETS = ((100, "<100ms"), (500, "100-500ms"), (1000, "0.5-1s"), (3000, "1-3s"), (10000, "3-10s"), (30000, "10-30s"), (None, ">30s"))


def tool_or_path() -> Column:
    return F.coalesce("tool", "path")


def recent(usage: DataFrame, as_of: str, days: int, classes: list[str] | None = None) -> DataFrame:
    """Calls after `as_of` less so many days; no classes means all."""
    since = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    rows = usage.where(F.col("called_at") > since)
    return rows.where(F.col("route_class").isin(classes)) if classes else rows


def _quantile(p: float, column: str = "duration_ms") -> Column:
    return F.expr(f"percentile_cont({p}) WITHIN GROUP (ORDER BY {column})")


def _errors() -> Column:
    return F.count_if(F.col("status") >= 400)


def by_tool(usage: DataFrame) -> DataFrame:
    return usage.groupBy("client", tool_or_path().alias("tool")).agg(
        F.count(F.lit(1)).alias("calls"),
        F.round(F.avg("duration_ms"), 6).alias("avg_ms"),
        F.round(_quantile(0.5), 6).alias("p50_ms"),
        F.round(_quantile(0.95), 6).alias("p95_ms"),
        F.max("duration_ms").alias("max_ms"),
        _errors().alias("errors"),
        F.max("called_at").alias("last_at"),
    )


def by_day(usage: DataFrame) -> DataFrame:
    return usage.groupBy(F.date_format("called_at", "yyyy-MM-dd").alias("day"), "client").agg(F.count(F.lit(1)).alias("calls"))


def by_class(usage: DataFrame) -> DataFrame:
    return usage.groupBy("route_class").agg(F.count(F.lit(1)).alias("calls"), _errors().alias("errors"), F.round(_quantile(0.5), 6).alias("p50_ms"))


def by_hour(usage: DataFrame) -> DataFrame:
    return usage.groupBy(F.hour("called_at").alias("hour")).agg(F.count(F.lit(1)).alias("calls"))


def by_weekday(usage: DataFrame) -> DataFrame:
    """ISO days of the week, 1 being Monday."""
    return usage.groupBy(F.expr("extract(DAYOFWEEK_ISO FROM called_at)").alias("dow")).agg(F.count(F.lit(1)).alias("calls"))


def totals(usage: DataFrame) -> DataFrame:
    return usage.agg(
        F.count(F.lit(1)).alias("calls"),
        _errors().alias("errors"),
        F.count_distinct("client").alias("clients"),
        F.round(F.coalesce(_quantile(0.5), F.lit(0.0)), 6).alias("p50_ms"),
        F.round(F.coalesce(_quantile(0.95), F.lit(0.0)), 6).alias("p95_ms"),
    )


def facets(usage: DataFrame, most_tools: int = 25) -> DataFrame:
    """Calls by client, and by tool for the most called ones."""
    clients = usage.groupBy(F.lit("client").alias("facet"), F.col("client").alias("value")).agg(F.count(F.lit(1)).alias("calls"))
    tools = usage.groupBy(F.lit("tool").alias("facet"), tool_or_path().alias("value")).agg(F.count(F.lit(1)).alias("calls"))
    return clients.unionByName(tools.orderBy(F.desc("calls"), "value").limit(most_tools))


def ask_insights(usage: DataFrame, reply: DataFrame) -> DataFrame:
    asks = usage.where(F.col("path").isin("/api/ask", "/api/ask/stream")).join(reply, F.col("id") == F.col("call_id"), "left")
    return asks.agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.col("status") == 499).alias("aborted"),
        F.count_if(F.col("status") >= 500).alias("failed"),
        F.count_if("degraded").alias("degraded"),
        F.count_if(F.col("result_count") == 0).alias("zero_source"),
        F.round(_quantile(0.5), 6).alias("p50_ms"),
        F.round(_quantile(0.95), 6).alias("p95_ms"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"),
        F.round(F.avg("ttft_ms"), 6).alias("avg_ttft_ms"),
    )


def search_insights(usage: DataFrame, reply: DataFrame) -> DataFrame:
    rows = usage.where(F.col("path") == "/api/search").join(reply, F.col("id") == F.col("call_id"), "left")
    return rows.agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.col("result_count") == 0).alias("zero_result"),
        F.round(_quantile(0.5), 6).alias("p50_ms"),
        F.round(_quantile(0.95), 6).alias("p95_ms"),
        F.round(_quantile(0.5, "result_count"), 6).alias("median_results"),
    )


def latency_histogram(usage: DataFrame) -> DataFrame:
    bucket, order = F.lit(LATENCY_BUCKETS[-1][1]), F.lit(len(LATENCY_BUCKETS) - 1)
    for n, (below, name) in reversed(list(enumerate(LATENCY_BUCKETS[:-1]))):
        bucket, order = F.when(F.col("duration_ms") < below, F.lit(name)).otherwise(bucket), F.when(F.col("duration_ms") < below, F.lit(n)).otherwise(order)
    rows = usage.where(F.col("route_class").isin(QUERY, READ, WRITE))
    return rows.groupBy(bucket.alias("bucket"), order.alias("place")).agg(F.count(F.lit(1)).alias("calls"))


def top_queries(usage: DataFrame, most: int = 15) -> DataFrame:
    rows = usage.where((F.col("route_class") == QUERY) & (F.col("query") != ""))
    return rows.groupBy("query").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("calls"), F.max("called_at").alias("last_at")).orderBy(
        F.desc("calls"), F.desc("last_at"), "query"
    ).limit(most)


def models(usage: DataFrame, reply: DataFrame) -> DataFrame:
    rows = reply.join(usage.select("id"), F.col("id") == F.col("call_id")).where("model IS NOT NULL")
    return rows.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"))


def filter_calls(
    usage: DataFrame,
    client: str | None = None,
    tool: str | None = None,
    classes: list[str] | None = None,
    failed: bool | None = None,
    since: str | None = None,
    until: str | None = None,
    contains: str | None = None,
    hide_noise: bool = False,
) -> DataFrame:
    """Filters of the call list: `since` inclusive, `until` exclusive; `contains` is a case-blind LIKE, % and _ being wildcards."""
    rows = usage
    if client:
        rows = rows.where(F.col("client") == client)
    if tool:
        rows = rows.where(tool_or_path() == tool)
    if classes:
        rows = rows.where(F.col("route_class").isin(classes))
    if failed is not None:
        rows = rows.where(F.col("status") >= 400 if failed else F.col("status") < 400)
    if since:
        rows = rows.where(F.col("called_at") >= F.lit(since).cast("timestamp"))
    if until:
        rows = rows.where(F.col("called_at") < F.lit(until).cast("timestamp"))
    if contains:
        rows = rows.where(F.col("query").ilike(f"%{contains}%"))
    if hide_noise:
        rows = rows.where((F.col("path") != "/api/projects") & (F.coalesce("query", F.lit("")) != ""))
    return rows


def call_page(calls: DataFrame, reply: DataFrame, size: int, before: tuple[str, int] | None = None) -> DataFrame:
    """A page of the newest calls before the cursor (called_at, id), told whether each has a reply."""
    if before:
        at, last = F.lit(before[0]).cast("timestamp"), before[1]
        calls = calls.where((F.col("called_at") < at) | ((F.col("called_at") == at) & (F.col("id") < last)))
    page = calls.orderBy(F.desc("called_at"), F.desc("id")).limit(max(1, min(size, 500)))
    has = reply.select(F.col("call_id"), F.lit(True).alias("found")).dropDuplicates(["call_id"])
    return page.join(has, page["id"] == has["call_id"], "left").drop("call_id").withColumn("has_reply", F.coalesce("found", F.lit(False))).drop("found")


def daily_complete(usage: DataFrame, first: str, last: str) -> DataFrame:
    """Calls of every calendar day, 0 where there were none."""
    days = usage.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    counts = usage.groupBy(F.to_date("called_at").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return days.join(F.broadcast(counts.where(F.col("d").between(first, last))), F.col("day") == F.col("d"), "left").select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("n", F.lit(0)).alias("calls")
    )


def hour_strip(usage: DataFrame) -> DataFrame:
    """Calls of each of the 24 hours of the day, 0 where there were none."""
    counts = usage.groupBy(F.hour("called_at").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    hours = usage.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(counts, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("calls"))


def iso_weekdays(usage: DataFrame) -> DataFrame:
    """Calls of each weekday, Monday being 1, 0 where there were none."""
    counts = usage.groupBy((F.weekday("called_at") + 1).alias("weekday")).agg(F.count(F.lit(1)).alias("n"))
    days = usage.sparkSession.range(1, 8).select(F.col("id").cast("int").alias("weekday"))
    return days.join(counts, "weekday", "left").select("weekday", F.coalesce("n", F.lit(0)).alias("calls"))


def next_cursor(page: DataFrame, size: int) -> DataFrame:
    """(called_at, id) after which the next page of calls begins; no row where this page isn't full."""
    last = page.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("called_at", "id")).alias("last"))
    return last.where(F.col("n") >= size).select("last.called_at", "last.id")


def prune(usage: DataFrame, reply: DataFrame, as_of: str, days: int) -> tuple[DataFrame, DataFrame]:
    """Calls not older than so many days, and the replies of those calls."""
    kept = usage.where(F.col("called_at") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days)))
    return kept, reply.join(kept.select(F.col("id").alias("call_id")), "call_id", "left_semi")
