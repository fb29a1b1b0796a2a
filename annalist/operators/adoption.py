"""How often assistants use a tool where their words say they should have.

Input: `turns(session_id, project, pos, role, text, tool, tool_input, at)`, a row per text or tool call in order. A rule is
a pattern over assistant text for one tool; a session that meets a rule and never calls the tool missed it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LOOKUP = r"\b(?:git log|git show|git blame|git diff|rg |grep -)"
LEAST_TURNS, LEAST_SESSIONS = 5, 10


@dataclass(frozen=True)
class Rule:
    name: str
    tool: str
    pattern: str
    after_lookup: bool = False


def sessions(turns: DataFrame, rules: list[Rule], tools: dict[str, str]) -> DataFrame:
    """One row a session: turns, calls of each tool (by the pattern of its name), rules met by their first match."""
    order = Window.partitionBy("session_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    looked = F.coalesce(F.max(F.coalesce(F.col("tool_input").rlike(LOOKUP), F.lit(False)).cast("int")).over(order), F.lit(0)) == 1
    rows = turns.withColumn("looked", looked)
    said = (F.col("role") == "assistant") & F.col("text").isNotNull()
    hits = [F.when(said & F.col("text").rlike(r.pattern) & (F.col("looked") if r.after_lookup else F.lit(True)), F.col("pos")) for r in rules]
    first = F.filter(
        F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.tool).alias("tool"), F.min(h).alias("pos")) for r, h in zip(rules, hits, strict=True))),
        lambda x: x["pos"].isNotNull(),
    )
    return rows.groupBy("session_id").agg(
        F.min("project").alias("project"),
        F.count_if(F.col("role") == "assistant").alias("turns"),
        F.min("at").alias("started_at"),
        *(F.count_if(F.coalesce(F.col("tool").rlike(p), F.lit(False))).alias(f"calls_{t}") for t, p in tools.items()),
        first.alias("met"),
    )


def narrowed(rows: DataFrame, project: str | None = None, since: str | None = None, until: str | None = None, least_turns: int = LEAST_TURNS) -> DataFrame:
    """Sessions of a project long enough to count; `until` is exclusive, so windows partition time."""
    out = rows.where(F.col("turns") >= least_turns)
    if project:
        out = out.where(F.col("project").contains(project))
    if since:
        out = out.where(F.col("started_at") >= F.lit(since).cast("timestamp"))
    if until:
        out = out.where(F.col("started_at") < F.lit(until).cast("timestamp"))
    return out


def report(rows: DataFrame, tools: list[str]) -> DataFrame:
    """Per tool: sessions that used it, that missed it, and used / (used + missed); null without an occasion."""
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("name"), F.col(f"calls_{t}").alias("calls")) for t in tools))).alias("t")
    flat = rows.select("met", each).select(
        F.col("t.name").alias("tool"), (F.col("t.calls") > 0).alias("used"), F.exists("met", lambda m: m["tool"] == F.col("t.name")).alias("due")
    )
    used, missed = F.count_if("used"), F.count_if(~F.col("used") & F.col("due"))
    return flat.groupBy("tool").agg(
        F.count(F.lit(1)).alias("sessions"), used.alias("used"), missed.alias("missed"), F.round(F.try_divide(used, used + missed), 3).alias("fire_rate")
    )


def missed_rules(rows: DataFrame, tools: list[str]) -> DataFrame:
    calls = F.map_from_arrays(F.array(*(F.lit(t) for t in tools)), F.array(*(F.col(f"calls_{t}") for t in tools)))
    met = rows.select(calls.alias("calls"), F.explode("met").alias("m")).where(F.col("calls")[F.col("m.tool")] == 0)
    return met.groupBy("m.rule").agg(F.count(F.lit(1)).alias("sessions"))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two reports side by side; a change means something only with LEAST_SESSIONS sessions in both."""
    b = before.select("tool", F.col("sessions").alias("n_before"), F.col("fire_rate").alias("rate_before"))
    a = after.select("tool", F.col("sessions").alias("n_after"), F.col("fire_rate").alias("rate_after"))
    enough = (F.coalesce("n_before", F.lit(0)) >= LEAST_SESSIONS) & (F.coalesce("n_after", F.lit(0)) >= LEAST_SESSIONS)
    return b.join(a, "tool", "full_outer").select("*", F.round(F.col("rate_after") - F.col("rate_before"), 3).alias("delta"), enough.alias("significant"))
