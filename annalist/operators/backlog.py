"""The state of backlog items from the markers and reviews that speak of them.

Input: `lines(project, path, line, body, component, line_hash, at, marker)` with `marker` as the reader gives it, and
`verdicts(project, path, line, status, reviewed_at)`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annalist.functions.text import token_containment

LEAST_MATCH, MISMATCH, NEAR_TIE = 0.5, 0.2, 0.1
_FILE = ["project", "path"]
_PREFIX = r"^((RESOLVED|DROPPED|REOPENED)\s*\[[^\]]*\]\s*:\s*|(DONE|RESOLVED|FIXED|WONTFIX|OBSOLETE)\s*:\s*)"


def split_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Work items, and markers."""
    items = lines.where("marker IS NULL").drop("marker")
    markers = lines.where("marker IS NOT NULL").select(
        *_FILE, F.col("line").alias("marker_line"), F.col("at").alias("marker_at"), F.regexp_replace("body", _PREFIX, "").alias("summary"),
        F.col("component").alias("marker_component"), "marker.kind", "marker.target_line", "marker.target_hash", "marker.legacy",
    )
    return items, markers


def link_markers(lines: DataFrame, threshold: float = LEAST_MATCH) -> DataFrame:
    """Markers with the item line they settle (null if none), how it was found, and what is wrong with the reference.

    `ref`: the line named, its hash equal or not given. `relocated`: exactly one item has the hash. `fuzzy`: the earlier
    item that contains most of the marker's words, those of its component before others, unless another comes within NEAR_TIE.
    """
    items, markers = split_lines(lines)
    named = markers.where("NOT legacy")
    by_line = items.select(*_FILE, F.col("line").alias("target_line"), F.col("line_hash").alias("found_hash"), F.col("body").alias("found"))
    met = named.join(by_line, [*_FILE, "target_line"], "left")
    good = F.col("found").isNotNull() & (F.col("target_hash").isNull() | (F.col("target_hash") == F.col("found_hash")))
    by_hash = items.groupBy(*_FILE, F.col("line_hash").alias("target_hash")).agg(F.count(F.lit(1)).alias("same"), F.min("line").alias("moved_to"))
    met = met.join(by_hash, [*_FILE, "target_hash"], "left")
    moved = F.col("same") == 1
    mismatch = F.col("target_hash").isNull() & (token_containment(F.col("summary"), F.col("found")) < MISMATCH)
    structured = met.select(
        *_FILE, "marker_line", "marker_at", "kind", "legacy",
        F.when(good, F.col("target_line")).when(moved, F.col("moved_to")).alias("line"),
        F.when(good, F.lit("ref")).when(moved, F.lit("relocated")).otherwise(F.lit("broken-link")).alias("how"),
        F.when(good & mismatch, F.lit("ref-mismatch")).when(~good & moved, F.lit("relocated")).when(~good, F.lit("broken-link")).alias("lint"),
    )

    old = markers.where("legacy")
    earlier = items.select(*_FILE, "line", "body", "component")
    pairs = old.join(earlier, _FILE).where(F.col("line") < F.col("marker_line")).withColumn("score", F.round(token_containment(F.col("summary"), F.col("body")), 9))
    pairs = pairs.where(F.col("score") >= threshold).withColumn("own", F.coalesce(F.col("component") == F.col("marker_component"), F.lit(False)))
    each = Window.partitionBy(*_FILE, "marker_line")
    pairs = pairs.withColumn("any_own", F.max(F.col("own").cast("int")).over(each)).where((F.col("any_own") == 0) | F.col("own"))
    order = each.orderBy(F.desc("score"), "line")
    best = pairs.withColumn("n", F.row_number().over(order)).withColumn("next", F.lead("score").over(order)).where("n = 1")
    best = best.withColumn("tie", F.coalesce(F.col("score") - F.col("next") < NEAR_TIE, F.lit(False)))
    found = best.select(*_FILE, "marker_line", "line", "tie")
    fuzzy = old.join(found, [*_FILE, "marker_line"], "left").select(
        *_FILE, "marker_line", "marker_at", "kind", "legacy",
        F.when(~F.col("tie"), F.col("line")).alias("line"),
        F.when(F.col("line").isNull(), F.lit("unlinked")).when(F.col("tie"), F.lit("ambiguous")).otherwise(F.lit("fuzzy")).alias("how"),
        F.lit(None).cast("string").alias("lint"),
    )
    return structured.unionByName(fuzzy)


def latest_verdicts(verdicts: DataFrame) -> DataFrame:
    """The latest review of each line; of several at one time the first by `seq` if there is such a column, then by status."""
    ties = ["seq", "status"] if "seq" in verdicts.columns else ["status"]
    order = Window.partitionBy(*_FILE, "line").orderBy(F.desc("reviewed_at"), *ties)
    return verdicts.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def backlog_view(lines: DataFrame, verdicts: DataFrame, latest_activity: str, threshold: float = LEAST_MATCH) -> DataFrame:
    """Every item with its status, where that comes from, and lints. The last marker of an item counts; a review wins
    over it when it is of a later day (or there is no marker)."""
    items, _ = split_lines(lines)
    linked = link_markers(lines, threshold).where("line IS NOT NULL")
    last = linked.groupBy(*_FILE, "line").agg(
        F.max_by(F.struct("kind", "marker_at", "how"), "marker_line").alias("m"), F.count(F.lit(1)).alias("markers"),
        F.array_sort(F.collect_set("lint")).alias("lints"), F.max((F.col("kind") == "resolved").cast("int")).alias("resolved_once"),
    )
    review = latest_verdicts(verdicts).select(*_FILE, "line", F.col("status").alias("verdict"), "reviewed_at")
    rows = items.join(last, [*_FILE, "line"], "left").join(review, [*_FILE, "line"], "left")
    marked = F.when(F.col("m.kind") == "reopened", F.lit("open")).otherwise(F.coalesce("m.kind", F.lit("open")))
    marker_day = F.when(F.col("m").isNotNull(), F.coalesce(F.to_date("m.marker_at"), F.lit("9999-12-31").cast("date")))
    wins = F.col("verdict").isNotNull() & (F.col("m").isNull() | (F.to_date("reviewed_at") > marker_day))
    settled = F.col("verdict").isin("confirmed-resolved", "confirmed-open")
    status = F.when(wins & (F.col("verdict") == "confirmed-resolved"), F.lit("resolved")).when(wins & (F.col("verdict") == "confirmed-open"), F.lit("open")).otherwise(marked)
    origin = (
        F.when(wins & settled, F.lit("review")).when(F.col("m").isNull(), F.lit("default"))
        .when(F.col("m.how") == "fuzzy", F.lit("heuristic")).otherwise(F.lit("structured"))
    )
    lints = F.array_compact(
        F.array(
            F.when(F.col("markers") > 1, F.lit("superseded-marker")),
            F.when(F.col("reviewed_at") < F.lit(latest_activity).cast("timestamp"), F.lit("stale-review")),
            F.when(F.col("verdict").isNotNull() & ~settled, F.col("verdict")),
            F.when(wins & (F.col("verdict") == "confirmed-resolved") & (F.coalesce("resolved_once", F.lit(0)) == 0), F.lit("not-written-back")),
        )
    )
    return rows.select(
        *_FILE, "line", "body", "component", status.alias("status"), origin.alias("origin"),
        F.array_sort(F.concat(F.coalesce("lints", F.array().cast("array<string>")), lints)).alias("lints"),
    )


def counts(view: DataFrame) -> DataFrame:
    return view.groupBy(*_FILE).agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("open", "resolved", "dropped")))
