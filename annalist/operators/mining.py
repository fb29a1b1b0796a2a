"""Making evaluation sets out of recorded traffic."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annalist.functions.describe import query_id
from annalist.functions.text import call_template, date_window, question_class, tokenize
from annalist.operators.evaluation import mulberry32

LOAD_TEST_REPEATS = 5
SAME_ENTRY = ("project", "source_type", "title", "occurred_at")
# fixed values: named settings of reranking that are compared; a floor reserves slots for what is no transcript
VARIANTS = {
    "baseline": {}, "no-recency": {"recency_boost": 0.0}, "no-source-weight": {"weights": {"": 1.0}}, "cap-as-floor": {"floor": 4},
}


def consolidate(mined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`mined(text, filters, source, at)` → distinct queries at their first sighting with class, and the templates dropped
    as load tests with their counts."""
    rows = mined.withColumn("template", call_template(F.col("text")))
    counted = rows.groupBy("template").agg(F.count(F.lit(1)).alias("n"))
    dropped = counted.where(F.col("n") >= LOAD_TEST_REPEATS)
    kept = rows.join(dropped.select("template"), "template", "left_anti").withColumn("id", query_id(F.col("text"), F.col("filters")))
    first = kept.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy(F.asc_nulls_last("at"), "source", "text"))).where("k = 1")
    return first.select("id", "text", question_class(F.col("text")).alias("class"), "filters", "source", "at"), dropped


def merge_queries(held: DataFrame, new: DataFrame) -> DataFrame:
    """Held queries as they are, and new ones by id."""
    return held.unionByName(new.join(held.select("id"), "id", "left_anti").select(*held.columns))


def fingerprint(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count(F.lit(1)).alias("entries"), F.max("occurred_at").alias("latest"))


def spread_sample(entries: DataFrame, most: int) -> DataFrame:
    """Entries in an order that jumps about ids, the first `most`."""
    return entries.orderBy(F.col("id") % 97, "id").limit(most)


def expand_gold(gold: DataFrame, entries: DataFrame) -> DataFrame:
    """`gold(query_id, entry_id)` widened to entries that are the same event recorded again."""
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in SAME_ENTRY]
    known = entries.select(F.col("id").alias("entry_id"), *keys)
    mine = gold.join(known, "entry_id").drop("entry_id")
    return mine.join(known, list(SAME_ENTRY)).select("query_id", "entry_id").union(gold.select("query_id", "entry_id")).distinct()


def stratified(labels: DataFrame, fraction: float, seed: int) -> DataFrame:
    """At least one and else this share of each (class, grade), by a seeded shuffle of its items in order."""

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item").reset_index(drop=True)
        order = np.arange(len(rows))
        draws = mulberry32(seed + len(f"{rows['class'][0]}:{rows['grade'][0]}"), max(len(rows) - 1, 0))
        for i, u in zip(range(len(rows) - 1, 0, -1), draws, strict=True):
            j = int(u * (i + 1))
            order[i], order[j] = order[j], order[i]
        return rows.iloc[order[: max(1, int(np.floor(len(rows) * fraction + 0.5)))]]

    return labels.select("class", "grade", "item").groupBy("class", "grade").applyInPandas(pick, labels.select("class", "grade", "item").schema)


def judgement_hash(labels: DataFrame) -> DataFrame:
    """Sixteen hexadecimal digits that change with any label. The labels are a hand-made set of some thousands."""
    line = F.concat_ws(":", "query_id", "entry_id", "grade")
    rows = labels.select(F.struct(F.col("query_id"), F.col("entry_id"), line.alias("line")).alias("r"))
    return rows.agg(F.substring(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n"), 256), 1, 16).alias("hash"))


def is_time_scoped(text):
    return date_window(text).isNotNull()


def signals(hits: DataFrame, dense: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query: fused scores at ranks 1 and 5, the first over the median, cosines at 1 and 5, and the mean share of the
    query's terms in the five best hits. The median is the element at floor(n / 2) of the falling list."""
    at = lambda c, r: F.max(F.when(F.col("rank") == r, F.col(c)))
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    ranked = hits.withColumn("n", n)
    fused = ranked.groupBy("query_id").agg(
        at("score", 0).alias("rrf1"), at("score", 4).alias("rrf5"), F.max(F.when(F.col("rank") == F.floor(F.col("n") / 2), F.col("score"))).alias("median"), F.count(F.lit(1)).alias("hits")
    )
    cosines = dense.groupBy("query_id").agg(at("score", 0).alias("cosine1"), at("score", 4).alias("cosine5"))
    terms = queries.select("query_id", F.array_distinct(tokenize(F.col("text"))).alias("terms"))
    top = hits.where(F.col("rank") < 5).join(terms, "query_id")
    share = F.size(F.array_intersect("terms", tokenize(F.concat("title", F.lit(" "), "snippet")))) / F.size("terms")
    overlap = top.groupBy("query_id").agg(F.avg(F.when(F.size("terms") == 0, F.lit(0.0)).otherwise(share)).alias("lexical_overlap"))
    out = queries.select("query_id").join(fused, "query_id", "left").join(cosines, "query_id", "left").join(overlap, "query_id", "left")
    six = lambda c: F.round(c, 6)
    return out.select(
        "query_id", six("rrf1").alias("rrf1"), six("rrf5").alias("rrf5"), six(F.try_divide("rrf1", "median")).alias("rrf_gap"), six("cosine1").alias("cosine1"),
        six("cosine5").alias("cosine5"), six("lexical_overlap").alias("lexical_overlap"), F.coalesce("hits", F.lit(0)).alias("hits"),
    )


# fixed values: what a recorded tool call says
_CALL = (
    "array<struct<type:string,name:string,input:struct<question:string,query:string,project:string,kind:string,source:string,since:string,until:string>>>"
)


def tool_queries(lines: DataFrame, tools: tuple[str, ...]) -> DataFrame:
    """Questions that transcripts put to the given tools: `lines(ref, line)` → ref, at, text, project, kind, source_type, since, until. Lines
    that are no JSON, or hold no such call, give nothing."""
    named = F.lit(False)
    for tool in tools:
        named = named | F.col("line").contains(tool)
    said = F.from_json("line", "timestamp STRING, content STRING, message STRUCT<content: STRING>")
    rows = lines.where(named).select("ref", said.alias("m")).select("ref", F.col("m.timestamp").alias("at"), F.from_json(F.coalesce("m.message.content", "m.content"), _CALL).alias("calls"))
    calls = rows.select("ref", "at", F.explode("calls").alias("c")).where((F.col("c.type") == "tool_use") & F.col("c.name").isin(*tools))
    text = F.trim(F.coalesce("c.input.question", "c.input.query", F.lit("")))
    out = calls.select("ref", "at", text.alias("text"), "c.input.project", "c.input.kind", F.col("c.input.source").alias("source_type"), "c.input.since", "c.input.until")
    return out.where("text <> ''")
