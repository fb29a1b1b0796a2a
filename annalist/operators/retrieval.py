"""Keyword, dense and fused retrieval for batches of queries, as one lazy plan.

A batch is `queries(query_id, text, …)`; one query is a batch of one. Filters hold inside each branch, before ranking.
Postings and vectors are ordinary tables keyed by point; only queries, bounded by FEW_QUERIES, are broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annalist.functions.text import age_months, chunk, fnv1a, recency_factor, term_weight, tokenize
from annalist.operators import blocks
from annalist.storage import written

#: A batch of at most so many queries is broadcast to scan vectors; larger ones are scanned in slices of this size.
FEW_QUERIES = 10_000
#: Scores that a task holds at once.
STRIP_SCORES = 4_000_000
# fixed values: how much a source's word counts in an answer's context, and the shares of its window
SOURCE_WEIGHTS = {"doc": 1.35, "component": 1.3, "changelog": 1.15, "report": 1.15, "backlog": 1.05, "commit": 1.0, "session": 0.95, "transcript": 0.8}
EXPLANATORY = ("doc", "component", "changelog", "backlog", "report", "session")
ARCHIVED_PENALTY, AGING_MONTHS, SESSION_SHARE = 0.6, 12, 0.5


def points(entries: DataFrame) -> DataFrame:
    """Chunks of the entries: entry_id, seq, chunk, and what filters need."""
    body = F.concat("title", F.lit("\n\n"), "body")
    rows = entries.select(F.col("id").alias("entry_id"), "project", "source_type", "component", "kind", "doc_status", "occurred_at", F.posexplode(chunk(body)).alias("seq", "chunk"))
    return rows


def postings(points: DataFrame) -> DataFrame:
    """term, entry_id, seq, weight of every distinct token of each chunk."""
    terms = points.select("entry_id", "seq", F.explode(tokenize(F.col("chunk"))).alias("token")).groupBy("entry_id", "seq", "token").count()
    return terms.select(fnv1a(F.col("token")).alias("term"), "token", "entry_id", "seq", term_weight(F.col("count")).alias("weight"))


def idf(postings: DataFrame, points: DataFrame) -> DataFrame:
    """Robertson / Spärck Jones weights of all terms, over the unfiltered corpus."""
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = points.agg(F.count(F.lit(1)).alias("n"))
    return df.crossJoin(F.broadcast(total)).select("term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def query_tokens(queries: DataFrame, literals: bool = True) -> DataFrame:
    """The distinct tokens of each query: query_id, token, weight."""
    tokens = queries.select("query_id", F.explode(tokenize(F.col("text"), literals)).alias("token")).groupBy("query_id", "token").count()
    return tokens.select("query_id", "token", term_weight(F.col("count"), F.col("token") if literals else None).alias("weight"))


def query_terms(queries: DataFrame) -> DataFrame:
    return query_tokens(queries).select("query_id", fnv1a(F.col("token")).alias("term"), "weight")


def _top(scored: DataFrame, limit: int, *ties: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *ties)
    # a limit on the bare row number lets each task drop what can't be among the best before the shuffle
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return best.withColumn("rank", F.col("rank") - 1)


def sparse_search(queries: DataFrame, postings: DataFrame, weights: DataFrame, limit: int) -> DataFrame:
    """Per query the points of highest idf-weighted inner product: query_id, entry_id, seq, score, rank from 0."""
    asked = query_terms(queries)
    # idf meets the query's terms first, so the postings are joined once, on the term
    known = asked.join(weights, "term").select("query_id", "term", (F.col("weight") * F.col("idf")).alias("q"))
    met = postings.select("term", "entry_id", "seq", "weight").join(known, "term")
    scored = met.groupBy("query_id", "entry_id", "seq").agg(F.round(F.sum(F.col("q") * F.col("weight")), 9).alias("score"))
    return _top(scored, limit, "entry_id", "seq")


def search_texts(queries: DataFrame, texts: DataFrame, limit: int, digits: int = 9, literals: bool = True) -> DataFrame:
    """As `sparse_search` over texts(entry_id, seq, chunk) that are read once and of which only what queries ask for is kept; scores are rounded to
    `digits` before they are ranked. Tokens meet as they are, not by their hashes."""

    def run(some: DataFrame) -> DataFrame:
        found = blocks.search_texts(query_tokens(some, literals), texts, limit, digits, literals)
        return _top(found.withColumn("score", F.round("score", digits)), limit, "entry_id", "seq")

    return blocks.by_slices(queries, run, "text")


def fts_search(queries: DataFrame, entries: DataFrame, limit: int) -> DataFrame:
    """Fallback without an index: entries with any of the query's tokens, those with more of them first."""
    tokens = entries.select(F.col("id").alias("entry_id"), F.explode(F.array_distinct(tokenize(F.concat_ws(" ", "title", "body")))).alias("token"))
    asked = queries.select("query_id", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("token"))
    scored = tokens.join(asked, "token").groupBy("query_id", "entry_id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    return _top(scored, limit, "entry_id")


def hashed_embedding(text: str, dim: int = 64) -> list[float]:
    """A deterministic stand-in for an embedding model: signed hash buckets of the words, unit length."""
    v = np.zeros(dim)
    for word in text.lower().split():
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        v[h % dim] += 1.0 if h >> 63 else -1.0
    return list(v / (np.linalg.norm(v) or 1.0))


def embed(rows: DataFrame, text: str, provider=hashed_embedding, out: str = "embedding") -> DataFrame:
    """Vectors from a provider `text -> list[float]`, by Arrow batches."""

    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(provider)

    return rows.withColumn(out, of(F.col(text)))


def dense_search(queries: DataFrame, vectors: DataFrame, limit: int, exclude_self: bool = False) -> DataFrame:
    """Exact cosine top-k of each query's embedding among all vectors: query_id, entry_id, score, rank.

    Each task multiplies its vectors with the block of queries and keeps its own best, so at most `limit` rows per query leave a task.
    """
    asked = queries.select("query_id", "embedding").limit(FEW_QUERIES + 1).collect()
    if len(asked) <= FEW_QUERIES:
        return _dense_slice(asked, vectors, limit, exclude_self)
    # one slice of queries is on the driver at a time; its result is written before the next one is taken
    del asked
    every = written(queries.select("query_id", "embedding"), "dense-queries")
    parts = -(-every.count() // FEW_QUERIES)
    rows = written(every.repartition(parts), "dense-queries").toLocalIterator()
    slices = []
    while some := list(islice(rows, FEW_QUERIES)):
        slices.append(written(_dense_slice(some, vectors, limit, exclude_self).drop("rank"), "dense-slice"))
    return _top(reduce(DataFrame.unionByName, slices), limit, "entry_id")


def _dense_slice(asked: list[Row], vectors: DataFrame, limit: int, exclude_self: bool) -> DataFrame:
    ids = np.array([r["query_id"] for r in asked], dtype=np.int64)
    q = np.array([r["embedding"] for r in asked], dtype=np.float64).reshape(len(asked), -1)
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

    strip = max(1, STRIP_SCORES // max(1, len(ids)))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            batch = batch[batch["embedding"].notna()].sort_values("entry_id")  # the smaller id comes first among equals
            for at in range(0, len(batch) if len(ids) else 0, strip):
                rows = batch.iloc[at : at + strip]
                x = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
                norm = np.linalg.norm(x, axis=1)
                score = np.round((x @ q.T) / np.where(norm > 0, norm, 1)[:, None], 9)
                own = rows["entry_id"].to_numpy()
                if exclude_self:
                    score[own[:, None] == ids[None, :]] = -2.0
                keep = np.argsort(-score, axis=0, kind="stable")[: limit + 8]
                found = pd.DataFrame({"query_id": np.tile(ids, len(keep)), "entry_id": own[keep].ravel(), "score": np.take_along_axis(score, keep, 0).ravel()})
                held = found if held is None else pd.concat([held, found])
                held = held.sort_values(["query_id", "score", "entry_id"], ascending=[True, False, True]).groupby("query_id").head(limit)
        if held is not None:
            yield held[held["score"] >= -1.0] if exclude_self else held

    found = vectors.select("entry_id", "embedding").mapInPandas(best, "query_id long, entry_id long, score double")
    return _top(found, limit, "entry_id")


def fuse(branches: list[DataFrame], limit: int, point: tuple[str, ...] = ("entry_id", "seq")) -> DataFrame:
    """Reciprocal rank fusion: a hit at rank r (from 0) of a branch adds 1 / (2 + r)."""
    every = branches[0].select("query_id", *point, "rank")
    for b in branches[1:]:
        every = every.unionByName(b.select("query_id", *point, "rank"))
    scored = every.groupBy("query_id", *point).agg(F.round(F.sum(1 / (F.lit(2.0) + F.col("rank"))), 9).alias("score"))
    return _top(scored, limit, *point)


def hydrate(hits: DataFrame, entries: DataFrame, snippet: int = 280) -> DataFrame:
    """Hits with their entries: the best hit of each entry counts, missing entries are left out."""
    once = hits.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "entry_id").orderBy("rank"))).where("n = 1").drop("n")
    facts = entries.select(
        F.col("id").alias("entry_id"), "project", "source_type", "component", "title", F.substring("body", 1, snippet).alias("snippet"), "source_path", "occurred_at", "doc_status"
    )
    return once.join(facts, "entry_id")


def finalise(hits: DataFrame, as_of: str, limit: int, penalty: float = ARCHIVED_PENALTY, aging_months: int = AGING_MONTHS) -> DataFrame:
    """Archived documents lose score, old ones get a label, the best `limit` of each query stay."""
    now = F.lit(as_of).cast("timestamp")
    months = F.when(F.col("source_type") == "doc", age_months(F.col("occurred_at"), now))
    archived = (F.col("source_type") == "doc") & F.col("doc_status").eqNullSafe("archived")
    out = hits.withColumn("score", F.when(archived, F.col("score") * penalty).otherwise(F.col("score"))).withColumn(
        "status", F.when(archived, F.lit("archived")).when(months >= aging_months, F.lit("aging"))
    ).withColumn("age_months", age_months(F.col("occurred_at"), now))
    return _top(out.withColumnRenamed("rank", "place"), limit, "place", "entry_id").drop("place")


def rerank(hits: DataFrame, as_of: str, k: int, floor: int | None = None, weights: dict[str, float] | None = None, recency_days: float = 180.0, recency_boost: float = 0.12, share: float = SESSION_SHARE) -> DataFrame:
    """The k hits of each query for an answer's context: weight of the source and recency, one of each repeated event,
    transcripts held to a share of the window (or to what `floor` other hits leave) unless nothing else fills it. Without `weights` the usual
    ones hold; an empty table weighs all sources alike."""
    table = SOURCE_WEIGHTS if weights is None else weights
    weight: Column = F.lit(1.0)
    for name, w in table.items():
        weight = F.when(F.col("source_type") == name, F.lit(w)).otherwise(weight)
    scored = hits.withColumn("s", F.round(F.col("score") * weight * recency_factor(F.col("occurred_at"), F.lit(as_of).cast("timestamp"), recency_days, recency_boost), 9))
    same = Window.partitionBy("query_id", "project", "source_type", "title", "occurred_at").orderBy(F.desc("s"), "rank")
    once = scored.withColumn("n", F.row_number().over(same)).where("n = 1").drop("n")
    cap = max(1, k - floor) if floor is not None else max(1, int(k * share))
    order = Window.partitionBy("query_id").orderBy(F.desc("s"), "rank")
    talk = F.col("source_type") == "transcript"
    nth = F.sum(talk.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = once.withColumn("over", (talk & (nth > cap)).cast("int")).withColumn("pos", F.row_number().over(order))
    final = Window.partitionBy("query_id").orderBy("over", "pos")
    return placed.withColumn("place", F.row_number().over(final)).where(F.col("place") <= k).drop("over", "pos")


def top_up(found: DataFrame, explanatory: DataFrame, k: int) -> DataFrame:
    """Where fewer than half of k hits explain rather than narrate, append explaining hits not yet there, at the end."""
    counts = found.groupBy("query_id").agg(F.count_if(F.col("source_type") != "transcript").alias("n"), F.max("rank").alias("last"))
    short = counts.where(F.col("n") < -(-k // 2)).select("query_id", "last")
    extra = explanatory.join(short, "query_id").join(found.select("query_id", "entry_id"), ["query_id", "entry_id"], "left_anti")
    extra = extra.withColumn("rank", F.col("last") + 1 + F.col("rank")).drop("last")
    return found.unionByName(extra.select(*found.columns))


def prompt_block(limit: int = 1500) -> Column:
    """A numbered context block of a reranked hit, with its staleness if any."""
    stale = F.when(F.col("status").isNotNull(), F.concat(F.lit(" ("), F.col("status"), F.lit(")"))).otherwise(F.lit(""))
    cut = F.when(F.length("snippet") > limit, F.concat(F.substring("snippet", 1, limit), F.lit("\n[truncated]"))).otherwise(F.col("snippet"))
    return F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), F.col("project"), F.lit(" / "), F.col("source_type"), stale, F.lit(": "), F.col("title"), F.lit("\n"), cut)
