"""Retrieval quality: graded metrics, agreement and paired comparison.

`ranked(query_id, item, rank)` with ranks from 0, `grades(query_id, item, grade)` with grades 0 to 3. What is undefined is
null, never 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def precedence(grades: DataFrame) -> DataFrame:
    """One grade a (query, item): a human's before the primary judge's before any other's (`judge` names them)."""
    rank = F.when(F.col("judge") == "human", 0).when(F.col("judge") == "primary", 1).otherwise(2)
    order = Window.partitionBy("query_id", "item").orderBy(rank, "judge")
    return grades.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def ndcg(ranked: DataFrame, grades: DataFrame, k: int) -> DataFrame:
    """Gain is the grade, discount log2(rank + 2); the ideal takes all judged grades. Null if the ideal is 0."""
    got = ranked.where(F.col("rank") < k).join(grades, ["query_id", "item"], "left").groupBy("query_id").agg(
        F.sum(F.coalesce("grade", F.lit(0)) / F.log2(F.col("rank") + 2)).alias("dcg")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("grade"), "item")
    best = grades.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < k)
    ideal = best.groupBy("query_id").agg(F.sum(F.col("grade") / F.log2(F.col("place") + 2)).alias("ideal"))
    queries = ranked.select("query_id").union(grades.select("query_id")).distinct()
    joined = queries.join(got, "query_id", "left").join(ideal, "query_id", "left")
    return joined.select("query_id", F.when(F.col("ideal") > 0, F.round(F.coalesce("dcg", F.lit(0.0)) / F.col("ideal"), 9)).alias("ndcg"))


def recall_precision(ranked: DataFrame, grades: DataFrame, k: int, relevant_from: int = 2) -> DataFrame:
    """Recall of the relevant items (null without any); precision over the window's real length (0 when empty)."""
    relevant = grades.where(F.col("grade") >= relevant_from).select("query_id", "item", F.lit(1).alias("good"))
    window = ranked.where(F.col("rank") < k).join(relevant, ["query_id", "item"], "left").groupBy("query_id").agg(
        F.count("good").alias("hits"), F.count(F.lit(1)).alias("length")
    )
    wanted = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"))
    queries = ranked.select("query_id").union(grades.select("query_id")).distinct()
    joined = queries.join(window, "query_id", "left").join(wanted, "query_id", "left")
    hits = F.coalesce("hits", F.lit(0))
    return joined.select(
        "query_id", F.round(F.try_divide(hits.cast("double"), F.col("wanted").cast("double")), 9).alias("recall"),
        F.round(F.coalesce(F.try_divide(hits.cast("double"), F.col("length").cast("double")), F.lit(0.0)), 9).alias("precision"),
    )


def reciprocal_rank(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """1 / (rank of the first gold item, from 1), 0 without one in the list; and whether one is in the first k."""
    first = ranked.join(gold.select("query_id", "item").distinct(), ["query_id", "item"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    joined = gold.select("query_id").distinct().join(first, "query_id", "left")
    return joined.select(
        "query_id", F.round(F.coalesce(1 / (F.col("rank") + F.lit(1.0)), F.lit(0.0)), 9).alias("rr"), F.coalesce((F.col("rank") < k).cast("int"), F.lit(0)).alias("hit")
    )


def paired(a: DataFrame, b: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Wins, losses and ties of `b(query_id, value)` over `a`, where both have a value, and the mean difference."""
    both = a.select("query_id", F.col("value").alias("x")).join(b.select("query_id", F.col("value").alias("y")), "query_id").where("x IS NOT NULL AND y IS NOT NULL")
    d = F.col("y") - F.col("x")
    return both.agg(
        F.count_if(d > tolerance).alias("wins"), F.count_if(d < -tolerance).alias("losses"), F.count_if(F.abs(d) <= tolerance).alias("ties"), F.avg(d).alias("mean_delta")
    )


def mulberry32(seed: int, n: int) -> np.ndarray:
    """n numbers in [0, 1) of the mulberry32 generator, whose state only counts up, so they come all at once."""
    with np.errstate(over="ignore"):
        a = (np.uint32(seed) + np.uint32(0x6D2B79F5) * np.arange(1, n + 1, dtype=np.uint32)).astype(np.uint32)
        t = ((a ^ (a >> np.uint32(15))) * (a | np.uint32(1))).astype(np.uint32)
        t ^= (t + ((t ^ (t >> np.uint32(7))) * (t | np.uint32(61))).astype(np.uint32)).astype(np.uint32)
        return ((t ^ (t >> np.uint32(14))) / 4294967296.0).astype(np.float64)


def bootstrap(deltas: DataFrame, resamples: int = 10_000, seed: int = 1) -> DataFrame:
    """`deltas(group, query_id, delta)` → group, n, low, high, straddles_zero: the 95 % percentile interval of the mean.

    Null bounds below two values. A group is the queries of one comparison, some hundreds at most.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values("query_id")["delta"].dropna().to_numpy()
        low = high = None
        if len(x) >= 2:
            pick = (mulberry32(seed, resamples * len(x)) * len(x)).astype(int).reshape(resamples, len(x))
            means = np.sort(x[pick].mean(axis=1))
            low, high = float(means[int(0.025 * resamples)]), float(means[min(int(0.975 * resamples), resamples - 1)])
        straddles = None if low is None else bool(low <= 0 <= high)
        return pd.DataFrame({"group": [rows["group"].iloc[0]], "n": [len(x)], "low": [low], "high": [high], "straddles_zero": [straddles]})

    return deltas.groupBy("group").applyInPandas(run, "group string, n long, low double, high double, straddles_zero boolean")


def weighted_kappa(pairs: DataFrame, categories: int = 4) -> DataFrame:
    """Quadratic weighted agreement of `pairs(a, b)`: n, kappa; 1 where neither observed nor expected disagree, 0 for no pairs."""
    cells = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    weight = lambda x, y: F.pow((F.col(x) - F.col(y)) / F.lit(float(categories - 1)), F.lit(2))
    observed = cells.agg(F.coalesce(F.sum(weight("a", "b") * F.col("n")), F.lit(0.0)).alias("observed"))
    rows, columns = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    # marginals have `categories` rows each
    expected = rows.crossJoin(F.broadcast(columns)).agg(F.coalesce(F.sum(weight("a", "b") * F.col("na") * F.col("nb")), F.lit(0.0)).alias("cross"))
    one = total.crossJoin(observed).crossJoin(expected)
    share = F.col("observed") * F.col("total") / F.col("cross")
    kappa = F.when(F.col("total") == 0, F.lit(0.0)).when(F.col("cross") == 0, F.when(F.col("observed") == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(1 - share)
    return one.select(F.col("total").alias("n"), F.round(kappa, 9).alias("kappa"))


def floor_percentiles(values: DataFrame, points: tuple[float, ...]) -> DataFrame:
    """Per group, the element at floor(p * n) of the ascending values (not interpolated)."""
    order = Window.partitionBy("group").orderBy("value")
    ranked = values.where("value IS NOT NULL").withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("group")))
    at = lambda p: F.max(F.when(F.col("i") == F.least(F.floor(F.lit(p) * F.col("n")), F.col("n") - 1), F.col("value"))).alias(f"p{round(p * 100)}")
    return ranked.groupBy("group").agg(*(at(p) for p in points))


def pool(lists: list[DataFrame], cutoff: int = 30) -> DataFrame:
    """Distinct candidates of several rankings down to the cutoff."""
    out = lists[0].where(F.col("rank") < cutoff).select("query_id", "item")
    for r in lists[1:]:
        out = out.union(r.where(F.col("rank") < cutoff).select("query_id", "item"))
    return out.distinct()


def summarise(scores: DataFrame) -> DataFrame:
    """Means by pool and class, and by pool over all classes; fewer than 8 queries are only indicative."""
    both = scores.select("pool", "class", "value").union(scores.select("pool", F.lit("all"), "value"))
    return both.groupBy("pool", "class").agg(F.count("value").alias("n"), F.round(F.avg("value"), 9).alias("mean"), (F.count("value") < 8).alias("indicative"))


# fixed values: the metrics of each pool of queries, and the depth of the graded one
METRICS = {"A": ("ndcg", "precision", "recall"), "B": ("mrr", "hit"), "L": ("mrr", "hit"), "N": ()}
NDCG_DEPTH = 10
_QUERY = ["query_id", "pool", "class"]


def score_queries(
    queries: DataFrame, context: DataFrame, candidates: DataFrame, grades: DataFrame, unjudged: DataFrame, gold: DataFrame, k: int, cutoff: int, unjudged_as: int
) -> DataFrame:
    """Each of `queries(query_id, pool, class)` with the metrics of its pool; the others are null.

    `context` and `candidates(query_id, item, rank)` are what an answer sees and what was retrieved. Pools B and L look for
    their gold items. Pool A is graded, `unjudged(query_id, item)` items as `unjudged_as` (a grade wins over that); a query of which
    nothing was judged or awaits judgement has no value. Negatives (N) have none. `unjudged` counts hits without a grade.
    """
    waiting = unjudged.select("query_id", "item").distinct().join(grades, ["query_id", "item"], "left_anti")
    known = grades.select("query_id", "item", "grade").unionByName(waiting.withColumn("grade", F.lit(unjudged_as)))
    judged = known.select("query_id").distinct().withColumn("judged", F.lit(True))
    seen = context.select("query_id", "item").unionAll(candidates.select("query_id", "item")).join(waiting, ["query_id", "item"])
    found = reciprocal_rank(candidates.where(F.col("rank") < cutoff), gold, k).select("query_id", F.col("rr").alias("mrr"))
    hit = reciprocal_rank(context, gold, k).select("query_id", F.col("hit").cast("double").alias("hit"))
    parts = (
        judged, found, hit, ndcg(context, known, NDCG_DEPTH), recall_precision(context, known, k).select("query_id", "precision"),
        recall_precision(candidates, known, cutoff).select("query_id", "recall"), seen.groupBy("query_id").agg(F.count(F.lit(1)).alias("seen")),
    )
    rows = queries.select(*_QUERY)
    for part in parts:
        rows = rows.join(part, "query_id", "left")
    graded, golden = (F.col("pool") == "A") & F.col("judged"), F.col("pool").isin("B", "L")
    of = {"ndcg": F.col("ndcg"), "precision": F.coalesce("precision", F.lit(0.0)), "recall": F.col("recall")}
    return rows.select(
        *_QUERY, *(F.when(graded, v).alias(m) for m, v in of.items()), *(F.when(golden, F.coalesce(m, F.lit(0.0))).alias(m) for m in ("mrr", "hit")),
        F.when(graded, F.coalesce("seen", F.lit(0))).otherwise(F.lit(0)).alias("unjudged"),
    )


def compare(base: DataFrame, candidate: DataFrame, seed: int = 1, resamples: int = 10_000) -> DataFrame:
    """Two variants' scores of the same queries, paired by pool, class (and over all classes) and metric: n, wins, losses, ties, mean_delta, low,
    high, straddles_zero, indicative (a class of fewer than 8 queries). Comparisons without a pair are left out."""
    names = sorted({m for of in METRICS.values() for m in of})
    fits = F.lit(False)
    for pool_name, of in METRICS.items():
        fits = fits | ((F.col("pool") == pool_name) & F.col("metric").isin(*of))
    x = base.unpivot(_QUERY, names, "metric", "x").where(fits)
    y = candidate.unpivot(["query_id"], names, "metric", "y")
    each = x.join(y, ["query_id", "metric"], "left").withColumn("delta", F.col("y") - F.col("x"))
    each = each.unionByName(each.withColumn("class", F.lit("all")))
    key, d = ["pool", "class", "metric"], F.col("delta")
    rows = each.groupBy(*key).agg(
        F.count("delta").alias("n"), F.count_if(d > 1e-9).alias("wins"), F.count_if(d < -1e-9).alias("losses"), F.count_if(F.abs(d) <= 1e-9).alias("ties"),
        F.round(F.avg("delta"), 9).alias("mean_delta"), ((F.col("class") != "all") & (F.count(F.lit(1)) < 8)).alias("indicative"),
    )
    interval = bootstrap(each.where("delta IS NOT NULL").select(F.concat_ws("/", *key).alias("group"), "query_id", "delta"), resamples, seed)
    joined = rows.where("n > 0").withColumn("group", F.concat_ws("/", *key)).join(interval.drop("n"), "group", "left")
    return joined.drop("group")


def flipped(optimistic: DataFrame, pessimistic: DataFrame) -> DataFrame:
    """Comparisons that the two bounds of unjudged items decide differently, by sign or by whether zero lies in the interval. A
    decision holds if there is none."""
    key = ["pool", "class", "metric"]
    other = pessimistic.select(*key, F.col("mean_delta").alias("other"), F.col("straddles_zero").alias("other_straddles"))
    rows = optimistic.join(other, key).where("mean_delta IS NOT NULL AND other IS NOT NULL")
    differs = (F.signum("mean_delta") != F.signum("other")) | ~F.col("straddles_zero").eqNullSafe(F.col("other_straddles"))
    return rows.where(differs).select(*key, "mean_delta", F.col("other").alias("mean_delta_pessimistic"))


def resolution_floor(kappa: float) -> float:
    """The least difference that judges of this agreement can tell."""
    return min(0.2, max(0.01, (1 - kappa) / 2))
