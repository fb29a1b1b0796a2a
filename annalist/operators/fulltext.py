"""Ranked full text: any of a query's words finds an entry, more of them rank it higher, then titles, repeats and words that stand together.

The words of entries are a table with positions (`entry_words`), and a stored index holds the same. Words meet by their stems, and stems cost more than
all else here, so they are told once for each distinct word (`vocabulary`): a query's stems become the words that the entries have for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annalist.functions.stem import stemmed
from annalist.functions.text import tokenize
from annalist.operators.retrieval import _top

# fixed values: weights of a word in the title and in the body, and what repeats without end would add up to
TITLE_WEIGHT, BODY_WEIGHT = 1.0, 0.1
ALL_REPEATS = 1.64493406685


def whole_text() -> Column:
    """The text of an entry that full text reads: its title, then its body; one may be null."""
    return F.concat_ws(" ", "title", "body")


def entry_words(entries: DataFrame, *keep: str) -> DataFrame:
    """A row for each distinct token of each entry: `keep`, token, its places (from 0, title first) and how many are in the title."""
    tokens = entries.select(*keep, F.size(tokenize(F.col("title"))).alias("title_size"), F.posexplode(tokenize(whole_text())).alias("place", "token"))
    return tokens.groupBy(*keep, "token").agg(F.sort_array(F.collect_list("place")).alias("places"), F.count_if(F.col("place") < F.col("title_size")).cast("int").alias("in_title"))


def vocabulary(words: DataFrame, parts: int | None = None) -> DataFrame:
    """The distinct tokens of `words`, each with its stem."""
    tokens = words.select("token").distinct()
    # few bytes but much to do for each: a number that is asked for isn't made smaller at run time
    return stemmed(tokens.repartition(parts, "token") if parts else tokens, "token")


def query_stems(queries: DataFrame, literals: bool = True) -> DataFrame:
    """The distinct stems of each query: query_id, stem, `follows` (stems right behind it somewhere), `asked` and `pairs` (stems and such pairs of the query)."""
    tokens = stemmed(queries.select("query_id", F.posexplode(tokenize(F.col("text"), literals)).alias("at", "token")), "token")
    behind = tokens.withColumn("behind", F.lead("stem").over(Window.partitionBy("query_id").orderBy("at")))
    stems = behind.groupBy("query_id", "stem").agg(F.sort_array(F.collect_set("behind")).alias("follows"))
    query = Window.partitionBy("query_id")
    return stems.withColumns({"asked": F.count(F.lit(1)).over(query), "pairs": F.sum(F.size("follows")).over(query)})


def _repeats(n: Column) -> Column:
    """1 + 1/4 + 1/9 ... of n terms."""
    squares = F.transform(F.sequence(F.lit(1), n), lambda j: 1.0 / (j.cast("double") * j))
    return F.when(n < 1, F.lit(0.0)).otherwise(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x))


def ranked_search(asked: DataFrame, known: DataFrame, words: DataFrame, limit: int) -> DataFrame:
    """The best `limit` entries of each query of `query_stems`, with the vocabulary `known` of the words: query_id, entry_id, score, matched, near, rank from 0.

    `matched` counts the query's stems that the entry holds, `near` the query's neighbours that are neighbours in the entry too. The score is
    `matched` and less than one for the rest: half of it the weights of the words found (a repeat adds less than the one before, titles weigh more),
    half of it the share of neighbours. Equal scores: the smaller id comes first.
    """
    met = words.select("token", "entry_id", "places", "in_title").join(asked.join(known, "stem"), "token")
    # words of one stem are one
    held = met.groupBy("query_id", "entry_id", "stem").agg(
        F.flatten(F.collect_list("places")).alias("places"), F.sum("in_title").cast("int").alias("titled"), *(F.first(c).alias(c) for c in ("follows", "asked", "pairs"))
    )
    titled, n = F.col("titled"), F.size("places")
    weight = (BODY_WEIGHT * _repeats(n) + (TITLE_WEIGHT - BODY_WEIGHT) * _repeats(titled)) / ALL_REPEATS
    held = held.withColumn("weight", F.round(weight, 12))
    hits = held.groupBy("query_id", "entry_id").agg(
        F.count(F.lit(1)).alias("matched"), F.sum("weight").alias("weight"), F.first("asked").alias("asked"), F.first("pairs").alias("pairs"),
        F.map_from_entries(F.collect_list(F.struct("stem", "places"))).alias("places"), F.collect_list(F.struct("stem", "follows")).alias("follows"),
    )

    def together(row: Column) -> Column:
        ahead = F.transform(F.element_at("places", row["stem"]), lambda p: p + 1)
        return F.size(F.filter(row["follows"], lambda f: F.coalesce(F.arrays_overlap(ahead, F.try_element_at("places", f)), F.lit(False))))

    near = F.aggregate(F.transform("follows", together), F.lit(0), lambda a, x: a + x)
    hits = hits.withColumn("near", near)
    share = F.when(F.col("pairs") > 0, F.col("near") / F.col("pairs")).otherwise(0.0)
    scored = hits.select("query_id", "entry_id", F.round(F.col("matched") + (F.col("weight") / F.col("asked") + share) / 2, 9).alias("score"), "matched", "near")
    return _top(scored, limit, "entry_id")
