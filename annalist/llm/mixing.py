"""Mixing sources to target weights by temperature.

Source shares of all tokens are raised to an exponent and normalised. The exponent is bisected: the largest one whose
weights reach the wanted entropy, lowered further never; and not below the least one that keeps every source within the repetition
limit. The budget is the least one that passes every source at least once, unless a larger or smaller one is named.

The weights are realised as block permutations: an epoch of a source is a permutation of its blocks of about BLOCK_ROWS
documents, documents permuted inside. Whole epochs take every document; the last, partial one takes blocks in order while they fit the
source's tokens and cuts the next block document by document. Where it cuts is a handful of numbers for each source, so
documents are never shuffled: each decides its copies by itself. Only DataFrame operations run here.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annalist.llm.shared import column, settle

BLOCK_ROWS, SEED = 1024, 17
#: Sources are few; their totals are read by the driver. More than this many is an error.
MOST_SOURCES = 100_000


def bisect_exponent(shares: list[float], entropy: float | None, max_repetition: float | None, turns: int = 50) -> float:
    """The exponent in [0, 1], rounded up to 1e-6.

    `entropy`: at least this share of the evenest mix's entropy is wanted, if the exponent 0 to 1 can give it; the exponent stays as
    near to 1 as that allows. `max_repetition`: no source may be passed more than so many times as often as the largest
    one; this lower bound on the exponent wins over the entropy.
    """

    def evenness(e: float) -> float:
        weights = [s**e for s in shares]
        total = math.fsum(weights)
        return -math.fsum(w / total * math.log(w / total) for w in weights) / math.log(len(weights))

    def spread(e: float) -> float:
        return (max(shares) / min(shares)) ** (1 - e)

    def up(x: float) -> float:
        return min(1.0, math.ceil(round(x * 1e6, 3)) / 1e6)

    if len(shares) < 2 or max(shares) == min(shares):
        return 1.0
    exponent = 1.0
    if entropy is not None and evenness(1.0) < entropy:
        low, high = 0.0, 1.0
        for _ in range(turns):
            middle = (low + high) / 2
            low, high = (middle, high) if evenness(middle) >= entropy else (low, middle)
        exponent = low
    elif entropy is None:
        exponent = 0.0
    if max_repetition is not None and spread(exponent) > max_repetition:
        low, high = exponent, 1.0
        for _ in range(turns):
            middle = (low + high) / 2
            low, high = (middle, high) if spread(middle) > max_repetition else (low, middle)
        exponent = high
    return up(exponent)


def _place(*parts: Column) -> Column:
    """A number in [0, 2^60) that stands for a place in a permutation; the same in any engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))), 1, 15), 16, 10).cast("long")


def mix_sources(
    docs: DataFrame,
    entropy: float | None = None,
    max_repetition: float | None = None,
    budget: int | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    seed: int = SEED,
    own_columns: bool = True,
) -> DataFrame:
    """→ the columns of `docs` and, unless `own_columns` is off: mix_tokens, mix_weight (of the source), mix_epoch (from 1), mix_block, mix_place.

    A column of the input that has the name of one of these gives way to it; with `own_columns` off all columns stay. A row for each copy of a document in the mix; ordering a source's rows by epoch and place gives its stream. Tokens are words and one end.
    Without a budget none is dropped: each source is passed once at least. A null source is a source of its own. Rows
    equal in id and source stand at the same place and share their fate. An empty table gives an empty mix.
    """
    spark = docs.sparkSession
    named = F.when(column(source_column).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), column(source_column).cast("string")))
    key = _place(column(id_column), F.lit(seed), F.lit("doc"))
    words = F.regexp_count(F.coalesce(column(text_column).cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1
    slim = settle(docs.select(named.alias("mix_source"), column(id_column).cast("string").alias("id"), key.alias("key"), words.cast("long").alias("mix_tokens")), "mix-rows")
    totals = settle(slim.groupBy("mix_source").agg(F.count(F.lit(1)).alias("rows"), F.sum("mix_tokens").alias("tokens")), "mix-totals")
    facts = totals.select("mix_source", "tokens").limit(MOST_SOURCES + 1).collect()
    if len(facts) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    whole = sum(r["tokens"] for r in facts) or 1
    exponent = bisect_exponent(sorted(r["tokens"] / whole for r in facts), entropy, max_repetition)

    share = F.col("tokens") / F.lit(whole)
    power = F.pow(share, F.lit(exponent))
    norm, least = totals.select(power.alias("p"), share.alias("s")).agg(F.sum("p"), F.max(F.col("s") / F.col("p"))).first()
    tokens = F.lit(float(budget)) if budget is not None else F.lit(float(whole)) * F.lit((norm or 1.0) * (least or 1.0))
    weight = power / F.lit(norm or 1.0)
    quota = F.greatest(F.round(weight * tokens), F.lit(0)).cast("long")
    plan = totals.withColumn("mix_weight", weight).withColumn("quota", quota).select(
        "mix_source",
        "mix_weight",
        F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.lit(1)).cast("long").alias("blocks"),
        F.expr("quota div tokens").alias("epochs"),
        F.expr("quota % tokens").alias("rest"),
    )
    plan = F.broadcast(settle(plan, "mix-plan"))  # MOST_SOURCES rows at most

    block = F.pmod(F.col("key"), F.col("blocks"))
    block_place = _place(F.col("mix_source"), F.col("mix_block"), F.col("epochs") + 1, F.lit(seed))
    placed = slim.join(plan, "mix_source").withColumn("mix_block", block)
    sums = placed.groupBy("mix_source", "mix_block", "epochs", "rest").agg(F.sum("mix_tokens").alias("n")).withColumn("place", block_place)
    along = Window.partitionBy("mix_source").orderBy("place", "mix_block")
    taken = sums.withColumn("until", F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    cut = settle(taken.where("until > rest AND until - n <= rest").select("mix_source", F.col("mix_block").alias("cut_block"), F.col("place").alias("cut_place"), (F.col("rest") - F.col("until") + F.col("n")).alias("left")), "mix-cuts")
    cut = F.broadcast(cut)  # a row for each source
    inside = slim.join(plan, "mix_source").withColumn("mix_block", block).join(cut, "mix_source").where("mix_block = cut_block")
    inside = inside.withColumn("doc_place", _place(F.col("id"), F.col("epochs") + 1, F.lit(seed)))
    order = Window.partitionBy("mix_source").orderBy("doc_place").rangeBetween(Window.unboundedPreceding, 0)
    fits = inside.withColumn("until", F.sum("mix_tokens").over(order)).where("until <= left")
    last = F.broadcast(settle(fits.groupBy("mix_source").agg(F.max("doc_place").alias("last_place")), "mix-lasts"))

    rows = docs.select(
        F.struct(*map(column, docs.columns)).alias("doc"), named.alias("mix_source"), column(id_column).cast("string").alias("id"), key.alias("mix_key"), words.cast("long").alias("mix_tokens")
    )
    rows = rows.join(plan, "mix_source").join(cut, "mix_source", "left").join(last, "mix_source", "left")
    rows = rows.withColumn("mix_block", F.pmod(F.col("mix_key"), F.col("blocks")))
    own_block = _place(F.col("mix_source"), F.col("mix_block"), F.col("epochs") + 1, F.lit(seed))
    own_place = _place(F.col("id"), F.col("epochs") + 1, F.lit(seed))
    before = (own_block < F.col("cut_place")) | ((own_block == F.col("cut_place")) & (F.col("mix_block") < F.col("cut_block")))
    partial = F.coalesce(before, F.lit(False)) | F.coalesce((F.col("mix_block") == F.col("cut_block")) & (own_place <= F.col("last_place")), F.lit(False))
    copies = F.col("epochs") + partial.cast("long")
    rows = rows.withColumn("mix_epoch", F.explode(F.when(copies > 0, F.sequence(F.lit(1).cast("long"), copies)).otherwise(F.array().cast("array<long>"))))
    place = F.concat_ws(
        "-",
        F.lpad(_place(F.col("mix_source"), F.col("mix_block"), F.col("mix_epoch"), F.lit(seed)).cast("string"), 19, "0"),
        F.lpad(_place(F.col("id"), F.col("mix_epoch"), F.lit(seed)).cast("string"), 19, "0"),
    )
    own = ["mix_tokens", "mix_weight", "mix_epoch", "mix_block", "mix_place"] if own_columns else []
    carried = [F.col("doc").getField(c).alias(c) for c in docs.columns if c.lower() not in own]
    return rows.withColumn("mix_place", place).select(*carried, *own)
