"""A training corpus from raw documents, stage by stage.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept; `run` writes each result and reads
it again, so a lost executor costs the tasks it ran. Columns of any name beside those of documents pass through all stages but the last;
an empty table passes as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from annalist.llm.exact_dedup import DigestIndex
from annalist.llm.minhash import drop_near_duplicates
from annalist.llm.mixing import mix_sources
from annalist.llm.packing import pack
from annalist.llm.quality import keep_quality
from annalist.llm.shared import settle, table

QUALITY_THRESHOLD = 0.3
NEAR_PERCENT = 80
MOST_REPETITION = 2.0


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier doesn't reject. A null text is judged as an empty one; equal rows share their fate; a null or
    repeated id changes nothing but what its labels teach."""
    return keep_quality(docs, table(spark, sf_dir, "labels"), QUALITY_THRESHOLD)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest id. A null text equals an empty one; a null id stays only where its text
    has no other; of rows equal in id and text one stays."""
    return DigestIndex(spark).keep(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id, null ids last. Texts that are null or have no
    words all stay; rows that repeat an id are documents of their own."""
    return drop_near_duplicates(docs, percent=NEAR_PERCENT)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; those of small sources again, up to MOST_REPETITION times as often as the largest source's.
    A null source is a source; a null text is one token; rows equal in id and source are repeated alike."""
    return mix_sources(docs, max_repetition=MOST_REPETITION, own_columns=False)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences. A null text is its end token; ids are carried as they are."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("exact_dedup", exact),
    ("minhash_near_dedup", near),
    ("source_mixing", mixing),
    ("best_fit_packing", packing),
]

#: SQL can't express the classifier; tests compare `run` with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
