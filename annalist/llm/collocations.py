"""Phrases whose words keep company: weighted n-gram counts per language, scored by their weakest cut.

Texts are cut into pieces; identical pieces become one row with a multiplicity. Tasks count the n-grams of their pieces in
DuckDB and send each hash bucket its counts as one sorted, front-coded Parquet file; a bucket's task lets DuckDB sum those files
out of core and keeps what is frequent. A phrase is never more frequent than its parts. So words and pairs are counted first, and longer
phrases only where all pairs are frequent, as a bitmap of fixed size tells: pairs that share a bit are let through, none is
lost. And all that a candidate needs is among the frequent ones: it asks for its parts by requests shuffled to where their counts are.
"""

from __future__ import annotations

import io
import tempfile
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annalist.llm.shared import column, discard, settle, text_or_empty
from annalist.llm.wordhash import hash_spans

LEAST_COUNT = 30
LONGEST = 4
FIRST = 2000
#: A longer phrase with this share of a phrase's occurrences stands for it.
COVER_PERCENT = 80
SCORE_SCALE = 2_000_000
#: Bytes of pieces whose n-grams a task counts at once, words of distinct pieces for each hash bucket, and DuckDB's memory in a task.
PIECE_BYTES = 6_000_000
WORDS_A_BUCKET = 4_000_000
TASK_MEMORY = "320MB"
#: Bits of the bitmap of frequent pairs, whatever the input: 8 MB.
PAIR_BITS = 1 << 26
#: Parts a language's phrases are ranked in before the last ranking of at most `first` of each.
RANK_PARTS = 16

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pieces_of(text: Column) -> Column:
    """Pieces of a text, their words parted by single blanks; some may be empty."""
    plain = F.regexp_replace(F.translate(text, _UPPER, _LOWER), "[ \t]+", " ")
    return F.transform(F.split(plain, " ?[.,;:!?\\x0A-\\x0D] ?"), lambda piece: F.trim(piece))


@contextmanager
def _database() -> Iterator[tuple[duckdb.DuckDBPyConnection, Path]]:
    """A DuckDB of this task and its folder, both gone afterwards."""
    with tempfile.TemporaryDirectory(prefix="annalist-grams-") as folder:
        settings = {"threads": 1, "memory_limit": TASK_MEMORY, "temp_directory": f"{folder}/spill", "preserve_insertion_order": False}
        with duckdb.connect(":memory:", config=settings) as db:
            yield db, Path(folder)


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of `batches`, about PIECE_BYTES of pieces at a time."""
    held, size = [], 0
    for batch in batches:
        until = pc.cumulative_sum(pc.cast(pc.binary_length(batch.column("piece")), pa.int64()))
        at, before = 0, 0
        for row, total in enumerate(until.to_pylist()):
            if size + total - before >= PIECE_BYTES:
                yield pa.Table.from_batches([*held, batch.slice(at, row + 1 - at)])
                held, size, at, before = [], 0, row + 1, total
        if at < batch.num_rows:
            held.append(batch.slice(at))
            size += until[-1].as_py() - before
    if held:
        yield pa.Table.from_batches(held)


def _spots(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, langs: np.ndarray) -> np.ndarray:
    """Bits of the pairs that stand in `data` at [start, end), of languages with these codes."""
    return ((hash_spans(data, starts, ends) ^ langs) & np.uint64(PAIR_BITS - 1)).astype(np.int64)


def _strings(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of strings."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    whole = pa.concat_arrays([c.cast(pa.large_string()) for c in chunks])
    offsets = np.frombuffer(whole.buffers()[1], dtype=np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = whole.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8)[: offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8), offsets


def _lang_codes(langs: pa.ChunkedArray | pa.Array) -> np.ndarray:
    coded = pa.concat_arrays(langs.chunks).dictionary_encode() if isinstance(langs, pa.ChunkedArray) else langs.dictionary_encode()
    codes = np.array([zlib.crc32(x.encode()) for x in coded.dictionary.to_pylist()], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C55)
    return codes[coded.indices.to_numpy(zero_copy_only=False)]


def _stretches(pieces: pa.Table, pairs: np.ndarray) -> pa.Table:
    """The stretches of three words or more whose neighbours are all frequent pairs, with the language and times of their piece."""
    data, offsets = _strings(pieces.column("piece"))
    row_starts, row_ends = offsets[:-1], offsets[1:]
    blanks = np.flatnonzero(data == 32)
    starts = np.sort(np.concatenate([row_starts, blanks + 1]))  # pieces aren't empty and begin and end with words
    ends = np.sort(np.concatenate([row_ends, blanks]))
    row = np.searchsorted(row_starts, starts, side="right") - 1
    joined = np.flatnonzero(row[1:] == row[:-1])
    spots = _spots(data, starts[joined], ends[joined + 1], _lang_codes(pieces.column("lang"))[row[joined]])
    frequent = np.zeros(len(starts), dtype=bool)  # whether a word and the next are a frequent pair
    frequent[joined] = (pairs[spots >> 3] >> (spots & 7).astype(np.uint8)) & 1
    edges = np.flatnonzero(np.diff(np.concatenate([[False], frequent, [False]]).astype(np.int8)))
    first, last = edges[::2], edges[1::2]  # words of a run of frequent pairs
    long = last - first > 1
    first, last = first[long], last[long]
    text = data.tobytes()
    found = [text[a:b] for a, b in zip(starts[first].tolist(), ends[last].tolist(), strict=True)]
    own = pa.array(row[first])
    return pa.table({"lang": pieces.column("lang").take(own), "piece": pa.array(found, pa.binary()).cast(pa.string()), "times": pieces.column("times").take(own)})


def _gram_counter(buckets: int, fewest: int, longest: int, pairs: np.ndarray | None):
    """(lang, piece, times) → (bucket, a Parquet file of lang, phrase and f of `fewest` to `longest` words), for each portion of pieces."""
    words = ", ".join(f"unnest(words[{k}:]) AS w{k}" for k in range(1, longest + 1))
    grams = ", ".join(" || ' ' || ".join(f"w{j}" for j in range(1, k + 1)) for k in range(fewest, longest + 1))
    sql = f"""
        WITH listed AS (SELECT lang, times, string_split(piece, ' ') AS words FROM pieces),
            placed AS (SELECT lang, times, {words} FROM listed),
            grams AS (SELECT lang, times, unnest([{grams}]) AS phrase FROM placed)
        SELECT (hash(lang, phrase) % {buckets})::INT AS bucket, lang, phrase, sum(times)::BIGINT AS f
        FROM grams WHERE phrase IS NOT NULL GROUP BY lang, phrase ORDER BY bucket, lang, phrase
    """

    def packed(bucket: int, table: pa.Table) -> pa.RecordBatch:
        file = io.BytesIO()
        pq.write_table(table, file, compression="zstd", use_dictionary=["lang"], column_encoding={"phrase": "DELTA_BYTE_ARRAY"}, write_statistics=False, store_schema=False)
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([file.getvalue()], pa.binary())], names=["bucket", "grams"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _database() as (db, _):
            for pieces in _portions(batches):
                db.register("pieces", pieces if pairs is None else _stretches(pieces, pairs))
                held: list[pa.Table] = []
                for batch in db.sql(sql).to_arrow_reader(200_000):  # in the order of buckets
                    runs = pc.run_end_encode(batch.column("bucket"))
                    at = 0
                    for bucket, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                        if held and held[0][0] != bucket:
                            yield packed(held[0][0], pa.concat_tables([t for _, t in held]))
                            held = []
                        held.append((bucket, pa.Table.from_batches([batch.slice(at, end - at).select(["lang", "phrase", "f"])])))
                        at = end
                if held:
                    yield packed(held[0][0], pa.concat_tables([t for _, t in held]))
                db.unregister("pieces")

    return run


def _gram_summer(least: int):
    """Parquet files of one or several buckets → lang, phrase, f of all that reach `least`, and their bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _database() as (db, folder):
            files = 0
            for batch in batches:
                for blob in batch.column("grams"):
                    (folder / f"{files}.parquet").write_bytes(blob.as_buffer())
                    files += 1
            if files:
                sums = f"SELECT lang, phrase, sum(f)::BIGINT AS f FROM read_parquet('{folder}/*.parquet') GROUP BY lang, phrase HAVING sum(f) >= {least}"
                for found in db.sql(sums).to_arrow_reader(50_000):
                    data, offsets = _strings(found.column("phrase"))
                    spots = _spots(data, offsets[:-1], offsets[1:], _lang_codes(found.column("lang")))
                    yield pa.RecordBatch.from_arrays([*found.columns, pa.array(spots)], names=["lang", "phrase", "f", "spot"])

    return run


def _pair_bitmap(counts: DataFrame) -> np.ndarray:
    """The bits of all frequent pairs: at most PAIR_BITS, in parts of 32,768."""
    spot = F.col("spot") + 1  # the functions number from 1
    parts = counts.where(F.size(F.split("phrase", " ")) == 2).groupBy(F.bitmap_bucket_number(spot).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("bits"))
    bits = np.zeros(PAIR_BITS // 8, dtype=np.uint8)
    for part, found in parts.collect():
        at = (part - 1) * 4096
        bits[at : at + 4096] = np.frombuffer(found, dtype=np.uint8)
    return bits


def count_phrases(pieces: DataFrame, buckets: int, least: int = LEAST_COUNT, longest: int = LONGEST) -> DataFrame:
    """(lang, piece, times) → a table of lang, phrase and f of all phrases of at most `longest` words with f >= `least`."""

    def counted(fewest: int, longest: int, pairs: np.ndarray | None) -> DataFrame:
        files = pieces.select("lang", "piece", "times").mapInArrow(_gram_counter(buckets, fewest, longest, pairs), "bucket int, grams binary")
        sums = files.repartitionById(buckets, F.col("bucket")).mapInArrow(_gram_summer(least), "lang string, phrase string, f long, spot long")
        return settle(sums, f"phrase-counts-{longest}")

    short = counted(1, min(longest, 2), None)
    if longest < 3:
        return short.drop("spot")
    return short.unionByName(counted(3, longest, _pair_bitmap(short))).drop("spot")


def _join_words(words: Column, first: Column | int, n: Column) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def score_phrases(counts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Frequent phrases (lang, phrase, f) → those of two words or more with a, l, r and the score of their weakest cut."""
    listed = counts.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words")).where(F.size("words") > 1)
    cuts = listed.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    sides = F.array(
        F.struct(F.lit(True).alias("left"), _join_words(F.col("words"), 1, F.col("k")).alias("part")),
        F.struct(F.lit(False).alias("left"), _join_words(F.col("words"), F.col("k") + 1, F.size("words") - F.col("k")).alias("part")),
    )
    requests = cuts.select("lang", "phrase", "a", "k", F.inline(sides))
    held = counts.select("lang", F.col("phrase").alias("part"), "f").hint("merge")
    answers = requests.join(held, ["lang", "part"])
    asked = [F.max(F.when((F.col("k") == k) & (F.col("left") == side), F.col("f"))).alias(f"{name}{k}") for k in range(1, longest) for name, side in (("l", True), ("r", False))]

    def cut(k: int) -> Column:
        both = F.col(f"l{k}").cast("decimal(20,0)") + F.col(f"r{k}").cast("decimal(20,0)")
        score = F.call_function("div", F.col("a").cast("decimal(20,0)") * F.lit(SCORE_SCALE).cast("decimal(7,0)"), both)
        return F.when(F.col(f"l{k}").isNotNull(), F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))

    weakest = F.array_min(F.array(*[cut(k) for k in range(1, longest)]))
    scored = answers.groupBy("lang", "phrase", "a").agg(*asked).select("lang", "phrase", "a", weakest.alias("cut"))
    return scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def drop_covered(scored: DataFrame, counts: DataFrame, longest: int = LONGEST, percent: int = COVER_PERCENT) -> DataFrame:
    """`scored` without phrases that stand inside a longer frequent one with `percent` of their occurrences or more."""
    long = counts.select("lang", "f", F.split("phrase", " ").alias("words")).where(F.size("words") > 2)
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.size("words") - 1),
            lambda n: F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda at: _join_words(F.col("words"), at, n)),
        )
    )
    over = long.select("lang", "f", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("over"))
    exact = [F.col(c).cast("decimal(20,0)") * F.lit(p).cast("decimal(3,0)") for c, p in (("over", 100), ("a", percent))]
    return scored.join(over.hint("merge"), ["lang", "phrase"], "left").where(F.col("over").isNull() | (exact[0] < exact[1])).drop("over")


def mine_phrases(
    docs: DataFrame,
    text_column: str = "text",
    lang_column: str = "lang",
    least: int = LEAST_COUNT,
    longest: int = LONGEST,
    first: int = FIRST,
    cover_percent: int = COVER_PERCENT,
) -> DataFrame:
    """→ each language's `first` phrases: lang, rank, phrase, a, l, r, n, score.

    A null text is empty, a null language `und` (one language with rows that say so); rows count as often as they are there,
    whatever their ids, and other columns are not read. Texts without words, and an empty table, give no phrase. A text of
    any length is one row; its pieces are counted as those of others. Ranks never tie: phrases of equal score and
    frequency follow in byte order.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(column(lang_column).cast("string"), F.lit("und")).alias("lang"), F.explode(pieces_of(text_or_empty(text_column))).alias("piece"))
    grouped = texts.where(F.col("piece") != "").groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("times"))
    words = F.length("piece") - F.length(F.replace("piece", F.lit(" "), F.lit(""))) + 1
    pieces = settle(grouped.select("lang", "piece", "times", words.cast("long").alias("words")), "phrase-pieces")
    totals = settle(
        pieces.groupBy("lang").agg(F.sum(F.col("words").cast("decimal(20,0)") * F.col("times")).cast("long").alias("n"), F.sum("words").alias("distinct_words")), "phrase-totals"
    )
    distinct = totals.agg(F.sum("distinct_words")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-distinct // WORDS_A_BUCKET))
    counts = count_phrases(pieces, buckets, least, longest)
    discard(pieces)
    kept = drop_covered(score_phrases(counts, longest), counts, longest, cover_percent)

    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    best = kept.withColumn("place", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("place") <= first)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
