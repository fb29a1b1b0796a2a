"""A stored search index: points, postings by token, document frequencies, entry tokens and their stems, as tables of segments under one folder.

A build writes one segment; an upsert writes another, with the ids it replaces and what it changes in the document frequencies, so its work
follows the batch. A manifest names the segments that count; it is written last, under a name that only one writer can take. So what
a lost writer leaves is never seen, and an open index keeps reading the segments it was opened with. `merge` folds the segments
into one, `vacuum` deletes those that no kept manifest names.

Postings are lists, a row for each token and block of entries (`blocks.py`), partitioned by a bucket of the token and sorted by it; points are ranged by
entry: a few tokens or entries touch few row groups. What filters need stands once for each entry, beside its number of chunks.
"""

from __future__ import annotations

import json
import math
import uuid
import zlib
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalist.functions.text import tokenize
from annalist.operators import blocks as bl
from annalist.operators import fulltext as ft
from annalist.operators import retrieval as rt
from annalist.storage import delete, names_in, read_text, write_new

#: Partitions of postings unless named at the build; a large corpus wants as many as make one about a gigabyte.
BUCKETS = 16
#: Ids of at most so many rows prune by value; larger batches read all that their bounds allow.
FEW_TERMS = 10_000
#: Goes up with every change of the tables; an index of another layout has to be built anew.
LAYOUT = 3

_FACTS = "entry_id long, project string, source_type string, component string, kind string, doc_status string, occurred_at timestamp"
_SCHEMAS = {
    "points": f"{_FACTS}, seq int, chunk string, segment int",
    "postings": f"{bl.POSTINGS}, segment int, bucket int",
    "words": f"{bl.WORDS}, segment int, bucket int",
    "vocabulary": "token string, stem string, bucket int",
    "ids": f"{_FACTS}, chunks long, removed boolean, segment int",
    "frequencies": "token string, df long, bucket int",
}


class SearchIndex:
    """The index at `path`, as its newest manifest has it: points, postings (of chunks), words (distinct tokens of whole entries, with places)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.refresh()

    @property
    def buckets(self) -> int:
        return self.manifest["buckets"]

    @property
    def literals(self) -> bool:
        return self.manifest["literals"]

    def refresh(self) -> None:
        """Read the newest manifest: what other writers have published since."""
        versions = sorted(n for n in names_in(self.spark, f"{self.path}/manifest") if n.endswith(".json"))
        if not versions:
            raise FileNotFoundError(f"no index is published at {self.path}")
        manifest = json.loads(read_text(self.spark, f"{self.path}/manifest/{versions[-1]}"))
        if manifest.get("layout") != LAYOUT:
            raise ValueError(f"the index at {self.path} has layout {manifest.get('layout')}, not {LAYOUT}: build it anew")
        self.manifest = manifest

    @staticmethod
    def _publish(spark: SparkSession, path: str, manifest: dict) -> None:
        """Swap in a manifest; FileExistsError if another writer has published this version."""
        write_new(spark, f"{path}/manifest/{manifest['version']:012d}.json", json.dumps(manifest))

    @classmethod
    def build(cls, entries: DataFrame, path: str, buckets: int = BUCKETS, literals: bool = True) -> SearchIndex:
        """Index `entries` under `path`; an index that is there already is replaced when this one is complete. Its tokens, those of later upserts
        and of queries are those of `tokenize` with `literals`."""
        spark, path = entries.sparkSession, path.rstrip("/")
        versions = sorted(n for n in names_in(spark, f"{path}/manifest") if n.endswith(".json"))
        version = int(versions[-1].split(".")[0]) + 1 if versions else 0
        name, added = _write_segment(spark, path, entries, version, buckets, literals, None)
        cls._publish(spark, path, {"version": version, "layout": LAYOUT, "buckets": buckets, "literals": literals, "points": added, "segments": [[name, version]]})
        return cls(spark, path)

    # reading

    def _table(self, table: str, segments: list[list]) -> DataFrame:
        schema = T._parse_datatype_string(_SCHEMAS[table])
        paths = [f"{_folder(self.path, name)}/table={table}" for name, _ in segments]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/segments").parquet(*paths).select(*schema.fieldNames())

    def _current(self, rows: DataFrame) -> DataFrame:
        """Rows of each entry's newest segment. Only the ids of upserts are read, not those of the first segment."""
        later = self.manifest["segments"][1:]
        if not later:
            return rows
        newest = self._table("ids", later).groupBy("entry_id").agg(F.max("segment").alias("newest"))
        return rows.join(newest, "entry_id", "left").where(F.col("newest").isNull() | (F.col("segment") >= F.col("newest"))).drop("newest")

    def points(self) -> DataFrame:
        """The current points, without order."""
        return self._current(self._table("points", self.manifest["segments"]))

    def _entries(self) -> DataFrame:
        """What is held of each entry that is indexed, as its newest segment has it."""
        return self._current(self._table("ids", self.manifest["segments"])).where("NOT removed")

    def coverage(self) -> DataFrame:
        """entry_id and chunks of all entries that are wholly indexed; those without chunks too."""
        return self._entries().select("entry_id", "chunks")

    def scroll(self, size: int, after: tuple[int, int] | None = None) -> DataFrame:
        """A page of points by (entry_id, seq), beginning behind `after`. The slim table of ids tells where it ends, so chunks of other pages aren't read."""
        start = after[0] if after else None
        ahead = self.coverage().where("chunks > 0")
        ahead = ahead if start is None else ahead.where(F.col("entry_id") >= start)
        # `size` entries behind the one that `after` names hold a page at least
        last = ahead.orderBy("entry_id").select("entry_id").limit(size + 1).agg(F.max("entry_id").alias("m")).first()["m"]
        rows = self.points().where(F.col("entry_id") <= (last if last is not None else -1))
        if after is not None:
            rows = rows.where((F.col("entry_id") >= start) & ((F.col("entry_id") > start) | (F.col("seq") > after[1])))
        return rows.orderBy("entry_id", "seq").limit(size)

    def _lists(self, table: str, words: Iterable[str], name: str = "token") -> DataFrame:
        """Rows of the table for these words, a bounded number of them, read from their buckets alone."""
        buckets = {zlib.crc32(w.encode()) % self.buckets for w in words}
        rows = self._table(table, self.manifest["segments"])
        rows = rows if len(buckets) >= self.buckets else rows.where(F.col("bucket").isin(sorted(buckets)))
        return rows.join(F.broadcast(self.spark.createDataFrame([(w,) for w in words], f"{name} string")), name, "left_semi")

    def _allowed(self, where: Column | None) -> DataFrame | None:
        """Entries that meet `where`, each with the segment that counts; None if all rows of all segments do."""
        if where is None and len(self.manifest["segments"]) == 1:
            return None
        entries = self._entries()
        return (entries if where is None else entries.where(where)).select("entry_id", "segment")

    def sparse_search(self, queries: DataFrame, limit: int, where: Column | None = None) -> DataFrame:
        """As `retrieval.sparse_search` over the stored postings; `where` filters on the entries' columns before ranking."""

        def run(some: DataFrame) -> DataFrame:
            rows = rt.query_tokens(some, self.literals).collect()
            words = {r["token"] for r in rows}
            df = {r["token"]: r["df"] for r in self._lists("frequencies", words).groupBy("token").agg(F.sum("df").alias("df")).where("df > 0").collect()}
            n = self.manifest["points"]
            asked = bl.Asked([(r["query_id"], w, r["weight"] * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))) for r in rows if (w := r["token"]) in df])
            lists = self._lists("postings", asked.code).select("token", "block", "segment", "entry_ids", "seqs", "counts")
            found = bl.search_lists(lists, self._allowed(where), asked, limit)
            return rt._top(found.withColumn("score", F.round("score", 9)), limit, "entry_id", "seq")

        return bl.by_slices(queries, run, "text")

    def fts_search(self, queries: DataFrame, limit: int, where: Column | None = None) -> DataFrame:
        """As `retrieval.fts_search` over the stored tokens of entries."""

        def run(some: DataFrame) -> DataFrame:
            rows = some.select("query_id", F.explode(F.array_distinct(tokenize(F.col("text"), self.literals))).alias("token")).collect()
            asked = bl.Asked([(r["query_id"], r["token"], 1.0) for r in rows])
            lists = self._lists("words", asked.code).select("token", "block", "segment", "entry_ids")
            return rt._top(bl.search_lists(lists, self._allowed(where), asked, limit).drop("seq"), limit, "entry_id")

        return bl.by_slices(queries, run, "text")

    def ranked_search(self, queries: DataFrame, limit: int, where: Column | None = None) -> DataFrame:
        """As `fulltext.ranked_search` over the stored words: stems meet, titles and neighbours count."""

        def run(some: DataFrame) -> DataFrame:
            rows = ft.query_stems(some, self.literals).select("query_id", "stem", "follows", "asked", "pairs").collect()
            # a token is in the vocabulary of each segment that has it
            known = self._lists("vocabulary", {r["stem"] for r in rows}, "stem").select("token", "stem").distinct().collect()
            asked = bl.Ranked([tuple(r) for r in rows], [tuple(r) for r in known])
            lists = self._lists("words", asked.stem_of).select("token", "block", "segment", "entry_ids", "places", "in_title")
            found = bl.ranked_lists(lists, self._allowed(where), asked, limit, ft.BODY_WEIGHT, ft.TITLE_WEIGHT, ft.ALL_REPEATS)
            return rt._top(found.withColumn("score", F.round("score", 9)), limit, "entry_id")

        return bl.by_slices(queries, run, "text")

    # writing

    def _held(self, ids: DataFrame) -> DataFrame:
        """The current points of these entries, read from the row groups that their bounds or values meet."""
        some = [r["entry_id"] for r in ids.limit(FEW_TERMS + 1).collect()]
        rows = self.points()
        if len(some) <= FEW_TERMS:
            return rows.where(F.col("entry_id").isin(some))
        low, high = ids.agg(F.min("entry_id"), F.max("entry_id")).first()
        return rows.where(F.col("entry_id").between(low, high)).join(ids, "entry_id", "left_semi")

    def upsert(self, entries: DataFrame) -> None:
        """Points of `entries` replace those of the same ids, all at once; an entry without text leaves none. Running it twice gives the same index."""
        self._append(entries, self._held(entries.select(F.col("id").alias("entry_id"))), None)

    def remove(self, ids: DataFrame) -> None:
        """Entries `ids(entry_id)` leave the index."""
        nothing = self.points().limit(0).select(F.col("entry_id").alias("id"), *_fact_names()[1:], F.lit("").alias("title"), F.lit("").alias("body"))
        self._append(nothing, self._held(ids), ids)

    def _append(self, entries: DataFrame, held: DataFrame, removed: DataFrame | None) -> None:
        version = self.manifest["version"] + 1
        name, change = _write_segment(self.spark, self.path, entries, version, self.buckets, self.literals, held, removed)
        manifest = self.manifest | {"version": version, "points": self.manifest["points"] + change, "segments": [*self.manifest["segments"], [name, version]]}
        self._publish(self.spark, self.path, manifest)
        self.manifest = manifest

    def merge(self) -> None:
        """Fold all segments into one; searches give what they gave before."""
        version, name = self.manifest["version"] + 1, uuid.uuid4().hex
        folder, segments = _folder(self.path, name), self.manifest["segments"]
        at = F.lit(version).alias("segment")
        points = self.points().withColumn("segment", at)
        points.repartitionByRange(self.buckets, "entry_id").sortWithinPartitions("entry_id", "seq").write.parquet(f"{folder}/table=points")
        entries = self._entries()
        for table in ("postings", "words"):
            kept = bl.kept_lists(self._table(table, segments).drop("bucket"), entries.select("entry_id", "segment"))
            _write_buckets(kept.withColumn("segment", at), f"{folder}/table={table}", self.buckets)
        _write_vocabulary(self._table("vocabulary", segments).distinct(), folder)
        df = self._table("frequencies", segments).groupBy("bucket", "token").agg(F.sum("df").alias("df")).where("df > 0")
        _write_frequencies(df, folder)
        entries.withColumn("segment", at).write.parquet(f"{folder}/table=ids")
        manifest = self.manifest | {"version": version, "segments": [[name, version]]}
        self._publish(self.spark, self.path, manifest)
        self.manifest = manifest

    def vacuum(self, keep: int = 2) -> None:
        """Delete manifests before the newest `keep`, and segments that none of those names. Not while another writer is at work."""
        manifests = sorted(n for n in names_in(self.spark, f"{self.path}/manifest") if n.endswith(".json"))
        kept = manifests[-max(1, keep) :]
        named = {s for m in kept for s, _ in json.loads(read_text(self.spark, f"{self.path}/manifest/{m}"))["segments"]}
        for m in manifests[: -len(kept)]:
            delete(self.spark, f"{self.path}/manifest/{m}")
        for s in names_in(self.spark, f"{self.path}/segments"):
            if s.removeprefix("name=") not in named:
                delete(self.spark, f"{self.path}/segments/{s}")


def _folder(path: str, name: str) -> str:
    return f"{path}/segments/name={name}"


def _fact_names() -> list[str]:
    return T._parse_datatype_string(_FACTS).fieldNames()


def _bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(word), F.lit(buckets)).cast("int")


def _write_buckets(lists: DataFrame, path: str, buckets: int) -> None:
    """Lists by bucket of the token, sorted; a bucket is dealt over tasks by blocks."""
    dealt = lists.withColumn("bucket", _bucket(F.col("token"), buckets)).repartition("bucket", F.pmod(F.xxhash64("block"), F.lit(4))).sortWithinPartitions("bucket", "token")
    dealt.write.partitionBy("bucket").parquet(path)


def _write_frequencies(df: DataFrame, folder: str) -> None:
    df.repartition("bucket").sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(f"{folder}/table=frequencies")


def _write_vocabulary(known: DataFrame, folder: str) -> None:
    known.repartition("bucket").sortWithinPartitions("bucket", "stem").write.partitionBy("bucket").parquet(f"{folder}/table=vocabulary")


def _write_segment(spark: SparkSession, path: str, entries: DataFrame, version: int, buckets: int, literals: bool, held: DataFrame | None, removed: DataFrame | None = None) -> tuple[str, int]:
    """A segment of `entries`, which replaces the points `held` (none in a first one): its name, and how many points there are more."""
    name = uuid.uuid4().hex
    folder, at = _folder(path, name), F.lit(version).alias("segment")
    entries = entries.withColumn("id", F.col("id").cast("long"))
    parts = max(buckets, entries.rdd.getNumPartitions())
    ranged = entries.repartitionByRange(parts, "id").sortWithinPartitions("id")  # ranges are drawn from ids alone, before any text is cut
    rt.points(ranged).withColumn("segment", at).write.parquet(f"{folder}/table=points")
    points = spark.read.schema(_SCHEMAS["points"]).parquet(f"{folder}/table=points")
    _write_buckets(bl.posting_lists(points, literals).withColumn("segment", at), f"{folder}/table=postings", buckets)
    words = bl.word_lists(ranged.withColumnRenamed("id", "entry_id"), ft.whole_text(), literals)
    _write_buckets(words.withColumn("segment", at), f"{folder}/table=words", buckets)
    known = ft.vocabulary(spark.read.schema(_SCHEMAS["words"]).parquet(f"{folder}/table=words"), buckets)
    _write_vocabulary(known.withColumn("bucket", _bucket(F.col("stem"), buckets)), folder)

    chunks = points.groupBy("entry_id").agg(F.count(F.lit(1)).alias("chunks"))
    facts = entries.withColumnRenamed("id", "entry_id").select(*_fact_names())
    ids = facts.join(chunks, "entry_id", "left").select(*_fact_names(), F.coalesce("chunks", F.lit(0).cast("long")).alias("chunks"), F.lit(False).alias("removed"), at)
    if removed is not None:
        ids = ids.unionByName(removed.select("entry_id", F.lit(0).cast("long").alias("chunks"), F.lit(True).alias("removed"), at), allowMissingColumns=True)
    ids.write.parquet(f"{folder}/table=ids")

    added = spark.read.schema(_SCHEMAS["postings"]).parquet(f"{folder}/table=postings").select("token", F.size("entry_ids").alias("n"))
    gone = 0
    if held is not None:
        gone = held.count()
        added = added.unionByName(bl.posting_lists(held, literals).select("token", (-F.size("entry_ids")).alias("n")))
    df = added.groupBy("token").agg(F.sum("n").alias("df")).where("df <> 0").withColumn("bucket", _bucket(F.col("token"), buckets))
    _write_frequencies(df, folder)
    return name, points.count() - gone


def search(index: SearchIndex, queries: DataFrame, limit: int, dense: DataFrame | None = None, where: Column | None = None) -> DataFrame:
    """Hits of the keyword branch, fused with those of a dense one if given, each ranked from 0 by query."""
    branches = [index.sparse_search(queries, limit, where), *([dense] if dense is not None else [])]
    return rt.fuse(branches, limit) if len(branches) > 1 else reduce(DataFrame.unionByName, branches)
