"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is reduced to one row per digest by a map-side combined
aggregation and merge-joined with the index bucket by bucket (the index is never shuffled again); what the index doesn't
hold is appended. Only DataFrame operations run here.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.shared import column, delete_folder, discard, new_path, settle, settle_counted, text_or_empty

#: A digest with more than 1/HOT_SHARE of a batch's rows is hot; there are fewer than HOT_SHARE of them, so they can be broadcast.
HOT_SHARE = 1000
#: Digests a bucket is laid out for, about 200 MB, and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 2_000_000, 8


class DigestIndex:
    """Digests seen so far, with the id that stays and how often each was seen.

    `path` holds the files, in a folder named by the number of buckets, so an index outlives the session: opening the same path again finds
    its rows. `buckets` are as many as the first batch's rows ask for unless named; name them where far more is to come, as a merge runs
    one task a bucket. Running an ingest a second time (after a lost driver, say) gives the same decisions, because a row whose id is the
    index's own `keep_id` counts as kept and `group_size` is taken from the batch's own aggregation.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.buckets = spark, buckets
        self.path = path or new_path(spark, "digest-index")
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
        laid = sorted(int(name.removeprefix("buckets-")) for name in found if name.startswith("buckets-"))
        if laid:
            self.buckets = laid[-1]

    def _table(self, folder: str | None = None) -> str:
        name = f"digest_index_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {name} (digest STRING, keep_id BIGINT, group_size BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{folder or self._folder()}'"
        )
        return name

    def _folder(self) -> str:
        return f"{self.path}/buckets-{self.buckets}"

    def _drop(self, name: str) -> None:
        """Take the name from the catalog; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def rows(self) -> DataFrame:
        """All rows of the index."""
        schema = "digest string, keep_id long, group_size long"
        return self.spark.read.schema(schema).parquet(self._folder()) if self.buckets else self.spark.createDataFrame([], schema)

    def compact(self) -> None:
        """Rewrite the index as one sorted file a bucket, where many appended batches have left several."""
        copy = settle(self.rows(), "digest-index-copy")
        delete_folder(self.spark, self._folder())
        name = self._table()
        copy.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(name)
        self._drop(name)
        discard(copy)

    def _decide(self, docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame, int]:
        """→ (doc_id, digest) of all rows; (digest, keep_id, group_size) of the batch, whose new digests the index holds from now on; rows."""
        digests, rows = settle_counted(docs.select(column(id_column).cast("long").alias("doc_id"), F.sha2(text_or_empty(text_column), 256).alias("digest")), "digests")
        if not self.buckets:
            self.buckets = max(LEAST_BUCKETS, 1 << max(0, -(-rows // BUCKET_ROWS) - 1).bit_length())
        name = self._table()
        groups = digests.groupBy("digest").agg(F.max("doc_id").alias("own_id"), F.count(F.lit(1)).alias("group_size"))
        held = self.spark.table(name).select("digest", F.col("keep_id").alias("held_id"), F.lit(True).alias("held"))
        known = F.coalesce("held", F.lit(False))
        decided = groups.join(held.hint("merge"), "digest", "left").select(
            "digest", F.when(known, F.col("held_id")).otherwise(F.col("own_id")).alias("keep_id"), "group_size", known.alias("held")
        )
        decided = settle(decided, "digest-decisions")
        new = decided.where("NOT held").select("digest", "keep_id", "group_size").repartition(self.buckets, "digest")
        new.sortWithinPartitions("digest").write.insertInto(name)
        self._drop(name)
        return digests, decided.drop("held"), rows

    def ingest(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
        """Add a batch; → one row per input row: doc_id, keep_id, group_size, kept, text_sha256.

        Equal means identical code for code (SHA-256 of the UTF-8 text); null text counts as empty. Of equal texts new to
        the index the largest id stays; of texts it already holds none stays but the index's own. `group_size` counts the
        batch's rows of that text. Ids may repeat: equal rows with the id that stays are all marked kept. A null id stays only where
        every id of its group is null, with `keep_id` null. Other columns are ignored. An empty batch gives no row.
        """
        return self._spread(*self._decide(docs, id_column, text_column))

    def keep(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
        """Ingest a batch and return its rows that stay, one a text, with all their columns, whatever their names."""
        digests, decided, _ = self._decide(docs, id_column, text_column)
        discard(digests)
        of = lambda digest, i: F.concat(digest, F.lit(":"), F.coalesce(i.cast("string"), F.lit("")))
        rows = docs.select(F.struct(*map(column, docs.columns)).alias("doc"), of(F.sha2(text_or_empty(text_column), 256), column(id_column).cast("long")).alias("key"))
        met = rows.join(decided.select(of(F.col("digest"), F.col("keep_id")).alias("key")), "key")
        return met.dropDuplicates(["key"]).select(*(F.col("doc").getField(c).alias(c) for c in docs.columns))

    def _spread(self, digests: DataFrame, decided: DataFrame, rows: int) -> DataFrame:
        """Carry decisions back to rows. Hot digests, fewer than HOT_SHARE by their definition, go by broadcast."""
        hot_from = rows // HOT_SHARE + 1
        hot = decided.where(F.col("group_size") > hot_from)
        flagged = digests.join(F.broadcast(hot), "digest", "left")
        is_hot = F.col("group_size").isNotNull()
        cold = flagged.where(~is_hot).select("doc_id", "digest").join(decided.where(F.col("group_size") <= hot_from), "digest")
        columns = ["doc_id", "keep_id", "group_size", "digest"]
        return flagged.where(is_hot).select(*columns).union(cold.select(*columns)).select(
            "doc_id",
            "keep_id",
            "group_size",
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )
