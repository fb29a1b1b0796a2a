"""A stored index of vectors: cells around centroids, a byte a component, and full vectors to score what the bytes find.

The centroids are fitted on a bounded sample; every vector then joins its nearest cell. A search probes the cells nearest to each query, ranks
their vectors by bytes, and scores the best of them again from the full vectors, which are read by cell and id. How many cells are
probed is measured at the build: as many as hold RECALL of the true neighbours of a sample of vectors. Vectors without groups
need most cells, grouped ones few. The index can be opened only when its last file is in.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from annalist.operators import retrieval as rt
from annalist.storage import names_in, read_text, write_new, written

#: Vectors that a cell is meant to hold, most cells, and most vectors the centroids are fitted on.
CELL_ROWS, MOST_CELLS, SAMPLE_ROWS = 1024, 4096, 65_536
ROUNDS = 8
#: How many times the limit is scored in full.
OVERSAMPLE = 4
#: Share of true neighbours that the probed cells are to hold, and how many vectors it is measured with, by the scan of all.
RECALL, MEASURED, NEIGHBOURS = 0.995, 256, 10
#: Parts that a cell's vectors are dealt over when written, so that a cell with very many isn't one task.
SALT = 4


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids by rounds of spherical k-means, begun at evenly spread rows of the sample; an empty cell keeps its centroid."""
    x = _unit(sample.astype(np.float32))
    centroids = x[np.linspace(0, len(x) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        nearest = np.concatenate([(part @ centroids.T).argmax(1) for part in np.array_split(x, -(-len(x) * cells // rt.STRIP_SCORES) or 1)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        met = np.linalg.norm(sums, axis=1) > 0
        centroids[met] = _unit(sums[met])
    return centroids


def _assigner(centroids: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            full = np.stack(batch["embedding"].to_numpy()).astype(np.float64)
            x = _unit(full)
            top = np.abs(x).max(axis=1, keepdims=True)
            codes = np.rint(x / np.where(top > 0, top, 1) * 127).astype(np.int8)
            cell = (x.astype(np.float32) @ centroids.T).argmax(1)
            yield pd.DataFrame(
                {"cell": cell.astype(np.int32), "entry_id": batch["entry_id"], "code": [c.tobytes() for c in codes], "scale": (top[:, 0] / 127).astype(np.float32), "embedding": list(full)}
            )

    return run


class DenseIndex:
    """The index at `path`: a table of cell, entry_id, code, scale and embedding, partitioned by cell and sorted by id."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        if "index.json" not in names_in(spark, self.path):
            raise FileNotFoundError(f"no index is published at {path}")
        meta = json.loads(read_text(spark, f"{self.path}/index.json"))
        self.table = meta["table"]
        self.centroids = np.array(meta["centroids"], dtype=np.float32)
        self.probes = meta["probes"]

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cell_rows: int = CELL_ROWS, sample_rows: int = SAMPLE_ROWS) -> DenseIndex:
        """Index `vectors(entry_id, embedding)` in a new folder; rows without a vector are left out, all vectors have one length."""
        spark, path = vectors.sparkSession, path.rstrip("/")
        rows = vectors.select("entry_id", F.col("embedding").cast("array<double>").alias("embedding")).where("embedding IS NOT NULL")
        n = rows.count()
        cells = max(1, min(MOST_CELLS, round(n / cell_rows)))
        sample = rows.orderBy(F.xxhash64("entry_id"), "entry_id").limit(min(sample_rows, 64 * cells)).collect()
        centroids = fit_centroids(np.array([r["embedding"] for r in sample]), min(cells, len(sample))) if sample else np.zeros((1, 1), dtype=np.float32)
        table = f"table-{uuid.uuid4().hex}"
        found = rows.mapInPandas(_assigner(centroids), "cell int, entry_id long, code binary, scale float, embedding array<double>")
        dealt = found.repartition("cell", F.pmod(F.xxhash64("entry_id"), F.lit(SALT))).sortWithinPartitions("cell", "entry_id")
        dealt.write.partitionBy("cell").parquet(f"{path}/{table}")
        probes = _probes_needed(spark.read.parquet(f"{path}/{table}"), centroids) if sample else 1
        write_new(spark, f"{path}/index.json", json.dumps({"table": table, "centroids": centroids.tolist(), "probes": probes}))
        return cls(spark, path)

    def _rows(self, cells: list[int]) -> DataFrame:
        schema = "entry_id long, code binary, scale float, embedding array<double>, cell int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/{self.table}").where(F.col("cell").isin(cells))

    def search(self, queries: DataFrame, limit: int, probes: int | None = None, oversample: int = OVERSAMPLE, exclude_self: bool = False) -> DataFrame:
        """As `retrieval.dense_search`, from the cells probed: query_id, entry_id, score (cosine of full vectors), rank. Batches above
        `retrieval.FEW_QUERIES` go slice by slice; a null query finds nothing."""
        probes = probes or self.probes
        asked = queries.select("query_id", "embedding").where("embedding IS NOT NULL")
        some = asked.limit(rt.FEW_QUERIES + 1).collect()
        if len(some) <= rt.FEW_QUERIES:
            return self._slice(some, limit, probes, oversample, exclude_self)
        del some
        every = written(asked, "dense-index-queries")
        rows = written(every.repartition(-(-every.count() // rt.FEW_QUERIES)), "dense-index-queries").toLocalIterator()
        slices = []
        while part := list(islice(rows, rt.FEW_QUERIES)):
            slices.append(written(self._slice(part, limit, probes, oversample, exclude_self), "dense-index-slice"))
        return reduce(DataFrame.unionByName, slices)

    def _slice(self, asked: list[Row], limit: int, probes: int, oversample: int, exclude_self: bool) -> DataFrame:
        ids = np.array([r["query_id"] for r in asked], dtype=np.int64)
        q = _unit(np.array([r["embedding"] for r in asked], dtype=np.float64).reshape(len(asked), -1 if asked else 1))
        near = np.argsort(-(q.astype(np.float32) @ self.centroids.T), axis=1, kind="stable")[:, :probes] if len(asked) else np.zeros((0, 1), dtype=int)
        by_cell = {int(c): np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}
        rows, most = self._rows(sorted(by_cell)), limit * oversample

        def by_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: pd.DataFrame | None = None
            for batch in batches:
                for cell, part in batch.groupby("cell", sort=False):
                    who = by_cell[int(cell)]
                    strip = max(1, rt.STRIP_SCORES // len(who))
                    for at in range(0, len(part), strip):
                        own = part.iloc[at : at + strip]
                        x = np.frombuffer(b"".join(own["code"]), dtype=np.int8).reshape(len(own), -1).astype(np.float32)
                        score = (x @ q[who].T.astype(np.float32)) * own["scale"].to_numpy()[:, None]
                        entry = own["entry_id"].to_numpy()
                        if exclude_self:
                            score[entry[:, None] == ids[who][None, :]] = -np.inf
                        keep = np.argsort(-score, axis=0, kind="stable")[:most]
                        found = pd.DataFrame({"query_id": np.tile(ids[who], len(keep)), "entry_id": entry[keep].ravel(), "cell": np.int32(cell), "score": np.take_along_axis(score, keep, 0).ravel().astype(np.float64)})
                        held = found if held is None else pd.concat([held, found])
                        held = held.sort_values(["query_id", "score", "entry_id"], ascending=[True, False, True]).groupby("query_id").head(most)
            if held is not None:
                yield held[np.isfinite(held["score"])]

        rough = rows.select("cell", "entry_id", "code", "scale").mapInPandas(by_bytes, "query_id long, entry_id long, cell int, score double")
        candidates = written(rt._top(rough, most, "entry_id").select("query_id", "cell", "entry_id"), "dense-candidates")
        wanted = [r["entry_id"] for r in candidates.select("entry_id").distinct().limit(rt.FEW_QUERIES + 1).collect()]
        full = rows.select("cell", "entry_id", "embedding")
        if len(wanted) <= rt.FEW_QUERIES:
            full = full.where(F.col("entry_id").isin(wanted))
        place = {int(i): k for k, i in enumerate(ids)}

        def in_full(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    x = np.stack(batch["embedding"].to_numpy())
                    norm = np.linalg.norm(x, axis=1)
                    own = q[[place[i] for i in batch["query_id"].tolist()]]
                    score = np.round((x * own).sum(axis=1) / np.where(norm > 0, norm, 1), 9)
                    yield pd.DataFrame({"query_id": batch["query_id"], "entry_id": batch["entry_id"], "score": score})

        scored = candidates.join(full, ["cell", "entry_id"]).select("query_id", "entry_id", "embedding").mapInPandas(in_full, "query_id long, entry_id long, score double")
        return rt._top(scored, limit, "entry_id")


def _probes_needed(table: DataFrame, centroids: np.ndarray) -> int:
    """The fewest cells, nearest first, that hold RECALL of the neighbours of MEASURED vectors of the table."""
    queries = table.orderBy(F.xxhash64("entry_id", F.lit(1)), "entry_id").limit(MEASURED).select(F.col("entry_id").alias("query_id"), "embedding").collect()
    spark = table.sparkSession
    exact = rt.dense_search(spark.createDataFrame(queries, "query_id long, embedding array<double>"), table, NEIGHBOURS, exclude_self=True).select("query_id", "entry_id").collect()
    hits = sorted({r["entry_id"] for r in exact})  # at most MEASURED * NEIGHBOURS
    cell = {r["entry_id"]: r["cell"] for r in table.where(F.col("entry_id").isin(hits)).select("entry_id", "cell").collect()}
    q = _unit(np.array([r["embedding"] for r in queries], dtype=np.float64)).astype(np.float32)
    place = np.argsort(np.argsort(-(q @ centroids.T), axis=1, kind="stable"), axis=1)
    row = {r["query_id"]: k for k, r in enumerate(queries)}
    needed = sorted(int(place[row[r["query_id"]], cell[r["entry_id"]]]) + 1 for r in exact)
    return needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))) - 1)] if needed else 1


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact hits that were found."""
    wanted = exact.select("query_id", "entry_id")
    return wanted.join(found.select("query_id", "entry_id"), ["query_id", "entry_id"], "left_semi").count() / max(1, wanted.count())
