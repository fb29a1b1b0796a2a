"""The stored index of vectors against the exact scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from annalist.operators import retrieval as rt
from annalist.operators.dense_index import DenseIndex, recall


def vectors_of(spark, n, dims, seed, groups=30):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    x = centres[rng.integers(0, groups, n)] + rng.normal(scale=0.6, size=(n, dims))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "entry_id long, embedding array<double>")


def test_recall_against_the_exact_scan(spark, tmp_path):
    vectors = vectors_of(spark, 12_000, 24, 1).repartition(4)
    index = DenseIndex.build(vectors, f"file://{tmp_path}/index", cell_rows=200)
    assert len(index.centroids) == 60 and 1 <= index.probes < 30  # grouped vectors need few cells
    queries = vectors.where("entry_id % 50 = 0").select(F.col("entry_id").alias("query_id"), "embedding")
    exact = rt.dense_search(queries, vectors, 10, exclude_self=True)
    found = index.search(queries, 10, exclude_self=True)
    assert recall(found, exact) >= 0.99
    scores = {(r.query_id, r.entry_id): r.score for r in exact.collect()}
    both = [(r.score, scores[r.query_id, r.entry_id]) for r in found.collect() if (r.query_id, r.entry_id) in scores]
    assert all(abs(a - b) < 2e-9 for a, b in both)  # full vectors score, not bytes
    one = DenseIndex(spark, index.path).search(queries.where("query_id = 50"), 10, probes=3)
    assert one.count() == 10 and one.orderBy("rank").first().entry_id == 50
    plan = index._rows([1, 2, 3]).select("entry_id", "code")._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "cell" in scan.split("PartitionFilters: [")[1].split("]")[0]  # other cells aren't read
    assert "embedding" not in scan.split("ReadSchema")[1]  # and of these the bytes alone


def test_vectors_without_groups_need_most_cells(spark, tmp_path):
    rng = np.random.default_rng(4)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(3000, 24)))], "entry_id long, embedding array<double>")
    index = DenseIndex.build(vectors, f"file://{tmp_path}/index", cell_rows=100)
    queries = vectors.where("entry_id % 20 = 0").select(F.col("entry_id").alias("query_id"), "embedding")
    assert recall(index.search(queries, 10, exclude_self=True), rt.dense_search(queries, vectors, 10, exclude_self=True)) >= 0.99
    assert index.probes > 15 and DenseIndex(spark, index.path).probes == index.probes


def test_ties_odd_rows_and_unpublished(spark, tmp_path, monkeypatch):
    rows = [(i, [1.0, 0.0]) for i in range(30)] + [(40, [0.0, 0.0]), (41, None), (42, [-1.0, 0.5])]
    vectors = spark.createDataFrame(rows, "entry_id long, embedding array<double>")
    index = DenseIndex.build(vectors, f"file://{tmp_path}/index", cell_rows=8)
    queries = spark.createDataFrame([(7, [2.0, 0.0]), (8, None)], "query_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.entry_id, r.score) for r in index.search(queries, 5, exclude_self=True).orderBy("rank").collect()]
    assert got == [(7, k, e, 1.0) for k, e in enumerate([0, 1, 2, 3, 4])]
    monkeypatch.setattr(rt, "FEW_QUERIES", 1)
    many = spark.createDataFrame([(7, [2.0, 0.0]), (9, [-1.0, 0.4])], "query_id long, embedding array<double>")
    assert {(r.query_id, r.entry_id) for r in index.search(many, 1).collect()} == {(7, 0), (9, 42)}
    with pytest.raises(FileNotFoundError):
        DenseIndex(spark, f"file://{tmp_path}/nothing")
    empty = DenseIndex.build(vectors.limit(0), f"file://{tmp_path}/empty")
    assert empty.search(queries.limit(0), 3).count() == 0
