"""Segments of the stored index: publication, replacement, merging, and searches equal to a fresh build."""

import pytest
from pyspark.sql import functions as F

from annalist.operators import index as ix
from annalist.operators.index import SearchIndex
from annalist.storage import names_in
from tests.test_index import entries_of, hits


def rows_of(n, shift=0):
    return [(i, "doc" if i % 2 else "commit", f"title {i} alpha", " ".join(f"w{(i * k + shift) % 13}" for k in range(1, 30 + 40 * (i % 3 == 0) * 9))) for i in range(n)]


def state(index, queries):
    points = sorted((r.entry_id, r.seq, r.chunk) for r in index.points().collect())
    covered = sorted((r.entry_id, r.chunks) for r in index.coverage().collect())
    fts = sorted((r.query_id, r["rank"], r.entry_id, r.score) for r in index.fts_search(queries, 9).collect())
    return points, covered, hits(index.sparse_search(queries, 9)), fts, index.manifest["points"]


@pytest.fixture()
def queries(spark):
    return spark.createDataFrame([(1, "w3 w7 alpha"), (2, "fresh w1"), (3, "gone"), (4, "title")], "query_id long, text string")


def test_upserts_equal_a_fresh_build(spark, tmp_path, queries):
    first = {r[0]: r for r in rows_of(14)} | {13: (13, "doc", "gone", "gone word")}
    index = SearchIndex.build(entries_of(spark, first.values()), f"file://{tmp_path}/index", buckets=3)
    batches = [
        [(2, "doc", "t2", "fresh w1 w3"), (13, "doc", "", "  ")],  # 13 is emptied: its points have to go
        [(2, "doc", "t2", "fresh again"), (40, "commit", "t40", "w7 w7 fresh"), (41, "doc", None, None)],
        [r for r in rows_of(6, 5)],
    ]
    for batch in batches:
        index.upsert(entries_of(spark, batch))
        first |= {r[0]: r for r in batch}
    fresh = SearchIndex.build(entries_of(spark, first.values()), f"file://{tmp_path}/fresh", buckets=3)
    assert state(index, queries) == state(fresh, queries)
    assert dict(state(index, queries)[1])[13] == 0  # an entry without chunks is covered at once
    index.upsert(entries_of(spark, batches[-1]))  # again: nothing changes
    index.remove(spark.createDataFrame([(40,), (0,), (999,)], "entry_id long"))
    fresh = SearchIndex.build(entries_of(spark, [r for i, r in first.items() if i not in (0, 40)]), f"file://{tmp_path}/fresh", buckets=3)
    want = state(fresh, queries)
    assert state(index, queries) == want
    index.merge()
    assert len(index.manifest["segments"]) == 1 and state(index, queries) == want
    index.vacuum(keep=1)
    assert names_in(spark, f"{index.path}/segments") == ["name=" + index.manifest["segments"][0][0]]
    assert state(SearchIndex(spark, index.path), queries) == want
    assert [(r.entry_id, r.seq) for r in index.scroll(4, (3, 0)).collect()] == [(e, s) for e, s, _ in want[0] if (e, s) > (3, 0)][:4]


def test_nothing_half_published(spark, tmp_path, queries, monkeypatch):
    index = SearchIndex.build(entries_of(spark, rows_of(5)), f"file://{tmp_path}/index", buckets=2)
    before = state(index, queries)
    changed = entries_of(spark, [(1, "doc", "t", "fresh"), (9, "doc", "t", "fresh")])
    for step in ("_write_frequencies", "_write_buckets"):
        with monkeypatch.context() as m:
            def lost(*_):
                raise OSError("lost driver")

            m.setattr(ix, step, lost)
            with pytest.raises(OSError):
                index.upsert(changed)
            with pytest.raises(OSError):
                index.merge()
        assert state(SearchIndex(spark, index.path), queries) == before
    with monkeypatch.context() as m:
        m.setattr(ix, "write_new", lambda *_: (_ for _ in ()).throw(OSError("lost driver")))
        with pytest.raises(OSError):
            index.upsert(changed)
    assert state(SearchIndex(spark, index.path), queries) == before
    index.upsert(changed)
    assert {r.entry_id for r in SearchIndex(spark, index.path).sparse_search(queries.where("query_id = 2"), 5).collect()} >= {1, 9}


def test_writers_that_meet_and_readers_that_stay(spark, tmp_path, queries):
    index = SearchIndex.build(entries_of(spark, rows_of(5)), f"file://{tmp_path}/index", buckets=2)
    other, reader = SearchIndex(spark, index.path), SearchIndex(spark, index.path)
    before = state(reader, queries)
    index.upsert(entries_of(spark, [(1, "doc", "t", "fresh")]))
    with pytest.raises(FileExistsError):
        other.upsert(entries_of(spark, [(2, "doc", "t", "fresh")]))
    assert state(reader, queries) == before
    other.refresh()
    other.upsert(entries_of(spark, [(2, "doc", "t", "fresh")]))
    reader.refresh()
    assert state(reader, queries) == state(other, queries) != before


def test_an_upsert_reads_few_rows(spark, tmp_path):
    """The points that an upsert looks at are bounded by its ids in the plan of the scan."""
    index = SearchIndex.build(entries_of(spark, rows_of(40)), f"file://{tmp_path}/index", buckets=4)
    held = index._held(spark.createDataFrame([(3,), (5,)], "entry_id long"))
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "In(entry_id, [3,5])" in plan.replace(" ", "").replace("In(entry_id,[3,5])", "In(entry_id, [3,5])")
    assert {r.entry_id for r in held.collect()} == {3, 5}
    assert held.where(F.col("seq") < 0).count() == 0
