"""The stored search index against the same search without one."""

from pyspark.sql import functions as F

from annalist.operators import retrieval as rt
from annalist.operators.index import SearchIndex, search

SCHEMA = "id long, project string, source_type string, component string, kind string, doc_status string, occurred_at timestamp, title string, body string"


def entries_of(spark, rows):
    return spark.createDataFrame([(i, "p", kind, None, None, None, None, title, body) for i, kind, title, body in rows], SCHEMA)


def hits(df):
    return sorted((r.query_id, r["rank"], r.entry_id, r.seq, r.score) for r in df.collect())


def test_index_equals_search_without_one(spark, tmp_path):
    rows = [(i, "doc" if i % 2 else "commit", f"title {i} alpha", " ".join(f"w{(i * k) % 13}" for k in range(1, 900))) for i in range(12)]
    rows += [(20, "doc", "", "   "), (21, "doc", None, None), (22, "doc", "memory of 6.8 MB", "uses qdrant.ts and snake_case")]
    entries = entries_of(spark, rows)
    index = SearchIndex.build(entries, f"file://{tmp_path}/index", buckets=4)
    queries = spark.createDataFrame([(1, "w3 w7 alpha"), (2, "6.8MB qdrant"), (3, "nothing like it"), (4, None)], "query_id long, text string")
    pts = rt.points(entries)
    post = rt.postings(pts)
    want = hits(rt.sparse_search(queries, post, rt.idf(post, pts), 7))
    assert want and hits(index.sparse_search(queries, 7)) == want
    again = SearchIndex(spark, f"file://{tmp_path}/index")
    assert again.buckets == 4 and hits(again.sparse_search(queries, 7)) == want
    doc = hits(index.sparse_search(queries, 50, F.col("source_type") == "doc"))
    assert [h[2:] for h in doc] == [h[2:] for h in hits(index.sparse_search(queries, 50)) if h[2] % 2 or h[2] >= 20]
    fts = lambda df: sorted((r.query_id, r["rank"], r.entry_id, r.score) for r in df.collect())
    assert fts(index.fts_search(queries, 5)) == fts(rt.fts_search(queries, entries.where("id <> 21"), 5))
    assert search(index, queries, 3).count() == len(hits(index.sparse_search(queries, 3)))


def test_upsert_and_scroll(spark, tmp_path):
    index = SearchIndex.build(entries_of(spark, [(i, "doc", f"t{i}", f"word{i}") for i in range(6)]), f"file://{tmp_path}/index", buckets=2)
    changed = entries_of(spark, [(2, "doc", "t2", "fresh"), (9, "doc", "t9", "fresh too")])
    index.upsert(changed)
    index.upsert(changed)
    assert [r.entry_id for r in index.scroll(3).collect()] == [0, 1, 2]
    assert [r.entry_id for r in index.scroll(10, (2, 0)).collect()] == [3, 4, 5, 9]
    found = index.sparse_search(spark.createDataFrame([(1, "fresh"), (2, "word2"), (3, "word3")], "query_id long, text string"), 5)
    assert sorted((r.query_id, r.entry_id) for r in found.collect()) == [(1, 2), (1, 9), (3, 3)]
