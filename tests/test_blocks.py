"""Tokens, lists and scores by blocks against the rows they stand for."""

import random

import numpy as np
from pyspark.sql import functions as F

from annalist.functions.text import tokenize
from annalist.operators import blocks as bl
from annalist.operators import retrieval as rt
from annalist.operators.index import SearchIndex
from tests.test_index import entries_of, hits


def test_tokens_of_texts_are_those_of_columns(spark):
    draw = random.Random(5)
    parts = ["6.8", " ", "MB", "mb", "a", "b.c", "Foo.bar", "x.ts", "12", "3.4.5", "...", "_x", "h", "min", "5min", ".5", ".", "\n", "é", "İ", "K", "the", "run", "1a", "9.", "mail4.example.com"]
    texts = [None, "", " ", *("".join(draw.choices(parts, k=draw.randint(1, 30))) for _ in range(400))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    for literals in (True, False):
        codes, text_of, words = bl.token_codes(texts, literals)
        want = {r.i: r.k for r in rows.select("i", tokenize(F.col("t"), literals).alias("k")).collect()}
        assert [[words[c] for c in codes[text_of == i]] for i in range(len(texts))] == [want[i] for i in range(len(texts))]


def test_words_of_one_hash_are_two(spark, tmp_path):
    """`liquid` and `costarring` have the same 32-bit hash."""
    entries = entries_of(spark, [(1, "doc", "one", "liquid"), (2, "doc", "two", "costarring")])
    index = SearchIndex.build(entries, f"file://{tmp_path}/index", buckets=2)
    asked = spark.createDataFrame([(7, "liquid")], "query_id long, text string")
    assert [h[2] for h in hits(index.sparse_search(asked, 5))] == [1]
    assert [h[2] for h in hits(rt.search_texts(asked, entries.select(F.col("id").alias("entry_id"), F.lit(0).alias("seq"), F.col("body").alias("chunk")), 5))] == [1]


def test_a_row_holds_a_word_of_many_entries(spark, tmp_path):
    index = SearchIndex.build(entries_of(spark, [(i, "doc", "same", "same words here") for i in range(50)]), f"file://{tmp_path}/index", buckets=2)
    for table in ("postings", "words"):
        assert index._table(table, index.manifest["segments"]).groupBy("token").count().agg(F.max("count")).first()[0] <= 2


def test_slices_of_queries_and_far_ids(spark, tmp_path, monkeypatch):
    draw = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, "doc" if i % 3 else "commit", "", " ".join(draw.choices(words, k=40))) for i in (-9_000_000_000, -1, 0, 4095, 4096, *range(5000, 5060), 2**62)]
    entries = entries_of(spark, rows)
    asked = spark.createDataFrame([(q, " ".join(draw.choices(words, k=4))) for q in range(7)], "query_id long, text string")
    index = SearchIndex.build(entries, f"file://{tmp_path}/index", buckets=2)
    pts = rt.points(entries)
    post = rt.postings(pts)
    want = hits(rt.sparse_search(asked, post, rt.idf(post, pts), 9))
    index.upsert(entries_of(spark, rows[3:9]))  # as they were: what the first segment has of them doesn't count
    results = lambda: (hits(index.sparse_search(asked, 9)), hits(rt.search_texts(asked, pts, 9)), sorted(index.ranked_search(asked, 9, F.col("source_type") == "doc").collect()))
    whole = results()
    assert whole[0] == want and whole[1] == want and whole[2]
    monkeypatch.setattr(bl, "FEW_QUERIES", 3)
    assert results() == whole


def test_scores_in_strips(monkeypatch):
    draw = np.random.default_rng(1)
    asked = bl.Asked([(q, f"t{t}", float(q + t + 1)) for q in range(6) for t in range(5) if (q + t) % 3])
    code, point, value = draw.integers(0, 5, 80), draw.integers(0, 11, 80), draw.random(80)
    whole, ones = asked.sums(0, 6, 11, code, point, value, None)
    dense = np.zeros((6, 11))
    for q in range(6):
        for c, p, v in zip(code, point, value, strict=True):
            dense[q, p] += ((q + c) % 3 > 0) * (q + c + 1) * v
    assert np.allclose(whole, dense)
    monkeypatch.setattr(bl, "STRIP_SCORES", 25)
    parts = [asked.sums(low, high, 11, code, point, value, None) for low, high in asked.strips(11)]
    assert len(parts) == 3 and np.allclose(np.vstack([p[0] for p in parts]), whole) and np.allclose(np.vstack([p[1] for p in parts]), ones)


def test_best_of_equals_are_the_first():
    scores = np.array([[1.0, 3.0, 0.0, 3.0, 3.0], [0.0, 0.0, 0.0, 2.0, 0.0]])
    rows, columns = bl._best(scores, 2)
    assert list(zip(rows.tolist(), columns.tolist(), strict=True)) == [(0, 1), (0, 3), (1, 3)]
