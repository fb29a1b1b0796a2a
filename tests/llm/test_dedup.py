"""Exact, near and vector deduplication against brute force."""

import hashlib
import random

import numpy as np
import pytest

from annalist.llm import embedding_dedup, minhash
from annalist.llm.components import connected_components, permuted, restored
from annalist.llm.embedding_dedup import near_duplicate_vectors
from annalist.llm.exact_dedup import DigestIndex
from annalist.llm.minhash import near_duplicates, shared_counts


def groups(ids, linked):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, k) for k in range(5001, 5100)] + [(7, 7)]
    for parts in (1, 7, 40):
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long").repartition(parts)).collect()}
        want = groups({x for p in pairs for x in p}, pairs)
        assert set(got) == set(want) and len({(got[x], want[x]) for x in got}) == len(set(got.values())) == len(set(want.values()))
    ids = np.array([0, 1, -1, 2**63 - 1, -(2**63), 12345], dtype=np.int64)
    assert all((restored(permuted(ids, t), t) == ids).all() for t in range(5))
    with_null = spark.createDataFrame([(None, 1), (3, None), (4, 4)], "a long, b long")
    assert [tuple(r) for r in connected_components(with_null).collect()] == [(4, 4)]
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_dedup(spark):
    rows = [(1, "a"), (5, "a"), (3, "A"), (2, None), (4, ""), (9, "x" * 200_000), (6, "a"), (7, "b"), (7, "b"), (None, "b"), (None, "only null")]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, digest string")
    index = DigestIndex(spark, buckets=3)
    got = index.ingest(docs).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.text_sha256): r for r in got}
    of = lambda i, t: by[(i, hashlib.sha256(t.encode()).hexdigest())]
    assert [(of(i, "a").keep_id, of(i, "a").group_size, of(i, "a").kept) for i in (1, 5, 6)] == [(6, 3, False), (6, 3, False), (6, 3, True)]
    assert of(2, "").keep_id == 4 and of(4, "").kept and of(3, "A").kept
    assert of(7, "b").kept and not of(None, "b").kept and of(7, "b").group_size == 3
    assert of(None, "only null").kept and of(None, "only null").keep_id is None
    later = {r.doc_id: r for r in index.ingest(spark.createDataFrame([(100, "a"), (101, "new")], "doc_id long, text string")).collect()}
    assert (later[100].kept, later[100].keep_id, later[101].kept) == (False, 6, True)
    again = {r.doc_id: r.kept for r in index.ingest(spark.createDataFrame([(100, "a"), (101, "new")], "doc_id long, text string")).collect()}
    assert again == {100: False, 101: True}


def test_exact_dedup_keep_and_empty(spark):
    docs = spark.createDataFrame([(1, "a", "s"), (2, "a", "s"), (3, "b", "s"), (3, "b", "s")], "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in DigestIndex(spark, buckets=2).keep(docs).collect()) == [2, 3]
    assert DigestIndex(spark, buckets=2).ingest(docs.limit(0)).count() == 0


def test_index_outlives_its_session_table(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    DigestIndex(spark, path, buckets=2).ingest(docs)
    assert not DigestIndex(spark, path, buckets=2).ingest(spark.createDataFrame([(2, "a")], "doc_id long, text string")).first().kept


def shingles(text, width=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())


def near_texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randrange(30, 200))]
        for _ in range(rng.randrange(1, 30)):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += ["", None, "   \n", "One two", "one TWO", "a b c d e", "a b c d e f", texts[0], texts[0].upper()]
    return texts


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, percent, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 8)
    texts = near_texts()
    rows = [(i * 3, t, "x") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, rep string"), percent=percent).collect()}
    sets = {i: shingles(t) for i, t, _ in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    expected = groups(sets, linked)
    assert {i: r.component_id for i, r in got.items()} == expected
    assert all(got[i].n_shingles == len(sets[i]) and got[i].kept == (expected[i] == i) for i in sets)


def test_near_duplicates_of_odd_ids(spark):
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(None, text), (4, text), (4, text), (2, text + " more"), (None, "alone in here with five words"), (8, "other " + text[::-1]), (8, "z y x w v u")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=80).collect()
    assert len(got) == len(rows)
    assert {r.component_id for r in got if r.doc_id in (4, 2)} == {2}
    assert sum(r.doc_id is None and r.component_id == 2 for r in got) == 1
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shared_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 400, n).astype(np.uint64)) for n in (3, 200, 150, 0, 77)]
    got = shared_counts(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(5) for j in range(5) if i != j)


def test_estimate_is_close(spark):
    a, b = ({f"{x}".encode() for x in range(s, s + 1000)} for s in (0, 100))
    hashes = [minhash.wordhash.mix(np.array(sorted(hash(x) & (2**64 - 1) for x in s), dtype=np.uint64)) for s in (a, b)]
    packed = minhash.pack(np.array([minhash.minima(h) for h in hashes]))
    rows = spark.createDataFrame([([int(v) for v in packed[0]], [int(v) for v in packed[1]])], "x array<long>, y array<long>")
    assert abs(rows.select(minhash.estimate("x", "y")).first()[0] - 900 / 1100) < 0.15


def test_vectors(spark):
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for label in (0, 1):
        for _ in range(6):
            base = rng.standard_normal(16)
            for _ in range(int(rng.integers(1, 40))):
                rows.append((n, (base + rng.normal(0, 0.12, 16)).astype(np.float32).tolist(), label))
                n += 1
    good = list(rows)
    rows += [(n, good[0][1], 1), (n + 1, good[0][1], 0), (n + 2, None, 0), (n + 3, [0.0] * 16, 0), (n + 4, [float("nan")] * 16, 0), (n + 5, [None] * 16, 0), (n + 6, good[1][1], None), (n + 7, [], 0), (n + 8, [1.0, 2.0], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in near_duplicate_vectors(frame, window=8).collect()}
    valid = {i: (np.array(v, dtype=np.float64), c) for i, v, c in rows if v and c is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    cos = lambda x, y: float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)) if len(x) == len(y) else 0.0
    linked = [(a, b) for a in valid for b in valid if a < b and valid[a][1] == valid[b][1] and cos(valid[a][0], valid[b][0]) >= 0.93]
    expected = groups([r[0] for r in rows], linked)
    assert {i: r.component_id for i, r in got.items()} == expected
    degree = dict.fromkeys(expected, 0)
    for a, b in linked:
        degree[a] += 1
        degree[b] += 1
    assert {i: r.n_links for i, r in got.items()} == degree
    assert near_duplicate_vectors(frame.limit(0)).count() == 0


def test_vectors_of_odd_rows(spark):
    """Null and repeated ids, huge and tiny components, clashing names."""
    rows = [(None, [1.0, 0.0], 0), (5, [1.0, 0.0], 0), (5, [1.0, 0.01], 0), (5, [0.0, 1.0], 0), (9, [1e200, 1e200], 1), (8, [1e-200, 1e-200], 1), (7, [-1e200, 1e200], 1)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, rep string, same int")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in near_duplicate_vectors(frame).collect())
    assert got == [(0, 0, None, True), (5, 0, 5, True), (5, 1, 5, True), (5, 1, 5, True), (7, 0, 7, True), (8, 1, 8, True), (9, 1, 8, False)]


def test_vectors_that_windows_miss(spark):
    """Pairs in a label of spread-out vectors, far apart in the order of the only pass: every link is found nevertheless."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((1500, 32))
    near = base[:300] + 0.35 * rng.standard_normal((300, 32))
    x = np.concatenate([base, near])
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(3)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = np.triu(unit @ unit.T >= 0.93, 1)
    expected, degree = groups(range(len(x)), np.argwhere(hit).tolist()), hit.sum(axis=0) + hit.sum(axis=1)
    assert hit.sum() > 100
    for values in (1 << 19, 1 << 13):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(embedding_dedup, "BLOCK_VALUES", values, raising=False)
            got = near_duplicate_vectors(frame, passes=1, window=2).collect()
        assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (degree[i], expected[i]) for i in expected}
