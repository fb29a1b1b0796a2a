"""Codes against Lloyd rounds in Python integers, point by point."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from annalist.llm import vector_codes
from annalist.llm.vector_codes import Tree, encode_vectors, scaled


def by_hand(rows, parts=8, entries=16, rounds=6):
    """(id, vector, label) of kept rows → {id: (code, error, label_error)} and the codebooks' digest."""
    rows = sorted(rows)
    whole = {i: [math.floor(4096 * Fraction(x)) for x in v] for i, v, _ in rows}
    d = len(rows[0][1]) // parts
    cut = {i: [v[p * d : (p + 1) * d] for p in range(parts)] for i, v in whole.items()}
    books = [[cut[i][p] for i, _, _ in rows[:entries]] for p in range(parts)]

    def nearest(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, z, strict=True)), e) for e, z in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = {}
            for i in cut:
                groups.setdefault(nearest(book, cut[i][p])[1], []).append(cut[i][p])
            books[p] = [[sum(c) // len(groups[e]) for c in zip(*groups[e], strict=True)] if e in groups else z for e, z in enumerate(book)]
    found = {i: [nearest(books[p], cut[i][p]) for p in range(parts)] for i in cut}
    error = {i: sum(x for x, _ in f) for i, f in found.items()}
    of_label = {}
    for i, _, label in rows:
        of_label[label] = of_label.get(label, 0) + error[i]
    fits = lambda x: x if x < 2**63 else None
    lost = {label for i, _, label in rows if fits(error[i]) is None}
    out = {i: (bytes(e for _, e in found[i]).hex(), fits(error[i]), None if label in lost else fits(of_label[label])) for i, _, label in rows}
    return out, hashlib.sha256(",".join(str(x) for b in books for z in b for x in z).encode()).hexdigest()


def coded(df, **settings):
    rows = encode_vectors(df, **settings).collect()
    return {r.vec_id: (r.code, r.error, r.label_error) for r in rows}, {r.codebooks_sha256 for r in rows}


def vectors(n, dims, seed):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(9)]
    return [(i * 3, [float(np.float32(c + rng.gauss(0, 0.2))) for c in rng.choice(centres)], rng.choice([1, 2, 2, 2, None])) for i in range(n)]


@pytest.mark.parametrize("n,dims", [(300, 16), (7, 8), (40, 32)])
def test_codes_equal_plain_rounds(spark, monkeypatch, n, dims):
    monkeypatch.setattr(vector_codes, "BLOCK", 64)
    rows = vectors(n, dims, n)
    rows += [(10**6 + i, rows[0][1], 3) for i in range(50)]  # one very common vector
    bad = [(-1, None, 1), (-2, [1.0] * (dims - 1) + [None], 1), (-3, [float("nan")] * dims, 2), (-4, [float("inf")] + [0.0] * (dims - 1), 2), (-5, [], 1), (10**9, [1.0] * (dims + 8), 1), (10**9 + 1, [1.0] * (dims - 1), 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows + bad], "vec_id long, embedding array<float>, label int, code string").repartition(4)
    want, digest = by_hand(rows)
    assert coded(df) == (want, {digest})


def test_values_of_any_size(spark):
    rows = vectors(60, 8, 1)
    rows[4] = (rows[4][0], [3e38] * 4 + [-1.5e300, 1e15 + 0.25, 2.0**40, -0.0], 2)
    rows[50] = (rows[50][0], [-1e18] * 8, 1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(2)
    want, digest = by_hand(rows)
    assert coded(df) == (want, {digest})


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, [0.5] * 8, "a")], "`my.id` long, sums array<double>, width string")
    got = encode_vectors(df, id_column="my.id", vector_column="sums", label_column="width").collect()
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in got] == [(1, "00" * 8, 0, 0)]
    assert encode_vectors(df.limit(0), id_column="my.id", vector_column="sums", label_column="width").count() == 0
    twice = spark.createDataFrame([(1, [2.0] * 8, 1), (1, [1.0] * 8, 1), (None, [1.0] * 8, None), (None, None, None)], "vec_id long, embedding array<double>, label long")
    assert sorted((str(r.vec_id), r.code) for r in encode_vectors(twice).collect()) == [("1", "00" * 8), ("1", "01" * 8), ("None", "00" * 8)]


def test_trees_assign_like_a_scan():
    rng = np.random.default_rng(3)
    for n, d, k, spread in ((1, 3, 2, 5), (700, 4, 16, 3), (4096, 8, 16, 200), (333, 1, 5, 4)):
        points, book = rng.integers(-spread, spread + 1, (n, d)), rng.integers(-spread, spread + 1, (k, d))
        tree = Tree.build(points)
        nearest, sums, counts = tree.walk(book, np.ones(k, dtype=bool))
        plain = ((points[:, None] - book[None]) ** 2).sum(2).argmin(1)  # the lowest index of equals
        assert np.array_equal(nearest, plain[tree.order]) and np.array_equal(counts, np.bincount(plain, minlength=k))
        assert np.array_equal(sums, np.stack([points[plain == e].sum(0) for e in range(k)]))


def test_scaled_floors_down():
    values = np.array([[-1e-9, 0.1, -0.1, 123456.789, -7e9 - 0.3, 2.0**60]])
    assert [int(x) for x in scaled(values, 4096)[0]] == [math.floor(4096 * Fraction(float(x))) for x in values[0]]
