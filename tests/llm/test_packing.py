"""Packing: an exact round trip of tokens, and plans that fit."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from annalist.llm import packing
from annalist.llm.packing import SumIndex, WordEncoder, pack, plan_packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_encoder_equals_tokenizer():
    rng = random.Random(2)
    alphabet = list("aBcé ß'\n\t.,!<|>0123ÀÿŒœ😀é İ\x1c\xa0σΣ-_\"") + ["'s ", "the ", "<|endoftext|>", "  "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(1500)]
    encoder, plain = WordEncoder(PATH), Tokenizer.from_file(PATH)
    for text, got in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(got, dtype="<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("seed", range(6))
def test_plans_place_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 120))
    lengths = rng.integers(1, capacity + 1, int(rng.integers(0, 400))) if seed % 2 else np.minimum(rng.geometric(0.05, 700), capacity)
    counts = np.bincount(lengths, minlength=capacity + 1)
    plan = plan_packing(counts, capacity)
    rank = np.concatenate([np.arange(counts[v]) for v in range(capacity + 1)])
    length = np.repeat(np.arange(capacity + 1), counts)
    sequence, offset = plan.place(length, rank) if len(length) else (np.zeros(0, int), np.zeros(0, int))
    fill = {}
    for s, o, n in sorted(zip(sequence.tolist(), offset.tolist(), length.tolist(), strict=True)):
        assert fill.get(s, 0) == o
        fill[s] = o + n
    assert len(fill) == plan.sequences and all(v <= capacity for v in fill.values())
    least = -(-int(length.sum()) // capacity)
    assert plan.sequences <= least * 1.25 + 2


def test_pack_round_trip(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["alpha", "be", "Gamma,", "δ", "x1"]) for _ in range(rng.randrange(0, 60))) for _ in range(80)] + [None, "", "word " * 500]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(None, "null id", 5), (3, "again", 5)], "doc_id long, text string, task int").repartition(3)
    rows = pack(docs, PATH, capacity=64, keep_ids=True).collect()
    plain = Tokenizer.from_file(PATH)
    expected = {}
    for i, t in [(r.doc_id, r.text) for r in docs.collect()]:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        for p, at in enumerate(range(0, len(ids), 64)):
            part = np.array(ids[at : at + 64], dtype="<u4").tobytes()
            expected.setdefault((i, p, at, part), []).append(zlib.crc32(part))
    got = {}
    for r in rows:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        got.setdefault((r.doc_id, r.piece, r.start, bytes(r.ids)), []).append(r.ids_crc32)
    assert got == expected
    by = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert by.get(r.sequence_id, 0) == r.offset
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 64
    assert pack(docs.limit(0), PATH).count() == 0


def test_sum_index_against_brute_force():
    rng = np.random.default_rng(2)
    left = (rng.random(60) < 0.4).astype(np.int64)
    index = SumIndex(left)
    for length in [*np.flatnonzero(left)[rng.permutation(int((left > 0).sum()))].tolist()]:
        have = np.flatnonzero(index.single)
        pairs, triples = Counter(int(a + b) for a in have for b in have), Counter(int(a + b + c) for a in have for b in have for c in have)
        assert all(index.pairs[s] == pairs[s] and index.triples[s] == triples[s] for s in range(60))
        if length:
            index.remove(length)
    assert not index.single.any() and not index.pairs.any() and not index.triples.any()


def test_words_met_again_stay(monkeypatch):
    """A full memory keeps the words that texts hold again and again, so they are asked for once; ids stay the tokenizer's."""
    monkeypatch.setattr(packing, "WORDS_HELD", 30)
    encoder, plain, learned = WordEncoder(PATH), Tokenizer.from_file(PATH), []
    learn = encoder.learn
    monkeypatch.setattr(encoder, "learn", lambda words: (learned.extend(words), learn(words)))
    common = [f"common{'abcdefgh'[k]}" for k in range(8)]
    rare = iter(f"rare{a}{b}" for a in "abcdefghij" for b in "klmnopqrst")
    for _ in range(10):
        texts = pa.array(["cut off", " ".join([*common, next(rare), " \x0bÉa<", next(rare), *common]), "", f"a <|endoftext|>{next(rare)}", next(rare)]).slice(1)
        for text, got in zip(texts.to_pylist(), encoder.encode(texts), strict=True):
            assert np.frombuffer(got, dtype="<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert len(encoder.known) <= 30 and all(learned.count(w.encode()) == 1 for w in common)


def test_stretches_take_every_row_once(monkeypatch):
    monkeypatch.setattr(packing, "BYTES_AT_ONCE", 10)
    texts = pa.array(["x" * n for n in (3, 7, 1, 25, 0, 0, 9, 1, 0)])
    assert list(packing._stretches(texts)) == [(0, 2), (2, 3), (3, 4), (4, 9)] and list(packing._stretches(texts[:0])) == []
