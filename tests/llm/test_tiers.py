"""Tiers: plans without padding, and an exact round trip of tokens."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from annalist.llm.tiers import pack_tiers, plan_tiers

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("seed", range(8))
def test_plans_fill_windows(seed):
    rng = np.random.default_rng(seed)
    tiers = [(64, 32, 16), (64,), (128, 8), (16, 8, 4, 2, 1)][seed % 4]
    n = int(rng.integers(0, 500))
    lengths = rng.integers(1, tiers[0] + 1, n) if seed < 4 else np.minimum(rng.geometric(0.1, n), tiers[0])
    counts = np.bincount(lengths, minlength=tiers[0] + 1)
    plan = plan_tiers(counts, tiers, step_tokens=256)
    rank = np.concatenate([np.arange(c) for c in counts])
    length = np.repeat(np.arange(len(counts)), counts)
    piece, slot, sequence = plan.place(length, rank)
    assert np.array_equal(np.bincount(piece, plan.size[slot], minlength=n), length)
    done = {}
    for p, k in zip(piece.tolist(), slot.tolist(), strict=True):  # the parts of a piece follow each other
        assert plan.start[k] == done.get(p, 0)
        done[p] = done.get(p, 0) + plan.size[k]
    fill, window = {}, {}
    for s, o, k in sorted(zip(sequence.tolist(), plan.offset[slot].tolist(), slot.tolist(), strict=True)):
        assert fill.get(s, 0) == o
        fill[s] = o + int(plan.size[k])
        window.setdefault(s, set()).add(int(plan.window[k]))
    assert all(window[s] == {fill[s]} and fill[s] & (fill[s] - 1) == 0 for s in fill)
    assert sorted(fill) == list(range(plan.sequences))
    sizes = [fill[s] for s in range(plan.sequences)]
    assert sizes == sorted(sizes, reverse=True)
    for size in set(sizes):  # each step group has its share of every size
        dealt = np.bincount([s % plan.groups for s in range(plan.sequences) if sizes[s] == size], minlength=plan.groups)
        assert dealt.max() - dealt.min() <= 1


def test_round_trip(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["alpha", "be", "Gamma,", "δ", "x1"]) for _ in range(rng.randrange(0, 60))) for _ in range(80)] + [None, "", "word " * 700]
    rows = [(i, t, 5, "s") for i, t in enumerate(texts)] + [(None, "null id", 5, "s"), (3, "again", 5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank int, start string").repartition(3)
    got = pack_tiers(docs, PATH, tiers=(64, 32, 16), keep_ids=True, step_tokens=512).collect()
    plain = Tokenizer.from_file(PATH)
    want = sorted((str(i), plain.encode(t or "", add_special_tokens=False).ids + [2]) for i, t, _, _ in rows)
    tokens, fill = {}, {}
    for r in got:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        tokens.setdefault((str(r.doc_id), r.doc_tokens), []).append((r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()))
    again = []
    for (doc, n), parts in tokens.items():
        ids = sum((p for _, p in sorted(parts)), [])
        if doc != "3":
            assert [s for s, _ in sorted(parts)] == np.cumsum([0, *[len(p) for _, p in sorted(parts)]])[:-1].tolist() and len(ids) == n
        again.append((doc, ids))
    assert sorted(again) == want
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert fill.get(r.sequence_id, 0) == r.offset
        fill[r.sequence_id] = r.offset + r.length
    assert all(fill[r.sequence_id] == r.window for r in got)
    assert pack_tiers(docs.limit(0), PATH).count() == 0


def test_columns_of_other_names(spark):
    docs = spark.createDataFrame([(1, "one two", 2)], ["a.b", "t t", "length"])
    assert sum(r.length for r in pack_tiers(docs, PATH, id_column="a.b", text_column="t t").collect()) == 3
    with pytest.raises(ValueError):
        pack_tiers(docs, PATH, tiers=(100,))
