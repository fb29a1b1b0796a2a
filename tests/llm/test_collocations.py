"""Phrases against a count of every n-gram in Python."""

import random
import re
from collections import Counter

from annalist.llm.collocations import _portions, mine_phrases


def by_hand(rows, least, longest=4, first=2000, cover=80):
    """(lang, text) → {lang: [(rank, phrase, a, l, r, n, score)]}."""
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                for at in range(len(words) - n + 1):
                    counts.setdefault(lang, Counter())[tuple(words[at : at + n])] += 1
    out = {}
    for lang, f in counts.items():
        found = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        covered = {
            long[at : at + n]
            for long, b in found.items()
            for n in range(2, len(long))
            for at in range(len(long) - n + 1)
            if 100 * b >= cover * f[long[at : at + n]]
        }
        rows_of = []
        for g, a in found.items():
            if g not in covered:
                score, _, l, r = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
                rows_of.append((-score, -a, " ".join(g).encode(), l, r))
        out[lang] = [(i + 1, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows_of)[:first])]
    return out


def mined(df, **settings):
    out = {}
    for r in sorted(mine_phrases(df, **settings).collect(), key=lambda r: (r.lang, r.rank)):
        out.setdefault(r.lang, []).append((r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score))
    return out


def test_phrases_equal_a_plain_count(spark):
    rng = random.Random(5)
    words = ["new", "York", "city", "of", "the", "straße", "Ünder", "x1", "İ", "😀", "nul\x00l"]
    rows = []
    for _ in range(400):
        text = "".join(rng.choice(words) + rng.choice([" "] * 6 + ["\t ", ". ", ",", "\x0b", "\r\n", " ; ", "\x1c", "  "]) for _ in range(rng.randrange(25)))
        rows.append((rng.choice(["en", "en", "de", None, "und", ""]), text))
    rows += [("en", "The city of New York never sleeps. ")] * 200 + [("en", None), (None, None), ("xx", ""), ("yy", " . , "), ("zz", "one two " * 5000)]
    df = spark.createDataFrame([(i % 7, t, x, "n") for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string, n string").repartition(5)
    want = {k: v for k, v in by_hand(rows, 4).items() if v}
    assert mined(df, least=4) == want
    few = {k: v for k, v in by_hand(rows, 4, first=3).items() if v}
    assert mined(df, least=4, first=3) == few
    assert mined(df.limit(0), least=4) == {}


def test_columns_of_other_names(spark):
    df = spark.createDataFrame([("a b a b a b", "fr", 1)] * 3, ["my.text", "phrase", "times"])
    got = mined(df, text_column="my.text", lang_column="phrase", least=2)
    assert got == by_hand([("fr", "a b a b a b")] * 3, 2)


def test_scores_beyond_64_bits(spark):
    from annalist.llm.collocations import drop_covered, score_phrases

    big = 9 * 10**18 // 2
    counts = spark.createDataFrame(
        [("en", "a", big), ("en", "b", big + 3), ("en", "c", big), ("en", "a b", big - 1), ("en", "b c", big - 7), ("en", "a b c", big * 4 // 5 - 1)], "lang string, phrase string, f long"
    )
    scored = score_phrases(counts)
    got = {r.phrase: (r.l, r.r, r.score) for r in scored.collect()}
    assert got["a b"] == (big, big + 3, 2_000_000 * (big - 1) // (2 * big + 3))
    assert got["a b c"][2] == min(2_000_000 * (big * 4 // 5 - 1) // x for x in (big + big - 7, big - 1 + big))
    left = {r.phrase for r in drop_covered(scored, counts).collect()}
    longer = big * 4 // 5 - 1
    assert left == {"a b c"} | {p for p, a in (("a b", big - 1), ("b c", big - 7)) if 100 * longer < 80 * a}


def test_portions_keep_all_rows(monkeypatch):
    import pyarrow as pa

    from annalist.llm import collocations

    monkeypatch.setattr(collocations, "PIECE_BYTES", 10)
    pieces = ["a" * n for n in (1, 30, 4, 4, 4, 9, 0, 25, 2)]
    batches = [pa.RecordBatch.from_pydict({"piece": pieces[:4]}), pa.RecordBatch.from_pydict({"piece": pieces[4:]})]
    got = [t.column("piece").to_pylist() for t in _portions(iter(batches))]
    assert sum(got, []) == pieces and len(got) > 3
