"""Stems against hand-known pairs and a plain version of the rules, ranked search against brute force, with and without a stored index."""

import random
import re
from collections import defaultdict

import pytest

from annalist.functions import stem as st
from annalist.functions.text import STOPWORDS
from annalist.operators import fulltext as ft
from annalist.operators.index import SearchIndex
from tests.test_index import entries_of

# words and stems as published with the algorithm
KNOWN = """consign consign consigned consign consignment consign consistency consist consistently consist consolation consol consolatory consolatori
consolidating consolid consonant conson consorting consort conspicuously conspicu conspiracy conspiraci conspirators conspir constables constabl
constancy constanc knackeries knackeri knavish knavish kneeled kneel knightly knight knitted knit knocker knocker knives knive knopp knopp""".split()
MORE = """generate generat generously generous ponies poni ties tie gaps gap gas gas kiwis kiwi hopping hop hoped hope happy happi say say by by dying die
skies sky inning inning proceeds proceed bed bed shred shred bead bead luxuriated luxuri agreed agre feed feed relational relat rational ration
geology geolog hopefulness hope controlled control rolling roll youth youth boyish boyish disk_full disk_full 6.8mb 6.8mb on on communication communic""".split()


def plain_stem(word):
    """The rules on strings, region by region."""
    vowels, doubles = "aeiouy", ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
    if not re.fullmatch("[a-z]{3,}", word) or word in st.INVARIANT:
        return word
    if word in st.IRREGULAR:
        return st.IRREGULAR[word]
    letters = list(word)
    for i, c in enumerate(letters):
        if c == "y" and (i == 0 or letters[i - 1] in vowels):
            letters[i] = "Y"
    w = "".join(letters)

    def region(start):
        for i in range(start + 1, len(w)):
            if w[i] not in vowels and w[i - 1] in vowels:
                return i + 1
        return len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None) or region(0)
    r2 = region(r1)

    def ends_short(x):
        if len(x) == 2:
            return x[0] in vowels and x[1] not in vowels
        return len(x) > 2 and x[-3] not in vowels and x[-2] in vowels and x[-1] not in vowels + "wxY"

    def longest(suffixes):
        return max((s for s in suffixes if w.endswith(s)), key=len, default="")

    s = longest(["sses", "ied", "ies", "us", "ss", "s"])
    if s == "sses":
        w = w[:-2]
    elif s in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif s == "s" and any(c in vowels for c in w[:-2]):
        w = w[:-1]
    if w in st.INVARIANT_SINGULARS:
        return w
    s = longest(["eed", "eedly", "ed", "edly", "ing", "ingly"])
    if s in ("eed", "eedly"):
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    elif s and any(c in vowels for c in w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(doubles):
            w = w[:-1]
        elif r1 >= len(w) and ends_short(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in vowels:
        w = w[:-1] + "i"
    s = longest(st.STEP_2)
    if s and len(w) - len(s) >= r1 and (s != "ogi" or w[-4] == "l") and (s != "li" or w[-3] in "cdeghkmnrt"):
        w = w[: -len(s)] + st.STEP_2[s]
    s = longest(st.STEP_3)
    if s and len(w) - len(s) >= r1 and (s != "ative" or len(w) - 5 >= r2):
        w = w[: -len(s)] + st.STEP_3[s]
    s = longest(st.STEP_4)
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[-4] in "st"):
        w = w[: -len(s)]
    if w[-1] == "e" and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not ends_short(w[:-1]))):
        w = w[:-1]
    elif w[-1] == "l" and len(w) - 1 >= r2 and w.endswith("ll"):
        w = w[:-1]
    return w.lower()


def test_stems(spark):
    pairs = list(zip(KNOWN[::2] + MORE[::2], KNOWN[1::2] + MORE[1::2]))
    draw = random.Random(5)
    parts = ["y", "ab", "ion", "at", "er", "bl", "iz", "e", "ing", "ed", "s", "ies", "l", "li", "ness", "ational", "st", "ous", "ee", "dd", "x", "gener", "ative", "ogi", "wy", "tion", "al", "sky"]
    made = ["".join(draw.choices(parts, k=draw.randint(1, 5))) for _ in range(3000)]
    words = [w for w, _ in pairs] + made
    got = dict(spark.createDataFrame([(w,) for w in words] + [(None,), ("",)], "w string").transform(st.stemmed, "w").select("w", "stem").collect())
    assert {w: got[w] for w, _ in pairs} == dict(pairs)
    assert [(w, got[w], plain_stem(w)) for w in words if got[w] != plain_stem(w)] == []
    assert got[None] is None and got[""] == ""


def tokens(text):
    return [t for t in re.findall("[a-z]+", (text or "").lower()) if 2 <= len(t) <= 40 and t not in STOPWORDS]


def brute(rows, queries, limit):
    out = []
    for query_id, text in queries:
        asked = [plain_stem(t) for t in tokens(text)]
        stems, pairs, scored = set(asked), set(zip(asked, asked[1:])), []
        for entry_id, _, title, body in rows:
            words = [plain_stem(t) for t in tokens(title) + tokens(body)]
            titled, matched, weight = len(tokens(title)), 0, 0.0
            for s in stems & set(words):
                at = [i for i, w in enumerate(words) if w == s]
                matched += 1
                weight += sum((1.0 if i < titled else 0.1) / j**2 for j, i in enumerate(at, 1)) / 1.64493406685
            near = len(pairs & set(zip(words, words[1:])))
            if matched:
                scored.append((-round(matched + (weight / len(stems) + (near / len(pairs) if pairs else 0)) / 2, 6), entry_id, matched, near))
        out += [(query_id, rank, e, -s, m, n) for rank, (s, e, m, n) in enumerate(sorted(scored)[:limit])]
    return out


def found(df):
    return sorted((r.query_id, r["rank"], r.entry_id, round(r.score, 6), r.matched, r.near) for r in df.collect())


def test_ranked_search_equals_brute_force(spark, tmp_path):
    draw = random.Random(3)
    vocabulary = "worker workers pool pools resize resizing resized procedure index indexes indexed searching searched hope hoping the of".split()
    rows = [(i, "doc", " ".join(draw.choices(vocabulary, k=3)), " ".join(draw.choices(vocabulary, k=draw.randint(0, 60)))) for i in range(60)]
    rows += [(60, "doc", None, "worker pool"), (61, "doc", "", ""), (62, "doc", None, None), (63, "doc", "pool", None), (64, "doc", "long", "resize " * 20_000)]
    queries = [(1, "resizing the worker pool"), (2, "Hopes"), (3, "pool pool worker pool"), (4, "unknown"), (5, ""), (6, None), (7, "the of")]
    asked = spark.createDataFrame(queries, "query_id long, text string")
    entries = entries_of(spark, rows)
    words = ft.entry_words(entries.withColumnRenamed("id", "entry_id"), "entry_id")
    want = brute(rows, queries, 12)
    assert found(ft.ranked_search(ft.query_stems(asked), ft.vocabulary(words), words, 12)) == want and want
    index = SearchIndex.build(entries, f"file://{tmp_path}/index", buckets=3)
    assert found(index.ranked_search(asked, 12)) == want
    changed = {r[0]: r for r in rows} | {3: (3, "doc", "worker pool", "resized"), 5: (5, "doc", "", "")}
    index.upsert(entries_of(spark, [changed[3], changed[5]]))
    assert found(index.ranked_search(asked, 12)) == brute(changed.values(), queries, 12)


def test_what_ranks_higher(spark):
    rows = [(1, "doc", "note", "the pool was resized"), (2, "doc", "pools", "nothing"), (3, "doc", "note", "pools of workers"), (4, "doc", "note", "workers and then other pools"), (5, "doc", "x", "y")]
    words = ft.entry_words(entries_of(spark, rows).withColumnRenamed("id", "entry_id"), "entry_id")
    asked = spark.createDataFrame([(1, "pool"), (2, "pool worker")], "query_id long, text string")
    hits = found(ft.ranked_search(ft.query_stems(asked), ft.vocabulary(words), words, 9))
    assert [h[2] for h in hits if h[0] == 1] == [2, 1, 3, 4]  # titles before bodies; a stem is enough
    assert [h[2] for h in hits if h[0] == 2] == [3, 4, 2, 1]  # more words first, of those the one where they stand together


def test_an_index_of_another_layout_is_refused(spark, tmp_path, monkeypatch):
    from annalist.operators import index as ix

    SearchIndex.build(entries_of(spark, [(1, "doc", "a title", "a body")]), f"file://{tmp_path}/index", buckets=1)
    monkeypatch.setattr(ix, "LAYOUT", ix.LAYOUT + 1)
    with pytest.raises(ValueError, match="build it anew"):
        SearchIndex(spark, f"file://{tmp_path}/index")
