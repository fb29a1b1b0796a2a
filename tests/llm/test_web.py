"""WARC archives and HTML main text."""

import base64
import gzip
import hashlib
import io
import itertools
import random
import re
import time

import pytest

from annalist.llm import html_text
from annalist.llm.html_text import ASIDE, BODY, OPEN, blocks, extract_text
from annalist.llm.warc import LoserTree, archive_pages, base32_of_hex, merge_captures, parse_records, read_archives, url_key, write_archives
from pyspark.sql import functions as F


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


ROWS = [
    (1, "http://b.example.com/x?q=1#frag", "<p>same</p>"),
    (9, "https://www.a.example.com/", "<p>same</p>"),
    (4, None, None),
    (5, "http://a.example.com/\r\nEvil: yes", ""),
    (6, "http://c.example/π", "WARC/1.1\r\n\r\n\r\n\r\nüñï\x00 tail"),
    (None, "http://n.example/", "<p>same</p>"),
    (7, "http://d.example/", "long " * 50_000),
    (9, "https://www.a.example.com/", "<p>same</p>"),
]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*r, "k") for r in ROWS], "page_id long, url string, html string, key string").repartition(3)


def test_archive_round_trip(spark, pages, tmp_path):
    path = f"file://{tmp_path}/warc"
    got = archive_pages(pages, path).collect()
    assert len(got) == len(ROWS)
    for r in got:
        html = next(h for i, _, h in ROWS if i == r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len((html or "").encode()), digest(html))
    kinds = sorted(((-1 if r.page_id is None else r.page_id), r.record_type, r.refers_to) for r in got)
    assert kinds == [(-1, "revisit", 9), (1, "revisit", 9), (4, "revisit", 5), (5, "response", None), (6, "response", None), (7, "response", None), (9, "response", None), (9, "response", None)]
    order = [(r.urlkey, r.captured_at, -1 if r.page_id is None else r.page_id) for r in sorted(got, key=lambda r: (r.segment, r.place))]
    assert order == sorted(order)
    files = list((tmp_path / "warc").glob("*.gz"))
    fields, block = next(parse_records(gzip.open(files[0])))
    assert fields["warc-type"] in ("response", "revisit") and int(fields["content-length"]) == len(block)


def test_least_revisit_bytes_and_empty(spark, pages, tmp_path):
    write_archives(pages, f"file://{tmp_path}/w", least_revisit_bytes=5)
    assert {r.record_type for r in read_archives(spark, f"file://{tmp_path}/w").collect() if r.page_id in (4, 5)} == {"response"}
    assert archive_pages(pages.limit(0), f"file://{tmp_path}/none").count() == 0


def test_ids_and_times_of_any_size(spark):
    ids = [2**62, -7 * 10**10, 251_698_233_600, 10**12, -(2**63), 2**63 - 1, 0, None]
    times = ["+10000-01-01 00:00:00", "0001-01-01 00:00:00", "9999-12-31 23:00:00", None, "1970-01-01 00:00:00", "2024-05-06 07:08:09", "-0005-01-01 00:00:00", "0002-02-03 04:05:06"]
    pages = spark.createDataFrame([(i, "http://a.example/x", f"<p>{i}</p>", t, "n") for i, t in zip(ids, times, strict=True)], "`my.id` long, url string, html string, at string, payload string")
    got = archive_pages(pages.withColumn("at", F.expr("try_cast(at AS timestamp)")), id_column="my.id").collect()
    assert sorted((str(r.page_id), r.record_type, r.payload_bytes) for r in got) == sorted((str(i), "response", len(f"<p>{i}</p>")) for i in ids)
    assert {r.captured_at.year for r in got} == {2024}
    timed = archive_pages(pages.withColumn("at", F.expr("try_cast(at AS timestamp)")), id_column="my.id", time_column="at").collect()
    at = {r.page_id: r.captured_at.replace(tzinfo=None).isoformat() for r in timed}
    assert len(timed) == 8 and at[2**63 - 1] == "2024-05-06T07:08:09" and at[-(2**63)] == "1970-01-01T00:00:00" and at[None] == "0002-02-03T04:05:06"
    assert all(at[i].startswith("2024-") for i in (2**62, 10**12, 0))


def test_damaged_archive_raises():
    with pytest.raises(ValueError):
        list(parse_records(io.BytesIO(b"WARC/1.1\r\nContent-Length: 50\r\n\r\nshort")))


def test_base32_and_keys(spark):
    rows = spark.createDataFrame([("",), ("abc",), ("é" * 99,)], "s string").select("s", base32_of_hex(F.sha1("s")).alias("d"))
    assert all(r.d == digest(r.s) for r in rows.collect())
    key = lambda u: spark.range(1).select(url_key(F.lit(u)).alias("k")).first().k
    assert key("https://www.News.Example.com/A?b#c") == "com,example,news)/a?b" and key("http://u:p@h.org:80") == "org,h)"


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(k)]
    assert list(LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_merge_of_many_runs(spark):
    rng = random.Random(1)
    rows = []
    for f in range(9):
        own = sorted((f"http://h{rng.randrange(3)}.org/{rng.randrange(5)}", rng.randrange(100), rng.randrange(1000)) for _ in range(40))
        rows += [(i, u, t, f"file{f}", n) for n, (u, t, i) in enumerate(sorted(own, key=lambda x: (x[0], x[1], x[2])))]
    index = spark.createDataFrame(rows, "page_id long, url string, t long, file string, record_no long").selectExpr(
        "page_id", "url", "timestamp_seconds(t) AS captured_at", "0L AS payload_bytes", "'' AS payload_digest", "'response' AS record_type", "NULL::long AS refers_to", "file", "record_no"
    )
    got = merge_captures(index, segments=4).collect()
    order = [(r.urlkey, r.captured_at, r.page_id) for r in sorted(got, key=lambda r: (r.segment, r.place))]
    assert len(order) == 360 and order == sorted(order)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>x</article>";</script></head><body>
<header class="top">Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>no</p> --><div class="ad big">Buy</div>
<article><header><h1>Head &amp; tail</h1></header><p>One <b>two</b>
 three&nbsp;four<br>five<p>six &lt;b&gt; &#233;<aside>side</aside><div id="comments"><p>first!</p></div><form><input><button>Go</button></form><p data-x="a>b">last</p></article>
<footer>&copy; x</footer>"""


def body(page):
    return [t for zone, t in blocks(page) if zone != ASIDE]


def test_structure():
    assert body(PAGE) == ["Head & tail", "One two three four", "five", "six <b> é", "last"]
    assert blocks("") == [] and blocks("<p>") == [] and blocks("plain") == [(OPEN, "plain")]
    assert blocks("<article><p>a<script>x") == [(BODY, "a")]


@pytest.mark.parametrize(
    "page, want",
    [
        ('<article><p>a</p><ul><li class="share">S<li>kept item</ul><p>b</p></article>', ["a", "kept item", "b"]),
        ('<p>one<p class="ad">x<p>two', ["one", "two"]),
        ('<article><h2 id="search">How search works</h2><section class="social">Social policy text</section></article>', ["How search works", "Social policy text"]),
        ("<p>stray open</p><article><p>main</p></article><p>more</p>", ["main"]),
        ('<article><p>a</p><div id="comments"><p>one</p><ul><li>two<li>three</ul></div><p>b</article>', ["a", "b"]),
        ('<article><ul><li class="ad">x<ul><li>y</ul>z<li>kept</ul></article>', ["kept"]),
        ('<article><p class="ad">x<div>kept</div></article>', ["kept"]),
        ('<article><table><tr><td class="ad">x<td>kept<tr><td>too</table></article>', ["kept", "too"]),
        ('<article>a <span class="ad">x <span>y</span> z</span> b</article>', ["a", "b"]),
        ("<main><p>a<nav>x</nav><form>y</form>b</main><footer>z</footer>", ["a", "b"]),
        ('<article data-x="</article>" title=\'>\'>a</b></div>b</article>c', ["ab"]),
        ("a<!-- <p>x</p> -->b<!doctype x>c<![CDATA[y]]>", ["abc"]),
        ("a < b &lt; c <3", ["a < b < c <3"]),
        ('<p>a<p title="never closed>b<p>c', ["a"]),
    ],
)
def test_pages_as_they_are(page, want):
    assert body(page) == want


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<a '", '<a x="', "<!--", "<div>", "</div>", "<p>", "<li>", "<b>", "<", "&", "<script>", "<p class=ad>", "</b><i>"])
def test_long_unclosed_pages(piece):
    began = time.monotonic()
    blocks(piece * (1_000_000 // len(piece)))
    assert time.monotonic() - began < 10


def brute(rows):
    """What extract_text gives, by sorting all suffixes of a host's streams and comparing neighbours."""
    pages = [(i, url, blocks(page or "")) for i, url, page in rows]
    hosts = {}
    for n, (_, url, found) in enumerate(pages):
        host = re.match(r"//([^/?#:]*)", (url or "").split(":", 1)[-1])
        hosts.setdefault(host[1] if host else "", []).append(n)
    out = {}
    for own in hosts.values():
        streams = {n: [["" if zone == BODY else t for zone, t in pages[n][2]], []] for n in own}
        for n in own:
            streams[n][1] = [t for block in streams[n][0] for t in (*block.split(), "\n")]
        kind = lambda n: (*streams[n][0], "".join(zone for zone, _ in pages[n][2]))
        distinct = {}
        for n in own:
            if any(streams[n][0]):
                distinct.setdefault(kind(n), n)
        needed = max(2, min(html_text.MANY_PAGES, -(-len(distinct) // 2)))
        gone = {n: [False] * len(streams[n][1]) for n in own}
        # stretches: neighbours in suffix order that share PASSAGE_TOKENS tokens are one group
        suffixes = sorted((streams[n][1][k:], n, k) for n in own for k in range(len(streams[n][1])))
        group = []
        for place, (suffix, n, k) in enumerate(suffixes):
            head = suffix[: html_text.PASSAGE_TOKENS]
            group = [*group, (n, k)] if place and suffixes[place - 1][0][: html_text.PASSAGE_TOKENS] == head else [(n, k)]
            last = place + 1 == len(suffixes) or suffixes[place + 1][0][: html_text.PASSAGE_TOKENS] != head
            if last and len(head) == html_text.PASSAGE_TOKENS and len({kind(m) for m, _ in group}) >= needed:
                for m, at in group:
                    gone[m][at : at + len(head)] = [True] * len(head)
        runs = {}
        for n in own:
            texts, at = streams[n][0], 0
            starts = [at := at + (len(texts[k - 1].split()) + 1 if k else 0) for k in range(len(texts))]
            for i in range(len(texts)):
                for j in range(i + 1, len(texts) + 1):
                    tokens = [t for block in texts[i:j] for t in (*block.split(), "\n")]
                    if all(texts[i:j]) and len(tokens) >= html_text.LEAST_TOKENS:
                        runs.setdefault(tuple(tokens), []).append((n, starts[i]))
        for tokens, places in runs.items():
            if len({kind(n) for n, _ in places}) >= needed:
                for n, at in places:
                    gone[n][at : at + len(tokens)] = [True] * len(tokens)
        for n in own:
            left, at, zones = [], 0, [zone for zone, _ in pages[n][2]]
            for zone, block in pages[n][2]:
                size = 0 if zone == BODY else len(block.split())
                unique = " ".join(t for t, g in zip(block.split(), gone[n][at : at + size]) if not g) if zone == OPEN else block if zone == BODY else ""
                left.append(unique)
                at += size + 1
            if not any(left) and BODY not in zones:
                left = [t for zone, t in pages[n][2] if zone == OPEN]
            covered = sum(g and t != "\n" for g, t in zip(gone[n], streams[n][1]))
            out[pages[n][0]] = ("\n".join(t for t in left if t), covered)
    return out


def test_whole_query_against_sorted_suffixes(spark, monkeypatch):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(40)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    menus, notes = [[prose(rng.randrange(1, 5)) for _ in range(4)] for _ in range(3)], [prose(70) for _ in range(4)]
    rows = []
    for i in range(120):
        parts = [f"<p>{b}</p>" for b in rng.choice(menus)] + [f"<p>{prose(rng.randrange(1, 60))}</p>" for _ in range(rng.randrange(3))]
        if rng.random() < 0.5:
            note = rng.choice(notes).split()
            cut = rng.randrange(15)
            parts.insert(rng.randrange(len(parts) + 1), f"<p>{prose(3)} {' '.join(note[cut:])} {prose(2)}</p>")
        if rng.random() < 0.3:
            parts = [f'<nav>{"".join(parts[:2])}</nav>', f'<article><p>{prose(9)}</p><div class="widget">{"".join(parts[2:])}</div></article>']
        page = rows[rng.randrange(len(rows))][2] if rows and rng.random() < 0.1 else "".join(parts)
        rows.append((i, f"http://h{rng.randrange(4)}.org/{i}", page))
    got = {r.page_id: (r.text, r.boilerplate_tokens) for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert got == brute(rows) and sum(n for _, n in got.values()) > 100


@pytest.mark.parametrize("tasks", [1, 40])
def test_longest_repeats_over_tasks(spark, monkeypatch, tasks):
    """Of each suffix at a block the longest beginning that enough pages have, though its repeats go on over several tasks."""
    monkeypatch.setattr(html_text, "SUFFIXES_A_TASK", 1)
    streams = []
    for row in range(30):  # all begin alike, 15 of them for longer, 12 for longer still
        shared = ["a b c d e", "f g h", *(["i j k"] if row % 2 else []), *(["l m n o"] if row in range(1, 24, 2) else []), f"own{row} x"]
        streams.append((row, "h", shared if row < 29 else [*shared[:2], "", "i j k"]))
    streams += [(30 + n, "few", [*(f"w{k}" for k in range(6 + n % 2)), f"end{n}"]) for n in range(4)]
    passage = " ".join(f"p{k}" for k in range(60))
    streams += [(40 + n, "long", [f"before{n} {passage} after{n}"]) for n in range(3)] + [(43, "long", ["none of it"])]
    df = spark.createDataFrame(streams, "row long, host string, stream array<string>").repartition(5).cache()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(html_text, "SUFFIXES_A_TASK", 10**9 if tasks == 1 else 12)
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    try:
        got = {(r.row, r.at, r.stretch): r.length for r in html_text._repeats(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {}
    for row, host, page in streams:
        starts = [0, *itertools.accumulate(len(b.split()) + 1 for b in page)][:-1]
        own = [(n, html_text._stream(page[n:][: (page[n:] + [""]).index("")])) for n in range(len(page)) if page[n]]
        for n, suffix in own:
            others = [html_text._stream(q[m:][: (q[m:] + [""]).index("")]) for r, h, q in streams if h == host and r != row for m in range(len(q))]
            rows = [r for r, h, q in streams if h == host and r != row for m in range(len(q))]
            needed = max(2, min(10, -(-sum(h == host for _, h, _ in streams) // 2)))
            best = max(k for k in range(len(suffix) + 1) if k == 0 or len({r for r, o in zip(rows, others) if o[:k] == suffix[:k]}) + 1 >= needed)
            if best >= html_text.LEAST_TOKENS and len(suffix) <= html_text.PASSAGE_TOKENS:
                want[row, starts[n], False] = best
    want |= {(40 + n, 1 + k, True): 50 for n in range(3) for k in range(11)}
    assert got == want and len(set(want.values())) > 3


def test_spans_of_pages_that_repeat_themselves():
    rng = random.Random(3)
    for _ in range(300):
        rows, many = [rng.randrange(4) for _ in range(rng.randrange(1, 9))], rng.randrange(2, 5)
        found = list(html_text._shortest(rows, many))
        assert all(len(set(rows[i:j])) == many for i, j in found)
        for x, y in itertools.combinations(range(len(rows) + 1), 2):
            if len(set(rows[x:y])) >= many:
                assert all(any(x <= i <= k < j <= y for i, j in found) for k in range(x, y)), (rows, many, x, y)


def test_extract(spark):
    menu = "<div>all our offers are on the front page today</div>"
    rows = [(1, "http://h.org/a", PAGE), (2, "http://h.org/b", f"<body>{menu}<div>a text of its own</div></body>"), (3, "http://h.org/c", f"<body>{menu}<div>another one entirely</div></body>")]
    rows += [(4, "http://i.org/c", f"<body>{menu}</body>"), (5, None, None), (None, "u", ""), (2, "http://h.org/b", "<p>dup &amp id</p>"), (6, "x", "<article>" + "w " * 100_000 + "</article>")]
    got = extract_text(spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, kept string")).collect()
    texts = sorted((r.page_id or 0, r.text) for r in got if r.page_id != 6)
    assert texts == [(0, ""), (1, "Head & tail\nOne two three four\nfive\nsix <b> é\nlast"), (2, "a text of its own"), (2, "dup & id"), (3, "another one entirely"), (4, "all our offers are on the front page today"), (5, "")]
    assert all(r.n_chars == len(r.text) for r in got) and next(r.n_chars for r in got if r.page_id == 6) == 199_999
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_large_host(spark):
    """What a host repeats is found whatever its size: 6 pages, 420,000 tokens, a passage for every three of the pages."""
    rng = random.Random(4)
    trios = {trio: " ".join(f"t{n}w{k}" for k in range(12)) for n, trio in enumerate(itertools.combinations(range(6), 3))}
    own = [[" ".join(f"p{p}x{rng.randrange(10**6)}" for _ in range(1000)) for _ in range(70)] for p in range(6)]
    pages = [[b for k in range(70) for b in (own[p][k], *[t for n, (trio, t) in enumerate(trios.items()) if n == k and p in trio])] for p in range(6)]
    rows = [(p, f"http://large.org/{p}", "".join(f"<p>{b}</p>" for b in page)) for p, page in enumerate(pages)]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert {r.page_id: r.text for r in got} == {p: "\n".join(own[p]) for p in range(6)}


def test_open_text_keeps_phrases_and_copies(spark):
    rng = random.Random(6)
    prose = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    menu, phrase, passage = "all our offers are on the front page", "on the other hand it has to be said that", prose(60)
    own = [f"{prose(20)} {phrase} {prose(20)}" for _ in range(24)]
    pages = [[menu, "Home", "About", "Contact us", text, f"{prose(3)} {passage}"] for text in own]
    want = [[text, last.removesuffix(f" {passage}")] for text, (*_, last) in zip(own, pages, strict=True)]
    copied, last = prose(80), prose(30)
    pages += [[menu, copied, last], [menu, copied, last], [menu, copied, prose(30)]]  # two exact copies and a near one
    want += [[copied, last], [copied, last], pages[-1][1:]]
    rows = [(p, f"http://open.org/{p}", "".join(f"<p>{b}</p>" for b in page)) for p, page in enumerate(pages)]
    rows += [(100 + p, f"http://two.org/{p}", f"<p>{copied}</p>") for p in range(2)] + [(102, "http://two.org/2", f"<p>{copied}</p><p>{last}</p>")]
    want_of = {p: "\n".join(w) for p, w in enumerate(want)} | {100: copied, 101: copied, 102: last}
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert {r.page_id: r.text for r in got} == want_of
