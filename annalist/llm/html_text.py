"""Main text of web pages: page structure as evidence, and what the token streams of each host repeat.

A page is cut into blocks, and structure gives each a zone. BODY: inside an article (or main) element. ASIDE: menus,
headers, footers, sidebars, notices, adverts, forms, comments, and, where a page has an article, all that stands
outside it. OPEN: pages without an article, and parts of an article that only a vague word in class, id or role marks.

The tokens of a page's blocks outside BODY are its stream. The suffixes of all streams that can begin a repeat are sorted,
host by host, dealt over tasks by range: neighbours' common beginnings tell of each suffix how many tokens of it enough pages
have, and beginnings that go on past a task's first or last suffix are counted over all tasks, so a host may have any number of
pages. Such a repeat covers its whole blocks where it begins with a block and has LEAST_TOKENS or more, and any stretch of
PASSAGE_TOKENS; repeats inside longer ones add nothing. What MANY_PAGES pages of different
streams hold (on a host of few pages, half of its pages, but two at least) is boilerplate: it leaves OPEN blocks, of which
unique runs stay. A page that would lose all its text keeps it. ASIDE goes whether its host repeats it or not, BODY stays: an
article that a host carries twice would vanish otherwise.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.shared import column, settle

LEAST_TOKENS = 6
PASSAGE_TOKENS = 50
MANY_PAGES = 10
#: A stream of more than 1/HOT_SHARE of all pages is hot; there are fewer than HOT_SHARE of them, so they can be broadcast.
HOT_SHARE = 1000
#: About how many suffixes a task compares at most; it holds them at once.
SUFFIXES_A_TASK = 500_000
#: Distinct tokens whose hashes a task remembers.
REMEMBERED = 200_000
# fixed values: bytes of a token's code in the head of a suffix, and what tells the two kinds of heads apart
_CODE = 8
_RUN, _STRETCH = b"\0", b"\1"
# fixed values: an odd number and its inverse modulo 2^64, for hashes of windows
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)

# a tag goes to the first > outside quoted values, or to the end of the page; each alternative takes what it sees, so no text is read twice
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*+)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
# fixed values: element names of HTML
_RAW = frozenset("script style noscript template textarea select title svg math iframe object canvas audio video".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_FURNITURE = frozenset("nav aside form menu footer dialog button".split())
# fixed values: elements whose end tag may be left out, and elements past which such an end isn't implied
_LEFT_OPEN = {"p": "p", "li": "li", "dt": "dt", "dd": "dt", "td": "td", "th": "td", "tr": "tr", "option": "option"}
_WALLS = {
    "ul": ("li",), "ol": ("li",), "menu": ("li",), "dl": ("dt",), "table": ("p", "td", "tr", "li", "dt"), "td": ("p",), "th": ("p",), "caption": ("p",), "button": ("p",),
}
_NOT_OVER_P = frozenset("br caption td th tr tbody thead tfoot option optgroup legend summary html head body".split())
# fixed values: words in class, id or role that say page furniture, and words that only hint at it
_CUES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "complementary contentinfo cookie cookies consent gdpr newsletter share sharing comment comments respond disqus pager pagination footer masthead".split()
)
_HINTS = frozenset("banner notice alert popup modal overlay subscribe signup login social related recommended recommendations widget toolbar search skip header".split())

BODY, OPEN, ASIDE = "b", "o", "a"


def blocks(page: str) -> list[tuple[str, str]]:
    """(zone, text) of the page's blocks in order; raw elements and empty blocks are left out."""
    found: list[tuple[str, str, int]] = []
    text: list[str] = []
    stack: list[tuple[str, int, int, int]] = []  # name, and whether it is furniture, is only hinted at, is the article
    opened: Counter[str] = Counter()
    ends: dict[str, list[int]] = {group: [-1] for group in _LEFT_OPEN.values()}  # for each wall, where the open member of the group is
    aside = hinted = inside = articles = 0

    def flush() -> None:
        if text:
            said = " ".join("".join(text).split())
            if said:
                found.append((ASIDE if aside else OPEN if hinted or not inside else BODY, said, inside))
            text.clear()

    def leave(depth: int) -> None:
        nonlocal aside, hinted, inside
        while len(stack) > depth:
            name, drop, hint, article = stack.pop()
            opened[name] -= 1
            aside, hinted, inside = aside - drop, hinted - hint, inside - article
            for group in _WALLS.get(name, ()):
                ends[group].pop()
            if (group := _LEFT_OPEN.get(name)) and ends[group][-1] == len(stack):
                ends[group][-1] = -1

    at = 0
    while True:
        m = _TAG.search(page, at)
        if piece := page[at : m.start() if m else len(page)]:
            text.append(html.unescape(piece))
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        block = name in _BLOCK
        if block and (not m[1] or opened[name] or name in ("p", "br")):  # an end without its start breaks nothing, but for those two
            flush()
        if m[1]:
            if opened[name]:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == name:
                        if not block:
                            flush()
                        leave(depth)
                        break
                    if not block and stack[depth][0] in _BLOCK:
                        break
            continue
        if name in _RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in _VOID:
            continue
        if block and name not in _NOT_OVER_P and ends["p"][-1] >= 0:
            leave(ends["p"][-1])
        if (group := _LEFT_OPEN.get(name)) and ends[group][-1] >= 0:
            leave(ends[group][-1])
        marks = {k.lower(): (a or b or c) for k, a, b, c in _ATTRIBUTE.findall(m[3])} if m[3] else {}
        cues = {w for k in ("class", "id", "role") if k in marks for w in re.split(r"[^a-z0-9]+", marks[k].lower())}
        article = name in ("article", "main") or marks.get("role") == "main" or marks.get("itemprop") == "articleBody"
        drop = hint = False
        if not article and name not in ("html", "body") and name not in _HEADINGS:
            drop = name in _FURNITURE or bool(cues & _CUES) or (not inside and name == "header")
            hint = not drop and bool(cues & _HINTS)
        if block or drop or hint or article or opened[name]:  # plain inline elements matter only inside a marked one of their name
            if (drop or hint) and not block:
                flush()
            for wall in _WALLS.get(name, ()):
                ends[wall].append(-1)
            if group:
                ends[group][-1] = len(stack)
            stack.append((name, int(drop), int(hint), int(article)))
            opened[name] += 1
            aside, hinted, inside, articles = aside + drop, hinted + hint, inside + article, articles + article
    flush()
    return [(ASIDE if zone == OPEN and articles and not within else zone, said) for zone, said, within in found]


def _unique(page: list[str], stream: list[str], gone: np.ndarray) -> list[str]:
    kept, at = [], 0
    for block in page:
        n = len(block.split())
        kept.append(" ".join(t for t, g in zip(stream[at : at + n], gone[at : at + n], strict=True) if not g))
        at += n + 1
    return kept


_PARSED = "page_id long, url string, zones string, body array<string>, stream array<string>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        body, zones, stream = [], [], []
        for page in batch.column(0):
            found = blocks(page.as_py() or "")
            zones.append("".join(zone for zone, _ in found))
            body.append([t if zone == BODY else "" for zone, t in found])
            stream.append(["" if zone == BODY else t for zone, t in found])
        kind = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), batch.column(2), pa.array(zones), pa.array(body, kind), pa.array(stream, kind)], names=["page_id", "url", "zones", "body", "stream"]
        )


def _stream(page: list[str]) -> list[str]:
    return [t for block in page for t in (*block.split(), "\n")]


def _token_hashes(stream: list[str], known: dict[str, tuple[int, int]]) -> np.ndarray:
    if len(known) > REMEMBERED:
        known.clear()
    out = np.empty((2, len(stream)), dtype=np.uint64)
    for n, t in enumerate(stream):
        if (h := known.get(t)) is None:
            raw = hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            h = known[t] = (int.from_bytes(raw[:8], "little"), int.from_bytes(raw[8:], "little"))
        out[0, n], out[1, n] = h
    return out


def _powers(of: int, count: int) -> np.ndarray:
    out = np.full(count, of, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _hashes(host: str, stream: list[str], start: np.ndarray, stop: np.ndarray, known: dict[str, tuple[int, int]]) -> np.ndarray:
    """128 bits of every window and its host, as two rows of longs."""
    tokens, size = _token_hashes([host, *stream], known), len(stream)
    sums = np.zeros((2, size + 1), dtype=np.uint64)
    np.cumsum(tokens[:, 1:] * _powers(_STEP, size), axis=1, out=sums[:, 1:])
    of = (sums[:, stop] - sums[:, start]) * _powers(_BACK, size + 1)[start]
    return (of + tokens[:, :1] * np.uint64(_BACK) + (stop - start).astype(np.uint64)).view(np.int64)


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, host, stream) → row, at, head: the suffixes of a stream that can begin a repeat, with what orders them.

    A suffix at the start of a block has the codes of its tokens up to the last end of a block within PASSAGE_TOKENS; an article
    ends it. One of PASSAGE_TOKENS or more anywhere has a name of 128 bits for that many: its place among others doesn't
    matter before that depth, and longer runs of blocks are made of such stretches. Before both stand the host and the kind."""
    known: dict[str, tuple[int, int]] = {}
    for batch in batches:
        for row, host, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            stream = _stream(page)
            codes = _token_hashes([host, *stream], known)[0].astype(">u8").tobytes()
            ends = [0, *np.cumsum([len(block.split()) + 1 for block in page]).tolist()]
            places, heads = [], []
            for n in range(len(page)):
                k = n
                while k < len(page) and page[k] and ends[k + 1] - ends[n] <= PASSAGE_TOKENS:
                    k += 1
                if ends[k] - ends[n] >= LEAST_TOKENS:
                    places.append(ends[n])
                    heads.append(codes[:_CODE] + _RUN + codes[_CODE * (1 + ends[n]) : _CODE * (1 + ends[k])])
            start = np.arange(len(stream) - PASSAGE_TOKENS + 1)
            if len(start):
                names = _hashes(host, stream, start, start + PASSAGE_TOKENS, known).T.tobytes()
                places += start.tolist()
                heads += [codes[:_CODE] + _STRETCH + names[16 * k : 16 * k + 16] for k in start.tolist()]
            if places:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(places), row)), pa.array(places, pa.int64()), pa.array(heads, pa.binary())], names=["row", "at", "head"]
                )


def _common(one: bytes, other: bytes) -> int:
    """How many tokens two suffixes have in common at least; less than LEAST_TOKENS counts as none."""
    least = _CODE + 1 + _CODE * LEAST_TOKENS
    if one[_CODE : _CODE + 1] == _STRETCH:
        return PASSAGE_TOKENS if one == other else 0
    if one[:least] != other[:least]:
        return 0
    size = (min(len(one), len(other)) - _CODE - 1) // _CODE
    x, y = (np.frombuffer(h, dtype="<u8", count=size, offset=_CODE + 1) for h in (one, other))
    differ = np.flatnonzero(x != y)
    return int(differ[0]) if len(differ) else size


def _shortest(rows: list[int], many: int) -> Iterator[tuple[int, int]]:
    """The shortest spans with `many` different rows from each place on and, where rows repeat, also up to each place: a place
    in any span of so many lies in one of them that the span contains."""
    for turned in (False, True) if len(set(rows)) < len(rows) else (False,):
        own = rows[::-1] if turned else rows
        held: Counter[int] = Counter()
        j = 0
        for i, row in enumerate(own):
            while j < len(own) and len(held) < many:
                held[own[j]] += 1
                j += 1
            if len(held) < many:
                break
            yield (len(own) - j, len(own) - i) if turned else (i, j)
            held[row] -= 1
            if not held[row]:
                del held[row]


_COMPARED = "task int, row long, at long, stretch boolean, lengths array<long>, first long, last long, side int, depth long, prefix binary, pages array<long>"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, at, head) in order of head and row → of each suffix that others begin like: for 2, 3, ... MANY_PAGES pages, how many
    tokens that many pages of this task have in common with it, and how many it has in common with the task's first and last suffix.

    Repeats may go on in the tasks beside. So of the first and the last suffix's beginnings (`side`, `depth`, `prefix`) up to
    MANY_PAGES pages of the task that have them are given as well."""
    rows, places, heads = [], [], []
    task = TaskContext.get().partitionId()
    for batch in batches:
        for row, at, head in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if heads and heads[-1] == head and rows[-1] == row:
                places[-1].append(at)
            else:
                rows.append(row), places.append([at]), heads.append(head)
    n = len(heads)
    if not n:
        return
    lcp = np.array([0, *map(_common, heads, heads[1:])], dtype=np.int64)  # of each suffix and the one before it
    edge = np.zeros((2, n), dtype=np.int64)
    out: list[tuple] = []
    for side, (top, step) in enumerate(((0, 1), (n - 1, -1))):
        size = PASSAGE_TOKENS if heads[top][_CODE : _CODE + 1] == _STRETCH else (len(heads[top]) - _CODE - 1) // _CODE
        k, depth, pages = top, size, []
        while 0 <= k < n and depth >= LEAST_TOKENS:
            edge[side, k] = depth
            if rows[k] not in pages[:MANY_PAGES]:
                pages.append(rows[k])
            k += step
            shared = min(depth, int(lcp[k if step == 1 else k + 1])) if 0 <= k < n else 0
            for d in range(depth, max(shared, LEAST_TOKENS - 1), -1):
                whole = heads[top][_CODE : _CODE + 1] == _STRETCH
                if d == PASSAGE_TOKENS or not whole:
                    prefix = heads[top] if whole else heads[top][: _CODE + 1 + _CODE * d]
                    out.append((task, None, None, None, None, None, None, side, d, prefix, pages[:MANY_PAGES]))
            depth = shared
    lengths = np.zeros((MANY_PAGES - 1, n), dtype=np.int64)
    cuts = np.flatnonzero(lcp < LEAST_TOKENS).tolist() + [n]
    for a, b in zip(cuts, cuts[1:], strict=False):
        for k in range(2, min(MANY_PAGES, b - a) + 1):
            for i, j in _shortest(rows[a:b], k):
                np.maximum(lengths[k - 2, a + i : a + j], lcp[a + i + 1 : a + j].min(), out=lengths[k - 2, a + i : a + j])
    for k in np.flatnonzero((lengths[0] > 0) | (edge[0] > 0) | (edge[1] > 0)).tolist():
        for at in places[k]:
            stretch = heads[k][_CODE : _CODE + 1] == _STRETCH
            out.append((task, rows[k], at, stretch, lengths[:, k].tolist(), int(edge[0, k]), int(edge[1, k]), None, None, None, None))
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
    names = [field.split()[0] for field in _COMPARED.split(", ")]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def _repeats(streams: DataFrame) -> DataFrame:
    """(row, host, stream) → row, at, length, stretch: for each suffix the longest beginning that enough pages of its host have."""
    suffixes = streams.select("row", "host", "stream").mapInArrow(_suffixes, "row long, at long, head binary")
    tokens = streams.agg(F.sum(F.size(F.split(F.array_join("stream", " "), " ")))).first()[0] or 0
    tasks = [tokens // SUFFIXES_A_TASK] if tokens // SUFFIXES_A_TASK > int(streams.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    ordered = suffixes.repartitionByRange(*tasks, "head", "row").sortWithinPartitions("head", "row")
    found = settle(ordered.mapInArrow(_compared, _COMPARED), "suffixes-compared")
    # what begins as a task's first or last suffix is counted over all tasks; there are two such suffixes a task
    edges = found.where("side IS NOT NULL").select("task", "side", "depth", "prefix", "pages")
    over_all = edges.groupBy("prefix").agg(F.size(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("n"))
    reached = [F.max(F.when(F.col("n") >= k, F.col("depth")).otherwise(0)) for k in range(2, MANY_PAGES + 1)]
    of_task = edges.join(over_all, "prefix").groupBy("task", "side").agg(F.array(*reached).alias("reach"))
    first, last = (of_task.where(F.col("side") == n).select("task", F.col("reach").alias(f"reach{n}")) for n in range(2))
    few = F.greatest(F.lit(2), F.least(F.lit(MANY_PAGES), F.ceil(F.count(F.lit(1)) / F.lit(2))))
    needed = streams.groupBy("host").agg((few - 2).cast("int").alias("needed"))
    of_row = found.where("row IS NOT NULL").join(F.broadcast(first), "task", "left").join(F.broadcast(last), "task", "left")
    of_row = of_row.join(streams.select("row", "host"), "row").join(needed, "host")
    beside = [F.least(e, F.coalesce(F.get(f"reach{n}", "needed"), F.lit(0))) for n, e in enumerate(("first", "last"))]
    return of_row.select("row", "at", F.greatest(F.get("lengths", "needed"), *beside).alias("length"), "stretch").where(F.col("length") >= LEAST_TOKENS)


def _gone(page: list[str], repeats: list[dict]) -> np.ndarray:
    """Which tokens of a page's stream its repeats cover: stretches, and whole blocks of runs."""
    ends = np.cumsum([0, *(len(block.split()) + 1 for block in page)])
    gone = np.zeros(int(ends[-1]) + 1, dtype=np.int64)
    for r in repeats:
        stop = r["at"] + r["length"]
        if not r["stretch"]:
            stop = int(ends[np.searchsorted(ends, stop, side="right") - 1])
        if stop - r["at"] >= LEAST_TOKENS:
            gone[r["at"]] += 1
            gone[stop] -= 1
    return np.cumsum(gone[:-1]) > 0


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(same, stream, zones, repeats) → same, its OPEN blocks without what the repeats cover ('' for other blocks), and how many
    tokens of the whole stream they cover."""
    for batch in batches:
        rows, left, covered = [], [], []
        for same, page, zones, repeats in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            stream, gone = _stream(page), _gone(page, repeats or [])
            unique = [t if zone == OPEN else "" for zone, t in zip(zones, _unique(page, stream, gone), strict=True)]
            if not any(unique) and BODY not in zones:
                unique = [t if zone == OPEN else "" for zone, t in zip(zones, page, strict=True)]
            rows.append(same)
            left.append(unique)
            covered.append(sum(g and t != "\n" for t, g in zip(stream, gone.tolist(), strict=True)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.string()), pa.array(left, pa.list_(pa.string())), pa.array(covered, pa.int64())], names=["same", "unique", "covered"]
        )


def extract_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """→ one row per input row: page_id, url, text, n_chars (code points), boilerplate_tokens.

    Blocks are joined by one newline, white space inside a block is one space, character references are decoded. Null
    html is empty; a page without main text has an empty one. Ids and urls are carried as they are, null and repeated ones too; a null url
    is a host of its own. Pages of equal streams and zones count once when a host's pages are counted. Other columns are ignored; an empty table
    gives no row. `boilerplate_tokens`: how many tokens outside the page's article lie in what its host repeats.
    """
    source = pages.select(
        column(html_column).cast("string").alias("html"), column(id_column).cast("long").alias("page_id"), column(url_column).cast("string").alias("url")
    )
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    parsed = source.mapInArrow(_parse, _PARSED).withColumn("host", host)
    parsed = parsed.withColumn("same", F.when(F.exists("stream", lambda t: t != ""), F.sha2(F.concat_ws("\n", "host", "zones", "stream"), 256)))
    # a stream is known by what it says, so pages are parsed anew for the result rather than written
    streams = parsed.where("same IS NOT NULL").groupBy("same").agg(*(F.first(c).alias(c) for c in ("host", "stream", "zones")), F.count(F.lit(1)).alias("times"))
    streams = settle(streams.withColumn("row", F.monotonically_increasing_id()), "page-streams")
    held = _repeats(streams).groupBy("row").agg(F.collect_list(F.struct("at", "length", "stretch")).alias("repeats"))
    marked = streams.join(held, "row", "left").select("same", "stream", "zones", "repeats")
    unique = marked.mapInArrow(_without, "same string, unique array<string>, covered long")
    unique = settle(unique.join(streams.select("same", "times"), "same"), "page-unique")
    # streams that very many pages have are few by definition and go by broadcast; pages without a stream and theirs are spread by a key of no match
    pages_of = unique.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("n")).first()["n"]
    hot = unique.where(F.col("times") > pages_of // HOT_SHARE + 1).select("same", F.col("unique").alias("hot_unique"), F.col("covered").alias("hot_covered"))
    cold = unique.select(F.col("same").alias("key"), "unique", "covered")
    joined = parsed.drop("stream", "zones", "host").join(F.broadcast(hot), "same", "left")
    apart = F.concat(F.lit(":"), F.xxhash64("page_id", "url", F.size("body")).cast("string"))
    joined = joined.withColumn("key", F.when(F.col("same").isNull() | F.col("hot_unique").isNotNull(), apart).otherwise(F.col("same"))).join(cold, "key", "left")
    rest, covered = F.coalesce("hot_unique", "unique"), F.coalesce("hot_covered", "covered", F.lit(0))
    both = F.when(rest.isNull(), F.col("body")).otherwise(F.zip_with("body", rest, lambda b, u: F.when(b != "", b).otherwise(u)))
    done = joined.select("page_id", "url", F.array_join(F.filter(both, lambda t: t != ""), "\n").alias("text"), covered.cast("long").alias("boilerplate_tokens"))
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "boilerplate_tokens")
