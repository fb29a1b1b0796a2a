"""Tokens, hashes, chunks and text predicates as native expressions; none needs a Python worker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that carry no meaning in search, and units that may follow a number with or without a space
STOPWORDS = (
    "a an and are as at be but by for from has have if in into is it its of on or "
    "that the their then there these this to was were will with you your not no "
    "we they he she i do does did done can could should would may might"
).split()
UNITS = (
    "b kb mb gb tb pb kib mib gib tib bit bits byte bytes ns us ms sec secs s min mins m h hr hrs d day days k bn req rps qps px pt"
).split()
LITERAL_WEIGHT = 3.0

_PURE_NUMBER = r"^\d+(\.\d+)*$"
_NUMBER_UNIT = r"^(\d+(?:\.\d+)?)([a-z]+)$"


def _among(words: list[str], x: Column) -> Column:
    return x.isin(words)  # a hash set once planned


def _searched(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: (F.length(t) >= 2) & (F.length(t) <= 40) & ~_among(STOPWORDS, t))


def tokenize(text: Column, literals: bool = True) -> Column:
    """Search tokens with repeats: literals stay whole, and `6.8 MB` gives what `6.8MB` gives.

    Null gives an empty array. Stateless: whether a run is a unit already used up shows in the run before it. Without `literals` each run of
    signs is one token, whatever it looks like.
    """
    runs = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9_.]+", -1)
    runs = F.filter(F.transform(runs, lambda r: F.regexp_replace(r, r"^\.+|\.+$", "")), lambda r: r != "")
    if not literals:
        return _searched(runs)

    def expand(bound: Column) -> Column:
        def of(run: Column, i: Column) -> Column:
            before, after = F.get(bound, i - 1), F.get(bound, i + 1)
            used = (i > 0) & F.coalesce(before.rlike(_PURE_NUMBER), F.lit(False)) & _among(UNITS, run)
            measured = run.rlike(_PURE_NUMBER) & after.isNotNull() & _among(UNITS, F.coalesce(after, F.lit("")))
            number, unit = F.regexp_extract(run, _NUMBER_UNIT, 1), F.regexp_extract(run, _NUMBER_UNIT, 2)
            parts = F.filter(F.split(run, r"\."), lambda s: s != "")
            named = run.contains(".") & (F.size(parts) > 1) & F.forall(parts, lambda s: s.rlike("^[a-z]"))
            return (
                F.when(~run.rlike("[0-9.]") & ~_among(UNITS, run), F.array(run))  # most runs: no literal, and no unit of one
                .when(used, F.array().cast("array<string>"))
                .when(measured, F.array(run, F.concat(run, after), after))
                .when(run.rlike(_PURE_NUMBER), F.array(run))
                .when((number != "") & _among(UNITS, unit), F.array(run, number, unit))
                .when(named, F.concat(F.array(run), parts))
                .otherwise(F.array(run))
            )

        return F.flatten(F.transform(bound, of))

    # bind the runs once: the lambda sees a variable, not the splitting expression
    tokens = F.get(F.transform(F.array(runs), expand), F.lit(0))
    return _searched(tokens)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of an ASCII string, as a long."""
    codes = F.filter(F.transform(F.split(text, ""), lambda c: F.ascii(c)), lambda c: c != 0)
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: F.pmod(h.bitwiseXOR(c.cast("long")) * F.lit(16777619), F.lit(4294967296)))


def is_literal_token(token: Column) -> Column:
    """Whether a token looks like an identifier or a measurement."""
    return (token.rlike(r"\d") & token.rlike("[a-z]")) | token.contains("_") | token.contains(".") | token.rlike(r"^\d{3,}$")


def term_weight(tf: Column, token: Column | None = None) -> Column:
    """1 + ln(tf); with a token, three times that for literals (queries only)."""
    weight = 1 + F.log(tf)
    return weight if token is None else weight * F.when(is_literal_token(token), F.lit(LITERAL_WEIGHT)).otherwise(F.lit(1.0))


def chunk(text: Column, most: int = 1800, overlap: int = 200) -> Column:
    """Pieces of about `most` characters: whole paragraphs packed greedily, each next piece seeded with the last one's
    tail, long paragraphs cut. A seeded piece may reach most + overlap + 2. Blank text gives no piece."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    paragraphs = F.filter(F.split(body, r"\n{2,}", -1), lambda p: F.trim(p) != "")
    starts = lambda p: F.sequence(F.lit(0), F.greatest(F.ceil(F.length(p) / most) - 1, F.lit(0)).cast("int"))
    pieces = F.flatten(F.transform(paragraphs, lambda p: F.transform(starts(p), lambda i: F.substr(p, i * most + 1, F.lit(most)))))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("current"))

    def step(state: Column, piece: Column) -> Column:
        full = (state["current"] != "") & (F.length(state["current"]) + F.length(piece) + 2 > most)
        seed = F.when(full, F.right(state["current"], F.lit(overlap))).otherwise(state["current"])
        done = F.when(full, F.array_append(state["done"], state["current"])).otherwise(state["done"])
        return F.struct(done.alias("done"), F.when(seed == "", piece).otherwise(F.concat(seed, F.lit("\n\n"), piece)).alias("current"))

    packed = F.aggregate(pieces, empty, step, lambda s: F.array_append(s["done"], s["current"]))
    clean = F.filter(F.transform(packed, lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")), lambda c: c != "")
    return F.when(F.length(body) <= most, F.filter(F.array(body), lambda c: c != "")).otherwise(clean)


def deterministic_uuid(namespace: str, *parts: Column) -> Column:
    """Name-based UUID (version 5 shape) of the parts joined by U+001F; a null part counts as empty."""
    joined = F.concat_ws("\u001f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(joined, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)
    )


#: The name space of entry and point ids.
NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def dedup_key(project: Column, path: Column, ref: Column, title: Column, body: Column) -> Column:
    """The key under which an entry is written once."""
    return deterministic_uuid(NAMESPACE, project, path, ref, title, content_hash(body))


# fixed values: path words that mark archived documents
_ARCHIVED = r"(?i)^_?(archived?s?|legacy|old|deprecated|previous|obsolete|superseded|outdated|backups?|bak)$"
MONTH_MS = int(30.44 * 24 * 3600 * 1000)


def is_archived_path(path: Column) -> Column:
    """A directory, or a token of the file's stem, is an archive word; whole words only."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]+$", "")
    hit = lambda s: s.rlike(_ARCHIVED)
    return F.exists(folders, hit) | F.exists(F.split(stem, "[._-]"), hit)


def age_months(at: Column, as_of: Column) -> Column:
    return F.floor((F.unix_millis(as_of) - F.unix_millis(at)) / F.lit(MONTH_MS)).cast("int")


def recency_factor(at: Column, as_of: Column, days: float = 180.0, boost: float = 0.12) -> Column:
    """1 + boost * exp(-age / days); 1 without a date, ages before `as_of` only."""
    age = F.greatest((F.unix_millis(as_of) - F.unix_millis(at)) / F.lit(86400000.0), F.lit(0.0))
    return F.when(at.isNull(), F.lit(1.0)).otherwise(1 + F.lit(boost) * F.exp(-age / F.lit(days)))


def slugify(name: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", F.lit("unnamed")).otherwise(slug)


def encode_path(path: Column) -> Column:
    """A working directory as transcript folders spell it."""
    return F.regexp_replace(path, "[^A-Za-z0-9-]", "-")


# fixed values: route patterns and their classes, most specific first
ROUTES = (
    (r"^/api/search$", "query"), (r"^/api/ask$", "query"), (r"^/api/ask/stream$", "query"), (r"^/api/projects/[^/]+/backlog/review$", "query"),
    (r"^/api/projects/[^/]+/backlog/verdict$", "write"),
    (r"^/api/health$", "status"), (r"^/api/stats$", "status"), (r"^/api/dashboard$", "status"),
    (r"^/api/projects$", "read"), (r"^/api/timeline$", "read"), (r"^/api/projects/[^/]+/timeline$", "read"), (r"^/api/projects/[^/]+/components$", "read"),
    (r"^/api/projects/[^/]+/components/[^/]+$", "read"), (r"^/api/projects/[^/]+/sessions$", "read"), (r"^/api/projects/[^/]+/backlog$", "read"),
    (r"^/api/sessions/[^/]+$", "read"), (r"^/api/entries/[^/]+$", "read"),
)


def route_class(path: Column) -> Column:
    """query, read, write, status, admin or other, by whole path segments; the query string is ignored."""
    bare = F.substring_index(F.coalesce(path, F.lit("")), "?", 1)
    clean = F.concat(F.lit("/"), F.array_join(F.filter(F.split(bare, "/"), lambda s: s != ""), "/"))
    out = F.when(clean == "/", F.lit("other")).when(clean.rlike(r"^/api/admin(/|$)"), F.lit("admin"))
    for pattern, name in ROUTES:
        out = out.when(clean.rlike(pattern), F.lit(name))
    return out.otherwise(F.lit("other"))


def _stems(text: Column) -> Column:
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "), r"\s+"), lambda w: F.length(w) >= 3)
    cut = lambda w, n: F.substr(w, F.lit(1), F.length(w) - n)
    stem = lambda w: (
        F.when((F.length(w) > 5) & w.endswith("ing"), cut(w, 3))
        .when((F.length(w) > 4) & w.endswith("ed"), cut(w, 2))
        .when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), cut(w, 1))
        .otherwise(w)
    )
    return F.array_distinct(F.transform(words, stem))


def token_containment(summary: Column, candidate: Column) -> Column:
    """Share of the summary's distinct stems found in the candidate; 0 for an empty summary."""
    mine = _stems(summary)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(mine, _stems(candidate))).cast("double"), F.size(mine).cast("double")), F.lit(0.0))


def fts_query(text: Column) -> Column:
    """Tokens joined by ` | `: any of them matches."""
    return F.array_join(tokenize(text), " | ")


# fixed values: question classes by their first matching pattern
QUESTION_CLASSES = (
    ("temporal", r"\b(20\d\d-\d\d-\d\d|yesterday|last (week|month)|on july|what happened on)\b"),
    ("incident", r"\b(root cause|crash|failed|failure|spike|incident|bug|broke|starv)"),
    ("intent", r"\b(why|rationale|deliberate|instead of|decided)\b"),
    ("procedural", r"\b(how (to|do|should)|procedure|safely|steps)\b"),
)


def question_class(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(QUESTION_CLASSES):
        out = F.when(F.lower(text).rlike(pattern), F.lit(name)).otherwise(out)
    return F.coalesce(out, F.lit("definitional"))


def call_template(text: Column) -> Column:
    """Text with its numbers and spacing evened out, to tell generated load from questions."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\d+", "#"), r"\s+", " "))


def tokens_per_second(completion: Column, total_ms: Column, first_token_ms: Column) -> Column:
    """One decimal; null when a part is missing or no time passed."""
    took = total_ms - first_token_ms
    return F.when(took > 0, F.round(completion / (took / F.lit(1000.0)), 1))


_MONTHS = "january february march april may june july august september october november december".split()
_MONTH_ALT = "|".join(sorted({*_MONTHS, *(m[:3] for m in _MONTHS)}, key=lambda m: (-len(m), m)))


def _days(text: Column, pattern: str, order: str) -> Column:
    """Dates of the matches, null where the calendar has no such day."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    names = F.array(*(F.lit(m[:3]) for m in _MONTHS))

    def date(match: Column) -> Column:
        a, b, c = (F.regexp_extract(match, pattern, i) for i in (1, 2, 3))
        year, month, day = {"iso": (a, b, c), "dmy": (c, b, a), "mdy": (c, a, b), "my": (b, a, F.lit("01"))}[order]
        number = month if order == "iso" else F.lpad(F.array_position(names, F.lower(F.substring(month, 1, 3))).cast("string"), 2, "0")
        return F.try_to_date(F.concat_ws("-", year, number, F.lpad(day, 2, "0")), "yyyy-MM-dd")

    return F.filter(F.transform(found, date), lambda d: d.isNotNull())


def date_window(text: Column) -> Column:
    """The span of the dates a question names, as struct(since, until) with `until` the last millisecond; else null.

    Days are `2026-07-21`, `21 July 2026`, `July 21, 2026`; only without any of them does `July 2026` mean its month.
    """
    days = F.concat(
        _days(text, r"(?<![\d-])(\d{4})-(\d{2})-(\d{2})(?![\d-])", "iso"),
        _days(text, rf"(?i)\b(\d{{1,2}})(?:st|nd|rd|th)?\s+({_MONTH_ALT})\b[,\s]+(\d{{4}})\b", "dmy"),
        _days(text, rf"(?i)\b({_MONTH_ALT})\s+(\d{{1,2}})(?:st|nd|rd|th)?\b[,\s]+(\d{{4}})\b", "mdy"),
    )
    months = _days(text, rf"(?i)\b({_MONTH_ALT})\s+(\d{{4}})(\b)", "my")
    since = F.when(F.size(days) > 0, F.array_min(days)).otherwise(F.array_min(months))
    until = F.when(F.size(days) > 0, F.array_max(days)).otherwise(F.last_day(F.array_max(months)))
    end = F.timestamp_millis(F.unix_millis(until.cast("timestamp")) + 86399999)
    return F.when(since.isNotNull(), F.struct(since.cast("timestamp").alias("since"), end.alias("until")))


def padded_window(window: Column, days: int) -> Column:
    shift = days * 86_400_000
    return F.struct(
        F.timestamp_millis(F.unix_millis(window["since"]) - shift).alias("since"), F.timestamp_millis(F.unix_millis(window["until"]) + shift).alias("until")
    )
