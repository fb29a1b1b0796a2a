"""Reading recorded calls back: query strings, literals, paths, markers, ranges. All native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from annalist.functions.text import fnv1a, tokenize

# fixed values: parameters that steer a call without being its subject
MECHANICAL = ("limit", "offset", "k", "max_body", "cursorAt", "cursorId")
_QUERY_STRING = r"^[a-zA-Z_][a-zA-Z0-9_]*="
_UNITS = "b|kb|mb|gb|tb|kib|mib|gib|tib|ns|us|ms|s|sec|secs|min|mins|h|hr|hrs|k|m|bn|rps|qps|px"
MARKER_MOST = 120


def parameters(raw: Column) -> Column:
    """`a=1&b=x+y` as an array of (key, value), decoded, in order; empty values are left out."""
    decode = lambda x: F.url_decode(x)
    pairs = F.transform(F.split(raw, "&"), lambda p: F.struct(decode(F.substring_index(p, "=", 1)).alias("key"), decode(F.regexp_replace(p, "^[^=]*=?", "")).alias("value")))
    return F.filter(pairs, lambda p: p["value"] != "")


def parameter(raw: Column, key: str) -> Column:
    return F.get(F.filter(parameters(raw), lambda p: p["key"] == key), F.lit(0))["value"]


def matches(haystack: Column, needle: str) -> Column:
    """Whether a text holds the needle, whatever the letter case; an empty needle is in every text, null holds nothing else."""
    return F.lit(True) if not needle else F.contains(F.lower(F.coalesce(haystack, F.lit(""))), F.lit(needle.lower()))


def is_query_string(raw: Column) -> Column:
    return raw.rlike(_QUERY_STRING)


def describe_query(raw: Column) -> Column:
    """struct(text, filters): prose as it is; a query string's text, and its other parameters, mechanical ones last."""
    value = F.trim(F.coalesce(raw, F.lit("")))
    all_ = parameters(value)
    text = F.get(F.filter(all_, lambda p: p["key"].isin("q", "question")), F.lit(0))
    rest = F.filter(all_, lambda p: ~p["key"].isin("q", "question") | ~(p["value"] == text["value"]))
    dull = lambda p: p["key"].isin(*MECHANICAL)
    ordered = F.concat(F.filter(rest, lambda p: ~dull(p)), F.filter(rest, dull))
    prose = F.struct(value.alias("text"), F.array().cast("array<struct<key:string,value:string>>").alias("filters"))
    decoded = F.struct(F.coalesce(text["value"], F.lit("")).alias("text"), ordered.alias("filters"))
    return F.when(value == "", F.lit(None)).when(is_query_string(value), decoded).otherwise(prose)


def summarize_query(raw: Column) -> Column:
    """One line for a table cell."""
    d = describe_query(raw)
    filters = F.array_join(F.transform(d["filters"], lambda p: F.concat(p["key"], F.lit(": "), p["value"])), " · ")
    both = F.concat(d["text"], F.lit(" — "), filters)
    return F.coalesce(F.when(F.size(d["filters"]) == 0, d["text"]).when(d["text"] == "", filters).otherwise(both), F.lit(""))


def parse_usage(path: Column, query: Column) -> Column:
    """struct(text, filters) of a recorded search or ask; null where there is no text. Ask keeps none of its filters."""
    keep = ("project", "source", "component", "kind", "since", "until")
    asked = F.trim(query)
    given = F.filter(parameters(query), lambda p: p["key"].isin(*keep))
    none = F.array().cast("array<struct<key:string,value:string>>")
    text = F.trim(F.coalesce(parameter(query, "q"), F.lit("")))
    return F.when(path.startswith("/api/ask"), F.when(asked != "", F.struct(asked.alias("text"), none.alias("filters")))).otherwise(
        F.when(text != "", F.struct(text.alias("text"), given.alias("filters")))
    )


def query_id(text: Column, filters: Column) -> Column:
    """Eight hexadecimal digits of the evened text and the sorted filters. Characters outside ASCII hash by code point."""
    even = F.lower(F.regexp_replace(F.trim(text), r"\s+", " "))
    part = lambda p: F.concat(p["key"], F.lit("="), F.array_join(F.array_sort(F.split(p["value"], ",")), ","))
    given = F.array_join(F.array_sort(F.transform(filters, part)), "&")
    return F.lpad(F.lower(F.hex(fnv1a(F.concat(even, F.lit("|"), given)))), 8, "0")


def leakage(question: Column, entry: Column, exempt: Column | None = None, literals: bool = True) -> Column:
    """Share of the question's distinct tokens, less exempt ones, that the entry has too; 0 without tokens. Without `literals` dotted names
    and measurements are one token each."""
    asked = F.array_distinct(tokenize(question, literals))
    if exempt is not None:
        asked = F.array_except(asked, tokenize(exempt, literals))
    shared = F.size(F.array_intersect(asked, tokenize(entry, literals)))
    return F.when(F.size(asked) == 0, F.lit(0.0)).otherwise(shared / F.size(asked))


def literal_shape(token: Column) -> Column:
    """version, measurement, sha, identifier, dotted or null. Bare numbers are nothing."""
    shapes = (
        ("version", token.rlike(r"(?i)^(?:v\d+(?:\.\d+)+|\d+\.\d+(?:\.\d+)+)$")),
        ("measurement", token.rlike(rf"(?i)^\d+(?:\.\d+)?(?:{_UNITS})$")),
        ("sha", token.rlike(r"(?i)^[0-9a-f]{7,40}$") & token.rlike("(?i)[a-f]") & token.rlike(r"\d")),
        ("identifier", token.rlike(r"(?i)^[a-z][a-z0-9]*(?:_[a-z0-9]+)+$")),
        ("dotted", token.rlike(r"(?i)^[a-z][a-z0-9]*(?:\.[a-z][a-z0-9]*)+$")),
    )
    out = F.lit(None).cast("string")
    for name, test in reversed(shapes):
        out = F.when(test, F.lit(name)).otherwise(out)
    return F.when((token != "") & (F.length(token) <= 40), out)


def extract_literal(text: Column) -> Column:
    """The most telling literal: the first measurement, else sha, version, identifier, dotted name."""
    tokens = F.transform(F.split(F.lower(text), r"[^a-z0-9._]+"), lambda t: F.regexp_replace(t, r"^[._]+|[._]+$", ""))
    shaped = F.transform(tokens, lambda t: F.struct(t.alias("token"), literal_shape(t).alias("shape")))
    found = lambda name: F.get(F.filter(shaped, lambda x: x["shape"] == name), F.lit(0))["token"]
    return F.coalesce(*(found(n) for n in ("measurement", "sha", "version", "identifier", "dotted")))


def spelling_in(text: Column, literal: Column) -> Column:
    """How the text writes the literal, in its own letter case; null if it doesn't."""
    at = F.call_function("locate", F.lower(literal), F.lower(text))
    return F.when(at > 0, F.substr(text, at, F.length(literal)))


def host_path(path: Column, mounts: list[tuple[str, str]]) -> Column:
    """A path inside a container as its host sees it; the longest mount wins, an unmatched path stays."""
    out = path
    for inside, host in sorted(mounts, key=lambda m: len(m[0])):
        prefix = inside if inside.endswith("/") else f"{inside}/"
        tail = F.substr(path, F.lit(len(prefix) + 1))
        out = F.when(path == inside, F.lit(host)).when(path.startswith(prefix), F.concat(F.lit(host.rstrip("/") + "/"), tail)).otherwise(out)
    return out


def editor_url(path: Column, line: Column) -> Column:
    escaped = F.array_join(F.transform(F.split(path, "/"), lambda s: F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))), "/")
    return F.concat(F.lit("vscode://file"), escaped, F.when(line.isNotNull(), F.concat(F.lit(":"), line.cast("string"))).otherwise(F.lit("")))


def line_of(ref: Column) -> Column:
    number = F.regexp_extract(ref, r"^line:(\d+)$", 1)
    return F.when(number != "", number.cast("int"))


def short_summary(text: Column, most: int = MARKER_MOST) -> Column:
    """One line of at most `most` characters, cut between words where that leaves more than half."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    cut = F.substring(flat, 1, most - 1)
    head = F.regexp_extract(cut, r"^(.*) ", 1)
    kept = F.when(F.length(head) > most / 2, head).otherwise(cut)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(kept), F.lit("…")))


def marker_line(kind: Column, line: Column, line_hash: Column, summary: Column, day: Column, evidence: Column) -> Column:
    """The line that would settle a backlog item."""
    ref = F.concat(F.lit("L"), line.cast("string"), F.coalesce(F.concat(F.lit("#"), line_hash), F.lit("")))
    tail = F.coalesce(F.concat(F.lit(" (evidence: "), short_summary(evidence, 80), F.lit(")")), F.lit(""))
    return F.concat(F.lit("- ["), day, F.lit("] "), F.upper(kind), F.lit(" ["), ref, F.lit("]: "), short_summary(summary), tail)


def range_bounds(first: Column, last: Column) -> Column:
    """struct(since, until, days) of a range of days: `until` is exclusive, a single day counts one."""
    return F.struct(
        first.cast("timestamp").alias("since"), F.date_add(last, 1).cast("timestamp").alias("until"), F.greatest(F.datediff(last, first) + 1, F.lit(1)).alias("days")
    )


def judge_verdict(reply: Column, known: Column) -> Column:
    """struct(status, confidence, reasoning, citations) from a model's reply; anything unusable is inconclusive."""
    body = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    v = F.from_json(body, "status STRING, confidence DOUBLE, reasoning STRING, citations ARRAY<BIGINT>")
    good = v["status"].isin("confirmed-resolved", "confirmed-open", "inconclusive")
    cited = F.filter(F.coalesce(v["citations"], F.array().cast("array<bigint>")), lambda c: F.array_contains(known, c))
    ok = F.struct(
        v["status"].alias("status"), F.least(F.greatest(F.coalesce(v["confidence"], F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("confidence"),
        F.substring(F.coalesce(v["reasoning"], F.lit("")), 1, 1000).alias("reasoning"), cited.alias("citations"),
    )
    bad = F.struct(
        F.lit("inconclusive").alias("status"), F.lit(0.0).alias("confidence"), F.lit("model output was not a valid verdict").alias("reasoning"),
        F.array().cast("array<bigint>").alias("citations"),
    )
    return F.when(F.coalesce(good, F.lit(False)), ok).otherwise(bad)


def judge_grades(reply: Column) -> Column:
    """Array of (n, grade) from the widest JSON array of a reply: whole grades 0 to 3, the first of each n."""
    items = F.from_json(F.regexp_extract(reply, r"(?s)\[.*\]", 0), "ARRAY<STRUCT<n: DOUBLE, grade: DOUBLE>>")
    whole = lambda x: x.isNotNull() & (x == F.floor(x))
    good = F.filter(items, lambda x: whole(x["n"]) & whole(x["grade"]) & x["grade"].between(0, 3))
    none = F.array().cast("array<struct<n:int,grade:int>>")
    row = lambda x: F.struct(x["n"].cast("int").alias("n"), x["grade"].cast("int").alias("grade"))
    add = lambda done, x: F.when(F.exists(done, lambda d: d["n"] == x["n"].cast("int")), done).otherwise(F.array_append(done, row(x)))
    return F.coalesce(F.aggregate(good, none, add), none)
