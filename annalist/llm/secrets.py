"""Secrets in texts, with multipart credential linking.

Three base kinds are always reported: assignments to secret-like names, access key identifiers, long hexadecimal runs.
Weaker parts (account names, base64-like secrets, service endpoints) mean little alone. They are reported only when an
interval join finds their complement within SCOPE code points of the same text: an identifier beside a secret, a
secret beside an identifier or an endpoint, an endpoint beside both.

Only DataFrame operations run here. A match's place comes from the lengths of what a split by its pattern leaves between
matches; texts without a match of a kind only pay for the search.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.llm.shared import settle

SCOPE = 256


@dataclass(frozen=True)
class Kind:
    name: str
    role: str  # identifier, secret or endpoint
    pattern: str
    guard: str  # a cheap pattern that any match contains
    #: least length of the pattern's group, (0, 0) for no such rule
    group: tuple[int, int] = (0, 0)


# In order of listing. Runs are matched at full length, so a lower bound in the pattern equals dropping short matches,
# but for `assign`, where a short match still uses up its text.
BASE = (
    Kind("assign", "secret", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"""(?i:passw(?:or)?d|secret|token|api_?key)["']?\x20*[:=]""", (2, 6)),
    Kind("access", "identifier", r"AKIA[A-Z0-9]{16,}", r"AKIA[A-Z0-9]{16}"),
    Kind("hex", "secret", r"[0-9a-f]{24,}", r"[0-9a-f]{24}"),
)
WEAK = (
    Kind("account", "identifier", r"""(?i:\b(user(?:name|_?id)?|login|account|client_?id|(?:access_?)?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]{3,})""", r"""(?i:user|login|account|client_?id|key_?id)[a-z_]*["']?\x20*[:=]""", (2, 3)),
    Kind("opaque", "secret", r"(?<![A-Za-z0-9/+])(?=[a-z0-9/+]*[A-Z])(?=[A-Z0-9/+]*[a-z])(?=[A-Za-z/+]*[0-9])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+])", r"[A-Za-z0-9/+]{40}"),
    Kind("endpoint", "endpoint", r"""(?:https?|s3|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]{3,}""", r"://[^\s]"),
)

_SPAN = "struct<start:int,kind:int,end:int>"


def places(text: Column, kind: Kind, number: int) -> Column:
    """Array of (start, kind, end) of the kind's matches: code points, end exclusive, leftmost and non-overlapping."""
    between, matches = F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    rows = F.zip_with(
        F.slice(between, 1, F.size(between) - 1), matches, lambda gap, match: F.struct(F.length(gap).alias("gap"), match.alias("match"))
    )
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("found"))

    def step(so_far: Column, row: Column) -> Column:
        start = so_far["at"] + row["gap"]
        end = start + F.length(row["match"])
        span = F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"))
        kept = F.array_append(so_far["found"], span)
        group, least = kind.group
        if group:
            kept = F.when(F.length(F.regexp_extract(row["match"], kind.pattern, group)) >= least, kept).otherwise(so_far["found"])
        return F.struct(end.alias("at"), kept.alias("found"))

    found = F.aggregate(rows, empty, step, lambda x: x["found"])
    return F.when(text.rlike(kind.guard), found).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _written(spans: str) -> Column:
    names = F.array(*(F.lit(k.name) for k in BASE + WEAK))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _linked(found: DataFrame, scope: int) -> DataFrame:
    """(row, linked spans) of the weak parts whose complement lies in scope."""
    roles = F.array(*(F.lit(k.role) for k in BASE + WEAK))
    parts = found.where(F.size("weak") > 0).select("row", F.explode(F.concat("base", "weak")).alias("s")).select(
        "row", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.kind").alias("kind"), F.get(roles, F.col("s.kind")).alias("role")
    )
    bucket = F.floor(F.col("start") / scope)
    weak = parts.where(F.col("kind") >= len(BASE)).withColumn("bucket", bucket)
    near = parts.select("row", F.col("start").alias("s2"), F.col("role").alias("role2"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    met = weak.join(near, ["row", "bucket"]).where((F.abs(F.col("start") - F.col("s2")) <= scope) & (F.col("role") != F.col("role2")))
    has = {r: F.bool_or(F.col("role2") == r) for r in ("identifier", "secret", "endpoint")}
    whole = met.groupBy("row", "start", "kind", "end", "role").agg(*(v.alias(k) for k, v in has.items()))
    reported = whole.where(
        "(role = 'identifier' AND secret) OR (role = 'secret' AND (identifier OR endpoint)) OR (role = 'endpoint' AND identifier AND secret)"
    )
    return reported.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", scope: int = SCOPE) -> DataFrame:
    """→ one row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are `kind:start:end`, by start and then kind in order of listing, joined by commas. Null and empty texts have
    none. Ids are carried as they are; rows with equal or null ids are told apart.
    """
    text = F.col("text")
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    found = source.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        *(places(text, k, n).alias(k.name) for n, k in enumerate(BASE + WEAK)),
    )
    base = F.concat(*(F.col(k.name) for k in BASE))
    clear = F.filter(
        F.concat(*(F.col(k.name) for k in WEAK)), lambda w: ~F.exists(F.col("base"), lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"]))
    )
    found = found.select(
        "row", "doc_id", *(F.size(k.name).cast("long").alias(f"n_{k.name}") for k in BASE), base.alias("base"), *(k.name for k in WEAK)
    ).withColumn("weak", clear)
    found = settle(found.drop(*(k.name for k in WEAK)), "secret-parts")
    all_of = found.join(_linked(found, scope), "row", "left").withColumn(
        "all", F.concat("base", F.coalesce("linked", F.array().cast(f"array<{_SPAN}>")))
    )
    return all_of.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_written("base"), 256).alias("base_sha256"), _written("all").alias("spans"))
