"""Numbers and names as people read them, and the small decisions taken before a rebuild."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DASH = "—"


def _plain(x: Column) -> Column:
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def compact(n: Column) -> Column:
    """950, 1.2k, 12k, 3M: one decimal below ten of a unit."""
    size = F.abs(n)
    out = _plain(n)
    for least, suffix in ((1e3, "k"), (1e6, "M"), (1e9, "B"), (1e12, "T")):
        v = n / F.lit(least)
        short = F.when(F.abs(v) < 10, _plain(F.round(v, 1))).otherwise(F.round(v).cast("long").cast("string"))
        out = F.when(size >= least, F.concat(short, F.lit(suffix))).otherwise(out)
    return F.coalesce(out, F.lit(_DASH))


def byte_size(n: Column) -> Column:
    """Binary units, three significant digits."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, suffix in enumerate(("KB", "MB", "GB", "TB"), start=1):
        v = n / F.lit(float(1024**power))
        digits = F.when(v < 10, F.format_string("%.2f", v)).when(v < 100, F.format_string("%.1f", v)).otherwise(F.round(v).cast("long").cast("string"))
        out = F.when(n >= 1024**power, F.concat(digits, F.lit(f" {suffix}"))).otherwise(out)
    return F.coalesce(out, F.lit(_DASH))


def duration(seconds: Column) -> Column:
    s = F.round(seconds).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    m = F.floor(s / 60)
    text = (
        F.when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(m < 60, F.concat(m.cast("string"), F.lit("m "), two(s % 60), F.lit("s")))
        .otherwise(F.concat(F.floor(m / 60).cast("string"), F.lit("h "), two(m % 60), F.lit("m")))
    )
    return F.when(seconds.isNull() | (seconds < 0), F.lit(_DASH)).otherwise(text)


def millis(ms: Column) -> Column:
    s = ms / F.lit(1000.0)
    short = F.when(s < 10, F.format_string("%.1fs", s)).otherwise(F.concat(F.round(s).cast("long").cast("string"), F.lit("s")))
    text = F.when(ms < 1000, F.concat(F.round(ms).cast("long").cast("string"), F.lit("ms"))).when(s < 60, short).otherwise(duration(s))
    return F.when(ms.isNull() | (ms < 0), F.lit(_DASH)).otherwise(text)


def share(part: Column, whole: Column) -> Column:
    """A rounded percentage, or a dash where there is no whole."""
    return F.when(whole > 0, F.concat(F.round(100.0 * part / whole).cast("long").cast("string"), F.lit("%"))).otherwise(F.lit(_DASH))


def collection_name(provider: Column, model: Column, dim: Column, prefix: str = "annalist_") -> Column:
    safe = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_")
    return F.concat(F.lit(prefix), safe(provider), F.lit("_"), safe(model), F.lit("_"), dim.cast("string"))


def embedder_parts(active: Column) -> Column:
    """struct(name, model, dim) of `name/model/dim`, whose model may have slashes; null if it is no such thing."""
    parts = F.split(active, "/")
    dim = F.element_at(parts, -1).try_cast("int")
    model = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(1))), "/")
    return F.when((F.size(parts) >= 3) & (F.get(parts, F.lit(0)) != "") & dim.isNotNull(), F.struct(F.get(parts, F.lit(0)).alias("name"), model.alias("model"), dim.alias("dim")))


def version_key(version: Column) -> Column:
    """The numbers of a version padded to six, so that arrays compare as versions do."""
    numbers = F.transform(F.regexp_extract_all(version, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("long"))
    return F.slice(F.concat(numbers, F.array_repeat(F.lit(0).cast("long"), 6)), 1, 6)


def bare_model(model: Column) -> Column:
    return F.lower(F.element_at(F.split(model, "/"), -1))


def is_substitution(served: Column, requested: Column) -> Column:
    """Whether another model answered than was asked, vendor prefixes aside."""
    return F.coalesce((served != "") & (bare_model(served) != bare_model(requested)), F.lit(False))


def needs_backfill(uncovered: int) -> bool:
    return uncovered > 0


def rebuild_action(stored: int, current: int, uncovered: int, total: int, backfilled: bool, enabled: bool) -> str:
    """none, stamp (a whole rebuild just wrote every vector), rebuild or skipped."""
    if stored == current:
        return "none"
    if backfilled and total > 0 and uncovered >= total:
        return "stamp"
    return "rebuild" if enabled else "skipped"


def refuses_downgrade(configured: str, target: str, active: str | None, populated: int, allowed: bool) -> bool:
    """Whether an automatic choice of embedder must not move a populated index to another collection."""
    return not allowed and configured == "auto" and active is not None and active != target and populated > 0
