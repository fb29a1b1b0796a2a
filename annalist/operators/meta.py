"""Entries' `meta`, JSON objects held as VARIANT: predicates that reach the scan, merges, removals and resyncs.

A path's value is compared as text, as a store's `->>` gives it: strings bare, other values as JSON. A table written with a VARIANT
column is shredded by Spark, and `value` of a path and what compares it with a constant are read from that path's own column alone.
Null meta, text that is no JSON, and values other than objects have no keys; edits take them for `{}`. Numbers are equal by value,
the order of keys doesn't matter. Of a key that a text repeats the last value counts (a setting of `annalist.session`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MAP = "map<string,variant>"


def with_variant(entries: DataFrame, column: str = "meta") -> DataFrame:
    """Entries with JSON text of a column as VARIANT."""
    return entries.withColumn(column, F.try_parse_json(column))


def _path(keys: tuple[str, ...]) -> str:
    parts = []
    for key in keys:
        if "'" in key and '"' in key:
            raise ValueError(f"a key with both kinds of quotes can't be written in a path: {key}")
        quote = '"' if "'" in key else "'"
        parts.append(f"[{quote}{key}{quote}]")
    return "$" + "".join(parts)


def value(meta: Column, *keys: str) -> Column:
    """The value behind the keys as text, null where there is none."""
    return F.try_variant_get(meta, _path(keys), "string")


def equals(meta: Column, keys: tuple[str, ...], text: str) -> Column:
    return value(meta, *keys) == text


def differs(meta: Column, keys: tuple[str, ...], text: str) -> Column:
    """The value isn't that text; a missing one isn't either."""
    return ~value(meta, *keys).eqNullSafe(F.lit(text))


def _map(meta: Column) -> Column:
    return F.coalesce(F.try_variant_get(meta, "$", _MAP), F.create_map().cast(_MAP))


def has_key(meta: Column, key: str) -> Column:
    """The object has the key at its top, be its value null."""
    return F.map_contains_key(_map(meta), key)


def merged(meta: Column, patch: Column) -> Column:
    """The object with the patch's top keys put in or replaced."""
    new = _map(patch)
    return F.to_variant_object(F.map_concat(F.map_filter(_map(meta), lambda k, _: ~F.map_contains_key(new, k)), new))


def without(meta: Column, *keys: str) -> Column:
    return F.to_variant_object(F.map_filter(_map(meta), lambda k, _: ~k.isin(*keys)))


def text(meta: Column) -> Column:
    """JSON with sorted keys and plain numbers: equal values have equal texts. Null counts as an empty object."""
    return F.coalesce(F.to_json(meta), F.lit("{}"))


def sync_meta(entries: DataFrame, fresh: DataFrame, keys: tuple[str, ...] = ("project", "dedup_key")) -> DataFrame:
    """Entries with the meta that `fresh(*keys, meta)` has for them where it differs from theirs; `changed` tells where. Of several
    fresh rows of a key the one least by its JSON text counts; rows without a null-free key and keys that no entry has change nothing."""
    new = fresh.select(*keys, text(F.col("meta")).alias("_json")).groupBy(*keys).agg(F.min("_json").alias("_json"))
    met = entries.join(new, list(keys), "left")
    changed = F.col("_json").isNotNull() & (F.col("_json") != text(F.col("meta")))
    out = met.withColumn("changed", changed).withColumn("meta", F.when(F.col("changed"), F.parse_json("_json")).otherwise(F.col("meta")))
    return out.select(*entries.columns, "changed")


def sync_doc_status(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Documents marked or unmarked as archived after `files(project, source_path, archived)`; `changed` tells which entries were. A file
    listed twice is archived if one of its rows says so; files that aren't listed, and entries other than documents, stay as they are."""
    told = files.groupBy("project", "source_path").agg(F.max("archived").alias("_archived"))
    met = entries.join(told, ["project", "source_path"], "left")
    doc, meta = F.col("source_type").eqNullSafe(F.lit("doc")), F.col("meta")
    mark = doc & F.col("_archived").eqNullSafe(F.lit(True)) & differs(meta, ("docStatus",), "archived")
    unmark = doc & F.col("_archived").eqNullSafe(F.lit(False)) & has_key(meta, "docStatus")
    archived = F.parse_json(F.lit('{"docStatus":"archived"}'))
    edited = F.when(mark, merged(meta, archived)).when(unmark, without(meta, "docStatus")).otherwise(meta)
    return met.withColumn("changed", mark | unmark).withColumn("meta", edited).select(*entries.columns, "changed")
