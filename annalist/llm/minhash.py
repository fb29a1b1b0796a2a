"""Near-duplicate documents by b-bit MinHash.

Per document, `BANDS x ROWS` minima over the hashes of its distinct word shingles are taken. A band of full minima
hashes to a bucket key (candidates); of every minimum only the low `BITS` bits are packed into the signature, from
whose matching bits the similarity is estimated with the chance of a collision taken out. Links are confirmed on full
shingle sets.

Documents with the same shingle set are one class. Buckets never expand into all pairs: first every member is compared
with LEADERS members of each of its buckets (a linear number of pairs) and confirmed against the TRIED likeliest, which
ties a group of near-copies together; afterwards only buckets whose members still lie in different components are looked
at. There the members outside the largest component and all members are cut into blocks of bounded size, and each pair of blocks
tests its pairs across components whose estimate is within reach of the threshold, giving back no more links than join
what was apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from annalist.llm import wordhash
from annalist.llm.components import connected_components
from annalist.llm.shared import bound_batches, column, discard, in_slices, settle, settle_counted, tidied

BANDS, ROWS, BITS = 24, 5, 2
#: A pair is confirmed on full sets when its estimate is at most so many standard deviations below the threshold.
REACH = 5.0
#: Members of a bucket that all others are compared with first, and how many of those a member is confirmed against.
LEADERS, TRIED = 4, 2
#: A block of a bucket has about so many members, and shingles, at most.
BLOCK_ROWS, BLOCK_SHINGLES = 256, 200_000

_HASHES = BANDS * ROWS
_MULTIPLIERS = wordhash.mix(np.arange(1, _HASHES + 1, dtype=np.uint64)) | np.uint64(1)
_LONGS = -(-_HASHES * BITS // 64)
_SKETCH = [
    T.StructField("n_shingles", T.LongType()),
    T.StructField("set_digest", T.BinaryType()),
    T.StructField("signature", T.ArrayType(T.LongType())),
    T.StructField("bands", T.ArrayType(T.LongType())),
]


def minima(hashes: np.ndarray, step: int = 2048) -> np.ndarray:
    least = np.full(_HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), step):
        np.minimum(least, np.multiply(_MULTIPLIERS[:, None], hashes[None, at : at + step]).min(axis=1), out=least)
    return least


def pack(least: np.ndarray) -> np.ndarray:
    """The low BITS bits of the (mixed) minima, side by side in longs. `least` has a row for each document."""
    low = (wordhash.mix(least) & np.uint64((1 << BITS) - 1)).astype(np.uint64)
    per = 64 // BITS
    low = np.pad(low, ((0, 0), (0, _LONGS * per - _HASHES)))
    shifts = np.arange(per, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(low.reshape(-1, _LONGS, per) << shifts, axis=2).view(np.int64)


def band_keys(least: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(least), BANDS), dtype=np.uint64)
    grouped = least.reshape(-1, BANDS, ROWS)
    for r in range(ROWS):
        keys = wordhash.mix(keys * np.uint64(31) + grouped[:, :, r])
    return wordhash.mix(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def set_digest(hashes: np.ndarray) -> bytes:
    """128 bits of a set of hashes and its size."""
    if not len(hashes):
        return b""
    other = wordhash.mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
    both = np.array([hashes.sum(dtype=np.uint64), other.sum(dtype=np.uint64)], dtype=np.uint64)
    return wordhash.mix(both + np.uint64(len(hashes))).tobytes()


def _sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    for _, data, offsets in wordhash.text_blocks(column):
        words, counts = wordhash.word_hashes(data, offsets)
        at = 0
        for n in counts:
            yield wordhash.shingle_sets(words[at : at + n], width)
            at += n


def _sketcher(width: int):
    """(doc, id, text) → the same and what the text's set has."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, least = [], [], []
            for hashes in _sets(batch.column(2), width):
                sizes.append(len(hashes))
                digests.append(set_digest(hashes) or None)
                least.append(minima(hashes))
            if not sizes:
                continue
            full = np.array(least, dtype=np.uint64).reshape(-1, _HASHES)
            packed, bands = pack(full), band_keys(full)
            some = np.array(sizes) > 0

            def lists(values: np.ndarray, some=some) -> pa.Array:
                offsets = np.concatenate([[0], np.cumsum(np.where(some, values.shape[1], 0))]).astype(np.int32)
                return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[some].ravel()))

            whole = pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists(packed), lists(bands)],
                names=[*batch.schema.names, *(f.name for f in _SKETCH)],
            )
            yield from in_slices(whole)

    return sketch


def _set_reader(width: int):
    """(rep, text) → (rep, the sorted set as bytes)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets, held = [], [], 0
            for rep, hashes in zip(batch.column(0).to_pylist(), _sets(batch.column(1), width), strict=True):
                ids.append(rep)
                sets.append(hashes.tobytes())
                held += len(sets[-1])
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["rep", "hashes"])
                    ids, sets, held = [], [], 0
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["rep", "hashes"])

    return read


def _confirmer(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.asarray(batch.column(i)) for i in (0, 1))
            keep = np.zeros(len(a), dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                p, q = (np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in (x, y))
                both = np.concatenate([p, q])
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep[i] = 100 * shared >= percent * (len(both) - shared)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return confirm


def estimate(left: str, right: str):
    """Estimated similarity of two packed signatures: share of equal BITS-bit cells, less the chance of equal ones."""
    low = F.lit(int("01" * 32, 2)) if BITS == 2 else None
    if low is None:
        raise NotImplementedError("estimate() counts cells of 2 bits")
    unequal = sum(
        (F.bit_count((x := F.col(left)[k].bitwiseXOR(F.col(right)[k])).bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(low)) for k in range(_LONGS)),
        start=F.lit(0),
    )
    chance = 1 / (1 << BITS)
    return (1 - unequal / F.lit(float(_HASHES)) - chance) / (1 - chance)


def least_estimate(threshold: float) -> float:
    chance = 1 / (1 << BITS)
    p = threshold + (1 - threshold) * chance
    return threshold - REACH * (p * (1 - p) / _HASHES) ** 0.5 / (1 - chance)


def _shingle_sets(rows: DataFrame, needed: DataFrame, width: int) -> DataFrame:
    """(rep, hashes) of the classes in `needed(rep)`, read from the texts of just those rows. How many are needed grows with the
    corpus, so they are merged with the rows at any size."""
    texts = needed.hint("merge").join(rows.select(F.col("row").alias("rep"), "text"), "rep").select("rep", "text")
    return settle(texts.mapInArrow(tidied(_set_reader(width)), "rep long, hashes binary"), "shingle-sets")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of `pairs(a, b)`, those that are links on full sets."""
    full = pairs.join(sets.select(F.col("rep").alias("a"), F.col("hashes").alias("x")), "a").join(
        sets.select(F.col("rep").alias("b"), F.col("hashes").alias("y")), "b"
    )
    return settle(full.select("a", "b", "x", "y").mapInArrow(tidied(_confirmer(percent)), "a long, b long"), "links")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, by products of incidence matrices over hashes two sets share."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times[column] > 1
    owner, column = owner[common], (np.cumsum(times > 1) - 1)[column[common]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), dtype=np.float32)
    step = 16384
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        low, high = np.searchsorted(column, (at, at + step))
        part = np.zeros((len(sets), step), dtype=np.float32)
        part[owner[low:high], column[low:high] - at] = 1
        total += part @ part.T
    return np.rint(total).astype(np.int64)


def _block_linker(percent: int, near: float):
    """Members of two blocks of a bucket → components that a link joins, each pair once in effect."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        left, part, n = (rows[c].to_numpy() for c in ("left", "part", "n"))
        sig = np.stack(rows["sig"].to_list()).view(np.uint64)
        unequal = np.zeros((len(rows), len(rows)), dtype=np.int64)
        for k in range(sig.shape[1]):
            x = sig[:, None, k] ^ sig[None, :, k]
            unequal += np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(int("01" * 32, 2)))
        chance = 1 / (1 << BITS)
        open_ = (1 - unequal / _HASHES - chance) / (1 - chance) >= near
        open_ &= 100 * np.minimum(n[:, None], n) >= percent * np.maximum(n[:, None], n)
        open_ &= (part[:, None] != part) & left[:, None] & ~left
        use = np.flatnonzero(open_.any(axis=0) | open_.any(axis=1))
        found: tuple[list[int], list[int]] = ([], [])
        if len(use):
            part, n = part[use], n[use]
            both = shared_counts([np.frombuffer(x, dtype=np.uint64) for x in rows["hashes"].iloc[use]])
            hit = open_[np.ix_(use, use)] & (100 * both >= percent * (n[:, None] + n - both))
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while (up := parent.get(x, x)) != x:
                    x = up
                return x

            for x, y in np.argwhere(hit):
                p, q = root(part[x]), root(part[y])
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    found[0].append(int(part[x]))
                    found[1].append(int(part[y]))
        return pd.DataFrame({"a": np.array(found[0], dtype=np.int64), "b": np.array(found[1], dtype=np.int64)})

    return run


def near_duplicate_rows(docs: DataFrame, carried: list[str], id_column: str, text_column: str, width: int, percent: int) -> DataFrame:
    """→ (doc, id, text, n_shingles, row, component_id, kept) for each row of `docs`: `doc` is a struct of the `carried`
    columns, `row` tells rows apart, the kept row of a component is the one least by id (null ids last) and then by `row`."""
    bound_batches(docs.sparkSession)
    base = docs.select(
        F.struct(*(column(c) for c in carried)).alias("doc"), column(id_column).cast("long").alias("id"), column(text_column).cast("string").alias("text")
    )
    sketch = base.mapInArrow(tidied(_sketcher(width)), T.StructType([*base.schema.fields, *_SKETCH]))
    rows = settle(sketch.withColumn("row", F.monotonically_increasing_id()), "sketch")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row"))
    classes = settle(
        rows.where("set_digest IS NOT NULL")
        .groupBy("set_digest")
        .agg(F.min("row").alias("rep"), first.alias("first"), F.first("n_shingles").alias("n"), F.first("signature").alias("sig"), F.first("bands").alias("bands")),
        "classes",
    )
    parts, merged = _links(rows, classes, width, percent)
    named = classes.select("set_digest", "rep", "first").join(parts, F.col("rep") == F.col("node"), "left").withColumn("part", F.coalesce("component", "rep"))
    if merged is not None:
        named = named.drop("component").join(merged, F.col("part") == F.col("old"), "left").withColumn("part", F.coalesce("new", "part"))
    named = settle(named.select("set_digest", "part", "first"), "parts")
    least = named.groupBy("part").agg(F.min("first").alias("stays"))
    named = named.join(least, "part").select("set_digest", "stays")
    columns = ["doc", "id", "text", "n_shingles", "row"]
    # joined on the digest; a class with many copies is split by AQE
    met = rows.where("set_digest IS NOT NULL").join(named, "set_digest").select(
        *columns, F.col("stays.id").alias("component_id"), (F.col("row") == F.col("stays.row")).alias("kept")
    )
    alone = rows.where("set_digest IS NULL").select(*columns, F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return met.union(alone)


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """→ one row per input row: doc_id, n_shingles, component_id, kept.

    Documents are linked when `100 * |A ∩ B| >= percent * |A ∪ B|` on their sets of `width`-word shingles (fewer words:
    the whole sequence is one shingle). Null and wordless texts have an empty set and are linked with nothing. The
    smallest id reachable names the component; rows with that id and a set in it are kept. Each row is a document of its own, so an id that
    repeats with different texts may lie in several components, and a row with a null id takes part; component_id is null where every id of a
    component is. Columns besides the two are ignored. Shingles are told apart by 64-bit hashes.
    """
    found = near_duplicate_rows(docs, [id_column], id_column, text_column, width, percent)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: one a component, see `near_duplicates`.

    It is the row least by id, null ids last; of rows equal in id just one stays. Rows without words all stay.
    """
    carried = [c for c in docs.columns if c != text_column] or [id_column]
    stay = near_duplicate_rows(docs, carried, id_column, text_column, width, percent).where("kept")
    kind = docs.schema[text_column].dataType
    return stay.select(*(F.col("text").cast(kind).alias(c) if c == text_column else F.col("doc").getField(c).alias(c) for c in docs.columns))


def _links(rows: DataFrame, classes: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """→ (node, component) of classes linked within their buckets' leaders, and (old, new) of components that other links join."""
    near = least_estimate(percent / 100)
    facts = classes.select("rep", "n", "sig")
    member = classes.select(F.explode("bands").alias("key"), "rep")
    several = member.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key")
    met = settle(member.join(several, "key"), "buckets")

    least = [F.min(F.struct(F.xxhash64("rep", F.lit(k)).alias("h"), F.col("rep")))["rep"] for k in range(LEADERS)]
    leaders = met.groupBy("key").agg(F.array_distinct(F.array(*least)).alias("leaders"))
    stars = met.join(leaders, "key").select("rep", F.explode("leaders").alias("leader")).where("rep <> leader")
    stars = stars.select(F.greatest("rep", "leader").alias("rep"), F.least("rep", "leader").alias("leader")).distinct()
    leader_facts = facts.select(F.col("rep").alias("leader"), F.col("n").alias("m"), F.col("sig").alias("other"))
    sizes = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    alike = stars.join(facts, "rep").join(leader_facts, "leader").where(sizes).select("rep", "leader", estimate("sig", "other").alias("guess"))
    alike = settle(alike.where(F.col("guess") >= near), "candidates")
    both = alike.union(alike.select(F.col("leader"), F.col("rep"), "guess"))
    order = Window.partitionBy("rep").orderBy(F.desc("guess"), "leader")
    best = both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= TRIED)
    tried = settle(best.select(F.greatest("rep", "leader").alias("a"), F.least("rep", "leader").alias("b")).distinct(), "tried")
    needed = tried.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    sets = _shingle_sets(rows, needed, width)
    links = _confirm(tried, sets, percent)
    parts = connected_components(links)
    discard(alike, tried, sets, links)

    placed = met.join(parts, met["rep"] == parts["node"], "left").select("key", "rep", F.coalesce("component", "rep").alias("part"))
    shares = placed.join(facts.select("rep", "n"), "rep").groupBy("key", "part").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"))
    blocks = lambda rows, shingles: F.ceil(F.greatest(rows / BLOCK_ROWS, shingles / BLOCK_SHINGLES)).cast("int")
    buckets = shares.groupBy("key").agg(
        F.count(F.lit(1)).alias("parts"),
        F.max(F.struct("rows", "part", "shingles")).alias("main"),
        F.sum("rows").alias("rows"),
        F.sum("shingles").alias("shingles"),
    )
    buckets = buckets.where("parts > 1").select(
        "key",
        F.col("main.part").alias("main"),
        blocks(F.col("rows") - F.col("main.rows"), F.col("shingles") - F.col("main.shingles")).alias("lefts"),
        blocks(F.col("rows"), F.col("shingles")).alias("rights"),
    )
    mixed, some = settle_counted(placed.join(buckets, "key").join(facts, "rep"), "mixed")
    if not some:
        return parts, None
    sets = _shingle_sets(rows, mixed.select("rep").distinct(), width)
    block = lambda count: F.pmod(F.xxhash64("rep"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    columns = ["key", "i", "j", "left", "rep", "n", "sig", "part"]
    apart = mixed.where("part <> main").withColumn("i", block("lefts")).withColumn("j", every("rights")).withColumn("left", F.lit(True))
    whole = mixed.withColumn("j", block("rights")).withColumn("i", every("lefts")).withColumn("left", F.lit(False))
    dealt = apart.select(*columns).union(whole.select(*columns)).join(sets, "rep")
    across, joined = settle_counted(dealt.groupBy("key", "i", "j").applyInPandas(_block_linker(percent, near), "a long, b long"), "across")
    if not joined:
        return parts, None
    merged = connected_components(across).select(F.col("node").alias("old"), F.col("component").alias("new"))
    discard(met, mixed, sets, across)
    return parts, merged
