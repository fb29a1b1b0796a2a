"""Near-duplicate embeddings by sorted projection passes.

Each pass concatenates the signs of its own random projections into a key and orders the vectors of a label by it; every
vector is compared, in double precision, with a bounded window of its successors, also across the borders of tasks.
Verified pairs of all passes are united into components, and the links within each component are counted exactly.

How many passes are enough depends on the vectors and on the size of their labels, so it is measured: a bounded sample of
vectors is compared with all rows, and further rounds of passes follow while more than MISSED of the sample's links lie
between components. If MOST_ROUNDS rounds don't do, all pairs of a label are compared by block pairs. Exact copies of a
vector are one class with a multiplicity throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.components import connected_components, forest
from annalist.llm.shared import column, discard, settle

PASSES, WINDOW, KEY_BITS, SEED = 24, 64, 48, 20240131
#: Share of the sample's links that may be missed, and rounds of passes before all pairs are compared.
MISSED, MOST_ROUNDS = 0.002, 4
#: Vectors in the sample and numbers in them, at most; vectors that a task compares in key order at once.
SAMPLE, SAMPLE_VALUES, RUN = 4096, 1 << 18, 1024
#: Numbers in the vectors of one block, about, and rows compared at once.
BLOCK_VALUES, STRIP = 1 << 19, 512


def _planes(dimension: int, passes: int, turn: int) -> np.ndarray:
    return np.random.default_rng([SEED, dimension, turn]).standard_normal((dimension, passes * KEY_BITS))


def _keyer(passes: int, turn: int):
    """(rep, label, embedding) → one row a pass: pass, label, dim, key, rep."""
    planes: dict[int, np.ndarray] = {}
    weights = (1 << np.arange(KEY_BITS - 1, -1, -1, dtype=np.int64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            dims = rows["embedding"].map(len)
            for dim, part in rows.groupby(dims):
                if dim not in planes:
                    planes[dim] = _planes(dim, passes, turn)
                for at in range(0, len(part), 2000):
                    some = part.iloc[at : at + 2000]
                    x = np.stack(some["embedding"].to_numpy()).astype(np.float64)
                    keys = ((x @ planes[dim]) > 0).reshape(len(x), passes, KEY_BITS) @ weights
                    out = some[["rep", "label"]].loc[some.index.repeat(passes)].copy()
                    out["pass"] = np.tile(np.arange(passes, dtype=np.int32), len(some))
                    out["dim"] = np.int32(dim)
                    out["key"] = keys.ravel()
                    yield out[["pass", "label", "dim", "key", "rep"]]

    return run


def _unit(vectors) -> np.ndarray:
    x = np.stack(list(vectors)).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components would overflow or vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pd.DataFrame]:
    """Runs of rows with equal keys, of rows sorted by them, whole across batches."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        rows = batch.to_pandas()
        if not len(rows):
            continue
        of = rows[list(keys)].to_numpy()
        cuts = np.flatnonzero((of[1:] != of[:-1]).any(axis=1)) + 1
        edges = [0, *cuts.tolist(), len(rows)]
        if held and (held[-1][list(keys)].to_numpy()[-1] != of[0]).any():
            yield pd.concat(held, ignore_index=True)
            held = []
        for start, stop in zip(edges[:-1], edges[1:], strict=True):
            if start and held:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(rows.iloc[start:stop])
    if held:
        yield pd.concat(held, ignore_index=True)


def _scanner(threshold: float, window: int):
    """Runs of RUN rows in key order and the `window` rows behind them → a spanning forest of each run's verified pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "run"):
            # equal values of pass, label and length are one stretch; labels are told apart by where they change, whatever their type
            marks = rows[["pass", "label", "dim"]]
            stretch = (marks != marks.shift()).any(axis=1).to_numpy().cumsum()
            own, reps = (rows["place"] // RUN == rows["run"]).to_numpy(), rows["rep"].to_numpy()
            a, b = [], []
            for s in np.unique(stretch[own]):
                at = np.flatnonzero(stretch == s)
                if len(at) < 2:
                    continue
                x, rep, n = _unit(rows["embedding"].iloc[at]), reps[at], int(own[at].sum())
                for k in range(0, n, window):
                    hit = np.argwhere(x[k : min(k + window, n)] @ x[k : k + 2 * window].T >= threshold)
                    hit = hit[(hit[:, 1] > hit[:, 0]) & (hit[:, 1] - hit[:, 0] <= window)]
                    a.append(rep[k + hit[:, 0]])
                    b.append(rep[k + hit[:, 1]])
            if a and len(a := np.concatenate(a)):
                nodes, roots = forest(a, np.concatenate(b))
                apart = nodes != roots
                yield pa.RecordBatch.from_arrays([pa.array(nodes[apart], pa.int64()), pa.array(roots[apart], pa.int64())], names=["a", "b"])

    return run


def _misser(threshold: float, sample: dict):
    """(rep, label, dim, embedding, part) → links with the sample's vectors of the same label and length, and how many lie between parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = missed = 0
        for batch in batches:
            for key, rows in batch.to_pandas().groupby(["label", "dim"]):
                if key not in sample:
                    continue
                reps, parts, x = sample[key]
                for at in range(0, len(rows), STRIP):
                    some = rows.iloc[at : at + STRIP]
                    hit = _unit(some["embedding"]) @ x.T >= threshold
                    hit &= some["rep"].to_numpy()[:, None] != reps
                    links += int(hit.sum())
                    missed += int((hit & (some["part"].to_numpy()[:, None] != parts)).sum())
        yield pa.RecordBatch.from_arrays([pa.array([links]), pa.array([missed])], names=["links", "missed"])

    return run


def _counter(threshold: float):
    """Block pairs of a pool: (rep, n), with how many rows (by multiplicity) each representative is linked, and
    (part, n null, other) for links between components, no more than join what was apart."""

    def counted(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = rows["i"].iat[0], rows["j"].iat[0]
        x, rep, mult, part, block = _unit(rows["embedding"]), *(rows[c].to_numpy() for c in ("rep", "mult", "part", "block"))
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        n = np.zeros(len(rows), dtype=np.int64)
        parent: dict[int, int] = {}
        joined: tuple[list[int], list[int]] = ([], [])

        def root(p: int) -> int:
            while (up := parent.get(p, p)) != p:
                parent[p] = p = parent.get(up, up)
            return p

        y = x[right]
        for at in range(0, len(left), STRIP):
            some = left[at : at + STRIP]
            hit = (x[some] @ y.T) >= threshold
            if i == j:
                hit[np.arange(len(some)), at + np.arange(len(some))] = False
            n[some] += hit @ mult[right]
            if i != j:
                n[right] += hit.T @ mult[some]
            a, b = np.nonzero(hit)
            a, b = part[some[a]], part[right[b]]
            for p, q in np.unique(np.stack([a, b], axis=1)[a != b], axis=0).tolist():
                p, q = root(p), root(q)
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    joined[0].append(p)
                    joined[1].append(q)
        linked = n > 0
        counts = pd.DataFrame({"rep": rep[linked], "n": pd.array(n[linked], "Int64"), "other": pd.array([None] * int(linked.sum()), "Int64")})
        links = pd.DataFrame({"rep": np.array(joined[0], dtype=np.int64), "n": pd.array([None] * len(joined[0]), "Int64"), "other": pd.array(joined[1], "Int64")})
        return pd.concat([counts, links]) if len(links) else counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("other", pa.int64())])
        held, size = [], 0
        for rows in _runs(batches, "pool", "i", "j"):
            held.append(counted(rows))
            size += len(held[-1])
            if size >= 10_000:
                yield pa.RecordBatch.from_pandas(pd.concat(held), schema, preserve_index=False)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pandas(pd.concat(held), schema, preserve_index=False)

    return run


def _window_links(reps: DataFrame, threshold: float, passes: int, window: int, turn: int) -> DataFrame:
    """Verified pairs of a round of passes, those of each run of rows as a forest (a, b)."""
    spark = reps.sparkSession
    keyed = reps.select("rep", "label", "embedding").mapInPandas(_keyer(passes, turn), f"pass int, label {reps.schema['label'].dataType.simpleString()}, dim int, key long, rep long")
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ("pass", "label", "dim", "key", "rep")
    ordered = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # only keys are sorted; the id holds the task and the place in it, so places over all tasks follow from a count for each task
    ordered = settle(ordered.select("pass", "label", "dim", "rep", F.monotonically_increasing_id().alias("id")), "vector-order")
    task = F.shiftright("id", 33)
    sizes = sorted((r["task"], r["n"]) for r in ordered.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n")).collect())
    before = spark.createDataFrame([(k, sum(n for _, n in sizes[:at])) for at, (k, _) in enumerate(sizes)], "task long, before long")
    placed = ordered.withColumn("task", task).join(F.broadcast(before), "task").withColumn("place", F.col("before") + F.col("id").bitwiseAND((1 << 33) - 1))
    run = F.floor(F.col("place") / RUN)
    behind = F.array_distinct(F.array(run, F.floor(F.greatest(F.col("place") - window, F.lit(0)) / RUN)))
    placed = placed.select("pass", "label", "dim", "rep", "place", F.explode(behind).alias("run"))
    met = placed.join(reps.select("rep", "embedding"), "rep").repartition(parts, "run").sortWithinPartitions("run", "place")
    links = settle(met.select("run", "place", "pass", "label", "dim", "rep", "embedding").mapInArrow(_scanner(threshold, window), "a long, b long"), "vector-links")
    discard(ordered)
    return links


def _missed_share(placed: DataFrame, threshold: float) -> float:
    """The share of links between a bounded sample of vectors and all others that lie between parts."""
    longest = placed.agg(F.max("dim").alias("n")).first()["n"]
    if not longest:
        return 0.0
    most = max(1, min(SAMPLE, SAMPLE_VALUES // longest))
    sample: dict = {}
    for r in placed.orderBy(F.xxhash64("rep"), "rep").limit(most).select("rep", "label", "dim", "embedding", "part").collect():
        sample.setdefault((r["label"], r["dim"]), []).append(r)
    held = {k: (np.array([r["rep"] for r in v]), np.array([r["part"] for r in v]), _unit([r["embedding"] for r in v])) for k, v in sample.items()}
    found = placed.select("rep", "label", "dim", "embedding", "part").mapInArrow(_misser(threshold, held), "links long, missed long")
    totals = found.agg(F.sum("links").alias("links"), F.sum("missed").alias("missed")).first()
    return (totals["missed"] or 0) / max(1, totals["links"] or 0)


def near_duplicate_vectors(
    vectors: DataFrame,
    threshold: float = 0.93,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    passes: int = PASSES,
    window: int = WINDOW,
) -> DataFrame:
    """→ one row per input row: vec_id, n_links, component_id, kept.

    Rows are compared only when their labels are equal and not null and their vectors have the same length. A vector
    that is null, empty or zero, or holds a null or non-finite component, links with nothing. Rows of a repeated id
    count as separate vectors; rows with a null id link with nothing. Other columns are ignored; an empty table gives no row. Links between vectors that no window brought
    into one component are missed: at most about MISSED of them by the sample's measure, none where the sample holds all vectors. `kept` marks the row whose id is its component's smallest.
    """
    kind = "array<float>" if vectors.schema[vector_column].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(
        column(id_column).cast("long").alias("vec_id"),
        column(label_column).alias("label"),
        column(vector_column).cast(kind).alias("embedding"),
    )
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    sane = F.coalesce(finite & (F.size("embedding") > 0) & F.exists("embedding", lambda v: v != 0), F.lit(False))
    rows = settle(
        rows.withColumn("valid", sane & F.col("label").isNotNull() & F.col("vec_id").isNotNull()).withColumn(
            "same", F.when(F.col("valid"), F.sha2(F.concat_ws(" ", F.col("label").cast("string"), F.array_join(F.col("embedding").cast("array<string>"), ",")), 256))
        ),
        "vectors",
    )
    reps = settle(
        rows.where("valid")
        .groupBy("same")
        .agg(F.min("vec_id").alias("min_id"), F.count(F.lit(1)).alias("mult"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
        # an id that repeats with different vectors is one node of the graph but several classes: classes get numbers of their own
        .withColumn("rep", F.monotonically_increasing_id())
        .withColumn("dim", F.size("embedding")),
        "vector-classes",
    )

    links = None
    for turn in range(MOST_ROUNDS):
        more = _window_links(reps, threshold, passes, window, turn)
        links = more if links is None else links.union(more)
        component = connected_components(links)
        placed = reps.join(component, reps["rep"] == component["node"], "left")
        placed = settle(placed.select("rep", "min_id", "mult", "label", "dim", "embedding", F.coalesce("component", "rep").alias("part")), "vector-parts")
        if enough := _missed_share(placed, threshold) <= MISSED:
            break
        if turn + 1 < MOST_ROUNDS:
            discard(placed)
    if enough:
        pooled = placed.withColumn("pool", F.col("part"))
    else:
        pools = placed.groupBy("label", "dim").agg(F.min("rep").alias("pool"))
        pooled = placed.join(pools, ["label", "dim"])
    sizes = pooled.groupBy("pool", "dim").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = sizes.select("pool", F.ceil(F.col("n") * F.col("dim") / F.lit(BLOCK_VALUES)).cast("int").alias("blocks"))
    blocked = pooled.join(sizes, "pool").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    pairs = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "pool", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "mult", "part", "embedding"
    )
    # dealt by block pair, as the join's own dealing by pool would leave all pairs of a pool in one task
    parts = max(2, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = pairs.repartition(parts, "pool", "i", "j").sortWithinPartitions("pool", "i", "j")
    met = settle(pairs.mapInArrow(_counter(threshold), "rep long, n long, other long"), "vector-counts")
    counted = met.where("n IS NOT NULL").groupBy("rep").agg(F.sum("n").alias("n"))
    whole = placed.select("rep", "min_id", F.col("part").alias("component"))
    if not enough:
        apart = met.where("n IS NULL").select(F.col("rep").alias("a"), F.col("other").alias("b"))
        merged = connected_components(apart).select("node", F.col("component").alias("joined"))
        whole = whole.join(merged, whole["component"] == merged["node"], "left").select("rep", "min_id", F.coalesce("joined", "component").alias("component"))
    named = whole.groupBy("component").agg(F.min("min_id").alias("component_id"))
    linked = whole.join(named, "component").select("rep", "component_id").join(counted, "rep")
    facts = settle(
        reps.select("same", "rep", "mult", "min_id").join(linked, "rep", "left").select(
            "same", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component_id", "min_id").alias("component_id")
        ),
        "vector-facts",
    )
    out = rows.where("valid").select("vec_id", "same").join(facts, "same").select("vec_id", "n_links", "component_id")
    out = out.union(rows.where("NOT valid").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
