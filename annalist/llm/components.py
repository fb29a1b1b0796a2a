"""Connected components of an edge table by local forests and contraction.

Each task turns the edges it sees into a forest: a row for each node and the root it has there. Nodes then gather their
roots, one from each task that met them, and take the least as their label; what is left is a graph of those roots that share a node, on
which the same is done. Order is that of a random permutation, another one each turn, so any graph shrinks by a
constant factor and a star of any size is gone at once. A hub meets no single task: tasks combine its edges first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.shared import discard, settle, settle_counted

#: A task holds about so many edges at once.
HELD = 2_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


def _shift(turn: int) -> np.ndarray:
    return np.array([(2 * turn + 1) * int(_STEP) % (1 << 64)], dtype=np.uint64)


def permuted(ids: np.ndarray, turn: int) -> np.ndarray:
    """Longs as other longs, one to one; another permutation each turn."""
    x = ids.astype(np.int64).view(np.uint64) + _shift(turn)
    x = (x ^ (x >> np.uint64(32))) * _STEP
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def restored(ids: np.ndarray, turn: int) -> np.ndarray:
    x = ids.astype(np.int64).view(np.uint64)
    x = (x ^ (x >> np.uint64(32))) * _BACK
    return ((x ^ (x >> np.uint64(32))) - _shift(turn)).view(np.int64)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the edges (a, b), and the least node of each one's component."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = places[: len(a)], places[len(a) :]
    label = np.arange(len(nodes))
    while True:
        p, q = label[x], label[y]
        if (p == q).all():
            return nodes, nodes[label]
        low = np.minimum(p, q)
        np.minimum.at(label, p, low)
        np.minimum.at(label, q, low)
        while (deeper := label[label]).tobytes() != label.tobytes():
            label = deeper


def _forester(turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = b = np.zeros(0, dtype=np.int64)
        for batch in batches:
            x, y = (permuted(batch.column(k).to_numpy(), turn) for k in (0, 1))
            a, b = np.concatenate([a, x]), np.concatenate([b, y])
            if len(a) > HELD:
                a, b = forest(a, b)
                if len(a) > HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                    a = b = np.zeros(0, dtype=np.int64)
        a, b = forest(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _restorer(turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [pa.array(restored(batch.column(k).to_numpy(), turn)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "component"])

    return run


def connected_components(edges: DataFrame, turn: int = 0, max_turns: int = 60) -> DataFrame:
    """`edges(a, b)` of longs → `(node, component)`: nodes have the same component where edges join them; which of its
    nodes names a component is arbitrary.

    Edges with a null end don't count; loops only register their node. Empty edges give an empty table.
    """
    if turn > max_turns:
        raise RuntimeError(f"components did not settle in {max_turns} turns")
    whole = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a IS NOT NULL AND b IS NOT NULL")
    # a node has at most one root for each task that met it
    roots = whole.mapInArrow(_forester(turn), "a long, b long").groupBy("a").agg(F.min("b").alias("low"), F.collect_set("b").alias("roots"))
    roots, open_ = settle_counted(roots, "roots", F.size("roots") > 1)
    named = roots.select(F.col("a").alias("node"), F.col("low").alias("component"))
    spent = [roots]
    if open_:
        live = settle(roots.where("size(roots) > 1").select(F.explode("roots").alias("a"), F.col("low").alias("b")).where("a <> b").distinct(), "live")
        deeper = connected_components(live, turn + 1, max_turns)
        named = named.join(deeper.select(F.col("node").alias("at"), F.col("component").alias("to")), F.col("component") == F.col("at"), "left")
        named = named.select("node", F.coalesce("to", "component").alias("component"))
        spent += [live, deeper]
    done = settle(named.mapInArrow(_restorer(turn), "node long, component long"), "components")
    discard(*spent)
    return done
