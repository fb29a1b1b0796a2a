"""Vectors as short codes: one codebook for each part of a vector, trained by filtering Lloyd rounds on integers.

Every task builds a kd-tree over each part of its blocks of vectors, with the bounding box, sum and count of every node, and
writes the trees to a table once. A round walks them from the root: an entry that is farther than another from all of a
node's box leaves the node, and a node with one entry left is assigned as a whole by its cached sum and count. What tasks give
back is a sum for each entry and component; the codebooks are all that the driver holds. All arithmetic is of integers and exact.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from annalist.llm.shared import column, settle

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Vectors of a tree, and about how many stand in a leaf.
BLOCK = 4096
LEAF = 16
_LIMB_BITS = 60


def _limit(d: int) -> int:
    """Components below this in size have exact distances in 64 bits."""
    return math.isqrt((2**63 - 1) // max(d, 1)) // 2


def scaled(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): as int64 where all are small enough, else as Python integers."""
    if not vectors.size or np.abs(vectors).max() < 2**31 / scale:
        return np.floor(vectors * scale).astype(np.int64)
    whole = [int(x) * scale if abs(x) >= 2**53 else math.floor(int(x) * scale + (x - int(x)) * scale) for x in vectors.ravel().tolist()]
    return np.array(whole, dtype=object).reshape(vectors.shape)


@dataclass
class Tree:
    """The points of one part in the order of their leaves, and by node, level by level, lows, highs and sums. Node j of
    level l holds the points [n*j >> l, n*(j+1) >> l)."""

    points: np.ndarray
    order: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray

    @staticmethod
    def depth(n: int) -> int:
        return max(0, math.ceil(math.log2(n / LEAF))) if n > LEAF else 0

    @staticmethod
    def build(points: np.ndarray) -> Tree:
        n, order = len(points), np.arange(len(points))
        depth = Tree.depth(n)
        for level in range(depth):
            starts = n * np.arange(1 << level) >> level
            own = points[order]
            widest = (np.maximum.reduceat(own, starts) - np.minimum.reduceat(own, starts)).argmax(1)
            node = np.repeat(np.arange(1 << level), np.diff(np.append(starts, n)))
            order = order[np.lexsort((own[np.arange(n), widest[node]], node))]
        own = points[order]
        levels = [n * np.arange(1 << level) >> level for level in range(depth + 1)]
        low, high, sums = (np.concatenate([f.reduceat(own, starts) for starts in levels]) for f in (np.minimum, np.maximum, np.add))
        return Tree(own, order, low, high, sums)

    def walk(self, codebook: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """→ the nearest entry of each point (in the tree's order), the lowest index of equals, and sums and counts of entries.

        `among`: the entries to choose from."""
        n, (k, d) = len(self.points), codebook.shape
        nearest, sums, counts = np.zeros(n, dtype=np.int8), np.zeros((k, d), dtype=np.int64), np.zeros(k, dtype=np.int64)
        index, nodes, left = np.arange(k), np.array([0]), among[None, :]
        depth = Tree.depth(n)
        for level in range(depth + 1):
            base = (1 << level) - 1
            low, high = self.low[base + nodes], self.high[base + nodes]
            middle = ((low + high)[:, None, :] / 2 - codebook[None]) ** 2
            best = np.where(left, middle.sum(2), np.inf).argmin(1)
            chosen = codebook[best]
            corner = np.where(codebook[None] > chosen[:, None], high[:, None], low[:, None])
            far, near = ((codebook[None] - corner) ** 2).sum(2), ((chosen[:, None] - corner) ** 2).sum(2)
            left = left & ~((far > near) | ((far == near) & (index[None] > best[:, None])))
            single = left.sum(1) == 1
            starts, ends = n * nodes >> level, n * (nodes + 1) >> level
            entry = left[single].argmax(1)
            np.add.at(sums, entry, self.sums[base + nodes[single]])
            np.add.at(counts, entry, (ends - starts)[single])
            for a, b, e in zip(starts[single].tolist(), ends[single].tolist(), entry.tolist(), strict=True):
                nearest[a:b] = e
            nodes, left, starts, ends = nodes[~single], left[~single], starts[~single], ends[~single]
            if level == depth:
                size = ends - starts
                rows = np.repeat(starts - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
                apart = ((self.points[rows][:, None] - codebook[None]) ** 2).sum(2)
                entry = np.where(np.repeat(left, size, axis=0), apart, np.iinfo(np.int64).max).argmin(1)
                nearest[rows] = entry
                np.add.at(sums, entry, self.points[rows])
                np.add.at(counts, entry, 1)
            nodes, left = np.concatenate([2 * nodes, 2 * nodes + 1]), np.concatenate([left, left])
        return nearest, sums, counts


def _plain_walk(points: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What `Tree.walk` gives, point by point in Python integers: for blocks whose distances pass 64 bits."""
    entries, nearest = codebook.tolist(), np.zeros(len(points), dtype=np.int8)
    sums, counts = np.zeros(codebook.shape, dtype=object), np.zeros(len(entries), dtype=np.int64)
    for row, point in enumerate(points.tolist()):
        apart = [sum((x - z) ** 2 for x, z in zip(point, entry, strict=True)) for entry in entries]
        nearest[row] = best = apart.index(min(apart))
        sums[best] += np.array(point, dtype=object)
        counts[best] += 1
    return nearest, sums, counts


def _tree_builder(parts: int, scale: int, labels: pa.DataType):
    """(vec_id, label, vector) → blocks: ids and labels, and for all parts the points, their order and the nodes' values."""

    def block(ids: pa.Array, kinds: pa.Array, vectors: np.ndarray) -> pa.RecordBatch:
        n, whole = len(vectors), scaled(vectors, scale)
        d = vectors.shape[1] // parts
        wide = whole.dtype == object or bool(whole.size and np.abs(whole).max() >= min(_limit(d), 2**31))
        split = [whole[:, p * d : (p + 1) * d] for p in range(parts)]
        trees = [] if wide else [Tree.build(x) for x in split]
        values = {
            "points": b"".join(t.points.astype("<i4").tobytes() for t in trees),
            "place": b"".join(t.order.astype("<i4").tobytes() for t in trees),
            "boxes": b"".join(np.stack([t.low, t.high]).astype("<i4").tobytes() for t in trees),
            "sums": b"".join(t.sums.astype("<i8").tobytes() for t in trees),
            "wide": ",".join(map(str, whole.ravel().tolist())) if wide else None,
        }
        lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), x) for x in (ids, kinds)]
        kinds_of = [pa.binary()] * 4 + [pa.string()]
        arrays = [*lists, pa.array([d], pa.int32())] + [pa.array([v], k) for v, k in zip(values.values(), kinds_of, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=["ids", "labels", "width", *values])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def blocks(every: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            table = pa.Table.from_batches(held).combine_chunks()
            while table.num_rows and (every or table.num_rows >= BLOCK):
                now, table = table.slice(0, BLOCK).combine_chunks(), table.slice(BLOCK)
                ids, kinds, vectors = (pa.concat_arrays(now.column(c).chunks) for c in range(3))
                yield block(ids, kinds.cast(labels), vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1))
            held, rows = table.to_batches(), table.num_rows

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BLOCK:
                yield from blocks(False)
        if rows:
            yield from blocks(True)

    return run


def _trees_of(row: dict, parts: int) -> list[Tree]:
    n, d = len(row["ids"]), row["width"]
    nodes = (2 << Tree.depth(n)) - 1
    points = np.frombuffer(row["points"], "<i4").reshape(parts, n, d).astype(np.int64)
    order = np.frombuffer(row["place"], "<i4").reshape(parts, n)
    boxes = np.frombuffer(row["boxes"], "<i4").reshape(parts, 2, nodes, d).astype(np.int64)
    sums = np.frombuffer(row["sums"], "<i8").reshape(parts, nodes, d)
    return [Tree(points[p], order[p], boxes[p, 0], boxes[p, 1], sums[p]) for p in range(parts)]


def _nearest_of(row: dict, codebooks: list[list[list[int]]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each part of a block: its points, their rows in the block, nearest entries, sums and counts."""
    parts, n, d = len(codebooks), len(row["ids"]), row["width"]
    limit = _limit(d)
    whole = None
    if row["wide"] is not None:
        whole = np.array([int(x) for x in row["wide"].split(",")], dtype=object).reshape(n, parts, d)
    trees = _trees_of(row, parts) if whole is None else []
    for p, codebook in enumerate(codebooks):
        exact = np.array(codebook, dtype=object).reshape(len(codebook), d)
        small = np.array([all(abs(x) < limit for x in entry) for entry in codebook])
        if whole is None and not small.all():
            small = _near_root(trees[p], exact, small)
        if whole is None and small is not None:
            codes = np.where(small[:, None], exact, 0).astype(np.int64)
            yield trees[p].points, trees[p].order, *trees[p].walk(codes, small)
        else:
            points = whole[:, p] if whole is not None else trees[p].points.astype(object)
            yield points, np.arange(n) if whole is not None else trees[p].order, *_plain_walk(points, exact)


def _near_root(tree: Tree, codebook: np.ndarray, small: np.ndarray) -> np.ndarray | None:
    """The small entries, if one of them beats every large one on the whole box of the root; else None."""
    low, high = ([int(x) for x in side[0]] for side in (tree.low, tree.high))
    for one in np.flatnonzero(small).tolist():
        beaten = True
        for other in np.flatnonzero(~small).tolist():
            corner = [h if z > c else w for w, h, z, c in zip(low, high, codebook[other], codebook[one], strict=True)]
            far, near = (sum((z - v) ** 2 for z, v in zip(codebook[e], corner, strict=True)) for e in (other, one))
            beaten = beaten and far > near
        if beaten:
            return small
    return None


def _limbs(value: int) -> list[tuple[int, int]]:
    """A number as (position, value) of 60 bits each; small ones have one."""
    sign, rest, out = (-1 if value < 0 else 1), abs(value), []
    while rest:
        out.append((len(out), sign * (rest & ((1 << _LIMB_BITS) - 1))))
        rest >>= _LIMB_BITS
    return out


def _summer(codebooks: list[list[list[int]]]):
    """Blocks → (part, entry, component, limb, value): a task's sums; component -1 is the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                for p, (_, _, _, sums, counts) in enumerate(_nearest_of(row, codebooks)):
                    have = total.get(p)
                    total[p] = (sums.astype(object) + have[0], counts + have[1]) if have else (sums.astype(object), counts)
        rows = [
            (p, e, i, limb, value)
            for p, (sums, counts) in total.items()
            for e in np.flatnonzero(counts).tolist()
            for i, number in enumerate([int(counts[e]), *map(int, sums[e])])
            for limb, value in _limbs(number)
        ]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.int32()] * 4 + [pa.int64()]
        names = ["part", "entry", "component", "limb", "value"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def _coder(codebooks: list[list[list[int]]], labels: pa.DataType):
    """Blocks → vec_id, label, code and error of every vector; an error beyond 64 bits is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, row in enumerate(batch.to_pylist()):
                n = len(row["ids"])
                codes, errors = np.zeros((n, len(codebooks)), dtype=np.int64), np.zeros(n, dtype=object)
                for p, (points, order, nearest, _, _) in enumerate(_nearest_of(row, codebooks)):
                    codes[order, p] = nearest
                    entries = np.array(codebooks[p], dtype=object)[nearest]
                    if points.dtype != object and all(abs(x) < _limit(points.shape[1]) for e in set(nearest.tolist()) for x in codebooks[p][e]):
                        entries = entries.astype(np.int64)
                    errors[order] += ((points - entries) ** 2).sum(1).astype(object)
                text = [bytes(c).hex() for c in codes.astype(np.uint8)]
                arrays = [
                    batch.column("ids")[at].values,
                    batch.column("labels")[at].values.cast(labels),
                    pa.array(text),
                    pa.array([e if e < 2**63 else None for e in errors.tolist()], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "label", "code", "error"])

    return run


def _usable(vector: Column, parts: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & (F.size(vector) % parts == 0) & finite


def train_codebooks(trees: DataFrame, codebooks: list[list[list[int]]], rounds: int = ROUNDS) -> list[list[list[int]]]:
    """Codebooks after `rounds` of assignment and replacement by componentwise floor(sum / count); unused entries stay."""
    for _ in range(rounds):
        sums = trees.mapInArrow(_summer(codebooks), "part int, entry int, component int, limb int, value long")
        totals = sums.groupBy("part", "entry", "component", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
        numbers: dict[tuple[int, int], dict[int, int]] = {}
        for part, entry, component, limb, value in totals.collect():  # as many as the codebooks have numbers
            own = numbers.setdefault((part, entry), {})
            own[component] = own.get(component, 0) + (int(value) << (_LIMB_BITS * limb))
        codebooks = [
            [[numbers[p, e].get(i + 1, 0) // numbers[p, e][0] for i in range(len(entry))] if (p, e) in numbers else entry for e, entry in enumerate(book)]
            for p, book in enumerate(codebooks)
        ]
    return codebooks


def encode_vectors(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> DataFrame:
    """→ vec_id, code, error, label_error and codebooks_sha256, a row for each vector that is kept.

    Left out are vectors that are null, hold null or non-finite components, are empty, or whose length `parts` does not
    divide or is not that of the kept vector with the smallest id. Codebooks start as the parts of the `entries` smallest
    ids (null ids last; of equal ids the smaller vector first), or of all if there are fewer. Null and repeated ids are
    coded as rows of their own, null labels are summed together, and other columns are not read. Components of any size
    count exactly; an error, or a label's sum of them, that passes 64 bits is null. A table without usable vectors gives no row.
    """
    if not 0 < entries <= 127:
        raise ValueError("entries has to be from 1 to 127")
    rows = vectors.select(
        column(id_column).cast("long").alias("vec_id"), column(label_column).alias("label"), column(vector_column).cast("array<double>").alias("vector")
    ).where(_usable(F.col("vector"), parts))
    order = [F.asc_nulls_last("vec_id"), "vector"]
    head = rows.orderBy(*order).select(F.size("vector")).first()
    length = head[0] if head else parts
    rows = rows.where(F.size("vector") == length)
    first = scaled(np.array([r["vector"] for r in rows.orderBy(*order).select("vector").limit(entries).collect()], dtype=np.float64).reshape(-1, length), scale).tolist()
    d = length // parts
    codebooks = [[entry[p * d : (p + 1) * d] for entry in first] for p in range(parts)]

    kind = rows.schema["label"].dataType
    arrow = to_arrow_type(kind)
    of_tree = T.StructType().add("ids", T.ArrayType(T.LongType())).add("labels", T.ArrayType(kind)).add("width", T.IntegerType())
    for name in ("points", "place", "boxes", "sums"):
        of_tree = of_tree.add(name, T.BinaryType())
    trees = settle(rows.mapInArrow(_tree_builder(parts, scale, arrow), of_tree.add("wide", T.StringType())), "vector-trees")

    if first:
        codebooks = train_codebooks(trees, codebooks, rounds)
    digest = hashlib.sha256(",".join(str(x) for book in codebooks for entry in book for x in entry).encode()).hexdigest()
    of_row = T.StructType().add("vec_id", T.LongType()).add("label", kind).add("code", T.StringType()).add("error", T.LongType())
    coded = settle(trees.mapInArrow(_coder(codebooks, arrow), of_row), "vector-codes")
    by_label = coded.groupBy(F.col("label").alias("own")).agg(
        F.when(F.count(F.lit(1)) == F.count("error"), F.sum(F.col("error").cast("decimal(38,0)"))).alias("total")
    )
    joined = coded.join(by_label.hint("merge"), coded["label"].eqNullSafe(by_label["own"]))
    return joined.select("vec_id", "code", "error", F.expr("try_cast(total AS BIGINT)").alias("label_error"), F.lit(digest).alias("codebooks_sha256"))

