"""Packing into windows of several context sizes: tiers that are powers of two, filled without padding.

Documents are cut at the largest window; what remains of each is routed to the smallest tier that holds it. From the largest
tier down, each window takes one piece of its tier and fills its gap with the longest pieces of shorter tiers that fit; where
none fits, a piece is cut and its rest goes back to the tier of its new length. The last tokens fill windows of ever smaller powers
of two. A plan is over counts of lengths: each step takes a pattern of lengths as often as it is available, so it is small and goes to
every task. Windows are numbered from the largest tier down and dealt over step groups in turn.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annalist.llm.packing import TEXTS_AT_ONCE, encoder_of
from annalist.llm.shared import column, settle

TIERS = (4096, 2048, 1024, 512, 256)
END_ID = 2
#: Tokens of a training step: how many windows a step group has follows from it.
STEP_TOKENS = 1 << 20
_START_BITS, _RANK_BITS = 13, 37


@dataclass
class TierPlan:
    """Slots: pieces of `length` with rank in [first, first + times) have their tokens [start, start + size) at `offset` of
    the windows `sequence`, `sequence` + 1, ..."""

    length: np.ndarray
    start: np.ndarray
    first: np.ndarray
    times: np.ndarray
    size: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    window: np.ndarray
    sequences: int
    groups: int

    def __post_init__(self) -> None:
        order = np.lexsort((self.first, self.start, self.length))
        for name in ("length", "start", "first", "times", "size", "sequence", "offset", "window"):
            setattr(self, name, getattr(self, name)[order])
        self._key = self._keys(self.length, self.start, self.first)

    @staticmethod
    def _keys(length: np.ndarray, start: np.ndarray, first: np.ndarray) -> np.ndarray:
        return (((length << _START_BITS) | start) << _RANK_BITS) | first

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """→ for each slot that the given pieces take: the piece's position in the input, the slot, and the sequence."""
        rows, start = np.arange(len(length)), np.zeros(len(length), dtype=np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(rows):
            slot = np.searchsorted(self._key, self._keys(length[rows], start, rank[rows]), side="right") - 1
            found.append((rows, slot, self.sequence[slot] + rank[rows] - self.first[slot]))
            start = start + self.size[slot]
            more = start < length[rows]
            rows, start = rows[more], start[more]
        piece, slot, sequence = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, dtype=np.int64) for k in range(3))
        order = np.lexsort((self.start[slot], piece))
        return piece[order], slot[order], sequence[order]


def plan_tiers(counts: np.ndarray, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> TierPlan:
    """Windows for `counts[l]` pieces of each length l up to the largest tier; see the module's docstring."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    #: Of each length: what is available, as [length of the piece, first rank, how many, start in the piece].
    stock = {int(v): deque([[int(v), 0, int(left[v]), 0]]) for v in np.flatnonzero(left)}
    slots: list[tuple[int, ...]] = []
    tokens, sequences = int((left * np.arange(len(left))).sum()), 0

    def give(window: int, lengths: list[int], last: int) -> None:
        """Take windows of these lengths, the last one cut to `last` tokens, as often as the first batch of each allows."""
        nonlocal tokens, sequences
        times = max(1, min(stock[v][0][2] // lengths.count(v) for v in set(lengths)))
        offset = 0
        for k, v in enumerate(lengths):
            piece = stock[v][0]
            size = last if k == len(lengths) - 1 else v
            slots.append((piece[0], piece[3], piece[1], times, size, sequences, offset, window))
            if size < v:
                stock.setdefault(v - size, deque()).append([piece[0], piece[1], times, piece[3] + size])
                left[v - size] += times
            piece[1] += times
            piece[2] -= times
            left[v] -= times
            if not piece[2]:
                stock[v].popleft()
            offset += size
        tokens -= times * window
        sequences += times

    def fill(window: int, longest: int) -> None:
        """One pattern of a window that begins with a piece of `longest` tokens."""
        lengths, gap, taken = [longest], window - longest, np.zeros(len(left), dtype=np.int64)
        taken[longest] = 1
        while gap > 0:
            free = np.flatnonzero(left[: gap + 1] > taken[: gap + 1])
            if not len(free):
                break
            v = int(free[-1])
            many = min(gap // v, int(left[v] - taken[v]))
            lengths += [v] * many
            taken[v] += many
            gap -= v * many
        if gap > 0:  # no piece fits: cut the shortest that is longer
            v = int(np.flatnonzero(left > taken)[0])
            give(window, [*lengths, v], gap)
        else:
            give(window, lengths, lengths[-1])

    def lead(window: int, longest: int) -> None:
        if longest > window:
            give(window, [longest], window)
        else:
            fill(window, longest)

    for tier, shorter in zip(tiers, [*tiers[1:], 0], strict=True):
        while tokens >= tier and (longest := int(np.flatnonzero(left)[-1])) > shorter:
            lead(tier, longest)
    while tokens:
        lead(1 << (tokens.bit_length() - 1), int(np.flatnonzero(left)[-1]))
    table = np.array(slots, dtype=np.int64).reshape(-1, 8)
    whole = int((counts * np.arange(len(counts))).sum())
    return TierPlan(*(table[:, k] for k in range(8)), sequences, max(1, -(-whole // step_tokens)))


def _cutter(path: str, largest: int):
    """(doc_id, text) → pieces of at most `largest` tokens with their ids, the task's number and the rank in it for the length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, seen = encoder_of(path), TaskContext.get().partitionId(), np.zeros(largest + 1, dtype=np.int64)
        width = 2 if len(encoder.ends) <= 1 << 16 else 4
        end = np.array([END_ID], dtype="<u4").tobytes()
        names = ["doc_id", "start", "length", "doc_tokens", "task", "rank", "ids"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for first in range(0, len(docs), TEXTS_AT_ONCE):
                out: list[list] = [[] for _ in names]
                texts = [x.as_py() or "" for x in batch.column(1)[first : first + TEXTS_AT_ONCE]]
                for doc, found in zip(docs[first : first + TEXTS_AT_ONCE], encoder.encode(texts), strict=True):
                    ids = np.frombuffer(found + end, dtype="<u4").astype(f"<u{width}")
                    for at in range(0, len(ids), largest):
                        part = ids[at : at + largest]
                        row = [doc, at, len(part), len(ids), task, int(seen[len(part)]), part.tobytes()]
                        seen[len(part)] += 1
                        for values, value in zip(out, row, strict=True):
                            values.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return run


def _placer(plan: TierPlan, keep_ids: bool):
    """Pieces with their rank in the whole table → the parts that go into windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank, start, tokens = (batch.column(c).to_numpy() for c in ("length", "rank", "start", "doc_tokens"))
            piece, slot, sequence = plan.place(length, rank)
            binary, ids, sums = batch.column("ids"), [], []
            held, own, width = -1, b"", 4
            for row, first, size in zip(piece.tolist(), plan.start[slot].tolist(), plan.size[slot].tolist(), strict=True):
                if row != held:
                    held, own = row, binary[row].as_py()
                    width = len(own) // int(length[row])
                part = np.frombuffer(own, dtype=f"<u{width}")[first : first + size].astype("<u4").tobytes()
                sums.append(zlib.crc32(part))
                if keep_ids:
                    ids.append(part)
            values = {
                "doc_id": batch.column("doc_id").take(pa.array(piece)),
                "start": pa.array(start[piece] + plan.start[slot]),
                "length": pa.array(plan.size[slot]),
                "ids_crc32": pa.array(sums, pa.int64()),
                "doc_tokens": pa.array(tokens[piece]),
                "sequence_id": pa.array(sequence),
                "offset": pa.array(plan.offset[slot]),
                "window": pa.array(plan.window[slot].astype(np.int32)),
                "step_group": pa.array(sequence % plan.groups),
            }
            if keep_ids:
                values["ids"] = pa.array(ids, pa.binary())
            yield pa.RecordBatch.from_arrays(list(values.values()), names=list(values))

    return run


def pack_tiers(
    docs: DataFrame,
    tokenizer_path: str,
    tiers: tuple[int, ...] = TIERS,
    id_column: str = "doc_id",
    text_column: str = "text",
    step_tokens: int = STEP_TOKENS,
    keep_ids: bool = False,
) -> DataFrame:
    """→ a row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, the tokens of its window (a power
    of two, always full), step_group (and `ids`, little-endian unsigned 32-bit, on demand).

    `tiers`: powers of two, descending, the largest at most 4096. A document is its token ids and one id END_ID; null text is empty (the end id alone).
    Ids are carried, not interpreted: rows with null and repeated ones are documents of their own. A document longer than the largest tier is
    cut at its multiples; others are cut only to fill a window. Step groups hold equally many windows of each tier, give or take one.
    Other columns are not read; an empty table gives no piece.
    """
    if list(tiers) != sorted(set(tiers), reverse=True) or any(t < 1 or t & (t - 1) for t in tiers) or not 1 <= tiers[0] < 1 << _START_BITS:
        raise ValueError("tiers have to be powers of two of at most 4096, the largest first")
    source = docs.select(column(id_column).cast("long").alias("doc_id"), column(text_column).cast("string").alias("text"))
    cut = "doc_id long, start long, length long, doc_tokens long, task int, rank long, ids binary"
    pieces = settle(source.mapInArrow(_cutter(tokenizer_path, tiers[0]), cut), "tier-pieces")

    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = settle(by_task.select("length", "task", "n", F.coalesce(before, F.lit(0)).alias("before")), "tier-ranks")
    counts = np.zeros(tiers[0] + 1, dtype=np.int64)
    for row in starts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row a length: at most 4,096
        counts[row["length"]] = row["n"]
    plan = plan_tiers(counts, tiers, step_tokens)

    ranked = pieces.join(starts.drop("n").hint("merge"), ["length", "task"]).select(
        "doc_id", "start", "length", "doc_tokens", "ids", (F.col("rank") + F.col("before")).alias("rank")
    )
    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window int, step_group long"
    return ranked.mapInArrow(_placer(plan, keep_ids), out + ", ids binary" * keep_ids)
