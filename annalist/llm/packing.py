"""Best-fit packing of tokenised documents into fixed-length sequences by exact-complement hashing.

Planning needs only how many pieces there are of each length (at most `capacity` numbers). From the longest length
down, the gap a piece leaves is looked up in the index of single, pair and triple length sums; a combination that fills
it exactly is consumed as often as its lengths are available. What no exact combination completes goes into best-fit
bins. Every consumption exhausts a length, so a plan has O(capacity) patterns whatever the corpus size, and is small
enough to ship to every task. Pieces then find their places by rank within their length, from per-task counts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annalist.llm.shared import bound_batches, column, kept, settle, tidied

CAPACITY = 2048
END_ID = 0
#: Word ids remembered by a process; when full, words met again stay.
WORDS_HELD = 600_000
TEXTS_AT_ONCE = 512
#: Bytes of text encoded at once, or one text: the more, the less often a word is looked up.
BYTES_AT_ONCE = 8 << 20


class WordEncoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, equal to the tokenizer's own.

    The vocabulary never merges across white space, and normalises nothing across it either, so a text's ids are those of
    its words in a row. A word is asked for once as long as it is remembered. Words of plain Latin letters (with
    punctuation after them, which is a token run of its own) are asked for many at a time as one text, whose ids part
    where a token ends a word; all other words one by one. Texts with strings of special tokens go to the tokenizer whole.
    """

    _SPECIAL = "<|"
    #: A word a line: letters and the punctuation after them, or anything else.
    _LINES = re.compile(r"^(?:([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)|(.*))$", re.MULTILINE)

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # words are remembered here; its own memory of 10,000 costs more than it saves
        self.known: dict[bytes, bytes] = {}
        self.again: set[bytes] = set()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _ask(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _ask_letters(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of plain letters."""
        if not words:
            return {}
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        edges = np.flatnonzero(self.ends[ids]) + 1
        if len(edges) != len(words):
            return {w: self._ask(w) for w in words}
        data, at = ids.tobytes(), [0, *(4 * edges).tolist()]
        return {w: data[at[i] : at[i + 1]] for i, w in enumerate(words)}

    def learn(self, ordered: list[bytes]) -> None:
        if not ordered:
            return
        parts = self._LINES.findall(b"\n".join(ordered).decode())
        ids = self._ask_letters(list({body for body, _, _ in parts if body}))
        marks = {m: self._ask(m) if m else b"" for m in {m for _, m, _ in parts}}
        self.known.update((word, ids[body] + marks[mark] if body else self._ask(other)) for word, (body, mark, other) in zip(ordered, parts, strict=True))

    def _look_up(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words. When the memory is full, words met again since they were learned stay in it."""
        parts = list(map(self.known.get, words))
        new = [w for w, part in zip(words, parts, strict=True) if part is None]
        if new and len(self.known) + len(new) > WORDS_HELD:
            kept = self.again if len(self.again) + len(new) <= WORDS_HELD else ()
            self.known, self.again = {w: self.known[w] for w in kept}, set()
        elif len(new) < len(words):
            self.again.update(words)
            self.again.difference_update(new)
        if not new:
            return parts
        self.learn(new)
        return [self.known[w] if part is None else part for w, part in zip(words, parts, strict=True)]

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Words are numbered by Arrow, so a word is looked up once a call however often the texts hold it."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        special = pc.match_substring(texts, self._SPECIAL)
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.if_else(special, "", texts)))
        at = lists.offsets.to_numpy()
        coded = lists.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
        words, number = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        parts = self._look_up(words)
        ids, size = np.frombuffer(b"".join(parts), dtype="<u4"), np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
        # the ids of each word's place: from where its word's ids begin, less what stands before the place, counted on
        many = size[number]
        stop = np.concatenate([[0], np.cumsum(many)])
        out = ids[np.repeat((np.cumsum(size) - size)[number] - stop[:-1], many) + np.arange(stop[-1])]
        ends = stop[at - at[0]]
        data, cuts = out.tobytes(), (4 * ends).tolist()
        whole = special.to_pylist()
        return [self._ask(texts[k].as_py()) if whole[k] else data[cuts[k] : cuts[k + 1]] for k in range(len(texts))]


def encoder_of(path: str) -> WordEncoder:
    """The encoder of this process: a worker that runs several tasks loads the vocabulary once, until tasks of another kind come."""
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]


def _stretches(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """From where to where the rows go that are encoded at once."""
    stop = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(stop):
        last = max(first + 1, int(np.searchsorted(stop, BYTES_AT_ONCE + (stop[first - 1] if first else 0), side="right")))
        yield first, last
        first = last


def _cutter(path: str, capacity: int, keep_ids: bool):
    """(doc_id, text) → the pieces of each document, with the task's number and the piece's rank in it for its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, seen = encoder_of(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        end = np.array([END_ID], dtype="<u4").tobytes()
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"] + ["ids"] * keep_ids
        for batch in batches:
            out: list[list] = [[] for _ in names]
            docs = batch.column(0).to_pylist()
            texts = batch.column(1).fill_null("")
            for first, last in _stretches(texts):
                for doc, ids in zip(docs[first:last], encoder.encode(texts.slice(first, last - first)), strict=True):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        n = len(part) // 4
                        row = [doc, piece, at // 4, n, zlib.crc32(part), task, int(seen[n])] + [part] * keep_ids
                        seen[n] += 1
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * keep_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return run


@dataclass
class Plan:
    """Slots by length: pieces of length `l` with rank in [first, first + times) take a place in `times` sequences that
    begin at `sequence` (one more for each next rank, `times` of them), at `offset`."""

    length: np.ndarray
    first: np.ndarray
    times: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def __post_init__(self) -> None:
        order = np.lexsort((self.first, self.length))
        for name in ("length", "first", "times", "sequence", "offset"):
            setattr(self, name, getattr(self, name)[order])
        self._key = self.length.astype(np.int64) * (1 << 48) + self.first

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = np.searchsorted(self._key, length * (1 << 48) + rank, side="right") - 1
        return self.sequence[slot] + rank - self.first[slot], self.offset[slot]


class SumIndex:
    """For every sum up to the capacity, how many ordered pairs and triples of the available lengths make it.

    A length that is used up leaves the index: with H the available lengths as a polynomial, H^2 and H^3 count pairs and
    triples, and what the term x^v takes from them is known from the powers that remain.
    """

    def __init__(self, left: np.ndarray):
        self.single = (left > 0).astype(np.int64)
        self.single[0] = 0
        size = len(left)
        self.pairs = np.convolve(self.single, self.single)[:size]
        self.triples = np.convolve(self.pairs, self.single)[:size]

    def remove(self, length: int) -> None:
        size = len(self.single)

        def behind(counts: np.ndarray, by: int) -> np.ndarray:
            out = np.zeros(size, dtype=np.int64)
            if by < size:
                out[by:] = counts[: size - by]
            return out

        one = np.zeros(size, dtype=np.int64)
        one[0] = 1
        self.single[length] = 0
        self.pairs -= 2 * behind(self.single, length) + behind(one, 2 * length)
        self.triples -= 3 * behind(self.pairs, length) + 3 * behind(self.single, 2 * length) + behind(one, 3 * length)


def _complement(left: np.ndarray, index: SumIndex, gap: int) -> tuple[int, ...]:
    """Lengths that fill `gap` exactly: one, else two, else three, the longest first; () if there are none. The index tells
    whether any lengths make the sum, `left` whether there are enough of each."""
    if left[gap]:
        return (gap,)

    def pair(total: int, below: int) -> tuple[int, int] | None:
        big = np.arange(min(below, total - 1), (total - 1) // 2, -1)
        ok = (left[big] > 0) & (left[total - big] > 0)
        if total % 2 == 0 and len(big) and big[-1] * 2 == total:
            ok[-1] = left[total // 2] > 1
        at = np.flatnonzero(ok)
        return (int(big[at[0]]), int(total - big[at[0]])) if len(at) else None

    if index.pairs[gap] and (got := pair(gap, gap)):
        return got
    if index.triples[gap]:
        firsts = np.arange(max(gap - 2, 0), -(-gap // 3) - 1, -1)
        for big in firsts[(left[firsts] > 0) & (index.pairs[gap - firsts] > 0)].tolist():
            got = pair(gap - big, big)
            if got and all(left[v] >= (big, *got).count(v) for v in {big, *got}):
                return (big, *got)
    return ()


def plan_packing(counts: np.ndarray, capacity: int) -> Plan:
    """Pack `counts[l]` pieces of each length l into sequences of `capacity`; see the module's docstring."""
    left, used = counts.astype(np.int64).copy(), np.zeros(capacity + 1, dtype=np.int64)
    index = SumIndex(left)
    slots: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def consume(lengths: tuple[int, ...] | list[int]) -> None:
        nonlocal sequences
        times = min(int(left[v]) // lengths.count(v) for v in set(lengths))
        offset = 0
        for v in lengths:
            slots.append((v, int(used[v]), times, sequences, offset))
            used[v] += times
            left[v] -= times
            offset += v
        for v in set(lengths):
            if not left[v] and index.single[v]:
                index.remove(v)
        sequences += times

    if left[capacity]:
        consume([capacity])
    for longest in range(capacity - 1, 0, -1):
        while left[longest]:
            left[longest] -= 1
            rest = _complement(left, index, capacity - longest)
            left[longest] += 1
            if not rest:
                break
            consume((longest, *rest))
    while (some := np.flatnonzero(left)).size:
        bin_, gap = [], capacity
        taken = np.zeros(capacity + 1, dtype=np.int64)
        while gap:
            fits = some[some <= gap]
            fits = fits[left[fits] > taken[fits]]
            if not len(fits):
                break
            best = int(fits[-1])
            many = min(gap // best, int(left[best] - taken[best]))
            bin_ += [best] * many
            taken[best] += many
            gap -= best * many
        consume(bin_)
    table = np.array(slots, dtype=np.int64).reshape(-1, 5)
    return Plan(*(table[:, k] for k in range(5)), sequences)


def _placer(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            length, rank = (batch.column(at(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = plan.place(length, rank)
            arrays = [batch.column(k) for k in range(batch.num_columns - 1)] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return run


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """→ one row per piece: doc_id, piece, start, length, ids_crc32 (and `ids`, bytes, on demand), sequence_id, offset.

    A document is its token ids and one id END_ID; only documents longer than `capacity` are cut. Null text is empty
    (its piece is the end id alone). Ids are carried, not interpreted: null and repeated ones are packed as rows of
    their own. An empty table gives no piece.
    """
    bound_batches(docs.sparkSession)
    stay = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    cut = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long" + ", ids binary" * keep_ids
    source = docs.select(column(id_column).cast("long").alias("doc_id"), column(text_column).cast("string").alias("text"))
    pieces = settle(source.mapInArrow(tidied(_cutter(tokenizer_path, capacity, keep_ids), keeps=tokenizer_path), cut), "pieces")

    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = settle(by_task.select("length", "task", "n", F.coalesce(before, F.lit(0)).alias("before")), "piece-ranks")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in starts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[row["length"]] = row["n"]
    plan = plan_packing(counts, capacity)

    ranked = pieces.join(starts.drop("n"), ["length", "task"]).select(*stay, (F.col("rank") + F.col("before")).alias("rank"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids + ", sequence_id long, offset long"
    return ranked.mapInArrow(_placer(plan), schema)
