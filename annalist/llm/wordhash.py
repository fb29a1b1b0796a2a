"""Vectorised word and shingle hashing over the raw UTF-8 buffers of Arrow string columns.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z only, so they can be cut on bytes. A word's hash is a polynomial
over its bytes modulo 2^64, taken from prefix sums and finalised with a mixer, so a whole buffer is hashed by a handful
of numpy passes with no Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C55)  # odd, hence invertible modulo 2^64
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        have = _powers[str(base)] = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed hashes of the byte spans [start, end) of `data`."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(data * _power(_BASE, n), out=sums[1:])
    own = (sums[ends] - sums[starts]) * _power(_BASE_INVERSE, n + 1)[starts]
    return mix(own ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts that lie at `offsets` (n+1 of them) in `data`; no word crosses a text."""
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] |= word[edges]
    last[edges - 1] |= word[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def text_blocks(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about `most` bytes; nulls count as empty. A longer text is a run
    of its own."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True, window: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in text order, and how many each text has. Long buffers go in windows cut between words."""
    if lower:
        data = _LOWER[data]
    starts, ends = spans(data, offsets)
    per_text = np.diff(np.searchsorted(starts, offsets))
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(int(np.searchsorted(ends, base + window, side="right")), at + 1)
        out[at:to] = hash_spans(data[base : ends[to - 1]], starts[at:to] - base, ends[at:to] - base)
        at = to
    return out, per_text


def shingle_sets(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the `width`-word shingles of one text; with fewer words the whole sequence is one;
    without words the set is empty."""
    n = len(words)
    if n == 0:
        return words
    use = min(width, n)
    places = mix(np.arange(1, use + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    total = np.zeros(n - use + 1, dtype=np.uint64)
    for k in range(use):
        total += words[k : n - use + 1 + k] * places[k]
    return np.unique(mix(total ^ np.uint64(use)))
