"""Document quality by random-indexing word vectors and a small network.

Every word owns a sparse ternary index vector given by its hash; the vector of a word is the sum of the index vectors of
the words next to it, counted over the whole corpus. Words share VECTORS rows by hash, so the table has a fixed size and is
gathered by one map-side combined sum. The units of a text are its words and their shapes (letter case, digits,
punctuation), both with a vector. A document is the mean of its units' unit vectors.

A two-layer network is fitted with numpy on a bounded sample of labelled documents, and its logit is divided by a
temperature fitted on a part of that sample the weights have not seen, so scores are calibrated probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalist.llm import wordhash
from annalist.llm.shared import bound_batches, column, in_slices, settle, tidied

VECTORS, DIM, NONZERO, REACH = 4096, 64, 4, 2
SHAPES = 512  # of the VECTORS rows, the first SHAPES belong to shapes
HIDDEN, EPOCHS, BATCH, RATE, SEED = 32, 60, 256, 3e-3, 7
#: At most so many labelled documents are fitted, those least by hash of their id.
SAMPLE = 20_000
FEATURES = 2 * DIM + 2

# fixed values: which class of character a byte is, for shapes
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_OTHER = np.zeros(256, bool)
_OTHER[33:48] = _OTHER[58:65] = _OTHER[91:97] = _OTHER[123:127] = True


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the NONZERO entries of every row's index vector."""
    seeds = wordhash.mix(np.arange(1, VECTORS * NONZERO + 1, dtype=np.uint64)).reshape(VECTORS, NONZERO)
    return (seeds % np.uint64(DIM)).astype(np.int64), np.where(seeds >> np.uint64(63), 1.0, -1.0)


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vector row of each word, of each word's shape, words per text) for texts at `offsets` in `data`."""
    starts, ends = wordhash.spans(data, offsets)
    per_text = np.diff(np.searchsorted(starts, offsets))
    hashes, _ = wordhash.word_hashes(data, offsets, lower=False)
    words = (hashes % np.uint64(VECTORS - SHAPES)).astype(np.int64) + SHAPES

    def count(kind: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, dtype=np.int32)
        np.cumsum(kind[data], out=sums[1:])
        return sums[ends] - sums[starts]

    upper, digit, other = count(_UPPER), count(_DIGIT), count(_OTHER)
    size = (ends - starts).astype(np.int64)
    last = data[ends - 1].astype(np.int64) if len(ends) else size
    mark = np.where(_OTHER[last], last, 0)
    case = np.where(upper == 0, 0, np.where(upper == 1, 1, np.where(2 * upper >= size, 3, 2)))
    code = ((np.minimum(other, 4) * 4 + case) * 2 + (digit > 0)) * 128 + mark
    shapes = (wordhash.mix(code.astype(np.uint64) + np.uint64(11)) % np.uint64(SHAPES)).astype(np.int64)
    return words, shapes, per_text


def _neighbour_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts → the task's sums of neighbours' index vectors, a row for each vector row that met any."""
    places, signs = _index_vectors()
    sums = np.zeros(VECTORS * DIM, dtype=np.int64)
    for batch in batches:
        for _, data, offsets in wordhash.text_blocks(batch.column(0)):
            words, shapes, per_text = units(data, offsets)
            text = np.repeat(np.arange(len(per_text)), per_text)
            for apart in range(1, REACH + 1):
                together = text[apart:] == text[:-apart]
                left, right = words[:-apart][together], words[apart:][together]
                left_shape, right_shape = shapes[:-apart][together], shapes[apart:][together]
                for of, near in ((left, right), (right, left), (left_shape, right_shape), (right_shape, left_shape)):
                    for k in range(NONZERO):
                        sums += np.bincount(of * DIM + places[near, k], weights=signs[near, k], minlength=VECTORS * DIM).astype(np.int64)
    table = sums.reshape(VECTORS, DIM)
    some = np.flatnonzero(table.any(axis=1))
    yield pa.RecordBatch.from_arrays(
        [pa.array(some, pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(table[some].ravel()), DIM).cast(pa.list_(pa.int64()))], names=["unit", "sums"]
    )


def word_vectors(texts: DataFrame) -> np.ndarray:
    """Unit vectors of the VECTORS rows, from all texts of a one-column table."""
    partial = texts.mapInArrow(tidied(_neighbour_sums), "unit int, sums array<bigint>")
    total = partial.groupBy("unit").agg(*(F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(DIM)))
    table = np.zeros((VECTORS, DIM))
    rows = total.toArrow()  # VECTORS rows at most; whole numbers, so any order gives the same sums
    for k in range(DIM):
        table[rows.column("unit").to_numpy(), k] = rows.column(f"s{k}").to_numpy()
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def features(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """A row for each text: mean word vector, mean shape vector, log of the word count, whether it has words."""
    out = np.zeros((len(texts), FEATURES), dtype=np.float32)
    for first, data, offsets in wordhash.text_blocks(texts):
        words, shapes, per_text = units(data, offsets)
        some = np.flatnonzero(per_text)
        if not len(some):
            continue
        starts = np.concatenate([[0], np.cumsum(per_text[some])[:-1]])
        for at, rows in ((0, words), (DIM, shapes)):
            out[first + some, at : at + DIM] = np.add.reduceat(vectors[rows], starts, axis=0) / per_text[some, None]
        out[first + some, 2 * DIM] = np.log1p(per_text[some]) / 5
        out[first + some, 2 * DIM + 1] = 1
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Network:
    """Adam on the log loss, a fifth held back to choose the temperature. One class only: a constant near its share."""
    rng = np.random.default_rng(SEED)
    y = y.astype(np.float64)
    mean, scale = (x.mean(axis=0, dtype=np.float64), x.std(axis=0, dtype=np.float64) + 1e-3) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    share = (y.sum() + 1) / (len(y) + 2)
    net = Network(mean, scale, rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(share / (1 - share))))
    if len(y) < 10 or y.min() == y.max():
        return net
    order = rng.permutation(len(y))
    check, train = order[: len(y) // 5], order[len(y) // 5 :]
    z = (x - mean.astype(np.float32)) / scale.astype(np.float32)
    params = [net.w1, net.b1, net.w2, np.array(net.b2)]
    m, v, turn = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS if len(train) > 2000 else 4 * EPOCHS):
        rng.shuffle(train)
        for at in range(0, len(train), BATCH):
            some = train[at : at + BATCH]
            given = z[some].astype(np.float64)
            hidden = np.tanh(given @ params[0] + params[1])
            slope = (1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3], -30, 30))) - y[some]) / len(some)
            back = np.outer(slope, params[2]) * (1 - hidden**2)
            grads = [given.T @ back + 1e-4 * params[0], back.sum(axis=0), hidden.T @ slope + 1e-4 * params[2], slope.sum()]
            turn += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                params[k] = params[k] - RATE * (m[k] / (1 - 0.9**turn)) / (np.sqrt(v[k] / (1 - 0.999**turn)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3])
    logits, truth = net.logit(x[check].astype(np.float64)), y[check]
    choices = np.geomspace(0.25, 8, 41)
    loss = [np.logaddexp(0, -np.where(truth > 0, 1, -1) * logits / t).mean() for t in choices]
    net.temperature = float(choices[int(np.argmin(loss))])
    return net


def held_out(id_column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 5 == 0, F.lit(False))


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", sample: int = SAMPLE
) -> tuple[np.ndarray, Network]:
    """Vectors from all texts, and a network fitted on at most `sample` labelled rows (see `score_quality`)."""
    bound_batches(docs.sparkSession)
    source = docs.select(column(id_column).cast("long").alias("doc_id"), column(text_column).cast("string").alias("text"))
    vectors = word_vectors(source.select("text"))
    known = labels.select(F.col(id_column).cast("long").alias("doc_id"), F.col(label_column).cast("int").alias("label")).where(
        "doc_id IS NOT NULL AND label IS NOT NULL"
    )
    known = known.where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = settle(known.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(sample), "label-sample")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(0), vectors)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, FEATURES, dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), flat], names=["doc_id", "label", "x"])

    taught = source.join(F.broadcast(chosen), "doc_id").select("text", "doc_id", "label")  # `sample` ids at most
    rows = taught.mapInArrow(tidied(featurise), "doc_id long, label int, x array<float>").toArrow()
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(-1, FEATURES)
    return vectors, fit(x[order], rows.column("label").to_numpy()[order] > 0)


def with_score(docs: DataFrame, vectors: np.ndarray, net: Network, text_column: str = "text") -> DataFrame:
    """The columns of `docs` as c0, c1 and so on, and the `score` of each row, without a shuffle."""
    text, kind = docs.columns.index(text_column), docs.schema[text_column].dataType

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = net.probability(features(batch.column(text).cast(pa.string()), vectors).astype(np.float64))
            yield from in_slices(pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, "score"]))

    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    if not isinstance(kind, T.StringType):
        plain = plain.withColumn(f"c{text}", F.col(f"c{text}").cast("string"))
    return plain.mapInArrow(tidied(score), T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())]))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of `docs` that score `threshold` or more, with all their columns and no other; see `score_quality`."""
    vectors, net = fit_quality(docs, labels, id_column, text_column)
    stay = with_score(docs, vectors, net, text_column).where(F.col("score") >= threshold).drop("score")
    return stay.select(*(F.col(c).cast(f.dataType) for c, f in zip(stay.columns, docs.schema.fields, strict=True))).toDF(*docs.columns)


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.3,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
    sample: int = SAMPLE,
) -> DataFrame:
    """→ one row per input row: doc_id, held_out, score (0 to 1), predicted (1 from `threshold` on).

    Labels are learnt only from ids whose CRC-32 modulo 5 is not 0, at most `sample` of them; rows with a null id or
    label teach nothing. Null and empty texts are scored like any other, and so is each row of a repeated id (the larger
    of its labels counts). Columns besides the two are ignored. Without usable labels every score is one half; an empty table gives no row.
    """
    vectors, net = fit_quality(docs, labels, id_column, text_column, label_column, sample)
    source = docs.select(column(id_column).cast("long").alias("doc_id"), column(text_column).cast("string").alias("text"))
    scored = with_score(source, vectors, net).withColumnRenamed("c0", "doc_id")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
