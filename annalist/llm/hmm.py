"""A hidden Markov language model trained by Baum-Welch over the whole corpus.

Latent states emit word classes; a class emits its word. The OWN most frequent words and the end of a text are classes of
one word each; the other words share classes by the hash of their last bytes, so a word's class needs no table. Within a class a
word has its share of the training tokens, less what the class's words seen once predict for words never seen.

Training: every task turns the expected counts of its texts into rows, Spark sums them, the driver re-estimates. Counts
are whole numbers of 1/UNIT, so sums don't depend on order. Training sequences are stretches of up to STRETCH tokens;
scoring runs the scaled forward recursion over each text whole, which gives its exact likelihood.

Counts of at most COMMON most frequent words travel with the tasks (a fixed bound); tokens of all other words are joined with
the vocabulary table by word.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.shared import settle

STATES, ROUNDS, STRETCH = 12, 6, 256
OWN, SUFFIXES, SUFFIX_BYTES = 1500, 512, 3
COMMON = 1 << 17
CLASSES = 1 + OWN + SUFFIXES  # class 0 is the end
#: Classes that start the training: the most frequent words, and the suffix classes folded.
COARSE_OWN, COARSE_SUFFIXES, NEAR = 191, 64, 4
COARSE = 1 + COARSE_OWN + COARSE_SUFFIXES
UNIT, SEED = 1024, 13
_WORDS_HELD = 300_000


def _words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z: on bytes, split() and lower() do just that."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

    for batch in batches:
        for text in batch.column(0):
            counts.update(_words(text.as_py()))
            if len(counts) > _WORDS_HELD:
                yield rows()
                counts.clear()
    if counts:
        yield rows()


@dataclass
class Lexicon:
    """What a task needs to encode texts; bounded by COMMON and CLASSES."""

    common: dict[bytes, int]  # word → place by falling count
    counts: np.ndarray  # of the common words
    tokens: int  # N
    distinct: int  # V
    ends: int
    class_tokens: np.ndarray  # of each class
    unseen: np.ndarray  # share of a class left to words never seen

    def classes(self) -> np.ndarray:
        """Class of each common word."""
        out = np.array([1 + OWN + zlib.crc32(w[-SUFFIX_BYTES:]) % SUFFIXES for w in self.common] or [0], dtype=np.int64)
        out[:OWN] = np.arange(1, OWN + 1)[: len(out)]
        return out

    def seen_share(self) -> np.ndarray:
        """log10 of what a class gives each token of a seen word: (1 - unseen) / tokens of the class."""
        return np.log10((1 - self.unseen) / np.maximum(self.class_tokens, 1))


def _most_common(vocabulary: DataFrame) -> list[tuple[bytes, int]]:
    """At most COMMON words, more frequent than all others, by falling count. A histogram of counts gives the least count
    to take, so no task or driver sorts the vocabulary."""
    c = F.col("c")
    level = F.when(c < 4096, c).otherwise(4096 + F.floor(512 * F.log2(c / 4096))).cast("int")
    least, total = None, 0
    for row in sorted(vocabulary.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        total += row["count"]
        if total > COMMON:
            break
        least = row["level"]
    if least is None:
        return []
    found = vocabulary.where(level >= least).select("word", "c").toArrow()
    return sorted(zip(found.column("word").to_pylist(), found.column("c").to_pylist(), strict=True), key=lambda w: (-w[1], w[0]))


def build_lexicon(texts: DataFrame) -> tuple[Lexicon, DataFrame]:
    """From a one-column table of training texts: the lexicon, and the whole vocabulary (word, c)."""
    vocabulary = settle(texts.mapInArrow(_count_words, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "vocabulary")
    suffix = F.pmod(F.crc32(F.substring("word", -SUFFIX_BYTES, SUFFIX_BYTES)), F.lit(SUFFIXES))
    short = F.when(F.octet_length("word") < SUFFIX_BYTES, F.pmod(F.crc32("word"), F.lit(SUFFIXES))).otherwise(suffix)
    by_suffix = vocabulary.groupBy(short.alias("k")).agg(
        F.sum("c").alias("tokens"), F.count_if(F.col("c") == 1).alias("once"), F.count(F.lit(1)).alias("words")
    ).collect()  # fmt: skip  # SUFFIXES rows
    top = _most_common(vocabulary)
    ends = texts.count()
    tokens, once = np.zeros(CLASSES, dtype=np.int64), np.zeros(CLASSES, dtype=np.int64)
    for row in by_suffix:
        tokens[1 + OWN + row["k"]], once[1 + OWN + row["k"]] = row["tokens"], row["once"]
    for place, (word, c) in enumerate(top[:OWN]):
        k = 1 + OWN + zlib.crc32(word[-SUFFIX_BYTES:]) % SUFFIXES
        tokens[k] -= c
        once[k] -= c == 1
        tokens[1 + place] = c
    tokens[0] = ends
    unseen = np.where(np.arange(CLASSES) > OWN, (once + 0.5) / (tokens + 1), 0.0)
    unseen = np.where(tokens > 0, np.minimum(unseen, 0.99), np.where(np.arange(CLASSES) > OWN, 1.0 - 1e-9, 0.0))
    words = {word: i for i, (word, _) in enumerate(top)}
    distinct = sum(r["words"] for r in by_suffix) + (ends > 0)
    return Lexicon(words, np.array([c for _, c in top], dtype=np.int64), int(tokens.sum()), distinct, ends, tokens, unseen), vocabulary


_ENCODED = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, base double, inner double, codes binary, rare array<binary>, times array<int>"
)


def _encoder(lexicon: Lexicon):
    """(doc_id, held_out, text) → codes of the classes, sums over common words, and the other words with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, total = lexicon.common.get, lexicon.tokens + lexicon.distinct + 1
        classes, seen = lexicon.classes(), lexicon.seen_share()
        base = np.log10((lexicon.counts + 1) / total) if len(lexicon.counts) else np.zeros(1)
        inner = np.where(classes > OWN, np.log10(np.maximum(lexicon.counts, 1)) + seen[classes], 0.0) if len(lexicon.counts) else np.zeros(1)
        end_base = float(np.log10((lexicon.ends + 1) / total))
        suffix: dict[bytes, int] = {}
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for text in batch.column(2):
                words = _words(text.as_py())
                at = np.fromiter(map(find, words, repeat(-1)), dtype=np.int64, count=len(words))
                common = at[at >= 0]
                codes = classes[at].astype(np.uint16)
                missing = np.flatnonzero(at < 0)
                rare: dict[bytes, int] = {}
                for i in missing.tolist():
                    w = words[i]
                    rare[w] = rare.get(w, 0) + 1
                    tail = w[-SUFFIX_BYTES:]
                    k = suffix.get(tail)
                    if k is None:
                        k = suffix[tail] = 1 + OWN + zlib.crc32(tail) % SUFFIXES
                        if len(suffix) > _WORDS_HELD:
                            suffix.clear()
                    codes[i] = k
                row = (
                    len(words) + 1, len(common) + (lexicon.ends > 0), float(base[common].sum()) + end_base, float(inner[common].sum()),
                    np.append(codes, np.uint16(0)).tobytes(), list(rare), list(rare.values()),
                )
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base", "inner", "codes", "rare", "times"],
            )

    return run


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # state x class


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All codes of a binary column, and each text's first and last place."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data.view(np.uint16) if data.ctypes.data % 2 == 0 else np.frombuffer(data.tobytes(), dtype=np.uint16), (offsets - offsets[0]) // 2


def coarse_of() -> np.ndarray:
    out = np.zeros(CLASSES, dtype=np.int64)
    out[1 : 1 + OWN] = np.where(np.arange(OWN) < COARSE_OWN, np.arange(1, OWN + 1), 1 + COARSE_OWN + np.arange(OWN) % COARSE_SUFFIXES)
    out[1 + OWN :] = 1 + COARSE_OWN + np.arange(SUFFIXES) % COARSE_SUFFIXES
    return out


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes → how often two coarse classes stand within NEAR tokens of each other."""
    coarse, counts = coarse_of(), np.zeros(COARSE * COARSE, dtype=np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        codes, edges = _codes(batch.column(0))
        c, text = coarse[codes], np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        for apart in range(1, NEAR + 1):
            same = text[apart:] == text[:-apart]
            counts += np.bincount((c[:-apart] * COARSE + c[apart:])[same], minlength=COARSE * COARSE)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["cell", "n"])


def first_model(pairs: np.ndarray, lexicon: Lexicon, states: int = STATES) -> Model:
    """States start as groups of coarse classes with alike neighbours: k-means on the square roots of neighbour shares."""
    rng = np.random.default_rng(SEED)
    both = (pairs + pairs.T).astype(np.float64)
    weight = both.sum(axis=1)
    expected = np.outer(weight, weight) / max(weight.sum(), 1)
    shift = np.sqrt(both + 0.1) - np.sqrt(expected + 0.1)
    values, vectors = np.linalg.eigh((shift + shift.T) / 2)
    lead = np.argsort(-np.abs(values))[: states]
    points = vectors[:, lead] * np.sqrt(np.abs(values[lead]))
    points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)
    centres = [points[int(np.argmax(weight))]]
    while len(centres) < states:
        far = (1 - np.max(points @ np.array(centres).T, axis=1)) * np.sqrt(weight)
        centres.append(points[int(np.argmax(far))])
    centre = np.array(centres)
    for _ in range(50):
        group = np.argmax(points @ centre.T, axis=1)
        for s in range(states):
            if (group == s).any():
                mean = (points[group == s] * weight[group == s, None]).sum(axis=0)
                centre[s] = mean / max(np.linalg.norm(mean), 1e-9)
    closeness = np.exp(4 * (points @ centre.T))
    closeness /= closeness.sum(axis=1, keepdims=True)
    emit = (closeness[coarse_of()].T * (lexicon.class_tokens + 0.5)) * rng.uniform(0.9, 1.1, (states, CLASSES))
    emit /= emit.sum(axis=1, keepdims=True)
    move = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
    return Model(np.full(states, 1 / states), move, emit)


def expected_counts(codes: np.ndarray, edges: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of first states, moves and emissions over sequences codes[edges[i]:edges[i + 1]] in stretches."""
    s = len(model.start)
    start, move, emit = np.zeros(s), np.zeros((s, s)), np.zeros((s, CLASSES))
    pieces = -(-np.diff(edges) // STRETCH)
    first = np.concatenate([e + STRETCH * np.arange(n) for e, n in zip(edges[:-1], pieces, strict=True)]) if len(pieces) else np.zeros(0, int)
    last = np.minimum(first + STRETCH, np.repeat(edges[1:], pieces))
    opens = np.isin(first, edges[:-1])
    power = np.linalg.matrix_power(model.move, 64)[0]
    steps, table = model.move.astype(np.float32), np.ascontiguousarray(model.emit.T.astype(np.float32))
    order = np.argsort(first - last, kind="stable")
    for at in range(0, len(order), 2048):
        some = order[at : at + 2048]
        a, size = first[some], (last - first)[some]
        longest = int(size[0])
        live = np.searchsorted(-size, -np.arange(longest), side="left")
        alpha = np.zeros((longest, len(some), s), dtype=np.float32)
        given = np.zeros_like(alpha)
        scale = np.ones((longest, len(some), 1), dtype=np.float32)
        now = np.where(opens[some, None], model.start, power).astype(np.float32)
        for t in range(longest):
            m = live[t]
            given[t, :m] = table[codes[a[:m] + t]]
            now = (now[:m] if t == 0 else now[:m] @ steps) * given[t, :m]
            scale[t, :m] = np.maximum(now.sum(axis=1, keepdims=True), 1e-30)
            now = now / scale[t, :m]
            alpha[t, :m] = now
        beta = np.ones((len(some), s), dtype=np.float32)
        total = np.zeros((s, s))
        for t in range(longest - 2, -1, -1):
            m = live[t + 1]
            onward = given[t + 1, :m] * beta[:m] / scale[t + 1, :m]
            total += alpha[t, :m].T @ onward
            beta[:m] = onward @ steps.T
            alpha[t, :m] *= beta[:m]
        move += model.move * total
        start += alpha[0][opens[some]].sum(axis=0)
        seen = np.concatenate([codes[a[: live[t]] + t] for t in range(longest)])
        weight = np.concatenate([alpha[t, : live[t]] for t in range(longest)])
        for k in range(s):
            emit[k] += np.bincount(seen, weights=weight[:, k], minlength=CLASSES)
    return start, move, emit


def _expecter(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = len(model.start)
        sums = [np.zeros(s), np.zeros((s, s)), np.zeros((s, CLASSES))]
        for batch in batches:
            if batch.num_rows:
                for have, more in zip(sums, expected_counts(*_codes(batch.column(0)), model), strict=True):
                    have += more
        flat = np.rint(np.concatenate([x.ravel() for x in sums]) * UNIT).astype(np.int64)
        some = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(flat[some])], names=["cell", "n"])

    return run


def _gather(rows: DataFrame, size: int) -> np.ndarray:
    """Sum (cell, n) rows of all tasks; `size` numbers at most reach the driver."""
    out = np.zeros(size, dtype=np.int64)
    for row in rows.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[row["cell"]] = row["n"]
    return out


def train(codes: DataFrame, lexicon: Lexicon, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over a one-column table of encoded training texts."""
    pairs = _gather(codes.mapInArrow(_count_pairs, "cell long, n long"), COARSE * COARSE).reshape(COARSE, COARSE)
    model = first_model(pairs, lexicon, states)
    prior = (lexicon.class_tokens + 0.1) / (lexicon.class_tokens + 0.1).sum()
    for _ in range(rounds):
        flat = _gather(codes.mapInArrow(_expecter(model), "cell long, n long"), states + states * states + states * CLASSES) / UNIT
        start, move, emit = flat[:states], flat[states : states + states**2].reshape(states, states), flat[states + states**2 :].reshape(states, CLASSES)
        model = Model(
            (start + 0.1) / (start + 0.1).sum(),
            (move + 0.1) / (move + 0.1).sum(axis=1, keepdims=True),
            (emit + 20 * prior) / (emit.sum(axis=1, keepdims=True) + 20),
        )
    return model


def log_likelihood(codes: np.ndarray, edges: np.ndarray, model: Model) -> np.ndarray:
    """log10 likelihood of every sequence by the scaled forward recursion, all sequences side by side."""
    size = np.diff(edges)
    order = np.argsort(-size, kind="stable")
    a, out = edges[:-1][order], np.zeros(len(size))
    if not len(size):
        return out
    longest = int(size[order[0]])
    live = np.searchsorted(-size[order], -np.arange(longest), side="left")
    table = np.ascontiguousarray(model.emit.T)
    now = np.tile(model.start, (len(size), 1))
    for t in range(longest):
        m = live[t]
        now = (now[:m] if t == 0 else now[:m] @ model.move) * table[codes[a[:m] + t]]
        scale = now.sum(axis=1)
        now /= scale[:, None]
        out[:m] += np.log10(scale)
    back = np.empty_like(out)
    back[order] = out
    return back


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(log_likelihood(*_codes(batch.column(1)), model))], names=["row", "latent"])

    return run


def score_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """→ one row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts whose crc32 of the id modulo 7 is 2 are held out; all others (null ids too) train. Null text is empty: its
    end alone is scored. `score` is the model's log10 probability; a word never seen counts as its class's event of
    meeting one. An empty table gives no row.
    """
    away = F.coalesce(F.crc32(F.col(id_column).cast("string")) % 7 == 2, F.lit(False))
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), away.alias("held_out"), F.col(text_column).cast("string").alias("text"))
    lexicon, vocabulary = build_lexicon(source.where("NOT held_out").select("text"))
    encoded = settle(source.mapInArrow(_encoder(lexicon), _ENCODED).withColumn("row", F.monotonically_increasing_id()), "encoded")
    model = train(encoded.where("NOT held_out").select("codes"), lexicon, states, rounds)
    latent = encoded.select("row", "codes").mapInArrow(_scorer(model), "row long, latent double")

    suffix = F.pmod(F.crc32(F.when(F.octet_length("word") < SUFFIX_BYTES, F.col("word")).otherwise(F.substring("word", -SUFFIX_BYTES, SUFFIX_BYTES))), F.lit(SUFFIXES))
    share = lambda x: F.get(F.array(*(F.lit(float(v)) for v in x[1 + OWN :])), suffix.cast("int"))
    total = lexicon.tokens + lexicon.distinct + 1
    rare = encoded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    met = rare.join(vocabulary, "word", "left").select(
        "row",
        F.when(F.col("c") > 0, F.col("times")).otherwise(0).cast("long").alias("known"),
        (F.col("times") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(total)))).alias("base"),
        (F.col("times") * F.when(F.col("c") > 0, F.log10("c") + share(lexicon.seen_share())).otherwise(share(np.log10(np.maximum(lexicon.unseen, 1e-300))))).alias("inner"),
    )
    met = met.groupBy("row").agg(F.sum("known").alias("rare_known"), F.sum("base").alias("rare_base"), F.sum("inner").alias("rare_inner"))
    sums = encoded.drop("codes", "rare", "times").join(latent, "row").join(met, "row", "left")
    zero = F.lit(0)
    return sums.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", zero)).alias("n_known"),
        F.lit(lexicon.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", zero)).alias("base_score"),
        (F.col("latent") + F.col("inner") + F.coalesce("rare_inner", zero)).alias("score"),
    )
