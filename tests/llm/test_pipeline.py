"""The pipeline, stage by stage against brute force on a small corpus of labelled good and bad texts."""

import random
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from annalist.llm.minhash import drop_near_duplicates
from annalist.llm.packing import encoder_of
from annalist.llm.shared import BYTES_GOT, bound_batches, tidied
from tests.llm.test_dedup import groups, shingles


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["ta", "ri", "mo", "ne", "lu"]) for _ in range(rng.randrange(1, 5)))
    texts = []
    for i in range(400):
        words = [word() for _ in range(rng.randrange(40, 120))]
        texts.append((" ".join(w.upper() + "!!" for w in words) if i % 8 == 0 else " ".join(words), int(i % 8 > 0)))
    good = [t for t, y in texts if y]
    texts += [(t, 1) for t in good[:20] for _ in range(2)]
    for t in good[20:40]:
        words = t.split()
        words[len(words) // 2] = "changed"
        texts.append((" ".join(words), 1))
    texts += [("", 1), (None, 1)]
    rng.shuffle(texts)
    folder = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "en", "big" if i % 3 else f"s{i % 2}", len(t or "")) for i, (t, _) in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, y, 0) for i, (_, y) in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, {i: t for i, t, *_ in rows}, {i: y for i, (_, y) in enumerate(texts)}


def test_stages(spark, corpus):
    folder, text, label = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
        docs.write.parquet(f"{folder}/{name}.parquet")
        docs = spark.read.parquet(f"{folder}/{name}.parquet")

    clean = set(kept["quality_classifier"])
    wordy = {i for i in text if text[i]}
    assert sum((i in clean) == bool(label[i]) for i in wordy) / len(wordy) > 0.98

    largest = {}
    for i in clean:
        largest[text[i] or ""] = max(i, largest.get(text[i] or "", -1))
    assert sorted(kept["exact_dedup"]) == sorted(largest.values())

    sets = {i: shingles(text[i]) for i in kept["exact_dedup"]}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= corpus_pipeline.NEAR_PERCENT * len(sets[a] | sets[b])]
    parts = groups(sets, linked)
    assert linked and sorted(kept["minhash_near_dedup"]) == sorted({*parts.values()})

    copies = Counter(kept["source_mixing"])
    assert set(copies) == set(kept["minhash_near_dedup"]) and set(copies.values()) <= {1, 2}

    plain, pieces, fill = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter(), Counter()
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect():
        pieces[r.doc_id] += r.length
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048
    assert pieces == {i: n * (len(plain.encode(text[i] or "", add_special_tokens=False).ids) + 1) for i, n in copies.items()}


def test_run(spark, corpus):
    folder, text, _ = corpus
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in got} <= set(text) and len({r.doc_id for r in got}) > 300


CLASHING = ["_score", "score", "_stay_id", "_kept", "kept", "mix_tokens", "mix_source", "doc", "row", "key", "digest", "set_digest", "component_id", "c0", "we`ird name"]


def test_odd_rows(spark, corpus):
    """Extra columns of any name, null and repeated ids, equal rows, null sources, empty and very long texts."""
    folder, text, _ = corpus
    long = " ".join(f"ta{i % 7}ri mone" for i in range(100_000))
    other = " ".join(f"lumo{i}" for i in range(60))
    rows = [(i, t, "s") for i, t in list(text.items())[:60]]
    rows += [(None, "ta ri mo ne lu tari", "s"), (None, None, None), (None, "", "s"), (7000, long, "s"), (7001, long, None), (7001, long, None)]
    rows += [(7002, "one clean text of its own with a few words", "s"), (7002, other, "s"), (1, other + " more", "s"), (7003, "  ", "s")]
    docs = spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in rows], ", ".join(["doc_id long", "text string", "source string", *(f"`{c.replace('`', '``')}` string" for c in CLASHING)]))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        kept[name] = [(r.doc_id, r.text) for r in out.collect()]
        assert stage(spark, docs.limit(0), folder).collect() == []
    assert set(kept["quality_classifier"]) <= {r[:2] for r in rows}
    texts = [t or "" for _, t in kept["exact_dedup"]]
    assert sorted(texts) == sorted({t or "" for _, t, _ in rows}) and (7001, long) in kept["exact_dedup"]
    near = kept["minhash_near_dedup"]
    assert (7002, "one clean text of its own with a few words") in near and (7002, other) not in near and (1, other + " more") in near
    assert [i for i, t in near if t == long] == [7000] and sum(not (t or "").strip() for _, t in near) == sum(not (r[1] or "").strip() for r in rows)
    assert {(i, t) for i, t in kept["source_mixing"]} == {r[:2] for r in rows}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert sum(r.piece == 0 for r in pieces) == len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).collect() == []


def _batch_bytes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["rows", "bytes"])


def test_batches_of_long_texts(spark, tmp_path):
    """Python tasks get at most BYTES_GOT and a row at once, and all rows."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.range(40, numPartitions=1).selectExpr("id AS doc_id", "repeat(concat(id, ' w '), 200000) AS text").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    long = 1_200_000
    assert drop_near_duplicates(docs).count() == 40
    got = docs.coalesce(1).select("text").mapInArrow(_batch_bytes, "rows long, bytes long").collect()
    assert sum(r["rows"] for r in got) == 40
    assert max(r["bytes"] for r in got) <= BYTES_GOT + long
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
    bound_batches(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1m"
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


def test_workers_keep_the_encoder_only_while_they_pack():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = encoder_of(path)
    assert list(tidied(lambda batches: batches, keeps=path)(iter([]))) == []
    assert encoder_of(path) is encoder
    assert list(tidied(lambda batches: batches)(iter([]))) == []
    assert encoder_of(path) is not encoder
