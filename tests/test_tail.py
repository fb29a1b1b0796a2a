"""The source of growing files: byte offsets, torn lines, shrunk files, replays."""

import json
import os

from pyspark.sql import functions as F

from annalist.sources.tail import TailStreamReader, register
from annalist.streaming.ingest import tail_stream


def append(path, data: bytes):
    with open(path, "ab") as f:
        f.write(data)


def read(reader, start, end):
    return [(b.column("byte_offset")[k].as_py(), b.column("value")[k].as_py()) for p in reader.partitions(start, end) for b in reader.read(p) for k in range(b.num_rows)]


def test_only_the_tail_is_read(tmp_path):
    path = str(tmp_path / "a.log")
    append(path, b"".join(b"line %07d %s\n" % (i, b"x" * 80) for i in range(60_000)))  # more than 5 MB
    reader = TailStreamReader({"path": str(tmp_path)})
    first = reader.latestOffset()
    assert first == {path: os.path.getsize(path)}
    assert len(read(reader, {}, first)) == 60_000
    append(path, b"new one\n\nnew two\ntorn")
    seen = reader.files.bytes_read
    second = reader.latestOffset()
    got = read(reader, first, second)
    assert [v for _, v in got] == ["new one", "new two"] and got[0][0] == first[path]
    assert reader.files.bytes_read - seen < 100  # a look for the line end, and the new lines
    assert read(reader, first, second) == got  # a replay
    append(path, b" no more\n")
    third = TailStreamReader({"path": str(tmp_path)}).latestOffset()  # a restart knows nothing
    assert [v for _, v in read(reader, second, third)] == ["torn no more"]
    with open(path, "wb") as f:
        f.write(b"anew\n")
    shrunk = reader.latestOffset()
    assert shrunk == {path: 5} and read(reader, third, shrunk) == [(0, "anew")]
    os.remove(path)
    assert reader.latestOffset() == {}


def test_ranges_give_each_line_once(tmp_path):
    lines = [b"", b"a", b"bb\r", "é€😀".encode(), b"z" * 50, b"", b"", b"\xff\xfe", b"q" * 9]
    data = b"".join(x + b"\n" for x in lines) + b"torn"
    (tmp_path / "f.txt").write_bytes(data)
    (tmp_path / "_hidden").write_bytes(b"no\n")
    (tmp_path / "other.md").write_bytes(b"no\n")
    want, at = [], 0
    for x in lines:
        if x:
            want.append((at, x.decode("utf-8", "replace")))
        at += len(x) + 1
    for size in (1, 2, 3, 7, 16, 1000):
        reader = TailStreamReader({"path": str(tmp_path), "pattern": "*.txt", "partbytes": str(size)})
        assert read(reader, {}, reader.latestOffset()) == want
    assert TailStreamReader({"path": str(tmp_path / "none")}).latestOffset() == {}


def test_stream_ingests_appended_lines(spark, tmp_path):
    register(spark)
    logs, table, checkpoint = tmp_path / "logs", f"file://{tmp_path}/entries", f"file://{tmp_path}/checkpoint"
    logs.mkdir()

    def entries(lines):
        return lines.select(
            F.lit("p").alias("project"), F.lit("log").alias("source_type"), F.col("path").alias("source_path"), F.col("byte_offset").cast("string").alias("source_ref"),
            F.substring("value", 1, 60).alias("title"), F.col("value").alias("body"),
        )

    def run():
        tail_stream(spark, str(logs), entries, table, checkpoint).awaitTermination()
        return sorted((os.path.basename(r.source_path), int(r.source_ref), r.body) for r in spark.read.parquet(table).collect())

    append(logs / "a.jsonl", json.dumps({"n": 1}).encode() + b"\nsecond\nto")
    assert run() == [("a.jsonl", 0, '{"n": 1}'), ("a.jsonl", 9, "second")]
    append(logs / "a.jsonl", b"rn\n")
    append(logs / "b.jsonl", b"other\n")
    want = [("a.jsonl", 0, '{"n": 1}'), ("a.jsonl", 9, "second"), ("a.jsonl", 16, "torn"), ("b.jsonl", 0, "other")]
    assert run() == want
    assert run() == want  # nothing new
    # another checkpoint replays all lines, and nothing is written twice
    tail_stream(spark, str(logs), entries, table, f"file://{tmp_path}/again").awaitTermination()
    assert spark.read.parquet(table).count() == 4
    assert spark.read.format("tail").load(str(logs)).count() == 4
