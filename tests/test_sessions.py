"""Session rows by a stream against the same files read whole."""

import json
import os

import pytest
from pyspark.sql import functions as F

from annalist.operators.maintenance import merge_sessions
from annalist.sources import readers as rd
from annalist.streaming import sessions as ss


def event(kind, minute, **more):
    return json.dumps({"type": kind, "timestamp": f"2026-07-01T10:{minute:02d}:00Z", **more}).encode() + b"\n"


def edit(minute, path):
    block = {"type": "tool_use", "name": "Edit", "input": {"file_path": path}}
    return event("assistant", minute, message={"content": [block, {"type": "text", "text": "done"}]})


def ask(minute, text, **more):
    return event("user", minute, message={"content": text}, **more)


@pytest.fixture
def stored(spark):
    before = spark.conf.get(ss.STORE[0])
    spark.conf.set(*ss.STORE)
    yield spark
    spark.conf.set(ss.STORE[0], before)


def rows(df):
    out = {}
    for r in df.collect():
        d = r.asDict()
        out[d.pop("session_id")] = {k: d[k] for k in ("cwd", "title", "started_at", "ended_at", "prompt_count", "action_count", "files_touched")}
    return out


def whole(spark, folder):
    files = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("source_path"), F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    name = F.regexp_extract("source_path", r"([^/]+)\.jsonl$", 1)
    new = rd.sessions(files.select(F.lit("p").alias("project"), "source_path", name.alias("session_id"), "pos", "line")).withColumn("from_start", F.lit(True))
    return merge_sessions(new.limit(0), new)


def test_stream_equals_whole_files(stored, tmp_path):
    folder, table, checkpoint = (str(tmp_path / n) for n in ("logs", "table", "checkpoint"))
    os.mkdir(folder)

    def turn(**data):
        for name, lines in data.items():
            with open(f"{folder}/{name}.jsonl", "ab") as f:
                f.write(b"".join(lines))
        ss.transcript_stream(stored, folder, "p", table, checkpoint).awaitTermination()
        return rows(ss.latest_sessions(stored, table))

    turn(
        a=[ask(1, "first question", cwd="/w"), edit(2, "b.py"), b'{"type": "us'],
        b=[b"torn {\n", ask(5, "<noise>"), edit(4, "x.py")],
        c=[event("summary", 3, summary="said early")],
        empty=[],
    )
    got = turn(
        a=[b'er", "message": {"content": "second"}}\n', edit(9, "a.py"), edit(8, "b.py")],
        b=[ask(7, "late prompt " + "y" * 300), event("system", 6, cwd="/x")],
        d=[ask(k % 60, f"prompt {k}") for k in range(500)],
    )
    want = rows(whole(stored, folder))
    assert got == want and set(got) == {"a", "b", "c", "d"}
    assert got["a"]["prompt_count"] == 2 and got["a"]["files_touched"] == ["a.py", "b.py"] and got["a"]["title"] == "first question"
    assert got["b"]["title"] == ("late prompt " + "y" * 300)[:120] and got["c"]["title"] == "said early"
    assert turn() == got  # nothing new

    got = turn(a=[event("summary", 12, summary="named later")])
    assert got["a"]["title"] == "named later" and got["a"]["prompt_count"] == 2
    with open(f"{folder}/a.jsonl", "wb") as f:  # rewritten and shorter: counts start over, files and the first start stay
        f.write(ask(20, "again"))
    got = turn()
    assert got["a"]["prompt_count"] == 1 and got["a"]["action_count"] == 0 and got["a"]["files_touched"] == ["a.py", "b.py"]
    assert got["a"]["title"] == "named later" and got["a"]["started_at"].minute == 1 and got["a"]["ended_at"].minute == 20


def test_another_store_is_refused(spark, tmp_path):
    spark.conf.set(ss.STORE[0], "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    with pytest.raises(ValueError, match="providerClass"):
        ss.transcript_stream(spark, str(tmp_path), "p", str(tmp_path / "t"), str(tmp_path / "c"))


def test_parts_unite_in_any_order():
    import itertools

    def part(k, **more):
        base = {"low": k, "high": k, "started": None, "ended": None, "prompts": 0, "actions": 0, "files": set()}
        return base | {c: None for pair in ss._FIRSTS for c in pair} | more

    parts = [part(3, cwd_at=3, cwd="b", started=7), part(1, asked_at=1, asked="q", prompts=1), part(2, cwd_at=2, cwd="a", ended=4, files={"x"}), part(2, actions=2, started=5)]
    seen = []
    for order in itertools.permutations(parts):
        whole = order[0]
        for p in order[1:]:
            whole = ss._united(whole, p)
        seen.append(whole)
    assert all(w == seen[0] for w in seen)
    assert seen[0]["cwd"] == "a" and seen[0]["started"] == 5 and seen[0]["low"] == 1 and seen[0]["high"] == 3
