from pyspark.sql import functions as F

from annalist.functions import present as pr
from annalist.sources import discovery as di


def test_discovery(spark, tmp_path):
    for name in ("Deep/journal/changelog.log", "Deep/journal/changelog.md", "Deep/journal/notes.md", "Deep/journal/components/pool.log", "Deep/Harbor/journal/backlog.log", "Deep/README.md",
                 "Deep/docs/a/old/x.md", "Deep/docs/b.md", "Deep/src/no.md", "node_modules/journal/changelog.log", "Plain/x.txt"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x")
    files = di.listing(spark, f"file://{tmp_path}")
    assert files.count() == 11 and files.first()["size"] == 1
    git = spark.createDataFrame([("Code/.git/HEAD", 0, 1)], "path string, mtime_ms long, size long")
    got = {r.slug: (r.root, r.has_journal) for r in di.projects(files.union(git)).collect()}
    assert got == {"deep": ("Deep", True), "deep-harbor": ("Deep/Harbor", True), "code": ("Code", False)}
    kinds = {r.path: (r.source_type, r.component, r.root) for r in di.journals(files).where("root LIKE 'Deep%'").collect()}
    assert kinds == {
        "Deep/journal/changelog.log": ("changelog", None, "Deep"), "Deep/journal/notes.md": ("report", None, "Deep"), "Deep/journal/components/pool.log": ("component", "pool", "Deep"),
        "Deep/Harbor/journal/backlog.log": ("backlog", None, "Deep/Harbor"),
    }
    docs, dropped = di.documents(files.where("path LIKE 'Deep%'"), most=2)
    assert sorted((r.path, r.archived) for r in docs.collect()) == [("Deep/README.md", False), ("Deep/docs/a/old/x.md", True)] and dropped.first().dropped == 1


def test_presentation(spark):
    rows = spark.createDataFrame([(999.0,), (1234.0,), (12345.0,), (3e6,)], "n double")
    assert [r[0] for r in rows.select(pr.compact(F.col("n"))).collect()] == ["999", "1.2k", "12k", "3M"]
    sizes = spark.createDataFrame([(12,), (2048,), (2515421157,), (None,)], "n long")
    assert [r[0] for r in sizes.select(pr.byte_size(F.col("n"))).collect()] == ["12 B", "2.00 KB", "2.34 GB", "—"]
    times = spark.createDataFrame([(19.0,), (2200.0,), (96000.0,), (None,)], "n double")
    assert [r[0] for r in times.select(pr.millis(F.col("n"))).collect()] == ["19ms", "2.2s", "1m 36s", "—"]
    one = spark.range(1)
    assert one.select(pr.duration(F.lit(3900))).first()[0] == "1h 05m" and one.select(pr.share(F.lit(1), F.lit(0))).first()[0] == "—"
    assert one.select(pr.collection_name(F.lit("Local"), F.lit("a/b-c"), F.lit(384))).first()[0] == "annalist_local_a_b_c_384"
    assert one.select(pr.embedder_parts(F.lit("bundled/x/y/384")).alias("e")).first()["e"].asDict() == {"name": "bundled", "model": "x/y", "dim": 384}
    assert one.select(pr.version_key(F.lit("v1.10")) > pr.version_key(F.lit("1.9.3"))).first()[0]
    assert one.select(pr.is_substitution(F.lit("v/a"), F.lit("a")), pr.is_substitution(F.lit("b"), F.lit("a"))).first()[:] == (False, True)


def test_decisions():
    assert [pr.rebuild_action(2, 2, 0, 9, True, True), pr.rebuild_action(1, 2, 9, 9, True, True), pr.rebuild_action(1, 2, 3, 9, True, True), pr.rebuild_action(1, 2, 3, 9, True, False)] == ["none", "stamp", "rebuild", "skipped"]
    assert pr.refuses_downgrade("auto", "b", "a", 5, False) and not pr.refuses_downgrade("auto", "b", "a", 0, False) and not pr.refuses_downgrade("x", "b", "a", 5, False)
    assert pr.needs_backfill(1) and not pr.needs_backfill(0)
