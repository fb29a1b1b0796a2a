"""Projects, journals and documents, found in a listing of files rather than by walking folders one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annalist.functions.text import is_archived_path, slugify

JOURNAL = "journal"
DOCS_MOST, DOCS_DEPTH = 2000, 6
# fixed values: folders that hold no project, and views generated from logs
IGNORED = ("node_modules", "dist", "build", "target", "vendor", "venv", "__pycache__")
GENERATED = ("index.md", "changelog.md", "session.md", "backlog.md")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path (below the root), mtime_ms, size of every file; contents are not read. Spark leaves hidden files out, so a
    version-control folder shows only in a listing got elsewhere."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = F.regexp_replace("path", r"^.*?" + root.split("://")[-1].rstrip("/") + "/", "")
    return files.select(below.alias("path"), F.unix_millis("modificationTime").alias("mtime_ms"), F.col("length").alias("size"))


def projects(files: DataFrame) -> DataFrame:
    """slug, name, root, has_journal: folders with a journal or a version-control folder, and folders one deeper with a
    journal. The first root of a slug wins."""
    parts = F.split("path", "/")
    hit = lambda i, names: F.coalesce(F.get(parts, F.lit(i)).isin(*names), F.lit(False))
    rows = files.withColumn("a", F.get(parts, F.lit(0))).withColumn("b", F.get(parts, F.lit(1)))
    fine = lambda c: ~F.col(c).startswith(".") & ~F.col(c).isin(*IGNORED)
    top = rows.where((F.size(parts) > 2) & hit(1, (JOURNAL, ".git")) & fine("a")).groupBy(F.col("a").alias("name"), F.col("a").alias("root")).agg(
        F.max(F.col("b") == JOURNAL).alias("has_journal")
    )
    deep = rows.where((F.size(parts) > 3) & hit(2, (JOURNAL,)) & fine("a") & fine("b")).select(F.concat_ws("/", "a", "b").alias("name"), F.concat_ws("/", "a", "b").alias("root"))
    both = top.unionByName(deep.distinct().withColumn("has_journal", F.lit(True))).withColumn("slug", slugify(F.col("name")))
    first = Window.partitionBy("slug").orderBy("root")
    return both.withColumn("n", F.row_number().over(first)).where("n = 1").select("slug", "name", "root", "has_journal")


def journals(files: DataFrame) -> DataFrame:
    """path, root, source_type, component of journal files, typed by their names."""
    pattern = rf"^(.*?)/?{JOURNAL}/([^/]+)$"
    component = rf"^(.*?)/?{JOURNAL}/components/([^/]+)\.log$"
    name = F.regexp_extract("path", pattern, 2)
    kind = (
        F.when(F.col("path").rlike(component), F.lit("component")).when(name == "changelog.log", F.lit("changelog")).when(name == "session.log", F.lit("session"))
        .when(name == "backlog.log", F.lit("backlog")).when(name.endswith(".md") & ~name.isin(*GENERATED), F.lit("report"))
    )
    part = F.regexp_extract("path", component, 2)
    root = F.when(part != "", F.regexp_extract("path", component, 1)).otherwise(F.regexp_extract("path", pattern, 1))
    return files.select("path", root.alias("root"), kind.alias("source_type"), F.when(part != "", part).alias("component")).where("source_type IS NOT NULL")


def documents(files: DataFrame, most: int = DOCS_MOST) -> tuple[DataFrame, DataFrame]:
    """Markdown at a project's root and in its docs folder, and how many of each root were left out over the cap."""
    below = F.regexp_replace("path", r"^[^/]+/", "")
    root = F.substring_index("path", "/", 1)
    depth = F.size(F.split(below, "/"))
    rows = files.select("path", root.alias("root"), below.alias("below"), is_archived_path(below).alias("archived")).where(
        F.col("path").endswith(".md") & F.col("path").contains("/") & ((depth == 1) | (below.startswith("docs/") & (depth <= DOCS_DEPTH + 1)))
    )
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("root").orderBy("below")))
    dropped = ranked.where(F.col("n") > most).groupBy("root").agg(F.count(F.lit(1)).alias("dropped"))
    return ranked.where(F.col("n") <= most).drop("n", "below"), dropped
