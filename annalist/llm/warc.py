"""WARC archives of pages, and the global capture index over them.

Writing stays in DataFrame operations: a record is a string, a record's end is the text writer's line separator, so
files are ordinary gzipped WARC/1.1, committed by Spark wherever the folder lives. Every task writes its captures sorted
by URL key and time. Reading parses the archives by Content-Length and checks every payload against its digest.

The index is an external merge: the sorted runs are cut at common key ranges, and each range merges its runs' segments
with a loser tree, so captures come out in global (segment, place) order, the captures of a URL together in time order.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.shared import column, new_path, settle

_CRLF = "\r\n"
_END = "\r\n\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_URN = "urn:annalist:page:"
#: The year whose seconds stand for times where pages have none, and the seconds of dates that four digits can write.
FIRST_SECOND, SECONDS = 1704067200, 366 * 86400
DATED = (-62135510400, 253402214400)
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS_PER_FILE = 4096

_INDEX = (
    "page_id long, url string, captured_at timestamp, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "file string, record_no long"
)


def base32_of_hex(hexed: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits (5 of those are 4 of base 32)."""

    def digit(i: Column) -> Column:
        value = F.conv(F.substr(hexed, F.floor(i / 4).cast("int") * 5 + 1, F.lit(5)), 16, 10).cast("int")
        five = F.call_function("shiftright", value, (F.lit(3) - i % 4) * 5).bitwiseAND(F.lit(31))
        return F.substr(F.lit(_BASE32), five + 1, F.lit(1))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), digit), "")


def url_key(url: Column) -> Column:
    """Sort-friendly form of a URL: host labels reversed, then the path and query without fragment, lower case."""
    lower = F.lower(F.coalesce(url, F.lit("")))
    plain = F.regexp_replace(F.regexp_replace(lower, r"#.*$", ""), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?", "")
    host, rest = F.regexp_extract(plain, r"^([^/?:]*)", 1), F.regexp_replace(plain, r"^[^/?]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def write_archives(
    pages: DataFrame,
    path: str,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
    time_column: str | None = None,
    least_revisit_bytes: int = 0,
) -> None:
    """Write a record per row under `path`. Null html is an empty payload.

    Of rows with equal payloads of at least `least_revisit_bytes` bytes, the one with the largest id is a response and
    the others are revisits of it; a repeated row with that largest id is a response again, as is every row without an
    id in a group that has none. Without `time_column`, and where its time is null or outside the years 1 to 9999, a page's time is the
    second of 2024 (UTC) that its id falls on, counted round and round the year; a null id counts as 0. Ids are any 64-bit numbers. Other columns are not
    read, whatever their names. An empty table leaves a folder without records.
    """
    when = F.timestamp_seconds(F.lit(FIRST_SECOND) + F.pmod(F.coalesce(column(id_column).cast("long"), F.lit(0)), F.lit(SECONDS)))
    if time_column:
        given = column(time_column).cast("timestamp")
        when = F.coalesce(F.when(F.unix_seconds(given).between(*DATED), given), when)
    rows = pages.select(
        column(id_column).cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce(column(url_column), F.lit("")), r"[\x00-\x20\x7f]", "").alias("url"),
        F.coalesce(column(html_column), F.lit("")).alias("payload"),
        when.alias("captured_at"),
    ).withColumn("digest", F.sha1("payload"))
    held = settle(rows.groupBy("digest").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("copies")), "payloads")
    again = held.where("copies > 1").select("digest", "original")
    rows = rows.join(again, "digest", "left")
    revisit = (F.col("original") != F.col("page_id")) | (F.col("page_id").isNull() & F.col("original").isNotNull())
    revisit = F.coalesce(revisit, F.lit(False)) & (F.octet_length("payload") >= least_revisit_bytes)

    size = F.octet_length("payload").cast("string")
    sent = F.when(revisit, F.lit(0)).otherwise(F.octet_length("payload"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), size, F.lit(_END))
    urn = lambda c: F.concat(F.lit(f"<{_URN}"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    head = F.concat(
        F.lit(f"WARC/1.1{_CRLF}WARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{_CRLF}WARC-Record-ID: "), urn("page_id"),
        F.lit(f"{_CRLF}WARC-Date: "), F.date_format(F.to_utc_timestamp("captured_at", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit(f"{_CRLF}WARC-Target-URI: "), F.col("url"),
        F.lit(f"{_CRLF}WARC-Payload-Digest: sha1:"), base32_of_hex(F.col("digest")),
        F.when(revisit, F.concat(F.lit(f"{_CRLF}WARC-Profile: {_PROFILE}{_CRLF}WARC-Refers-To: "), urn("original"))).otherwise(F.lit("")),
        F.lit(f"{_CRLF}Content-Type: application/http;msgtype=response{_CRLF}Content-Length: "),
        (F.octet_length(http) + sent).cast("string"), F.lit(_END), http,
    )
    value = F.when(revisit, head).otherwise(F.concat(head, F.col("payload")))
    records = rows.select(value.alias("value"), url_key(F.col("url")).alias("key"), "captured_at", "page_id")
    records.sortWithinPartitions("key", "captured_at", "page_id").select("value").write.option("lineSep", _END).option(
        "compression", "gzip"
    ).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields, block) of each record of an uncompressed WARC stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line.strip() == b"":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if len(block) != int(fields["content-length"]):
            raise ValueError("truncated WARC record")
        yield fields, block


def _id(urn: str | None) -> int | None:
    found = re.fullmatch(rf"<{_URN}(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import datetime

    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("captured_at", pa.timestamp("us", tz="UTC")), ("payload_bytes", pa.int64()),
         ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("record_no", pa.int64())]
    )
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = []
            with gzip.open(io.BytesIO(content.as_buffer()), "rb") as stream:
                for number, (fields, block) in enumerate(parse_records(stream)):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", head)[1])
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    if fields["warc-type"] == "response":
                        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"payload of {fields['warc-record-id']} in {path} doesn't match its digest")
                    at = datetime.datetime.fromisoformat(fields["warc-date"])
                    rows.append((_id(fields["warc-record-id"]), fields["warc-target-uri"], at, size, digest, fields["warc-type"], _id(fields.get("warc-refers-to")), path, number))
            columns = list(zip(*rows, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the archives under `path`, in file order within a file. Damaged records raise."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path)
    return files.select("path", "content").mapInArrow(_reader, _INDEX)


class LoserTree:
    """Merges sorted runs: inner nodes hold the run that lost there, so an output costs one replay from leaf to root."""

    def __init__(self, runs: list[list], key: Callable):
        self.runs, self.key, self.k = runs, key, max(1, len(runs))
        self.at = [0] * self.k
        self.front = [self._front(i) for i in range(self.k)]
        self.lost = [-1] * self.k
        self.best = self._build(1) if self.k > 1 else 0

    def _front(self, run: int) -> tuple:
        rows, at = (self.runs[run] if self.runs else []), self.at[run]
        return (0, self.key(rows[at]), run) if at < len(rows) else (1, None, run)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.front[a], self.front[b]
        return x[0] < y[0] if x[0] != y[0] else (x[1:] < y[1:] if x[0] == 0 else a < b)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (a, b) if self._less(a, b) else (b, a)
        self.lost[node] = lose
        return win

    def __iter__(self) -> Iterator:
        while self.front[self.best][0] == 0:
            run = self.best
            yield self.runs[run][self.at[run]]
            self.at[run] += 1
            self.front[run] = self._front(run)
            node = (run + self.k) // 2
            while node >= 1 and self.k > 1:
                if self._less(self.lost[node], run):
                    self.lost[node], run = run, self.lost[node]
                node //= 2
            self.best = run


def _merger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one key range, run by run → the same rows merged, numbered by (segment, place)."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    runs: dict[str, list[int]] = {}
    for i, file in enumerate(rows.column("file").to_pylist()):
        runs.setdefault(file, []).append(i)
    keys = list(zip(rows.column("urlkey").to_pylist(), rows.column("captured_at").cast(pa.int64()).to_pylist(), [-1 << 63 if x is None else x for x in rows.column("page_id").to_pylist()], strict=True))
    order = list(LoserTree(list(runs.values()), keys.__getitem__))
    merged = rows.take(pa.array(order, pa.int64()))
    merged = merged.append_column("segment", pa.array([TaskContext.get().partitionId()] * len(order), pa.int32()))
    yield from merged.append_column("place", pa.array(range(len(order)), pa.int64())).combine_chunks().to_batches()


def merge_captures(index: DataFrame, segments: int | None = None) -> DataFrame:
    """Sorted runs (one a file) → all captures in global order of (urlkey, captured_at, page_id), told by (segment, place)."""
    spark = index.sparkSession
    keyed = settle(index.withColumn("urlkey", url_key(F.col("url"))), "capture-runs")
    parts = segments or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = keyed.repartitionByRange(parts, "urlkey", "captured_at", "page_id").sortWithinPartitions("file", "record_no")
    return ranged.mapInArrow(_merger, _INDEX + ", urlkey string, segment int, place long")


def archive_pages(pages: DataFrame, path: str | None = None, **columns) -> DataFrame:
    """Write `pages` to WARC, read the archives back, and merge their capture runs; see `write_archives`."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(pages, path, **columns)
    return merge_captures(read_archives(spark, path))
