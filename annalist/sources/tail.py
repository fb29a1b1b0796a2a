"""Growing files as a source: only what was appended is read, line by line.

`spark.readStream.format("tail").load(folder)` gives path, byte_offset and value of each whole new line under a folder. The offset of a
stream is the byte up to which each file is known, always behind a line end, so a torn last line waits until it is whole. A file that is
shorter than its known byte starts anew, and so does one that was away. Long appended ranges are dealt over tasks. Batch reads
(`spark.read.format("tail")`) take all whole lines.

Files are opened by pyarrow: local ones and those of stores it has a file system for.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, byte_offset long, value string"
#: Bytes of a task's range, of a read, and of a step back in search of a file's last line end.
PART_BYTES, READ_BYTES, BACK_BYTES = 64 << 20, 1 << 20, 64 << 10
ROWS_A_BATCH = 10_000


@dataclass
class Range(InputPartition):
    """Lines of `path` that begin in [start, stop). Whole lines end before `end`; `inside` tells that `start` may be amid a line."""

    path: str
    start: int
    stop: int
    end: int
    inside: bool


class _Files:
    """The files of a folder and their whole lines."""

    def __init__(self, options: dict):
        self.folder = options["path"]
        self.pattern = options.get("pattern", "*")
        self.part_bytes = int(options.get("partbytes", PART_BYTES))
        #: Bytes read so far by this object.
        self.bytes_read = 0
        self._known: dict[str, tuple[int, int]] = {}

    def _opened(self) -> tuple[fs.FileSystem, str]:
        if "://" not in self.folder and not self.folder.startswith("file:"):
            return fs.LocalFileSystem(), self.folder
        return fs.FileSystem.from_uri(self.folder)

    def _read_at(self, file: pa.NativeFile, count: int, at: int) -> bytes:
        data = file.read_at(count, at)
        self.bytes_read += len(data)
        return data

    def ends(self) -> dict[str, int]:
        """Each file's byte behind its last line end."""
        store, root = self._opened()
        found = {}
        for info in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            hidden = info.base_name.startswith(("_", "."))
            if info.type == fs.FileType.File and not hidden and fnmatch.fnmatch(info.base_name, self.pattern):
                size, end = self._known.get(info.path, (0, 0))
                if size != info.size:
                    end = self._last_end(store, info.path, info.size, end if info.size > size else 0)
                    self._known[info.path] = (info.size, end)
                found[info.path] = end
        self._known = {path: self._known[path] for path in found if path in self._known}
        return found

    def _last_end(self, store: fs.FileSystem, path: str, size: int, floor: int) -> int:
        """The byte behind the last line end in [floor, size), or `floor`; read backwards."""
        with store.open_input_file(path) as file:
            top = size
            while top > floor:
                bottom = max(floor, top - BACK_BYTES)
                at = self._read_at(file, top - bottom, bottom).rfind(b"\n")
                if at >= 0:
                    return bottom + at + 1
                top = bottom
        return floor

    def ranges(self, start: dict[str, int], end: dict[str, int]) -> list[Range]:
        out = []
        for path, stop in sorted(end.items()):
            first = start.get(path, 0)
            first = 0 if stop < first else first  # the file shrank
            for at in range(first, stop, self.part_bytes):
                out.append(Range(path, at, min(at + self.part_bytes, stop), stop, at > first))
        return out

    def lines(self, part: Range) -> Iterator[tuple[int, bytes]]:
        """(byte, line) of the lines that begin in a range; blank ones are left out."""
        store, _ = self._opened()
        at = begin = part.start - part.inside
        skip, held = part.inside, []
        with store.open_input_file(part.path) as file:
            while at < part.end and (data := self._read_at(file, min(READ_BYTES, part.end - at), at)):
                at += len(data)
                *whole, rest = data.split(b"\n")
                for piece in whole:
                    line, held = b"".join([*held, piece]), []
                    start, begin = begin, begin + len(line) + 1
                    if skip:
                        skip = False
                    elif start >= part.stop:
                        return
                    elif line:
                        yield start, line
                held.append(rest)
                if begin >= part.stop and not skip:
                    return

    def batches(self, part: Range) -> Iterator[pa.RecordBatch]:
        starts, values = [], []

        def batch() -> pa.RecordBatch:
            arrays = [pa.array([part.path] * len(starts), pa.string()), pa.array(starts, pa.int64()), pa.array(values, pa.string())]
            return pa.RecordBatch.from_arrays(arrays, names=["path", "byte_offset", "value"])

        for start, line in self.lines(part):
            starts.append(start)
            values.append(line.decode("utf-8", "replace"))
            if len(starts) == ROWS_A_BATCH:
                yield batch()
                starts, values = [], []
        if starts:
            yield batch()


class TailStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.files = _Files(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.files.ends()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.files.ranges(start, end)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.files.batches(partition)


class TailReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = _Files(options)

    def partitions(self) -> list[Range]:
        return self.files.ranges({}, self.files.ends())

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.files.batches(partition)


class TailSource(DataSource):
    """Options: `path`, the folder; `pattern`, of file names; `partBytes`, of a task's range."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TailReader:
        return TailReader(dict(self.options))

    def streamReader(self, schema) -> TailStreamReader:
        return TailStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(TailSource)
