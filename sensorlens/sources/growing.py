"""A streaming source of logs that grow: lines appended to files that it has read before, and files that take their place.

Spark's own file sources read a file once. Here an offset says for each file how many of its bytes have been read:

* A file is known by its first line (and its inode, where there is one), not by its path. One that is renamed goes on where it
  was; one that begins anew under an old path is new.
* Only whole lines count: an offset stands behind a line feed, and half a line waits for its rest.
* ``start`` is ``end`` (what is appended from now on) or ``beginning``.
* New bytes are read in ranges of ``rangeBytes``, so a long file is many tasks' work; a line belongs to the range it begins in.

Files are listed and read through ``pyarrow.fs``: local and shared file systems, S3, HDFS with its native library.
"""

from __future__ import annotations

import fnmatch
import hashlib
import os
import posixpath
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

# Workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NAME = "growing_log"
SCHEMA = "value string, path string, position long"
LONGEST_FIRST_LINE = 4_096
CHUNK = 1 << 20


@dataclass
class Range(InputPartition):
    """Lines of the file ``name`` that begin from ``first`` to before ``last``; ``whole`` if a line begins at ``first``."""

    name: str
    path: str
    first: int
    last: int
    whole: bool


class Folder:
    """The files that a path with a pattern in its last part names."""

    def __init__(self, path: str):
        self.store, full = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))
        self.top, self.pattern = posixpath.split(full)

    def files(self) -> Iterator[fs.FileInfo]:
        for info in sorted(self.store.get_file_info(fs.FileSelector(self.top, allow_not_found=True)), key=lambda i: i.path):
            if info.type == fs.FileType.File and info.size and fnmatch.fnmatchcase(info.base_name, self.pattern):
                yield info

    def name_of(self, path: str) -> str | None:
        """What the file is known by; None until it has a whole line."""
        with self.store.open_input_file(path) as f:
            head = f.read(LONGEST_FIRST_LINE)
        if b"\n" not in head and len(head) < LONGEST_FIRST_LINE:
            return None
        inode = str(os.stat(path).st_ino) if isinstance(self.store, fs.LocalFileSystem) else ""
        return hashlib.sha1(head.split(b"\n", 1)[0] + b"\n" + inode.encode()).hexdigest()[:20]

    def lines_end(self, path: str, low: int, high: int) -> int:
        """The place behind the last line feed from ``low`` to before ``high``; ``low`` if there is none."""
        with self.store.open_input_file(path) as f:
            while high > low:
                a = max(low, high - CHUNK)
                f.seek(a)
                at = f.read(high - a).rfind(b"\n")
                if at >= 0:
                    return a + at + 1
                high = a
        return low

    def next_line(self, path: str, low: int, high: int) -> int:
        """The place behind the first line feed from ``low`` to before ``high``; ``high`` if there is none."""
        with self.store.open_input_file(path) as f:
            f.seek(low)
            while low < high and (data := f.read(min(CHUNK, high - low))):
                if (at := data.find(b"\n")) >= 0:
                    return low + at + 1
                low += len(data)
        return high


class GrowingReader(DataSourceStreamReader):
    def __init__(self, path: str, start: str, range_bytes: int, batch_bytes: int | None):
        if start not in ("end", "beginning"):
            raise ValueError("start must be 'end' or 'beginning'")
        self.path, self.start, self.range_bytes, self.batch_bytes = path, start, range_bytes, batch_bytes
        self.read_to: dict | None = None

    def _ends(self) -> dict:
        """For each file its path and the end of its last whole line."""
        folder, found = Folder(self.path), {}
        for info in folder.files():
            if (name := folder.name_of(info.path)) is not None:
                if name in found:  # without inodes: another file with the same first line
                    name = f"{name}:{info.base_name}"
                found[name] = {"path": info.path, "at": folder.lines_end(info.path, 0, info.size)}
        return found

    def initialOffset(self) -> dict:
        self.read_to = {"files": self._ends() if self.start == "end" else {}}
        return self.read_to

    def latestOffset(self) -> dict:
        now = self._ends()
        if self.batch_bytes is not None and self.read_to is not None:
            left, folder = self.batch_bytes, Folder(self.path)
            for name, file in list(now.items()):
                before = self.read_to["files"].get(name, {"at": 0})["at"]
                before = before if before <= file["at"] else 0
                if file["at"] - before > left:
                    to = folder.lines_end(file["path"], before, before + left) if left > 0 else before
                    if to == before and left == self.batch_bytes:  # one line that is longer than a batch
                        to = folder.next_line(file["path"], before + left, file["at"])
                    if to:
                        file["at"] = to
                    else:  # waits for a later batch
                        del now[name]
                left -= max(0, file["at"] - before)
        return {"files": now}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.read_to, out = end, []
        for name, file in end["files"].items():
            first, last = start["files"].get(name, {"at": 0})["at"], file["at"]
            if first > last:  # written anew from the same first line
                first = 0
            out += [Range(name, file["path"], a, min(last, a + self.range_bytes), a == first) for a in range(first, last, self.range_bytes)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        folder = Folder(self.path)
        path, name = partition.path, partition.name.split(":")[0]
        try:
            same = folder.name_of(path) == name
        except FileNotFoundError:
            same = False
        if not same:  # renamed since the batch was planned
            path = next((i.path for i in folder.files() if folder.name_of(i.path) == name), None)
            if path is None:
                raise FileNotFoundError(f"{partition.path} was replaced before its lines up to {partition.last} were read, and no file that the pattern names has them")
        size = folder.store.get_file_info(path).size
        # A line that begins in this range may end in later ones, and one that begins at its first byte is its own.
        at = partition.first if partition.whole else folder.next_line(path, partition.first - 1, size)
        values: list[str] = []
        places: list[int] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array([partition.path] * len(values), pa.string()), pa.array(places, pa.int64())], ["value", "path", "position"])

        with folder.store.open_input_stream(path, buffer_size=CHUNK) if at == 0 else folder.store.open_input_file(path) as f:
            if at:
                f.seek(at)
            rest = b""
            while at < partition.last:
                data = f.read(CHUNK)
                lines = (rest + data).split(b"\n")
                rest = lines.pop()
                for line in lines:
                    if at >= partition.last:
                        break
                    values.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                    places.append(at)
                    at += len(line) + 1
                    held += len(line)
                if held >= CHUNK or len(values) >= 10_000:
                    yield batch()
                    values, places, held = [], [], 0
                if not data:
                    break
        if values:
            yield batch()


class GrowingLog(DataSource):
    """Options: ``path`` (its last part may be a pattern), ``start``, ``rangeBytes``, ``maxBytesPerTrigger``.

    ``maxBytesPerTrigger`` bounds a batch but for one line, from the first batch after a start on. With a trigger of what is
    available now it would end before everything is read, so leave it out there.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> GrowingReader:
        most = self.options.get("maxBytesPerTrigger")
        return GrowingReader(self.options["path"], self.options.get("start", "end"), int(self.options.get("rangeBytes", 64 << 20)), int(most) if most else None)


def growing_lines(spark: SparkSession, path: str, start: str = "end", **options) -> DataFrame:
    """``value, path, position``: a stream of the lines appended to the files at ``path``, each with its first byte's place."""
    spark.dataSource.register(GrowingLog)
    return spark.readStream.format(NAME).option("start", start).options(**options).load(path)
