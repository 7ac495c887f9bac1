"""Media columns: archives of images behind a custom Spark data source.

``payload`` bytes are kept as 8-bit grey samples of a PNG, ``WIDTH`` to a row, losslessly. The data source
``media_archive`` writes and reads a directory of tar archives:

* writing: each task streams its rows into archives of about ``archive_bytes``, with an index of members beside each. Only
  archives that a finished task reported are listed, in the manifest that the commit writes; others don't count.
* reading: the driver lists archives and plans byte ranges of ``range_bytes`` over them, without opening any. A task reads
  the index of its archive, streams the members that begin in its range through Arrow, a few megabytes at a time, and
  tries a member that fails again by its offset, on a newly opened file; the other members don't notice. A member that
  keeps failing comes as a row with its ``error``.
"""

from __future__ import annotations

import io
import json
import struct
import tarfile
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

WIDTH = 192
PNG = b"\x89PNG\r\n\x1a\n"
INDEX = pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("crc32", pa.int64())])
MANIFEST = "manifest"


class MediaError(ValueError):
    """Stored media that can't be read back as they were written."""


def payload_of(text: str | None) -> tuple[bytes, int]:
    """(UTF-8 bytes, filled up with spaces to a positive multiple of ``WIDTH``; length before that)"""
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % WIDTH or (0 if raw else WIDTH)), len(raw)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, n_bytes: int, level: int = 6) -> bytes:
    """``payload`` as a grey image; ``n_bytes`` is kept as a text entry."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    filtered = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter 0 before each row
    filtered[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"Bytes\0" + str(n_bytes).encode()) + _chunk(b"IDAT", zlib.compress(filtered.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[bytes, int]:
    """(payload, length before filling) of an image that ``to_png`` made."""
    if media[:8] != PNG:
        raise MediaError("not a PNG")
    at, data, height, n_bytes = 8, [], 0, -1
    while at < len(media):
        (size,), kind, body = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8], media[at + 8 : at + 8 + int.from_bytes(media[at : at + 4], "big")]
        if zlib.crc32(kind + body) != int.from_bytes(media[at + 8 + size : at + 12 + size], "big"):
            raise MediaError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            height = struct.unpack(">IIBBBBB", body)[1]
        elif kind == b"tEXt" and body.startswith(b"Bytes\0"):
            n_bytes = int(body[6:])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, WIDTH + 1)
    if rows[:, 0].any():
        raise MediaError("rows are filtered")
    return rows[:, 1:].tobytes(), n_bytes


def features(payload: bytes) -> str:
    """Rows, mean, deviation, entropy in bits and shares of eight bands of brightness."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256).astype(np.float64)
    n, values = counts.sum(), np.arange(256)
    mean = float(counts @ values / n)
    p = counts[counts > 0] / n
    bands = counts.reshape(8, 32).sum(1) / n
    return f"rows={int(n) // WIDTH};mean={mean:.4f};sd={float(np.sqrt(max(0.0, counts @ values**2 / n - mean**2))):.4f};entropy={float(-(p * np.log2(p)).sum()) + 0.0:.4f};bands=" + ",".join(f"{b:.4f}" for b in bands)


def _store(uri: str):
    """(file system, path) of a folder, for any store that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


@dataclass
class Range(InputPartition):
    archive: str
    start: int
    stop: int


@dataclass
class Written(WriterCommitMessage):
    archives: list  # of (name, bytes)


class MediaArchive(DataSource):
    """``spark.read/write.format("media_archive")`` with option ``path``; see the module for the others."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "row_id long, doc_id long, offset long, media binary, attempts int, error string"

    def reader(self, schema) -> "MediaReader":
        return MediaReader(self.options)

    def writer(self, schema, overwrite: bool) -> "MediaWriter":
        return MediaWriter(self.options)


class MediaWriter(DataSourceArrowWriter):
    """Takes rows of ``row_id, doc_id, text``."""

    def __init__(self, options):
        self.folder, self.archive_bytes = options["path"], int(options.get("archive_bytes", 64 << 20))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, base = _store(self.folder)
        store.create_dir(base, recursive=True)
        done: list[tuple[str, int]] = []
        name, out, tar, index = "", None, None, []

        def close() -> None:
            tar.close()
            size = out.tell()
            out.close()
            with store.open_output_stream(f"{base}/{name}.index") as f, pa.ipc.new_file(f, INDEX) as sink:
                sink.write_table(pa.table(list(zip(*index, strict=True)), schema=INDEX))
            done.append((name, size))

        for batch in batches:
            for row, doc, text in zip(*(batch.column(c).to_pylist() for c in ("row_id", "doc_id", "text")), strict=True):
                if tar is None:
                    name, index = f"{uuid.uuid4().hex}.tar", []
                    out = store.open_output_stream(f"{base}/{name}")
                    tar = tarfile.open(fileobj=out, mode="w|", format=tarfile.GNU_FORMAT)
                media = to_png(*payload_of(text))
                member = tarfile.TarInfo(f"{row}.png")
                member.size = len(media)
                index.append((row, doc, tar.offset + tarfile.BLOCKSIZE, len(media), zlib.crc32(media)))
                tar.addfile(member, io.BytesIO(media))
                if tar.offset >= self.archive_bytes:
                    close()
                    tar = None
        if tar is not None:
            close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = _store(self.folder)
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/{MANIFEST}") as f:
            f.write(json.dumps([a for m in messages if m for a in m.archives]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, base = _store(self.folder)
        for m in messages:
            for name, _ in m.archives if m else ():
                store.delete_file(f"{base}/{name}")


def fetched(store, path: str, offset: int, size: int, crc: int, tries: int) -> tuple[bytes | None, int, str | None]:
    """(member, attempts, error): the bytes at ``offset``, from a newly opened file at each attempt."""
    why = ""
    for attempt in range(1, tries + 1):
        try:
            with store.open_input_file(path) as f:
                f.seek(offset)
                media = f.read(size)
            if zlib.crc32(media) == crc:
                return media, attempt, None
            why = "its bytes have another checksum"
        except OSError as e:
            why = str(e)
        time.sleep(0.05 * attempt)
    return None, tries, f"member at {offset} of {path}: {why}"


#: Ranges have at least so many bytes, and more where there would be too many of them.
LEAST_RANGE, MOST_RANGES = 16 << 20, 100_000


class MediaReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.range_bytes, self.tries = options["path"], int(options.get("range_bytes", 0)), int(options.get("tries", 3))

    def partitions(self) -> list[Range]:
        store, base = _store(self.folder)
        with store.open_input_stream(f"{base}/{MANIFEST}") as f:
            archives = json.loads(f.read())
        step = self.range_bytes or max(LEAST_RANGE, sum(size for _, size in archives) // MOST_RANGES)
        return [Range(name, at, min(size, at + step)) for name, size in archives for at in range(0, size, step)] or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        names, kinds = ["row_id", "doc_id", "offset", "media", "attempts", "error"], [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.string()]
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 6, kinds, strict=True)], names)
            rows.clear()
            return made

        if part.archive:
            store, base = _store(self.folder)
            path = f"{base}/{part.archive}"
            with store.open_input_file(f"{path}.index") as f:
                index = pa.ipc.open_file(f).read_all()
            offsets = index.column("offset").to_numpy()
            mine = index.slice(int(np.searchsorted(offsets, part.start)), int(np.searchsorted(offsets, part.stop) - np.searchsorted(offsets, part.start)))
            held, shared = 0, None
            for row, doc, offset, size, crc in zip(*(c.to_pylist() for c in mine.columns), strict=True):
                try:
                    shared = shared or store.open_input_file(path)
                    shared.seek(offset)
                    media = shared.read(size)
                    found = (media, 1, None) if zlib.crc32(media) == crc else None
                except OSError:
                    found, shared = None, None
                media, attempts, error = found or fetched(store, path, offset, size, crc, self.tries)
                rows.append((row, doc, offset, media, attempts, error))
                held += size
                if held >= 4 << 20:
                    yield out()
                    held = 0
            if shared:
                shared.close()
        yield out()


def write_media(docs: DataFrame, folder: str, **options) -> None:
    """Archives of the texts of ``docs`` in ``folder``, a row of ``docs`` to a member."""
    docs.sparkSession.dataSource.register(MediaArchive)
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows.write.format("media_archive").options(path=folder, **options).mode("append").save()


def read_media(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(path=folder, **options).load()


def media_columns(media: DataFrame) -> DataFrame:
    """Digests and features of the members ``doc_id, media, error``. A member that couldn't be read raises ``MediaError``."""
    kind = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for doc, stored, error in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "media", "error")), strict=True):
                if error:
                    raise MediaError(error)
                payload, n = from_png(stored)
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), features(payload)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 8, types, strict=True)], [x.split()[0] for x in kind.split(", ")])

    return media.select("doc_id", "media", "error").mapInArrow(columns, kind)


def stored_media(docs: DataFrame, folder: str, **options) -> DataFrame:
    """Writes each whole text (null: empty) as an image, reads the archives back and gives their digests and features.

    A row for each row of ``docs``; equal texts have equal values, whatever their ``doc_id``, which may be null. An empty
    table gives no rows. Columns other than ``doc_id`` and ``text`` aren't read.
    """
    write_media(docs, folder, **options)
    return media_columns(read_media(docs.sparkSession, folder))
