"""Terminal recordings: binary records to rows, and rows to pairs of input and output."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import udtf

from ..operators.corpus import turn_pairs

#: Fixed values of the format: a header of six little-endian 32-bit numbers, operations and directions.
HEADER = "<IIIIII"
SIZE = struct.calcsize(HEADER)
OPEN, CLOSE, DATA = 1, 2, 3
OUTPUT, INPUT = 2, 3


@udtf(returnType="seq int, op int, direction int, sec long, usec long, payload string")
class DecodeRecords:
    """Records of one recording, up to an unknown operation or a size past the end."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        at, seq = 0, 0
        while content is not None and at + SIZE <= len(content):
            op, _, size, direction, sec, usec = struct.unpack_from(HEADER, content, at)
            at += SIZE
            if op not in (OPEN, CLOSE, DATA) or at + size > len(content):
                return
            yield seq, op, direction, sec, usec, bytes(content[at : at + size]).decode("utf-8", "replace")
            at, seq = at + size, seq + 1


def records(recordings: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """``key`` and the decoded records of each row of ``recordings``."""
    spark = recordings.sparkSession
    spark.udtf.register("decode_records", DecodeRecords)
    view = f"terminal_recordings_{uuid.uuid4().hex}"
    recordings.select(F.col(key).alias("key"), F.col(content).alias("content")).createOrReplaceTempView(view)
    found = spark.sql(f"SELECT r.key AS `{key}`, d.* FROM {view} r, LATERAL decode_records(r.content) d")
    spark.catalog.dropTempView(view)
    return found


def pairs(recordings: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """``key, pair, instruction, output``: cleaned input with the cleaned output after it."""
    rows = records(recordings, key, content).where((F.col("op") == DATA) & (F.col("payload") != ""))
    sides = rows.withColumn("side", F.when(F.col("direction") == INPUT, "in").when(F.col("direction") == OUTPUT, "out"))
    return turn_pairs(sides, key, "seq", "side", "payload", "in", "out", clean=True)
