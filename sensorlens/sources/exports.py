"""Exports with line feeds inside quotes, one file read by as many tasks as it has ranges of bytes.

Whether a line feed ends a record depends on all quotes before it, which is why Spark's own reader gives such a file to one
task. Here its text reader cuts files into ranges at any line feed, and then

1. the quotes of each range are counted, and the parity of those before it in its file says whether it begins inside a field;
2. each range's lines, in their order, become records where they end inside the range; lines before the first record end and
   after the last are fragments;
3. fragments of neighbouring ranges, at most two for each range, become the records that cross them.

Only fragments are shuffled. Fields may hold quotes only inside quotes and doubled, as writers of such exports do.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

# Workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WHOLE, HEAD, TAIL, THROUGH = range(4)
PIECES = "value string, kind int, first boolean, path string, at long"


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``value, path, at``: the lines of each range, with its file and its first byte."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"))


def ranges(rows: DataFrame) -> DataFrame:
    """``path, at, inside``: whether each range begins inside a quoted field. One row for each range."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    odd = rows.groupBy("path", "at").agg((F.sum(quotes) % 2).alias("odd"))
    before = W.partitionBy("path").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    return odd.select("path", "at", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside"))


class _Range:
    """What is known while the lines of one range come in."""

    def __init__(self, path: str, at: int, inside: bool):
        self.path, self.at, self.inside = path, at, inside
        self.open: list[str] = []  # lines of a record that has not ended
        self.headless = inside  # whether that record began in a range before
        self.fresh = at == 0  # whether the file's first record is still to come

    def take(self, values: pa.Array) -> Iterator[tuple[pa.Array, int, bool]]:
        """(values, kind, whether the first of them is the file's first) of what ends in ``values``."""
        odd = pc.count_substring(values, '"').to_numpy(zero_copy_only=False) & 1
        after = (np.cumsum(odd) + self.inside) & 1
        ends = np.flatnonzero(after == 0)
        starts = np.concatenate([[-1], ends[:-1]]) + 1 if len(ends) else ends
        if len(ends) and (self.open or self.headless):  # the record that was open ends here
            text = "\n".join([*self.open, *values.slice(0, int(ends[0]) + 1).to_pylist()])
            yield pa.array([text]), HEAD if self.headless else WHOLE, self.fresh and not self.headless
            self.fresh, self.headless, self.open = False, False, []
            starts, ends = starts[1:], ends[1:]
            rest = int(starts[0]) if len(ends) else int(np.flatnonzero(after == 0)[0]) + 1
        else:
            rest = 0
        if len(ends):
            alone = starts == ends
            if self.fresh:
                k = int(ends[0])
                yield pa.array(["\n".join(values.slice(0, k + 1).to_pylist())]), WHOLE, True
                self.fresh, starts, ends, alone = False, starts[1:], ends[1:], alone[1:]
                rest = k + 1
            if alone.any():
                yield values.take(pa.array(ends[alone])), WHOLE, False
            several = ["\n".join(values.slice(a, b - a + 1).to_pylist()) for a, b in zip(starts[~alone].tolist(), ends[~alone].tolist())]
            if several:
                yield pa.array(several), WHOLE, False
            rest = int(ends[-1]) + 1 if len(ends) else rest
        self.open += values.slice(rest).to_pylist()
        self.inside = bool(after[-1]) if len(after) else self.inside

    def close(self) -> Iterator[tuple[pa.Array, int, bool]]:
        if self.open:
            yield pa.array(["\n".join(self.open)]), THROUGH if self.headless else TAIL, self.fresh


def pieces(rows: DataFrame) -> DataFrame:
    """Records that begin and end in a range (``kind`` 0) and fragments of the others, with their range."""
    known = {(r.path, r.at): r.inside for r in _bounded(ranges(rows))}
    told = rows.sparkSession.sparkContext.broadcast(known)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Range | None = None

        def out(found: tuple[pa.Array, int, bool]) -> pa.RecordBatch:
            values, kind, first = found
            n = len(values)
            marks = pa.array(np.arange(n) == (0 if first else -1))
            place = [pa.array([now.path] * n, pa.string()), pa.array([now.at] * n, pa.int64())] if kind else [pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())]
            return pa.RecordBatch.from_arrays([values.cast(pa.string()), pa.array(np.full(n, kind, np.int32)), marks, *place], ["value", "kind", "first", "path", "at"])

        for batch in batches:
            values, paths, starts = batch.column("value"), batch.column("path"), batch.column("at").to_numpy()
            codes = paths.dictionary_encode().indices.to_numpy()
            cuts = np.flatnonzero((np.diff(starts) != 0) | (np.diff(codes) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)]):
                if a == b:
                    continue
                path, at = paths[a].as_py(), int(starts[a])
                if now is None or (now.path, now.at) != (path, at):
                    if now is not None:
                        yield from map(out, now.close())
                    if (path, at) not in told.value:
                        raise RuntimeError(f"the ranges of {path} have changed since their quotes were counted; read it again")
                    now = _Range(path, at, told.value[path, at])
                yield from map(out, now.take(values.slice(a, b - a)))
        if now is not None:
            yield from map(out, now.close())

    return rows.mapInArrow(join, PIECES)


def _bounded(found: DataFrame) -> list:
    """One row for each range of a file, that is for 128 MB by default: some 8,000 for a terabyte."""
    return found.collect()


def records(spark: SparkSession, path: str | list[str], header: bool = True) -> DataFrame:
    """``value``: the records of the files at ``path``, each with its inner line feeds; without each file's first if ``header``.

    Blank records are left out. A field that no quote ends takes the rest of its file.
    """
    parts = pieces(lines(spark, path))
    chain = W.partitionBy("path").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0)
    cut = parts.where(F.col("kind") != WHOLE).withColumn("chain", F.last(F.when(F.col("kind") == TAIL, F.col("at")), ignorenulls=True).over(chain))
    ordered = F.sort_array(F.collect_list(F.struct("at", "value")))
    crossing = cut.groupBy("path", "chain").agg(F.array_join(F.transform(ordered, lambda x: x["value"]), "\n").alias("value"), F.max("first").alias("first"))
    found = parts.where(F.col("kind") == WHOLE).select("value", "first").unionByName(crossing.select("value", "first"))
    if header:
        found = found.where(~F.col("first"))
    bare = F.when(F.endswith("value", F.lit("\r")), F.substring(F.col("value"), F.lit(1), F.length("value") - 1)).otherwise(F.col("value"))
    return found.select(bare.alias("value")).where("value <> ''")


def quoted_csv(spark: SparkSession, path: str | list[str], schema: str, header: bool = True) -> DataFrame:
    """The rows of exports at ``path``, as Spark's reader gives them with ``multiLine`` and doubled quotes."""
    parsed = records(spark, path, header).select(F.from_csv("value", schema, {"escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}).alias("row"))
    return parsed.select("row.*")
