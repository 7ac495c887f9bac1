"""Substring dedup: words in passages that a document with a smaller id has too, found by recompression.

1. Each document's words go through the rounds of ``recompression``. Each window of ``width`` words gets a mark, a high-level
   symbol that all equal windows share, and neighbouring windows with one mark are one stretch, about one for 14 words.
2. Only marks in documents with different ids can tell of a repeat. Stretches with such marks go on, the others are done.
3. A stretch that a smaller id has in full repeats in full: one comparison for all its windows.
4. What is left are the ends of repeats. A stretch whose mark a smaller id has in another stretch is compared window by window,
   each different stretch once, for the smallest id that has it.
5. The windows that repeat are known for each stretch by a bit each; each document removes the words that they cover.

Names are hashes: equal windows always get equal names, and two windows are taken for equal if 64 bits of their mark and 64
independent bits of their words agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import settled
from .recompression import Spans, Words, pieces, stretches

#: Words of a window whose repeats are removed.
WIDTH = 50


def _key() -> Column:
    """What documents are known by: rows with equal id and text get equal answers. Null without an id."""
    return F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text"))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def marked_stretches(keyed: DataFrame, width: int) -> DataFrame:
    """``mark, whole, doc_id, key`` of the different stretches of each document of ``keyed`` (``key, doc_id, text``)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("doc_id").to_numpy(), batch.column("key").to_numpy()
            for words, docs, _ in pieces(batch.column("text"), width):
                s = stretches(words, width)
                doc = docs[np.searchsorted(words.before, s.first, side="right") - 1]
                _, at = np.unique(s.whole ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
                yield pa.RecordBatch.from_arrays([_signed(s.mark[at]), _signed(s.whole[at]), pa.array(ids[doc[at]]), pa.array(keys[doc[at]])], ["mark", "whole", "doc_id", "key"])

    return keyed.where("doc_id is not null").select("key", "doc_id", "text").mapInArrow(emit, "mark long, whole long, doc_id long, key long")


def windows_of(asked: DataFrame, width: int) -> DataFrame:
    """``mark, whole, doc_id, place, name`` of each window of the stretches in ``wholes`` of ``asked`` (``doc_id, text, wholes``)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, asks = batch.column("doc_id").to_numpy(), batch.column("wholes")
            for words, docs, _ in pieces(batch.column("text"), width):
                s = stretches(words, width)
                doc = docs[np.searchsorted(words.before, s.first, side="right") - 1]
                at, _ = _answers(doc, s.whole, asks)
                times = s.windows[at]
                row = np.repeat(at, times)
                place = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                name = Spans(words, 2).of(s.first[row] + place, width)
                columns = [_signed(s.mark[row]), _signed(s.whole[row]), pa.array(ids[doc[row]]), pa.array(place), _signed(name)]
                yield pa.RecordBatch.from_arrays(columns, ["mark", "whole", "doc_id", "place", "name"])

    return asked.select("doc_id", "text", "wholes").mapInArrow(emit, "mark long, whole long, doc_id long, place long, name long")


def _answers(doc: np.ndarray, whole: np.ndarray, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, place in the flat lists) of the stretches whose ``whole`` is in their document's list; ``doc`` rises."""
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    found, places = [], []
    for d in np.unique(doc).tolist():
        if ends[d] == ends[d + 1]:
            continue
        here = slice(*np.searchsorted(doc, [d, d + 1]).tolist())
        own = flat[ends[d] : ends[d + 1]]
        order = np.argsort(own)
        at = order[np.minimum(np.searchsorted(own, whole[here], sorter=order), len(own) - 1)]
        hit = np.flatnonzero(own[at] == whole[here])
        found.append(hit + here.start)
        places.append(at[hit] + ends[d])
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(found or empty), np.concatenate(places or empty)


def repeats(keyed: DataFrame, width: int) -> DataFrame:
    """``key, wholes, masks``: for each document with repeats its stretches, and in bits which of their windows repeat."""
    marked = settled(marked_stretches(keyed, width), "marks")
    shared = marked.groupBy("mark").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("mark")
    several = settled(marked.join(shared, "mark"), "shared")
    # One row for each different stretch, and the document that stands for it.
    first = F.min(F.struct("doc_id", "key"))
    kinds = settled(several.groupBy("mark", "whole").agg(first.alias("first"), F.max("doc_id").alias("most")).select("mark", "whole", "first.doc_id", "first.key", "most"), "kinds")
    open_ = kinds.groupBy("mark").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).where("least < last").select("mark")
    asked = kinds.join(open_, "mark").groupBy("key").agg(F.collect_set("whole").alias("wholes"))  # of one document
    windows = settled(windows_of(keyed.join(asked, "key"), width), "windows")
    earliest = windows.groupBy("mark", "name").agg(F.min("doc_id").alias("least"))
    later = windows.join(earliest, ["mark", "name"]).where("least < doc_id")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").cast("int"))
    masks = later.groupBy("mark", "whole").agg(F.bit_or(bit).alias("mask"))
    known = kinds.join(masks, ["mark", "whole"], "left").where("doc_id < most or mask is not null").select("mark", "whole", F.col("doc_id").alias("least"), F.coalesce("mask", F.lit(0)).alias("mask"))
    # All windows of a stretch that a smaller id has; else those found one by one.
    told = several.join(known, ["mark", "whole"]).select("key", "whole", F.when(F.col("doc_id") > F.col("least"), F.lit(-1).cast("long")).otherwise(F.col("mask")).alias("mask")).where("mask <> 0")
    return told.groupBy("key").agg(F.collect_set(F.struct("whole", "mask")).alias("told")).select("key", F.col("told.whole").alias("wholes"), F.col("told.mask").alias("masks"))


def removed_words(words: Words, first: np.ndarray, windows: np.ndarray, masks: np.ndarray, width: int) -> np.ndarray:
    """Which words are covered by the windows that the bits of ``masks`` name."""
    row = np.repeat(np.arange(len(first)), windows)
    place = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    starts = first[row] + place
    starts = starts[(masks[row] >> place) & 1 == 1]
    edges = np.zeros(len(words.names) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return np.cumsum(edges)[:-1] > 0


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_words, n_removed, kept, removed`` for each row of ``docs``: the words left, joined by one space, and the
    ``first`` and ``last`` words of the stretches removed, counted from 0.

    A word goes if a window of ``width`` words over it also starts in a document with a smaller ``doc_id``; what is left is
    not looked at again. Rows with equal ``doc_id`` don't count as smaller than each other; a row without ``doc_id`` neither
    loses words nor makes others lose them. Null and blank texts have no words. An empty table gives no rows. Extra columns
    are left out. A window's mark has at most 50 places, so ``width`` may be 2 to 64.
    """
    keyed = docs.select(_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    told = settled(repeats(keyed, width), "repeats")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                yield _cut(batch.slice(at, 500), width)

    schema = "doc_id long, n_words long, n_removed long, kept string, removed array<struct<first: long, last: long>>"
    return keyed.join(told, "key", "left").select("doc_id", "text", "wholes", "masks").mapInArrow(cut, schema)


def _cut(batch: pa.RecordBatch, width: int) -> pa.RecordBatch:
    text, lists, masks = batch.column("text"), batch.column("wholes"), batch.column("masks").flatten().to_numpy(zero_copy_only=False)
    gone: dict[int, list[np.ndarray]] = {}
    rows = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
    for words, docs, offsets in pieces(text.take(pa.array(rows)), width):
        s = stretches(words, width)
        part = np.searchsorted(words.before, s.first, side="right") - 1
        at, places = _answers(rows[docs[part]], s.whole, lists)
        out = removed_words(words, s.first[at], s.windows[at], masks[places], width)
        for k, (d, offset) in enumerate(zip(rows[docs].tolist(), offsets.tolist())):
            gone.setdefault(d, []).append(np.flatnonzero(out[words.before[k] : words.before[k + 1]]) + offset)
    made = []
    for d, (doc_id, found) in enumerate(zip(batch.column("doc_id").to_pylist(), text.cast(pa.binary()).to_pylist())):
        found = (found or b"").split()
        lost = np.unique(np.concatenate(gone[d])) if d in gone else np.zeros(0, np.int64)
        spans = []
        if len(lost):
            cut = np.flatnonzero(np.diff(lost) > 1)
            spans = [{"first": int(a), "last": int(b)} for a, b in zip(lost[np.append(0, cut + 1)], lost[np.append(cut, len(lost) - 1)])]
        kept, after = [], 0
        for span in spans:
            kept += found[after : span["first"]]
            after = span["last"] + 1
        kept += found[after:]
        made.append((doc_id, len(found), len(lost), b" ".join(kept).decode("utf-8", "replace"), spans))
    spans = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), spans)
    columns = [pa.array(x, kind) for x, kind in zip(zip(*made) if made else [[]] * 5, kinds)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept", "removed"])


ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), words AS (
  SELECT row, doc_id, unnest(words) AS word, unnest(range(len(words))) AS place FROM docs
), windows AS (
  SELECT row, doc_id, place, word, list(word) OVER (PARTITION BY row ORDER BY place ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS next FROM words
), starts AS (
  SELECT next, min(doc_id) AS least FROM windows WHERE len(next) = 50 GROUP BY next
), told AS (
  SELECT w.row, w.place, w.word, coalesce(max(CASE WHEN s.least < w.doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY w.row ORDER BY w.place ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM windows w LEFT JOIN starts s ON len(w.next) = 50 AND s.next = w.next
), kept AS (
  SELECT row, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY place) FILTER (gone = 0) AS kept FROM told GROUP BY row
)
SELECT doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (row)
"""
