"""Packing: order-preserving dynamic programming over cut places, with a monotone queue.

The documents of a partition, in their order, form one stream of ids. Cut places are document ends (free), sentence ends
(a small penalty) and, inside sentences longer than ``stride`` ids, every ``stride`` ids (a larger one). With ``x`` the
place of a cut and ``f`` the least cost up to it,

    f(x_j) = cut(x_j) + min over i with x_j - x_i <= width of f(x_i) + padding(x_j - x_i)

where ``padding(n)`` is ``width - n``, or 0 if ``n`` is a power of two. The first form is ``width - x_j + min (f(x_i) +
x_i)`` over a sliding window, which a monotone queue gives in constant time; the powers are a few single look-ups.

The stream is solved in blocks of ``block`` ids. A block's cuts are kept but for the last few, and the next block starts
there, so that memory doesn't grow with the partition. At a partition's end any place may be a cut, so that what is left
over can be dealt into sequences of powers of two. No row is shuffled:
a partition is packed where it is read, and its sequence ids start at ``partition << 33``.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .word_ids import encoded_slices, word_encoder

FREE, SENTENCE, INSIDE = 0, 1, 2


def _power_pairs(places: np.ndarray, width: int) -> list[tuple[int, int]]:
    """(later, earlier) indexes of all places a power of two below ``width`` apart, by the later, longest first."""
    later, earlier = [], []
    for p in reversed([1 << k for k in range(width.bit_length()) if 1 << k < width]):
        at = np.searchsorted(places, places - p)
        same = np.flatnonzero(places[at] == places - p)
        later.append(same)
        earlier.append(at[same])
    j, i = np.concatenate(later), np.concatenate(earlier)
    order = np.argsort(j, kind="stable")
    return list(zip(j[order].tolist(), i[order].tolist(), strict=True))


def best_cuts(places: list[int], kinds: list[int], width: int, penalty: tuple[int, int, int]) -> list[int]:
    """Indexes of the cuts of least cost, from 0 to the last place. ``places`` ascend, with no gap over ``width``."""
    n = len(places)
    cost, back = [0] * n, [0] * n
    queue: deque[int] = deque([0])  # of places in reach, by rising cost + place
    pairs = _power_pairs(np.array(places), width)
    pairs.append((n, 0))
    pair, (later, earlier) = 1, pairs[0]
    for j in range(1, n):
        x = places[j]
        while places[queue[0]] < x - width:
            queue.popleft()
        i = queue[0]
        best = cost[i] + width - (x - places[i])
        while later == j:
            if cost[earlier] < best:
                best, i = cost[earlier], earlier
            later, earlier = pairs[pair]
            pair += 1
        cost[j], back[j] = best + penalty[kinds[j]], i
        key = cost[j] + x
        while queue and cost[queue[-1]] + places[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def cut_places(ids: np.ndarray, ends: np.ndarray, sentence_end: np.ndarray, stride: int, tail: int) -> tuple[list[int], list[int]]:
    """Places (ids before the cut) and kinds, from 0 to ``len(ids)``; within ``tail`` of the end, any place will do."""
    marks = np.flatnonzero(sentence_end[ids]) + 1
    base = np.unique(np.concatenate([[0], marks, ends, [len(ids)]]))
    extra = [np.arange(base[k] + stride, base[k + 1], stride) for k in np.flatnonzero(np.diff(base) > stride)]
    places = np.unique(np.concatenate([base, *extra, np.arange(max(0, len(ids) - tail), len(ids))])).astype(np.int64)
    kinds = np.full(len(places), INSIDE, np.int8)
    kinds[np.searchsorted(places, marks)] = SENTENCE
    kinds[np.searchsorted(places, ends)] = FREE
    kinds[-1] = FREE
    return places.tolist(), kinds.tolist()


class Packer:
    """Takes documents one by one and gives rows of pieces whenever a block has been solved."""

    def __init__(self, width: int, penalty: tuple[int, int, int], sentence_end: np.ndarray, first_sequence: int, block: int, stride: int):
        self.width, self.penalty, self.sentence_end, self.block, self.stride = width, penalty, sentence_end, block, stride
        self.sequence, self.ids, self.runs, self.held = first_sequence, [], [], 0

    def add(self, key, ids: np.ndarray) -> Iterator[tuple]:
        """A document of any length: a very long one passes through in several blocks."""
        total, done = len(ids), 0
        while done < total:
            take = min(total - done, max(1, self.block - self.held))
            self.ids.append(ids[done : done + take])
            if done and self.runs and self.runs[-1][1] + self.runs[-1][2] == done:
                self.runs[-1][2] += take
            else:
                self.runs.append([key, done, take, total])  # key, start in the document, length, document's length
            self.held += take
            done += take
            if self.held >= self.block:
                yield from self.solve(last=False)

    def solve(self, last: bool) -> Iterator[tuple]:
        if not self.held:
            return
        ids = np.concatenate(self.ids)
        ends = np.cumsum([n for _, _, n, _ in self.runs])
        whole = [e for e, (_, start, n, total) in zip(ends.tolist(), self.runs, strict=True) if start + n == total]
        places, kinds = cut_places(ids, np.array(whole, np.int64), self.sentence_end, self.stride, self.width if last else 0)
        cuts = [places[k] for k in best_cuts(places, kinds, self.width, self.penalty)]
        if not last:  # what follows may change the best way near the end
            cuts = cuts[: max(2, len(cuts) - 4)]
        run, begin = 0, 0
        for a, b in zip(cuts, cuts[1:], strict=False):
            offset = 0
            while a < b:
                key, start, n, total = self.runs[run]
                take = min(begin + n, b) - a
                crc = zlib.crc32(ids[a : a + take].astype("<u4").tobytes())
                yield key, start + a - begin, take, crc, total, self.sequence, offset
                a, offset = a + take, offset + take
                if a == begin + n:
                    run, begin = run + 1, a
            self.sequence += 1
        rest = cuts[-1]
        self.runs = self.runs[run:]
        if self.runs and rest > begin:
            self.runs[0][1] += rest - begin
            self.runs[0][2] -= rest - begin
        self.ids, self.held = [ids[rest:]], len(ids) - rest


def sentence_ends(encoder) -> np.ndarray:
    """For each id whether its token ends a sentence."""
    ends = np.zeros(encoder.tok.get_vocab_size(True), bool)
    for token, i in encoder.tok.get_vocab(True).items():
        ends[i] = token.removesuffix("</w>").rstrip("\"')]").endswith((".", "!", "?"))
    return ends


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packed(
    docs: DataFrame, path: str, end_id: int = 1, width: int = 2048, sentence_penalty: int = 32, inside_penalty: int = 128, sequence_cost: int = 8, block: int = 1 << 18, stride: int = 256
) -> DataFrame:
    """One row for each piece of a document: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Ids are those of the whole text, without added special tokens, and ``end_id``. A null or empty text is that one id.
    Rows with equal or null ``doc_id`` are packed as documents of their own. An empty table gives no rows. Columns other
    than ``doc_id`` and ``text`` aren't read. Ties between equally good cuts go to the longest sequence.
    """
    penalty = (sequence_cost, sequence_cost + sentence_penalty, sequence_cost + inside_penalty)
    names = [x.split()[0] for x in PIECE.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        packer = Packer(width, penalty, sentence_ends(encoder), TaskContext.get().partitionId() << 33, block, stride)
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for first, ids, before in encoded_slices(encoder, batch.column("text"), end_id):
                for key, a, b in zip(keys[first : first + len(before) - 1], before[:-1].tolist(), before[1:].tolist(), strict=True):
                    rows.extend(packer.add(key, ids[a:b]))
                yield out()
        rows.extend(packer.solve(last=True))
        yield out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pack, PIECE)
