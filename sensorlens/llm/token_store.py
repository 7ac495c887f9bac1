"""Content-addressed store of token ids.

A rolling hash over the ids cuts each document's stream into chunks, so that equal passages give equal chunks wherever they
stand. The store has three tables in its folder:

* ``kind=chunk``: each different chunk once, under the SHA-256 (first 16 bytes) of its ids, as little-endian unsigned ids;
* ``recipes``: for each document, in ascending ``doc_id`` order, its addresses, lengths, first position in the whole stream
  and the root over its addresses. Files ascend by name and rows ascend inside a file;
* ``manifest``: a Merkle tree over the roots in stream order, ``fanout`` children to a node, up to one root.

Only unique chunks cross the network, once. Reading verifies every chunk against its address, every document against its
root and the tree against its top, and raises ``StoreError`` on any difference.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import settled
from .word_ids import encoded_slices, word_encoder

#: Window of the rolling hash, and least and greatest chunk, in ids; a cut is taken at one place in ``MEAN``.
WINDOW, LEAST, MEAN, GREATEST = 16, 128, 512, 4096
ADDRESS = 16


class StoreError(ValueError):
    """The stored bytes differ from what their addresses or roots say."""


@lru_cache(maxsize=1)
def _gear(size: int) -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 1 << 32, size, np.uint32)


def cut_hints(ids: np.ndarray, size: int) -> np.ndarray:
    """Places where the rolling hash over the last ``WINDOW`` ids allows a cut, in ascending order."""
    roll, k = _gear(size)[ids], 1
    while k < WINDOW:  # a hash over k ids and the one over the k before give that over 2k
        wider = roll.copy()
        wider[k:] += roll[:-k] << np.uint32(k)
        roll, k = wider, 2 * k
    return np.flatnonzero((roll & np.uint32((MEAN - 1) << WINDOW)) == 0) + 1  # all of the window has a say in these bits


def chunk_ends(hints: list[int], n: int) -> list[int]:
    """Ends of the chunks of a document of ``n`` ids with ``hints``. No cut comes before ``LEAST`` ids, so that a hash over
    ids of the document before can't make one: the chunks depend on the document's ids alone."""
    ends, last = [], 0
    for h in hints:
        while h - last > GREATEST:
            last += GREATEST
            ends.append(last)
        if h - last >= LEAST:
            ends.append(h)
            last = h
    while n - last > GREATEST:
        last += GREATEST
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


ROWS = "kind string, key binary, body binary, row_id long, doc_id long, addresses array<binary>, lengths array<int>"


def write_store(docs: DataFrame, path: str, folder: str, end_id: int = 2, fanout: int = 256) -> None:
    """Encodes every whole text (null: empty), appends ``end_id`` and writes the store to ``folder``.

    Rows with equal ``doc_id`` stay documents of their own, in the order they were read; null comes first.
    """
    names = [x.split()[0] for x in ROWS.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        size = encoder.tok.get_vocab_size(True)
        sent: set[bytes] = set()

        for batch in batches:
            rows, keys = batch.column("row_id").to_pylist(), batch.column("doc_id").to_pylist()
            for first, stream, before in encoded_slices(encoder, batch.column("text"), end_id):
                made: dict[bytes, bytes] = {}
                recipes = []
                stops = before[1:]
                hints = cut_hints(stream, size)
                marks = np.searchsorted(hints, stops, side="right").tolist()
                begin = mark = 0
                for k, (stop, upto) in enumerate(zip(stops.tolist(), marks, strict=True), first):
                    ends = chunk_ends((hints[mark:upto] - begin).tolist(), stop - begin)
                    raw, begin, mark = stream[begin:stop].tobytes(), stop, upto
                    addresses = []
                    for a, b in zip([0, *ends], ends, strict=False):
                        body = raw[a * encoder.dtype.itemsize : b * encoder.dtype.itemsize]
                        addresses.append(hashlib.sha256(body).digest()[:ADDRESS])
                        if addresses[-1] not in sent:
                            made[addresses[-1]] = body
                    recipes.append(("recipe", rows[k].to_bytes(8, "little"), None, rows[k], keys[k], addresses, np.diff([0, *ends]).tolist()))
                sent.update(made)
                if len(sent) > 500_000:  # only to send less; the grouping by address is what makes chunks unique
                    sent.clear()
                found = [("chunk", k, body, None, None, None, None) for k, body in made.items()] + recipes
                kinds = [pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names)

    numbered = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    # One shuffle carries unique chunks and recipes alike, so that texts are encoded once.
    numbered.mapInArrow(cut, ROWS).dropDuplicates(["kind", "key"]).write.partitionBy("kind").option("compression", "zstd").parquet(f"{folder}/parts")
    spark = docs.sparkSession
    parts = spark.read.schema(ROWS).parquet(f"{folder}/parts").where(F.col("kind") == "recipe")
    n = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    root = F.unhex(F.sha2(F.unhex(F.array_join(F.transform("addresses", F.hex), "")), 256))
    recipes = parts.select("row_id", "doc_id", n.alias("n_tokens"), "addresses", "lengths", root.alias("root"))
    # Running sums in two levels: inside a range of documents, and over the ranges, of which there are as many as partitions.
    ranged = recipes.repartitionByRange("doc_id", "row_id").sortWithinPartitions("doc_id", "row_id").withColumn("part", F.spark_partition_id())
    ranged = settled(ranged, "ranged")
    totals = ranged.groupBy("part").agg(F.sum("n_tokens").alias("ids"), F.count("*").alias("docs"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("ids"), F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("docs"))
    inside = W.partitionBy("part").orderBy("doc_id", "row_id")
    start = F.col("ids") + F.sum("n_tokens").over(inside) - F.col("n_tokens")
    placed = ranged.join(F.broadcast(totals), "part").select("part", "doc_id", start.alias("start"), "n_tokens", "addresses", "lengths", "root", (F.col("docs") + F.row_number().over(inside) - 1).alias("place"))
    placed.write.option("compression", "zstd").parquet(f"{folder}/recipes")
    level = spark.read.parquet(f"{folder}/recipes").select(F.col("place").alias("node"), F.col("root").alias("digest"))
    depth = 0
    while True:
        level = parents(level, fanout)
        level.withColumn("level", F.lit(depth)).write.mode("append").parquet(f"{folder}/manifest")
        level = spark.read.parquet(f"{folder}/manifest").where(F.col("level") == depth).select("node", "digest")
        depth += 1
        if level.count() <= 1:
            return


def parents(level: DataFrame, fanout: int) -> DataFrame:
    """The next level of the tree: a node is the hash over its at most ``fanout`` children in order."""
    children = F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda x: F.hex(x["digest"]))
    grouped = level.groupBy(F.floor(F.col("node") / fanout).cast("long").alias("parent")).agg(children.alias("children"))
    return grouped.select(F.col("parent").alias("node"), F.unhex(F.sha2(F.unhex(F.array_join("children", "")), 256)).alias("digest"))


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of CRC-32, in its reflected form."""
    out = 0
    for _ in range(32):
        if a & 0x80000000:
            out ^= b
        a = (a << 1) & 0xFFFFFFFF
        b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
    return out


@lru_cache(maxsize=65536)
def _shift(n_bytes: int) -> int:
    """x to the power 8 * n_bytes."""
    out, square = 0x80000000, 0x00800000
    while n_bytes:
        if n_bytes & 1:
            out = _times(square, out)
        square = _times(square, square)
        n_bytes >>= 1
    return out


def joined_crc32(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of a stream from (CRC-32, bytes) of its consecutive parts."""
    out = 0
    for crc, n in parts:
        out = _times(_shift(n), out) ^ crc
    return out


def read_chunks(spark: SparkSession, folder: str, item: int) -> DataFrame:
    """``address, crc32, n``: each stored chunk, verified, with the CRC-32 of its ids as unsigned 32-bit integers."""

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, crcs, sizes = batch.column("key").to_pylist(), [], []
            for key, body in zip(keys, batch.column("body").to_pylist(), strict=True):
                if hashlib.sha256(body).digest()[:ADDRESS] != key:
                    raise StoreError(f"chunk {key.hex()} has other bytes than its address says")
                ids = np.frombuffer(body, f"<u{item}")
                crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                sizes.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(crcs, pa.int64()), pa.array(sizes, pa.int32())], ["address", "crc32", "n"])

    chunks = spark.read.schema(ROWS).parquet(f"{folder}/parts").where(F.col("kind") == "chunk").select("key", "body")
    return chunks.mapInArrow(verified, "address binary, crc32 long, n int")


def read_digests(spark: SparkSession, folder: str, item: int = 2) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every stored document, from the bytes of its chunks.

    CRCs of chunks are joined to the recipes and combined, so that no chunk's bytes cross the network.
    """
    recipes = spark.read.parquet(f"{folder}/recipes")
    pieces = recipes.select("place", F.posexplode("addresses").alias("at", "address"))
    found = pieces.join(read_chunks(spark, folder, item), "address", "left").select("place", F.struct("at", "address", "crc32", "n").alias("piece"))
    gathered = found.groupBy("place").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))  # as many as the document has
    full = recipes.select("place", "doc_id", "start", "n_tokens", "root").join(gathered, "place")

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = []
            for doc, root, n, pieces in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "root", "n_tokens", "pieces")), strict=True):
                if any(p["crc32"] is None for p in pieces) or sum(p["n"] for p in pieces) != n or hashlib.sha256(b"".join(p["address"] for p in pieces)).digest() != root:
                    raise StoreError(f"the chunks of document {doc} don't give its root")
                crcs.append(joined_crc32([(p["crc32"], 4 * p["n"]) for p in pieces]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return full.mapInArrow(combined, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids``: the stored documents themselves, ``ids`` as the bytes of their ids."""
    recipes = spark.read.parquet(f"{folder}/recipes")
    chunks = spark.read.schema(ROWS).parquet(f"{folder}/parts").where(F.col("kind") == "chunk").select(F.col("key").alias("address"), "body")
    pieces = recipes.select("place", F.posexplode("addresses").alias("at", "address")).join(chunks, "address")
    bodies = F.transform(F.array_sort(F.collect_list(F.struct("at", "body"))), lambda x: F.hex(x["body"]))
    gathered = pieces.groupBy("place").agg(F.unhex(F.array_join(bodies, "")).alias("ids"))
    return recipes.join(gathered, "place").select("doc_id", "start", "n_tokens", "ids")


def verify_manifest(spark: SparkSession, folder: str, fanout: int = 256) -> None:
    """Builds the tree again, level by level, from the recipes read back, and holds it against the stored one."""
    recipes = spark.read.parquet(f"{folder}/recipes")
    stored = spark.read.parquet(f"{folder}/manifest")
    below = recipes.select(F.col("place").alias("node"), F.col("root").alias("digest"))
    for depth in range((stored.agg(F.max("level")).first()[0] or 0) + 1):
        kept = stored.where(F.col("level") == depth).select("node", F.col("digest").alias("kept"))
        if parents(below, fanout).join(kept, "node", "full").where(~F.col("digest").eqNullSafe(F.col("kept"))).limit(1).count():
            raise StoreError(f"level {depth} of the manifest differs from the recipes")
        below = kept.select("node", F.col("kept").alias("digest"))


def stored_digests(docs: DataFrame, path: str, folder: str, end_id: int = 2) -> DataFrame:
    """Writes the store, verifies its manifest and gives what reading it back says; an empty table gives no rows."""
    write_store(docs, path, folder, end_id)
    spark = docs.sparkSession
    verify_manifest(spark, folder)
    return read_digests(spark, folder, word_encoder(path).dtype.itemsize)
