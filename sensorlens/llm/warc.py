"""WARC archives and their fixity audit with Merkle trees.

Pages are written as ``resource`` records, each a gzip member of its own, into archives of about ``archive_bytes``. A
replica is a folder of archives with an index table: for each record its archive, ordinal and offset range. Only archives
whose task finished are in the index.

The audit reads the bytes of each replica once: a leaf is the hash over a record's offset range and bytes, and a node is the
hash over ``fanout`` consecutive nodes of its archive, up to the archive's root and, over the archives in order, one root
for the replica. Trees are written by level. Comparing starts at the roots and follows only branches that differ, so equal
replicas cost one comparison and a damaged record one short path. Reading takes a damaged record from the replica whose
copy of it holds against its own digest.

Tasks are dealt by bytes: an archive is read in parts of ``part_bytes``, and parts go round by number.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import new_folder, settled
from .media import _store

DATE = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    """Bytes that are no WARC record."""


def record(page_id: int | None, url: str | None, html: str | None, serial: int) -> bytes:
    """One uncompressed record. A null id or url has no header; line ends in a url are escaped."""
    block = (html or "").encode()
    head = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(serial))}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: text/html", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers in lower case, block) of an uncompressed record, its block held against its digest."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise WarcError("no record starts here")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    if headers.get("warc-block-digest", "").startswith("sha256:") and hashlib.sha256(block).hexdigest() != headers["warc-block-digest"][7:]:
        raise WarcError("the block has another digest")
    return headers, block


INDEX = "archive string, ordinal long, offset long, size long, page_id long"
#: Bytes of an archive that one part has, and of all parts of one task.
PART, TASK = 8 << 20, 64 << 20


def write_warc(pages: DataFrame, folder: str, archive_bytes: int = 32 << 20) -> None:
    """Records of ``page_id, url, html``, one for each row of ``pages``, and ``index`` in ``folder``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        name, out, at, rows = "", None, 0, []

        def listed() -> pa.RecordBatch:
            out.close()
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["archive", "ordinal", "offset", "size", "page_id"])

        for batch in batches:
            for serial, page, url, html in zip(*(batch.column(c).to_pylist() for c in ("row_id", "page_id", "url", "html")), strict=True):
                if out is None:
                    name, at, rows = f"{uuid.uuid4().hex}.warc.gz", 0, []
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                member = gzip.compress(record(page, url, html, serial), 6, mtime=0)
                out.write(member)
                rows.append((name, len(rows), at, len(member), page))
                at += len(member)
                if at >= archive_bytes:
                    yield listed()
                    out = None
        if out is not None:
            yield listed()

    rows = pages.select(F.monotonically_increasing_id().alias("row_id"), F.col("page_id").cast("long").alias("page_id"), "url", "html")
    rows.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")


def index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def _dealt(rows: DataFrame, size: str) -> DataFrame:
    """``rows`` in tasks of about ``TASK`` bytes, or as many as run at once where there are fewer bytes."""
    n, total = rows.agg(F.count("*"), F.sum(size)).first()
    tasks = max((total or 0) // TASK, 2 * rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(max(1, min(n, tasks)))


def replicate(spark: SparkSession, folder: str, to: str, spoilt: Column | None = None) -> None:
    """Copies the listed archives of ``folder``, and the index. ``spoilt``: for tests of the audit, a condition over the index;
    in the copies of such records one bit is turned."""
    hit = F.when(spoilt, F.col("offset") + F.expr("size div 2")) if spoilt is not None else F.lit(None).cast("long")
    archives = index(spark, folder).groupBy("archive").agg(F.sum("size").alias("size"), F.array_sort(F.collect_list(hit)).alias("hits"))  # as many as an archive has records

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (store, base), (far, there) = _store(folder), _store(to)
        far.create_dir(there, recursive=True)
        for batch in batches:
            for name, hits in zip(batch.column("archive").to_pylist(), batch.column("hits").to_pylist(), strict=True):
                with store.open_input_stream(f"{base}/{name}", compression=None) as a, far.open_output_stream(f"{there}/{name}", compression=None) as b:
                    at = 0
                    while part := bytearray(a.read(1 << 20)):
                        for h in hits:
                            if at <= h < at + len(part):
                                part[h - at] ^= 1
                        b.write(part)
                        at += len(part)
            yield pa.RecordBatch.from_arrays([batch.column("archive")], ["archive"])

    copied = settled(_dealt(archives, "size").mapInArrow(copy, "archive string"), "copied")
    index(spark, folder).join(copied, "archive", "left_semi").write.parquet(f"{to}/index")


def members(spark: SparkSession, folder: str, of: DataFrame | None = None) -> DataFrame:
    """``archive, ordinal, offset, size, member``: the stored bytes of each record of ``of`` (rows of the index; None: all), read
    by range; short or missing ones as they are."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        names = ["archive", "ordinal", "offset", "size", "member"]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            for name, ranges in zip(batch.column("archive").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                rows, held = [], 0
                try:
                    f = store.open_input_file(f"{base}/{name}")
                except FileNotFoundError:
                    f = None
                for r in ranges:
                    member = b""
                    if f is not None:
                        f.seek(min(r["offset"], f.size()))
                        member = f.read(r["size"])
                    rows.append((name, r["ordinal"], r["offset"], r["size"], member))
                    held += len(member)
                    if held >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
                if f is not None:
                    f.close()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    part = F.floor(F.col("offset") / PART)
    ranges = F.array_sort(F.collect_list(F.struct("ordinal", "offset", "size")))  # as many records as begin in the part
    parts = (index(spark, folder) if of is None else of).groupBy("archive", part.alias("part")).agg(F.sum("size").alias("bytes"), ranges.alias("ranges"))
    return _dealt(parts, "bytes").mapInArrow(read, "archive string, ordinal long, offset long, size long, member binary")


def write_tree(spark: SparkSession, folder: str, fanout: int = 16) -> int:
    """Writes ``tree`` for the bytes now in ``folder``: ``level, archive, node, first, last, digest``. Gives the number of levels.

    The last levels run over archives, in the order of their names, under archive ''.
    """
    ends = (F.col("offset") + F.col("size")).alias("last")
    leaf = F.sha2(F.concat_ws("|", "offset", "size", F.sha2("member", 256)), 256)
    level = members(spark, folder).select(F.lit(0).alias("level"), "archive", F.col("ordinal").alias("node"), F.col("offset").alias("first"), ends, leaf.alias("digest"))
    depth, across = 0, False
    while True:
        level.write.partitionBy("level").option("compression", "zstd").mode("append").parquet(f"{folder}/tree")
        below = tree_level(spark, folder, depth)
        n, archives = below.agg(F.count("*"), F.countDistinct("archive")).first()
        if n <= 1 and (across or archives == 0):
            return depth + 1
        depth += 1
        if not across and n == archives:  # every archive has its root: go on over the archives
            from .common import placed_in_order

            across = True
            placed = placed_in_order(below.drop("level"), [F.col("archive")], {}, "roots").select("place", F.col("archive").alias("name"), "digest")
            level = placed.select(F.lit(depth).alias("level"), F.lit("").alias("archive"), F.col("place").alias("node"), F.col("place").alias("first"), (F.col("place") + 1).alias("last"), F.sha2(F.concat_ws("|", "name", "digest"), 256).alias("digest"))
            continue
        children = F.array_sort(F.collect_list(F.struct("node", "digest")))
        grouped = below.groupBy("archive", F.floor(F.col("node") / fanout).cast("long").alias("parent")).agg(F.min("first").alias("first"), F.max("last").alias("last"), children.alias("children"))
        level = grouped.select(F.lit(depth).alias("level"), "archive", F.col("parent").alias("node"), "first", "last", F.sha2(F.array_join(F.transform("children", lambda c: c["digest"]), ""), 256).alias("digest"))


TREE = "archive string, node long, first long, last long, digest string, level int"


def tree_level(spark: SparkSession, folder: str, level: int) -> DataFrame:
    return spark.read.schema(TREE).parquet(f"{folder}/tree").where(F.col("level") == level)


def audit(spark: SparkSession, a: str, b: str, levels: int, fanout: int = 16) -> DataFrame:
    """``archive, ordinal, first, last`` of the records that differ between two replicas with the same index.

    Goes down from the root; at each level only children of nodes that differ are compared. Replicas that are equal give no
    rows after one comparison.
    """
    names = tree_level(spark, a, 0).select("archive").distinct()
    wrong = None
    for depth in range(levels - 1, -1, -1):
        pair = tree_level(spark, a, depth).drop("level"), tree_level(spark, b, depth).select("archive", "node", F.col("digest").alias("other"))
        if wrong is not None:
            pair = tuple(_below(x, wrong, fanout) for x in pair)
        found = pair[0].join(pair[1], ["archive", "node"], "full").where(~F.col("digest").eqNullSafe(F.col("other")))
        found = settled(found.select("archive", "node", "first", "last"), "differing")
        if not found.limit(1).count():
            break
        across = found.where("archive = ''").limit(1).count() > 0
        if across and not tree_level(spark, a, depth - 1).where("archive = ''").limit(1).count():
            # The lowest level over archives: its nodes are places in the order of names, its children the roots of archives.
            from .common import placed_in_order

            placed = placed_in_order(names, [F.col("archive")], {}, "names")
            wrong = placed.join(found.select(F.col("node").alias("place")), "place").select("archive", F.lit(0).cast("long").alias("parent"))
        else:
            wrong = found.select("archive", F.col("node").alias("parent"))
    return found.select("archive", F.col("node").alias("ordinal"), "first", "last")


def _below(level: DataFrame, wrong: DataFrame, fanout: int) -> DataFrame:
    """The nodes of ``level`` whose parent is among ``wrong``."""
    keyed = level.withColumn("parent", F.floor(F.col("node") / fanout).cast("long"))
    return keyed.join(wrong, ["archive", "parent"], "left_semi").drop("parent")


def blocks(found: DataFrame) -> DataFrame:
    """``archive, ordinal, sound, page_id, payload_bytes, payload_sha256`` of read records; those that aren't sound have nulls."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for member in batch.column("member").to_pylist():
                try:
                    headers, block = parsed(zlib.decompress(member, 31))
                    rows.append((True, int(headers["x-page-id"]) if "x-page-id" in headers else None, len(block), hashlib.sha256(block).hexdigest()))
                except (zlib.error, ValueError, KeyError):
                    rows.append((False, None, None, None))
            kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("archive"), batch.column("ordinal"), *columns], ["archive", "ordinal", "sound", "page_id", "payload_bytes", "payload_sha256"])

    return found.mapInArrow(made, "archive string, ordinal long, sound boolean, page_id long, payload_bytes long, payload_sha256 string")


def healed(spark: SparkSession, a: str, b: str, differing: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_sha256, damaged`` of each record: from ``b`` where the replicas agree, else from the one
    that is sound. A record that is sound in neither has nulls but for ``damaged``."""
    keys = ["archive", "ordinal"]
    listed, wrong = index(spark, b), settled(differing.select(*keys), "wrong")
    same = blocks(members(spark, b, listed.join(wrong, keys, "left_anti"))).select("page_id", "payload_bytes", "payload_sha256", (~F.col("sound")).alias("damaged"))
    asked = listed.join(wrong, keys, "left_semi")
    either = blocks(members(spark, a, asked)).unionByName(blocks(members(spark, b, asked)))
    best = either.groupBy(*keys).agg(F.max_by(F.struct("page_id", "payload_bytes", "payload_sha256"), F.col("sound").cast("int")).alias("x"))
    return same.unionByName(best.select("x.*", F.lit(True).alias("damaged")))


#: For the query: which records of the second replica are spoilt on their way, one in 32.
SPOILT = "substring(md5(cast(page_id as string)), 1, 2) < '08'"


def audited_pages(pages: DataFrame, label: str = "warc", spoilt: Column | None = None) -> DataFrame:
    """``page_id, payload_bytes, payload_sha256, damaged`` of each row of ``pages``, from records read back.

    Writes the archives, replicates them, builds the tree of each replica from its bytes, finds what differs by going down
    the trees, and reads all records, the damaged ones from the replica where they are sound. A null page is an empty block.
    Repeated rows are records of their own, a null ``page_id`` stays null, and an empty table gives no rows. ``spoilt``: see
    ``replicate``.
    """
    spark = pages.sparkSession
    first, second = new_folder(spark, f"{label}-a"), new_folder(spark, f"{label}-b")
    write_warc(pages, first)
    replicate(spark, first, second, spoilt)
    levels = write_tree(spark, first)
    write_tree(spark, second)
    return healed(spark, first, second, audit(spark, first, second, levels))


ORACLE_SQL = """
SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_sha256, coalesce(substring(md5(page_id::VARCHAR), 1, 2) < '08', FALSE) AS damaged FROM pages
"""
