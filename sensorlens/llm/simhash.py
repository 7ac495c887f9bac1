"""SimHash near-duplicates through a vantage-point tree.

1. A 64-bit fingerprint for each text, from its word shingles.
2. A tree over the different fingerprints. A node holds a vantage point and a radius: fingerprints within the radius are
   inside, others outside. It is built on the driver from a bounded sample (``sample_size``), has a bounded number of
   shards, and is broadcast. Sampling shapes the shards alone; what links is the same for any tree.
3. Each fingerprint lives in one shard, and visits each later shard that its ball of ``radius`` bits may reach: by the
   triangle inequality the inside can be left out if it is farther than radius + ball from the vantage point, the outside
   if it is nearer than radius - ball. Each shard compares what lives there with itself and its visitors, in blocks, and
   returns for each fingerprint that has a link the least one it hangs together with there.
4. A shard that holds too many gets a tree of its own, grown in a task from a bounded sample of it, so that the shards grow
   with the table. These trees are a table, and each meets its shard's fingerprints, in pieces, and no others. One that stays dense, because near copies crowd in a few bits where no radius parts them, isn't compared
   pair by pair: fingerprints within two bits have a common value within one bit of each, so its fingerprints are dealt out
   by their 65 values within one bit, and those that meet, at most 65, are linked. This is exact, and linear in the shard.
5. Links between shards become components by alternating large and small stars, a written table after each round.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import released, settled, settled_at
from .shingles import majority, perhaps_in, set_groups, with_digests

SEED = 42
LINK_BITS = 2


# --- fingerprints


def fingerprint(text: str | None, words: int = 3) -> int:
    """Bit by bit the majority of the XXH64 of the shingles of ``text``, A-Z lowered; 0 if there is no word."""
    import xxhash

    found = (text or "").encode().lower().split()  # of bytes both take ASCII alone
    if not found:
        return 0
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    width = min(words, len(found))
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], SEED) for a, b in zip((ends - sizes)[: len(found) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)], "<u8"))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id, fp`` with ``fp`` the fingerprint as a signed long."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(made, "doc_id long, fp long")


# --- the tree


@dataclass(frozen=True)
class Node:
    vantage: int
    radius: int
    inside: "Node | int"  # a shard's number at the leaves, rising from inside to outside
    outside: "Node | int"


def build_tree(sample: np.ndarray, leaf: int, seed: int = 7) -> Node | int:
    """A tree with shards of at most about ``leaf`` of the sample. Vantage points are those that spread distances most."""
    rng, shards = np.random.default_rng(seed), [0]

    def grow(points: np.ndarray, depth: int) -> Node | int:
        if len(points) > leaf and depth < 24:
            best = None
            for v in rng.choice(points, min(12, len(points)), replace=False):
                d = np.bitwise_count(points ^ v)
                spread = float(d.std())
                if best is None or spread > best[0]:
                    best = (spread, v, d)
            _, v, d = best
            # Of the radii that part the points evenly enough, the one that fewest balls cross.
            values = np.arange(0, 64)
            inside = np.searchsorted(np.sort(d), values, side="right")
            even = np.minimum(inside, len(d) - inside) >= 0.35 * len(d)
            if not even.any():
                even = np.minimum(inside, len(d) - inside) >= max(1, 0.1 * len(d))
            if even.any():
                crossing = [int(((d >= r - LINK_BITS + 1) & (d <= r + LINK_BITS)).sum()) for r in values[even]]
                r = int(values[even][int(np.argmin(crossing))])
                return Node(int(v), r, grow(points[d <= r], depth + 1), grow(points[d > r], depth + 1))
        shards[0] += 1
        return shards[0] - 1

    return grow(np.asarray(sample, np.uint64), 0)


def visits(tree: Node | int, fps: np.ndarray, ball: int = LINK_BITS, guests: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, lives there) for the home of each fingerprint and for each later shard that its ball may reach.

    ``guests``: rows that live nowhere here and visit every shard that their ball may reach.
    """
    rows, shards, home = [], [], np.zeros(len(fps), np.int32)
    stack = [(tree, np.arange(len(fps)), np.ones(len(fps), bool))]
    while stack:
        node, at, lives = stack.pop()
        if not len(at):
            continue
        if not isinstance(node, Node):
            home[at[lives]] = node
            rows.append(at)
            shards.append(np.full(len(at), node, np.int32))
            continue
        d = np.bitwise_count(fps[at] ^ np.uint64(node.vantage)).astype(np.int16)
        near, far = d - ball <= node.radius, d + ball > node.radius
        stack.append((node.inside, at[near], (lives & (d <= node.radius))[near]))
        stack.append((node.outside, at[far], (lives & (d > node.radius))[far]))
    row, shard = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, shards))
    lives = shard == home[row]
    keep = shard >= home[row]
    if guests is not None:
        lives, keep = lives & ~guests[row], keep | guests[row]
    return row[keep], shard[keep], lives[keep]


# --- inside a shard


def shard_links(fps: np.ndarray, lives: np.ndarray, ball: int = LINK_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, least one it hangs together with here) of all that have a link to one that lives here."""
    members = fps[lives]
    everyone = np.concatenate([members, fps[~lives]])
    label = np.arange(len(everyone))
    linked = np.zeros(len(everyone), bool)
    step = max(1, 2_000_000 // max(1, len(members)))
    for at in range(0, len(everyone), step):
        i, j = np.nonzero(np.bitwise_count(everyone[at : at + step, None] ^ members[None, :]) <= ball)
        i += at
        i, j = i[i > j], j[i > j]
        linked[i] = linked[j] = True
        a, b = label[i], label[j]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)])[:, a != b], axis=1)
        if pairs.shape[1]:
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while x in root:
                    x = root[x]
                return x

            for p, q in pairs.T.tolist():
                p, q = find(p), find(q)
                if p != q:
                    root[max(p, q)] = min(p, q)
            for x in list(root):
                root[x] = find(x)
            table = np.arange(len(everyone))
            table[list(root)] = list(root.values())
            label = table[label]
    nodes, label = everyone[linked].view(np.int64), label[linked]
    least = np.full(len(everyone), np.iinfo(np.int64).max)
    np.minimum.at(least, label, nodes)
    return nodes, least[label]


#: A fingerprint where it lives or visits; ``part`` is the shard of the shard's own tree, 0 where it has none.
PLACED = "shard int, part int, fp long, lives boolean"


def _sample_of(column: str, share) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(1 << 30)) < share * (1 << 30)


def _heavy(placed: DataFrame, dense: int) -> DataFrame:
    """``shard, part, n`` of the shards that hold too many; of a bounded number of shards."""
    sizes = placed.groupBy("shard", "part").agg(F.count("*").alias("n"), F.sum(F.col("lives").cast("long")).alias("living"))
    return sizes.where((F.col("living") > dense) | (F.col("n") > 16 * dense)).select("shard", "part", "n")


def _own_trees(placed: DataFrame, heavy: DataFrame, sample_size: int, leaves: int) -> DataFrame:
    """``shard, tree``: a pickled tree for each of the ``heavy`` shards, grown in tasks from about ``sample_size`` fingerprints each;
    its shards hold ``sample_size / leaves`` of the sample at most."""

    def grow(sample: pa.Table) -> pa.Table:
        points = np.sort(sample.column("fp").to_numpy().view(np.uint64))
        tree = pickle.dumps(build_tree(points, max(4, len(points) // leaves)))
        return pa.table({"shard": sample.column("shard").slice(0, 1), "tree": pa.array([tree], pa.binary())})

    shares = F.broadcast(heavy.select("shard", F.least(F.lit(1.0), F.lit(sample_size) / F.col("n")).alias("share")))  # of a bounded number of shards
    sampled = placed.join(shares, "shard").where(_sample_of("fp", F.col("share"))).select("shard", "fp")
    return sampled.groupBy("shard").applyInArrow(grow, "shard int, tree binary")


def _parted(placed: DataFrame, heavy: DataFrame, trees: DataFrame, piece: int = 32_768) -> DataFrame:
    """What is ``placed`` in ``heavy`` shards, dealt to the shards of their own trees. A shard goes in pieces of some ``piece``
    fingerprints, each of which meets the shard's tree, so that no task holds more than one piece and one tree at a time."""

    def part(rows: pa.Table, grown: pa.Table) -> pa.Table:
        tree = pickle.loads(grown.column("tree")[0].as_py()) if len(grown) else 0
        shards, fps, lives = (rows.column(c).to_numpy() for c in ("shard", "fp", "lives"))
        made = []
        for at in range(0, len(fps), 2_000):
            some = slice(at, at + 2_000)
            row, own, home = visits(tree, fps[some].view(np.uint64), guests=~lives[some].astype(bool))
            made.append(pa.table({"shard": shards[some][row].astype(np.int32), "part": own.astype(np.int32), "fp": fps[some][row], "lives": home}))
        return pa.concat_tables(made) if made else pa.table({"shard": pa.array([], pa.int32()), "part": pa.array([], pa.int32()), "fp": pa.array([], pa.int64()), "lives": pa.array([], pa.bool_())})

    pieces = heavy.select("shard", F.ceil(F.col("n") / piece).cast("int").alias("pieces"))
    rows = placed.join(F.broadcast(pieces), "shard").withColumn("piece", F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int"))  # of a bounded number of shards
    grown = trees.join(pieces, "shard").select("shard", "tree", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    return rows.groupBy("shard", "piece").cogroup(grown.groupBy("shard", "piece")).applyInArrow(part, PLACED)


def fingerprint_links(groups: DataFrame, sample_size: int = 65_536, shard_size: int = 4_096, dense: int = 32_768, leaves: int = 256) -> DataFrame:
    """``a, b`` with ``b < a``: links between different fingerprints ``fp`` of ``groups``, as many as make the components."""
    spark = groups.sparkSession
    n = groups.count()
    sample = np.array([r.fp for r in groups.where(_sample_of("fp", min(1.0, sample_size / max(1, n)))).select("fp").collect()], np.int64).view(np.uint64)
    sample.sort()
    tree = spark.sparkContext.broadcast(build_tree(sample, max(16, round(shard_size * len(sample) / max(1, n)))))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 2_000):
                row, shard, lives = visits(tree.value, fps[at : at + 2_000])
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(np.zeros(len(row), np.int32)), pa.array(fps[at : at + 2_000][row].view(np.int64)), pa.array(lives)], ["shard", "part", "fp", "lives"])

    placed = settled(groups.select("fp").mapInArrow(dealt, PLACED), "shards")
    heavy = settled(_heavy(placed, dense), "heavy")
    crowded = None
    if not heavy.isEmpty():
        trees = settled(_own_trees(placed, heavy, sample_size // 8, leaves), "trees")
        parts = settled(_parted(placed, heavy, trees), "parts")
        crowded = settled(_heavy(parts, dense).select("shard", "part"), "crowded")
        rest = placed.join(F.broadcast(heavy.select("shard")), "shard", "left_anti")  # of a bounded number of shards
        placed = rest.select(*parts.columns).unionByName(parts)

    def compare(shard: pa.Table) -> pa.Table:
        fps, lives = shard.column("fp").to_numpy(), shard.column("lives").to_numpy()
        a, b = shard_links(fps.view(np.uint64), lives.astype(bool))
        keep = a != b
        return pa.table({"a": a[keep], "b": b[keep]})

    light = placed if crowded is None else placed.join(crowded, ["shard", "part"], "left_anti").select(*placed.columns)
    found = light.groupBy("shard", "part").applyInArrow(compare, "a long, b long")
    if crowded is not None:
        full = placed.join(crowded, ["shard", "part"], "left_semi")
        bit = F.sequence(F.lit(0), F.lit(63))
        near = F.concat(F.array("fp"), F.transform(bit, lambda k: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k))))
        meet = full.select("shard", "part", "fp", F.explode(near).alias("value"))
        met = meet.groupBy("shard", "part", "value").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)  # 65 at most
        pairs = met.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a <> b").distinct()
        found = found.unionByName(pairs)
    return found


# --- components


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """``node, root`` for each node of the links ``a, b``, where ``root`` is the least node of its component."""
    spark = links.sparkSession
    edges, held = settled_at(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large, wide = settled_at(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges, new = settled_at(small.where("a <> b").distinct(), "edges")
        for path in (held, wide):
            released(spark, path)
        held = new
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        mark = now
    raise RuntimeError(f"components haven't settled after {most_rounds} rounds")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs``; ``component_id`` is the least ``doc_id`` it reaches.

    Null, empty and blank texts have fingerprint 0 and are linked like any other. Rows with equal ``doc_id`` stay rows of
    their own. A null ``doc_id`` takes its component's least other id, or null if there is none. An empty table gives no
    rows.
    """
    marked = settled(fingerprints(docs), "fingerprints")
    groups = settled(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "groups")
    found = components(fingerprint_links(groups, **options))
    joined = groups.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    own = settled(joined.join(least, "root").where("n > 1 or component_id <> first or first is null").select("fp", "component_id"), "components")
    out = marked.join(own, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))


def tree_pairs(marks: DataFrame, **options) -> DataFrame:
    """``a, b`` with ``a < b``, written: candidates among the ``digest`` of ``marks`` (``digest, fp``) from the tree over their fingerprints.

    Those of one fingerprint meet the least of them, and the least of each fingerprint that of the one the tree links it
    to: no more pairs than rows and links, however many hang together.
    """
    groups = settled(marks.groupBy("fp").agg(F.min("digest").alias("least")), "groups")
    own = marks.join(groups.hint("merge"), "fp").select(F.col("least").alias("a"), F.col("digest").alias("b"))
    side = lambda c: groups.select(F.col("fp").alias(c), F.col("least").alias(f"least_{c}"))
    links = fingerprint_links(groups, **options).join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    pairs = own.unionByName(links.select(F.col("least_a").alias("a"), F.col("least_b").alias("b")))
    return settled(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "pairs")


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One row of ``docs``, with all its columns, for each group of near copies.

    Near copies are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and what hangs together
    by them; texts without a word are one group. The row with the least ``doc_id`` stays, of equal ones the first written.
    Rows without ``doc_id`` all stay.

    The tree over SimHashes of single words, which a few changed words move less than those of shingles, finds candidates
    within two bits, and their sets are compared. Alike texts that differ in more bits are found by their shingles.
    """
    # All columns of the given rows are carried in a struct, so that no name of theirs meets one of these.
    made = with_digests(docs).withColumn("near", F.monotonically_increasing_id())
    rows, held = settled_at(made, "rows")
    texts = rows.select("digest", F.col("row.text").cast("string").alias("text"), "size", "parity", "shorts")
    marks = settled(rows.select("digest", "fp").distinct(), "fingerprints")
    found = settled(set_groups(texts, tree_pairs(marks), components, **options), "components")
    ids = rows.select("near", F.col("row.doc_id").alias("doc_id"), "digest")
    marked = ids.join(found.hint("merge"), F.col("digest") == F.col("node"), "left")
    marked = settled(marked.select("near", F.coalesce("root", "digest").alias("root"), "doc_id"), "marked")
    groups = marked.where("doc_id is not null").groupBy("root").agg(F.min(F.struct("doc_id", "near")).alias("first"), F.count("*").alias("n")).where("n > 1").select("root", F.col("first.near").alias("stays"))
    drop = marked.join(groups.hint("merge"), "root").where("near <> stays and doc_id is not null").select("near")
    # The rows to drop grow with the documents: they are never broadcast, and the plan is the same at every size. A small
    # map of their hashes lets the rows pass that are surely not among them.
    drop = settled(drop, "drop")
    told = perhaps_in(drop, drop.count())(rows.select("near", "row"), "near")
    asked = told.where("perhaps").join(drop.hint("merge"), "near", "left_anti").select("row")
    return told.where("not perhaps").select("row").unionByName(asked).select("row.*")
