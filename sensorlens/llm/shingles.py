"""Links between texts whose sets of word shingles have a Jaccard similarity of at least a share, all of them and no other.

1. A set for each text: a 64-bit hash of each of its shingles of ``words`` words. Equal sets have one digest and count once.
2. Sets are put in one order, rare shingles first. Two sets that are alike share a shingle among the first
   n - ceil(share n) + 1 of each, so only sets that meet in such a prefix are looked at. Which shingles are frequent a
   first round of prefixes counts over all sets, itself steered by a bounded sample; the order steers the work alone.
3. A long set goes in parts, which a hash deals its shingles to: of sets that differ in d shingles, some part differs in at
   most d / parts, and so they meet in the first d / parts + 1 of that part. Sets of a size have as many parts, each of 128 to
   255 shingles; near the border between two numbers of parts a set goes both ways, so that sets alike have one in common.
4. Each set and each part has a parity: for each of some bits, whether an odd number of its shingles falls there. Parities
   differ in at most as many bits as sets do in shingles, so this leaves out most sets that meet, and none that are alike.
   Where they meet the part's parity of 512 bits tells, which parts of that size it does well, however long the texts; what
   is left of the pairs the whole set's parity tells, and then the sets.
5. Candidates from elsewhere (those of the SimHash tree, ``simhash.tree_pairs``) are asked before all others, and none that hang
   together by them asks the other again. What the candidates miss the prefixes find.
6. Of the sets that meet, each then asks the one with the nearest parity; where many meet, the nearest of a few of them. Of
   what then doesn't hang together, all pairs that the parities allow are asked. Where a crowd meets, it is dealt into blocks:
   at first each asks in its own block and a few go to all; later those outside the crowd's largest group go to all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from .common import released, settled, settled_at, tidied

SEED = 42
WORDS, TENTHS = 5, 8
#: Least and greatest length of a parity, in powers of two of bits. Sets beyond some 50,000 shingles are told apart by size alone.
SHORTEST, LONGEST = 8, 16
#: Least number of shingles in a part on the average, and longs of its parity.
PART, SHORT = 128, 8
#: Bytes of text made into sets at once; a longer text is a slice of its own.
SLICE = 2_000_000
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def majority(hashes: np.ndarray) -> int:
    """The SimHash of 64-bit ``hashes``: the bits that are set in over half of them; 0 if there is none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text its different shingles, A-Z lowered, as sorted 64-bit hashes. A null or blank text has none; one of
    fewer words is one shingle, of all its words."""
    return (shingles for _, shingles in words_and_sets(texts, words))


def words_and_sets(texts: pa.Array, words: int = WORDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the XXH64 of all its words, A-Z lowered and repeats included, and its ``shingle_sets``."""
    import xxhash

    factors = np.random.default_rng(SEED).integers(0, 1 << 63, words, np.uint64) * np.uint64(2) + np.uint64(1)
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) // SLICE
    firsts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(texts)]
    for a, b in zip(firsts, firsts[1:], strict=False):
        part = pc.fill_null(texts.slice(a, b - a), "").cast(pa.large_string())
        bounds = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        raw = part.buffers()[2].to_pybytes()[bounds[0] : bounds[-1]].lower() if part.buffers()[2] else b""
        bounds, data = bounds - (bounds[0] if len(bounds) else 0), np.frombuffer(raw, np.uint8)
        space = SPACES[data]
        opens = np.ones(len(data), bool)
        opens[1:] = space[:-1]
        opens[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        begin = np.flatnonzero(opens & ~space)
        rank = np.cumsum(~space, dtype=np.int32)
        offsets = np.append(rank[begin] - 1, rank[-1] if len(rank) else 0).astype(np.int32)
        coded = pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data[~space])]).dictionary_encode()
        named = np.array([xxhash.xxh64_intdigest(w, SEED) for w in coded.dictionary.to_pylist()], np.uint64)
        word = named[coded.indices.to_numpy()] if len(named) else np.zeros(0, np.uint64)
        windows = np.zeros(max(0, len(word) - words + 1), np.uint64)
        for k, f in enumerate(factors):
            windows += word[k : k + len(windows)] * f
        windows = _mixed(windows).view(np.int64)
        ends = np.searchsorted(begin, bounds).tolist()
        for i, j in zip(ends, ends[1:], strict=False):
            if j - i >= words:
                yield word[i:j], np.unique(windows[i : j - words + 1])
            elif j > i:
                yield word[i:j], _mixed((word[i:j] * factors[: j - i]).sum(keepdims=True) + np.uint64(j - i)).view(np.int64)
            else:
                yield word[:0], windows[:0]


def levels(size: int, tenths: int = TENTHS) -> list[int]:
    """The powers of two of parts in which a set of ``size`` shingles is looked for; sets that may be alike have one in common."""
    level = lambda n: max(0, (n // PART).bit_length() - 1)
    return sorted({level(size), level(size * 10 // tenths)})


def parts(shingles: np.ndarray, level: int) -> np.ndarray:
    """The part of each of ``shingles``, by other bits than those of parities."""
    return (shingles.view(np.uint64) >> np.uint64(40)).astype(np.int64) & ((1 << level) - 1)


def level_key(shingles: np.ndarray, level: int) -> np.ndarray:
    """Names under which sets meet at ``level`` alone; the same again gives the shingles."""
    return shingles ^ np.int64(level * 0x5851F42D4C957F2D & (1 << 62) - 1)


def parity(shingles: np.ndarray, least: int = SHORTEST) -> np.ndarray:
    """Bit by bit whether an odd number of ``shingles`` falls there; at least two bits to a shingle, up to the greatest length."""
    bits = 1 << min(LONGEST, max(least, (2 * len(shingles)).bit_length()))
    return _odd(shingles & (bits - 1), bits)


def _odd(places: np.ndarray, bits: int) -> np.ndarray:
    return np.packbits((np.bincount(places, minlength=bits) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def part_parities(shingles: np.ndarray, tenths: int = TENTHS) -> np.ndarray:
    """``SHORT`` longs for each part of each of the set's levels."""
    width = 64 * SHORT
    return np.concatenate([_odd(parts(shingles, c) * width + (shingles & (width - 1)), width << c) for c in levels(len(shingles), tenths)])


def with_digests(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``row``, a struct of all columns of ``docs``, with ``digest``, which tells sets apart and is 0 for texts without a word,
    ``fp``, the SimHash of its words, ``size``, ``parity`` and ``shorts``, the parities of its parts."""
    names = ["digest", "fp", "size", "parity", "shorts"]

    @tidied
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                digests, fps, sizes, parities, shorts = [], [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for w, s in words_and_sets(pc.struct_field(batch.column("row"), "text"), words):
                    fps.append(majority(w))
                    digests.append(xxhash.xxh64_intdigest(s.tobytes(), SEED) if len(s) else 0)
                    sizes.append(len(s))
                    parities.append(parity(s))
                    shorts.append(part_parities(s))
                lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([*map(len, x)]), pa.int32()), pa.array(np.concatenate(x))) for x in (parities, shorts)]
                made_columns = [*(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (digests, fps)), pa.array(sizes, pa.int32()), *lists]
                yield pa.RecordBatch.from_arrays([batch.column("row"), *made_columns], ["row", *names])

    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    schema = StructType([*held.schema.fields]).add("digest", LongType()).add("fp", LongType()).add("size", IntegerType()).add("parity", ArrayType(LongType())).add("shorts", ArrayType(LongType()))
    return held.mapInArrow(made, schema)


def _fresh(batches: Iterator[pa.RecordBatch], at_once: int = 500, most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Slices of ``batches`` with each digest once, as far as the task remembers: copies would only say the same again."""
    done: set[int] = set()
    for batch in batches:
        for at in range(0, batch.num_rows, at_once):
            part = batch.slice(at, at_once)
            if len(done) > most:
                done.clear()
            new = [k for k, d in enumerate(part.column("digest").to_pylist()) if d not in done and not done.add(d)]
            yield part.take(pa.array(new, pa.int64()))


def shingled(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """``digest, shingles`` of ``texts`` (``digest, text``). Sets are larger than their texts, so they are made anew where they are read."""

    @tidied
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _fresh(batches, 100):
            sets = [np.zeros(0, np.int64), *shingle_sets(part.column("text"), words)]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([*map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets)))
            yield pa.RecordBatch.from_arrays([part.column("digest"), lists], ["digest", "shingles"])

    return texts.select("digest", "text").mapInArrow(made, "digest long, shingles array<long>")


def perhaps_in(keys: DataFrame, count: int, most_bits: int = 1 << 25):
    """``(rows, column) -> rows`` with ``perhaps``: true for all whose long ``column`` is among the one column of ``keys``, and
    for few others. One hash in a map of 16 bits for each of ``count`` keys, of ``most_bits`` at most, which is joined word by
    word; where that is too small to tell, it is true for all, without a map.
    """
    if 2 * count > most_bits:
        return lambda rows, column: rows.withColumn("perhaps", F.lit(True))
    bits = 1 << min(most_bits.bit_length() - 1, max(16, (16 * count).bit_length()))
    place = lambda column: F.pmod(F.xxhash64(column), F.lit(bits))
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), (at % 32).cast("int"))
    words = keys.select(place(keys.columns[0]).alias("at")).groupBy(F.expr("at div 32").alias("perhaps_word")).agg(F.bit_or(bit(F.col("at"))).alias("perhaps_set"))
    words = settled(words, "words")

    def marked(rows: DataFrame, column: str) -> DataFrame:
        at = place(column)
        joined = rows.withColumn("perhaps_at", at).join(F.broadcast(words), F.expr("perhaps_at div 32") == F.col("perhaps_word"), "left")  # bits / 32 rows at most
        told = F.coalesce(F.col("perhaps_set").bitwiseAND(bit(F.col("perhaps_at"))) != 0, F.lit(False))
        return joined.withColumn("perhaps", told).drop("perhaps_at", "perhaps_word", "perhaps_set")

    return marked


def _listed(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, counts) of the ``most`` greatest of ``s, n``, by shingle."""
    common = counts.select("s", "n").orderBy(F.col("n").desc(), "s").limit(most).toArrow()
    s, n = (common.column(c).to_numpy() for c in ("s", "n"))
    order = np.argsort(s)
    return s[order], n[order]


def sampled_counts(texts: DataFrame, sample_size: int) -> DataFrame:
    """``s, n``: shingles that stand in more than two texts of a sample of about ``sample_size``."""
    n = texts.count()
    part = texts.where(F.pmod(F.xxhash64("digest"), F.lit(1 << 30)) < int(min(1.0, sample_size / max(1, n)) * (1 << 30))).dropDuplicates(["digest"])
    return shingled(part).select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n")).where("n > 2")


MET = ["shingle", "digest", "level", "slot"]


def prefix_of(ordered: np.ndarray, tenths: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, level, place among the set's part parities) of what sets meet in, for shingles in their order."""
    n, before, out = len(ordered), 0, []
    for level in levels(n, tenths) if n else []:
        if level == 0:
            chosen, part = ordered[: n - (tenths * n + 9) // 10 + 1], 0
        else:  # whoever is alike differs in at most this many shingles of some part
            differ = n * (10 - tenths) // tenths >> level
            part = parts(ordered, level)
            order = np.argsort(part, kind="stable")
            sorted_part = part[order]
            chosen = order[np.arange(n) - np.searchsorted(sorted_part, sorted_part) <= differ]
            chosen, part = ordered[chosen], part[chosen]
        out.append((level_key(chosen, level), np.full(len(chosen), level, np.int32), np.zeros(len(chosen), np.int32) + np.int32(before) + np.asarray(part, np.int32)))
        before += 1 << level
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32))


def met_sets(texts: DataFrame, tenths: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``shingle, digest, level, slot``: the sets that meet in ``shingle``, where there are two or more. ``frequent``:
    (shingles, counts), the rare ones go first, and what isn't listed before all. A part has fewer shingles than may differ
    once in some 10 ** 20 sets."""
    sent = texts.sparkSession.sparkContext.broadcast(frequent)
    schema = "shingle long, digest long, level int, slot int"

    @tidied
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, often = sent.value
        for part in _fresh(batches):
            found = []
            for s in shingle_sets(part.column("text")):
                if len(names):
                    at = np.minimum(np.searchsorted(names, s), len(names) - 1)
                    s = s[np.argsort(np.where(names[at] == s, often[at], 0), kind="stable")]
                found.append(prefix_of(s, tenths))
            if found:
                digests = np.repeat(part.column("digest").to_numpy(zero_copy_only=False), [len(x[0]) for x in found])
                shingle, level, slot = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shingle, digests, level, slot)], MET)

    @tidied
    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows in order, those whose shingle another digest has too, each once. The last row waits for the next batch."""
        held, kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)], np.zeros(0, bool)
        for batch in batches:
            held = [np.concatenate([x, batch.column(c).to_numpy(zero_copy_only=False)]) for x, c in zip(held, MET)]
            s, d = held[:2]
            differ = np.ones(len(s), bool)
            differ[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
            held = [x[differ] for x in held]
            s = held[0]
            found, same = np.zeros(len(s), bool), s[1:] == s[:-1]
            found[: len(kept)] = kept
            found[1:] |= same
            found[:-1] |= same
            yield pa.RecordBatch.from_arrays([pa.array(x[:-1][found[:-1]]) for x in held], MET)
            held, kept = [x[-1:] for x in held], found[-1:]
        yield pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in held], MET)

    met = texts.mapInArrow(prefixes, schema)
    return met.repartition("shingle").sortWithinPartitions("shingle", "digest").mapInArrow(together, schema)


MEMBER = ["shingle", "block", "digest", "group", "size", "level", "crowd", "asks", "parity"]


def _cells(members: DataFrame, block: int, nearest: bool) -> DataFrame:
    """``members`` by shingle; those of a crowded one in blocks of about ``block``, with a few rows in all of them.

    These few are, at first, some drawn by a hash; later those outside the largest group, whose pairs are wanted.
    """
    counts = members.groupBy("shingle").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = members.join(counts, "shingle")
    if nearest:
        few = F.pmod(F.xxhash64("digest", F.lit(7)), 2 * F.col("blocks") * max(1, block // PIVOTS)) == 0
        dealt = dealt.withColumn("asks", (F.col("blocks") > 1) & few)
    else:
        largest = dealt.where("blocks > 1").groupBy("shingle", "group").agg(F.count("*").alias("n")).groupBy("shingle").agg(F.max_by("group", F.struct("n", "group")).alias("largest"))
        dealt = dealt.join(largest, "shingle", "left").withColumn("asks", (F.col("blocks") > 1) & (F.col("group") != F.col("largest")))
    own = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    every = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    dealt = dealt.withColumns({"block": F.explode(every), "crowd": F.col("blocks") > 1})
    return dealt.select(*MEMBER).repartition("shingle", "block").sortWithinPartitions("shingle", "block", F.desc("asks"), "digest")


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """(columns, first rows of cells) of runs of whole cells."""
    held: list[pa.RecordBatch] = []
    for batch in _and_none(batches):
        if batch is not None:
            held.append(batch)
        table = pa.Table.from_batches(held).combine_chunks() if held else None
        if table is None or not len(table):
            continue
        key = [table.column(c).to_numpy() for c in ("shingle", "block")]
        fresh = np.ones(len(table), bool)
        fresh[1:] = np.any([k[1:] != k[:-1] for k in key], axis=0)
        first = np.flatnonzero(fresh)
        upto = len(table) if batch is None else int(first[-1])
        if upto:
            part = table.slice(0, upto)
            columns = {c: part.column(c).to_numpy() for c in ("digest", "group", "size", "level", "block", "crowd", "asks")}
            columns["bits"] = pc.list_flatten(part.column("parity")).to_numpy().view(np.uint64)
            columns["words"] = pc.list_value_length(part.column("parity")).to_numpy().astype(np.int64)
            yield columns, first if batch is None else first[:-1]
        held = table.slice(upto).to_batches()


def _and_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


#: Cells of more sets than this don't ask by all pairs; at first their sets ask so many of them.
FEW, PIVOTS = 64, 32


def _pairs_of_cells(first: np.ndarray, columns: dict[str, np.ndarray], nearest: bool, at_once: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(earlier, later) rows of pairs of different groups inside cells, some at a time. All pairs, but with ``nearest`` in large
    cells only those with one of the cell's first rows."""
    group = columns["group"]
    lengths = np.diff(first, append=len(group))
    for n in np.unique(lengths[(lengths > 1) & (lengths <= FEW)]).tolist():
        at = first[lengths == n]
        i, j = np.triu_indices(n, 1)
        for c in range(0, len(at), max(1, at_once // len(i))):
            base = at[c : c + max(1, at_once // len(i)), None]
            yield (base + i).ravel(), (base + j).ravel()
    for a, n in zip(first[lengths > FEW].tolist(), lengths[lengths > FEW].tolist(), strict=True):
        rows = np.arange(a, a + n)
        if nearest:
            ask = rows[:PIVOTS]
        elif columns["crowd"][a]:
            ask = rows[columns["asks"][rows]]
        else:  # pairs inside the largest group aren't asked for
            names, own, sizes = np.unique(group[rows], return_inverse=True, return_counts=True)
            ask = rows[own != sizes.argmax()]
        asks = np.zeros(n, bool)
        asks[ask - a] = True
        again = not nearest and columns["crowd"][a] and columns["block"][a] > 0  # those that ask have met in the first block
        for c in range(0, len(ask), max(1, at_once // n)):
            i, j = np.repeat(ask[c : c + max(1, at_once // n)], n), np.tile(rows, len(ask[c : c + max(1, at_once // n)]))
            once = ~asks[j - a] | (i < j) & (not again)  # of two that ask, one does
            once &= i != j
            yield i[once], j[once]


def _parity_differs(i: np.ndarray, j: np.ndarray, bits: np.ndarray, words: np.ndarray) -> np.ndarray:
    """In how many bits the parities of rows ``i`` and ``j`` differ, the longer one folded."""
    begin, off, least = np.cumsum(words) - words, np.zeros(len(i), np.int64), np.minimum(words[i], words[j])

    def folded(rows: np.ndarray, to: int) -> np.ndarray:
        out = np.zeros((len(rows), to), np.uint64)
        for own in np.unique(words[rows]).tolist():
            here = np.flatnonzero(words[rows] == own)
            taken = bits[begin[rows[here]][:, None] + np.arange(own)].reshape(len(here), own // to, to)
            out[here] = np.bitwise_xor.reduce(taken, axis=1)
        return out

    for to in np.unique(least).tolist():
        all_here = np.flatnonzero(least == to)
        for at in range(0, len(all_here), max(1, 4_000_000 // to)):
            here = all_here[at : at + max(1, 4_000_000 // to)]
            off[here] = np.bitwise_count(folded(i[here], to) ^ folded(j[here], to)).sum(1, dtype=np.int64)
    return off


def asked_pairs(members: DataFrame, tenths: int, nearest: bool, block: int) -> DataFrame:
    """``a, b, group_a, group_b`` of sets in the same cell and of different groups that the parity allows to be alike, each once.

    ``nearest``: only that of the nearest parity for each.
    """
    names = ["a", "b", "group_a", "group_b"]

    @tidied
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, first in _whole_cells(batches):
            digest, group, size = columns["digest"], columns["group"], columns["size"].astype(np.int64)

            def out(i: np.ndarray, j: np.ndarray, digest=digest, group=group) -> pa.RecordBatch:
                i, j = np.where(digest[i] < digest[j], i, j), np.where(digest[i] < digest[j], j, i)
                once = np.unique(np.stack([digest[i], digest[j]]), axis=1, return_index=True)[1] if len(i) else i
                return pa.RecordBatch.from_arrays([pa.array(x[once]) for x in (digest[i], digest[j], group[i], group[j])], names)

            best, partner = np.full(len(digest), np.inf), np.full(len(digest), -1)
            for i, j in _pairs_of_cells(first, columns, nearest):
                x, y = size[i], size[j]
                may = (group[i] != group[j]) & (10 * np.minimum(x, y) >= tenths * np.maximum(x, y))
                i, j = i[may], j[may]
                off, both = _parity_differs(i, j, columns["bits"], columns["words"]), size[i] + size[j]
                may = (10 + tenths) * (off << columns["level"][i].astype(np.int64)) <= (10 - tenths) * both
                i, j, score = i[may], j[may], (off / both)[may]
                if not nearest:
                    yield out(i, j)
                    continue
                row, other, score = np.concatenate([i, j]), np.concatenate([j, i]), np.tile(score, 2)
                order = np.lexsort((other, score, row))
                row, other, score = row[order], other[order], score[order]
                least = np.unique(row, return_index=True)[1]
                row, other, score = row[least], other[least], score[least]
                better = score < best[row]
                best[row[better]], partner[row[better]] = score[better], other[better]
            found = np.flatnonzero(partner >= 0)
            yield out(found, partner[found])

    pairs = _cells(members, block, nearest).mapInArrow(made, "a long, b long, group_a long, group_b long")
    return pairs.dropDuplicates(["a", "b"])


def still_asked(pairs: DataFrame, sketches: DataFrame, tenths: int) -> DataFrame:
    """The ``pairs`` that the whole parities allow. ``sketches``: ``digest, size, parity``."""
    names = pairs.columns

    @tidied
    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 1_000) for whole in batches for at in range(0, whole.num_rows, 1_000)):
            lists = pa.concat_arrays([batch.column("parity_a"), batch.column("parity_b")])
            bits, words = pc.list_flatten(lists).to_numpy(zero_copy_only=False).view(np.uint64), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.arange(batch.num_rows)
            both = batch.column("size_a").to_numpy().astype(np.int64) + batch.column("size_b").to_numpy()
            keep = (10 + tenths) * _parity_differs(at, at + batch.num_rows, bits, words) <= (10 - tenths) * both
            yield batch.select(names).filter(pa.array(keep))

    side = lambda c: sketches.select(F.col("digest").alias(c), F.col("size").alias(f"size_{c}"), F.col("parity").alias(f"parity_{c}"))
    both = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    return both.select(*names, "size_a", "size_b", "parity_a", "parity_b").mapInArrow(allowed, pairs.schema)


def sketched(rows: DataFrame, digests: DataFrame, *columns: str) -> DataFrame:
    """``digest`` and ``columns`` of ``rows``, once for each of ``digests`` and perhaps for a few others."""
    some = perhaps_in(digests, digests.count())(rows.select("digest", *columns), "digest").where("perhaps")
    return some.groupBy("digest").agg(*(F.first(c).alias(c) for c in columns))


def verified(pairs: DataFrame, texts: DataFrame, tenths: int) -> DataFrame:
    """The ``pairs`` whose sets are alike, written, from ``texts`` (``digest, text``). Only the sets that are asked for are made, once."""
    asked, asked_at = settled_at(pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct(), "asked")
    near = shingled(perhaps_in(asked, asked.count())(texts.select("digest", "text"), "digest").where("perhaps"))
    sets, sets_at = settled_at(near.join(asked.hint("merge"), "digest", "left_semi").groupBy("digest").agg(F.first("shingles").alias("shingles")), "sets")
    left, right = (sets.select(F.col("digest").alias(c), F.col("shingles").alias(f"s_{c}")) for c in "ab")
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    alike = settled(both.where((10 + tenths) * F.size(F.array_intersect("s_a", "s_b")) >= tenths * (F.size("s_a") + F.size("s_b"))).select(*pairs.columns), "alike")
    for path in (asked_at, sets_at):
        released(pairs.sparkSession, path)
    return alike


def set_groups(rows: DataFrame, candidates: DataFrame, components, tenths: int = TENTHS, sample_size: int = 5_000, listed: int = 100_000, block: int = 2_048) -> DataFrame:
    """``node, root`` for each ``digest`` of ``rows`` (``digest, text, size, parity, shorts``) whose shingles have a Jaccard
    similarity of ``tenths`` / 10 or more with another's; ``root`` is the same for all that hangs together.

    ``candidates``: written pairs ``a < b`` of digests that are asked first; which they are changes the work alone.
    ``components`` makes ``node, root`` of links ``a, b``. In the worst case, many sets that share rare shingles and nearly are
    alike but aren't, the pairs to verify grow with the square of their number.
    """
    spark, texts = rows.sparkSession, rows.select("digest", "text")
    named, named_at = settled_at(candidates.select(F.explode(F.array("a", "b")).alias("digest")).distinct(), "named")
    known, known_at = settled_at(sketched(rows, named, "size", "parity"), "known")
    likely, likely_at = settled_at(still_asked(candidates, known, tenths), "likely")
    linked = verified(likely, texts, tenths)
    for path in (named_at, known_at, likely_at):
        released(spark, path)
    sampled = settled(sampled_counts(texts, sample_size), "sampled")
    tried, tried_at = settled_at(met_sets(texts, tenths, _listed(sampled, listed)), "tried")
    counted = _by_shingle(tried).groupBy("s").agg(F.count("*").alias("n")).where("n > 2")
    last = sampled.withColumn("n", F.col("n") + F.lit(1 << 40))  # what the sample knew stays last
    met = settled(met_sets(texts, tenths, _listed(counted.unionByName(last), 5 * listed)), "met")
    released(spark, tried_at)
    sketches = settled(sketched(rows, met.select("digest").distinct(), "size", "parity", "shorts"), "sketches")
    shorts = sketches.select(F.col("digest").alias("_digest"), "size", "shorts")
    part = F.slice("shorts", F.col("slot") * SHORT + 1, SHORT).alias("parity")
    with_parity = lambda tagged: tagged.join(shorts.hint("merge"), F.col("digest") == F.col("_digest")).select("shingle", "digest", "group", "size", "level", part)
    # Sets with one label hang together by candidates, if not yet all that do.
    labels = linked.groupBy(F.col("b").alias("digest")).agg(F.min("a").alias("label"))
    labelled = met.join(labels.hint("merge"), "digest", "left").select(*MET, F.coalesce("label", "digest").alias("group"))
    members, members_at = settled_at(with_parity(labelled), "members")

    first = settled(still_asked(asked_pairs(members, tenths, True, block), sketches, tenths), "first")
    released(spark, members_at)
    grouped = settled(components(verified(first, texts, tenths).select("a", "b").unionByName(linked)), "grouped")
    # What still is to be asked meets where there is more than one group; most shingles have one by now, and need no parity.
    tagged = met.join(grouped.hint("merge"), F.col("digest") == F.col("node"), "left").select(*MET, F.coalesce("root", "digest").alias("group"))
    mixed = tagged.groupBy("shingle").agg(F.min("group").alias("least"), F.max("group").alias("most")).where("least < most").select("shingle")
    apart = settled(with_parity(tagged.join(mixed.hint("merge"), "shingle", "left_semi")), "apart")
    rest = asked_pairs(apart, tenths, False, block).join(first.select("a", "b").unionByName(candidates).hint("merge"), ["a", "b"], "left_anti")
    rest = settled(still_asked(rest, sketches, tenths), "rest")
    joined = settled(components(verified(rest, texts, tenths).select(F.col("group_a").alias("a"), F.col("group_b").alias("b"))).select(F.col("node").alias("_node"), F.col("root").alias("_root")), "joined")
    own = grouped.join(joined.hint("merge"), F.col("root") == F.col("_node"), "left").select("node", F.coalesce("_root", "root").alias("root"))
    alone = joined.join(grouped.hint("merge"), F.col("_node") == F.col("node"), "left_anti").select(F.col("_node").alias("node"), F.col("_root").alias("root"))
    return own.unionByName(alone)


def _by_shingle(met: DataFrame) -> DataFrame:
    """``s`` of the rows of ``met``: the shingles behind the names of their levels."""

    @tidied
    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, level = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shingle", "level"))
            out = s.copy()
            for c in np.unique(level).tolist():
                out[level == c] = level_key(s[level == c], c)
            yield pa.RecordBatch.from_arrays([pa.array(out)], ["s"])

    return met.select("shingle", "level").mapInArrow(names, "s long")
