"""Token counts: pieces are counted once for each distinct pre-token and summed over pre-token frequencies.

A byte-level BPE merges inside pre-tokens only, so a text's token count is the sum, over its distinct pre-tokens, of
frequency times pieces. Three steps, none of which makes token ids for a document:

1. One pass finds every distinct pre-token and in how many documents it stands.
2. Each distinct pre-token is encoded once.
3. A second pass takes each document's pre-token frequencies and joins them to those counts. Frequent pre-tokens are
   joined in place, against a broadcast of at most ``head_size`` of them; all others are joined by a shuffle. Every key of
   that shuffle stands in fewer documents than each key of the broadcast, so none of them is hot.
"""

from __future__ import annotations

import math
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import settled

#: Fixed value: the split that byte-level BPE makes before merging.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A task's own table of document frequencies is sent on when it holds so many pre-tokens.
FLUSH_AT = 400_000


@lru_cache(maxsize=2)
def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    if not os.path.exists(path):  # a worker that has the files elsewhere
        import public_tokenizers

        path = public_tokenizers.path(os.path.basename(path))
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@lru_cache(maxsize=2)
def pre_tokenizer(path: str):
    """A function from text to its pre-tokens; special strings, which the library finds first, count as one each."""
    import json

    import regex

    tok = load_tokenizer(path)
    plan = json.loads(tok.to_str())
    pre = plan["pre_tokenizer"] or {}
    if plan["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex"):
        raise ValueError("pre-token counts need a byte-level tokenizer without normalizer or prefix space")
    if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in plan["added_tokens"]):
        raise ValueError("added tokens that take in their surroundings aren't supported")
    find = regex.compile(BYTE_LEVEL_PATTERN).findall
    added = sorted((a["content"] for a in plan["added_tokens"]), key=len, reverse=True)
    if not added:
        return find
    special, at = set(added), re.compile("(" + "|".join(map(re.escape, added)) + ")")

    def split(text: str) -> list[str]:
        if not any(a in text for a in added):
            return find(text)
        return [p for part in at.split(text) for p in ([part] if part in special else find(part))]

    return split


def _texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [t or "" for t in batch.column(name).to_pylist()]


def distinct_pretokens(docs: DataFrame, path: str) -> DataFrame:
    """``pretoken, n_docs``: each pre-token of the texts, and the number of documents it stands in."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held = pre_tokenizer(path), Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["pretoken", "n_docs"])

        for batch in batches:
            for text in _texts(batch):
                held.update(set(split(text)))
                if len(held) > FLUSH_AT:
                    yield out()
                    held.clear()
        yield out()

    found = docs.select("text").mapInArrow(count, "pretoken string, n_docs long")
    return found.groupBy("pretoken").agg(F.sum("n_docs").alias("n_docs"))


def with_pieces(pretokens: DataFrame, path: str) -> DataFrame:
    """Adds ``n_pieces``, by encoding each pre-token once."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load_tokenizer(path)
        for batch in batches:
            got = tok.encode_batch_fast(_texts(batch, "pretoken"), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(x) for x in got], pa.int64())], ["pretoken", "n_docs", "n_pieces"])

    return pretokens.mapInArrow(pieces, "pretoken string, n_docs long, n_pieces long")


def head_threshold(pretokens: DataFrame, head_size: int) -> int:
    """The least document frequency that at most ``head_size`` pre-tokens reach."""
    step = F.floor(F.log2("n_docs") * 4).cast("int")
    sizes = pretokens.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()  # some 250 rows at most
    at, total = 0.0, 0
    for row in sorted(sizes, key=lambda r: -r["step"]):
        if total + row["n"] > head_size:
            at = (row["step"] + 1) / 4
            break
        total += row["n"]
    least = max(1, math.floor(2**at))
    while math.floor(math.log2(least) * 4) < at * 4:
        least += 1
    return least


def token_counts(docs: DataFrame, path: str, over: int = 1024, head_size: int = 200_000) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs``, whole texts counted.

    A null or empty text has 0 bytes and 0 tokens. Rows with equal or null ``doc_id`` stay rows of their own. Of an
    empty table the result is empty. Columns other than ``doc_id`` and ``text`` aren't read.
    """
    spark = docs.sparkSession
    vocab = settled(with_pieces(distinct_pretokens(docs, path), path), "pretokens")
    least = head_threshold(vocab, head_size)
    head_rows = vocab.where(F.col("n_docs") >= least).select("pretoken", "n_pieces").toArrow()
    head = spark.sparkContext.broadcast(dict(zip(head_rows[0].to_pylist(), head_rows[1].to_pylist(), strict=True)))
    kind = "row_id long, doc_id long, n_bytes long, head_tokens long, tail array<struct<pretoken: string, n: long>>"

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known = pre_tokenizer(path), head.value
        tail_type = pa.list_(pa.struct([("pretoken", pa.string()), ("n", pa.int64())]))
        for batch in batches:
            sizes, sums, tails = [], [], []
            for text in _texts(batch):
                total, rest = 0, []
                for piece, n in Counter(split(text)).items():
                    if (pieces := known.get(piece)) is None:
                        rest.append({"pretoken": piece, "n": n})
                    else:
                        total += n * pieces
                sizes.append(len(text.encode()))
                sums.append(total)
                tails.append(rest)
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(tails, tail_type)], ["row_id", "doc_id", "n_bytes", "head_tokens", "tail"])

    numbered = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = settled(numbered.mapInArrow(frequencies, kind), "frequencies")
    tail = base.select("row_id", F.explode("tail").alias("t")).select("row_id", "t.pretoken", "t.n")
    rare = vocab.where(F.col("n_docs") < least).select("pretoken", "n_pieces")
    sums = tail.join(rare, "pretoken").groupBy("row_id").agg(F.sum(F.col("n") * F.col("n_pieces")).alias("tail_tokens"))
    n = F.col("head_tokens") + F.coalesce("tail_tokens", F.lit(0))
    return base.drop("tail").join(sums, "row_id", "left").select("doc_id", "n_bytes", n.alias("n_tokens"), (n > over).alias("over_limit"))
