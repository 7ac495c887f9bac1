"""Language identification by nearest centroid.

Texts become TF-IDF vectors over hashed three-byte grams, of length one. For each language several centroids are clustered
from labelled texts, and a text takes the language of the centroid with the greatest cosine; it is rejected if even that is
lower than nearly all of that language's training texts were. The model is fitted on at most about ``per_language`` rows a
language, chosen by a hash; prediction reads every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

DIMENSIONS = 1 << 13
UNKNOWN = "und"


#: ASCII bytes other than letters become spaces.
LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(dimensions, counts) of the three-byte grams of the lower-cased words, each between single spaces."""
    total = np.zeros(DIMENSIONS, np.int64)
    raw = b" " + b" ".join(text.lower().encode().translate(LETTERS).split()) + b" "
    for at in range(0, len(raw) - 2, 1 << 20):  # a very long text passes in parts, which share the bytes of a gram
        b = np.frombuffer(raw, np.uint8, min(len(raw) - at, (1 << 20) + 2), at).astype(np.uint32)
        h = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(15)
        total += np.bincount((h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - 13), minlength=DIMENSIONS)
    where = np.flatnonzero(total)
    return where, total[where]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # one row each, of length one
    idf: np.ndarray
    least: np.ndarray  # the cosine below which a text is rejected, for each centroid

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine, rejected)"""
        if not has_letter(text) or not self.languages:
            return UNKNOWN, 0.0, True
        where, counts = gram_counts(text)
        values = np.log1p(counts) * self.idf[where]
        length = float(np.sqrt(values @ values))
        cosines = self.centroids[:, where] @ values / length if length else np.zeros(len(self.languages))
        k = int(np.argmax(cosines))
        score = min(1.0, max(0.0, float(cosines[k])))
        return self.languages[k], score, score < self.least[k]


def _vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for row, text in zip(out, texts, strict=True):
        where, counts = gram_counts(text)
        row[where] = np.log1p(counts) * idf[where]
        row /= max(1e-9, float(np.linalg.norm(row)))
    return out


def cluster(vectors: np.ndarray, most: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(centroids of length one, cosine of each row to its own), by spherical k-means from far-apart seeds."""
    seeds = [vectors.mean(0)]
    nearest = vectors @ seeds[0]
    picks = []
    for _ in range(min(most, len(vectors))):
        picks.append(vectors[int(np.argmin(nearest))] * 0.5 + seeds[0] * 0.5 if picks else seeds[0])
        nearest = np.maximum(nearest, vectors @ picks[-1])
    centroids = np.stack(picks)
    for _ in range(rounds):
        centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-9)
        own = np.argmax(vectors @ centroids.T, axis=1)
        centroids = np.stack([vectors[own == k].mean(0) if (own == k).any() else centroids[k] for k in range(len(centroids))])
    centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-9)
    return centroids, (vectors @ centroids.T).max(1)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, per_language: int = 1_000, clusters: int = 4, slack: float = 0.8) -> Model:
    """A model from the rows with a text, a language and an id that isn't held out.

    ``slack``: a text is rejected below this share of the cosine that one in 200 training texts falls below.
    """
    known = docs.where("text is not null and lang is not null and doc_id is not null").where(~held_out())
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row for each language
    if not sizes:
        return Model([], np.zeros((0, DIMENSIONS), np.float32), np.zeros(DIMENSIONS, np.float32), np.zeros(0))
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, per_language / n)).otherwise(share)
    chosen = known.select("lang", "text").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen[gram_counts(text)[0]] += 1
                rows += 1
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), pa.array([seen.tolist()], pa.list_(pa.int64()))], ["n", "df"])

    rows, df = 0, np.zeros(DIMENSIONS, np.int64)
    for r in chosen.mapInArrow(frequencies, "n long, df array<long>").collect():  # one row of fixed length for each task
        rows, df = rows + r.n, df + np.array(r.df)
    idf = (np.log((1 + rows) / (1 + df)) + 1).astype(np.float32)

    def centroids(lang: pd.DataFrame) -> pd.DataFrame:
        lang = lang.sort_values("text")
        made, cosines = cluster(_vectors([t for t in lang["text"] if has_letter(t)] or [" "], idf), clusters)
        least = slack * float(np.quantile(cosines, 0.005))
        return pd.DataFrame({"lang": lang["lang"].iloc[0], "centroid": [c.tolist() for c in made], "least": least})

    found = chosen.groupBy("lang").applyInPandas(centroids, "lang string, centroid array<float>, least double").toPandas().sort_values("lang", kind="stable")  # a bounded number a language
    return Model(found["lang"].tolist(), np.array(found["centroid"].tolist(), np.float32), idf, found["least"].to_numpy())


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred, score, rejected``; of the columns only ``text`` is looked at."""
    spark, names = docs.sparkSession, docs.columns
    sent = spark.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.predict(t) for t in batch.column("text").to_pylist()]
            columns = [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names if c != "text"), *columns], [*(c for c in names if c != "text"), "lang_pred", "score", "rejected"])

    kept = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "lang_pred string, score double, rejected boolean"])
    return docs.mapInArrow(predict, schema)


def identified(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` for each row of ``docs``.

    A null text and a text without letters are ``und``, with score 0, and rejected. A null ``doc_id`` isn't held out, nor
    learnt from. Rows with equal ``doc_id`` stay rows of their own. Without any labelled row all are ``und``. An empty
    table gives no rows. Ties between centroids go to the first language by name.
    """
    model = fit(docs, **options)
    found = predicted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose language is found near enough, with all their columns."""
    model = fit(docs, **options)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [not sent.value.predict(t)[2] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns], names)

    return docs.mapInArrow(keep, docs.schema)
