"""Tables whose files say which runs of three characters they hold, so that a search for part of a text reads few of them.

Beside the table lies, for each file and column, a map of bits, one for each hash of three characters that stand side by side in
any text of the file, lower-cased. A text that holds the part holds all its threes, so a file whose map lacks one has no such
text. What the maps let through is read and compared exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bits of a map: two buckets of Spark's bitmaps.
BITS = 1 << 16
INDEX = "_threes"


def _threes(text: Column) -> Column:
    """The different places of the runs of three characters of ``text``."""
    low = F.lower(text)
    runs = F.when(F.length(low) >= 3, F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3))))
    # From 1, since Spark's bitmaps begin there.
    return F.array_distinct(F.transform(runs, lambda r: F.pmod(F.xxhash64(r), F.lit(BITS)) + 1))


def save_searchable(df: DataFrame, path: str, columns: list[str]) -> None:
    """Writes ``df`` to ``path`` with the maps of ``columns``. Rows that are near each other in ``columns`` had best lie in one file."""
    df.write.mode("overwrite").parquet(path)
    index_files(df.sparkSession, path, columns)


def index_files(spark: SparkSession, path: str, columns: list[str]) -> None:
    """Makes the maps of the files at ``path``."""
    rows = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), *columns)
    texts = rows.select("file", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), _threes(F.col(c).cast("string")).alias("places")) for c in columns))).alias("t"))
    places = texts.select("file", "t.column", F.explode("t.places").alias("place"))
    maps = places.groupBy("file", "column", F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("map"))
    # A file without any text of three characters has to be known too.
    every = rows.select("file").distinct().select("file", F.lit("").alias("column"), F.lit(0).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("map"))
    maps.unionByName(every).write.mode("overwrite").parquet(f"{path}/{INDEX}")


def files_with(spark: SparkSession, path: str, columns: list[str], part: str) -> tuple[list[str], int]:
    """(files that may hold ``part`` in one of ``columns``, number of all files). One name for each file that is read."""
    maps = spark.read.parquet(f"{path}/{INDEX}")
    wanted = spark.range(1).select(F.transform(_threes(F.lit(part)), lambda p: F.struct(F.bitmap_bucket_number(p).alias("bucket"), F.bitmap_bit_position(p).alias("bit")))).first()[0]
    files = maps.where("column = ''").select("file").distinct()
    if wanted:
        byte = lambda bit: F.conv(F.hex(F.substring(F.col("map"), bit // 8 + 1, 1)), 16, 10).cast("int")
        held = [(F.col("bucket") == w.bucket) & (byte(w.bit).bitwiseAND(1 << w.bit % 8) != 0) for w in wanted]
        hits = reduce(lambda a, b: a + b, (h.cast("int") for h in held))
        found = maps.where(F.col("column").isin(columns)).groupBy("file", "column").agg(F.sum(F.coalesce(hits, F.lit(0))).alias("n")).where(F.col("n") == len(wanted))
        files = found.select("file").distinct()
    return [r.file for r in files.collect()], maps.where("column = ''").count()


def search(spark: SparkSession, path: str, columns: list[str], part: str) -> DataFrame:
    """Rows of the table at ``path`` that hold ``part`` in one of ``columns``, in any case; parts under three characters read all files."""
    schema = spark.read.parquet(path).schema
    files, _ = files_with(spark, path, columns, part)
    rows = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    low = F.lower(F.lit(part))
    return rows.where(reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(F.col(c).cast("string")), low), F.lit(False)) for c in columns)))
