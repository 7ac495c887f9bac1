"""What the operators of this subpackage share: tables, shared folders, the way to the workers."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

#: Words of every contract here: runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_own_folders: dict[str, str] = {}
_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Lets Python workers import this package even if only the driver has it: on its path on one machine, else as an archive, once for each application."""
    sc = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = sc.environment
    held = env.get("PYTHONPATH", "")
    if root not in held.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, held) if x)
    env.setdefault("TOKENIZERS_PARALLELISM", "false")
    if not sc.master.startswith("local") and sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        package = os.path.basename(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="spark-"), package), "zip", root, package))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir`` of the session.

    Only where that is unset on one machine, as in tests, a new temporary folder is made, once for each application.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own_folders[app]


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def settled(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: later readers neither recompute it nor depend on an executor."""
    return settled_at(df, label)[0]


def settled_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """The same with the path."""
    path = new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def released(spark: SparkSession, path: str) -> None:
    """Deletes a table that ``settled_at`` wrote and nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def tidied(work):
    """``work`` on batches, after which the worker gives the memory that it has freed back to the system.

    Workers live on from task to task, and one that keeps the most that any task took leaves less to all later ones.
    """

    def done(batches):
        yield from work(batches)
        import ctypes

        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library alone
        if trim:
            trim(0)

    return done


def column_or_null(df: DataFrame, name: str, kind: str):
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def placed_in_order(df: DataFrame, order: list, sums: dict[str, str], label: str) -> DataFrame:
    """``df`` with ``place``, its rank from 0 in ``order``, and for each ``new: old`` of ``sums`` the sum of ``old`` over the rows before.

    Ranks and sums are taken in two levels: inside ranges of ``order``, and over the totals of the ranges, one row for each
    partition. The ranges are written first, since a second evaluation may bound them elsewhere.
    """
    keys = [f"_order{k}" for k in range(len(order))]
    keyed = df.withColumns(dict(zip(keys, order, strict=True)))
    ranged = settled(keyed.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), label)
    totals = ranged.groupBy("_part").agg(F.count("*").alias("_rows"), *(F.sum(old).alias(f"_all_{new}") for new, old in sums.items()))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carried = {"_rows": "_rows", **{f"_all_{new}": f"_all_{new}" for new in sums}}
    offsets = totals.select("_part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in carried))
    inside = W.partitionBy("_part").orderBy(*keys)
    running = inside.rowsBetween(W.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(offsets), "_part")  # one row for each partition
    places = {"place": F.col("_rows") + F.row_number().over(inside) - 1}
    places |= {new: F.col(f"_all_{new}") + F.coalesce(F.sum(old).over(running), F.lit(0)) for new, old in sums.items()}
    return out.withColumns(places).drop("_part", *carried, *keys)
