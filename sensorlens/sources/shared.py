"""The folder that the driver and all executors share, for tables that cut lineage and for what streams keep."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def new_place(spark: SparkSession, label: str) -> str:
    """A path that no other run uses in ``spark.checkpoint.dir``; on one machine, where that is unset, in a folder of its own."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
        top = _own[app]
    return f"{top.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settled(df: DataFrame, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written there, in folders by ``by``, and read again, so that later readers neither recompute it nor depend on an executor."""
    path = new_place(df.sparkSession, label)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
