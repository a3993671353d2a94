"""Intermediate tables: Parquet below the folder that the cluster names in spark.checkpoint.dir.

A written table cuts the plan, so that nothing above it is pushed into what made it, and survives
lost executors. Tables go when the process ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's spark.checkpoint.dir.

    Where that is unset, as in tests, it is below a temporary folder of this machine, which a cluster's machines do not share.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a shared folder")
        root = "file://" + tempfile.gettempdir()
    path = f"{root}/lodestrata-queries/{name}-{uuid.uuid4().hex[:12]}"
    _MADE.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to a new folder and read again with the same columns and types."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """df in tasks of about so many rows each, for costly work on rows of few bytes.

    Spark deals out a file by its bytes, so a million short rows would else be one task. The rows are
    counted, so df is best a table as it is read.
    """
    tasks = -(-df.count() // rows)
    return df.repartition(tasks) if tasks > 1 else df


@atexit.register
def _clear() -> None:
    for spark, path in _MADE:
        if spark.sparkContext._jsc is not None:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
