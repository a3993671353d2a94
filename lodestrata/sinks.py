"""Writers of result tables (K1-K8)."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators.merges import nulls_as_empty


def flat(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON texts, for formats without them (K6, K8)."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema))


def csv(df: DataFrame, path: str, columns: Sequence[str] | None = None, sort: Sequence[str] = ()) -> None:
    """A folder of CSV files with a header, in a fixed column order; null is empty (K1, K3).

    With sort, the files are in ascending order of those columns, null as the empty text.
    """
    out = df.orderBy(*nulls_as_empty(*sort)) if sort else df
    flat(out.select(*(columns or df.columns))).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="", escape='"')


#: Names the folder of the published version, in a file of one line.
POINTER = "_current"


def tables(frames: dict[str, DataFrame], root: str, checks: dict[str, Callable[[dict[str, DataFrame]], DataFrame]], form: str = "parquet", keep: int = 2) -> str:
    """Publishes all tables at once, if all checks (tables of what is wrong) of what was written are empty; returns their folder (K2).

    Every table is written to a folder of this version; the checks read them from there, so they
    see what readers will, and nothing is computed twice. Last, the file POINTER is replaced, by
    which `current` finds the folder: readers have all tables of one version, and a failure leaves
    those of the version before. ValueError names the check that found something. Folders of
    versions before the last `keep` go.
    """
    spark = next(iter(frames.values())).sparkSession
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    folder = f"{root}/versions/{version}"
    try:
        for name, df in frames.items():
            if form == "csv":
                csv(df, f"{folder}/{name}")
            else:
                df.write.format(form).save(f"{folder}/{name}")
        there = {name: _read(spark, f"{folder}/{name}", form, df.schema) for name, df in frames.items()}
        for name, check in checks.items():
            if check(there).limit(1).count():
                raise ValueError(f"check failed: {name}")
    except Exception:
        _delete(spark, folder)
        raise
    _point(spark, root, version)
    for old in sorted(_names(spark, f"{root}/versions"))[:-keep]:
        if old != version:
            _delete(spark, f"{root}/versions/{old}")
    return folder


def current(spark: SparkSession, root: str, name: str, form: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """A table of the version that is published at root; FileNotFoundError without one."""
    if POINTER not in _names(spark, root):
        raise FileNotFoundError(f"{root}/{POINTER}")
    at, fs = _at(spark, f"{root}/{POINTER}")
    version = spark._jvm.org.apache.commons.io.IOUtils.toString(fs.open(at), "UTF-8")
    return _read(spark, f"{root}/versions/{version}/{name}", form, schema)


def _read(spark: SparkSession, path: str, form: str, schema: T.StructType | None) -> DataFrame:
    if form == "csv":
        kinds = (T.ArrayType, T.MapType, T.StructType)
        plain = schema and T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, kinds) else f.dataType) for f in schema])
        reader = spark.read.schema(plain) if plain else spark.read
        return reader.csv(path, header=True, escape='"', multiLine=True)
    return spark.read.format(form).load(path)


def _at(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    at, fs = _at(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def _delete(spark: SparkSession, path: str) -> None:
    at, fs = _at(spark, path)
    fs.delete(at, True)


def _point(spark: SparkSession, root: str, version: str) -> None:
    """Writes the new pointer beside the old one and puts it in its place in one step."""
    at, fs = _at(spark, f"{root}/{POINTER}.{version}")
    out = fs.create(at, True)
    out.write(bytearray(version.encode()))
    out.close()
    jvm = spark._jvm
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    target, _ = _at(spark, f"{root}/{POINTER}")
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(at), fs.makeQualified(target), overwrite)


def trace(run: dict[str, str], frames: dict[str, DataFrame], path: str) -> None:
    """One JSON row: facts of the run and the number of rows of each table."""
    counts = None
    for name, df in frames.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("t"), "n")
        counts = one if counts is None else counts.unionByName(one)
    out = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("t", "n")))).alias("rows"))
    out.select(*(F.lit(v).alias(k) for k, v in sorted(run.items())), "rows").coalesce(1).write.mode("overwrite").json(path)


def knowledge(df: DataFrame, path: str, key: Sequence[str], stats: DataFrame, source_sha256: str) -> None:
    """A rule table sorted by key, with its statistics and the hash of its source beside it (K7)."""
    csv(df, f"{path}/rules", sort=key)
    stats.withColumn("source_sha256", F.lit(source_sha256)).coalesce(1).write.mode("overwrite").json(f"{path}/stats")
