"""Results that are kept by what they were made from."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _folders(df: DataFrame, path: str) -> tuple:
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())


def kept(df: DataFrame, path: str, version: str, schema: str) -> DataFrame:
    """(input_hash, *schema) of the results of a tool's version that are kept at path by now, each key once."""
    at, fs = _folders(df, path)
    whole = f"input_hash string, tool_version string, {schema}"
    # named one by one, as Spark takes two readings of one folder for the same even if it has grown between them
    there = sorted(x.getPath().toString() for x in fs.listStatus(at)) if fs.exists(at) else []
    if not there:
        return df.sparkSession.createDataFrame([], whole).drop("tool_version")
    found = df.sparkSession.read.schema(whole).parquet(*there)
    return found.where(F.col("tool_version") == version).drop("tool_version").dropDuplicates(["input_hash"])


def with_results(df: DataFrame, inputs: Sequence[str], work: Callable[[DataFrame], DataFrame], schema: str, path: str, version: str) -> DataFrame:
    """df with the columns of schema, which work makes from the columns inputs.

    work takes a table (input_hash, *inputs) of distinct inputs and returns (input_hash, *schema),
    one row for each. Only inputs whose results are not kept at path for this version go through it;
    theirs are then added: written beside the others and moved into place as one folder, so that a
    failed or repeated run adds all of its results or none. Two runs at once may both add a key, of
    which readers take one.
    """
    fields = [f.split()[0] for f in schema.split(", ")]
    mark = F.sha2(F.concat_ws("\u0001", *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in inputs)), 256)
    keyed = df.withColumn("input_hash", mark)
    new = keyed.select("input_hash", *inputs).dropDuplicates(["input_hash"]).join(kept(df, path, version, schema), "input_hash", "left_anti")
    batch = uuid.uuid4().hex
    at, fs = _folders(df, f"{path}.adding-{batch}")
    work(new).select("input_hash", F.lit(version).alias("tool_version"), *fields).write.parquet(f"{path}.adding-{batch}")
    home, _ = _folders(df, path)
    fs.mkdirs(home)
    if not fs.rename(at, _folders(df, f"{path}/{batch}")[0]):
        raise OSError(f"results could not be added to {path}")
    return keyed.join(kept(df, path, version, schema), "input_hash").select(*df.columns, *fields)
