"""Where intermediate tables are written: the folder that the cluster names in spark.checkpoint.dir.

An intermediate table is Parquet in that folder, so it survives lost executors and cuts the lineage
as a checkpoint does, at a fraction of the bytes. Tables are removed at the end of the scope
(`passing`) that they are made in, when the Python process ends, or by `release`.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOTS: dict[str, SparkSession] = {}
#: Paths of the tables that are made in each open scope, the innermost last.
_SCOPES: list[list[str]] = []
_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Only where it is unset, as in tests, one of our own is set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines of the cluster share")
        _OWN[:] = _OWN or ["file://" + tempfile.mkdtemp(prefix="lodestrata-")]
        at = _OWN[0]
    path = spark._jvm.org.apache.hadoop.fs.Path(at)  # other readers do not know the cluster's default store
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", whole)


#: Rows and bytes that a Python worker is handed at once, and one row at least.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Hands Python workers fewer rows and bytes at once than Spark's defaults, as texts can be very long.

    Values that the user has set stay.
    """
    for name, default, ours in (("Records", "10000", BATCH_ROWS), ("Bytes", "67108864b", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.max{name}PerBatch") == default:
            spark.conf.set(f"spark.sql.execution.arrow.max{name}PerBatch", str(ours))


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call uses."""
    root = f"{shared_dir(spark)}/lodestrata-{spark.sparkContext.applicationId}"
    _ROOTS[root] = spark
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


#: Rows of narrow tables that a task handles at least, once each core has two tasks.
ROWS_PER_TASK = 100_000


def materialise(df: DataFrame, name: str, rows: int | None = None, keep: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it again with the same columns and types.

    rows: no fewer than df has, where that is known; a small table is then written by fewer tasks
    than the session has shuffle partitions, which spares the driver their bookkeeping. keep: the
    table outlives the scope that it is made in, and goes with the one around it.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if _SCOPES:
        (_SCOPES[-1] if not keep else _SCOPES[-2] if len(_SCOPES) > 1 else []).append(path)
    if rows is not None:
        tasks = max(2 * spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))
        df = df.coalesce(tasks) if tasks < int(spark.conf.get("spark.sql.shuffle.partitions")) else df
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """A scope: tables that are made within, but for kept ones, are removed at its end."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
        for path in made:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Ids that are broadcast to take rows out of a table (8 MB); beyond it, they are shuffled.
BROADCAST_IDS = 1_000_000


def without_ids(df: DataFrame, ids: DataFrame, df_id: str, ids_id: str) -> DataFrame:
    """The rows of df whose id is not among ids, a written table with one column; null ids are equal here."""
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    there = ids.select(F.col(ids_id).alias("id_to_leave_out"))
    there = F.broadcast(there) if small else there
    return df.join(there, df[df_id].eqNullSafe(there["id_to_leave_out"]), "left_anti")


def release(spark: SparkSession) -> None:
    """Deletes every intermediate table that this process has written."""
    for root in [r for r, s in _ROOTS.items() if s is spark]:
        del _ROOTS[root]
        _delete(spark, root)


@atexit.register
def _release_all() -> None:
    for spark in {id(s): s for s in _ROOTS.values()}.values():
        if spark.sparkContext._jsc is not None:
            release(spark)
