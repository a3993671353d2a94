"""Places in an order, in two levels, so that one group may hold all rows.

Rows are partitioned by range of group and order. Each piece numbers its own rows, and the counts of
a group's pieces before it are added: no task sees more than a piece, or one row for each piece.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written
from .merges import joined_by


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """df with the place of each row in its group, from 1; ties go by the other columns, so only equal rows are interchangeable."""
    rest = [f.name for f in df.schema if not f.dataType.simpleString().startswith(("map", "variant"))]
    rows = df.withColumn("_tie", F.xxhash64(*rest)).withColumn("_at", F.monotonically_increasing_id())
    sort = [*order, "_tie", "_at"]
    dealt = written(rows.repartitionByRange(*group, *sort).withColumn("_piece", F.spark_partition_id()), "pieces")
    counts = dealt.groupBy("_piece", *group).agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_piece", *group, before.alias("_before"))
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy("_piece", *group).orderBy(*sort)))
    out = joined_by(own, offsets, ["_piece", *group])
    return out.select(*df.columns, (F.col("_own") + F.col("_before")).alias(name))


def numbered(df: DataFrame, group: str, order: Sequence[str], name: str = "rule_id") -> DataFrame:
    """df with `group_n` counting from 1 within each group."""
    out = ranked(df, [group], order, "_n")
    return out.select(*df.columns, F.concat_ws("_", F.lower(group), F.col("_n").cast("string")).alias(name))
