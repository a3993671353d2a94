"""Integrity checks, as tables of what is wrong rather than exceptions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .merges import joined_by


def missing_parents(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows of child whose key is not in parent."""
    return child.join(parent.select(key).distinct(), key, "left_anti")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def counters(df: DataFrame, keys: Sequence[str], conditions: dict[str, Column]) -> DataFrame:
    """One row: rows, duplicate keys, rows with a blank key part, and rows under each condition."""
    blank = F.lit(False)
    for k in keys:
        blank = blank | (F.coalesce(F.col(k).cast("string"), F.lit("")) == "")
    each = df.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.count_if(blank).alias("blank_keys"), *(F.count_if(c).alias(n) for n, c in conditions.items())
    )
    sums = [F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("blank_keys", *conditions)]
    return each.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), *sums, F.count_if(F.col("_n") > 1).alias("duplicate_keys"))


def out_of_order(df: DataFrame, group: Sequence[str], pos: str, value: str) -> DataFrame:
    """Rows whose value is less than that of the row before."""
    w = Window.partitionBy(*group).orderBy(pos)
    return df.withColumn("before", F.lag(value).over(w)).where(F.col(value) < F.col("before"))


def identity_kept(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str], category: str) -> DataFrame:
    """One row: lost, unknown and changed records, and those of another category."""
    a = before.select(F.col(key).alias("_a"), *(F.col(f).alias(f"_a_{f}") for f in (*fields, category)))
    b = after.select(F.col(key).alias("_b"), *(F.col(f).alias(f"_b_{f}") for f in (*fields, category)))
    both = a.join(b, F.col("_a") == F.col("_b"), "full")
    met = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    changed = F.lit(False)
    for f in fields:
        changed = changed | ~F.col(f"_a_{f}").eqNullSafe(F.col(f"_b_{f}"))
    return both.agg(
        F.count_if(F.col("_b").isNull()).alias("lost"),
        F.count_if(F.col("_a").isNull()).alias("unknown"),
        F.count_if(met & changed).alias("changed"),
        F.count_if(met & ~F.col(f"_a_{category}").eqNullSafe(F.col(f"_b_{category}"))).alias("recategorised"),
    )


def rejected(df: DataFrame, rules: dict[str, Column], keys: Sequence[str], pos: str) -> DataFrame:
    """df with `reject`: the first broken rule, `duplicate` for all but the first row of a key, null for good rows (S3).

    pos tells rows apart. The first places of the keys of good rows are summed up and joined, so
    rows that break a rule, however many have the same blank key, never meet in one task.
    """
    reason = F.coalesce(*(F.when(c, n) for n, c in rules.items()))
    marked = df.withColumn("_reason", reason)
    first = marked.where("_reason is null").groupBy(*keys).agg(F.min(pos).alias("_first"))
    out = joined_by(marked, first, keys)
    again = F.col("_reason").isNull() & (F.col(pos) > F.col("_first"))
    return out.select(*df.columns, F.coalesce("_reason", F.when(again, "duplicate")).alias("reject"))
