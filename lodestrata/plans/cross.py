"""Analyses over the outputs of the other plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import compared, on_every_side


def universal(apps: DataFrame, vulnerable: DataFrame, traffic: DataFrame) -> DataFrame:
    """Apps that all three analyses know, by sample_id."""
    return on_every_side([apps, vulnerable, traffic], "sample_id")


def declared_against_seen(declared: DataFrame, seen: DataFrame) -> DataFrame:
    """(sample_id, vendor, side): vendors of declared libraries against those of traffic."""
    return compared(declared, seen, ["sample_id", "vendor"])


def rolled_up(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Counts and sums for every prefix of keys; `level` tells how many are rolled away."""
    return df.rollup(*keys).agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.sum(value).alias("total"))
