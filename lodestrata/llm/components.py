"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import ROWS_PER_TASK, materialise, passing


def _toward_minimum(edges: DataFrame, larger_only: bool, rows: int) -> DataFrame:
    """Each neighbour of u is linked with the least of u and its neighbours.

    The minima of many links are written first: the join then reads two plain exchanges, and Spark
    can split the one that holds a node with very many neighbours.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    least = least if rows <= ROWS_PER_TASK else materialise(least, "least", rows)
    joined = edges.join(least, "u")
    if larger_only:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least id that links reach, for each node from which they reach a lesser one.

    Nulls and links of a node with itself are ignored; repeated links change nothing; no links give
    no rows. Each round is a fixed number of joins and aggregations over the links, and the number
    of rounds grows with the logarithm of the longest chain.
    """
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges, state = materialise(edges, "links"), None
    while True:
        seen = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == state or seen[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state, rows = seen, 2 * seen[0]
        with passing(links.sparkSession):
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = materialise(_toward_minimum(both, larger_only=True, rows=rows).where("u <> v").distinct(), "large", rows)
            small = _toward_minimum(large, larger_only=False, rows=rows).where("u <> v")
            edges = materialise(small.distinct(), "small", rows, keep=True)
