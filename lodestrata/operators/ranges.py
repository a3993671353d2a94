"""The narrowest of many ranges that holds a value, by a merge in order.

Values and starts of ranges are partitioned by range together and sorted. Each part is gone through
once, with the ranges that have begun in a heap by their width, so those that have ended give way to
the ones around them. A range that reaches beyond its part is told to the parts after it: the first
values of all parts are all that the driver sees.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import written

#: Values and starts in one part, about.
PART_ROWS = 200_000


def narrowest(probes: DataFrame, ranges: DataFrame) -> DataFrame:
    """(_probe, _range) of each row (_probe, _key) whose key a range (_low, _high, _range) holds: the narrowest, of equals the first.

    Keys and bounds are hexadecimal numbers of one length, and bounds are in order. What is known of a
    range, _range, goes through the merge with it, so that nothing is joined afterwards. Both tables
    are gone through several times, so they are best given as written ones.
    """
    known = ranges.schema["_range"].dataType
    begun = ranges.select(F.col("_low").alias("at"), F.lit(0).alias("kind"), "_low", "_high", "_range", F.lit(None).cast("string").alias("_probe"))
    none = [F.lit(None).cast("string").alias("_low"), F.lit(None).cast("string").alias("_high"), F.lit(None).cast(known).alias("_range")]
    both = begun.unionByName(probes.select(F.col("_key").alias("at"), F.lit(1).alias("kind"), *none, "_probe"))
    parts = max(1, -(-both.count() // PART_ROWS))
    dealt = written(both.repartitionByRange(parts, "at").select(F.spark_partition_id().alias("part"), "*"), "dealt")
    firsts = [(r.part, r.first) for r in dealt.groupBy("part").agg(F.min("at").alias("first")).orderBy("part").collect()]
    if len(firsts) > 1:
        dealt = dealt.unionByName(_carried(dealt, firsts))
    ordered = dealt.repartition(len(firsts) or 1, "part").sortWithinPartitions("part", "at", "kind")
    return ordered.mapInArrow(_sweep, T.StructType([T.StructField("_probe", T.StringType()), T.StructField("_range", known)]))


def _carried(dealt: DataFrame, firsts: list[tuple[int, str]]) -> DataFrame:
    """Ranges that reach into parts after their own, once for each such part, at its first value."""
    after = {part: first for (part, _), (_, first) in zip(firsts[:-1], firsts[1:], strict=True)}
    next_ = F.broadcast(dealt.sparkSession.createDataFrame(list(after.items()), "part int, next string"))
    far = dealt.where("kind = 0").join(next_, "part").where(F.col("_high") >= F.col("next"))
    every = F.array(*(F.struct(F.lit(p).alias("part"), F.lit(f).alias("first")) for p, f in firsts))
    reached = F.filter(every, lambda x: (x["part"] > F.col("part")) & (x["first"] <= F.col("_high")))
    more = ["kind", "_low", "_high", "_range", "_probe"]
    return far.select(F.explode(reached).alias("to"), *more).select("to.part", F.col("to.first").alias("at"), *more)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, open_, pool = None, [], None
    for batch in batches:
        # of the ranges before this batch, those that are open are kept, in the heap's order
        own, still = batch.column("_range"), pa.array([i for *_, i in open_], pa.int64())
        pool, open_ = own if pool is None else pa.concat_arrays([pool.take(still), own]), [(*x[:-1], i) for i, x in enumerate(open_)]
        kinds, parts = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "part"))
        at, low, high = (batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("at", "_low", "_high"))
        changed = np.append(parts[:1] != part, parts[1:] != parts[:-1])
        chosen, start = np.full(len(kinds), -1), 0
        for row in [*np.flatnonzero((kinds == 0) | changed).tolist(), len(kinds)]:
            while start < row:  # the keys since the last range began: the narrowest that is open holds those up to its end
                while open_ and open_[0][2] < at[start]:
                    heapq.heappop(open_)
                if not open_:
                    break
                end = bisect_right(at, open_[0][2], start, row)
                chosen[start:end] = open_[0][3]
                start = end
            if row == len(kinds):
                break
            start = row
            if changed[row]:
                open_ = []
            if kinds[row] == 0:
                heapq.heappush(open_, (int(high[row], 16) - int(low[row], 16), low[row], high[row], len(still) + row))
                start = row + 1
        part = parts[-1] if len(parts) else part
        held = np.flatnonzero(chosen >= 0)
        yield pa.RecordBatch.from_arrays([batch.column("_probe").take(pa.array(held)), pool.take(pa.array(chosen[held]))], ["_probe", "_range"])
