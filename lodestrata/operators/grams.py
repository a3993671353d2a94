"""Containment and prefix joins as equi-joins, so that no value meets every rule.

A few patterns are literals of one expression. Of many, each is known by an anchor: some bytes of it,
as a number. A text's bytes are gone over once for each length of anchor: the number at every place
is held against a Bloom filter, those that pass against the anchors, and only these hits meet rules
in a join. So work follows the bytes, and memory the hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import written

#: Patterns up to which each is looked for as a literal.
LITERALS = 200
#: Bytes of an anchor; a pattern has the longest that fits.
SIZES = (7, 4, 2, 1)
#: Anchors that a task holds at once (eight bytes each), and bits of its Bloom filter as a power of two.
SLICE, BLOOM_BITS = 1 << 20, 20
#: Bytes of text that a task goes over at once, however long a text is.
PIECE = 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)


def containing(values: DataFrame, value: str, rules: DataFrame, pattern: str) -> DataFrame:
    """values with the columns of each rule whose pattern the value contains, one row for each pair.

    Empty patterns and null values match nothing. Names of the two tables must differ. Beyond SLICE
    anchors, values are read again for each slice.
    """
    known = rules.where(F.length(pattern) > 0)
    few = [r[0] for r in known.select(pattern).distinct().limit(LITERALS + 1).collect()]
    if len(few) <= LITERALS:
        each = [F.when(F.contains(F.col(value), F.lit(p)), F.lit(p)) for p in sorted(few)]
        met = F.array_compact(F.array(*each)) if each else F.array().cast("array<string>")
        return values.where(F.col(value).isNotNull()).withColumn("_met", F.explode(met)).join(known, F.col("_met") == F.col(pattern)).drop("_met")
    keyed = written(_anchored(known, pattern), "anchors")
    anchors = keyed.select("_anchor").distinct()
    out = None
    for low, high in _slices(anchors):
        mine = (F.col("_anchor") >= low) & (F.col("_anchor") <= high)
        held = np.sort(anchors.where(mine).toPandas()["_anchor"].to_numpy(np.int64))
        hits = values.where(F.col(value).isNotNull()).mapInArrow(_hits(held, values.columns.index(value)), _with(values, "_anchors array<long>"))
        hits = hits.withColumn("_anchor", F.explode("_anchors")).drop("_anchors")
        found = hits.join(keyed.where(mine), "_anchor").where(F.contains(F.col(value), F.col(pattern))).drop("_anchor")
        out = found if out is None else out.unionByName(found)
    return out


def _with(df: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), more])


def _anchored(known: DataFrame, pattern: str) -> DataFrame:
    """known with _anchor: of all anchors of a pattern the one that the fewest patterns have."""
    raw = F.col("_p").cast("binary")
    n = F.octet_length("_p")
    size = F.coalesce(*(F.when(n >= k, k) for k in SIZES))
    at = lambda i: F.conv(F.hex(F.substring(raw, i, F.col("_n"))), 16, 10).cast("long")
    pieces = known.select(F.col(pattern).alias("_p")).distinct().withColumn("_n", size)
    pieces = pieces.select("_p", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), n - F.col("_n") + 1), lambda i: at(i) + F.shiftleft(F.col("_n").cast("long"), 56)))).alias("_anchor"))
    often = pieces.groupBy("_anchor").agg(F.count("*").alias("_often"))
    rare = pieces.join(often, "_anchor").groupBy("_p").agg(F.min_by("_anchor", F.struct("_often", "_anchor")).alias("_anchor"))
    return known.join(rare, known[pattern] == rare["_p"]).drop("_p")


def _slices(anchors: DataFrame) -> list[tuple[int, int]]:
    """Intervals of at most about SLICE anchors each."""
    n = anchors.count()
    parts = -(-n // SLICE)
    if parts <= 1:
        return [(0, (1 << 63) - 1)]
    cuts = anchors.stat.approxQuantile("_anchor", [i / parts for i in range(1, parts)], 0.1 / parts)
    edges = [0, *sorted({int(c) for c in cuts}), (1 << 63) - 1]
    return [(a, b if b == edges[-1] else b - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _numbers(raw: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each size of anchor, the number that the bytes from every place on make."""
    one = raw.astype(np.uint64)
    yield 1, one
    two = one[:-1] << np.uint64(8) | one[1:]
    yield 2, two
    four = two[:-2] << np.uint64(16) | two[2:]
    yield 4, four
    yield 7, four[:-3] << np.uint64(24) | four[3:] & np.uint64(0xFFFFFF)


def _hits(anchors: np.ndarray, text: int):  # noqa: ANN202
    """The rows of batches, whose column of that number is the text, that hold anchors, with those (`_anchors`).

    A row comes once, whatever the number of its anchors, so that a task never holds copies of long texts.
    """
    of = {n: anchors[anchors >> 56 == n].astype(np.uint64) & np.uint64((1 << 56) - 1) for n in SIZES}
    slot = lambda x: (x * _MIX >> np.uint64(64 - BLOOM_BITS)).astype(np.int64)
    bloom = {}
    for n, own in of.items():
        bloom[n] = np.zeros(1 << BLOOM_BITS, bool)
        bloom[n][slot(own)] = True

    def found(raw: np.ndarray, ends: np.ndarray, start: int) -> Iterator[np.ndarray]:
        """Pairs of a row and an anchor that begins less than PIECE bytes after the start."""
        piece = raw[start : start + PIECE + SIZES[0] - 1]
        padded = piece if len(piece) >= SIZES[0] else np.append(piece, np.zeros(SIZES[0], np.uint8))
        for n, numbers in _numbers(padded):
            own = of[n]
            if not len(own):
                continue
            numbers = numbers[:PIECE]
            at = np.flatnonzero(bloom[n][slot(numbers)])
            k = np.minimum(np.searchsorted(own, numbers[at]), len(own) - 1)
            at = at[own[k] == numbers[at]]
            row = np.searchsorted(ends, at + start, "right")
            inside = row < len(ends)  # not behind the last text
            at, row = at[inside], row[inside]
            inside = at + start + n <= ends[row]
            pairs = np.column_stack([row[inside], numbers[at[inside]].astype(np.int64) + (n << 56)])
            yield np.unique(pairs, axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            ends = offsets[1:] - offsets[0]
            met = [pairs for start in range(0, len(raw), PIECE) for pairs in found(raw, ends, start)]
            pairs = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *met]), axis=0)
            rows, first = np.unique(pairs[:, 0], return_index=True)
            anchors = pa.ListArray.from_arrays(pa.array(np.append(first, len(pairs)), pa.int32()), pa.array(pairs[:, 1], pa.int64()))
            out = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*out.columns, anchors], [*out.schema.names, "_anchors"])

    return run


def starting(values: DataFrame, value: str, rules: DataFrame, prefix: str) -> DataFrame:
    """values with the columns of each rule whose prefix the value begins with, one row for each pair.

    Prefixes of the lengths that rules have are cut from each value and joined. Empty prefixes and
    null values match nothing. Names of the two tables must differ.
    """
    known = rules.where(F.length(prefix) > 0)
    lengths = sorted(r[0] for r in known.select(F.length(prefix)).distinct().collect())  # a few, whatever the number of rules
    cuts = F.array(*map(F.lit, lengths)).cast("array<int>")
    spread = values.withColumn("_cut", F.explode(cuts)).where(F.col("_cut") <= F.length(value))
    keyed = spread.withColumn("_start", F.substring(F.col(value), F.lit(1), F.col("_cut")))
    return keyed.join(known, F.col("_start") == F.col(prefix)).drop("_cut", "_start")
