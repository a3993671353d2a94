"""Sharding by best-fit-decreasing bin packing of indivisible groups.

The driver packs size classes, not groups: it holds a histogram (class, number of groups) with at
most CLASSES_PER_OCTAVE classes for each doubling of the size, and the ordered tree of open bins.
Groups of one class are alike to the packer, so best-fit-decreasing puts them down in runs. The
groups then find their bin by their rank within the class, counted in two levels so that no class
and no shard is numbered by one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise

#: Sizes below this are classes of their own; above, each octave has this many classes.
CLASSES_PER_OCTAVE = 4096
#: Rows that one task numbers at most, on average.
ROWS_PER_RANK_BUCKET = 20_000


@dataclass
class _Node:
    key: tuple[int, int]
    left: _Node | None = None
    right: _Node | None = None
    height: int = 1


class FreeSpace:
    """An AVL tree of open bins ordered by (remaining capacity, bin)."""

    def __init__(self) -> None:
        self._root: _Node | None = None

    @staticmethod
    def _height(n: _Node | None) -> int:
        return n.height if n else 0

    def _balanced(self, n: _Node) -> _Node:
        n.height = 1 + max(self._height(n.left), self._height(n.right))
        lean = self._height(n.left) - self._height(n.right)
        if lean > 1:
            if self._height(n.left.left) < self._height(n.left.right):
                n.left = self._rotated(n.left, to_left=True)
            return self._rotated(n, to_left=False)
        if lean < -1:
            if self._height(n.right.right) < self._height(n.right.left):
                n.right = self._rotated(n.right, to_left=False)
            return self._rotated(n, to_left=True)
        return n

    def _rotated(self, n: _Node, to_left: bool) -> _Node:
        up = n.right if to_left else n.left
        if to_left:
            n.right, up.left = up.left, n
        else:
            n.left, up.right = up.right, n
        for x in (n, up):
            x.height = 1 + max(self._height(x.left), self._height(x.right))
        return up

    def add(self, remaining: int, bin_id: int) -> None:
        def put(n: _Node | None) -> _Node:
            if n is None:
                return _Node((remaining, bin_id))
            if (remaining, bin_id) < n.key:
                n.left = put(n.left)
            else:
                n.right = put(n.right)
            return self._balanced(n)

        self._root = put(self._root)

    def remove(self, remaining: int, bin_id: int) -> None:
        def cut(n: _Node | None, key: tuple[int, int]) -> _Node | None:
            if n is None:
                return None
            if key < n.key:
                n.left = cut(n.left, key)
            elif key > n.key:
                n.right = cut(n.right, key)
            elif n.left is None or n.right is None:
                return n.left or n.right
            else:
                least = n.right
                while least.left:
                    least = least.left
                n.key, n.right = least.key, cut(n.right, least.key)
            return self._balanced(n)

        self._root = cut(self._root, (remaining, bin_id))

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The bin with the least remaining capacity that still holds size."""
        n, best = self._root, None
        while n:
            if n.key[0] >= size:
                best, n = n.key, n.left
            else:
                n = n.right
        return best


def pack(histogram: list[tuple[int, int]], capacity: int, most_bins: int | None = None) -> list[tuple[int, int, int, int]]:
    """Best-fit-decreasing of (size, number of groups) into bins of one capacity.

    Returns runs (size, first rank, number of groups, bin). A group that is larger than the
    capacity has a bin of its own. Stops early, with an unfinished packing, beyond most_bins.
    """
    free, runs, bins = FreeSpace(), [], 0
    for size, n in sorted(histogram, reverse=True):
        rank = 0
        while rank < n:
            at = free.tightest(size)
            if at is None:
                at = (max(capacity, size), bins)
                bins += 1
                if most_bins is not None and bins > most_bins:
                    return runs + [(size, rank, n - rank, most_bins)]
            else:
                free.remove(*at)
            taken = min(n - rank, at[0] // size) if size else n - rank
            runs.append((size, rank, taken, at[1]))
            rank += taken
            free.add(at[0] - taken * size, at[1])
    return runs


def pack_evenly(histogram: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int, int]]:
    """Runs over a fixed number of bins, by the least capacity at which best-fit-decreasing needs no more.

    Groups larger than an even share have bins of their own, and what is left is shared evenly.
    """
    alone: list[tuple[int, int, int, int]] = []
    rest = {s: n for s, n in histogram if n}
    while rest and len(alone) < bins - 1:
        largest, total = max(rest), sum(s * n for s, n in rest.items())
        if largest * (bins - len(alone)) <= total:
            break
        done = sum(1 for s, *_ in alone if s == largest)
        alone.append((largest, done, 1, len(alone)))
        rest[largest] -= 1
        if not rest[largest]:
            del rest[largest]
    if not rest:
        return alone
    left = bins - len(alone)
    low = max(max(rest), -(-sum(s * n for s, n in rest.items()) // left))
    high = low + max(rest)
    fits = lambda c: max((b for *_, b in pack(list(rest.items()), c, left)), default=0) < left
    while not fits(high):
        high *= 2
    while low < high and high - low > low // 100_000:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    shifted = {s: sum(1 for x, *_ in alone if x == s) for s in rest}
    packed = pack(list(rest.items()), high, left)
    return alone + [(s, r + shifted[s], n, b + len(alone)) for s, r, n, b in packed]


def size_class(size: Column) -> Column:
    """size itself if small, else rounded up to the next of CLASSES_PER_OCTAVE steps of its octave."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double") / CLASSES_PER_OCTAVE)))
    return F.when(size < CLASSES_PER_OCTAVE, size).otherwise((F.ceil(size / step) * step).cast("long"))


def ranked(df: DataFrame, keys: list[str], order: list[str], bucket_by: list[str], buckets: Column, name: str) -> DataFrame:
    """df with `rank`, gapless from 0 within keys, without one task for a key.

    Rows go to hash buckets within each key, as many as `buckets` says; rows are numbered within
    buckets, and the sizes of the buckets before are added. Rows are ordered by bucket, then by
    order. The table of bucket sizes has no rows for keys of one bucket, so it holds one row for
    every ROWS_PER_RANK_BUCKET rows of df, and not one for each key.
    """
    dealt = df.withColumn("buckets", buckets).withColumn("bucket", F.pmod(F.xxhash64(*bucket_by), F.col("buckets")))
    inner = dealt.withColumn("at", F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy(*order)) - 1)
    inner = materialise(inner, name)
    sizes = inner.where("buckets > 1").groupBy(*keys, "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    joined = inner.join(materialise(starts, f"{name}-starts"), [*keys, "bucket"], "left")
    return joined.withColumn("rank", F.col("at") + F.coalesce("before", F.lit(0))).drop("at", "before", "bucket", "buckets")


def shard_by_bytes(docs: DataFrame, shards: int, id_col: str = "doc_id", text: str = "text", overhead: int = 16) -> DataFrame:
    """(id_col, size, text_crc32, shard, slot): whole groups of equal texts in shards of near equal bytes.

    size is the UTF-8 bytes of the text, none for null, plus overhead. Equal texts are one group;
    null and empty texts are one group as well. A group larger than an even share gets a shard of
    its own, as groups are never cut. slot counts the rows of a shard from 0 without gaps. Rows
    that repeat an id each have a slot; null ids are allowed; an empty table gives no rows; other
    columns are ignored.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    rows = materialise(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(value) + overhead).cast("long").alias("size"),
            F.crc32(value.cast("binary")).alias("crc"),
            F.unhex(F.sha2(value, 256)).alias("grp"),
        ),
        "sizes",
    )
    total = rows.count()
    groups = rows.groupBy("grp").agg(F.sum("size").alias("total")).select("grp", size_class(F.col("total")).alias("class"))
    groups = materialise(groups, "groups")
    histogram = [(r[0], r[1]) for r in groups.groupBy("class").agg(F.count("*")).collect()]
    by_class: dict[int, list[tuple[int, int]]] = {c: [] for c, _ in histogram}
    for size, first, n, at in pack_evenly(histogram, shards):
        if n:
            by_class[size].append((first, at))
    table = [(c, [f for f, _ in sorted(by_class[c])], [b for _, b in sorted(by_class[c])], -(-n // ROWS_PER_RANK_BUCKET)) for c, n in histogram]
    # a row for each class, of which there are CLASSES_PER_OCTAVE for each doubling of the size at most, whatever the input
    classes = F.broadcast(docs.sparkSession.createDataFrame(table, "class long, firsts array<long>, bins array<int>, parts long"))
    placed = ranked(groups.join(classes, "class"), ["class"], ["grp"], ["grp"], F.col("parts"), "ranks")
    at = F.size(F.filter("firsts", lambda f: f <= F.col("rank"))) - 1
    placed = materialise(placed.select("grp", F.get("bins", at).alias("shard")), "placed")
    sharded = rows.join(placed, "grp")
    out = ranked(sharded, ["shard"], ["id", "grp"], ["id", "grp"], F.lit(max(1, -(-total // (shards * ROWS_PER_RANK_BUCKET)))), "sharded")
    return out.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", F.col("rank").alias("slot")
    )
