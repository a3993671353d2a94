"""Near duplicates among vectors by an epsilon grid order join.

Distinct unit vectors are turned onto their principal axes and sorted by the grid cells, of side
epsilon, of their leading coordinates. The sorted sequence is cut into blocks, and intervals of
blocks are joined recursively: of each pair of intervals whose bounding boxes lie within epsilon,
the pairs of their parts go on, down to pairs of blocks; provably distant ones are skipped with all
that they hold. The near pairs are dealt out in tiles of TILE by TILE blocks, so that a block is
shipped once for each tile and not for each pair. Pairs are compared in double precision, and give
counts and a spanning forest of their links, never the links one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import bounded_batches, materialise

#: Vectors of a block and bytes of them, leading principal axes of the grid, parts of an interval, and blocks on a tile's side.
BLOCK, BLOCK_BYTES, AXES, PARTS, TILE = 2048, 1 << 20, 8, 8, 8
#: The axes are those of this many vectors; any axes give the same links, and others only skip less.
AXES_SAMPLE = 4096
#: Pairs nearer to the threshold than this are computed again, each by itself in the plainest order, so many at a time.
CLOSE, NEAR_ROWS = 1e-9, 4096


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1))[:, None]


def _axes(reps: DataFrame, d: int) -> np.ndarray:
    sample = reps.orderBy(F.xxhash64("vec"), "node").limit(AXES_SAMPLE).select("vec").toPandas()["vec"]
    if not len(sample):
        return np.eye(d)
    unit = _unit(np.stack(sample.to_list()).astype(float))
    return np.linalg.svd(unit - unit.mean(0), full_matrices=True)[2].T


def _blocks(reps: DataFrame, d: int, n: int, epsilon: float) -> DataFrame:
    """One row for each block of the grid order: its place, members, weights, vectors and bounding box."""
    axes = _axes(reps, d)
    lead = min(AXES, d)
    most = max(1, min(BLOCK, BLOCK_BYTES // (8 * d)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            y = _unit(vectors.astype(float)) @ axes
            rest = np.sqrt((y[:, lead:] ** 2).sum(1))
            at = np.column_stack([y[:, :lead], rest])
            cells = [pa.array(c) for c in np.floor(y[:, :lead] / epsilon).astype(np.int32).T]
            raw = pa.array([v.tobytes() for v in vectors.astype("<f8")])
            box = pa.FixedSizeListArray.from_arrays(pa.array(at.reshape(-1)), lead + 1).cast(pa.list_(pa.float64()))
            names = ["node", "copies", "raw", "at", *(f"c{i}" for i in range(lead))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), raw, box, *cells], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, chunk, held = TaskContext.get().partitionId(), 0, []
        names = ["part", "chunk", "nodes", "copies", "raw", "lo", "hi"]

        def block(t: pa.Table) -> pa.RecordBatch:
            at = t.column("at").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
            ids, copies = (t.column(c).to_numpy().astype("<i8").tobytes() for c in ("node", "copies"))
            row = [task, chunk, ids, copies, b"".join(t.column("raw").to_pylist()), at.min(0).tolist(), at.max(0).tolist()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        for batch in batches:
            held.append(batch.select(["node", "copies", "raw", "at"]))
            while sum(b.num_rows for b in held) >= most:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, most))
                chunk, held = chunk + 1, table.slice(most).to_batches()
        if sum(b.num_rows for b in held):
            yield block(pa.Table.from_batches(held))

    cells = [f"c{i}" for i in range(lead)]
    placed = reps.mapInArrow(place, "node long, copies long, raw binary, at array<double>, " + ", ".join(f"{c} int" for c in cells))
    parts = max(1, min(-(-n // most), reps.sparkSession.sparkContext.defaultParallelism * 4), -(-n // (64 * most)))
    ordered = materialise(placed, "placed").repartitionByRange(parts, *cells, "node").sortWithinPartitions(*cells, "node")
    schema = "part int, chunk int, nodes binary, copies binary, raw binary, lo array<double>, hi array<double>"
    return materialise(ordered.mapInArrow(cut, schema), "blocks")


def _near_blocks(blocks: DataFrame, lead: int, epsilon: float) -> DataFrame:
    """(i, j), i <= j: pairs of blocks whose boxes lie within epsilon, by recursion over intervals."""
    axes = range(lead + 1)
    boxes = blocks.select("block", *(F.get("lo", F.lit(k)).alias(f"lo{k}") for k in axes), *(F.get("hi", F.lit(k)).alias(f"hi{k}") for k in axes))
    boxes = materialise(boxes, "boxes")
    last = boxes.agg(F.max("block")).first()[0] or 0
    depth = 1
    while PARTS**depth <= last:
        depth += 1
    pairs = blocks.sparkSession.createDataFrame([(0, 0)], "i long, j long")
    for level in range(depth - 1, -1, -1):
        width = PARTS**level
        node = F.floor(F.col("block") / width)
        extremes = [F.min(f"lo{k}").alias(f"lo{k}") for k in axes] + [F.max(f"hi{k}").alias(f"hi{k}") for k in axes]
        nodes = boxes.groupBy(node.alias("node")).agg(*extremes).withColumn("up", F.floor(F.col("node") / PARTS))
        side = lambda s: nodes.select(*(F.col(c).alias(f"{s}_{c}") for c in nodes.columns))
        met = pairs.join(side("a"), F.col("i") == F.col("a_up")).join(side("b"), F.col("j") == F.col("b_up"))
        gaps = [F.greatest(F.lit(0.0), F.col(f"a_lo{k}") - F.col(f"b_hi{k}"), F.col(f"b_lo{k}") - F.col(f"a_hi{k}")) for k in axes]
        near = sum((g * g for g in gaps), F.lit(0.0)) <= epsilon * epsilon + 1e-9
        met = met.where(near & (F.col("a_node") <= F.col("b_node")))
        pairs = materialise(met.select(F.col("a_node").alias("i"), F.col("b_node").alias("j")), "intervals")
    return pairs


def _compared(d: int, threshold: float):
    def forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least id that each member reaches within the block pair."""
        a, b = left.copy(), right.copy()
        far = np.iinfo(np.int64).max
        while True:
            to_a = np.minimum(a, np.where(linked, b[None, :], far).min(1))
            to_b = np.minimum(b, np.where(linked, to_a[:, None], far).min(0))
            if (to_a == a).all() and (to_b == b).all():
                return a, b
            a, b = to_a, to_b

    def linked(one: dict, other: dict) -> np.ndarray:
        cosine = one["unit"] @ other["unit"].T
        out = cosine >= threshold
        xs, ys = np.nonzero(np.abs(cosine - threshold) < CLOSE)
        for at in range(0, len(xs), NEAR_ROWS):
            x, y = xs[at : at + NEAR_ROWS], ys[at : at + NEAR_ROWS]
            p, q = one["vectors"][x], other["vectors"][y]
            out[x, y] = (p * q).sum(1) / np.sqrt((p * p).sum(1) * (q * q).sum(1)) >= threshold
        if one is other:
            np.fill_diagonal(out, False)
        return out

    def tile(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        """Links of each node within the tile, with itself as root, and the links that join components, counted 0."""
        blocks = {}
        for row in rows:
            vectors = np.frombuffer(row["raw"], "<f8").reshape(-1, d)
            nodes, copies = (np.frombuffer(row[c], "<i8") for c in ("nodes", "copies"))
            blocks[row["block"]] = {"vectors": vectors, "unit": _unit(vectors), "nodes": nodes, "copies": copies, "links": np.zeros(len(nodes), np.int64)}
        for row in rows:
            one = blocks[row["block"]]
            for k in row["others"]:
                other = blocks[k]
                met = linked(one, other)
                at, to = np.flatnonzero(met.any(1)), np.flatnonzero(met.any(0))
                if not len(at):
                    continue
                part = met[np.ix_(at, to)]
                one["links"][at] += part @ other["copies"][to]
                if one is not other:
                    other["links"][to] += one["copies"][at] @ part
                roots = forest(part, one["nodes"][at], other["nodes"][to])
                nodes, roots = np.concatenate([one["nodes"][at], other["nodes"][to]]), np.concatenate(roots)
                joins = nodes != roots
                yield _rows(nodes[joins], np.zeros(joins.sum(), np.int64), roots[joins])
        for own in blocks.values():
            some = own["links"] > 0
            yield _rows(own["nodes"][some], own["links"][some], own["nodes"][some])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and (held[-1]["i"], held[-1]["j"]) != (row["i"], row["j"]):
                    yield from tile(held)
                    held = []
                held.append(row)
        if held:
            yield from tile(held)

    return run


def _rows(nodes: np.ndarray, links: np.ndarray, roots: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (nodes, links, roots)], ["node", "links", "root"])


def _joined(reps: DataFrame, d: int, n: int, threshold: float) -> DataFrame:
    """(node, links, root): links of each distinct vector of d components with others, by tile, and links that join components."""
    epsilon = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    blocks = _blocks(reps, d, n, epsilon)
    most = (blocks.agg(F.max("chunk")).first()[0] or 0) + 1
    blocks = blocks.withColumn("block", F.col("part").cast("long") * most + F.col("chunk"))
    pairs = _near_blocks(blocks, min(AXES, d), epsilon)
    # each block of a tile once, with those at or after it in the order that it meets there
    at = [F.floor(F.col(c) / TILE).alias(f"t{c}") for c in "ij"]
    sides = F.array(F.struct(F.col("i").alias("block"), F.col("j").alias("other")), F.struct(F.col("j").alias("block"), F.lit(None).cast("long").alias("other")))
    wanted = pairs.select(*at, F.explode(sides).alias("s")).groupBy(F.col("ti").alias("i"), F.col("tj").alias("j"), "s.block")
    wanted = materialise(wanted.agg(F.array_sort(F.collect_set("s.other")).alias("others")), "tiles")
    dealt = wanted.join(blocks.select("block", "nodes", "copies", "raw"), "block")
    dealt = dealt.repartition("i", "j").sortWithinPartitions("i", "j", "block")
    return materialise(dealt.mapInArrow(_compared(d, threshold), "node long, links long, root long"), "compared")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row.

    Two vectors link if their cosine, in double precision, is the threshold or more. n_links counts
    the other rows that a row links with, equal vectors among them; component_id is the least id
    that links reach. Vectors that are null, empty or zero, or hold null or non-finite components,
    link with nothing, and vectors of different lengths do not link with each other. Rows with a
    null id link with nothing, and are returned with a null component and kept. Rows that repeat an
    id are rows of their own, with their own links. An empty table gives no rows; other columns are
    ignored.
    """
    bounded_batches(df.sparkSession)  # a row may hold a block
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    fit = (F.size("vec") > 0) & F.forall("vec", finite) & F.exists("vec", lambda x: x != 0) & F.col("id").isNotNull()
    rows = rows.withColumn("fit", F.coalesce(fit, F.lit(False)))
    # the constant stands first: behind the vector, the second hash would follow from the first
    key = [F.when(F.col("fit"), F.xxhash64(F.lit(k), "vec")).alias(f"k{k}") for k in (1, 2)]
    keyed = rows.select("id", "fit", "vec", *key)
    distinct = keyed.where("fit").groupBy("k1", "k2")
    reps = distinct.agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    # numbers in place of ids, as rows of different vectors may have one id; they are written, and so stay as they are
    reps = materialise(reps.withColumn("node", F.monotonically_increasing_id()), "distinct")
    found = None
    for d, n in sorted(tuple(r) for r in reps.groupBy(F.size("vec")).count().collect()):
        own = reps.where(F.size("vec") == d).select("node", "copies", "vec")
        links = _joined(own, d, n, threshold)
        found = links if found is None else found.unionByName(links)
    if found is None:
        found = df.sparkSession.createDataFrame([], "node long, links long, root long")
    roots = connected_components(found, "node", "root")
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = reps.select("k1", "k2", "node", "rep", "copies").join(counted, "node", "left").join(roots, "node", "left")
    links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    groups = materialise(groups.select("k1", "k2", "rep", links.alias("links"), F.coalesce("component", "node").alias("component")), "groups")
    least = materialise(groups.groupBy("component").agg(F.min("rep").alias("root")), "roots")
    groups = materialise(groups.join(least, "component").select("k1", "k2", "links", "root"), "rooted")
    out = keyed.select("id", "k1", "k2").join(groups, ["k1", "k2"], "left")
    component = F.coalesce("root", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("id")).alias("kept"),
    )
