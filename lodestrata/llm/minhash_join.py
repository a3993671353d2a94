"""Near duplicates by an inverted join over the coordinates of MinHash signatures.

Each distinct shingle set is posted under its (coordinate, value) pairs. Two sets that agree in at
least MATCHES of the K coordinates share a posting in the K - MATCHES + 1 rarest postings of either,
so only these prefixes are joined, rarest first, and a posting that one set alone has ends nothing
but its own search. Collisions are then counted on the signatures, and links are confirmed on the
full sets.

A posting list is never paired with itself. First each of its members meets the list's least id.
Lists of one least id are then taken together; those whose members the confirmed links have all
brought together are skipped. The rest are compared in blocks of bounded size, each pair of blocks
in a task that counts collisions, skips pairs that are together already, confirms the others on
their full sets, and gives the links that join components, never all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import BROADCAST_IDS, bounded_batches, materialise, passing, without_ids
from .words import by_bytes, shingle_sets, signatures

#: Coordinates of a signature, and those that must agree. A pair of similarity 0.75 agrees in fewer with probability 3e-7.
K, MATCHES = 32, 11
#: Coordinates of the sketch that is compared before the full sets, 8 bits each, and those that must
#: agree; a pair of similarity 0.75 agrees in fewer with probability 1e-7.
SKETCH, SKETCH_MATCHES = 256, 156
#: Members of a posting list in a block.
BLOCK = 512


def _sets(words: int, signed: bool):
    """Batches of (id, text) to (id, n, set_key, coords), or to (id, n, shingles, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 4 << 20):
            flat, at = shingle_sets(batch.column(1), words)
            n = np.diff(at)
            held = [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            if not signed:
                shingles = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.view(np.int64)))
                sketch = np.zeros((len(n), SKETCH), np.uint8)
                sketch[n > 0] = signatures(flat, at, SKETCH) & 255
                raw = pa.array([x.tobytes() for x in sketch])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), shingles, raw], ["id", "n", "shingles", "sketch"])
                continue
            import xxhash

            keys = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in held]
            packed = signatures(flat, at, K) | (np.arange(K, dtype=np.int64) << 32)
            ends = np.concatenate(([0], np.cumsum(np.where(n > 0, K, 0))))
            coords = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(packed.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(keys, pa.binary()), coords], ["id", "n", "set_key", "coords"]
            )

    return run


def _prefixes(reps: DataFrame) -> DataFrame:
    """(id, key): the rarest postings of each set, of which a partner must share one."""
    posts = reps.select("id", F.explode("coords").alias("key"))
    shared = materialise(posts.groupBy("key").agg(F.count("*").alias("df")).where("df > 1"), "df")
    own = posts.join(shared, "key").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("p"))
    own = own.where(F.size("p") >= MATCHES).select("id", F.explode(F.slice("p", 1, F.size("p") - (MATCHES - 1))).alias("p"))
    return materialise(own.select("id", F.col("p.key").alias("key")), "prefixes")


def _full_sets(prefixes: DataFrame, docs: DataFrame, words: int, most: int) -> DataFrame:
    """(id, n, shingles, sketch) of the texts that have postings to share."""
    wanted = materialise(prefixes.select("id").distinct(), "wanted", most)
    if wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = docs.join(wanted, "id", "left_semi")
    return materialise(texts.mapInArrow(_sets(words, False), "id long, n long, shingles array<long>, sketch binary"), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full shingle sets have the similarity."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    alike = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    both = pairs.join(left, "a").join(right, "b").where(alike).withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return both.where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def _labelled(ids: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) of all ids."""
    found = connected_components(links)
    joined = ids.join(found, ids["id"] == found["node"], "left")
    return joined.select("id", F.coalesce("component", "id").alias("component"))


def _across_blocks(percent: int):
    """Rows of parts (lead, i, j) to links (a, b) that join components within a part.

    Rows come sorted by part, with side 0 for block i and 1 for block j.
    """

    def links(rows: dict[str, np.ndarray], sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        left = np.flatnonzero(rows["side"] == 0)
        right = left if rows["i"][0] == rows["j"][0] else np.flatnonzero(rows["side"] == 1)
        n, comp = rows["n"], rows["component"]
        small, large = np.minimum(n[left][:, None], n[right][None, :]), np.maximum(n[left][:, None], n[right][None, :])
        apart = (comp[left][:, None] != comp[right][None, :]) & (100 * small >= percent * large)
        if not apart.any():
            return
        agree = np.zeros((len(left), len(right)), np.int16)
        for k in range(SKETCH):
            agree += rows["sketch"][left, k][:, None] == rows["sketch"][right, k][None, :]
        x, y = np.nonzero(apart & (agree >= SKETCH_MATCHES))
        order = np.argsort(-agree[x, y], kind="stable")
        root = {int(c): int(c) for c in comp}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        for p, q in zip(left[x[order]].tolist(), right[y[order]].tolist(), strict=True):
            one, two = find(int(comp[p])), find(int(comp[q]))
            if one == two:
                continue
            common = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
            if 100 * common >= percent * (len(sets[p]) + len(sets[q]) - common):
                root[max(one, two)] = min(one, two)
                yield int(rows["id"][p]), int(rows["id"][q])

    def whole(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cols = {c: table.column(c).to_numpy() for c in ("lead", "i", "j", "side", "id", "component", "n")}
        cols["sketch"] = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        lists = table.column("shingles").combine_chunks()
        flat, at = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        change = np.flatnonzero(np.any([np.diff(cols[c]) != 0 for c in ("lead", "i", "j")], axis=0)) + 1
        found: list[tuple[int, int]] = []
        for s, e in zip([0, *change], [*change, table.num_rows], strict=True):
            sets = [flat[a:b] for a, b in zip(at[s:e], at[s + 1 : e + 1], strict=True)]
            found += links({c: v[s:e] for c, v in cols.items()}, sets)
        ends = np.array(found, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("lead", "i", "j")])
            same = np.all(keys == keys[:, -1:], axis=0)
            start = 0 if same.all() else int(np.flatnonzero(~same)[-1]) + 1
            ends_held = held and [held[-1].column(c)[0].as_py() for c in ("lead", "i", "j")] != keys[:, -1].tolist()
            if start or ends_held:
                yield from whole(pa.Table.from_batches([*held, batch.slice(0, start)]))
                held = []
            held.append(batch.slice(start))
        if held:
            yield from whole(pa.Table.from_batches(held))

    return run


def _remaining(stars: DataFrame, sets: DataFrame, labels: DataFrame, percent: int, most: int) -> DataFrame:
    """Links between components among the members of each list that holds more than one."""
    leads = stars.select(F.col("a").alias("lead")).distinct()
    lists = stars.select(F.col("a").alias("lead"), F.col("b").alias("id")).unionByName(leads.withColumn("id", F.col("lead")))
    of_lead = labels.select(F.col("id").alias("lead"), F.col("component").alias("main"))
    posts = materialise(lists.join(labels, "id").join(of_lead, "lead").withColumn("rest", F.col("component") != F.col("main")), "lists", most)
    several = posts.groupBy("lead").agg(F.count_if("rest").alias("r"), F.count_if(~F.col("rest")).alias("m")).where("r > 0")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    several = materialise(several.select("lead", blocks("r").alias("rests"), blocks("m").alias("mains")), "several", most)
    rows = posts.join(several, "lead").join(sets, "id")
    # blocks of the rest come first; those of the least id's own component are together already and never meet each other
    own = F.when(F.col("rest"), F.pmod(F.xxhash64("id"), F.col("rests"))).otherwise(F.col("rests") + F.pmod(F.xxhash64("id"), F.col("mains")))
    last = F.when(F.col("rest"), F.col("rests") + F.col("mains") - 1).otherwise(F.col("rests") - 1)
    rows = rows.withColumn("own", own.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    side = (F.col("own") > F.col("other")).cast("int").alias("side")
    part = [F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")]
    rows = rows.select("lead", *part, side, "id", "component", "n", "shingles", "sketch")
    dealt = rows.repartition("lead", "i", "j").sortWithinPartitions("lead", "i", "j")
    return dealt.mapInArrow(_across_blocks(percent), "a long, b long")


def _grouped(reps: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(set_key, component) of all sets."""
    prefixes = _prefixes(reps)
    leaders = prefixes.groupBy("key").agg(F.min("id").alias("lead"), F.count("*").alias("m")).where("m > 1")
    most = prefixes.count()  # of all tables of ids from here on
    leaders = materialise(leaders.select("key", "lead"), "leaders", most)
    stars = prefixes.join(leaders, "key").where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    stars = materialise(stars, "stars", most)
    sets = _full_sets(prefixes, docs, words, most)
    links = materialise(_confirmed(stars, sets, percent), "links")
    labels = materialise(_labelled(sets.select("id"), links), "labels", most)
    links = links.unionByName(materialise(_remaining(stars, sets, labels, percent, 2 * most), "links"))
    labels = _labelled(sets.select("id"), links)
    groups = reps.select("set_key", "id").join(labels.withColumnRenamed("id", "rep"), F.col("id") == F.col("rep"), "left")
    return materialise(groups.select("set_key", F.coalesce("component", "id").alias("component")), "groups", keep=True)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.75
) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) of every row.

    Links are pairs of texts whose sets of word shingles have the Jaccard similarity or more;
    component_id is the least id that links reach. A text with fewer words than a shingle has its
    whole sequence as its one shingle; null texts, empty ones and those without words have none
    and link with nothing. Rows that repeat an id count as one document each, and join its
    component. Rows with a null id are returned with a null component and kept. An empty table
    gives no rows; other columns are ignored. Similarities much under 0.75 lose recall, as MATCHES
    is set for that one.
    """
    bounded_batches(docs.sparkSession)
    percent = round(similarity * 100)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    signed = "id long, n long, set_key binary, coords array<long>"
    signs = materialise(docs.mapInArrow(_sets(words, True), signed), "signatures")
    linked = signs.where("id is not null and set_key is not null")
    reps = linked.groupBy("set_key").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.first("coords").alias("coords"))
    reps = materialise(reps, "reps")
    with passing(docs.sparkSession):
        groups = _grouped(reps, docs.where("id is not null"), words, percent)
    keyed = signs.select("id", "n", F.coalesce("set_key", F.unhex(F.lit("00"))).alias("set_key"))
    out = keyed.join(groups, "set_key", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("id")).alias("kept"),
    )


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.75) -> DataFrame:
    """docs with all their columns, one document of each component: the one of the least id, and all without links."""
    found = near_duplicates(docs, id_col, text, words, similarity)
    gone = materialise(found.where("not kept").select(id_col).distinct(), "gone")
    return without_ids(docs, gone, id_col, id_col)
