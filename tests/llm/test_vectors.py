import numpy as np
import pytest

from lodestrata.llm import grid_order_join


def brute(vectors, threshold):
    """{id: (links, component)} of {id: vector or None}."""
    good = {i: np.array(v, float) for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {i: set() for i, _ in vectors}
    for i, a in good.items():
        for j, b in good.items():
            if i != j and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                links[i].add(j)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        out[i] = (len(links[i]), min(seen))
    return out


def check(spark, vectors, threshold=0.9):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").selectExpr("*", "1 as node", "'x' as root", "2 as copies")
    got = {r.vec_id: (r.n_links, r.component_id) for r in grid_order_join.near_duplicates(df, threshold=threshold).collect()}
    exact = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors]
    assert got == brute(exact, threshold)


@pytest.mark.parametrize("block", [7, 2048])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(grid_order_join, "BLOCK", block)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 12))
    rows = [(i, (centres[i % 6] + rng.normal(size=12) * 0.25).tolist()) for i in range(60)]
    rows += [(100 + i, rng.normal(size=12).tolist()) for i in range(20)]
    rows += [(200 + i, rows[0][1]) for i in range(15)]  # exact copies
    rows += [(300, None), (301, []), (302, [0.0] * 12), (303, [float("nan")] * 12), (304, [None] * 12), (305, [1.0, 2.0]), (306, [2.0, 4.0]), (307, [float("inf")] * 12)]
    check(spark, rows)


def test_edges(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert grid_order_join.near_duplicates(empty).collect() == []
    one = spark.createDataFrame([(1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in grid_order_join.near_duplicates(one).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), None: (0, None, True)}
    twice = spark.createDataFrame([(1, [1.0, 0.0])] * 3 + [(2, [0.0, 1.0]), (2, [1.0, 0.1])], "vec_id long, embedding array<float>")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in grid_order_join.near_duplicates(twice).collect())
    assert got == [(1, 3, 1, True)] * 3 + [(2, 0, 2, True), (2, 3, 1, False)]


def test_skips_distant_blocks(spark, monkeypatch):
    """Two far groups: no block of one meets a block of the other."""
    monkeypatch.setattr(grid_order_join, "BLOCK", 5)
    met = []
    whole = grid_order_join._near_blocks
    monkeypatch.setattr(grid_order_join, "_near_blocks", lambda *a: met.append(whole(*a)) or met[-1])
    rng = np.random.default_rng(2)
    rows = [(i, ([10.0, 0, 0] if i % 2 else [0, 10.0, 0] + rng.normal(size=3) * 0.1)) for i in range(60)]
    rows = [(i, (np.array(v) + rng.normal(size=3) * 0.05).tolist()) for i, v in rows]
    check(spark, rows)
    n = len({r.i for r in met[0].collect()} | {r.j for r in met[0].collect()})
    assert met[0].count() < n * (n + 1) / 2
