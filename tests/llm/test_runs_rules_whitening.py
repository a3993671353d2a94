import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import periodic_runs, queries, rule_ensemble, whitening

# --- periodic runs ---


def runs(words):
    """(start, length, period) of all runs, by trying every period at every word."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words):
    dropped = {i for s, n, q in runs(words) for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def some_words(rng):
    n = int(rng.integers(0, 50))
    words = ["ab", "c", "Ab", "dé"][: int(rng.integers(1, 5))]
    out = [str(w) for w in rng.choice(words, n)]
    if n and rng.random() < 0.5:
        a = int(rng.integers(0, n))
        p = 1 + (n - a) // int(rng.integers(3, 9))
        out = [out[i] if i < a else out[a + (i - a) % p] for i in range(n)]
    return out


def found(texts):
    ids, at, _ = periodic_runs._split(periodic_runs.pa.array(texts))
    rows = periodic_runs.find(ids, at)
    of = np.searchsorted(at, rows[:, 0], "right") - 1
    return [[(int(s - at[k]), int(e - s), int(q)) for s, e, q in rows[of == k]] for k in range(len(texts))]


@pytest.mark.parametrize("pairs", [1 << 19, 5])
def test_runs_against_brute_force(monkeypatch, pairs):
    monkeypatch.setattr(periodic_runs, "PAIRS", pairs)
    rng = np.random.default_rng(3)
    for _ in range(60):
        texts = [some_words(rng) for _ in range(8)]
        assert found([" ".join(t) for t in texts]) == [runs(t) for t in texts]


def test_runs_do_not_lean_on_hashes(monkeypatch):
    """With hashes that are all equal, only the words tell."""
    monkeypatch.setattr(periodic_runs, "_BASE", np.uint64(0))
    rng = np.random.default_rng(4)
    for _ in range(60):
        texts = [some_words(rng) for _ in range(4)]
        assert found([" ".join(t) for t in texts]) == [runs(t) for t in texts]


def test_long_repetitive_words():
    n = 50_000
    assert found(["x " * n]) == [[(0, n, 1)]]
    assert found(["a b c " * n + "a"]) == [[(0, 3 * n + 1, 3)]]
    morse = " ".join("ab"[bin(i).count("1") & 1] for i in range(1 << 12))  # sums of powers modulo 2^64 are known to be equal here
    assert found([morse]) == [runs(morse.split())]


def test_collapsed_texts(spark):
    rng = np.random.default_rng(5)
    texts = [None, "", " \n\t", "a", "a a a a a a", "a a a a a", "x\va\fb\ra b  a b a b\nend", "a a a a a a a a"] + ["  ".join(some_words(rng)) for _ in range(40)]
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(None, "b b b b b b", 7), (3, "c c c c c c c", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int").repartition(3)
    got = sorted((r.doc_id is None, r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.collapse(df).collect() if r.doc_id is not None)
    want = []
    for i, t, _ in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
        want.append((i is None, i, len(words), runs(words), collapsed(words)))
    assert got == sorted(w for w in want if not w[0])
    assert [r.collapsed for r in periodic_runs.collapse(df).collect() if r.doc_id is None] == ["b"]
    assert periodic_runs.collapse(df.limit(0)).count() == 0


def test_runs_query(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(some_words(rng))) for i in range(300)] + [(300, None), (None, "q q q q q q q")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.asDict() for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == 302 and sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(300)) > 10
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for i, t in rows:
        words = (t or "").split()
        h, n = zlib.crc32(str(i).encode()) if i is not None else 1, len(words)
        if h % 10 == 0 and n:
            a = (h // 10) % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[k if k < a else a + (k - a) % p] for k in range(n)]
        all_ = runs(words)
        s, m, q = max(all_, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in all_)
        assert got[i] == {"doc_id": i, "n_runs": len(all_), "start": s, "length": m, "period": q, "exponent_milli": m and 1000 * m // q, "runs_sha256": sha(lines), "collapsed_sha256": sha(collapsed(words))}


# --- rule ensemble ---

GOOD = ["The river runs down to the old mill, and the people of the town walk there in summer.", "He said that nothing was lost. They came home late, and slept.", "We find the result in three steps; each of them is short."]
BAD = ["BUY!! NOW!! CHEAP!! BUY!! NOW!! CHEAP!!", "a%%% b$$$ c### d&&& e*** f%%%", "home | login | about | help | map", "ha ha ha ha ha ha ha ha ha ha ha ha"]


def quality(spark, n=240):
    rows = [(i, f"{(BAD if i % 3 == 0 else GOOD)[i // 3 % 3]} word{i}", int(i % 3 != 0)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    return df.select("doc_id", "text", F.lit(1).alias("mark"), F.lit(2).alias("score")), df.select("doc_id", "quality", F.lit("x").alias("text"))


def test_statistics(spark):
    texts = [None, "", "Ab, c!", "x y x\nx|", "ÀÉ 12 ½", "  \n", "a" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.id: r for r in rule_ensemble.statistics(df).collect()}
    assert all(got[i][s] == 0 for i in (0, 1) for s in rule_ensemble.STATISTICS)
    assert not any(v is None for r in got.values() for v in r)
    assert (got[2].letter_share, got[2].capital_share, got[2].stop_share, got[2].bangs_by_word, got[2].ends_by_word) == (3 / 5, 1 / 3, 2 / 5, 0.5, 0.5)
    assert (got[3].distinct_words, got[3].bars_by_word, got[3].breaks_by_word, got[3].distinct_lines, got[3].mark_share) == (3 / 4, 1 / 4, 1 / 4, 1.0, 1 / 5)
    assert (got[4].capital_share, got[4].digit_share) == (1.0, 2 / 5)
    assert got[6].word_chars == 100_000


def test_quality_is_learned(spark):
    docs, labels = quality(spark)
    counted = rule_ensemble.statistics(docs)
    model = rule_ensemble.fit(counted, labels.where("doc_id < 160"))
    assert 0 < len(model.rules) < 60
    got = rule_ensemble.score(counted, model).join(labels, "doc_id").where("doc_id >= 160").collect()
    assert len(got) == 80 and all(r.predicted == r.quality == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got)


def test_compiled_rules_equal_plain_ones(spark):
    docs, labels = quality(spark, 90)
    counted = rule_ensemble.statistics(docs)
    model = rule_ensemble.fit(counted, labels)
    plain = {}
    for r in counted.collect():
        odds = model.offset + sum(w for rule, w in model.rules if all((r[rule_ensemble.STATISTICS[s]] > t) == over for s, t, over in rule))
        plain[r.id] = 1 / (1 + np.exp(-odds))
    got = {r.doc_id: r.score for r in rule_ensemble.score(counted, model).collect()}
    assert got.keys() == plain.keys() and all(abs(got[i] - plain[i]) < 1e-12 for i in got)


def test_lasso_leaves_few_rules_and_is_optimal():
    rng = np.random.default_rng(2)
    z = (rng.random((400, 30)) < 0.5).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * z[:, 0] - 3 * z[:, 1] + 0.5)))).astype(float)
    beta = rule_ensemble._lasso(z, y, np.ones(400), 0.03, np.zeros(31))
    slope = z.T @ (1 / (1 + np.exp(-(beta[0] + z @ beta[1:]))) - y) / 400
    assert set(np.flatnonzero(beta[1:])) == {0, 1}
    assert np.all(np.abs(slope) <= 0.03 + 1e-4) and np.allclose(slope[[0, 1]], -0.03 * np.sign(beta[[1, 2]]), atol=1e-4)


def test_quality_edges(spark):
    docs, labels = quality(spark, 60)
    more = docs.unionByName(docs.limit(0)).unionByName(spark.createDataFrame([(None, "x", 1, 2), (3, "again", 1, 2), (500, None, 1, 2)], docs.schema))
    counted = rule_ensemble.statistics(more)
    odd = labels.unionByName(spark.createDataFrame([(None, 1, "x"), (7, None, "x"), (8, 5, "x"), (9999, 0, "x"), (0, 1, "x")], labels.schema))
    model = rule_ensemble.fit(counted, odd)
    assert rule_ensemble.score(counted, model).count() == 63
    assert rule_ensemble.score(counted.limit(0), model).count() == 0
    none = rule_ensemble.fit(counted, labels.limit(0))
    assert {(r.score, r.predicted) for r in rule_ensemble.score(counted, none).collect()} == {(0.5, 1)}
    ones = rule_ensemble.fit(counted, labels.where("quality = 1"))
    assert ones.rules == [] and 0.9 < 1 / (1 + np.exp(-ones.offset)) < 1
    first = rule_ensemble.fit(counted.repartition(5, "mark"), odd.repartition(3))
    assert first == model  # whatever the order of rows


# --- whitening ---


def plain(vectors, k=16):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    c = u - s / n
    values, w = np.linalg.eigh(c.T @ c / n)
    values, w = values[::-1][:k], w[:, ::-1][:, :k]
    return x, n, s, values, w, np.trace(c.T @ c / n)


@pytest.mark.parametrize(("d", "k"), [(5, 16), (64, 16), (120, 6)])
def test_whitening_against_plain_eigenvectors(spark, d, k):
    rng = np.random.default_rng(d)
    vectors = (rng.normal(size=(300, d)) * np.linspace(0.1, 1.5, d)).astype(np.float32)
    vectors[250:] = vectors[:50]  # the fit list has them once
    df = spark.createDataFrame([(i, v.tolist(), 0.5) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, whitened double").repartition(5)
    x, n, s, values, w, trace = plain(vectors, k)
    got = whitening.whiten(df, components=k).orderBy("vec_id", "component").collect()
    m = min(d, k)
    assert [(r.vec_id, r.component) for r in got] == [(i, j + 1) for i in range(300) for j in range(m)]
    mine = np.array([r.whitened for r in got]).reshape(300, m)
    want = (x - s / n) @ w / np.sqrt(values)
    assert np.allclose(mine * np.sign((mine * want).sum(0)), want, atol=1e-8)
    assert {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-10
    assert [r.deviation for r in got[::m]] == [sum(int(a) ** 2 for a in row) for row in n * x - s]
    assert np.allclose([r.explained for r in got[:m]], values / trace, rtol=1e-9)


def test_large_matrices_are_searched_in_blocks():
    rng = np.random.default_rng(0)
    d, widths = 300, []
    turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
    for spectrum in (np.linspace(1, 0.2, d), np.append(np.full(40, 1.0), np.linspace(0.99, 0.1, d - 40)), np.zeros(d)):
        matrix = turn @ np.diag(spectrum) @ turn.T

        def product(q, matrix=matrix):
            widths.append(q.shape[1])
            return matrix @ q

        values, x, error = whitening.largest_pairs(product, d, 16)
        assert np.allclose(values, np.sort(spectrum)[::-1][:16], atol=1e-12) and error <= 1e-12
        assert np.allclose(x.T @ x, np.eye(16), atol=1e-12) and np.abs(matrix @ x - x * values).max() < 1e-12
    assert min(widths) == 24 and len(widths) < 400


def test_whitening_edges(spark):
    kind = "vec_id long, embedding array<double>"
    nan, far = float("nan"), float("inf")
    rows = [(1, [0.1, 0.2]), (1, [0.1, 0.2]), (None, [0.5, -0.2]), (2, None), (3, []), (4, [1.0, None]), (5, [nan, 1.0]), (6, [far, 1.0]), (7, [0.3, 0.9]), (8, [1e300, -1e300])]
    got = whitening.whiten(spark.createDataFrame(rows, kind)).collect()
    assert sorted(str(r.vec_id) for r in got) == sorted(["1"] * 4 + ["None"] * 2 + ["7"] * 2 + ["8"] * 2)
    assert {r.n for r in got} == {4}
    flat = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], kind)).collect()  # one distinct vector
    assert [(r.whitened, r.explained, r.deviation, r.n) for r in flat] == [(None, 0.0, 0, 1)] * 4
    line = whitening.whiten(spark.createDataFrame([(i, [i / 8, i / 4]) for i in range(5)], kind)).orderBy("vec_id", "component").collect()
    assert [r.whitened is None for r in line] == [False, True] * 5 and abs(line[0].explained - 1) < 1e-12
    mixed = whitening.whiten(spark.createDataFrame([(i, [float(i)] * (1 + i % 2)) for i in range(8)], kind)).collect()
    assert sorted((r.vec_id, r.component) for r in mixed) == sorted((i, k + 1) for i in range(8) for k in range(1 + i % 2))
    assert {r.n for r in mixed} == {4}
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0


def test_deviations_beyond_a_long():
    big = whitening.Fit(1 << 30, np.array([5, 5]), np.array([3, 0]), np.ones(1), np.ones((2, 1)))
    x = np.array([[5, 5], [7, 5], [6, 4], [900_000, 5]])
    exact = [sum(((1 << 30) * (int(v) - 5) - r) ** 2 for v, r in zip(row, (3, 0), strict=True)) for row in x]
    assert big.deviations(x) == [e if e < 1 << 63 else None for e in exact] and exact[-1] > 1 << 63 > exact[2]
