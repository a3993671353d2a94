"""How much the plans move: rows of apps once, and no pairs."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestrata import tables
from lodestrata.operators import grams, joins, ranges
from lodestrata.plans import vulnerabilities
from lodestrata.queries import vulnerabilities as queries
from lodestrata.sources import documents


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def components_and_entries(spark):
    rng = random.Random(8)
    names = [("com.a.red.bolt", "red bolt"), ("com.a.hot.bolt", "hot bolt"), ("org.rod", "rod"), ("org.other", "other"), (None, None)]
    versions = ["1", "1.5", "2", "3.1", "9", "", None, "junk"]
    sdks = [(rng.choice([f"app{i % 40}", None]) if i % 25 == 0 else f"app{i % 40}", *rng.choice(names), rng.choice(versions)) for i in range(300)]
    bound = "array<struct<start_including:string,start_excluding:string,end_including:string,end_excluding:string>>"
    cves = [(f"C{i % 7}", rng.choice(["u", "v"]), rng.choice(["bolt", "red", "hot", "rod"]), "HIGH", float(i), "2024", [(str(i % 4), None, None, str(i % 4 + 1))]) for i in range(20)]
    return spark.createDataFrame(sdks, "sample_id string, sdk_identifier string, sdk_name string, sdk_version string"), spark.createDataFrame(cves, f"cve_id string, vendor string, product string, severity string, score double, published string, version_ranges {bound}")


def test_vulnerable_components_are_moved_once(spark, monkeypatch):
    monkeypatch.setattr(vulnerabilities, "TASK_ROWS", 100)
    sdks, cves = components_and_entries(spark)
    found = vulnerabilities.matches(sdks, cves)
    rows = found.collect()
    assert len({(r.sample_id, r.sdk_identifier, r.cve_id) for r in rows}) == len(rows) > 50
    given = vulnerabilities.matches(vulnerabilities.with_tokens(sdks), cves)
    assert sorted(map(repr, given.collect())) == sorted(map(repr, rows))
    # the first of an app's versions and products counts
    for r in rows:
        same = [x for x in rows if (x.cve_id, x.sdk_identifier, x.sample_id) == (r.cve_id, r.sdk_identifier, r.sample_id)]
        assert same == [r]
    text = plan_of(vulnerabilities.app_summary(found)).split("== Initial Plan ==")[-1]
    assert text.count("Exchange hashpartitioning(sample_id") == text.count("Exchange hashpartitioning") == 1 and "Window" not in text and "Expand" not in text
    want = {}
    for r in rows:
        want.setdefault(r.sample_id, []).append(r)
    got = {r.sample_id: tuple(r)[1:] for r in vulnerabilities.app_summary(found).collect()}
    assert got == {s: (len(x), len({r.cve_id for r in x}), len({r.sdk_identifier for r in x}), max(r.score for r in x)) for s, x in want.items()}


def test_pairs_are_not_grouped(spark):
    sdks, cves = components_and_entries(spark)
    found = vulnerabilities.matches(sdks, cves)
    assert not [x for x in plan_of(found).splitlines() if "Aggregate" in x and "cve_id" in x]
    kinds, own = vulnerabilities._components(sdks)
    entries, want, forms = vulnerabilities._entries(kinds, cves).collect(), {}, {}
    order = lambda e: tuple(e[c] or "" for c in ("product", "vendor", "sdk_name", "sdk_version"))
    for s in sdks.collect():
        for e in entries:
            if [s[c] for c in own] == [e[c] for c in own]:
                key = (s.sample_id, e.sdk_identifier, e.cve_id)
                want[key] = min(want.get(key, e), e, key=order)
                forms.setdefault(key[:2], set()).add(e.kind)
    # one, two and more forms of an identifier in a sample, and samples without a name
    assert {1, 2, 3} <= {len(x) for x in forms.values()} and any(s is None for s, _, _ in want)
    got = {(r.sample_id, r.sdk_identifier, r.cve_id): r for r in found.collect()}
    assert {k: tuple(r)[2:] for k, r in got.items()} == {k: tuple(e[c] for c in found.columns[2:]) for k, e in want.items()}
    assert found.count() == len(want)


def test_outcomes_without_pairs(spark):
    sdks, cves = components_and_entries(spark)
    got = sorted(map(repr, vulnerabilities.judged(sdks, cves).collect()))
    assert got == sorted(map(repr, vulnerabilities.outcomes(sdks, vulnerabilities.matches(sdks, cves)).collect()))
    kinds = {r.outcome: r.n for r in vulnerabilities.judged(sdks, cves).groupBy("outcome").agg(F.count("*").alias("n")).collect()}
    assert sum(kinds.values()) == 300 and set(kinds) == {"matched", "no_version", "parse_error", "no_nvd_entry"}
    # another version of the same component in the same app, itself in no range, is matched with it
    pair = spark.createDataFrame([("a", "org.rod", "rod", "50"), ("a", "org.rod", "rod", "1.5"), ("b", "org.rod", "rod", "50")], sdks.schema)
    one = cves.limit(1).select(F.lit("C").alias("cve_id"), "vendor", F.lit("rod").alias("product"), "severity", "score", "published", F.expr("array(named_struct('start_including', '1', 'start_excluding', cast(null as string), 'end_including', cast(null as string), 'end_excluding', '2'))").alias("version_ranges"))
    assert sorted((r.sample_id, r.sdk_version, r.outcome) for r in vulnerabilities.judged(pair, one).collect()) == [("a", "1.5", "matched"), ("a", "50", "matched"), ("b", "50", "no_nvd_entry")]


def test_candidates_of_single_rows_are_not_moved(spark):
    items = spark.createDataFrame([(i, ["a", "b", "a"] if i % 2 else ["the"]) for i in range(40)], "item int, tokens array<string>")
    products = spark.createDataFrame([(j, "the" if j % 2 else "ab"[j % 4 // 2]) for j in range(20)], "j int, product string")
    want = sorted((i, j) for i in range(40) for j in range(20) if (i % 2 == 1) == (j % 2 == 0))
    found = joins.token_candidates(items, "item", "tokens", products, "product", ["j"])
    assert sorted((r.item, r.j) for r in found.collect()) == want
    # the pairs of distinct items and keys meet no aggregate
    assert "Aggregate" not in plan_of(found).split("Join")[0]
    # other rows of an item, of no item and of a key
    more = items.unionByName(spark.createDataFrame([(3, ["the", "b"]), (None, ["a"]), (None, ["the"])], items.schema))
    also = products.unionByName(spark.createDataFrame([(0, "the"), (1, "b"), (1, "the"), (None, "a"), (None, "a")], products.schema))
    got = joins.token_candidates(more, "item", "tokens", also, "product", ["j"]).collect()
    pairs = {(a.item, b.j) for a in more.collect() for b in also.collect() if b["product"] in a.tokens}
    assert len(got) == len(pairs) and {(r.item, r.j) for r in got} == pairs


def test_short_rows_are_dealt_out(spark, tmp_path):
    spark.range(35).coalesce(1).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    assert table.rdd.getNumPartitions() == 1
    many = tables.dealt(table, 10)
    assert many.rdd.getNumPartitions() == 4 and sorted(r.id for r in many.collect()) == list(range(35))
    assert tables.dealt(table, 100) is table


def test_evidence_parses_once(spark):
    xml = b'<manifest xmlns:android="u" package="p"><application><provider android:name="P" android:authorities="a;b"/><uses-library android:name="L"/><meta-data android:name="k" android:value="v"/></application></manifest>'
    files = spark.createDataFrame([("s", bytearray(xml)), ("t", bytearray(xml[:60]))], "sample_id string, content binary")
    found = documents.evidence(documents.manifests(files))
    assert sorted((r.sample_id, r.source, r.value) for r in found.collect()) == [("s", "authority", "a"), ("s", "authority", "b"), ("s", "component", "P"), ("s", "library", "L"), ("s", "meta_name", "k"), ("s", "meta_value", "v")]
    assert plan_of(found).count("from_xml(") == 1


def test_splits_grow_in_number_of_tasks(spark, monkeypatch):
    monkeypatch.setattr(joins, "TASK_FILES", 10)
    rows = [(i % 9, n, abi) for i in range(60) for n, abi in [(i, ["x86", "arm64", "armv7", None, "mips"][i % 5])]] + [(None, 99, "arm64")]
    files = spark.createDataFrame(rows, "app int, name int, abi string")
    ranks = {"arm64": 1, "armv7": 2}
    best = {a: min(ranks[x] for b, _, x in rows if b == a and x in ranks) for a in range(9)}
    chosen = joins.preferred_splits(files, spark.createDataFrame(list(ranks.items()), "abi string, rank int"))
    assert sorted(map(repr, (tuple(r) for r in chosen.collect()))) == sorted(repr(r) for r in rows if r[2] is None or r[0] is not None and ranks.get(r[2]) == best[r[0]])
    assert "Exchange hashpartitioning(app" in plan_of(chosen) and ", 7), REPARTITION_BY_NUM" in plan_of(chosen)


def test_ranges_go_through_the_merge_with_their_columns(spark, monkeypatch):
    monkeypatch.setattr(ranges, "PART_ROWS", 60)
    rng = random.Random(5)
    dotted = lambda n: f"23.5.{n // 256}.{n % 256}"
    spans = [(low, low + rng.choice([0, 3, 40, 400, 3000]), i) for i, low in enumerate(rng.randrange(4000) for _ in range(150))]
    probes = [rng.randrange(8000) for _ in range(400)]
    table = spark.createDataFrame([(dotted(low), dotted(high), [i, None]) for low, high, i in spans], "lo string, hi string, ids array<int>")
    df = spark.createDataFrame([(dotted(p),) for p in probes] + [("10.0.0.1",), (None,)], "ip string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # ranges stay open from batch to batch
    try:
        found = joins.range_lookup(df, "ip", table, "lo", "hi")
        got = sorted(map(repr, ((r.ip, r.lo, r.hi) for r in found.collect())))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    best = lambda p: min(((high - low, low, dotted(low), dotted(high)) for low, high, _ in spans if low <= p <= high), default=(None,) * 4)[2:]
    assert got == sorted(map(repr, [(dotted(p), *best(p)) for p in probes] + [("10.0.0.1", None, None), (None, None, None)]))
    # what the merge found is joined to the rows and to nothing else
    assert plan_of(found).split("== Initial Plan ==")[-1].split("MapInArrow")[0].count("Join") == 1


def test_keywords_of_a_long_text_do_not_copy_it(monkeypatch):
    monkeypatch.setattr(grams, "PIECE", 64, raising=False)
    rng = random.Random(6)
    words = ["".join(rng.choice("abcd") for _ in range(n)) for n in (1, 2, 3, 4, 5, 7, 9) for _ in range(12)]
    texts = ["", "".join(rng.choice("abcdx") for _ in range(3000)), "a", "", "bc", "".join(rng.choice("abcdx") for _ in range(500)), "zzz", ""]
    size = lambda w: next(n for n in grams.SIZES if n <= len(w))
    anchors = {(size(w) << 56) + int.from_bytes(w[: size(w)].encode()): w[: size(w)] for w in words}
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], ["k", "t"])
    for part in (batch, batch.slice(1, 6)):  # one begins within its buffers
        out = list(grams._hits(np.array(sorted(anchors)), 1)(iter([part])))
        rows = [r for b in out for r in b.to_pylist()]
        assert len({r["k"] for r in rows}) == len(rows)  # each text once
        got = {(r["k"], anchors[a]) for r in rows for a in r["_anchors"]}
        assert got == {(k, p) for k, t in zip(part["k"].to_pylist(), part["t"].to_pylist()) for p in anchors.values() if p in t}


def test_components_are_found_in_one_pass(spark):
    sdks, cves = components_and_entries(spark)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    kinds, _ = vulnerabilities._components(sdks.mapInArrow(counted, sdks.schema))
    assert seen.value == sdks.count()
    own = ["sdk_identifier", "sdk_name", "sdk_version"]
    assert sorted(map(repr, kinds.select(*own).collect())) == sorted(map(repr, sdks.select(*own).distinct().collect()))


def test_parts_are_spelled_once(spark, tmp_path, monkeypatch):
    parts = [(i, f"Red bolt {i % 3}", i % 5 if i % 6 else None) for i in range(30)]
    items = [(i // 3, i % 32 if i % 9 else None, i % 3) for i in range(90)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    of = {k: (name, size) for k, name, size in parts}
    version = lambda k, n: "" if k % 11 == 0 else "not-a-version" if k % 13 == 0 else ".".join(str(x) for x in (of[k][1], n) if x is not None)
    want = sorted((f"app{o}", "pkg." + of[k][0].lower().replace(" ", "."), of[k][0], version(k, n)) for o, k, n in items if k in of)
    for most, join in ((2_000_000, "BroadcastHashJoin"), (29, "ShuffledHashJoin")):
        monkeypatch.setattr(queries, "MOST_PARTS", most, raising=False)
        sdks = queries._sdks(spark, str(tmp_path))
        text = plan_of(sdks)
        assert join in text and "translate(" not in text.split(join)[0] and "translate(" in text.split(join)[1]
        assert sorted(map(tuple, sdks.collect())) == want
