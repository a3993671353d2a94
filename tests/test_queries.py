"""Every query that has SQL gives the rows of that SQL, on the smallest tables."""

import os

import duckdb
import pytest

from lodestrata.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in ORACLE_SQL:
        assert got
        return
    cursor = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", ["flow_buckets", "topk_share", "cve_outcomes", "tracker_longest_suffix"])
def test_partitions_do_not_matter(name, spark):
    seen = set()
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.add(tuple(sorted(map(repr, QUERIES[name](spark, SF).collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(seen) == 1
