"""Queries of the catalogue hold the rows of their SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from skymosaic.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: "~" if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, oracle, name):
    df = catalogue.QUERIES[name](spark, SF)
    cursor = oracle.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, cursor.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).columns == ["tile_id", "ann_id", "class_id", "visible"] and entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_hill_climb_finds_a_split(spark):
    if os.path.isdir(SF):
        assert {r.split for r in catalogue.QUERIES["split_hill_climb"](spark, SF).collect()} <= {"train", "val", "test"}
