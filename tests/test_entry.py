"""Queries beside their SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
NAMES = ["s1_read_edge_list", "p3_grounded_laplacian", "p6_without_edges", "j2_laplacian_times", "a4_leaf_counts", "w1_first_appearance", "g1_components", "a8_bridge_statistics", "c1_exact_centrality", "d1_d6_decomposed_centrality", "c6_exact_greedy"]


@pytest.fixture(scope="module")
def tables():
    if not DATA.exists():
        pytest.skip("no test data")
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def same(spark_rows, sql):
    columns = sorted(sql.columns)
    a, b = (sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in x), key=repr) for x in (spark_rows.select(*columns).collect(), sql.select(*columns).fetchall()))
    return len(a) == len(b) and all(x == pytest.approx(y, abs=2e-6) if not any(isinstance(v, str) for v in x) else x == y for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", NAMES)
def test_query_gives_what_its_sql_gives(spark, tables, name):
    assert same(entry.queries()[name](spark, str(DATA)), tables.sql(entry.oracle_sql()[name]))


def test_entry(spark):
    found = entry.entry(spark).collect()
    assert len(found) == 10 and found[0]["node"] == 99


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
