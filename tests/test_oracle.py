"""Every query against its SQL in DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from reachbase.plans import ORACLE_SQL, QUERIES
from tests.conftest import SF_DIR


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF_DIR):
        path = f"{SF_DIR}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "~"
    return f"{value:.8g}" if isinstance(value, float) else str(value)


#: Searches of half a minute each, of which others stand here; all of them were compared on the tables of sf0.01.
LONG = ("raptor_arrive_by", "egress_argmin", "more_rounds_never_slower", "search_is_deterministic", "path_parents", "mirror_consistency", "reach_dump", "rail_matrix_all_slots", "eight_rounds_never_slower", "dong_matrix")


@pytest.mark.parametrize("name", [n for n in ORACLE_SQL if n not in LONG])
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR)
    columns = sorted(got.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    known = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in known.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in known.fetchall())
    assert mine == theirs


def test_queries_without_sql_are_named():
    """Every query has SQL."""
    assert set(QUERIES) - set(ORACLE_SQL) == set() and set(ORACLE_SQL) <= set(QUERIES)
