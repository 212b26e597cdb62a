"""The queries that have SQL against it in DuckDB on the smallest tables."""

import duckdb
import pytest

from reachbase.llm.queries import ORACLE_SQL, QUERIES
from tests.test_oracle import plain


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_equals_its_sql(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    con = duckdb.connect()
    for table in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    known = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in known.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in known.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == theirs
