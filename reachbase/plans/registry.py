"""Queries by name, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reachbase.sources.bridge import load, oracle

Table = Callable[[str], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable[[Table], DataFrame]], Callable[[Table], DataFrame]]:
    """Registers a function of a table reader. Without SQL, tests compare it with a plain version."""

    def add(f: Callable[[Table], DataFrame]) -> Callable[[Table], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: load(spark, sf_dir, name))
        if sql is not None:
            ORACLE_SQL[f.__name__] = oracle(sql.replace("{{", "\x00").replace("}}", "\x01")).replace("\x00", "{").replace("\x01", "}")
        return f

    return add
