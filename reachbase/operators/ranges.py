"""Places and running sums over all rows in one order, without sorting them in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachbase.operators.graph import cut_lineage

#: Rows of a base table that one part holds at most, about: a task's sorts then take some 100 MB each, however long the table.
PART_ROWS = 500_000


def parts_for(base: DataFrame, rows: int = PART_ROWS) -> int:
    """In how many parts work on a base table's rows is dealt; counted without reading columns."""
    return -(-base.count() // rows)


def dealt(rows: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """Rows by keys in so many parts; left to Spark where the session's number of them is enough."""
    enough = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *keys) if parts and parts > enough else rows


def running_sums(rows: DataFrame, order: Sequence[str], sums: dict[str, str], within: str | None = None) -> DataFrame:
    """Adds for each ``name: column`` of sums the sum of the column over all earlier rows.

    order: columns to sort by, nulls first; within: a non-null column whose values each start
    from 0 again. Rows are range-partitioned by (within, order), so a value that holds a third
    of them is spread too; totals of the partitions give where each one starts. Rows that are
    equal in ``order`` come in any order. An empty table gives an empty one.
    """
    keys = [within] if within else []
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written once: sampling again for another run of this plan could move the bounds of the ranges.
    parts = cut_lineage(rows.repartitionByRange(count, *keys, *order).withColumn("_part", F.spark_partition_id()))
    totals = parts.groupBy("_part", *keys).agg(*[F.sum(c).alias(f"_total_{n}") for n, c in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", *keys, *[_or_zero(F.sum(f"_total_{n}").over(earlier)).alias(f"_start_{n}") for n in sums])
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.join(starts, ["_part", *keys]).select(*rows.columns, *[(F.col(f"_start_{n}") + _or_zero(F.sum(c).over(inside))).alias(n) for n, c in sums.items()])


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def places(rows: DataFrame, order: Sequence[str], within: str | None = None, name: str = "place") -> DataFrame:
    """Adds each row's place from 0 in the order, within each value of ``within`` if it is given."""
    return running_sums(rows.withColumn("_one", F.lit(1).cast("long")), order, {name: "_one"}, within).drop("_one")
