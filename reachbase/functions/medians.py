"""Order statistics by position: exact, without interpolation, and combined on the map side.

``percentile_disc`` keeps a count for each distinct value and merges them, so no group's rows
are collected. Over descending values it gives the upper of two middles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _disc(value: str, share: float, order: str, where: str | None) -> Column:
    condition = f" FILTER (WHERE {where})" if where else ""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {value} {order}){condition}")


def upper_middle(value: str, where: str | None = None) -> Column:
    """v[n div 2] of the sorted values (from 0); null if there are none."""
    return _disc(value, 0.5, "DESC", where)


def lower_middle(value: str, where: str | None = None) -> Column:
    """v[(n - 1) div 2]."""
    return _disc(value, 0.5, "ASC", where)


def at_share(value: str, share: float, where: str | None = None) -> Column:
    """v[floor(n * share)] for a share above 0 and below 1."""
    return _disc(value, round(1 - share, 9), "DESC", where)
