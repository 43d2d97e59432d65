"""Joins with a side whose size is checked, not assumed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a written table of a few narrow columns is broadcast: some tens of megabytes.
BROADCAST_ROWS = 200_000


def join_checked(large: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """Joins with ``small``, a written table: broadcast if a count proves it small, so that hot keys of ``large`` stay where they are.

    Otherwise the join shuffles, and adaptive execution splits what is skewed. ``how`` must keep only rows of ``large`` or matches.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(how)
    return large.join(F.broadcast(small) if small.count() <= most else small, keys, how)
