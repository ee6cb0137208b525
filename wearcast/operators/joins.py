"""Dimension joins.

The join itself is left to the planner: a dimension whose size in bytes is
known to be below the session's broadcast threshold is broadcast, one that
turns out so at run time is switched to by AQE, and otherwise it is a
sort-merge join whose hot keys AQE splits.  Nothing is run or counted while
the plan is built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def join_dimension(fact: DataFrame, dim: DataFrame, on, how: str = "left") -> DataFrame:
    """Join ``fact`` to ``dim`` (one row per key)."""
    return fact.join(dim, on=on, how=how)
