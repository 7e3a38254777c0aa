"""Hints to the optimizer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns that are computed once, where they stand.

    The optimizer moves a filter on a computed column (also the one it infers from ``explode``)
    below the projections and shuffles that lead to it, and copies their expressions into the
    filter: text would be matched twice, before it is spread over the cluster, and with columns
    building on one another the copies multiply. A generator of exactly one row stops that, for
    filters on what it makes. Filters on all other columns still go through to the scan.
    """
    row = F.struct(*[column.alias(f"_new_{name}") for name, column in columns.items()])
    made = df.select("*", F.inline(F.array(row))).drop(*columns)
    return made.withColumnsRenamed({f"_new_{name}": name for name in columns})
