"""Label algebra as native expressions."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegate.model import CRISIS, LABEL_CODES, LABEL_RANKS, MALIGN, VALID


def _lookup(key: Column, table: Mapping[str, object]) -> Column:
    first, *rest = table.items()
    start = F.when(key == first[0], F.lit(first[1]))
    return reduce(lambda case, item: case.when(key == item[0], F.lit(item[1])), rest, start)


def label_code(label: Column) -> Column:
    return _lookup(label, LABEL_CODES)


def label_rank(label: Column) -> Column:
    return _lookup(label, LABEL_RANKS)


def is_blocking(label: Column) -> Column:
    return label.isin(CRISIS, MALIGN)


def normalise_label(raw: Column, label_map: Mapping[str, str]) -> Column:
    """Map keys are compared with the upper-cased raw label; unknown labels become Valid."""
    table = F.create_map(*[F.lit(x) for pair in label_map.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.upper(raw)), F.lit(VALID))


def gate(label: Column, score: Column, threshold: float) -> Column:
    """Below the threshold a non-Valid label is downgraded; equality keeps it."""
    return F.when((score < F.lit(float(threshold))) & (label != VALID), F.lit(VALID)).otherwise(label)


def score_out_of_bounds(score: Column) -> Column:
    """NaN sorts above every number in Spark, so it needs its own test."""
    return F.isnan(score) | (score < 0.0) | (score > 1.0)
