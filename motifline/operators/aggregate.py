"""A generic aggregator: partial results by worker, merged to final ones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def two_phase(
    rows: DataFrame, keys: Sequence[str], partial: Mapping[str, Column], final: Mapping[str, Column], spread: Sequence[str], workers: int = 16
) -> DataFrame:
    """``keys`` and ``final``, which merges the ``partial`` aggregates of each worker.

    A row's worker is a hash of its ``spread`` columns, so a key that holds most of the rows is shared by all
    of them, also for aggregates that cannot be combined before the shuffle (such as distinct counts).
    """
    worker = F.pmod(F.xxhash64(*spread), F.lit(workers))
    parts = rows.groupBy(*keys, worker.alias("_worker")).agg(*[c.alias(n) for n, c in partial.items()])
    merged = [c.alias(n) for n, c in final.items()]
    return (parts.groupBy(*keys) if keys else parts).agg(*merged)
