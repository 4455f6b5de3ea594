"""Counts of rows and distinct users at several levels, exact or from sketches that can be united."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The logarithm of a sketch's registers; its standard error is about 1.04 / sqrt(2^LG_K): 1.6 %.
LG_K = 12
#: Of an estimate, at three standard errors.
ERROR = 3 * 1.04 / 2 ** (LG_K / 2)


def _levels(df: DataFrame, levels: Sequence[Sequence[str]], dimensions: Sequence[str]):
    return df.groupingSets([[F.col(c) for c in level] for level in levels], *[F.col(c) for c in dimensions])


def rollup(df: DataFrame, dimensions: Sequence[str], user: str, levels: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """Dimensions, level, n, users: rows and distinct users of every level (all subsets of the dimensions, if none are given).

    ``level`` is Spark's grouping_id: a bit is set for each dimension that is summed over, the first one
    the highest, which tells a null value from a total.  Rows are first counted by all
    dimensions and user, so what is copied for each level is distinct already; users who are null are not counted.
    """
    each = df.groupBy(*dimensions, user).agg(F.count(F.lit(1)).alias("_n"))
    wanted = levels if levels is not None else [[d for i, d in enumerate(dimensions) if mask >> i & 1] for mask in range(1 << len(dimensions))]
    if unknown := sorted({c for level in wanted for c in level} - set(dimensions)):
        raise ValueError(f"no dimensions {unknown}")
    return _levels(each, wanted, dimensions).agg(F.grouping_id().cast("long").alias("level"), F.sum("_n").alias("n"), F.count_distinct(user).alias("users"))


def daily_sketches(df: DataFrame, day: str, dimensions: Sequence[str], user: str, lg_k: int = LG_K) -> DataFrame:
    """Day, dimensions, n, users (a sketch): one row for each day and group, a few kilobytes whatever its users are.

    Made once for a day and kept; a later day adds rows and changes none.
    """
    return df.groupBy(day, *dimensions).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(user, lg_k).alias("users"))


def from_sketches(sketches: DataFrame, day: str, dimensions: Sequence[str], start: Any = None, end: Any = None) -> DataFrame:
    """Dimensions, n, users (an estimate): any span of days and any fewer dimensions, by uniting sketches.

    ``n`` is exact; ``users`` is within ``ERROR`` in all but some of a thousand groups.
    """
    if start is not None:
        sketches = sketches.where(F.col(day) >= F.lit(start))
    if end is not None:
        sketches = sketches.where(F.col(day) <= F.lit(end))
    return sketches.groupBy(*dimensions).agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("users")).alias("users"))
