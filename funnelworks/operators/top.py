"""The first rows of each group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIES = {"row": F.row_number, "rank": F.rank, "dense": F.dense_rank}


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int, ties: str = "row", name: str = "rank") -> DataFrame:
    """Rows of the first ``k`` places of each group, with their place as ``name``.

    ``ties``: ``row`` numbers the rows (``order`` should leave no ties), ``rank`` gives equal rows one place
    and leaves the next ones out, ``dense`` leaves none out; the last two may give more than ``k`` rows.
    No ``by`` means one group of all rows.  The place is only compared with ``k``, so Spark limits each task's
    part of a group before the shuffle: a hot group costs ``k`` rows of each task.
    """
    if ties not in TIES:
        raise ValueError(f"ties is {ties!r}; it can be {', '.join(TIES)}")
    if name in df.columns:
        raise ValueError(f"there is a column {name!r}")
    if k < 1:
        return df.withColumn(name, F.lit(0)).limit(0)
    if not by and ties == "row":
        first = df.orderBy(*order).limit(k)
        return first.withColumn(name, F.row_number().over(Window.orderBy(*order)))  # of k rows
    # A constant group has a limit for each task too.
    groups = list(by) or [F.lit(0)]
    return df.withColumn(name, TIES[ties]().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col(name) <= k)
