"""Joins by time: the last row before, and the rows within an interval."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _micros(column: Column) -> Column:
    """Microseconds since 1970 of a timestamp (with or without zone) or a date."""
    return F.unix_micros(column.cast("timestamp"))


def _bucket(micros: Column, width: int) -> Column:
    return F.floor(micros / F.lit(width * 1_000_000)).cast("long")


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, columns: Sequence[str], tie_breakers: Sequence[str] = (), strict: bool = True, tolerance: int | None = None, bucket: int | None = None) -> DataFrame:
    """Every row of ``left`` with ``columns`` of the last row of ``right`` before it, of the same ``by``.

    ``strict``: before, else at the same time too.  Of rows at one time the last by
    ``tie_breakers`` counts.  ``tolerance``: at most so many seconds before.  No such row, a null
    key or a null time give nulls.  Columns of ``right`` that ``left`` has already are a ValueError.

    Both tables go into one, which is sorted by time, and each row takes the last right
    row above it: one shuffle and one sort, no join by range.  A key's rows are in one task then; with
    ``bucket`` (seconds) they are parted by time as well.  What the buckets before had last
    is one row for each key and bucket, found by an aggregation and carried in as a row of its own.
    """
    if clash := sorted(set(left.columns) & set(columns)):
        raise ValueError(f"both tables have {clash}")
    names = [f"_{kind}" for kind in ("time", "side", "found", "row", "bucket")]
    if taken := sorted(set(left.columns) & set(names)):
        raise ValueError(f"reserved names: {taken}")
    carried = F.struct(_micros(F.col(right_time)).alias("at"), *[F.col(c).alias(f"tie_{i}") for i, c in enumerate(tie_breakers)], *[F.col(c).alias(f"x_{i}") for i, c in enumerate(columns)])
    keyed = reduce(and_, [F.col(c).isNotNull() for c in [*by, right_time]])
    rights = right.where(keyed).select(*by, _micros(F.col(right_time)).alias("_time"), F.lit(1 if strict else -1).alias("_side"), carried.alias("_found"))
    lefts = left.select(*by, _micros(F.col(left_time)).alias("_time"), F.lit(0).alias("_side"), F.struct(*left.columns).alias("_row"))
    parted = list(by)
    if bucket is not None:
        parted.append("_bucket")
        rights, lefts = (t.withColumn("_bucket", _bucket(F.col("_time"), bucket)) for t in (rights, lefts))
        # Ties of one moment: the greatest struct is the last by the tie breakers.
        ends = rights.groupBy(*parted).agg(F.max("_found").alias("_last"))
        every = ends.unionByName(lefts.where("_bucket is not null").select(*parted).distinct(), allowMissingColumns=True).groupBy(*parted).agg(F.max("_last").alias("_last"))
        before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        carry = every.withColumn("_found", F.last("_last", ignorenulls=True).over(before)).where("_found is not null")
        rights = rights.unionByName(carry.select(*parted, F.lit(None).cast("long").alias("_time"), F.lit(-2).alias("_side"), "_found"))
    both = rights.unionByName(lefts, allowMissingColumns=True)
    # Lefts without a time come first, before anything that could be carried to them.
    order = [F.col("_time").asc_nulls_first(), F.col("_side").asc(), F.col("_found").asc_nulls_first()]
    w = Window.partitionBy(*parted).orderBy(F.when(F.col("_row").isNotNull() & F.col("_time").isNull(), 0).otherwise(1), *order).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_found", ignorenulls=True).over(w)).where(F.col("_row").isNotNull())
    near = F.lit(True) if tolerance is None else F.col("_time") - F.col("_found.at") <= tolerance * 1_000_000
    return found.select(*[F.col(f"_row.`{c}`").alias(c) for c in left.columns], *[F.when(near, F.col(f"_found.x_{i}")).alias(c) for i, c in enumerate(columns)])


def interval_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, columns: Sequence[str], lower: int, upper: int, how: str = "inner", width: int | None = None, salts: int = 1) -> DataFrame:
    """Rows of ``left`` with ``columns`` of each row of ``right`` that is ``lower`` to ``upper`` seconds after it, both ends included, of the same ``by``.

    ``how`` is inner or left.  Null keys and times match nothing.  Columns of ``right`` that ``left`` has already are a ValueError.

    Time is cut into buckets of ``width`` seconds (the interval's length, at least a minute, if not
    given).  A left row is in the bucket of its time, a right row in all buckets from which it can be
    reached (one more than its reach in widths), so the join is one by equal keys and an
    exact test.  A key's rows are parted by time; where one key is hot within a bucket too, ``salts``
    deals its left rows out to so many tasks and sends the right ones to each.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how is {how!r}; it can be inner or left")
    if lower > upper:
        raise ValueError(f"{lower} is after {upper}")
    if clash := sorted(set(left.columns) & set(columns)):
        raise ValueError(f"both tables have {clash}")
    width = width or max(60, upper - lower)
    at, reach = _micros(F.col(right_time)), (lower * 1_000_000, upper * 1_000_000)
    buckets = F.sequence(_bucket(at - reach[1], width), _bucket(at - reach[0], width))
    lefts = left.withColumn("_time", _micros(F.col(left_time))).withColumn("_bucket", _bucket(F.col("_time"), width))
    rights = right.where(F.col(right_time).isNotNull()).select(*[F.col(c).alias(f"_by_{i}") for i, c in enumerate(by)], at.alias("_at"), *[F.col(c).alias(f"_x_{i}") for i, c in enumerate(columns)], F.explode(buckets).alias("_near"))
    same = [lefts[c] == rights[f"_by_{i}"] for i, c in enumerate(by)] + [lefts["_bucket"] == rights["_near"]]
    if salts > 1:
        lefts = lefts.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)))
        rights = rights.withColumn("_to", F.explode(F.array(*[F.lit(i).cast("long") for i in range(salts)])))
        same.append(lefts["_salt"] == rights["_to"])
    same.append((rights["_at"] - lefts["_time"]).between(*reach))
    return lefts.join(rights, reduce(and_, same), how).select(*[lefts[c] for c in left.columns], *[rights[f"_x_{i}"].alias(c) for i, c in enumerate(columns)])
