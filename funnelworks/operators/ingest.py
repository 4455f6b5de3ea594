"""Slices of raw tables by date: a closed range, or what is later than all that is there."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import validate_date
from ..params import IngestParams


def as_dataframe(frame: Any, spark: SparkSession | None = None) -> DataFrame:
    """A Spark or pandas table as a Spark one; anything else is a ValueError."""
    if isinstance(frame, DataFrame):
        return frame
    try:
        import pandas as pd
    except ImportError:
        pd = None
    if pd is not None and isinstance(frame, pd.DataFrame):
        return (spark or SparkSession.builder.getOrCreate()).createDataFrame(frame)
    raise ValueError(f"a Spark or pandas DataFrame is needed, not {type(frame).__name__}")


def _day(column: str, on_error: str) -> Column:
    c = F.col(column)
    return c.cast("date") if on_error == "fail" else c.try_cast("date")


def to_date_column(df: DataFrame, column: str, on_error: str = "null") -> DataFrame:
    """``column`` as a date: text is parsed, a timestamp loses its time.  A missing column is a KeyError."""
    if column not in df.columns:
        raise KeyError(f"no column {column!r} among {df.columns}")
    return df.withColumn(column, _day(column, on_error))


def in_range(df: DataFrame, column: str, start: Any = None, end: Any = None) -> DataFrame:
    """Rows from ``start`` to ``end``, both included; all rows unless both are given.  Null dates are in no range."""
    start, end = (None if x is None or str(x) in ("None", "none") else str(x) for x in (start, end))
    if start is None or end is None:
        return df
    validate_date([start, end])
    return df.filter(F.col(column).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def last_day(df: DataFrame, column: str) -> date | None:
    """The latest date of a table, by one small job; None for a table without dates."""
    return df.agg(F.max(_day(column, "null")).alias("last")).first()["last"]


def last_days(*tables: tuple[DataFrame, str]) -> list[date | None]:
    """The latest date of each table (by its column), by one action: the tables are read side by side."""
    each = [df.agg(F.max(_day(column, "null")).alias("last")).select(F.lit(i).alias("of"), "last") for i, (df, column) in enumerate(tables)]
    union = each[0]
    for more in each[1:]:
        union = union.union(more)
    found = {r["of"]: r["last"] for r in union.collect()}
    return [found[i] for i in range(len(tables))]


def after(df: DataFrame, column: str, existing: DataFrame) -> DataFrame:
    """Rows later than all of ``existing``: the same day again is not.  All rows if ``existing`` has no dates."""
    last = last_day(existing, column)
    return df if last is None else df.filter(F.col(column) > F.lit(last))


def ingest_historical_data(raw: Any, parameters: Mapping[str, Any], spark: SparkSession | None = None) -> DataFrame:
    """``raw`` with its date column as dates, within the range that ``parameters`` give."""
    p = IngestParams.from_dict(parameters)
    return in_range(to_date_column(as_dataframe(raw, spark), p.col_to_filter_by), p.col_to_filter_by, p.start_dt, p.end_dt)


def ingest_incremental_data(raw: Any, parameters: Mapping[str, Any], existing: Any, spark: SparkSession | None = None) -> DataFrame:
    """``raw`` with its date column as dates, later than all of ``existing``."""
    p = IngestParams.from_dict(parameters)
    df = to_date_column(as_dataframe(raw, spark), p.col_to_filter_by)
    return after(df, p.col_to_filter_by, as_dataframe(existing, spark))
