"""The days before a table's last day."""

from __future__ import annotations

import logging
from collections.abc import Mapping
from datetime import date
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import lookback_bounds
from ..params import LookbackParams
from .ingest import last_day, last_days

log = logging.getLogger(__name__)


def load_lookback(df: DataFrame, parameters: Mapping[str, Any] | LookbackParams, anchor: date | None = None) -> DataFrame:
    """Rows from three weeks (and ``last_n_days``) before the last day to the day before it.

    The range is on the partition column where there is one, so only those files
    are read; its bounds are literals, which prunes at planning.  ``anchor`` takes
    the place of the last day, to align tables that end on different days.  A
    table without dates gives no rows.
    """
    p = parameters if isinstance(parameters, LookbackParams) else LookbackParams.from_dict(parameters)
    last = anchor or last_day(df, p.date_col)
    if last is None:
        return df.limit(0)
    if p.last_n_days is None:
        log.warning("last_n_days is not given: three weeks before %s", last)
    start, end = lookback_bounds(last, p.last_n_days)
    by = f"{p.date_col}_partition" if f"{p.date_col}_partition" in df.columns else p.date_col
    return df.filter(F.col(by).between(F.lit(start), F.lit(end)))


def load_lookbacks(*tables: tuple[DataFrame, Mapping[str, Any] | LookbackParams]) -> list[DataFrame]:
    """``load_lookback`` of several tables, each before its own last day; one action finds all last days."""
    given = [(df, p if isinstance(p, LookbackParams) else LookbackParams.from_dict(p)) for df, p in tables]
    days = last_days(*[(df, p.date_col) for df, p in given])
    return [df.limit(0) if day is None else load_lookback(df, p, day) for (df, p), day in zip(given, days, strict=True)]
