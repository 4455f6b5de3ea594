"""Dates: checks on the driver, and expressions."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMAT = "%Y-%m-%d"
LOOKBACK_WEEKS = 3


def _parsed(text: str) -> datetime:
    try:
        return datetime.strptime(text, FORMAT)
    except (TypeError, ValueError) as e:
        raise ValueError(f"{text!r} is not a date like 2022-01-31") from e


def validate_date(dates: str | list | tuple) -> None:
    """A date's format; of a list or tuple, each one's, and that the first is not after the second.  Else a ValueError."""
    if isinstance(dates, str):
        _parsed(dates)
    elif isinstance(dates, list | tuple):
        found = [_parsed(d) for d in dates]
        if len(found) > 1 and found[0] > found[1]:
            raise ValueError(f"{dates[0]} is after {dates[1]}")
    else:
        raise ValueError(f"a date or a list of dates is needed, not {type(dates).__name__}")


def lookback_bounds(last: date, last_n_days: int | None = None) -> tuple[date, date]:
    """First and last day of the look-back from ``last``, which itself is left out."""
    return last - timedelta(weeks=LOOKBACK_WEEKS, days=last_n_days or 0), last - timedelta(days=1)


def snap_weekday(day: Column, target: str, weeks_before: int = 0) -> Column:
    """``day`` less some weeks, moved back to its week's Monday or on to its Sunday; any other target leaves it there."""
    moved = F.date_sub(day, 7 * weeks_before)
    monday = F.to_date(F.date_trunc("week", moved))
    return {"monday": monday, "sunday": F.date_add(monday, 6)}.get(target.lower(), moved)
