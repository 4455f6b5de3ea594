"""Parameters of the operators, checked when they are made."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

log = logging.getLogger(__name__)

HOWS = ("inner", "left", "right", "full", "semi", "anti")
#: Spark's other names for these; with keys to join by, a cross join is an inner one.
_ALIASES = {"cross": "inner", "leftouter": "left", "rightouter": "right", "outer": "full", "fullouter": "full", "leftsemi": "semi", "leftanti": "anti"}


def _optional(value: Any) -> str | None:
    """Dates may come as dates or as text; none may come as None or as the word."""
    text = str(value)
    return None if text in ("None", "none", "") else text


@dataclass(frozen=True)
class IngestParams:
    """The date column to slice by, and the range; both bounds or neither count."""

    col_to_filter_by: str
    start_dt: str | None = None
    end_dt: str | None = None

    @classmethod
    def from_dict(cls, given: Mapping[str, Any]) -> IngestParams:
        """Unknown keys are named in a warning and dropped; without a known key, or without the column, it is a ValueError."""
        known = ("col_to_filter_by", "start_dt", "end_dt")
        if missing := sorted(set(known) - set(given)):
            log.info("Unspecified parameters: %s", missing)
        # The table that is there already is an input of the step, but may be named among its parameters.
        if unknown := sorted(set(given) - {*known, "existing_data_df"}):
            log.warning("Unrecognized parameters: %s", unknown)
        found = {k: _optional(given[k]) for k in known if k in given}
        if not found:
            raise ValueError(f"no known parameter among {sorted(given)}; known are {list(known)}")
        if not found.get("col_to_filter_by"):
            raise ValueError("col_to_filter_by is missing")
        return cls(**found)  # type: ignore[arg-type]


@dataclass(frozen=True)
class StandardizeParams:
    """Steps in their order: flatten, cast (by original names), drop, rename, partition column (by new names)."""

    date_col: str
    explode_column: str | None = None
    columns_to_cast: Mapping[str, str] = field(default_factory=dict)
    columns_to_drop: Sequence[str] = ()
    columns_to_rename: Mapping[str, str] = field(default_factory=dict)
    #: ``null`` makes a value that does not fit its type null, ``fail`` fails the query.
    on_error: str = "null"

    @classmethod
    def from_dict(cls, given: Mapping[str, Any]) -> StandardizeParams:
        if not given.get("date_col"):
            raise ValueError("date_col is missing")
        return cls(given["date_col"], given.get("explode_column"), given.get("columns_to_cast") or {}, tuple(given.get("columns_to_drop") or ()), given.get("columns_to_rename") or {}, given.get("on_error", "null"))


@dataclass(frozen=True)
class LookbackParams:
    """Three weeks before the last day, and ``last_n_days`` more if given (0 counts as given)."""

    date_col: str
    last_n_days: int | None = None

    @classmethod
    def from_dict(cls, given: Mapping[str, Any]) -> LookbackParams:
        if not given.get("date_col"):
            raise ValueError("date_col is missing")
        return cls(given["date_col"], given.get("last_n_days"))


@dataclass(frozen=True)
class JoinParams:
    """Keys of the three tables, in step with each other; the kind of join for both joins.

    ``semi`` keeps prints with a tap and a payment, ``anti`` those with neither; nothing
    of taps and payments is in the result, so it has no flag and no total.
    """

    print_keys: Sequence[str] = ("date", "user_id", "value_prop")
    tap_keys: Sequence[str] = ("date", "user_id", "value_prop")
    pay_keys: Sequence[str] = ("pay_date", "user_id", "value_prop")
    how: str = "left"
    #: Columns of prints to keep beside the fixed ones.
    keep: Sequence[str] = ()
    #: Numeric columns whose nulls become 0; None: all of them.
    fill: Sequence[str] | None = None

    def __post_init__(self) -> None:
        how = self.how.lower().replace("_", "")
        object.__setattr__(self, "how", _ALIASES.get(how, how))
        if self.how not in HOWS:
            raise ValueError(f"how is {self.how!r}; it can be {', '.join([*HOWS, *_ALIASES])}")
        if not (len(self.print_keys) == len(self.tap_keys) == len(self.pay_keys) > 0):
            raise ValueError("the tables need equally many keys, one at least")

    @classmethod
    def from_dict(cls, given: Mapping[str, Any]) -> JoinParams:
        """``cols_to_keep`` of prints adds to ``keep``; of taps and pays only the match and the total go on, which a warning says."""
        tables = [given[f"{t}_df"] for t in ("prints", "taps", "pays")]
        for name, table in zip(("taps_df", "pays_df"), tables[1:], strict=True):
            if table.get("cols_to_keep"):
                log.warning("cols_to_keep of %s has no effect", name)
        keep = dict.fromkeys([*(given.get("keep") or ()), *(tables[0].get("cols_to_keep") or ())])
        return cls(*[tuple(t["cols_to_join"]) for t in tables], how=given.get("how") or given.get("join_type") or "left", keep=tuple(keep), fill=given.get("fill"))


@dataclass(frozen=True)
class FeatureParams:
    """The date column, how many days before the last one stay, and how rows of one day are ordered.

    ``tie_breakers`` empty leaves rows of one day in any order.  ``frame`` is ``rows``
    (the 21 rows before) or ``days`` (the rows of the 21 days before).
    """

    date_col: str
    last_n_days: int = 0
    tie_breakers: Sequence[str] = ()
    frame: str = "rows"

    def __post_init__(self) -> None:
        if self.frame not in ("rows", "days"):
            raise ValueError(f"frame is {self.frame!r}; it can be rows or days")

    @classmethod
    def from_dict(cls, given: Mapping[str, Any]) -> FeatureParams:
        if not given.get("date_col"):
            raise ValueError("date_col is missing")
        return cls(given["date_col"], given.get("last_n_days") or 0, tuple(given.get("tie_breakers") or ()), given.get("frame", "rows"))
