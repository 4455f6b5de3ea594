"""The shipped configuration: datasets and parameters by name."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any


def _table(layer: str, name: str, by: str) -> dict[str, Any]:
    return {"format": "parquet", "path": f"{layer}/{name}", "partition_by": by}


#: Names, formats and layout of the datasets.
CATALOG: dict[str, dict[str, Any]] = {
    "raw.prints": {"format": "json", "path": "01_raw/prints.json"},
    "raw.taps": {"format": "json", "path": "01_raw/taps.json"},
    "raw.pays": {"format": "csv", "path": "01_raw/pays.csv", "read_options": {"header": True, "inferSchema": True}},
    "intermediate.prints": _table("02_intermediate", "prints", "date_partition"),
    "intermediate.taps": _table("02_intermediate", "taps", "date_partition"),
    "intermediate.pays": _table("02_intermediate", "pays", "pay_date_partition"),
    "primary.mdt": _table("03_primary", "mdt", "date"),
    "intermediate.prints_columns": {"format": "tracking", "path": "09_tracking/intermediate_prints_columns.json"},
    "intermediate.taps_columns": {"format": "tracking", "path": "09_tracking/intermediate_taps_columns.json"},
    "intermediate.pays_columns": {"format": "tracking", "path": "09_tracking/intermediate_pays_columns.json"},
    "primary.mdt_columns": {"format": "tracking", "path": "09_tracking/primary_mdt_columns.json"},
}

_EVENTS = {"explode_column": "event_data", "columns_to_cast": {"position": "int", "value_prop": "string", "user_id": "int"}, "columns_to_rename": {"day": "date"}, "date_col": "date"}
_KEYS = ["date", "user_id", "value_prop"]

#: The parameters of each step.
PARAMETERS: dict[str, Any] = {
    "raw_prints": {"col_to_filter_by": "day"},
    "raw_taps": {"col_to_filter_by": "day"},
    "raw_pays": {"col_to_filter_by": "pay_date"},
    "intermediate_prints": _EVENTS,
    "intermediate_taps": _EVENTS,
    "intermediate_pays": {"date_col": "pay_date"},
    "primary_prints": {"date_col": "date", "last_n_days": 7},
    "primary_taps": {"date_col": "date", "last_n_days": 7},
    "primary_pays": {"date_col": "pay_date", "last_n_days": 7},
    "primary_join_parameters": {"prints_df": {"cols_to_join": _KEYS}, "taps_df": {"cols_to_join": _KEYS}, "pays_df": {"cols_to_join": ["pay_date", "user_id", "value_prop"]}, "how": "left"},
    "primary_windows_parameters": {"date_col": "date", "last_n_days": 6},
}


def merged(base: Mapping[str, Any], *overrides: Mapping[str, Any]) -> dict[str, Any]:
    """``base`` with each environment's settings over it; nested tables are merged, other values replaced."""
    out = dict(base)
    for extra in overrides:
        for k, v in extra.items():
            out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out
