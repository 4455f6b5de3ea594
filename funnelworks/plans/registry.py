"""The named pipelines."""

from __future__ import annotations

from ..operators.features import create_windows, join_dataframes
from ..operators.ingest import ingest_historical_data, ingest_incremental_data
from ..operators.lookback import load_lookback
from ..operators.standardize import preprocess_df
from .pipeline import Node, Pipeline

TABLES = ("prints", "taps", "pays")
DEFAULT = "__default__"


def ingestion_historical() -> Pipeline:
    return Pipeline(Node.of(ingest_historical_data, [f"raw.{t}", f"params:raw_{t}"], f"ingested_raw.{t}", f"ingest_historical_{t}") for t in TABLES)


def ingestion_incremental() -> Pipeline:
    """What is later than the intermediate tables; their date columns carry other names than the raw ones."""

    def ingest(raw, parameters, existing, names):
        to = (names.get("columns_to_rename") or {}).get(parameters["col_to_filter_by"], parameters["col_to_filter_by"])
        return ingest_incremental_data(raw, parameters, existing.select(existing[to].alias(parameters["col_to_filter_by"])))

    return Pipeline(Node.of(ingest, [f"raw.{t}", f"params:raw_{t}", f"intermediate.{t}", f"params:intermediate_{t}"], f"ingested_raw.{t}", f"ingest_incremental_{t}") for t in TABLES)


def intermediate() -> Pipeline:
    return Pipeline(Node.of(preprocess_df, [f"ingested_raw.{t}", f"params:intermediate_{t}"], [f"intermediate.{t}", f"intermediate.{t}_columns"], f"preprocess_{t}") for t in TABLES)


def primary() -> Pipeline:
    loads = [Node.of(load_lookback, [f"intermediate.{t}", f"params:primary_{t}"], f"primary_loaded.{t}", f"load_{t}") for t in TABLES]
    join = Node.of(join_dataframes, [*(f"primary_loaded.{t}" for t in TABLES), "params:primary_join_parameters"], "primary_joined.pre_mdt", "join_dataframes")
    features = Node.of(create_windows, ["primary_joined.pre_mdt", "params:primary_windows_parameters"], ["primary.mdt", "primary.mdt_columns"], "create_windows")
    return Pipeline([*loads, join, features])


def register_pipelines() -> dict[str, Pipeline]:
    """``__default__`` runs everything from the raw files.  The incremental pipelines add to the tables that are there."""
    return {
        DEFAULT: ingestion_historical() + intermediate() + primary(),
        "ingestion_historical_pipeline": ingestion_historical(),
        "ingestion_incremental_pipeline": ingestion_incremental(),
        "intermediate_pipeline": intermediate(),
        "de_historical_pipeline": ingestion_historical() + intermediate(),
        "primary_pipeline": primary(),
    }
