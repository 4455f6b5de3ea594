"""The row-wise operators on a stream of raw files.

Ingestion by range and all standardising steps are projections and filters, so
they run on streams as they are.  Look-backs and row-framed features need whole
tables and stay in batch.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import ingest_historical_data
from ..operators.standardize import preprocess_df


def standardized(stream: DataFrame, ingest: Mapping[str, Any], steps: Mapping[str, Any]) -> DataFrame:
    """A raw stream, ingested and standardised."""
    return preprocess_df(ingest_historical_data(stream, ingest), steps)[0]


def write_partitioned(stream: DataFrame, path: str, partition_by: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append to a partitioned Parquet table, each file of the source exactly once; by default until all that is there is read."""
    writer = stream.writeStream.format("parquet").outputMode("append").partitionBy(partition_by).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start(path)
