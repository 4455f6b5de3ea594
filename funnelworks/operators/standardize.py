"""Raw tables to typed ones: flatten, cast, drop, rename, partition column."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..params import StandardizeParams

log = logging.getLogger(__name__)


def flatten_struct(df: DataFrame, column: str) -> DataFrame:
    """A struct's fields as columns, after all others; a null struct gives nulls.  Names that clash are a ValueError."""
    if column not in df.columns:
        raise ValueError(f"no column {column!r} among {df.columns}")
    kind = df.schema[column].dataType
    if not isinstance(kind, StructType):
        raise ValueError(f"{column!r} is {kind.simpleString()}, not a struct")
    others = [c for c in df.columns if c != column]
    if clash := sorted(set(others) & set(kind.names)):
        raise ValueError(f"fields of {column!r} have the names of columns: {clash}")
    return df.select(*[F.col(f"`{c}`") for c in others], *[F.col(f"`{column}`.`{f}`").alias(f) for f in kind.names])


def cast_columns(df: DataFrame, types: Mapping[str, str], on_error: str = "null") -> DataFrame:
    """Columns as other types, in one projection; what does not fit is null, or fails the query with ``fail``."""
    if missing := sorted(set(types) - set(df.columns)):
        raise ValueError(f"no columns {missing} among {df.columns}")
    return df.withColumns({c: F.col(f"`{c}`").cast(t) if on_error == "fail" else F.col(f"`{c}`").try_cast(t) for c, t in types.items()})


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Without these columns; names that are not there do no harm."""
    return df.drop(*names)


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """New names for old, in turn, so a chain a to b to c ends at c; names that are not there do no harm.  Two columns of one name are a ValueError."""
    out = df.withColumnsRenamed(dict(names))
    if len(set(out.columns)) < len(out.columns):
        raise ValueError(f"columns would have the same name: {out.columns}")
    return out


def add_partition_column(df: DataFrame, date_col: str) -> DataFrame:
    """A copy of the date column to partition by: the copy in the path prunes files, the one inside keeps its statistics."""
    return df.withColumn(f"{date_col}_partition", F.col(date_col))


def schema_of(df: DataFrame) -> dict[str, dict[str, str]]:
    """Names and types of the columns, as they are tracked."""
    return {"columns": dict(df.dtypes)}


def preprocess_df(df: DataFrame, parameters: Mapping[str, Any] | StandardizeParams) -> tuple[DataFrame, dict[str, dict[str, str]]]:
    """All steps, and the schema of the result."""
    p = parameters if isinstance(parameters, StandardizeParams) else StandardizeParams.from_dict(parameters)
    if p.explode_column:
        df = flatten_struct(df, p.explode_column)
    if p.columns_to_cast:
        df = cast_columns(df, p.columns_to_cast, p.on_error)
    if p.columns_to_drop:
        df = drop_columns(df, p.columns_to_drop)
    if p.columns_to_rename:
        df = rename_columns(df, p.columns_to_rename)
    df = add_partition_column(df, p.date_col)
    log.info("columns:\n%s", df.schema.treeString() if hasattr(df.schema, "treeString") else df.dtypes)
    return df, schema_of(df)
