"""Sessions with the settings that the engine counts on."""

from __future__ import annotations

import logging
import logging.handlers
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import SparkSession

#: Set where the caller says nothing else.
DEFAULTS: dict[str, str] = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Only the partitions that a write has are replaced; earlier ones stay.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.scheduler.mode": "FAIR",
    "spark.driver.maxResultSize": "3g",
}

#: Reads files by the second version of the source interface, whose Parquet scan answers max() from footers.
METADATA_AGGREGATES: dict[str, str] = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}

#: Reads and writes s3a:// paths; the cluster must have the file system's jars.
OBJECT_STORE: dict[str, str] = {"spark.hadoop.fs.s3a.impl": "org.apache.hadoop.fs.s3a.S3AFileSystem"}


def build_session(conf: Mapping[str, str] | None = None, *, app: str = "funnelworks", master: str | None = None, metadata_aggregates: bool = False, object_store: bool = False, hive: bool = False) -> SparkSession:
    """A session with DEFAULTS, the chosen extras, and ``conf`` over all of them."""
    settings = DEFAULTS | (METADATA_AGGREGATES if metadata_aggregates else {}) | (OBJECT_STORE if object_store else {}) | dict(conf or {})
    builder = SparkSession.builder.appName(app).config(map=settings)
    if master:
        builder = builder.master(master)
    if hive:
        builder = builder.enableHiveSupport()
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def configure_logging(level: str = "INFO", file: str | Path | None = None) -> None:
    """To the console, and to ``file`` in up to 20 parts of 10 MB."""
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if file:
        Path(file).parent.mkdir(parents=True, exist_ok=True)
        handlers.append(logging.handlers.RotatingFileHandler(file, maxBytes=10 * 1024 * 1024, backupCount=20, encoding="utf-8"))
    logging.basicConfig(level=level, handlers=handlers, format="%(asctime)s %(name)s %(levelname)s %(message)s", force=True)
