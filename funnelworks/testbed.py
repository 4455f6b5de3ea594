"""The driver's ``events`` table in the roles of prints, taps and pays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").where(F.col("event_type") == kind).select(
        "event_id", F.to_date("ts").alias("day"), F.struct((k % 4).cast("bigint").alias("position"), F.concat(F.lit("vp_"), k % 5).alias("value_prop")).alias("event_data"), "user_id", "value"
    )


def raw_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """day (text), event_data (struct), user_id and event_id, as in the raw files."""
    return _events(spark, sf_dir, "view").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_data", "user_id", "event_id")


def raw_taps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, "click").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_data", "user_id", "event_id")


def raw_pays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, "purchase").select(F.col("day").alias("pay_date"), F.col("value").alias("total"), F.col("user_id").cast("int").alias("user_id"), "event_data.value_prop")
