"""Late events: what is still taken, what is not, and which days it changes.

Ingestion by high-watermark takes only later days, so an event that comes late is
lost for good.  Here a stream takes events up to a stated delay behind the latest one,
each once, and adds them to the day that they belong to.  Days that were complete
before and have changed are named, so their tables can be made again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: The folder under each day that says which micro-batch brought the rows.
BATCH = "arrived"


def each_once(stream: DataFrame, event_time: str, keys: Sequence[str], delay: str) -> DataFrame:
    """Events at most ``delay`` behind the latest seen before, each of ``keys`` once.

    A repeat is known as long as the watermark has not passed the first one; so the state
    holds the keys of ``delay``, however long the stream runs.
    """
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def write_by_day(stream: DataFrame, path: str, day: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Add each micro-batch to its days, late ones included, as folders ``day/arrived``.

    A batch that is run again after a failure replaces its own folders and nothing else, so every event
    is there once; no file of an earlier batch is read or written.
    """

    def add(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn(BATCH, F.lit(number).cast("long")).hint("rebalance", day)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day, BATCH).parquet(path)

    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(add)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def dropped_as_late(query: StreamingQuery) -> int:
    """Rows that came behind the watermark, in the micro-batches that the query still reports (100 by default)."""
    return sum(int(op.numRowsDroppedByWatermark) for p in query.recentProgress for op in p.stateOperators)


def changed_days(spark: SparkSession, path: str, day: str, since: int) -> DataFrame:
    """The days to which micro-batches after number ``since`` have added; only folder names are read."""
    return spark.read.parquet(path).where(F.col(BATCH) > since).select(day).distinct()


def rows_of_changed_days(spark: SparkSession, path: str, day: str, since: int) -> DataFrame:
    """All rows of the days that have changed after ``since``: written with dynamic overwrite they correct these days and no others."""
    days = [r[day] for r in changed_days(spark, path, day, since).collect()]  # at most the days of the table
    return spark.read.parquet(path).where(F.col(day).isin(days)).drop(BATCH) if days else spark.read.parquet(path).limit(0).drop(BATCH)


def within_watermark(arrivals: DataFrame, arrived: str, event_time: str, delay: str) -> DataFrame:
    """The same rule in batch: rows later than the watermark that all earlier arrivals have set.

    ``arrived`` numbers the runs of the stream.  One number for each run reaches the join, whatever their size.
    """
    latest = arrivals.groupBy(F.col(arrived).alias("_run")).agg(F.max(F.date_trunc("millisecond", event_time)).alias("_latest"))
    before = latest.alias("a").join(latest.alias("b"), F.col("b._run") < F.col("a._run"), "left").groupBy(F.col("a._run").alias("_run")).agg((F.max("b._latest") - F.expr(f"interval {delay}")).alias("_mark"))
    return arrivals.join(F.broadcast(before), F.col(arrived) == F.col("_run")).where(F.col("_mark").isNull() | (F.col(event_time) > F.col("_mark"))).drop("_run", "_mark")
