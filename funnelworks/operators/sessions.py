"""Sessions: runs of events with no more than a gap between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_DAY = 86_400


def _islands(df: DataFrame, by: Sequence[str], gap: Column) -> DataFrame:
    """Rows (by, start, end, n), each a run, joined where one starts at most ``gap`` after all before it have ended."""
    w = Window.partitionBy(*by).orderBy("start", "end")
    last = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(last.isNull() | (F.col("start") > last + gap), 1).otherwise(0))
    numbered = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).drop("_island")


def sessions(df: DataFrame, by: Sequence[str], time: str, gap: int, bucket: int = _DAY) -> DataFrame:
    """``by``, start, end, n: the sessions of each key; ``end`` is the time of the last event.

    Events at most ``gap`` seconds apart are in one session.  Null times are in none; a null
    key is a key.  In two steps: first the runs within each key and time bucket, where a hot key's events
    are spread over tasks, then the runs of these, of which a key has few.
    """
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    events = df.where(F.col(time).isNotNull()).select(*by, micros.alias("start"), micros.alias("end"), F.lit(1).cast("long").alias("n"))
    length = F.lit(gap * 1_000_000)
    near = _islands(events.withColumn("_bucket", F.floor(F.col("start") / F.lit(bucket * 1_000_000))), [*by, "_bucket"], length).drop("_bucket")
    found = _islands(near, by, length)
    kind = df.schema[time].dataType.simpleString()
    return found.select(*by, *[F.timestamp_micros(c).cast(kind).alias(c) for c in ("start", "end")], "n")


def stream_sessions(stream: DataFrame, by: Sequence[str], time: str, gap: int, delay: str) -> DataFrame:
    """The same on a stream: a session is told once the watermark, ``delay`` behind the latest event, has passed its end and the gap."""
    window = F.session_window(time, f"{gap} seconds")
    counted = stream.withWatermark(time, delay).groupBy(*by, window.alias("_session")).agg(F.count(F.lit(1)).alias("n"))
    end = (F.col("_session.end") - F.expr(f"interval {gap} seconds")).alias("end")
    return counted.select(*by, F.col("_session.start").alias("start"), end, "n")
