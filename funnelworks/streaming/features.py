"""Row-framed features on a stream: each key's last 21 rows are its state, and the keys of one part are held and worked on together."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegralType

from ..operators.features import HISTORY, PAID, PAID_COUNT, PAID_SUM, SAW_COUNT, TAP, TAP_COUNT

_STATE = "kept binary, waiting binary"
#: Parts that keys are dealt to by hash; a stream keeps them for good, as it does its shuffle partitions.
PARTS = 1024


def _packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> list[pd.DataFrame]:
    return [pa.ipc.open_stream(packed).read_pandas()] if packed else []


def _sums(values: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the ``place``-th of its key: the sum and the number of the real values among the 21 rows before it, from the first to the last."""
    total, many = np.zeros(len(values)), np.zeros(len(values), np.int64)
    for back in range(min(HISTORY, int(place.max(initial=0))), 0, -1):
        i = np.flatnonzero(place >= back)
        i = i[~np.isnan(values[i - back])]
        total[i] += values[i - back]
        many[i] += 1
    return total, many


def framed(rows: pd.DataFrame, kept: list[pd.DataFrame], keys: list[str]) -> tuple[pd.DataFrame, pd.DataFrame]:
    """``rows`` of some keys, in order, with their features after the ``kept`` rows; and what is kept after them, 21 of each key."""
    need = list(dict.fromkeys([*keys, TAP, PAID, *(c for c in (_null(TAP), _null(PAID)) if c in rows)]))
    every = pd.concat([*kept, rows[need]], ignore_index=True)
    begin = len(every) - len(rows)
    key = every.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
    order = np.argsort(key, kind="stable")
    new = np.append(True, np.diff(key[order]) != 0)
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(order)))
    place = np.arange(len(order)) - np.repeat(start, size)
    taps, paid = (np.where(every[_null(c)], np.nan, every[c].to_numpy(np.float64, na_value=np.nan)) if _null(c) in every else every[c].to_numpy(np.float64, na_value=np.nan) for c in (TAP, PAID))
    tapped, any_tap = _sums(taps[order], place)
    sums, any_paid = _sums(paid[order], place)
    # A missing or zero payment counts as none, so over any row at all the count is a number.
    payments, _ = _sums((paid[order] > 0).astype(np.float64), place)
    mine = np.empty(len(order), np.int64)
    mine[order] = np.arange(len(order))
    mine = mine[begin:]
    whole = lambda values, none: pd.arrays.IntegerArray(values[mine].astype(np.int64), none[mine])
    seen = np.where(rows["value_prop"].isna(), 0, np.minimum(place, HISTORY)[mine])
    made = {SAW_COUNT: seen, TAP_COUNT: whole(tapped, any_tap == 0), PAID_SUM: pd.arrays.FloatingArray(sums[mine], any_paid[mine] == 0), PAID_COUNT: whole(payments, place == 0)}
    return rows.assign(**made), every.iloc[order[np.repeat(size, size) - place <= HISTORY]]


def _null(column: str) -> str:
    """The name of what tells that a whole number is missing: pandas would make all of them floats."""
    return f"_no_{column}"


def stream_features(stream: DataFrame, event_time: str, delay: str, tie_breakers: Sequence[str] = (), parts: int = PARTS) -> DataFrame:
    """The four features of each row of a stream, as ``add_features`` has them in batch.

    Rows wait until the watermark (``delay`` behind the latest) has passed them and then
    take their place by ``event_time`` and ``tie_breakers``: what comes in another order, within the
    delay, gives the same features.  What comes later than that is dropped and counted by Spark.  The
    state is, for each user and proposition, the last 21 taps and payments, and the rows that wait.  Users and propositions
    are dealt to ``parts`` by hash; those of one part are one group of Spark's, so the work for a
    batch is in proportion to its rows, and what a group costs besides does not grow with the keys.
    """
    columns = stream.columns
    whole = [f.name for f in stream.schema if isinstance(f.dataType, IntegralType)]
    # What is missing comes first, as in Spark.
    order = {event_time: True} | {x: x == c for c in tie_breakers for x in ([_null(c), c] if c in whole else [c])}
    keys = ["user_id", "value_prop", *(_null(c) for c in ("user_id", "value_prop") if c in whole)]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, waiting = state.get if state.exists else (b"", b"")
        held = _unpacked(waiting)
        if not state.hasTimedOut:
            held += [b.drop(columns="_part") for b in batches]
        rows = pd.concat(held, ignore_index=True) if held else None
        mark = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
        if rows is not None and len(rows):
            ready = rows[event_time] <= mark
            now, rows = rows[ready].sort_values([*order], ascending=[*order.values()], na_position="first", ignore_index=True), rows[~ready]
            if len(now):
                out, after = framed(now, _unpacked(kept), keys)
                kept = _packed(after)
                yield out[names]
        left = rows is not None and len(rows) > 0
        state.update((kept, _packed(rows) if left else b""))
        if left:
            state.setTimeoutTimestamp(max(int(rows[event_time].min().value // 1_000_000) + 1, state.getCurrentWatermarkMs() + 1))

    told = stream.withWatermark(event_time, delay)
    for c in whole:
        told = told.withColumn(_null(c), F.col(c).isNull()).withColumn(c, F.coalesce(c, F.lit(0).cast(stream.schema[c].dataType)))
    kinds = [f"`{n}` {t}" for n, t in told.dtypes]
    made = {SAW_COUNT: "long", TAP_COUNT: "long", PAID_SUM: "double", PAID_COUNT: "long"}
    names = [*told.columns, *made]
    schema = ", ".join([*kinds, *(f"{n} {t}" for n, t in made.items())])
    parted = told.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(parts)))
    out = parted.groupBy("_part").applyInPandasWithState(run, schema, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(*[F.when(~F.col(_null(c)), F.col(c)).alias(c) if c in whole else F.col(c) for c in columns], *made)
