"""Shards of equal bytes by histogram sort.

The rows are ordered by the hash of their text, so that equal texts are one point
of the order, and boundaries are sought there: every round counts the exact bytes
below all candidate boundaries in each partition, adds the counts up, and narrows
each boundary's interval to the candidates around its target, until the counts
are within tolerance or one text is left in the interval.  Such a text stays
whole unless it is large for a shard; then the same search goes on among its
copies, by doc_id.  Only then do rows move, once, to their cell (a share of a
shard), where they are sorted and numbered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import integer_of, partitions, staged

_LOW = -(1 << 63)
#: Candidates for each boundary in a round.
PROBES = 64
#: Bytes that a boundary may be off, as a share of a shard; a single row, or a text below ``GROUP_SHARE``, may force more.
TOLERANCE = 0.0005
#: The copies of one text are parted only if together they have more than this share of a shard.
GROUP_SHARE = 0.02


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the sort key (hash, tie) of every document; a null text has no bytes, a null doc_id comes first."""
    text = F.coalesce("text", F.lit(""))
    return documents.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("hash"), F.coalesce(integer_of(documents, "doc_id"), F.lit(_LOW)).alias("tie"))


def _cells(hashes: np.ndarray, ties: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """How many of the bounds (``high``, ``low``), sorted by both, are not above each row's key (hash, tie)."""
    first, last = np.searchsorted(high, hashes, "left"), np.searchsorted(high, hashes, "right")
    out = first.astype(np.int64)
    for same in np.unique(hashes[last > first]):  # texts that a bound begins with or goes through
        mine = hashes == same
        a, b = int(np.searchsorted(high, same, "left")), int(np.searchsorted(high, same, "right"))
        out[mine] = a + np.searchsorted(low[a:b], ties[mine], "right")
    return out


_COUNTED = "cell long, bytes long, n long, first_hash long, last_hash long, first_tie long, last_tie long"


def _histogram(high: np.ndarray, low: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = len(high) + 1
        size, rows = np.zeros(many, np.int64), np.zeros(many, np.int64)
        ends = [np.full(many, fill, np.int64) for fill in (-_LOW - 1, _LOW, -_LOW - 1, _LOW)]
        for b in batches:
            hashes, ties = b.column("hash").to_numpy(), b.column("tie").to_numpy()
            cell = _cells(hashes, ties, high, low)
            np.add.at(size, cell, b.column("size").to_numpy())
            rows += np.bincount(cell, minlength=many)
            for end, keep, x in zip(ends, (np.minimum, np.maximum) * 2, (hashes, hashes, ties, ties), strict=True):
                keep.at(end, cell, x)
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some, size[some], rows[some], *[end[some] for end in ends])], names=[x.split()[0] for x in _COUNTED.split(", ")])

    return run


class Histogram:
    """Exact bytes and rows between consecutive bounds, below the first and above the last; the least and greatest hash and tie there."""

    def __init__(self, rows: DataFrame, high: np.ndarray, low: np.ndarray):
        sums = [F.sum(x).alias(x) for x in ("bytes", "n")] + [F.min(x).alias(x) for x in ("first_hash", "first_tie")] + [F.max(x).alias(x) for x in ("last_hash", "last_tie")]
        got = rows.select("hash", "tie", "size").mapInArrow(_histogram(high, low), _COUNTED).groupBy("cell").agg(*sums).toArrow()  # a row for each cell
        for name in ("bytes", "n", "first_hash", "last_hash", "first_tie", "last_tie"):
            held = np.zeros(len(high) + 1, np.int64)
            held[got["cell"].to_numpy()] = got[name].to_numpy()
            setattr(self, name, held)


def _between(low: np.ndarray, high: np.ndarray, share: np.ndarray, probes: int) -> np.ndarray:
    """Keys inside each interval: ``probes`` evenly spaced ones, and one where ``share`` of it lies below."""
    width = high.astype(np.uint64) - low.astype(np.uint64)
    steps = np.linspace(0, 1, probes + 2)[1:-1]
    at = np.concatenate([np.broadcast_to(steps, (len(low), probes)), share[:, None]], 1)
    inner = np.minimum((at * width[:, None].astype(float)).astype(np.uint64), (width - np.uint64(1))[:, None])
    return (low.astype(np.uint64)[:, None] + np.maximum(inner, np.uint64(1))).astype(np.int64)


def _narrowed(rows: DataFrame, by_tie: np.ndarray | None, start: np.ndarray, stop: np.ndarray, below: np.ndarray, upto: np.ndarray, target: np.ndarray, allowed: np.ndarray, probes: int) -> tuple[np.ndarray, ...]:
    """For each boundary a key with no more bytes below it than its target, and one with no fewer; and those bytes.

    ``start`` and ``stop`` are such keys, ``below`` and ``upto`` their bytes.  Keys
    are hashes, or ties within the hashes ``by_tie``.  It ends when one of the two is
    within what is ``allowed``, or when no key lies between them.
    """
    start, stop, below, upto = (x.copy() for x in (start, stop, below, upto))
    active = np.ones(len(target), bool)
    while True:
        active &= (stop.astype(np.uint64) - start.astype(np.uint64) > 1) & (target - below > allowed) & (upto - target > allowed)
        j = np.flatnonzero(active)
        if not len(j):
            return start, stop, below, upto
        share = (target[j] - below[j]) / np.maximum(upto[j] - below[j], 1)
        tries = _between(start[j], stop[j], share, probes)
        high = tries.ravel() if by_tie is None else np.repeat(by_tie[j], tries.shape[1])
        low = np.full(tries.size, _LOW, np.int64) if by_tie is None else tries.ravel()
        bounds = np.unique(np.stack([high, low], 1), axis=0)
        found = Histogram(rows, bounds[:, 0], bounds[:, 1])
        under = np.cumsum(found.bytes)[:-1]  # below each bound
        key = bounds[:, 0] if by_tie is None else bounds[:, 1]
        first, last = (found.first_hash, found.last_hash) if by_tie is None else (found.first_tie, found.last_tie)
        for i in j.tolist():
            a, b = (0, len(bounds)) if by_tie is None else np.searchsorted(bounds[:, 0], [by_tie[i], by_tie[i]], "left") + [0, np.count_nonzero(bounds[:, 0] == by_tie[i])]
            a, b = a + int(np.searchsorted(key[a:b], start[i], "right")), a + int(np.searchsorted(key[a:b], stop[i], "left"))
            k = a + int(np.searchsorted(under[a:b], target[i], "right"))  # bounds before it have no more below them than the target
            if k > a:
                start[i], below[i] = key[k - 1], under[k - 1]
            if k < b:
                stop[i], upto[i] = key[k], under[k]
            # Rows of the cell that holds the target lie between these ends (other cells' rows may share the hash's neighbours only for ties).
            if a < k < b and found.n[k]:
                start[i] = max(start[i], first[k])
                stop[i] = min(stop[i], last[k] + 1) if last[k] < -_LOW - 1 else stop[i]


def splitters(rows: DataFrame, shards: int, cells: int, tolerance: float = TOLERANCE, group_share: float = GROUP_SHARE, probes: int = PROBES) -> tuple[np.ndarray, np.ndarray]:
    """``shards * cells - 1`` increasing boundaries (hash, tie): between shards within tolerance, between the cells of a shard roughly.

    A boundary is the least key of what lies above it.
    """
    parts = shards * cells
    total = rows.agg(F.sum("size")).first()[0] or 0
    number = np.arange(1, parts)
    target = np.rint(number * (total / parts))
    outer = number % cells == 0
    allowed = np.where(outer, total / shards * tolerance, total / parts * 0.2)
    whole = [np.full(parts - 1, x, np.int64) for x in (_LOW, -_LOW - 1, 0, total)]
    start, stop, below, upto = _narrowed(rows, None, *whole, target, allowed, probes)
    low = np.where(target - below <= upto - target, start, stop)
    off = np.minimum(target - below, upto - target)
    # What is still off has one text between its ends.
    large = (off > allowed) & (upto - below > np.where(outer, total / shards * group_share, total / parts * 0.5))
    tie = np.full(parts - 1, _LOW, np.int64)
    j = np.flatnonzero(large)
    if len(j):
        ends = [np.full(len(j), x, np.int64) for x in (_LOW, -_LOW - 1)]
        a, b, under, over = _narrowed(rows, start[j], *ends, below[j], upto[j], target[j], allowed[j], probes)
        low[j] = start[j]
        tie[j] = np.where(target[j] - under <= over - target[j], a, b)
        past = (tie[j] == b) & (b == -_LOW - 1)  # after the last of them
        low[j], tie[j] = np.where(past, stop[j], low[j]), np.where(past, _LOW, tie[j])
    order = np.lexsort((tie, low))  # equal boundaries (an empty cell) are legal; they only have to be in order
    return low[order], tie[order]


def _assign(high: np.ndarray, low: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = _cells(b.column("hash").to_numpy(), b.column("tie").to_numpy(), high, low)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=[*b.schema.names, "cell"])

    return run


def shard_documents(documents: DataFrame, shards: int, tolerance: float = TOLERANCE) -> DataFrame:
    """Every document with its shard (0 to ``shards`` - 1), and its slot there (from 0 without gaps).

    Columns: doc_id, size, text_crc32, hash, shard, slot.  Shards are ranges of the
    texts' hashes, nearly equal in bytes.  Equal texts are in one shard, but for a
    text whose copies have over ``GROUP_SHARE`` of a shard; those are parted by
    doc_id.  Rows equal in both stay in one shard in any order.  A null text is as
    an empty one; very long texts are hashed whole and move as their length and
    checksum only.  An empty table gives no rows.  Other columns are not read.
    """
    spark = documents.sparkSession
    rows = staged(keyed(documents), "keys")
    cells = -(-partitions(spark) // shards)
    high, low = splitters(rows, shards, cells, tolerance)
    before = np.cumsum(np.append(0, Histogram(rows, high, low).n))
    offsets = [(c, c // cells, int(before[c] - before[c // cells * cells])) for c in range(shards * cells)]
    where = F.broadcast(spark.createDataFrame(offsets, "cell long, shard int, before long"))  # a row for each partition of the shuffle
    at = rows.mapInArrow(_assign(high, low), ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", cell long")
    number = F.row_number().over(Window.partitionBy("cell").orderBy("hash", "tie")) - 1
    return at.withColumn("number", number).join(where, "cell").select("doc_id", "size", "text_crc32", "hash", "shard", (F.col("before") + F.col("number")).alias("slot"))


def write_shards(documents: DataFrame, shards: int, path: str, tolerance: float = TOLERANCE) -> None:
    """Write every document to ``path/shard=k`` in slot order within each file; files hold consecutive slots.

    A row finds its shard by doc_id and text, so repeated rows (equal in both) are
    written each, side by side.
    """
    placed = shard_documents(documents, shards, tolerance).groupBy("doc_id", F.col("hash").alias("_hash")).agg(F.min("shard").alias("shard"), F.min("slot").alias("slot"))
    whole = documents.withColumn("_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    whole = whole.join(placed, whole["doc_id"].eqNullSafe(placed["doc_id"]) & (whole["_hash"] == placed["_hash"])).drop(placed["doc_id"]).drop("_hash")
    whole.repartitionByRange(max(shards, partitions(documents.sparkSession)), "shard", "slot").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
