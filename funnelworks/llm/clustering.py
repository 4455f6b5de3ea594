"""Centroid clustering in exact integers, with Hamerly's bounds.

Every vector keeps its cluster, an upper bound of the distance to that centroid and
one lower bound of the distance to any other.  When centroids have moved, the upper
bound grows by its own centroid's drift and the lower one shrinks by the largest
drift of the others.  While the upper bound is below the lower one, or below half
the way from its centroid to the next, the cluster cannot have changed.  What is
ambiguous first has its own distance measured; if that does not settle it, all
centroids are measured, in integers, and ties go to the smaller number.

Vectors lie in chunks (the rows of an Arrow batch): one row with packed integers,
clusters and bounds, written to the shared folder once a round.  A round reads the
chunks in place, without a shuffle; each chunk also writes the sums of its clusters,
so the driver gets one number for each centroid component and no more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import dropped, reading, staged

#: Components of a vector, and what they are multiplied by before they are rounded down.
DIMENSIONS, SCALE = 64, 64
CLUSTERS, ROUNDS, SEED = 16, 3, 1
#: Components stay below this size, so that a squared distance of 64 of them is a long.
MOST = 1 << 27
#: Up to this size of components float64 holds every intermediate product exactly.
_EXACT = 1 << 20
#: Roots and sums of bounds are widened by so much, far more than their rounding errors.
_SLACK = 2.0**-48


def squared(values: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (int64) of each vector to each centroid."""
    if max(np.abs(values).max(initial=0), np.abs(centroids).max(initial=0)) < _EXACT:
        v, c = values.astype(np.float64), centroids.astype(np.float64)
        return (np.einsum("ij,ij->i", v, v)[:, None] - 2 * (v @ c.T) + np.einsum("ij,ij->i", c, c)).astype(np.int64)
    return np.stack([((values - c) ** 2).sum(1) for c in centroids], 1)


def _own(values: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    return ((values - centroids[cluster]) ** 2).sum(1)


def _above(x: np.ndarray) -> np.ndarray:
    return x * (1 + _SLACK)


def _below(x: np.ndarray) -> np.ndarray:
    return x * np.where(x > 0, 1 - _SLACK, 1 + _SLACK)


def _scanned(values: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid of each vector, an upper bound of its distance, and a lower bound of the second nearest's."""
    d = squared(values, centroids)
    cluster = d.argmin(1)
    upper = _above(np.sqrt(d[np.arange(len(d)), cluster].astype(np.float64)))
    if d.shape[1] == 1:
        return cluster, upper, np.full(len(d), np.inf)
    return cluster, upper, _below(np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype(np.float64)))


@dataclass(frozen=True)
class Moved:
    """Centroids before and after an update, with what bounds lose by it."""

    before: np.ndarray
    after: np.ndarray

    def drifts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each centroid: its drift, the largest drift of the others, and half the way to the nearest other."""
        drift = _above(np.sqrt(((self.after - self.before) ** 2).sum(1).astype(np.float64)))
        k = len(drift)
        if k == 1:
            return drift, np.zeros(1), np.full(1, np.inf)
        others = np.array([np.delete(drift, j).max() for j in range(k)])
        between = squared(self.after, self.after)
        np.fill_diagonal(between, np.iinfo(np.int64).max)
        return drift, others, _below(np.sqrt(between.min(1).astype(np.float64)) / 2)

    def assigned(self, values: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Clusters and bounds after the update, and how many vectors needed all centroids."""
        drift, others, half = self.drifts()
        cluster, upper, lower = cluster.copy(), _above(upper + drift[cluster]), _below(lower - others[cluster])
        open_ = np.flatnonzero(upper >= np.maximum(lower, half[cluster]))
        upper[open_] = _above(np.sqrt(_own(values[open_], self.after, cluster[open_]).astype(np.float64)))
        open_ = open_[upper[open_] >= np.maximum(lower[open_], half[cluster[open_]])]
        if len(open_):
            cluster[open_], upper[open_], lower[open_] = _scanned(values[open_], self.after)
        return cluster, upper, lower, len(open_)


# A chunk's integers take the narrowest type that holds them.
_WIDTHS = (np.int8, np.int16, np.int32)


def _packed(values: np.ndarray) -> tuple[int, bytes]:
    most = int(np.abs(values).max(initial=0))
    kind = next(t for t in _WIDTHS if most <= np.iinfo(t).max)
    return np.dtype(kind).itemsize, values.astype(kind).tobytes()


def _unpacked(width: int, packed: bytes, dimensions: int) -> np.ndarray:
    return np.frombuffer(packed, f"<i{width}").reshape(-1, dimensions).astype(np.int64)


def _sums(values: np.ndarray, cluster: np.ndarray, distance: np.ndarray, k: int) -> bytes:
    """For each cluster: the sum of each component, the number of vectors, and the sum of distances."""
    out = np.zeros((k, values.shape[1] + 2), np.int64)
    for j in np.unique(cluster):
        mine = cluster == j
        out[j, :-2], out[j, -2], out[j, -1] = values[mine].sum(0), mine.sum(), distance[mine].sum()
    return out.tobytes()


def _chunk(ids: pa.Array, values: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, scanned: int, centroids: np.ndarray) -> pa.RecordBatch:
    distance = _own(values, centroids, cluster)
    width, packed = _packed(values)
    cells = {
        "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
        "width": pa.array([width], pa.int32()),
        "vectors": pa.array([packed], pa.binary()),
        "cluster": pa.array([cluster.astype(np.int32).tobytes()], pa.binary()),
        "upper": pa.array([upper.tobytes()], pa.binary()),
        "lower": pa.array([lower.tobytes()], pa.binary()),
        "distance": pa.array([distance.tobytes()], pa.binary()),
        "sums": pa.array([_sums(values, cluster, distance, len(centroids))], pa.binary()),
        "scanned": pa.array([scanned], pa.int64()),
    }
    return pa.RecordBatch.from_arrays(list(cells.values()), names=list(cells))


def _begun(centroids: np.ndarray, scale: int):
    """Chunks of new vectors: all of them are scanned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                values = np.floor(scale * b.column("x").flatten().to_numpy(zero_copy_only=False)).astype(np.int64).reshape(len(b), -1)
                yield _chunk(b.column("vec_id"), values, *_scanned(values, centroids), len(b), centroids)

    return run


def _continued(moved: Moved):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                row = {name: b.column(name)[i].as_py() for name in ("width", "vectors", "cluster", "upper", "lower")}
                values = _unpacked(row["width"], row["vectors"], moved.after.shape[1])
                found = moved.assigned(values, np.frombuffer(row["cluster"], np.int32).astype(np.int64), np.frombuffer(row["upper"]), np.frombuffer(row["lower"]))
                yield _chunk(b.column("ids").slice(i, 1).flatten(), values, *found, moved.after)

    return run


def _totals(chunks: DataFrame, k: int, width: int) -> list[list[int]]:
    """The sums of all chunks: ``k`` rows of ``width`` numbers, as many as reach the driver at any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (k * width)
        for b in batches:
            for packed in b.column("sums").to_pylist():
                total = [x + y for x, y in zip(total, np.frombuffer(packed, np.int64).tolist(), strict=True)]
        at = [i for i, x in enumerate(total) if x]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([Decimal(total[i]) for i in at], pa.decimal128(38, 0))], names=["slot", "x"])

    out = [[0] * width for _ in range(k)]
    for slot, x in chunks.select("sums").mapInArrow(run, "slot int, x decimal(38,0)").groupBy("slot").agg(F.sum("x").cast("decimal(38,0)").alias("x")).collect():
        out[slot // width][slot % width] = int(x)
    return out


def _listed(by_cluster: Sequence[tuple[int, int, str]]):
    """A row for each vector of the chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                cluster = np.frombuffer(b.column("cluster")[i].as_py(), np.int32)
                inertia, total, digest = (pa.array([x[j] for x in by_cluster]).take(pa.array(cluster)) for j in range(3))
                distance = pa.array(np.frombuffer(b.column("distance")[i].as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([b.column("ids").slice(i, 1).flatten(), pa.array(cluster), distance, inertia, total, digest], names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return run


def usable(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and x (array of doubles) of the vectors that can be clustered."""
    x = F.col("x")
    number = lambda v: F.coalesce(F.abs(v) * scale < MOST - 1, F.lit(False)) & ~F.isnan(v)
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("x")).where(x.isNotNull() & (F.size(x) == dimensions) & F.forall(x, number))


def cluster_vectors(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED, trace: list[int] | None = None) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable vector.

    ``vectors`` has vec_id and embedding; other columns are not read.  A component x
    counts as the integer floor(scale * x).  The first centroids are the vectors with
    the smallest sha256 of ``<seed>:<vec_id>`` (equal ids: the smaller vector first; a
    null vec_id comes last); with fewer vectors there are fewer centroids.  Each round
    assigns all vectors and moves every centroid that has some to the floor of their
    mean; at the end they are assigned once more.  ``distance`` is squared.

    Vectors are not used, and have no row, if they are null or of another length, or if a
    component is null, not finite, or of 2^27 or more after scaling (the distance
    would not be a long).  Repeated rows and repeated ids are vectors of their own.
    No usable vectors, no rows.  ``trace`` gets the number of full scans of each pass.
    """
    kept = usable(vectors, dimensions, scale)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = kept.select("vec_id", "x", order.alias("order")).orderBy(F.col("order").asc_nulls_last(), "x").limit(clusters).collect()
    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return vectors.sparkSession.createDataFrame([], rows)
    centroids = np.array([np.floor(scale * np.array(r["x"])) for r in first]).astype(np.int64)
    k = len(centroids)
    schema = f"ids array<{kind}>, width int, vectors binary, cluster binary, upper binary, lower binary, distance binary, sums binary, scanned long"
    chunks = staged(kept.mapInArrow(_begun(centroids, scale), schema), "clusters")
    totals = _totals(chunks, k, dimensions + 2)
    for _ in range(rounds):
        moved = Moved(centroids, np.array([[x // t[-2] for x in t[:-2]] if t[-2] else centroids[j].tolist() for j, t in enumerate(totals)], np.int64))
        before, chunks = chunks, staged(chunks.select("ids", "width", "vectors", "cluster", "upper", "lower").mapInArrow(_continued(moved), schema), "clusters")
        dropped(before, collect=False)
        centroids, totals = moved.after, _totals(chunks, k, dimensions + 2)
        if trace is not None:
            trace.append(chunks.agg(F.sum("scanned")).first()[0])
    total = sum(t[-1] for t in totals)
    by_cluster = [(t[-1], total, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for t, c in zip(totals, centroids, strict=True)]
    return reading(chunks.select("ids", "cluster", "distance").mapInArrow(_listed(by_cluster), rows), chunks)
