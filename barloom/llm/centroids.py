"""Centroid clustering in whole numbers, with bounds that geometry keeps tight.

Every vector carries an upper bound of the distance to its own centroid and a
lower bound of the distance to any other. While the one is below the other its
assignment stands unseen. When centroids move, the lower bound must loosen.
It need not by the whole drift: a cluster lies in a ball around its centroid,
and how much nearer a moved centroid can have come to a point of that ball is
a matter of the plane through the ball's centre and the line of the move. With
the move's direction as axis and its middle as origin, a point at an angle phi
is nearer by at most the drift times cos(phi) (its distances to both ends add
up to at least twice that to the middle), so the least angle in the ball
counts, and a ball behind the middle loosens nothing. Vectors whose bounds
cross are compared with all centroids exactly; ties go to the smaller number.
Bounds only save comparisons: results are exact whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import arrow_map, batch_of, discard, narrowed
from barloom.session import staged

LARGEST = 1 << 26  # a component beyond it would take squared distances of 64 components out of 64 bits
ROWS = 4096  # vectors that one vectorised step holds
SURE = 1 + 1e-9  # what rounding may take from a bound, many times over
CLUSTERED = "vec_id long, v binary, cluster int, upper double, lower double, distance long"


@dataclass(frozen=True)
class ClusterParameters:
    """``seed`` goes before the id in the hash that draws the first centroids; components are floor(scale * x)."""

    dimensions: int = 64
    clusters: int = 16
    rounds: int = 3
    scale: int = 64
    seed: str = "1:"


def cluster_vectors(embeddings: DataFrame, parameters: ClusterParameters = ClusterParameters()) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Kept are vectors with the wanted number of components, none null, NaN or
    infinite; a component of 2**26 or more after scaling is refused with an
    error. The first centroids are the vectors of the smallest hashes of
    their ids (null ids after all others, equal ids by their components, so
    repeated rows may start several equal centroids, of which the first gets
    the vectors); with fewer vectors than clusters there are as many centroids
    as vectors. Ties go to the smaller number, empty clusters stay. Repeated
    rows each get their row, an empty table gives an empty table, other
    columns, of any name, are not read. A round is one pass without a shuffle
    of vectors; what meets on the driver are the centroids.
    """
    spark, p = embeddings.sparkSession, parameters
    vectors = staged(arrow_map(narrowed(embeddings, "vec_id", "embedding"), _whole_numbers, "vec_id long, v binary", p=p))
    centroids = _first_centroids(vectors, p)
    if not len(centroids):
        discard(vectors)
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    rows = vectors.selectExpr("vec_id", "v", "CAST(NULL AS INT) AS cluster", "CAST(NULL AS DOUBLE) AS upper", "CAST(NULL AS DOUBLE) AS lower")
    before, radius = centroids, np.zeros(len(centroids))
    for i in range(p.rounds + 1):
        move = Move(before, centroids, radius)
        assigned = staged(arrow_map(rows, _assign, CLUSTERED, move=move, exact=i == p.rounds))
        discard(vectors)
        if i == p.rounds:
            break
        before = centroids
        centroids, radius = _moved(assigned, centroids)
        vectors, rows = assigned, assigned.select("vec_id", "v", "cluster", "upper", "lower")
    inertia = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    digests = [(c, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids.tolist())]
    # one row per centroid, as many as the parameters say
    facts = spark.createDataFrame(digests, "cluster int, centroid_sha256 string").join(inertia, "cluster")
    facts = facts.crossJoin(F.broadcast(assigned.agg(F.sum("distance").alias("inertia"))))
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _whole_numbers(batches: Iterator[pa.RecordBatch], p: ClusterParameters) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.binary())])
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            lists = part.column("embedding")
            sizes = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            fitting = part.take(pa.array(np.flatnonzero(sizes == p.dimensions)))
            # nulls become NaN here, and go with the other non-finite values
            flat = fitting.column("embedding").flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            flat = flat.reshape(-1, p.dimensions)
            kept = np.flatnonzero(np.isfinite(flat).all(axis=1))
            scaled = np.floor(p.scale * flat[kept])
            if len(kept) and np.abs(scaled).max() >= LARGEST:
                raise ValueError(f"a component is {LARGEST} or more after scaling: squared distances would leave 64 bits")
            ids = fitting.column("vec_id").cast(pa.int64()).take(pa.array(kept))
            yield batch_of(schema, ids, [row.tobytes() for row in scaled.astype("<i4")])


def _first_centroids(vectors: DataFrame, p: ClusterParameters) -> np.ndarray:
    key = F.sha2(F.concat(F.lit(p.seed), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(key.asc_nulls_last(), "v").select("v").limit(p.clusters).collect()
    return _matrix([row.v for row in first], p.dimensions)


def _matrix(rows: list[bytes], dimensions: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows), "<i4").astype(np.int64).reshape(-1, dimensions)


class Move:
    """Where the centroids are, and how their move from where they were loosens the bounds of each cluster."""

    def __init__(self, before: np.ndarray, now: np.ndarray, radius: np.ndarray):
        self.now = now
        self.drift = _lengths(now - before)
        self.loosening = np.array([max([0.0, *self._nearer(before, now, i, r)]) for i, r in enumerate(radius.tolist())])
        apart = _lengths(now[:, None] - now[None]) + np.where(np.eye(len(now), dtype=bool), np.inf, 0)
        # nothing else is nearer than half the way to the nearest other centroid
        self.half = apart.min(axis=1) / 2 / SURE

    def _nearer(self, before: np.ndarray, now: np.ndarray, own: int, radius: float) -> Iterator[float]:
        """By how much each other centroid may have come nearer to a point of this cluster's ball."""
        for j in np.flatnonzero(self.drift).tolist():
            if j == own:
                continue
            drift = self.drift[j]
            from_middle = before[own] - (before[j] + now[j]) / 2
            away = float(np.sqrt((from_middle**2).sum()))
            if away <= radius:
                yield drift * SURE
                continue
            cos_axis = float(from_middle @ (now[j] - before[j])) / (drift * away)
            sin_axis = np.sqrt(max(0.0, 1 - cos_axis**2))
            sin_ball = radius / away
            cos_ball = np.sqrt(max(0.0, 1 - sin_ball**2))
            # the axis goes through the ball's shadow, or the ball's edge is the nearest to it
            least = 1.0 if cos_axis >= cos_ball else cos_axis * cos_ball + sin_axis * sin_ball
            yield min(drift * SURE, drift * (least + 1e-6))


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(axis=-1))


def _assign(batches: Iterator[pa.RecordBatch], move: Move, exact: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("vec_id", pa.int64()), ("v", pa.binary()), ("cluster", pa.int32()), ("upper", pa.float64()), ("lower", pa.float64()), ("distance", pa.int64())]
    )
    now = move.now
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            v = _matrix(part.column("v").to_pylist(), now.shape[1])
            cluster = part.column("cluster").fill_null(0).to_numpy(zero_copy_only=False).copy()
            known = part.column("cluster").is_valid().to_numpy(zero_copy_only=False)
            upper = part.column("upper").fill_null(np.inf).to_numpy(zero_copy_only=False) + move.drift[cluster]
            lower = part.column("lower").fill_null(0.0).to_numpy(zero_copy_only=False) - move.loosening[cluster]
            lower = np.where(known, np.maximum(lower, 0.0), 0.0)
            safe = np.maximum(lower, move.half[cluster])
            doubtful = np.flatnonzero(~known | (upper * SURE >= safe))
            distance = np.full(len(v), -1, np.int64)
            # first the distance to the own centroid, then those to all others where that does not settle it
            distance[doubtful] = ((v[doubtful] - now[cluster[doubtful]]) ** 2).sum(axis=1)
            upper[doubtful] = np.sqrt(distance[doubtful]) * SURE
            doubtful = doubtful[~known[doubtful] | (upper[doubtful] * SURE >= safe[doubtful])]
            cluster[doubtful], distance[doubtful], lower[doubtful] = nearest(v[doubtful], now)
            upper[doubtful] = np.sqrt(distance[doubtful]) * SURE
            if exact:
                unseen = np.flatnonzero(distance < 0)
                distance[unseen] = ((v[unseen] - now[cluster[unseen]]) ** 2).sum(axis=1)
            yield batch_of(schema, part.column("vec_id"), part.column("v"), cluster, upper, lower, distance)


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid, its squared distance, and a lower bound of the distance to the others; the smaller number of equals."""
    squares = np.stack([((v - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    best = squares.argmin(axis=1)
    rows = np.arange(len(v))
    found = squares[rows, best]
    squares[rows, best] = np.iinfo(np.int64).max
    return best, found, np.sqrt(squares.min(axis=1)) / SURE


def _moved(assigned: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centroids at the floors of their vectors' means, and the radius of each ball of vectors around the old ones."""
    k, dimensions = centroids.shape
    schema = "cluster int, place int, total long, n long, radius double"
    parts = arrow_map(assigned.select("cluster", "v", "upper"), _sums, schema, k=k, dimensions=dimensions)
    # a row per centroid and component
    sums = parts.groupBy("cluster", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("radius").alias("radius")).collect()
    moved, radius = centroids.copy(), np.zeros(k)
    for row in sums:
        moved[row.cluster, row.place] = row.total // row.n
        radius[row.cluster] = row.radius
    return moved, radius


def _sums(batches: Iterator[pa.RecordBatch], k: int, dimensions: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("cluster", pa.int32()), ("place", pa.int32()), ("total", pa.int64()), ("n", pa.int64()), ("radius", pa.float64())])
    total, n, radius = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64), np.zeros(k)
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            cluster = part.column("cluster").to_numpy(zero_copy_only=False)
            np.add.at(total, cluster, _matrix(part.column("v").to_pylist(), dimensions))
            n += np.bincount(cluster, minlength=k)
            np.maximum.at(radius, cluster, part.column("upper").to_numpy(zero_copy_only=False))
    full = np.flatnonzero(n)
    places = np.tile(np.arange(dimensions), len(full))
    spread = lambda x: np.repeat(x[full], dimensions)
    yield batch_of(schema, spread(np.arange(k)), places, total[full].ravel(), spread(n), spread(radius))
