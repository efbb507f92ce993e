"""Integer k-means with a LAESA pivot table.

The distances of every vector to a few fixed pivots are computed once and stored beside the
vector. In each round the distances of pivots and centroids give, by the triangle inequality,
a lower bound of every distance between a vector and a centroid. A vector visits centroids by
rising bound and stops where the bound exceeds the best distance; centroids that survive get
exact integer distances. A task hands on one partial sum per cluster, so a cluster or a
common vector of any size costs one row per task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagecorpus.session import freeze, spread

#: Centroids, rounds, components, and by what a component is multiplied.
K, ROUNDS, SIZE, SCALE = 8, 10, 64, 1024
#: Pivots, and the vectors of smallest hash among which they are chosen. They change the
#: work and never the result.
PIVOTS, SAMPLE = 8, 256
#: Components below this keep every squared distance of ``SIZE`` of them in 64 bits.
LARGEST = 1 << 27
#: Relative slack of a bound, far above the rounding of the square roots it comes from.
SLACK = 1e-12


@dataclass(frozen=True)
class Clusters:
    """``assigned(vec_id, cluster, distance)``, the centroids in use, and exact distances computed per round."""

    assigned: DataFrame
    centroids: np.ndarray
    exact: list[int]


def whole(vector: Column, size: int = SIZE) -> Column:
    """Whether a vector has the right number of components, none null or non-finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == size) & finite, F.lit(False))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    gap = a - b
    return np.einsum("...i,...i->...", gap, gap)


def nearest(vectors: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (ties: smaller number) and squared distance of each row; distances computed."""
    across = np.sqrt(squared(pivots[:, None, :], centroids[None, :, :]))
    bound = np.zeros((len(vectors), len(centroids)))
    for p in range(len(pivots)):
        mine, theirs = to_pivots[:, p, None], across[None, p, :]
        np.maximum(bound, np.abs(mine - theirs) - SLACK * (mine + theirs), out=bound)
    bound = bound * bound * (1 - SLACK)
    order = np.argsort(bound, axis=1, kind="stable")
    cluster = order[:, 0].copy()
    best = squared(vectors, centroids[cluster])
    left, computed = np.arange(len(vectors)), len(vectors)
    for k in range(1, len(centroids)):
        c = order[left, k]
        alive = bound[left, c] <= best[left]
        left, c = left[alive], c[alive]
        if not len(left):
            break
        found = squared(vectors[left], centroids[c])
        computed += len(left)
        nearer = (found < best[left]) | ((found == best[left]) & (c < cluster[left]))
        best[left[nearer]], cluster[left[nearer]] = found[nearer], c[nearer]
    return cluster, best, computed


def _apart(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots far from each other, farthest first."""
    chosen = [0]
    gap = squared(sample, sample[0])
    while len(chosen) < count and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, squared(sample, sample[chosen[-1]]))
    return sample[chosen]


def _scaled(values: np.ndarray, scale: int) -> np.ndarray:
    scaled = np.floor(scale * values)
    if len(scaled) and np.abs(scaled).max() >= LARGEST:
        raise ValueError(f"a component is {LARGEST} or more after scaling: squared distances would not fit in 64 bits")
    return scaled.astype(np.int64)


def _rows(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    """A binary column of equal widths as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(len(column), width)


def cluster_vectors(
    table: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    k: int = K,
    rounds: int = ROUNDS,
    seed: int = 3,
    size: int = SIZE,
    scale: int = SCALE,
    pivots: int = PIVOTS,
) -> Clusters:
    """Clusters of the whole vectors of ``table``; see :func:`whole` for those left out.

    Components count as ``floor(scale * x)``. Centroids start as the ``k`` vectors of smallest
    SHA-256 of ``seed:vec_id``, in that order (equal hashes: the smaller vector; a null
    identifier hashes as nothing); fewer vectors give fewer centroids, none gives no rows.
    Rounds replace every non-empty centroid by the floor of its vectors' mean; an empty one,
    such as the second of two equal ones, stays. Identifiers may repeat: every row is a
    vector. Other columns are not looked at. A component of 2^27 or more after scaling raises
    an error, since its squared distances would not fit in a long.
    """
    doubles = F.col(vector).cast("array<double>")
    rows = table.select(F.col(vec_id).alias("vec_id"), doubles.alias("v")).where(whole(F.col("v"), size))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select(hashed.alias("h"), "v").orderBy("h", "v").limit(max(k, SAMPLE)).collect()
    spark = table.sparkSession
    kind = rows.schema["vec_id"].dataType.simpleString()
    out = f"vec_id {kind}, cluster int, distance bigint"
    if not first:
        return Clusters(spark.createDataFrame([], out), np.zeros((0, size), dtype=np.int64), [])
    sample = _scaled(np.array([r.v for r in first]), scale)
    fixed, centroids = _apart(sample, pivots), sample[:k].copy()

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _scaled(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size), scale)
            far = np.stack([np.sqrt(squared(values, p)) for p in fixed], axis=1)
            cells, distances = (m.tobytes() for m in (values.astype("<i4"), far.astype("<f8")))
            cut = lambda raw, w: pa.array([raw[i * w : i * w + w] for i in range(len(values))], pa.binary())
            columns = [batch.column(0), cut(cells, 4 * size), cut(distances, 8 * len(fixed))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cells", "far"])

    # The pivot table: read by every round, computed once.
    stored = freeze(spread(rows).mapInArrow(measured, f"vec_id {kind}, cells binary, far binary"))

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        cells, far = (batch.column(batch.schema.get_field_index(n)) for n in ("cells", "far"))
        return _rows(cells, "<i4", size).astype(np.int64), _rows(far, "<f8", len(fixed))

    exact = []
    for _ in range(rounds):
        sums, counts, computed = _sums(stored.select("cells", "far"), read, centroids, fixed)
        filled = counts > 0
        centroids[filled] = sums[filled] // counts[filled, None]
        exact.append(computed)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, best, _ = nearest(*read(batch), centroids, fixed)
            columns = [batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(best)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    return Clusters(freeze(stored.mapInArrow(placed, out)), centroids, exact)


def _sums(stored: DataFrame, read, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Componentwise sums and sizes of all clusters, and the distances computed.

    A row of the result per cluster and component (and two more) comes to the driver.
    """
    size = centroids.shape[1]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), size + 2), dtype=np.int64)
        for batch in batches:
            vectors, far = read(batch)
            cluster, _, computed = nearest(vectors, far, centroids, pivots)
            for c in np.unique(cluster):
                mine = cluster == c
                total[c, :size] += vectors[mine].sum(axis=0)
                total[c, size] += mine.sum()
            total[0, size + 1] += computed
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.int64()))], ["cluster", "part"])

    parts = stored.mapInArrow(partial, "cluster int, part array<bigint>").select("cluster", F.posexplode("part").alias("i", "x"))
    result = np.zeros((len(centroids), size + 2), dtype=np.int64)
    for r in parts.groupBy("cluster", "i").agg(F.sum("x").alias("x")).collect():
        result[r.cluster, r.i] = r.x
    return result[:, :size], result[:, size], int(result[:, size + 1].sum())


def with_inertia(found: Clusters) -> DataFrame:
    """``assigned`` with ``cluster_inertia``, ``inertia`` and the centroid's ``components``, a string.

    The table that is broadcast has a row per centroid.
    """
    spark = found.assigned.sparkSession
    sums = {r.cluster: r.s for r in found.assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    rows = [(c, s, sum(sums.values()), ",".join(map(str, found.centroids[c].tolist()))) for c, s in sums.items()]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, components string")
    return found.assigned.join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "components"
    )
