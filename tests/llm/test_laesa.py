"""Integer k-means with pivots against plain loops."""

import hashlib
import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from data import FOLDER

from pagecorpus.llm import laesa
from pagecorpus.llm.queries import op12_centroids


def slow(rows, k=8, rounds=10):
    """Per row of ``(vec_id, vector)`` that counts: ``(vec_id, cluster, distance)``; and the centroids."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(1024 * x) for x in v]))
    seeds = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in seeds[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    place = lambda v: min((gap(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(place(v)[1], []).append(v)
        for j, g in groups.items():
            centroids[j] = [sum(c) // len(g) for c in zip(*g)]
    return [(i, *reversed(place(v))) for i, v in kept], centroids


def assigned(found):
    return sorted(map(tuple, found.assigned.collect()), key=str)


def test_query_against_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{FOLDER}/embeddings.parquet").to_pylist()]
    placed, centroids = slow(rows)
    sums = [sum(d for _, c, d in placed if c == j) for j in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    expected = {i: (c, d, sums[c], sum(sums), digest[c]) for i, c, d in placed}
    assert {r.vec_id: tuple(r)[1:] for r in op12_centroids(spark, FOLDER).collect()} == expected


def vectors(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"vec_id bigint, embedding array<double>{extra}")


def test_awkward_rows(spark):
    rng = random.Random(4)
    one = [rng.gauss(0, 1) for _ in range(64)]
    rows = [(i, [rng.gauss(i % 3, 0.1) for _ in range(64)]) for i in range(60)]
    rows += [(None, one), (None, one), (7, one), (7, one), (200, None), (201, []), (202, one[:63]), (203, one + [0.0])]
    rows += [(204, [None] + one[1:]), (205, [float("nan")] + one[1:]), (206, [float("-inf")] + one[1:]), (207, [-1e-9] * 64)]
    expected, centroids = slow(rows)
    found = laesa.cluster_vectors(vectors(spark, rows).selectExpr("*", "1 AS cluster", "'x' AS cells", "2 AS far"))
    assert assigned(found) == sorted(expected, key=str)
    assert found.centroids.tolist() == centroids
    with pytest.raises(Exception, match="64 bits"):
        laesa.cluster_vectors(vectors(spark, [(1, [1e6] * 64)]))


@pytest.mark.parametrize("count", [0, 1, 3])
def test_few_vectors(spark, count):
    rows = [(i, [float(i)] * 64) for i in range(count)]
    found = laesa.cluster_vectors(vectors(spark, rows))
    assert assigned(found) == sorted(slow(rows)[0], key=str)
    assert laesa.with_inertia(found).count() == count


def test_a_common_vector_leaves_centroids_empty(spark):
    """Equal starts: ties go to the smaller number, the other centroid stays empty and where it is."""
    rows = [(i, [0.5] * 64) for i in range(300)] + [(i, [float(i % 7)] * 64) for i in range(300, 330)]
    expected, centroids = slow(rows)
    found = laesa.cluster_vectors(vectors(spark, rows).repartition(7))
    assert assigned(found) == sorted(expected, key=str)
    assert found.centroids.tolist() == centroids


def test_bounds_spare_distances_and_change_nothing(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=64) * 0.05 + (i % 8) * 3 * np.eye(64)[i % 8]).tolist()) for i in range(800)]
    found = laesa.cluster_vectors(vectors(spark, rows))
    assert assigned(found) == sorted(slow(rows)[0], key=str)
    assert found.exact[-1] < 0.6 * 800 * 8
    fewer = laesa.cluster_vectors(vectors(spark, rows), pivots=1)
    assert assigned(fewer) == assigned(found)
