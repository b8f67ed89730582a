import hashlib
import math
import random

import pytest

from listingmill.llm import centroids


def brute(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    means = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(means))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for c, g in groups.items():
            means[c] = [sum(col) // len(g) for col in zip(*g)]
    found = [(i, *near(v)) for i, v in kept]
    total = sum(d for _, d, _ in found)
    each = {c: sum(d for _, d, x in found if x == c) for _, _, c in found}
    return sorted([(i, c, d, each[c], total, hashlib.sha256(",".join(map(str, means[c])).encode()).hexdigest()) for i, d, c in found], key=str)


def rows_of(seed, n=120):
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(5)]
    rows = [(k, [m + rng.gauss(0, 0.3) for m in rng.choice(middles)]) for k in range(n)]
    rows += [(900 + k, list(middles[0])) for k in range(60)]  # a large group of equal vectors
    bad = [(500, None), (501, []), (502, [0.0] * 63), (503, [0.0] * 63 + [None]), (504, [float("nan")] * 64), (505, [float("inf")] + [0.0] * 63)]
    return rows + bad + [(7, [0.5] * 64), (7, [0.5] * 64), (None, [-0.25] * 64), (8, [0.0] * 64)]


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, x string, dots string")


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = rows_of(seed)
    got = centroids.digest(table(spark, rows).repartition(3)).collect()
    assert sorted([(r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got], key=str) == brute(rows)


def test_few_vectors_and_empty_clusters(spark):
    rows = [(k, [float(k % 3)] * 64) for k in range(6)]
    got = centroids.digest(table(spark, rows)).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows) and {r.distance for r in got} == {0}
    assert centroids.digest(table(spark, [(1, None)])).isEmpty()
    assert centroids.digest(table(spark, rows[:1])).first().cluster == 0


def test_only_moved_components_are_multiplied(spark):
    """Dot products after a change of a few components are those from scratch."""
    import numpy as np

    vectors = centroids.kept_vectors(table(spark, rows_of(3)))
    from pyspark.sql import functions as F

    start = vectors.select("vec_id", "x", F.aggregate("x", F.lit(0).cast("long"), lambda a, v: a + v.cast("long") * v).alias("norm"), F.lit(None).cast("array<long>").alias("dots"), F.lit(None).cast("int").alias("cluster"))
    first = np.arange(128, dtype=np.int64).reshape(2, 64) * 7
    change = np.zeros((2, 64), np.int64)
    change[1, [3, 60]] = (-50, 999)
    both = centroids.advance(centroids.advance(start, first, (first**2).sum(1)), change, ((first + change) ** 2).sum(1))
    for r in both.collect():
        assert r.dots == [int(np.array(r.x, np.int64) @ (first + change)[c]) for c in (0, 1)]
        assert r.distance == min(int(((np.array(r.x, np.int64) - m) ** 2).sum()) for m in first + change)


def test_a_component_that_does_not_fit(spark):
    with pytest.raises(Exception, match="component too large"):
        centroids.digest(table(spark, [(1, [1e30] + [0.0] * 63)])).collect()
