"""Centroid clustering over an incremental matrix of exact dot products.

Components are scaled and floored to integers, so every dot product, norm and squared distance is exact. A stored row holds a
vector, its squared norm and its dot product with every centroid. When centroids change, a dot product changes by the vector
times the change: only the components in which a centroid moved are multiplied and added, then the nearest centroid is
chosen again from the numbers at hand (squared distance = norm - 2 dot + norm of the centroid). Each round writes the updated
matrix to the shared folder and reads it back, so a lost executor costs one round's tasks. Sums of a centroid's
vectors are incremental as well: only vectors that changed their centroid are added to one and taken from another.

What goes to the tasks is the change of ``K`` centroids; what comes back are ``K`` sums a task, added up by Spark. Rounds
stop early only when no centroid moved, since every further round would repeat the last. Of the matrices, those of the last two
rounds are kept, older ones are deleted, so the disk holds three at most.

Vectors of another length, NULL vectors and vectors with a NULL or non-finite component are left out. A component beyond
``LARGEST`` after scaling raises an error, as its squared distance would not fit a long. Repeated vec_ids are vectors of their own;
NULL ids hash as the empty number. First centroids that tie (repeated ids) are ordered by their components. Fewer vectors than
``K`` give fewer centroids, none give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingmill.session import materialize, shared_dir

K = 8
ROUNDS = 10
LENGTH = 64
SCALE = 1024
SEED = 3
LARGEST = 1 << 26

_MATRIX = "vec_id long, x array<int>, norm long, dots array<long>, cluster int, before int, distance long"


def kept_vectors(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and x, the scaled integers of every usable vector."""
    x = F.col(column).cast("array<double>")
    whole = (F.size(x) == LENGTH) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    scaled = F.transform(x, lambda v: F.when(F.abs(v * SCALE) < LARGEST, F.floor(v * SCALE).cast("int")))
    good = rows.select(F.col("vec_id").cast("long").alias("vec_id"), column).filter(F.coalesce(whole, F.lit(False))).select("vec_id", scaled.alias("x"))
    return good.withColumn("x", F.when(F.exists("x", lambda v: v.isNull()), F.raise_error(F.lit("component too large"))).otherwise(F.col("x")))


def seeds(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The first centroids: at most ``k`` rows come to the driver."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.x for r in vectors.orderBy(order, "x").limit(k).select("x").collect()], np.int64).reshape(-1, LENGTH)


def _list(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(matrix.shape[0] + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).ravel(), kind))


def _square(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy().reshape(batch.num_rows, -1)


def advance(matrix: DataFrame, change: np.ndarray, norms: np.ndarray) -> DataFrame:
    """The matrix after its centroids moved by ``change`` to squared norms ``norms``; rows without dots start at 0."""
    moved = [(c, np.flatnonzero(row), row[np.flatnonzero(row)]) for c, row in enumerate(change) if row.any()]

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, norm = _square(batch, "x"), batch.column("norm").to_numpy()
            dots = _square(batch, "dots").copy() if batch.column("dots").null_count == 0 else np.zeros((batch.num_rows, len(change)), np.int64)
            for c, at, by in moved:
                dots[:, c] += x[:, at].astype(np.int64) @ by
            distance = norm[:, None] - 2 * dots + norms
            cluster = distance.argmin(axis=1)  # the first of equals
            cells = [
                batch.column("vec_id"), batch.column("x"), batch.column("norm"), _list(dots, pa.int64()), pa.array(cluster, pa.int32()),
                batch.column("cluster"), pa.array(distance[np.arange(len(x)), cluster]),
            ]
            yield pa.RecordBatch.from_arrays(cells, names=["vec_id", "x", "norm", "dots", "cluster", "before", "distance"])

    return matrix.mapInArrow(update, _MATRIX)


def moves(matrix: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """By how much the sums and counts of the centroids change through vectors that changed theirs: ``k`` rows from Spark."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, LENGTH + 1), np.int64)
        for batch in batches:
            x = np.c_[_square(batch, "x").astype(np.int64), np.ones(batch.num_rows, np.int64)] if batch.num_rows else np.zeros((0, LENGTH + 1), np.int64)
            to, left = batch.column("cluster").to_numpy(), batch.column("before").fill_null(-1).to_numpy()
            for c in range(k):
                sums[c] += x[to == c].sum(axis=0) - x[left == c].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), _list(sums, pa.int64())], names=["c", "sums"])

    changed = matrix.filter(~F.col("cluster").eqNullSafe(F.col("before"))).select("x", "cluster", "before")
    parts = changed.mapInArrow(add, "c int, sums array<long>").select("c", F.posexplode("sums").alias("j", "v"))
    # A sum of integers below 2**26 passes a long only beyond 2**37 vectors; decimals have room beyond.
    total = np.zeros((k, LENGTH + 1), object)
    for r in parts.groupBy("c", "j").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("v")).collect():
        total[r.c, r.j] = int(r.v)
    return total[:, :LENGTH], total[:, LENGTH]


def cluster(rows: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and distance of every kept vector after the last assignment, and the final centroids."""
    spark = rows.sparkSession
    root = shared_dir(spark, "centroids")
    norm = F.aggregate("x", F.lit(0).cast("long"), lambda acc, v: acc + v.cast("long") * v)
    start = kept_vectors(rows).select(
        "vec_id", "x", norm.alias("norm"), F.lit(None).cast("array<long>").alias("dots"), F.lit(None).cast("int").alias("cluster"),
    )
    matrix = materialize(start, f"{root}/round-start")
    centroids = seeds(matrix, k, seed)
    k, change = len(centroids), centroids
    sums, counts = np.zeros((k, LENGTH), object), np.zeros(k, object)
    for number in range(rounds + 1):
        matrix = materialize(advance(matrix, change, (centroids**2).sum(axis=1)), f"{root}/round-{number}")
        _forget(spark, f"{root}/round-{number - 2}" if number > 1 else f"{root}/round-start" if number == 1 else None)
        if number == rounds or not k:
            break
        by, held = moves(matrix, k)
        sums, counts = sums + by, counts + held
        new = np.array([[int(s) // int(n) for s in row] if n else old.tolist() for row, n, old in zip(sums, counts, centroids)], np.int64).reshape(-1, LENGTH)
        change, centroids = new - centroids, new
        if not change.any():
            break
    return matrix.select("vec_id", "cluster", "distance"), centroids


def _forget(spark, folder: str | None) -> None:
    """Delete a matrix that nothing reads any more, through the file system that holds it."""
    if folder:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def centroid_hash(components: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, components.tolist())).encode()).hexdigest()


def digest(rows: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    placed, centroids = cluster(rows)
    names: Column = F.array(*[F.lit(centroid_hash(c)) for c in centroids]) if len(centroids) else F.array().cast("array<string>")
    own = placed.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    found = {r.cluster: r.cluster_inertia for r in own.collect()}  # at most K rows
    parts = F.array(*[F.lit(found.get(c, 0)).cast("long") for c in range(len(centroids))]) if found else F.array().cast("array<bigint>")
    return placed.select(
        "vec_id", "cluster", "distance", F.get(parts, F.col("cluster")).alias("cluster_inertia"),
        F.lit(sum(found.values())).cast("long").alias("inertia"), F.get(names, F.col("cluster")).alias("centroid_sha256"),
    )


def _sql() -> str:
    """Every round is a pair of subqueries: c<i> the centroids, a<i> the assignment (squared distance and number in one integer)."""
    steps = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x AS m FROM (SELECT sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, x FROM v ORDER BY h, x LIMIT 8))",
    ]
    assign = """a{0} AS MATERIALIZED (SELECT r, min(CAST(list_sum(list_transform(list_zip(x, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) * 8 + c) AS dc FROM v, c{0} GROUP BY r)"""
    move = """s{0} AS (SELECT dc % 8 AS c, j, sum(e) AS t, count(*) AS n FROM (SELECT dc, unnest(x) AS e, unnest(range(1, 65)) AS j FROM a{0} JOIN v USING (r)) GROUP BY ALL),
c{1} AS MATERIALIZED (SELECT o.c, coalesce(w.m, o.m) AS m FROM c{0} o LEFT JOIN (SELECT c, list(CAST((t - ((t % n) + n) % n) // n AS BIGINT) ORDER BY j) AS m FROM s{0} GROUP BY c) w ON o.c = w.c)"""
    for i in range(ROUNDS):
        steps += [assign.format(i), move.format(i, i + 1)]
    steps += [assign.format(ROUNDS), f"p AS (SELECT vec_id, CAST(dc % 8 AS INTEGER) AS cluster, dc // 8 AS distance FROM a{ROUNDS} JOIN v USING (r))"]
    last = f"""SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256 FROM p JOIN c{ROUNDS} k ON k.c = p.cluster"""
    return "WITH " + ",\n".join(steps) + "\n" + last


SQL = _sql()
