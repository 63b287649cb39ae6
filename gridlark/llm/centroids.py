"""Centroid clustering by Elkan's bounds, exact on whole numbers.

Vectors become whole numbers, ``floor(scale * x)``, so that distances, sums and centroids are exact and do not
depend on how the rows are dealt. The first centroids are the ``k`` vectors with the smallest keyed hash of their
id. Each of ``rounds`` assigns all vectors and moves the centroids; a last assignment follows.

Every vector keeps its cluster, an upper bound of its distance to that centroid and a lower bound of its distance
to each of the ``k`` centroids. A centroid ``j`` is skipped where the upper bound is below ``j``'s lower bound, or
below half the distance of ``j`` from the vector's own centroid. When centroids move, bounds are loosened by how far.
Bounds are stored as 32-bit floats: upper ones are rounded up and lower ones down, and what is compared with them is
rounded in the same sense, so a bound is never too tight. Skipping asks for strictly less, so a centroid at exactly
the same distance is always looked at, and the smaller number wins by whole numbers.

The rows with their bounds are written to the shared folder in every round and read by the next; a lost executor
costs its tasks only. Sums are taken by task, then by centroid: the driver sees ``k`` rows a round.

Kept are vectors of exactly ``size`` components without a null, NaN or infinite one; others have no row in the
result. Components beyond ``LIMIT`` in magnitude count as ``LIMIT``, so that a squared distance is below 2 ** 62.
Repeated rows and ids are vectors of their own; a null id comes last in the order of hashes, and equal hashes are in
the order of their components. With fewer than ``k`` vectors each is a centroid; empty tables give no rows. An inertia
beyond 64 bits is null. Only ``vec_id`` and ``embedding`` are read, so further columns may have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, sliced, stored

SIZE, SCALE, K, ROUNDS, SEED = 64, 256, 40, 5, "2"
LIMIT = 1 << 27
#: Relative slack of a square root of a 64-bit number in double arithmetic, with room.
SLACK = 2.0**-48
STATE = "vec_id long, vector array<int>, cluster int, upper float, lower array<float>, distance long, n_distances long"


def up(x: np.ndarray) -> np.ndarray:
    """As 32-bit floats that are not below ``x``, and not below what ``x`` was rounded from."""
    return np.nextafter((np.asarray(x, np.float64) * (1 + SLACK)).astype(np.float32), np.float32(np.inf))


def down(x: np.ndarray) -> np.ndarray:
    """As 32-bit floats that are not above ``x``; never below 0."""
    return np.maximum(np.nextafter((np.asarray(x, np.float64) * (1 - SLACK)).astype(np.float32), np.float32(-np.inf)), np.float32(0))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def assigned(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, exact: bool = True) -> tuple[np.ndarray, ...]:
    """One round of assignment: cluster, squared distance, upper and lower bounds, distances computed.

    A ``cluster`` of -1 has no centroid yet. The squared distance is -1 where the bounds alone decided; with ``exact``
    it is computed there too.
    """
    n, k = lower.shape
    cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
    half = down(np.sqrt(np.stack([squared(centroids, c[None, :]) for c in centroids]).astype(np.float64)) / 2)
    best, spent = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    new = cluster < 0
    cluster[new] = 0

    def measure(rows: np.ndarray) -> None:
        """The exact distance to the own centroid, and bounds that are as tight as they get."""
        own = cluster[rows]
        best[rows] = squared(x[rows], centroids[own])
        root = np.sqrt(best[rows].astype(np.float64))
        upper[rows], lower[rows, own] = up(root), down(root)
        spent[rows] += 1

    def possible(rows: np.ndarray) -> np.ndarray:
        """Centroids that may be as near as the own one."""
        u, own = upper[rows, None], cluster[rows]
        out = (u >= lower[rows]) & (u >= half[own])
        out[np.arange(len(rows)), own] = False
        return out

    measure(np.nonzero(new)[0])
    loose = np.nonzero(~new)[0]
    measure(loose[possible(loose).any(axis=1)])
    tight = np.nonzero(best >= 0)[0]
    for j in range(k):
        own = cluster[tight]
        rows = tight[(own != j) & (upper[tight] >= lower[tight, j]) & (upper[tight] >= half[own, j])]
        if not len(rows):
            continue
        d = squared(x[rows], centroids[j][None, :])
        spent[rows] += 1
        root = np.sqrt(d.astype(np.float64))
        lower[rows, j] = down(root)
        nearer = (d < best[rows]) | ((d == best[rows]) & (j < cluster[rows]))
        moved = rows[nearer]
        cluster[moved], best[moved], upper[moved] = j, d[nearer], up(root[nearer])
    if exact:
        measure(np.nonzero(best < 0)[0])
    return cluster, best, upper, lower, spent


def loosened(upper: np.ndarray, lower: np.ndarray, cluster: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds after centroids moved by these squared distances."""
    by = up(np.sqrt(moved.astype(np.float64))).astype(np.float64)
    return up(upper.astype(np.float64) + by[cluster]), down(np.maximum(lower.astype(np.float64) - by[None, :], 0))


def whole_vectors(vectors: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id and the kept vectors as arrays of whole numbers."""
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    kept = vectors.filter(x.isNotNull() & (F.size(x) == size)).filter(~F.coalesce(bad, F.lit(True)))
    one = lambda v: F.greatest(F.least(F.floor(F.greatest(F.least(v.cast("double") * scale, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int")
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, one).alias("vector"))


def _matrix(column, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def _round(state: DataFrame, centroids: np.ndarray, moved: np.ndarray | None, exact: bool) -> DataFrame:
    k, size = centroids.shape

    def kernel(batches):
        import pyarrow as pa

        for batch in sliced(batches, 4096):
            if not batch.num_rows:
                continue
            col = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            x = _matrix(col("vector"), size, np.int64)
            cluster, spent = col("cluster").to_numpy(), col("n_distances").to_numpy()
            upper, lower = col("upper").to_numpy(), _matrix(col("lower"), k, np.float32)
            if moved is not None:
                upper, lower = loosened(upper, lower, cluster, moved)
            cluster, best, upper, lower, more = assigned(x, centroids, cluster, upper, lower, exact)
            offsets = pa.array(np.arange(0, len(x) * k + 1, k), pa.int32())
            arrays = [col("vec_id"), col("vector"), pa.array(cluster, pa.int32()), pa.array(upper, pa.float32()), pa.ListArray.from_arrays(offsets, pa.array(lower.ravel(), pa.float32())), pa.array(best, pa.int64()), pa.array(spent + more, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in STATE.split(", ")])

    return state.mapInArrow(kernel, STATE)


def _sums(state: DataFrame, k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and componentwise sums by cluster."""

    def kernel(batches):
        import pyarrow as pa

        count, total = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for batch in batches:
            cluster, x = batch.column(0).to_numpy(), _matrix(batch.column(1), size, np.int64)
            count += np.bincount(cluster, minlength=k)
            np.add.at(total, cluster, x)
        some = np.nonzero(count)[0]
        flat = total[some].ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, size), pa.int32()), pa.array(np.tile(np.arange(size), len(some)), pa.int32()), pa.array(flat, pa.int64()), pa.array(np.repeat(count[some], size), pa.int64())], ["cluster", "place", "total", "n"])

    parts = state.select("cluster", "vector").mapInArrow(kernel, "cluster int, place int, total long, n long")
    count, total = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
    for r in parts.groupBy("cluster", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # k * size rows
        count[r["cluster"]], total[r["cluster"], r["place"]] = r["n"], r["total"]
    return count, total


def cluster_vectors(vectors: DataFrame, *, k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, n_distances of every kept vector.

    ``n_distances`` counts the exact distances that were computed for the vector over all rounds, out of
    ``k * (rounds + 1)``.
    """
    spark = vectors.sparkSession
    whole = whole_vectors(vectors, size, scale)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = whole.orderBy(key.asc_nulls_last(), "vector").limit(k).select("vector").collect()  # k rows
    centroids = np.array([r["vector"] for r in first], np.int64).reshape(len(first), size)
    k = len(first)
    none = F.array_repeat(F.lit(0.0).cast("float"), k)
    start = whole.select("vec_id", "vector", F.lit(-1).alias("cluster"), F.lit(0.0).cast("float").alias("upper"), none.alias("lower"), F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("n_distances"))
    if not k:
        return start.select("vec_id", "cluster", "distance", F.col("distance").alias("cluster_inertia"), F.col("distance").alias("inertia"), F.lit("").alias("centroid_sha256"), "n_distances").limit(0)
    state, moved = start, None
    for turn in range(rounds + 1):
        done = stored(_round(state, centroids, moved, turn == rounds), "elkan-state")
        if turn:
            drop_stored(state)
        state = done
        if turn < rounds:
            count, total = _sums(state, k, size)
            new = np.where(count[:, None] > 0, total // np.maximum(count, 1)[:, None], centroids)
            moved, centroids = squared(new, centroids), new
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    names = spark.createDataFrame(list(enumerate(digests)), "c_cluster int, centroid_sha256 string")
    each = state.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    whole_sum = each.agg(F.try_sum("cluster_inertia").alias("inertia"))
    known = names.join(each, F.col("c_cluster") == F.col("cluster")).crossJoin(whole_sum).select("c_cluster", "cluster_inertia", "inertia", "centroid_sha256")  # k rows and one row
    known = stored(known, "elkan-inertia", narrow=True)
    return state.join(F.broadcast(known), F.col("cluster") == F.col("c_cluster")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_distances")


def oracle(k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: str = SEED) -> str:
    """The same rows in DuckDB SQL, by looking at every centroid in every round."""
    near = "list_sum([({v}[i] - {c}[i]) * ({v}[i] - {c}[i]) FOR i IN range(1, %d)])" % (size + 1)
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR)) NULLS LAST, v) - 1 AS c, v AS w FROM v QUALIFY c < {k})",
    ]
    for t in range(rounds + 1):
        steps.append(f"d{t} AS MATERIALIZED (SELECT row_id, min((CAST({near.format(v='v.v', c='w')} AS BIGINT), c)) AS best FROM v CROSS JOIN c{t} GROUP BY row_id)")
        if t < rounds:
            steps.append(
                f"""s{t} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, CAST(count(*) AS BIGINT) AS n FROM (SELECT best[2] AS c, unnest(v) AS x, unnest(range(1, {size + 1})) AS i FROM d{t} JOIN v USING (row_id)) GROUP BY c, i),
c{t + 1} AS MATERIALIZED (SELECT c{t}.c, coalesce(m.w, c{t}.w) AS w FROM c{t} LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS w FROM s{t} GROUP BY c) m USING (c))"""
            )
    return f"""WITH {', '.join(steps)},
e AS (SELECT vec_id, CAST(best[2] AS INTEGER) AS cluster, best[1] AS distance FROM d{rounds} JOIN v USING (row_id))
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(w, ',')) AS centroid_sha256
FROM e JOIN c{rounds} ON c = cluster"""
