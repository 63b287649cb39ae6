"""Clustering by bounds against all distances, its rounding, and edge cases."""

import hashlib

import numpy as np
import pytest

from gridlark.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, cluster string"


def plain(rows, k=40, rounds=5):
    """Every distance in every round, in whole numbers of any size."""
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centres = [v for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(centres)):
            part = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if part:
                centres[j] = [sum(c) // len(part) for c in zip(*part, strict=True)]
    last = [near(v) for _, v in kept]
    inertia = {j: sum(d for d, o in last if o == j) for j in range(len(centres))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), digest[j]) for (i, _), (d, j) in zip(kept, last, strict=True)), key=str)


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA)
    return sorted((tuple(r)[:6] for r in centroids.cluster_vectors(df, **how).collect()), key=str)


def test_ties_repeats_and_broken_rows(spark):
    """Vectors on a coarse lattice: most distances have ties."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-1, 2, 64) * (np.arange(64) < 4) / 256]) for i in range(300)]
    rows += rows[:7] + [(None, rows[0][1]), (-5, [0.5] * 64), (900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 63 + [None]), (904, [float("nan")] * 64), (905, [float("inf")] + [0.0] * 63)]
    assert run(spark, rows) == plain(rows)


def test_few_and_no_vectors(spark):
    rows = [(i, [i / 300] * 64) for i in range(5)]
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == []


def test_large_components_are_limited(spark):
    got = run(spark, [(1, [3e38] * 64), (2, [-3e38] * 64)], k=1, rounds=0)
    assert sorted(r[2] for r in got) == [0, 64 * (2 * centroids.LIMIT) ** 2]


def test_query_equals_sql_and_skips(spark, sf_dir, same):
    from gridlark.llm import queries

    same(queries.QUERIES["op11_centroids"](spark, sf_dir), queries.ORACLE_SQL["op11_centroids"])
    spent = [r.n_distances for r in centroids.cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).collect()]
    assert sum(spent) < 0.6 * 240 * len(spent)


def test_bounds_hold_after_moves():
    """Upper bounds are never below, and lower ones never above, the true distances."""
    rng = np.random.default_rng(5)
    x, c = rng.integers(-300, 300, (500, 64)), rng.integers(-300, 300, (9, 64))
    cluster, upper, lower = np.full(500, -1, np.int32), np.zeros(500, np.float32), np.zeros((500, 9), np.float32)
    for turn in range(6):
        cluster, best, upper, lower, _ = centroids.assigned(x, c, cluster, upper, lower, turn == 5)
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert (cluster == d.argmin(axis=1)).all()
        true = np.sqrt(d.astype(np.longdouble))
        assert (lower <= true).all() and (upper >= true[np.arange(500), cluster]).all()
        new = c + rng.integers(-20, 20, c.shape)
        upper, lower = centroids.loosened(upper, lower, cluster, centroids.squared(new, c))
        true = np.sqrt(((x[:, None] - new[None]) ** 2).sum(axis=2).astype(np.longdouble))
        assert (lower <= true).all() and (upper >= true[np.arange(500), cluster]).all()
        c = new


@pytest.mark.parametrize("n", [0, 1, 3, 1 << 40, (1 << 62) - 1])
def test_rounding(n):
    root = np.sqrt(np.float64(n))
    assert int(centroids.down(np.array([root]))[0].astype(object)) ** 2 <= n
    u = float(centroids.up(np.array([root]))[0])
    assert int(np.ceil(u)) ** 2 >= n
