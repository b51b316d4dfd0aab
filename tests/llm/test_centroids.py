import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from repolytics.llm import centroids

SCHEMA = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.DoubleType())),
        T.StructField("cluster", T.StringType()),
        T.StructField("x", T.StringType()),
        T.StructField("id", T.StringType()),
    ]
)


def table(spark, rows):
    return spark.createDataFrame([(i, v, "clash", "clash", "clash") for i, v in rows], SCHEMA).repartition(3)


def brute(rows, k, rounds, size):
    def whole(v):
        return v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)

    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if whole(v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    now = [v for _, v in start[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(now))

    for _ in range(rounds):
        mine = [nearest(v)[1] for _, v in kept]
        for j in range(len(now)):
            own = [v for (_, v), m in zip(kept, mine) if m == j]
            if own:
                now[j] = [sum(column) // len(own) for column in zip(*own)]
    last = [(i, *nearest(v)) for i, v in kept]
    total = sum(d for _, d, _ in last)
    return sorted(
        ((i, j, d, sum(e for _, e, m in last if m == j), total, hashlib.sha256(",".join(map(str, now[j])).encode()).hexdigest()) for i, d, j in last), key=str
    )


def rows_of(seed, n, size):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-1.5, -0.25, 0.0, 0.3, 0.9]) + rng.random() / 4 for _ in range(size)]) for i in range(n)]
    rows += [rows[0], (0, rows[1][1]), (None, rows[2][1]), (n, None), (n + 1, []), (n + 2, [1.0] * (size - 1))]
    rows += [(n + 3, [math.nan] * size), (n + 4, [math.inf] * size), (n + 5, [None] * size), (n + 6, rows[3][1])]
    return rows


@pytest.mark.parametrize("n,k,size", [(90, 7, 5), (3, 40, 5), (150, 12, 2)])
def test_equals_brute_force(spark, n, k, size):
    rows = rows_of(n, n, size)
    found = centroids.clusters(table(spark, rows), k=k, size=size).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(rows, k, 5, size)


def test_tournament_takes_the_smaller_number_at_equal_distance():
    rng = np.random.default_rng(4)
    for _ in range(30):
        c, x = rng.integers(-3, 4, (9, 3)), rng.integers(-3, 4, (200, 3))
        best, distance = centroids.Bisectors(c).nearest(x)
        all_of = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert (best == all_of.argmin(axis=1)).all() and (distance == all_of.min(axis=1)).all()


def test_sign_tests_are_exact_at_the_limit():
    far = centroids.LIMIT
    c = np.array([[far] * 64, [-far] * 64, [far] * 63 + [far - 1]])
    x = np.array([[-far] * 64, [far] * 63 + [far - 1], [far] * 64])
    best, distance = centroids.Bisectors(c).nearest(x)
    assert best.tolist() == [1, 2, 0] and distance.tolist() == [0, 0, 0]


def test_empty_and_too_large(spark):
    assert centroids.clusters(table(spark, [])).count() == 0
    assert centroids.clusters(table(spark, [(1, [1.0])])).count() == 0
    with pytest.raises(Exception, match="exceeds"):
        centroids.clusters(table(spark, [(1, [1e9] * 64)])).collect()
