"""Exact integer k-means whose nearest centroid is found by a tournament of bisectors.

For two centroids ``a < b`` the points nearer to ``b`` lie on one side of a hyperplane:
``|x-a|^2 > |x-b|^2`` exactly when ``2 (b - a) . x > |b|^2 - |a|^2``. Normals and thresholds of
all pairs are integers and computed once a round. A vector then plays ``k - 1`` sign tests: the
best so far meets the next centroid, the loser is out, and zero favours the smaller number. No
distance is computed but the one to the winner.

A round is one pass over the table. Tasks add up their vectors cluster by cluster and send one
row for each cluster; Spark adds those, and ``k`` rows of sums reach the driver, whatever the
number of vectors. Nothing is shuffled by cluster, so a cluster that owns a third of all vectors
costs no more than another.

Defined results: a vector that is null, of another length, or holds a null, NaN or infinity is
left out. A null id is kept and is taken as a starting centroid last. Rows that share an id are rows
of their own; among equal ids the smaller vector (component by component) starts first. Equal starting
vectors are separate centroids, of which the larger number stays empty. With fewer vectors than
``k`` every vector starts a centroid; an empty table gives an empty result. A component whose
integer exceeds ``LIMIT`` in size is an error, since squared distances no longer fit 64 bits. Columns of any
name may be present. There are no texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

# |x| and |c| up to 2^27: 64 squared differences of 2^28 add up to 2^62 at most
LIMIT = 1 << 27
_BLOCK = 8192


class Bisectors:
    """Normals and thresholds of all pairs of centroids."""

    def __init__(self, centroids: np.ndarray):
        c = self.centroids = np.asarray(centroids, np.int64)
        squares = (c * c).sum(axis=1)
        # [best, rival]: a positive side value means that the rival is nearer
        self.normals = 2 * (c[None, :, :] - c[:, None, :])
        self.thresholds = squares[None, :] - squares[:, None]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid (ties: the smallest) and the squared distance to it."""
        best = np.zeros(len(x), np.int64)
        for lo in range(0, len(x), _BLOCK):
            part, mine = x[lo : lo + _BLOCK], best[lo : lo + _BLOCK]
            for rival in range(1, len(self.centroids)):
                side = np.einsum("ij,ij->i", self.normals[mine, rival], part)
                mine[side > self.thresholds[mine, rival]] = rival
        apart = x - self.centroids[best]
        return best, np.einsum("ij,ij->i", apart, apart)


def integer_vectors(vectors: DataFrame, id: str, vector: str, size: int, scale: int) -> DataFrame:
    """``id`` and ``x``, the integer components of the vectors that are whole."""
    x: Column = F.col(f"`{vector}`").cast("array<double>")
    sound = (F.size(x) == size) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    scaled = F.transform(F.when(sound, x), lambda v: F.floor(v * F.lit(float(scale))))
    rows = vectors.select(F.col(f"`{id}`").alias("id"), scaled.alias("x")).where(F.col("x").isNotNull())
    fits = F.forall("x", lambda v: F.abs(v) <= LIMIT)
    too_large = F.raise_error(F.lit(f"a component exceeds {LIMIT} after scaling")).cast("array<bigint>")
    return rows.select("id", F.when(fits, F.col("x")).otherwise(too_large).alias("x"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, size)


def _start(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    order = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    first = rows.select(order.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k)
    return np.array([r["x"] for r in first.collect()], np.int64)


def _sums(rows: DataFrame, tests: Bisectors, size: int) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sum of every non-empty cluster: at most ``k`` rows."""
    columns = [f"s{i}" for i in range(size)]

    def run(batches):
        k = len(tests.centroids)
        counts, sums = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), size)
            best, _ = tests.nearest(x)
            counts += np.bincount(best, minlength=k)
            order = np.argsort(best, kind="stable")
            has, at = np.unique(best[order], return_index=True)
            if len(has):
                sums[has] += np.add.reduceat(x[order], at, axis=0)
        has = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(counts[has]), *[pa.array(sums[has, i]) for i in range(size)]], ["cluster", "n", *columns])

    parts = rows.select("x").mapInArrow(run, ", ".join(f"{c} bigint" for c in ["cluster", "n", *columns]))
    whole = parts.groupBy("cluster").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ["n", *columns]])
    return {r["cluster"]: (int(r["n"]), [int(r[c]) for c in columns]) for r in whole.collect()}


def fit(rows: DataFrame, k: int, rounds: int, size: int, seed: str) -> np.ndarray:
    """The centroids after ``rounds`` rounds over ``id, x`` rows; no row gives no centroid."""
    centroids = _start(rows, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        for cluster, (n, total) in _sums(rows, Bisectors(centroids), size).items():
            centroids[cluster] = [s // n for s in total]
    return centroids


def clusters(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = 40, rounds: int = 5, size: int = 64, scale: int = 256, seed: str = "2:") -> DataFrame:
    """``id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every whole vector.

    Components become ``floor(scale * x)``. The ``k`` vectors whose ``sha256(seed + id)`` is
    smallest start; ``rounds`` times every vector goes to its nearest centroid and every
    non-empty centroid to the floor of its vectors' mean; then vectors are assigned once more.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id].dataType.simpleString()
    rows = written(integer_vectors(vectors, id, vector, size, scale), "centroids")
    centroids = fit(rows, k, rounds, size, seed)
    shape = f"`{id}` {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], shape)
    tests = Bisectors(centroids)

    def assign(batches):
        for batch in batches:
            best, distance = tests.nearest(_matrix(batch.column(1), size))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.int32()), pa.array(distance)], ["id", "cluster", "distance"])

    assigned = written(rows.mapInArrow(assign, f"id {kind}, cluster int, distance bigint"), "centroids")
    totals = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    inertia = sum(int(r["total"]) for r in totals)
    side = spark.createDataFrame([(r["cluster"], int(r["total"]), inertia, names[r["cluster"]]) for r in totals], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # one row for each centroid, at most k
    return assigned.withColumnRenamed("id", id).join(F.broadcast(side), "cluster").select(id, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def clusters_sql(k: int = 40, rounds: int = 5, size: int = 64, scale: int = 256, seed: str = "2:") -> str:
    """The same by distances to all centroids, as one DuckDB statement."""
    apart = "list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint"
    steps = [
        f"""kept as materialized (select vec_id, list_transform(embedding, lambda e: floor({scale} * e::double)::bigint) as x from embeddings
        where len(embedding) = {size} and len(list_filter(embedding, lambda e: e is not null and isfinite(e::double))) = {size})""",
        f"""c0 as materialized (select (row_number() over (order by sha256('{seed}' || vec_id) nulls last, x) - 1)::int as cluster, x as c
        from kept qualify row_number() over (order by sha256('{seed}' || vec_id) nulls last, x) <= {k})""",
    ]
    for r in range(rounds + 1):
        nearest = f"select vec_id, any_value(x) as x, min_by(cluster, d) as cluster, min(d) as distance from (select row, vec_id, x, cluster, {apart}::hugeint * {k} + cluster as d from (select row_number() over () as row, * from kept), c{r}) group by row, vec_id"
        steps.append(f"a{r} as materialized ({nearest})")
        if r < rounds:
            mean = f"""select cluster, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as m from (
            select cluster, i, sum(x[i])::hugeint as s, count(*)::hugeint as n from a{r}, range(1, {size} + 1) as t(i) group by cluster, i) group by cluster"""
            steps.append(f"c{r + 1} as materialized (select c{r}.cluster, coalesce(m, c) as c from c{r} left join ({mean}) using (cluster))")
    return f"""
    with {", ".join(steps)}
    select vec_id, cluster, (distance // {k})::bigint as distance, (sum(distance // {k}) over (partition by cluster))::bigint as cluster_inertia,
           (sum(distance // {k}) over ())::bigint as inertia, sha256(array_to_string(c, ',')) as centroid_sha256
    from a{rounds} join c{rounds} using (cluster)
    """
