"""Centroid clustering in exact integers with partial-distance search.

The dimensions are ordered by their variance over all vectors, greatest first. A vector is held against one centroid after the other:
squared differences are summed over a few dimensions at a time, and the centroid is abandoned once the sum is strictly above the best
whole distance so far; survivors finish all dimensions. Many vectors are searched abreast in numpy; Spark moves one row of
sums for each task and cluster, and the driver sees only the centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import saved
from .text import slices

DIMENSIONS = 64
#: Components are scaled by this factor and floored.
SCALE = 1024
#: Dimensions that are summed between two looks at the best distance.
STRIDE = 8
#: Vectors that are searched abreast.
ABREAST = 8192
#: Below this magnitude all sums of squares of a vector fit in 64 bits; above it numpy computes with Python integers.
SMALL = 1 << 27
#: Scaled components are bounded to this magnitude, so that sums over 2^36 vectors fit in a decimal of 38 digits.
LARGEST = 1 << 90
LONG_MAX = (1 << 63) - 1


def scaled(values: np.ndarray, wide: bool) -> np.ndarray:
    """floor(SCALE * x) of each component: 64-bit integers, or Python integers bounded to LARGEST if ``wide``."""
    floors = np.floor(values * SCALE)
    if not wide:
        return floors.astype(np.int64)
    return np.array([max(-LARGEST, min(LARGEST, int(x))) for x in np.clip(floors, -1e300, 1e300).ravel()], object).reshape(floors.shape)


def nearest(vectors: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each vector (ties: the smaller number) and its squared distance, by partial-distance search."""
    steps = [order[k : k + STRIDE] for k in range(0, len(order), STRIDE)]
    best = np.zeros(len(vectors), np.int32)
    least = ((vectors - centroids[0]) ** 2).sum(axis=1)
    for c in range(1, len(centroids)):
        alive = np.arange(len(vectors))
        sums = np.zeros(len(vectors), vectors.dtype)
        for dims in steps:
            sums = sums + ((vectors[np.ix_(alive, dims)] - centroids[c][dims]) ** 2).sum(axis=1)
            going = sums <= least[alive]
            alive, sums = alive[going], sums[going]
            if not len(alive):
                break
        nearer = sums < least[alive]  # an equal one of a smaller number stays
        best[alive[nearer]] = c
        least[alive[nearer]] = sums[nearer]
    return best, least


def matrix(column: pa.Array, wide: bool) -> np.ndarray:
    """Vectors of a list column as rows of scaled integers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return scaled(flat.reshape(len(column), DIMENSIONS), wide)


def usable(vector: Column) -> Column:
    """Exactly DIMENSIONS components, none null or non-finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == DIMENSIONS) & finite, F.lit(False))


def kept_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and vector (array of double) of the rows that are clustered."""
    rows = embeddings.select(embeddings["vec_id"].alias("vec_id"), embeddings["embedding"].cast("array<double>").alias("vector"))
    return rows.filter(usable(F.col("vector")))


def seeds(kept: DataFrame, k: int, seed: int, wide: bool) -> np.ndarray:
    """The ``k`` vectors of least sha256 of ``seed:vec_id``, in that order; rows of one id by their components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(key.alias("key"), "vector").orderBy("key", "vector").limit(k).collect()
    return scaled(np.array([r["vector"] for r in rows], float).reshape(len(rows), DIMENSIONS), wide)


def sums_of_clusters(kept: DataFrame, centroids: np.ndarray, order: np.ndarray, wide: bool) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sums of each non-empty cluster: each task gives a row a cluster, Spark adds them up exactly."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for batch in slices(batches, ABREAST):
            vectors = matrix(batch.column(0), wide)
            best, _ = nearest(vectors, centroids, order)
            for c in np.unique(best):
                mine = vectors[best == c]
                count, sums = totals.get(int(c), (0, [0] * DIMENSIONS))
                totals[int(c)] = (count + len(mine), [a + int(b) for a, b in zip(sums, mine.sum(axis=0))])
        for c, (count, sums) in totals.items():
            yield pa.RecordBatch.from_pydict({"cluster": pa.array([c], pa.int32()), "n": pa.array([count], pa.int64()), "sums": pa.array([[str(x) for x in sums]], pa.list_(pa.string()))})

    parts = kept.select("vector").mapInArrow(partial, "cluster int, n long, sums array<string>")
    summed = parts.select("cluster", "n", F.posexplode("sums").alias("dimension", "part")).groupBy("cluster", "dimension").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    found: dict[int, tuple[int, list[int]]] = {}
    for r in summed.collect():  # at most one row a centroid and dimension
        found.setdefault(r["cluster"], (r["n"], [0] * DIMENSIONS))[1][r["dimension"]] = int(r["total"])
    return found


def moved(centroids: np.ndarray, sums: dict[int, tuple[int, list[int]]]) -> np.ndarray:
    """Each non-empty centroid replaced by the floored mean of its vectors."""
    out = centroids.copy()
    for c, (n, totals) in sums.items():
        out[c] = [total // n for total in totals]
    return out


def dimension_order(kept: DataFrame) -> tuple[np.ndarray, bool]:
    """Dimensions by variance, greatest first, and whether any scaled component is too large for 64-bit sums of squares."""
    spread = [F.var_pop(F.get("vector", F.lit(d))).alias(f"v{d}") for d in range(DIMENSIONS)]
    row = kept.agg(*spread, F.max(F.array_max(F.transform("vector", F.abs))).alias("most")).first()
    variances = np.nan_to_num(np.array([row[d] or 0.0 for d in range(DIMENSIONS)]))
    return np.argsort(-variances, kind="stable"), (row["most"] or 0.0) * SCALE >= SMALL - 1


def assigned(kept: DataFrame, centroids: np.ndarray, order: np.ndarray, wide: bool) -> DataFrame:
    """vec_id, cluster and distance of each vector; distances beyond a long count as its greatest value."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ABREAST):
            best, least = nearest(matrix(batch.column(1), wide), centroids, order)
            distances = pa.array([min(int(x), LONG_MAX) for x in least], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.int32()), distances], names=["vec_id", "cluster", "distance"])

    return kept.select("vec_id", "vector").mapInArrow(rows, f"vec_id {dict(kept.dtypes)['vec_id']}, cluster int, distance long")


def bounded_sum(distance: str) -> Column:
    """Sum of distances, at most the greatest long."""
    return F.least(F.sum(F.col(distance).cast("decimal(38,0)")), F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long")


def cluster(embeddings: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector of exactly 64 finite components.

    Other rows (null vectors too) are left out. Rows that repeat stay repeated and count each time; a null vec_id is kept and its seed key has an
    empty number. With fewer than ``k`` vectors there are as many centroids; without any there are no rows. A centroid that
    loses all vectors stays where it is. Scaled components beyond 2^90 in magnitude count as 2^90; a distance or inertia beyond a
    long counts as the greatest long. Columns of other names are not read.
    """
    kept = kept_vectors(embeddings)
    order, wide = dimension_order(kept)
    centroids = seeds(kept, k, seed, wide)
    if not len(centroids):
        kinds = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}
        return kept.select("vec_id", *[F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()])
    for _ in range(rounds):
        centroids = moved(centroids, sums_of_clusters(kept, centroids, order, wide))
    told = saved(assigned(kept, centroids, order, wide), "centroids")
    digests = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in centroids]
    by_cluster = told.groupBy("cluster").agg(bounded_sum("distance").alias("cluster_inertia"))  # at most k rows
    total = told.agg(bounded_sum("distance").alias("inertia"))
    named = by_cluster.withColumn("centroid_sha256", F.get(F.array(*map(F.lit, digests)), F.col("cluster")))
    return told.join(F.broadcast(named.join(F.broadcast(total))), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all embeddings after ten rounds."""
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql(k: int = 8, rounds: int = 10, seed: int = 3) -> str:
    """The same in SQL, one round after the other."""
    tie = "row_number() OVER (PARTITION BY row ORDER BY d, c) AS place"
    distance = "list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    parts = [
        f"""x AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS v FROM embeddings
WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM x ORDER BY h LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT row, c, d FROM (SELECT row, c, d, {tie} FROM (SELECT x.row, c.c, {distance} AS d FROM x, c{r} c)) WHERE place = 1)")
        if r < rounds:
            parts.append(f"s{r} AS (SELECT c, i, sum(v) AS s, count(*) AS n FROM (SELECT a{r}.c, unnest(x.v) AS v, unnest(range({DIMENSIONS})) AS i FROM a{r} JOIN x USING (row)) GROUP BY 1, 2)")
            parts.append(f"m{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM s{r} GROUP BY 1)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{r} o LEFT JOIN m{r} m USING (c))")
    return f"""WITH {", ".join(parts)} SELECT x.vec_id, a.c::INT AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN x USING (row) JOIN c{rounds} c ON c.c = a.c"""


OP11_SQL = _sql()
