"""Centroid clustering of integer vectors in JVM expressions alone.

Centroids are literal arrays in the plan. The distance of a vector to each comes from zip_with and
aggregate over integers, array_min over structs (distance, number) chooses the cluster, and column
sums over the chosen clusters give the next centroids. Between rounds only sums go to the driver: one
row per cluster, whatever the number of vectors.

Squared distance is |q|^2 + |c|^2 - 2 q.c, so one product per component is left to the inner loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import load, query, staged

DIM = 64
SCALE = 256
CLUSTERS = 40
ROUNDS = 5
SEED = 2
# Components are held within this bound, so that squares and distances fit in a long.
BOUND = 1 << 26
LONG = (1 << 63) - 1
# Vectors of one task; a round costs about a quarter of a millisecond for each.
TASK_ROWS = 1 << 18


def points(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """Rows of (id, q, qq): integer components and the sum of their squares, for usable vectors."""
    # x is NULL or NaN or infinite: the comparison is then null or false.
    usable = F.forall("_cent_v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    whole = F.transform("_cent_v", lambda x: F.least(F.greatest(F.floor(x * scale), F.lit(-BOUND)), F.lit(BOUND)).cast("long"))
    square = F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x * x)
    return (
        vectors.select(id_col, F.col(vector_col).cast("array<double>").alias("_cent_v"))
        .filter((F.size("_cent_v") == dim) & usable)
        .select(id_col, whole.alias("q"))
        .withColumn("qq", square)
    )


def _literal(values: list[int]) -> str:
    return f"array({', '.join(f'{v}L' for v in values)})"


def nearest(centroids: list[list[int]]) -> Column:
    """Struct (distance, cluster) of the nearest centroid of (q, qq); ties go to the smaller number."""
    table = ", ".join(f"named_struct('c', {_literal(c)}, 'cc', {sum(x * x for x in c)}L)" for c in centroids)
    product = "aggregate(zip_with(q, m.c, (x, y) -> x * y), 0L, (s, x) -> s + x)"
    return F.expr(f"array_min(transform(array({table}), (m, i) -> named_struct('distance', qq + m.cc - 2L * {product}, 'cluster', i)))")


def first_centroids(table: DataFrame, k: int, seed: int, id_col: str) -> list[list[int]]:
    """Components of the k vectors whose ids hash lowest; ties by components, null ids last."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)
    return [list(r.q) for r in table.select(mark.alias("h"), "q").orderBy(F.asc_nulls_last("h"), "q").limit(k).collect()]


def updated(centroids: list[list[int]], table: DataFrame, dim: int) -> list[list[int]]:
    """Centroids after one round: exact floors of the means, empty clusters as they were."""
    sums = table.select("q", nearest(centroids).alias("best")).groupBy(F.col("best.cluster").alias("cluster"))
    found = sums.agg(F.count("*").alias("n"), *[F.sum(F.col("q")[d]).alias(f"s{d}") for d in range(dim)]).collect()
    out = list(centroids)
    for r in found:
        out[r.cluster] = [r[f"s{d}"] // r.n for d in range(dim)]
    return out


def cluster(
    vectors: DataFrame,
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    dim: int = DIM,
    scale: int = SCALE,
    seed: int = SEED,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Rows of (id, cluster, distance, cluster_inertia, inertia, centroid), one per usable vector.

    Vectors of exactly dim components, none null or non-finite, become integers floor(scale * x). The
    first centroids are the k vectors whose `seed:id` has the smallest SHA-256, ties by components; with fewer vectors there
    are fewer clusters. Each round assigns every vector to the nearest centroid (squared distance,
    ties to the smaller number) and replaces it by the floor of the mean; empty clusters keep theirs.
    Rows that repeat an id, or a vector, count as often as they occur; a row with a null id is
    clustered like others and is a first centroid only if ids run short. Integers beyond BOUND are held
    to it and an inertia beyond a long is the largest long. Other columns are not read; a table
    without usable vectors gives an empty table.
    """
    table = points(vectors, id_col, vector_col, dim, scale)
    # Work goes with vectors, not bytes: as many tasks as there are cores, more for larger tables.
    cores = table.sparkSession.sparkContext.defaultParallelism
    rows = vectors.count()
    table = staged(table.repartition(max(2 * cores, -(-rows // TASK_ROWS))), "centroids-points")
    centroids = first_centroids(table, k, seed, id_col)
    if not centroids:
        # No rows: any centroid gives the right columns.
        centroids, rounds = [[0] * dim], 0
    for _ in range(rounds):
        centroids = updated(centroids, table, dim)
    best = staged(table.select(id_col, nearest(centroids).alias("_best")).select(id_col, "_best.cluster", "_best.distance"), "centroids-best")
    # One row per cluster.
    sums = {r.cluster: int(r.s) for r in best.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    held = [min(sums.get(c, 0), LONG) for c in range(len(centroids))]
    number = F.col("cluster") + 1
    return best.select(
        id_col,
        "cluster",
        "distance",
        F.element_at(F.expr(_literal(held)), number).alias("cluster_inertia"),
        F.lit(min(sum(sums.values()), LONG)).cast("long").alias("inertia"),
        F.element_at(F.expr(f"array({', '.join(map(_literal, centroids))})"), number).alias("centroid"),
    )


def _sql() -> str:
    """The same in SQL: one table of centroids per round."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(
            f"""near{r} AS MATERIALIZED (
    SELECT vec_id, rid, q, (best).cluster AS cluster, (best).distance AS distance FROM (
        SELECT p.vec_id, p.rid, p.q, min(struct_pack(
            distance := list_sum(list_transform(list_zip(p.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, cluster := c.cluster)) AS best
        FROM points p, cent{r} c GROUP BY p.vec_id, p.rid, p.q
    )
)"""
        )
        if r < ROUNDS:
            steps.append(
                f"""cent{r + 1} AS MATERIALIZED (
    SELECT c.cluster, coalesce(m.q, c.q) AS q FROM cent{r} c LEFT JOIN (
        SELECT cluster, list(v ORDER BY i) AS q FROM (
            SELECT cluster, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS v
            FROM (SELECT cluster, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM near{r}) GROUP BY cluster, i
        ) GROUP BY cluster
    ) m USING (cluster)
)"""
            )
    return f"""
WITH points AS MATERIALIZED (
    SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
    WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}
), cent0 AS MATERIALIZED (
    SELECT (row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), q) - 1)::INTEGER AS cluster, q FROM points
    ORDER BY cluster LIMIT {CLUSTERS}
), {", ".join(steps)}
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
    sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM near{ROUNDS} JOIN cent{ROUNDS} c USING (cluster)
"""


@query("op13_centroids", _sql())
def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster(load(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    text = F.array_join(F.col("centroid").cast("array<string>"), ",")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(text, 256).alias("centroid_sha256"))
