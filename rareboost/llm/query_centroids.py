"""Query op11 and its SQL, with the rounds unrolled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rareboost.llm.centroids import cluster, digest, per_cluster
from rareboost.llm.registry import query, table


def _assign(rows: str, centroids: str) -> str:
    gap = f"list_sum([({rows}.v[i] - {centroids}.v[i]) * ({rows}.v[i] - {centroids}.v[i]) for i in range(1, 65)])::BIGINT"
    return (
        f"SELECT vec_id, {rows}.v AS v, c, {gap} AS d FROM {rows}, {centroids}"
        f" QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1"
    )


def _sql(rounds: int = 10) -> str:
    steps = [
        "k AS MATERIALIZED (SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings"
        " WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = 64)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR)) - 1 AS c, v FROM k"
        " ORDER BY sha256('3:' || vec_id::VARCHAR) LIMIT 8)",
    ]
    for r in range(rounds):
        steps += [
            f"a{r} AS MATERIALIZED ({_assign('k', f'c{r}')})",
            f"m{r} AS (SELECT c, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, 65) AS t(i) GROUP BY c, i)",
            f"c{r + 1} AS MATERIALIZED (SELECT c{r}.c AS c, coalesce(w.v, c{r}.v) AS v FROM c{r} LEFT JOIN"
            f" (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM m{r} GROUP BY c) AS w ON w.c = c{r}.c)",
        ]
    steps.append(f"z AS MATERIALIZED ({_assign('k', f'c{rounds}')})")
    return (
        f"WITH {', '.join(steps)} SELECT vec_id, z.c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY z.c)::BIGINT AS cluster_inertia,"
        f" sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256 FROM z JOIN c{rounds} ON c{rounds}.c = z.c"
    )


@query("op11_cluster_ptolemaic", _sql())
def op11_cluster_ptolemaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector, with the distances of its cluster and of all summed."""
    found = cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    if not found.inertia:
        return found.rows.select("*", *[F.lit(0).cast("long").alias(n) for n in ("cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    return found.rows.select(
        "*",
        per_cluster(found.inertia).cast("long").alias("cluster_inertia"),
        F.lit(sum(found.inertia)).cast("long").alias("inertia"),
        per_cluster([digest(c) for c in found.centroids]).alias("centroid_sha256"),
    )
