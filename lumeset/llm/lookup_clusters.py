"""Centroid clustering of integer vectors by scalar lookup tables.

Vectors are stored once in chunks: for each dimension the integer values that occur in the chunk, and for each vector the number of its value.
A round tabulates, for each dimension, occurring value and centroid, the squared difference; the distances of a chunk are then gathers from these
tables, added up over the dimensions. No vector is multiplied or subtracted again. Only the centroids, and their sums and counts, meet on the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumeset.llm.common import integer_vectors, materialise

CLUSTERS, ROUNDS, DIMS = 40, 5, 64
CHUNK = 4096  # vectors of a chunk at most
MOST = (1 << 63) - 1
CHUNK_SCHEMA = "ids binary, none binary, codes binary, values binary, starts binary"
SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row and dimension the number of its value, the values of all dimensions one after another, and where each dimension's begin."""
    codes, values, starts = np.empty(x.shape, np.uint16), [], [0]
    for d in range(x.shape[1]):
        v, codes[:, d] = np.unique(x[:, d], return_inverse=True)
        values.append(v)
        starts.append(starts[-1] + len(v))
    return codes, np.concatenate(values) if values else np.zeros(0, np.int64), np.array(starts, np.int64)


def distances(codes: np.ndarray, values: np.ndarray, starts: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distance of each row to each centroid: tables of scalars, gathered and summed."""
    total = np.zeros((len(codes), len(centroids)), np.int64)
    part = np.empty_like(total)
    for d in range(codes.shape[1]):
        table = (values[starts[d] : starts[d + 1], None] - centroids[None, :, d]) ** 2
        np.take(table, codes[:, d], axis=0, out=part)
        total += part
    return total


def chunks_of(vectors: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """vectors (vec_id, vec) in chunks of CHUNK_SCHEMA."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), chunk):
                f = b.iloc[s : s + chunk]
                none = f["vec_id"].isna().to_numpy()
                ids = f["vec_id"].fillna(0).to_numpy(np.int64)
                each = coded(np.stack(f["vec"].to_numpy()).astype(np.int64))
                yield pd.DataFrame({c: [x.tobytes()] for c, x in zip(("ids", "none", "codes", "values", "starts"), (ids, none, *each), strict=True)})

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "vec").mapInPandas(run, CHUNK_SCHEMA)


def opened(r) -> tuple[np.ndarray, ...]:
    """ids, none, codes, values, starts of a chunk."""
    ids = np.frombuffer(r.ids, np.int64)
    return ids, np.frombuffer(r.none, bool), np.frombuffer(r.codes, np.uint16).reshape(len(ids), -1), np.frombuffer(r.values, np.int64), np.frombuffer(r.starts, np.int64)


def sums(chunks: DataFrame, centroids: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
    """Count and sum by cluster and dimension, of the vectors nearest to each centroid; clusters without vectors are not in it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for b in batches:
            for r in b.itertuples(index=False):
                _, _, codes, values, starts = opened(r)
                nearest = distances(codes, values, starts, centroids).argmin(1)
                count += np.bincount(nearest, minlength=len(centroids))
                for d in range(codes.shape[1]):
                    np.add.at(total[:, d], nearest, values[starts[d] + codes[:, d].astype(np.int64)])
        used = np.flatnonzero(count)
        yield pd.DataFrame({"cluster": used.astype(np.int32), "n": count[used], "sums": list(total[used])})

    each = chunks.mapInPandas(run, "cluster int, n long, sums array<long>").select("cluster", "n", F.posexplode("sums").alias("d", "s"))
    found = each.groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(20,0)")).alias("s"))
    return {(r["cluster"], r["d"]): (r["n"], int(r["s"])) for r in found.collect()}  # clusters times dimensions


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: str = "2:", chunk: int = CHUNK) -> DataFrame:
    """SCHEMA, a row for each row of vectors (vec_id; vec, integers of one dimension; other columns are ignored).

    Centroids start as the vectors with the smallest hex SHA-256 of seed and vec_id; rows of one id follow each other by their components, rows without an id
    come last. Each round assigns every vector to the nearest centroid (the smaller number of several) and replaces every centroid that has vectors by the
    floor of their mean; a last assignment gives the result. Repeated rows count each time. With fewer vectors than clusters there are as many centroids as
    vectors; without any the result is empty. An inertia over the largest long is given as that.
    """
    spark = vectors.sparkSession
    first = vectors.select("vec", F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256).alias("h")).orderBy(F.asc_nulls_last("h"), "vec").limit(clusters).collect()  # that many rows
    if not first:
        return spark.createDataFrame([], SCHEMA)
    centroids = np.array([r["vec"] for r in first], np.int64)
    chunks = materialise(chunks_of(vectors, chunk), "chunks")
    for _ in range(rounds):
        centroids = centroids.copy()
        for (c, d), (n, s) in sums(chunks, centroids).items():
            centroids[c, d] = s // n

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                ids, none, *rest = opened(r)
                far = distances(*rest, centroids)
                nearest = far.argmin(1)
                yield pd.DataFrame({"vec_id": pd.arrays.IntegerArray(ids.copy(), none.copy()), "cluster": nearest.astype(np.int32), "distance": far[np.arange(len(far)), nearest]})

    assigned = materialise(chunks.mapInPandas(assign, "vec_id long, cluster int, distance long"), "assigned")
    inertia = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}  # a row a cluster
    whole = min(MOST, sum(inertia.values()))
    names = [(c, min(MOST, s), whole, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in inertia.items()]
    table = spark.createDataFrame(names, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster").select(*(c.split()[0] for c in SCHEMA.split(", ")))  # a row a cluster


def op13_lookup_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 clusters of all vectors of 64 components."""
    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(F.size("embedding") == DIMS), "vec_id")
    return cluster(vectors)


def oracle_sql() -> str:
    far = "list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor({256} * x::DOUBLE)::BIGINT) AS e FROM embeddings
WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, e) - 1 AS c, e FROM v QUALIFY c < {CLUSTERS})"""]
    for r in range(ROUNDS + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT v.i, arg_min(c.c, {{'far': {far}, 'c': c.c}}) AS c, min({far}) AS far FROM v, c{r} c GROUP BY v.i)")
        if r < ROUNDS:
            parts.append(f"""m{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY d) AS e FROM (SELECT c, d, sum(e[d]) AS s, count(*) AS n FROM (SELECT a.c, v.e, unnest(range(1, {DIMS + 1})) AS d FROM a{r} a JOIN v USING (i)) GROUP BY c, d) GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.e, o.e) AS e FROM c{r} o LEFT JOIN m{r} m USING (c))""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, a.c::INT AS cluster, far::BIGINT AS distance, (sum(far) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(far) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN v USING (i) JOIN c{ROUNDS} c ON c.c = a.c"""


ORACLE_SQL = oracle_sql()
