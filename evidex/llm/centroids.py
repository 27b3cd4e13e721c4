"""Centroid clustering of vectors by weighted deduplication: Lloyd's rounds on distinct quantised vectors in whole numbers.

Vectors become whole numbers, equal ones one row with their number; a round sums weight times vector for each centroid inside
the tasks, and only those sums meet. Centroids, k x size numbers, pass the driver between rounds. Everything is exact, so
neither partitions nor the order of rows change a result.

Edge cases: vectors that are null, of another size, or hold null or non-finite components take no part, nor do rows without a
vec_id; nor vectors with a component beyond +-2^19, whose squared distances may not fit a long. Repeated rows are vectors of their own.
With fewer than k vectors there are fewer centroids; an empty table gives no row; further columns are ignored. An inertia that fits no long is null.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpoint, table
from .spread import looked_up

FAR = 1 << 19
SEED = 2


def quantised(embeddings: DataFrame, size: int = 64, scale: int = 256) -> DataFrame:
    """vec_id and q, floor(scale * x) of every component, of the vectors that take part."""
    fine = F.col("vec_id").isNotNull() & (F.size("embedding") == size) & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) <= FAR))  # not so for NaN, which is above all
    q = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int"))
    return embeddings.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), q.alias("q"))


def first_centroids(kept: DataFrame, k: int, seed: int = SEED) -> np.ndarray:
    """The k vectors whose `seed:vec_id` has the smallest SHA-256, in that order; ties by vector."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return np.array([r["q"] for r in kept.select(h.alias("h"), "q").orderBy("h", "q").limit(k).collect()], dtype=np.int64)


def _nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row, the smaller number where two are equally near, and the squared distance; exact."""
    top = max(int(np.abs(q).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    kind = np.float64 if 4 * q.shape[1] * top * top < 1 << 53 else np.int64  # every partial sum is a whole number that the type holds
    a, c = q.astype(kind), centroids.astype(kind)
    if kind is np.float64:
        d = (a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)
    else:
        d = np.stack([((a - one) ** 2).sum(1) for one in c], 1)
    at = d.argmin(1)
    return at, d[np.arange(len(d)), at].astype(np.int64)


def _rows(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("q").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: componentwise floor of the weighted mean, unchanged where no vector is nearest.

    A task sends one row for each of its centroids: the weight and the weighted sums, in 32-bit halves of weight so that no product
    overflows; the sums of tasks are exact decimals.
    """
    k, size = centroids.shape

    def run(batches):
        n, sums = [0] * k, [[0] * size for _ in range(k)]
        for b in batches:
            q, w = _rows(b, size), b.column("n").to_numpy(zero_copy_only=False)
            at, _ = _nearest(q, centroids)
            for c in np.unique(at):
                mine, wc = q[at == c].astype(np.int64), w[at == c]
                low, high = mine.T @ (wc & 0xFFFF), mine.T @ (wc >> 16)  # under 2^27 * 2^16 * rows of a batch
                n[c] += int(wc.sum())
                sums[c] = [s + int(x) + (int(y) << 16) for s, x, y in zip(sums[c], low, high, strict=True)]
        got = [c for c in range(k) if n[c]]
        yield pa.RecordBatch.from_arrays([pa.array(got, pa.int32()), pa.array([n[c] for c in got], pa.int64()), pa.array([[str(s) for s in sums[c]] for c in got], pa.list_(pa.string()))], ["cluster", "n", "sums"])

    parts = bounded_batches(distinct).mapInArrow(run, "cluster int, n long, sums array<string>")
    total = parts.select("cluster", "n", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = centroids.copy()
    for r in total.collect():  # k x size rows
        out[r["cluster"], r["i"]] = int(r["s"]) // r["n"]
    return out


def assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """distinct with cluster and distance."""
    size = centroids.shape[1]

    def run(batches):
        for b in batches:
            at, d = _nearest(_rows(b, size), centroids)
            yield pa.RecordBatch.from_arrays([b.column("q"), b.column("n"), pa.array(at.astype(np.int32)), pa.array(d)], ["q", "n", "cluster", "distance"])

    return bounded_batches(distinct).mapInArrow(run, "q array<int>, n long, cluster int, distance long")


def clusters(embeddings: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, scale: int = 256, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every vector that takes part, and the final centroids."""
    kept = checkpoint(quantised(embeddings, size, scale))
    start = first_centroids(kept, k, seed)
    if not len(start):
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), start.reshape(0, size)
    distinct = checkpoint(kept.groupBy("q").agg(F.count("*").alias("n")))
    centroids = reduce(lambda c, _: _moved(distinct, c), range(rounds), start)
    # a vector with very many copies is a hot key on the way back
    back = looked_up(kept, checkpoint(assigned(distinct, centroids)), ["q"], "n")
    return back.select("vec_id", "cluster", "distance"), centroids


def op13(spark, sf_dir: str) -> DataFrame:
    rows, centroids = clusters(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    rows = checkpoint(rows)
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()}  # at most k
    every = sum(sums.values()) if None not in sums.values() else None
    about = [(i, sums.get(i), every if every is not None and every < 1 << 63 else None, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    digests = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(digests), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 40, rounds: int = 5) -> str:
    steps = [f"c0 AS (SELECT (row_number() OVER (ORDER BY h, q) - 1)::INTEGER AS cluster, q AS c FROM (SELECT sha256('{SEED}:' || vec_id) AS h, q FROM e ORDER BY h, q LIMIT {k}))"]
    far = "list_sum(list_transform(list_zip(q, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, vec_id, q, min({{'d': d, 'cluster': cluster}}) AS m FROM (SELECT r, vec_id, q, cluster, {far} AS d FROM e, c{i}) GROUP BY r, vec_id, q)")
        if i < rounds:
            mean = f"SELECT cluster, list(v ORDER BY i) AS c FROM (SELECT m.cluster AS cluster, i, floor_div(sum(q[i])::BIGINT, count(*)) AS v FROM a{i}, range(1, 65) t(i) GROUP BY m.cluster, i) GROUP BY cluster"
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(n.c, o.c) AS c FROM c{i} o LEFT JOIN ({mean}) n ON n.cluster = o.cluster)")
    body = ", ".join(steps).replace("floor_div(sum(q[i])::BIGINT, count(*))", "((sum(q[i])::BIGINT - ((sum(q[i])::BIGINT % count(*)) + count(*)) % count(*)) // count(*))::BIGINT")
    return f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x) > {FAR})) = 0), {body}
SELECT a.vec_id, a.m.cluster AS cluster, a.m.d AS distance, sum(a.m.d) OVER (PARTITION BY a.m.cluster)::BIGINT AS cluster_inertia, sum(a.m.d) OVER ()::BIGINT AS inertia, sha256(list_aggregate(f.c, 'string_agg', ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} f ON f.cluster = a.m.cluster
"""


OP13_SQL = _sql()
