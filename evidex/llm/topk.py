"""Exact top-k inner-product search by term-at-a-time accumulation over blocks.

Rows are dealt evenly to cells, as many as the data's size asks for; a cell's rows are blocks of bounded size.
Every query block goes to every cell once, so no table is broadcast; a task holds its cell's rows and one query
block at a time. For each row block the posting lists are built once: of each term (vector component) the rows where
its weight isn't 0. A query's weight times the postings is scattered into the query's dense score array. Each
pair of blocks gives its k best rows of each query; a window merges them.

Edge cases: null vectors and vectors with null or non-finite components take no part, neither as queries
nor as candidates; a vector of other length counts as padded with zeros; a null vec_id takes no part; rows with a query's
vec_id are all its own and no candidates; a query that is repeated is asked once (its smallest vector);
ties go to the smaller vec_id; an empty table gives no rows; further columns are ignored. Scores are
64-bit integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import input_bytes, shuffle_parts

SCALE, QUERY_EVERY, K, CELL_BYTES = 1024, 100, 10, 16 << 20


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and v, floor(SCALE * x) of every component, of the rows that take part."""
    x = F.transform(F.col("embedding"), lambda e: e.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where("vec_id IS NOT NULL AND x IS NOT NULL")
    fine = F.forall("x", lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False)))
    return rows.where(fine).select("vec_id", F.transform("x", lambda e: F.floor(e * SCALE).cast("long")).alias("v"))


def _dense(lists: pa.Array) -> np.ndarray:
    arr = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    off = arr.offsets.to_numpy().astype(np.int64)
    val = arr.values.to_numpy(zero_copy_only=False)
    n, width = np.diff(off), int(max(np.diff(off), default=0))
    if len(n) and (n == width).all():
        return val[off[0] : off[-1]].reshape(len(n), width)
    out = np.zeros((len(n), width), np.int64)
    for i in range(len(n)):
        out[i, : n[i]] = val[off[i] : off[i + 1]]
    return out


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """One row per block: cell (number of the partition), ids (int64 bytes), w (int64 bytes, row by row), width."""

    def pack(batches):
        cell = TaskContext.get().partitionId()
        held: list = []
        n = 0

        def flush():
            ids = np.concatenate([a for a, _ in held])
            width = max(m.shape[1] for _, m in held)
            mat = np.zeros((len(ids), width), np.int64)
            at = 0
            for a, m in held:
                mat[at : at + len(a), : m.shape[1]] = m
                at += len(a)
            for s in range(0, len(ids), size):
                a, m = ids[s : s + size], mat[s : s + size]
                yield pa.RecordBatch.from_pydict({"cell": pa.array([cell], pa.int32()), "ids": pa.array([a.tobytes()], pa.binary()), "w": pa.array([np.ascontiguousarray(m).tobytes()], pa.binary()), "width": pa.array([width], pa.int32())})

        for b in batches:
            if b.num_rows:
                held.append((b.column("vec_id").to_numpy().astype(np.int64), _dense(b.column("v"))))
                n += b.num_rows
                if n >= size:
                    yield from flush()
                    held, n = [], 0
        if held:
            yield from flush()

    return rows.mapInArrow(pack, "cell int, ids binary, w binary, width int")


def postings(w: np.ndarray) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """Of every term, the rows of w with a weight and their weights; None for the rows if all have one."""
    out = []
    for t in range(w.shape[1]):
        post = np.flatnonzero(w[:, t])
        out.append((None, np.ascontiguousarray(w[:, t])) if len(post) == len(w) else (post, w[post, t]))
    return out


def accumulate(q: np.ndarray, lists: list[tuple[np.ndarray | None, np.ndarray]], n: int) -> np.ndarray:
    """Scores of queries (rows of q) against n rows with these postings, term by term."""
    scores = np.zeros((len(q), n), np.int64)
    for t, (post, weights) in enumerate(lists[: q.shape[1]]):
        if not len(weights):
            continue
        for i in np.flatnonzero(q[:, t]):
            if post is None:
                scores[i] += q[i, t] * weights
            else:
                scores[i, post] += q[i, t] * weights
    return scores


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k best of one score array, ties to the smaller id."""
    ok = ids != own
    s, i = scores[ok], ids[ok]
    if len(s) > k:
        keep = s >= np.partition(s, len(s) - k)[len(s) - k]
        s, i = s[keep], i[keep]
    o = np.lexsort((i, -s))[:k]
    return i[o], s[o]


def search(queries: DataFrame, rows: DataFrame, k: int = K, query_block: int = 4096, row_block: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows of every query; both sides as quantised() gives them."""
    q = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    parts = shuffle_parts(rows, CELL_BYTES)
    qb = blocks(q.repartition(max(1, min(parts, -(-input_bytes(queries) // (query_block * 512)))), "vec_id"), query_block)
    asked = qb.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("cell"), F.lit(1).alias("asks"), "ids", "w", "width")
    rb = blocks(rows.repartition(parts, "vec_id"), row_block).select("cell", F.lit(0).alias("asks"), "ids", "w", "width")
    dealt = rb.unionByName(asked).repartitionById(parts, F.col("cell")).sortWithinPartitions("asks")

    def score(batches):
        held: list = []
        for b in batches:
            for x in b.to_pylist():
                ids = np.frombuffer(x["ids"], np.int64)
                weights = np.frombuffer(x["w"], np.int64).reshape(len(ids), x["width"])
                if not x["asks"]:
                    held.append((ids, postings(np.asfortranarray(weights))))
                    continue
                for ri, lists in held:
                    out: list = [[], [], []]
                    for s in range(0, len(ids), 32):
                        sc = accumulate(weights[s : s + 32], lists, len(ri))
                        for j, own in enumerate(ids[s : s + 32]):
                            a, v = best(sc[j], ri, own, k)
                            out[0].append(np.full(len(a), own))
                            out[1].append(a)
                            out[2].append(v)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], ["query_id", "vec_id", "score"])

    top = dealt.mapInArrow(score, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return top.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1(spark, sf_dir: str) -> DataFrame:
    from .common import table

    rows = quantised(table(spark, sf_dir, "embeddings"))
    return search(rows.where(F.col("vec_id") % QUERY_EVERY == 0), rows)


OP1_SQL = """
WITH r AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, 1 + least(len(q.v), len(c.v))), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM r q JOIN r c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 10
"""
