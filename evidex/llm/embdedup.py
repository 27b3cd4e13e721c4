"""Embedding near-duplicates by product quantisation.

An inverted file with residual codes, a list for every PER_LIST vectors up to MAX_LISTS, is fitted on a bounded sample (8 vectors
a list, LEAST_SAMPLE to SAMPLE, of smallest hash); every
vector is indexed in its nearest list and looks into its PROBES nearest lists. A cell is one block of a
list's residents and one block of its visitors, so a list with a third of all vectors is dealt over many
tasks. In a cell, asymmetric table lookups give each visitor's distance to every resident's code; with the
code's own error added the test loses no pair of the cell, and what passes is compared by exact cosine in
double precision. Cells return numbers of links and a spanning forest, never lists of pairs.

Edge cases: null, zero and non-finite vectors link with nothing and are kept; vectors of other length
count as padded with zeros; equal vectors are one class (rows with the same id and vector are one), linked
among themselves; ties are links (>=); an empty table gives no rows; a null vec_id keeps its row, with
component null; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint
from .graph import connected_components

COSINE, PROBES, PER_LIST, MAX_LISTS, SAMPLE, LEAST_SAMPLE = 0.9, 12, 256, 16384, 131072, 16384
SUBSPACES, CODES = 16, 256
RESIDENTS, VISITORS = 2048, 8192


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's k-means; empty clusters are put on random points."""
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = np.concatenate([_nearest(x[s : s + 4096], c, 1)[:, 0] for s in range(0, len(x), 4096)])
        n = np.bincount(own, minlength=len(c))
        new = np.stack([np.bincount(own, x[:, d], len(c)) for d in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, new / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), len(c))])
    return c


def _nearest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    d = (c * c).sum(1)[None, :] - 2 * (x @ c.T)
    if k == 1:
        return d.argmin(1)[:, None]
    k = min(k, len(c))
    part = np.argpartition(d, k - 1, 1)[:, :k] if k < len(c) else np.tile(np.arange(k), (len(x), 1))
    return np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), 1, kind="stable"), 1)


class Index:
    """Coarse centroids and residual codebooks; small (lists x dimensions and codebooks), so it travels with the tasks."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        self.sub = -(-self.dim // SUBSPACES)
        self.coarse = _means(sample, min(lists, len(sample)), 8, rng)
        rest = self._split(sample - self.coarse[_nearest(sample, self.coarse, 1)[:, 0]])
        self.books = [_means(rest[:, m], min(CODES, len(rest)), 6, rng) for m in range(SUBSPACES)]

    def _split(self, r: np.ndarray) -> np.ndarray:
        out = np.zeros((len(r), SUBSPACES * self.sub))
        out[:, : self.dim] = r
        return out.reshape(len(r), SUBSPACES, self.sub)

    def encode(self, unit: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest lists (first: own), codes, and the distance of each vector to its code."""
        near = _nearest(unit, self.coarse, probes)
        rest = self._split(unit - self.coarse[near[:, 0]])
        codes = np.stack([_nearest(rest[:, m], self.books[m], 1)[:, 0] for m in range(SUBSPACES)], 1).astype(np.uint8)
        error = np.sqrt(sum(((rest[:, m] - self.books[m][codes[:, m]]) ** 2).sum(1) for m in range(SUBSPACES)))
        return near, codes, error

    def distances(self, unit: np.ndarray, lst: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances of visitors to codes of a list, by table lookup."""
        rest = self._split(unit - self.coarse[lst])
        total = np.zeros((len(unit), len(codes)), np.float32)
        for m in range(SUBSPACES):
            b = self.books[m]
            look = ((rest[:, m] ** 2).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * rest[:, m] @ b.T).astype(np.float32)
            total += np.take(look, codes[:, m], axis=1)
        return total


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float64).reshape(-1, dim) if len(col) else np.zeros((0, dim))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, exactly, so that squares of their components neither vanish nor overflow; cosines stay."""
    top = np.abs(x).max(1, initial=0.0)
    return np.ldexp(x, -np.frexp(top)[1][:, None])


def _padded(lists: list, dim: int) -> np.ndarray:
    out = np.zeros((len(lists), dim))
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def _vectors(lists: pa.Array) -> list[np.ndarray]:
    o = lists.offsets.to_numpy()
    return np.split(lists.values.to_numpy(zero_copy_only=False)[o[0] : o[-1]], o[1:-1] - o[0]) if len(lists) else []


def classes(vectors: DataFrame) -> DataFrame:
    """x (array of double), rep (smallest vec_id), m (number of ids) per distinct vector that takes part."""
    fine = F.forall("x", lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False))) & F.exists("x", lambda e: e != 0)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda e: e.cast("double")).alias("x")).where("vec_id IS NOT NULL AND x IS NOT NULL").where(fine)
    return v.groupBy("x", "vec_id").agg(F.lit(1).alias("one")).groupBy("x").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"))


def _cell(index: Index, cosine: float):
    reach = np.sqrt(2 - 2 * cosine)

    def run(key, table):
        lst = key[0].as_py()
        role = table.column("visits").to_numpy().astype(bool)

        def side(mask):
            t = table.filter(pa.array(mask))
            raw = _matrix(t.column("vec"), index.dim)
            norm = np.sqrt(np.einsum("ij,ij->i", raw, raw))
            probes = np.array(t.column("probes").to_pylist(), dtype=np.int64).reshape(len(raw), -1)
            return t, raw, norm, probes, t.column("rep").to_numpy(), t.column("m").to_numpy()

        rt, rx, rn, rp, rid, rm = side(~role)
        _, vx, vn, vp, vid, vm = side(role)
        out: list[list] = [[], [], []]
        if len(rid) and len(vid):
            codes = np.frombuffer(b"".join(rt.column("codes").to_pylist()), np.uint8).reshape(len(rid), SUBSPACES)
            limit = ((reach + rt.column("error").to_numpy() + 1e-4) ** 2).astype(np.float32)
            linked = np.zeros((len(vid), len(rid)), bool)
            nv, nr = np.zeros(len(vid), np.int64), np.zeros(len(rid), np.int64)
            for s in range(0, len(vid), 256):
                e = s + 256
                near = index.distances(vx[s:e] / vn[s:e, None], lst, codes) <= limit[None, :]
                i, j = np.nonzero(near & (vid[s:e, None] != rid[None, :]))
                for a in range(0, len(i), 1 << 16):  # exact check, in bounded pieces
                    p, q = i[a : a + (1 << 16)] + s, j[a : a + (1 << 16)]
                    ok = np.einsum("ij,ij->i", vx[p], rx[q]) / (vn[p] * rn[q]) >= cosine
                    linked[p[ok], q[ok]] = True
                # a pair is counted by the cell of the smaller list if both find each other, else where it is found
                home = vp[s:e, 0]
                both = (rp[None, :, :] == home[:, None, None]).any(2) if rp.shape[1] else np.zeros((len(home), len(rid)), bool)
                mine = linked[s:e] & ((home == lst)[:, None] | ~both | (lst < home)[:, None])
                nv[s:e] += mine @ rm
                away = mine & (home != lst)[:, None]
                nr += vm[s:e] @ away
            for ids, n in ((vid, nv), (rid, nr)):
                out[0].append(np.zeros(int((n > 0).sum()), np.int64))
                out[1].append(ids[n > 0])
                out[2].append(n[n > 0])
            a, b = linked.any(1), linked.any(0)
            sub, lv, lr = linked[a][:, b], vid[a].copy(), rid[b].copy()
            top = np.iinfo(np.int64).max
            while len(lv):
                was = (lv.copy(), lr.copy())
                lr = np.minimum(lr, np.where(sub, lv[:, None], top).min(0))
                lv = np.minimum(lv, np.where(sub, lr[None, :], top).min(1))
                if (was[0] == lv).all() and (was[1] == lr).all():
                    break
            for ids, low in ((vid[a], lv), (rid[b], lr)):
                out[0].append(np.ones(int((ids != low).sum()), np.int64))
                out[1].append(ids[ids != low])
                out[2].append(low[ids != low])
        cat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
        return pa.table({k: pa.array(x, pa.int64()) for k, x in zip(("kind", "a", "b"), cat, strict=True)})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, probes: int = PROBES, per_list: int = PER_LIST, max_lists: int = MAX_LISTS, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept for vectors (vec_id, embedding)."""
    all_ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda e: e.cast("double")).alias("x"))
    cls = checkpoint(classes(vectors))
    size = cls.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    if not size["n"]:
        return all_ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    dim = size["d"]
    lists = max(1, min(max_lists, size["n"] // per_list))
    few = cls.select("x", F.xxhash64(F.lit(29), "rep").alias("h")).orderBy("h").limit(min(sample, max(LEAST_SAMPLE, 8 * lists))).select("x").toArrow()
    fit = _scaled(_padded([v for c in few.column("x").chunks for v in _vectors(c)], dim))
    index = Index(fit / np.sqrt((fit * fit).sum(1))[:, None], min(lists, max(1, len(fit) // 8)))

    def encode(batches):
        for b in batches:
            for s in range(0, b.num_rows, 2048):
                c = b.slice(s, 2048)
                raw = _scaled(_padded(_vectors(c.column("x")), dim))
                near, codes, error = index.encode(raw / np.sqrt((raw * raw).sum(1))[:, None], probes)
                yield pa.RecordBatch.from_pydict({"rep": c.column("rep"), "m": c.column("m"), "vec": pa.array([x.tobytes() for x in raw], pa.binary()), "probes": pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32())), "codes": pa.array([x.tobytes() for x in codes], pa.binary()), "error": pa.array(error, pa.float64())})

    rows = checkpoint(cls.select("rep", "m", "x").mapInArrow(encode, "rep long, m long, vec binary, probes array<int>, codes binary, error double"))
    own = rows.groupBy(F.col("probes")[0].alias("lst")).agg(F.count("*").alias("nr"))
    came = rows.select(F.explode("probes").alias("lst")).groupBy("lst").agg(F.count("*").alias("nv"))
    # one row per list, at most max_lists: the bound of the broadcast
    grid = F.broadcast(checkpoint(own.join(came, "lst").select("lst", F.ceil(F.col("nr") / RESIDENTS).cast("int").alias("rbs"), F.ceil(F.col("nv") / VISITORS).cast("int").alias("vbs"))))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    h = F.xxhash64("rep")
    names = ["lst", "rb", "vb", "visits", "rep", "m", "vec", "probes", "codes", "error"]
    residents = rows.withColumn("lst", F.col("probes")[0]).join(grid, "lst").withColumns({"rb": F.pmod(h, F.col("rbs")).cast("int"), "visits": F.lit(False)}).withColumn("vb", upto("vbs"))
    visitors = rows.withColumn("lst", F.explode("probes")).join(grid, "lst").withColumns({"vb": F.pmod(h, F.col("vbs")).cast("int"), "visits": F.lit(True), "codes": F.lit(None).cast("binary")}).withColumn("rb", upto("rbs"))
    found = checkpoint(residents.select(*names).unionByName(visitors.select(*names)).groupBy("lst", "rb", "vb").applyInArrow(_cell(index, cosine), "kind long, a long, b long"))
    links = found.where("kind = 0").groupBy(F.col("a").alias("n_rep")).agg(F.sum("b").alias("links"))
    parts = connected_components(found.where("kind = 1").select("a", "b"))
    of = cls.join(links, F.col("rep") == F.col("n_rep"), "left").join(parts, F.col("rep") == F.col("node"), "left")
    of = of.select(F.col("x").alias("cx"), (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = all_ids.join(of, (F.col("x") == F.col("cx")) & F.col("vec_id").isNotNull(), "left")
    comp = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("vec_id") == comp, F.lit(True)).alias("kept"))


def op10(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return near_duplicates(table(spark, sf_dir, "embeddings"))
