"""MinHash near-duplicates with sequential Bayesian verification.

1. One pass over the texts: the set of word shingles, its size and 128-bit fingerprint, BANDS x ROWS
   min-hashes as band keys and as one byte each.
2. Texts with equal sets are one class; from here on only its smallest id counts, however many copies.
3. Members of a band bucket are compared by signature bytes in batches; a pair is dropped as soon as the
   posterior probability (uniform prior) of similarity >= 75/100 falls below MISS. Of what survives,
   a bucket gives a spanning forest only. A bucket of more than BLOCK members is cut into blocks, each with
   the same PIVOTS members of the bucket, so its work and its rows grow with its size, not with the square.
4. Forest edges are verified exactly on the full sets, recomputed from the whole texts.
5. Where an edge fails, or a bucket was cut, the forest doesn't say all of the bucket. Of such a bucket the members that
   aren't in its most frequent component by now (the rest) are compared with all others; what lies in one
   component is not compared again. Only rows that survive with one of another component get their texts, and
   are verified inside the cell, which again returns a forest. So no link that passes step 3's test is lost, and no step lists the
   pairs of a group. A bucket that is one large group, as hot ones are, is linear; rest x bucket otherwise.

Edge cases: null and empty texts and texts without words have 0 shingles and link with nothing; fewer than
5 words are one shingle; equal sets always link; a repeated row shares its id's component; rows with a null
doc_id link with nothing and are kept with component null; an empty table gives no rows; further columns are
ignored here and carried along by `keep_first`.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import bounded_batches, checkpoint, mix64, string_bytes
from .graph import connected_components

BANDS, ROWS, SAME, OF, MISS, BLOCK, EXACT_BLOCK, PIVOTS = 20, 4, 75, 100, 1e-4, 2048, 256, 16
BATCH = 20  # signature bytes compared before each look at the posterior
_MULT = np.random.default_rng(77).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def least_matches(miss: float = MISS) -> list[tuple[int, int]]:
    """(bytes compared, fewest matches that keep a pair). Bytes match with p = J + (1 - J) / 256; for a uniform prior
    P(p >= t | m of n) = P(Binomial(n + 1, t) <= m)."""
    t, out = SAME / OF + (1 - SAME / OF) / 256, []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        total = 0.0
        for m in range(n + 2):
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= miss:
                out.append((n, m))
                break
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n, f1, f2, bands (array of long), sig (bytes) of every text; a map without a shuffle."""

    def run(it):
        for b in it:
            data, offs = string_bytes(b.column(1))
            ids = b.column(0).cast(pa.int64())
            for a, z, d, o in shingles.batches(data, offs):
                s, at = shingles.sets(d, o)
                n = np.diff(at)
                has = n > 0
                f, bands, sig = np.zeros((2, z - a), np.uint64), np.zeros((int(has.sum()), BANDS), np.uint64), np.zeros((int(has.sum()), BANDS * ROWS), np.uint8)
                if has.any():
                    first = at[:-1][has]
                    f[0, has] = np.add.reduceat(mix64(s ^ _MULT[0]), first)
                    f[1, has] = np.add.reduceat(mix64(s ^ _MULT[1]), first)
                    buf = np.empty_like(s)
                    for k in range(BANDS * ROWS):
                        np.multiply(s, _MULT[k], out=buf)
                        low = mix64(np.minimum.reduceat(buf, first))
                        sig[:, k] = (low >> np.uint64(56)).astype(np.uint8)
                        bands[:, k // ROWS] = mix64(bands[:, k // ROWS] * _MULT[k % ROWS] + low + np.uint64(k))
                full_b, full_s = np.zeros((z - a, BANDS), np.int64), [None] * (z - a)
                full_b[has] = bands.view(np.int64)
                for i, row in zip(np.flatnonzero(has).tolist(), sig, strict=True):
                    full_s[i] = row.tobytes()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(z - a + 1, dtype=np.int32) * BANDS), pa.array(full_b.ravel()))
                yield pa.RecordBatch.from_arrays([ids.slice(a, z - a), pa.array(n, pa.int64()), pa.array(f[0].view(np.int64)), pa.array(f[1].view(np.int64)), lists, pa.array(full_s, pa.binary())], ["doc_id", "n", "f1", "f2", "bands", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, f1 long, f2 long, bands array<long>, sig binary")


class Survivors:
    """The Bayesian test of one row of a bucket against others."""

    def __init__(self, n: np.ndarray, sig: np.ndarray, steps: list[tuple[int, int]]):
        self.n, self.sig, self.steps = n, sig, steps

    def of(self, x: int, rest: np.ndarray) -> np.ndarray:
        """Those of rest that survive with x."""
        low, high = np.minimum(self.n[rest], self.n[x]), np.maximum(self.n[rest], self.n[x])
        rest = rest[OF * low >= SAME * high]  # the sizes alone bound the similarity
        match = np.zeros(len(rest), np.int64)
        was = 0
        for n, least in self.steps:
            match += (self.sig[rest, was:n] == self.sig[x, was:n]).sum(1)
            ok = match >= least
            rest, match, was = rest[ok], match[ok], n
        return rest


def forest(test: Survivors, side: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Spanning forest of the surviving pairs, as (row, rows joined to it); side: only rows of different sides are compared, unless all are -1."""
    left, out = np.arange(len(side)), []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = test.of(x, left if side[x] < 0 else left[side[left] != side[x]])
            if len(hit):
                out.append((x, hit))
                queue += hit[::-1].tolist()
                left = np.setdiff1d(left, hit, assume_unique=True)
    return out


class Overlaps:
    """Sizes of the sets of a cell and of their intersections, from an inverted table of the cell's shingles."""

    def __init__(self, texts: list[bytes]):
        offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        h, self.at = shingles.sets(np.frombuffer(b"".join(texts), np.uint8), offs)
        self.size = np.diff(self.at)
        self.ids = np.unique(h, return_inverse=True)[1]
        self.owner = np.repeat(np.arange(len(texts)), self.size)[np.argsort(self.ids, kind="stable")]
        self.count = np.bincount(self.ids)
        self.first = np.cumsum(self.count) - self.count

    def linked(self, x: int, rest: np.ndarray) -> np.ndarray:
        """Those of rest whose full sets are similar enough to x's."""
        ids = self.ids[self.at[x] : self.at[x + 1]]
        n = self.count[ids]
        at = np.repeat(self.first[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        same = np.bincount(self.owner[at], minlength=len(self.size))[rest]
        return rest[(OF * same >= SAME * (self.size[x] + self.size[rest] - same)) & (same > 0)]


def verified_forest(test: Survivors, side: np.ndarray, label: np.ndarray, sets: Overlaps) -> list[tuple[int, int]]:
    """Exactly verified links that join rows of different labels, one for each join."""
    out, label = [], np.unique(label, return_inverse=True)[1]
    for x in range(len(side) - 1):
        rest = np.arange(x + 1, len(side))
        rest = rest[(label[rest] != label[x]) & ((side[x] < 0) | (side[rest] != side[x]))]
        if not len(rest) or not len(rest := test.of(x, rest)):
            continue
        for y in sets.linked(x, rest).tolist():
            if label[y] != label[x]:
                out.append((x, y))
                label[label == label[y]] = label[x]
    return out


def sifted(test: Survivors, side: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Rows that survive with one of another label (and side)."""
    some = np.zeros(len(side), bool)
    for x in range(len(side) - 1):
        rest = np.arange(x + 1, len(side))
        hit = test.of(x, rest[(label[rest] != label[x]) & ((side[x] < 0) | (side[rest] != side[x]))])
        some[hit] = True
        some[x] |= len(hit) > 0
    return np.flatnonzero(some)


def _compare(members: DataFrame, miss: float, step: str = "forest") -> DataFrame:
    """key, a, b of a spanning forest of each cell (key, bi, bj) of members (key, bi, bj, blk, rep, n, sig): of the surviving pairs, to be verified.

    step `sift`: members have label, too; key, bi, bj, rep of the rows that survive with one of another label are returned.
    step `exact`: members have label and z (compressed text); surviving pairs of different labels are verified here, and links that join them are returned.
    """
    steps, names = least_matches(miss), ["key", "bi", "bj", "rep"] if step == "sift" else ["key", "a", "b"]

    def cell(key, bi, bj, blk, rep, n, sig, label, z, out):
        o = np.argsort(rep, kind="stable")
        blk, rep, n, sig, label = blk[o], rep[o], n[o], sig[o], label[o]
        side = blk if bi != bj else np.full(len(rep), -1)
        test = Survivors(n, sig, steps)
        if step != "forest" and (label == label[0]).all():
            return
        if step == "sift":
            some = rep[sifted(test, side, label)]
            for c, v in zip(out, (key, bi, bj, some), strict=True):
                c.append(np.full(len(some), v) if c is not out[3] else v)
            return
        if step == "exact":
            d = zstandard.ZstdDecompressor()
            found = [(x, np.array([y])) for x, y in verified_forest(test, side, label, Overlaps([d.decompress(z[i]) for i in o]))]
        else:
            found = forest(test, side)
        for x, hit in found:
            a = np.full(len(hit), rep[x])
            out[0].append(np.full(len(hit), key))
            out[1].append(np.minimum(a, rep[hit]))
            out[2].append(np.maximum(a, rep[hit]))

    def run(it):
        held = None
        for b in it:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            cells = [held.column(c).to_numpy() for c in ("key", "bi", "bj")]
            cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cells], 0)) + 1 if held.num_rows > 1 else np.zeros(0, int)
            if len(cut):
                yield work(held.slice(0, int(cut[-1])))
                held = held.slice(int(cut[-1])).combine_chunks()
        if held is not None and held.num_rows:
            yield work(held)

    def work(t):
        key, bi, bj, blk, rep, n = (t.column(c).to_numpy() for c in ("key", "bi", "bj", "blk", "rep", "n"))
        label = t.column("label").to_numpy() if step != "forest" else rep
        z = t.column("z").to_pylist() if step == "exact" else []
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(rep), BANDS * ROWS)
        cut = np.flatnonzero((key[1:] != key[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])) + 1
        out = [[] for _ in names]
        for a, e in zip([0, *cut.tolist()], [*cut.tolist(), len(key)], strict=True):
            if e - a > 1:
                cell(key[a], bi[a], bj[a], blk[a:e], rep[a:e], n[a:e], sig[a:e], label[a:e], z[a:e], out)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in out], names)

    return members.sortWithinPartitions("key", "bi", "bj").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _shared(reps: DataFrame) -> DataFrame:
    """key, cnt of the band buckets with two or more members."""
    return reps.select(F.explode("bands").alias("key")).groupBy("key").agg(F.count("*").alias("cnt")).where("cnt > 1")


def _rows(reps: DataFrame, keys: DataFrame) -> DataFrame:
    """rep, n, sig of the members of buckets `keys`, with its columns."""
    return reps.select("rep", F.explode("bands").alias("key")).join(keys, "key").join(reps.select("rep", "n", "sig"), "rep")


def _blocks(reps: DataFrame, shared: DataFrame, block: int, pivots: int) -> DataFrame:
    """Members by cell; a bucket of more than `block` members is cut into blocks, each with the bucket's pivots (smallest hashes of `pivots` parts of it)."""
    size = shared.withColumn("nb", F.ceil(F.col("cnt") / block).cast("long"))
    rows = _rows(reps, size).withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("nb")))
    names = ["key", F.col("blk").alias("bi"), F.col("blk").alias("bj"), "blk", "rep", "n", "sig"]
    hot = size.where("nb > 1")
    if hot.isEmpty():
        return rows.select(*names)
    part, order = F.pmod(F.xxhash64(F.lit(1), "rep"), F.lit(pivots)), F.struct(F.xxhash64(F.lit(2), "rep"), "rep")
    first = _rows(reps, hot).groupBy("key", "nb", part.alias("p")).agg(F.min_by(F.struct("rep", "n", "sig"), order).alias("v"))
    first = first.select("key", "v.*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("blk"))
    return rows.select(*names).unionByName(first.select(*names))


def _rest(held: DataFrame, block: int) -> DataFrame:
    """Cells of members (key, rep, n, sig, label) that aren't in their bucket's most frequent label against all of the bucket; buckets of one label have none."""
    by = held.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("top"), F.max("c").alias("most"), F.sum("c").alias("all")).where("most < all")
    by = by.select("key", "top", F.ceil((F.col("all") - F.col("most")) / block).cast("long").alias("nr"), F.ceil(F.col("most") / block).cast("long").alias("nd"))
    h, rest = F.xxhash64("rep"), F.col("label") != F.col("top")
    rows = held.join(by, "key").withColumn("blk", F.when(rest, F.pmod(h, F.col("nr"))).otherwise(F.col("nr") + F.pmod(h, F.col("nd"))))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(rest, F.col("nr") + F.col("nd") - 1).otherwise(F.col("nr") - 1))))
    return rows.select("key", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"), "blk", "rep", "n", "sig", "label")


def _dealt(members: DataFrame) -> DataFrame:
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return members.repartition(n, "key", "bi", "bj")


def packed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, z (text compressed; a quarter to a half of the shuffle)."""

    def run(it):
        comp = zstandard.ZstdCompressor(level=3)
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([None if t is None else comp.compress(t.encode()) for t in b.column(1).to_pylist()], pa.binary())], ["doc_id", "z"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, z binary")


def verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """pairs (a, b) with ok: whether the full shingle sets of the texts have 100 * intersection >= 75 * union."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = checkpoint(packed_texts(docs.where("doc_id IS NOT NULL AND text IS NOT NULL")).join(ends, F.col("doc_id") == F.col("id"), "left_semi"))
    rows = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("z").alias("zb")), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("z").alias("za")), "a")

    def run(it):
        d = zstandard.ZstdDecompressor()
        for b in it:
            a_ids, b_ids = b.column("a").to_numpy(), b.column("b").to_numpy()
            ok = np.zeros(len(a_ids), bool)
            for s in range(0, len(a_ids), 64):
                both = [[d.decompress(z) for z in b.column(c).slice(s, 64).to_pylist()] for c in ("za", "zb")]
                raw = [x for side in both for x in side]
                offs = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
                h, at = shingles.sets(np.frombuffer(b"".join(raw), np.uint8), offs)
                m = len(both[0])
                for i in range(m):
                    x, y = h[at[i] : at[i + 1]], h[at[m + i] : at[m + i + 1]]
                    same = np.intersect1d(x, y, assume_unique=True).size
                    ok[s + i] = OF * same >= SAME * (len(x) + len(y) - same) and same > 0
            yield pa.RecordBatch.from_arrays([pa.array(a_ids), pa.array(b_ids), pa.array(ok)], ["a", "b", "ok"])

    return rows.select("a", "b", "za", "zb").mapInArrow(run, "a long, b long, ok boolean")


def near_duplicates(docs: DataFrame, miss: float = MISS, block: int = BLOCK, exact_block: int = EXACT_BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for docs (doc_id, text)."""
    bounded_batches(docs)
    sigs = checkpoint(signatures(docs))
    reps = checkpoint(sigs.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sig").alias("sig")))
    shared = checkpoint(_shared(reps))
    pairs = checkpoint(_compare(_dealt(_blocks(reps, shared, block, pivots)), miss))
    checked = checkpoint(verify(pairs.select("a", "b").where("a <> b").distinct(), docs))
    links = checked.where("ok").select("a", "b")
    parts = connected_components(links)
    failed = checked.where("NOT ok").select("a", "b")
    open_keys = pairs.join(failed, ["a", "b"], "left_semi").select("key").unionByName(shared.where(F.col("cnt") > block).select("key")).distinct()
    if not open_keys.isEmpty():
        held = _rows(reps, open_keys).join(parts, F.col("rep") == F.col("node"), "left").select("key", "rep", "n", "sig", F.coalesce("component", "rep").alias("label"))
        cells = checkpoint(_rest(held, exact_block))
        some = checkpoint(cells.join(_compare(_dealt(cells), miss, "sift"), ["key", "bi", "bj", "rep"], "left_semi"))
        ids = some.select(F.col("rep").alias("id")).distinct()
        texts = packed_texts(docs.where("doc_id IS NOT NULL AND text IS NOT NULL")).join(ids, F.col("doc_id") == F.col("id"), "left_semi")
        late = checkpoint(_compare(_dealt(some.join(texts, F.col("rep") == F.col("doc_id")).drop("doc_id")), miss, "exact")).select("a", "b")
        parts = connected_components(links.unionByName(late))
    of = reps.join(parts, F.col("rep") == F.col("node"), "left").select(F.col("n").alias("cn"), F.col("f1").alias("c1"), F.col("f2").alias("c2"), F.coalesce("component", "rep").alias("comp"))
    out = sigs.select("doc_id", "n", "f1", "f2").join(of, (F.col("n") == F.col("cn")) & (F.col("f1") == F.col("c1")) & (F.col("f2") == F.col("c2")) & F.col("doc_id").isNotNull(), "left")
    comp = F.coalesce("comp", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, miss: float = MISS) -> DataFrame:
    """Rows of docs whose id is its component's smallest; of rows repeated under one id, one, found in the partitions of the join."""
    gone = near_duplicates(docs, miss).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
    return left.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(left.where("doc_id IS NULL"))


def op8(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents"))
