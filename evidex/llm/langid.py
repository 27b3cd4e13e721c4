"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

Both directions read segments of SEGMENT bytes; every byte position gets class probabilities, which are
averaged over all positions of a document. Training is backpropagation through time with Adam on a
bounded sample: at most PER_LANG documents of a language (smallest hash first), SPAN characters of each.
Prediction reads every byte of every document and is a map without a shuffle.

Edge cases: null text and text without a letter is `und` with score 0; with no labelled row everything is
`und`; null lang is no label; repeated rows are predicted each; very long texts are cut into segments, so
memory stays bounded; further columns are carried along by `identify`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import bounded_batches, crc32_of, string_bytes

HIDDEN, SEGMENT = 8, 64
PER_LANG, MAX_LANGS, SPAN, GROUPS = 300, 64, 384, 16


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= np.float32(0.5)
    np.tanh(x, out=x)
    x *= np.float32(0.5)
    x += np.float32(0.5)
    return x


class Network:
    """Parameters by name: x0, x1 (256 x 3H input weights of each direction, per byte), u0, u1 (H x 3H), w (2H x C), b (C)."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.langs, self.h = langs, hidden
        f = lambda *s, k: (rng.standard_normal(s) * k).astype(np.float32)
        self.p = {"x0": f(256, 3 * hidden, k=0.4), "x1": f(256, 3 * hidden, k=0.4), "u0": f(hidden, 3 * hidden, k=0.35), "u1": f(hidden, 3 * hidden, k=0.35), "w": f(2 * hidden, len(langs), k=0.3), "b": np.zeros(len(langs), np.float32)}

    def states(self, seg: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States of both directions, (L, B, 2H), for seg (L, B) bytes; what training needs goes to keep."""
        steps, n, h = len(seg), seg.shape[1], self.h
        out = np.empty((steps, n, 2 * h), np.float32)
        for d in (0, 1):
            x, u = self.p[f"x{d}"], self.p[f"u{d}"]
            state = np.zeros((n, h), np.float32)
            gx, gh = np.empty((n, 3 * h), np.float32), np.empty((n, 3 * h), np.float32)
            trace = []
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                np.take(x, seg[t], axis=0, out=gx, mode="clip")
                np.matmul(state, u, out=gh)
                gx[:, : 2 * h] += gh[:, : 2 * h]
                zr = _sigmoid(gx[:, : 2 * h])
                cand = zr[:, h:] * gh[:, 2 * h :]
                cand += gx[:, 2 * h :]
                np.tanh(cand, out=cand)
                if keep is not None:
                    trace.append((t, zr.copy(), gh[:, 2 * h :].copy(), cand, state))
                state = cand + zr[:, :h] * (state - cand)
                out[t, :, d * h : (d + 1) * h] = state
            if keep is not None:
                keep.append(trace)
        return out

    def predict_states(self, seg: np.ndarray) -> np.ndarray:
        """states() without a trace: each gate has arrays of its own, so every operation is on contiguous memory; gates' inputs are halved beforehand."""
        steps, n, h = len(seg), seg.shape[1], self.h
        out = np.empty((steps, n, 2 * h), np.float32)
        half = np.float32(0.5)
        for d in (0, 1):
            x, u = self.p[f"x{d}"], self.p[f"u{d}"]
            cut = [slice(0, h), slice(h, 2 * h), slice(2 * h, 3 * h)]
            xz, xr, xn = (np.ascontiguousarray(x[:, c]) * k for c, k in zip(cut, (half, half, 1), strict=True))
            uz, ur, un = (np.ascontiguousarray(u[:, c]) * k for c, k in zip(cut, (half, half, 1), strict=True))
            state = np.zeros((n, h), np.float32)
            z, r, c, g = (np.empty((n, h), np.float32) for _ in range(4))
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                at = seg[t]
                for gate, xs, us in ((z, xz, uz), (r, xr, ur)):
                    np.take(xs, at, axis=0, out=gate, mode="clip")
                    np.matmul(state, us, out=g)
                    gate += g
                    np.tanh(gate, out=gate)
                    gate *= half
                    gate += half
                np.matmul(state, un, out=g)
                g *= r
                np.take(xn, at, axis=0, out=c, mode="clip")
                c += g
                np.tanh(c, out=c)
                state -= c
                state *= z
                state += c
                out[t, :, d * h : (d + 1) * h] = state
        return out

    def positions(self, states: np.ndarray) -> np.ndarray:
        """Class probabilities of every position."""
        z = states.reshape(-1, 2 * self.h) @ self.p["w"]
        z += self.p["b"]
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        return z.reshape(*states.shape[:2], -1)

    def gradient(self, seg: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        keep: list = []
        states = self.states(seg, keep)
        prob = self.positions(states)
        m = mask.astype(np.float32)
        total = max(1.0, float(m.sum()))
        loss = -float((np.log(np.take_along_axis(prob, label[None, :, None], 2)[:, :, 0] + 1e-9) * m).sum()) / total
        dz = prob
        np.put_along_axis(dz, np.broadcast_to(label[None, :, None], (*dz.shape[:2], 1)), np.take_along_axis(dz, label[None, :, None], 2) - 1, 2)
        dz *= (m / np.float32(total))[:, :, None]
        flat = dz.reshape(-1, dz.shape[2])
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["w"], g["b"] = states.reshape(-1, 2 * self.h).T @ flat, flat.sum(0)
        dout = dz @ self.p["w"].T
        h = self.h
        for d in (0, 1):
            u, carry = self.p[f"u{d}"], np.zeros((seg.shape[1], h), np.float32)
            for t, zr, ghn, cand, prior in reversed(keep[d]):
                z, r = zr[:, :h], zr[:, h:]
                ds = carry + dout[t, :, d * h : (d + 1) * h]
                dn = ds * (1 - z) * (1 - cand * cand)
                dgx = np.concatenate([ds * (prior - cand) * z * (1 - z), dn * ghn * r * (1 - r), dn], 1)
                dgh = dgx.copy()
                dgh[:, 2 * h :] *= r
                for c in range(3 * h):
                    g[f"x{d}"][:, c] += np.bincount(seg[t], dgx[:, c], 256).astype(np.float32)
                g[f"u{d}"] += prior.T @ dgh
                carry = ds * z + dgh @ u.T
        return loss, g

    def fit(self, segs: np.ndarray, lens: np.ndarray, labels: np.ndarray, epochs: int = 4, batch: int = 256, rate: float = 0.02, seed: int = 7) -> float:
        """Adam over segments (n, L); the loss of the last epoch is returned."""
        rng = np.random.default_rng(seed)
        m1, m2, step, loss = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0, 0.0
        for e in range(epochs):
            order, losses = rng.permutation(len(segs)), []
            for s in range(0, len(order), batch):
                i = order[s : s + batch]
                one, g = self.gradient(np.ascontiguousarray(segs[i].T), np.arange(segs.shape[1])[:, None] < lens[i][None, :], labels[i])
                losses.append(one)
                step += 1
                lr = rate * (0.3 if e == epochs - 1 else 1.0)
                for k, v in g.items():
                    np.clip(v, -1, 1, out=v)
                    m1[k] = 0.9 * m1[k] + 0.1 * v
                    m2[k] = 0.99 * m2[k] + 0.01 * v * v
                    self.p[k] -= (lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            loss = float(np.mean(losses)) if losses else 0.0
        return loss

    def documents(self, data: np.ndarray, offs: np.ndarray, batch: int = 2048) -> np.ndarray:
        """Mean class probabilities of each document (rows of data between offs), over all its positions."""
        seg, lens, doc = segments(data, offs)
        total = np.zeros((len(offs) - 1, len(self.langs)), np.float64)
        at = np.arange(SEGMENT)[:, None]
        for s in range(0, len(lens), batch):
            one = np.ascontiguousarray(seg(s, s + batch).T)
            prob = self.positions(self.predict_states(one))
            n = lens[s : s + batch]
            if n.min() < SEGMENT:
                prob *= (at < n[None, :])[:, :, None]
            np.add.at(total, doc[s : s + batch], prob.sum(0))
        return total / np.maximum(1, np.diff(offs))[:, None]


def segments(data: np.ndarray, offs: np.ndarray, length: int = SEGMENT):
    """Segments of each row's bytes: a function giving rows s:e of them as (n, length), zero padded; their lengths; their document."""
    size = np.diff(offs)
    count = -(-size // length)
    doc = np.repeat(np.arange(len(size)), count)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = offs[doc] + within * length
    lens = np.minimum(length, offs[doc + 1] - start) if len(doc) else np.zeros(0, np.int64)
    padded = np.concatenate([data, np.zeros(length, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, length)

    def rows(s: int, e: int) -> np.ndarray:
        out = view[start[s:e]].copy()
        short = lens[s:e] < length
        if short.any():
            out[short] *= np.arange(length)[None, :] < lens[s:e][short][:, None]
        return out

    return rows, lens, doc


def train(labelled: DataFrame, per_lang: int = PER_LANG, span: int = SPAN) -> Network | None:
    """Fit on a bounded sample of (doc_id, text, lang): per_lang documents (the smallest hashes in each of GROUPS hash groups, so a
    frequent language isn't one group) of each of at most MAX_LANGS languages, span characters from a hashed place of each."""
    h = F.xxhash64(F.lit(11), "doc_id", "text")
    at = F.lit(1) + F.pmod(h, F.greatest(F.length("text") - span, F.lit(1))).cast("int")
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").where(F.col("text").rlike(r"\p{L}")).select("lang", h.alias("h"), F.substring("text", at, F.lit(span)).alias("t"))
    w = Window.partitionBy("lang", "g").orderBy("h", "t")
    got = rows.withColumn("g", F.pmod("h", F.lit(GROUPS))).withColumn("k", F.row_number().over(w)).where(F.col("k") <= -(-per_lang // GROUPS)).orderBy("k", "g", "lang").limit((per_lang + GROUPS) * MAX_LANGS).select("lang", "t").toPandas()
    if not len(got):
        return None
    langs = sorted(set(got["lang"]))
    data, offs = string_bytes(pa.array(got["t"], pa.string()))
    rows_of, lens, doc = segments(data, offs)
    label = np.array([langs.index(x) for x in got["lang"]])[doc]
    net = Network(langs)
    net.fit(rows_of(0, len(lens)), lens, label)
    return net


def identify(docs: DataFrame, labelled: DataFrame, names: tuple[str, str] = ("lang_pred", "score"), **options) -> DataFrame:
    """docs with the predicted language and its score, under `names` (columns of docs with these names give way); labelled rows (doc_id, text, lang) train the network. Reads text only."""
    bounded_batches(docs)
    net = train(labelled, **options)
    keep = [c for c in docs.columns if c not in names]
    schema = docs.select(*keep).schema.add(names[0], "string").add(names[1], "double")
    flagged = docs.select(*keep, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_has_letter"))

    def run(batches):
        for b in batches:
            letter = np.asarray(b.column(len(keep)).to_numpy(zero_copy_only=False), dtype=bool)
            pred, score = np.full(b.num_rows, "und", dtype=object), np.zeros(b.num_rows)
            if net is not None and letter.any():
                for s in range(0, b.num_rows, 512):  # bounds the working set, whatever the batch size
                    part = b.column(keep.index("text")).slice(s, 512)
                    mean = net.documents(*string_bytes(part))
                    pred[s : s + 512], score[s : s + 512] = np.array(net.langs, dtype=object)[mean.argmax(1)], mean.max(1)
                pred[~letter], score[~letter] = "und", 0.0
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array(pred, pa.string()), pa.array(np.clip(score, 0, 1), pa.float64())], [*keep, *names])

    return flagged.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, least_score: float = 0.35) -> DataFrame:
    """Rows of docs whose text has a language: not und, and predicted with at least least_score."""
    names = ("_lang_pred", "_lang_score")
    out = identify(docs, docs.where(~held_out()).select("doc_id", "text", "lang"), names)
    return out.where((F.col(names[0]) != "und") & (F.col(names[1]) >= least_score)).select(*docs.columns)


def held_out(doc_id: str = "doc_id") -> F.Column:
    return crc32_of(doc_id) % 4 == 2


def op4(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), docs.where(~held_out()).select("doc_id", "text", "lang"))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
