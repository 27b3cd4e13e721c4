"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are sorted only to the threshold (WIDTH bytes), by passes of most significant digits, and a suffix
leaves the sort as soon as it is alone in its group; the groups left after the last digit are exactly
the repeated windows. What is distributed is the first pass: every window goes to the bucket of its
minimiser, the smallest hash among its own SEED-byte strings, so equal windows meet. Neighbouring windows
with one minimiser travel as one string of at most WIDTH + SPAN - 1 bytes, in compressed blobs of a bucket.

A string found again inside a map batch is sent once, with the smallest id; the copies' answer is known there and
only their place is sent on. So a passage that a third of all documents share costs one string per batch.

Edge cases: null and empty texts have nothing to remove; texts shorter than WIDTH never match; copies inside
one document are kept; repeated rows have one id and never remove each other; a doc_id is taken to be one
document (rows of one id with different texts share their spans, cut to each row's length); rows with a null
doc_id neither remove nor lose anything; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, input_bytes, mix64, string_bytes
from .shingles import batches

WIDTH, SEED = 50, 12
SPAN = WIDTH - SEED + 1  # seeds in a window, and the most windows that one string carries
ROW = -(-(WIDTH + SPAN - 1) // 8) * 8
BATCH, CHUNK, PER_BUCKET = 8 << 20, 1 << 20, 5 << 19
BITS = 21  # of a place in a chunk of at most CHUNK + WIDTH - 1 bytes
_K = np.uint64(0x9E3779B97F4A7C15)
NONE = np.iinfo(np.int64).min  # stands for a null id


def _seeds(data: np.ndarray) -> np.ndarray:
    """Hash of the SEED bytes at every position: hashes of 1, 2, 4, 8 bytes by doubling, then put together."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _K
    h ^= h >> np.uint64(29)
    step, mult, done, out = 1, 0x9E3779B97F4A7C15, 0, None
    while done < SEED:
        if SEED & step:
            part = h[done:]
            out = part if out is None else out[: len(part)] * np.uint64(mult) + part
            done += step
        h = h[:-step] * np.uint64(mult) + h[step:]
        step, mult = step * 2, mult * mult % (1 << 64)
    return mix64(out[: len(data) - SEED + 1].copy())


def strings(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimiser: row, start in data (under 2**BITS bytes), number of windows, place of the minimiser in the run's first window, minimiser."""
    n = len(data)
    if n >= 1 << BITS:
        raise ValueError(f"a chunk of {n} bytes; chunks() cuts them")
    none = np.zeros(0, np.int64)
    if n < WIDTH:
        return none, none, none, none, np.zeros(0, np.uint64)
    h = _seeds(data)
    low = np.uint64((1 << BITS) - 1)  # as many bits in every chunk, so equal windows choose alike
    best = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # equal hashes: the leftmost
    step = 1
    while step * 2 <= SPAN:
        best = np.minimum(best[:-step], best[step:])
        step *= 2
    best = np.minimum(best[: len(best) - (SPAN - step)], best[SPAN - step :])
    place = (best & low).astype(np.int64)
    valid = np.ones(n - WIDTH + 1, bool)
    for k in range(1, WIDTH):  # windows that would cross a row's end
        cross = offs[1:-1] - k
        valid[cross[(cross >= 0) & (cross < len(valid))]] = False
    new = np.empty(len(valid), bool)
    new[0] = True
    new[1:] = (place[1:] != place[:-1]) | ~valid[:-1]
    start = np.flatnonzero(new & valid)
    last = np.flatnonzero(valid & np.concatenate([new[1:] | ~valid[1:], [True]]))
    row = np.searchsorted(offs, start, "right") - 1
    return row, start, last - start + 1, place[start] - start, h[place[start]]


def chunks(data: np.ndarray, offs: np.ndarray, most: int = CHUNK):
    """batches(), with a text of over `most` bytes cut into chunks that overlap by WIDTH - 1 bytes, so each window is in one: first and last text, data, offsets, place of the data in the text."""
    for a, z, d, o in batches(data, offs, most):
        for s in range(0, max(1, len(d) - WIDTH + 1), most) if z == a + 1 else (0,):
            part = d[s : s + most + WIDTH - 1] if z == a + 1 else d
            yield a, z, part, np.array([0, len(part)]) if z == a + 1 else o, s


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """data[start : start + size] of all, joined."""
    at = np.cumsum(size) - size
    return data[np.repeat(start - at, size) + np.arange(int(size.sum()))]


def rows_of(data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int = ROW) -> np.ndarray:
    """The same as a matrix, zero padded, as big-endian words of 8 bytes: the digits of the sort."""
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, width)[start].copy()
    out *= np.arange(width)[None, :] < size[:, None]
    return out.view(">u8").astype(np.uint64)


def radix_groups(first: np.ndarray, digits) -> np.ndarray:
    """Group of every item: items are equal if first and all digits are. first: number of a coarse group (>= 0).

    digits(i, d): digit d (0, 1, ...) of items i, or None after the last. A pass sorts the items still tied by
    (group, digit) and drops those that are alone; -1 marks items that are alone.
    """
    out = np.full(len(first), -1, np.int64)
    live = np.arange(len(first))
    group = first
    d = -1
    while len(live):
        if d < 0:
            o = np.argsort(group, kind="stable")
            new = np.empty(len(o), bool)
            new[:1] = True
            new[1:] = group[o][1:] != group[o][:-1]
        else:
            word = digits(live, d)
            if word is None:
                out[live] = group
                break
            o = np.argsort(word, kind="stable")
            o = o[np.argsort(group[o], kind="stable")]
            g, w = group[o], word[o]
            new = np.empty(len(o), bool)
            new[:1] = True
            new[1:] = (g[1:] != g[:-1]) | (w[1:] != w[:-1])
        number = np.cumsum(new) - 1
        keep = np.bincount(number)[number] > 1
        live, group = live[o[keep]], number[keep]
        d += 1
    return out


def _blob(*parts: np.ndarray) -> bytes:
    head = np.array([len(parts), *[p.nbytes for p in parts]], np.int64).tobytes()
    return zstandard.compress(head + b"".join(p.tobytes() for p in parts), 5)


def _parts(blob: bytes, kinds) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    k = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes, at, out = np.frombuffer(raw, np.int64, k, 8), 8 * (k + 1), []
    for n, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(raw, kind, int(n) // np.dtype(kind).itemsize, at))
        at += int(n)
    return out


def _delta(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=0) if len(x) else x


def _home(doc: np.ndarray, n: int) -> np.ndarray:
    """Bucket of documents for the last stage."""
    return (mix64(doc.astype(np.int64).view(np.uint64) + _K) % np.uint64(n)).astype(np.int64)


SENT = (np.int64, np.int32, np.uint8, np.uint8, np.uint8, np.int64, np.int32, np.uint8)  # doc, pos, windows, place, bytes; copies: doc, pos, windows


def _send(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, blob: the strings of every map batch by bucket."""

    def batch(held):
        doc, pos, num, place, mini, base, size = (np.concatenate(x) for x in zip(*[h[:7] for h in held], strict=True))
        data = np.concatenate([h[7] for h in held])
        # strings that occur again in this batch: only the smallest id's is sent with its bytes
        o = np.argsort(mini, kind="stable")
        again = np.zeros(len(o), bool)
        same = mini[o][1:] == mini[o][:-1]
        again[1:] |= same
        again[:-1] |= same
        i = np.sort(o[again])
        copy = np.zeros(len(doc), bool)
        if len(i):
            rank = np.unique(mini[i], return_inverse=True)[1]
            words = rows_of(data, base[i], size[i])
            shape = num[i].astype(np.uint64) << np.uint64(8) | place[i].astype(np.uint64)
            g = radix_groups(rank, lambda j, d: shape[j] if d == 0 else words[j, d - 1] if d <= words.shape[1] else None)
            tied = g >= 0
            if tied.any():
                low = np.full(int(g.max()) + 1, np.iinfo(np.int64).max)
                np.minimum.at(low, g[tied], doc[i[tied]])
                copy[i[tied]] = doc[i[tied]] > low[g[tied]]
        # minima are small: mixed again, else the first buckets get most
        bucket = ((mix64(mini ^ _K) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        o = np.argsort(bucket, kind="stable")  # in a bucket: text order, so places are small steps
        cut = np.searchsorted(bucket[o], np.arange(buckets + 1))
        keys, blobs = [], []
        for b in np.flatnonzero(np.diff(cut)).tolist():
            i = o[cut[b] : cut[b + 1]]
            s, c = i[~copy[i]], i[copy[i]]
            keys.append(b)
            blobs.append(_blob(_delta(doc[s]), pos[s].astype(np.int32), num[s].astype(np.uint8), place[s].astype(np.uint8), gather(data, base[s], size[s]), _delta(doc[c]), pos[c].astype(np.int32), num[c].astype(np.uint8)))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def run(it):
        held, n = [], 0
        for b in it:
            ids = b.column(0).cast(pa.int64()).fill_null(NONE).to_numpy()
            data, offs = string_bytes(b.column(1))
            for a, z, d, o, shift in chunks(data, offs):
                row, start, num, place, mini = strings(d, o)
                ok = ids[a:z][row] != NONE
                row, start, num, place, mini = row[ok], start[ok], num[ok], place[ok], mini[ok]
                held.append((ids[a:z][row], start - o[row] + shift, num, place, mini, start + n, num + WIDTH - 1, d))
                n += len(d)
                if n >= BATCH:
                    yield batch(held)
                    held, n = [], 0
        if held:
            yield batch(held)

    return docs.select("doc_id", "text").where("text IS NOT NULL").mapInArrow(run, "bucket long, blob binary")


def repeated(doc: np.ndarray, num: np.ndarray, place: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Flags of all windows of all strings, in order: whether the window starts in a document with a smaller id, too."""
    size = num + WIDTH - 1
    base = np.cumsum(size) - size
    flags = np.zeros(int(num.sum()), bool)
    window = np.cumsum(num) - num
    if not len(doc):
        return flags
    padded = np.concatenate([data, np.zeros(ROW, np.uint8)])
    view8 = np.lib.stride_tricks.sliding_window_view(padded, 8)
    at = [*range(0, SEED - 7, 8), *([SEED - 8] if SEED % 8 else [])]  # the last digit may overlap the one before
    seed = lambda i, k: view8[base[i] + place[i] + k].copy().view(">u8").ravel().astype(np.uint64)
    g = radix_groups(np.zeros(len(doc), np.int64), lambda i, d: seed(i, at[d]) if d < len(at) else None)
    live = np.flatnonzero(g >= 0)
    if not len(live):
        return flags
    # minimisers of one document only repeat nothing
    low, high = np.full(int(g.max()) + 1, np.iinfo(np.int64).max), np.full(int(g.max()) + 1, NONE)
    np.minimum.at(low, g[live], doc[live])
    np.maximum.at(high, g[live], doc[live])
    live = live[low[g[live]] < high[g[live]]]
    live = live[np.argsort(g[live], kind="stable")]
    most, a = 400_000, 0
    ends = np.cumsum(num[live])
    while a < len(live):  # whole minimiser groups, about `most` windows at a time
        z = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "left")) + 1
        while z < len(live) and g[live[z]] == g[live[z - 1]]:
            z += 1
        _group(live[a:z], g, doc, num, place, size, base, window, data, padded, flags)
        a = z
    return flags


def _group(i, g, doc, num, place, size, base, window, data, padded, flags) -> None:
    words = rows_of(data, base[i], size[i])
    shape = num[i].astype(np.uint64) << np.uint64(8) | place[i].astype(np.uint64)
    first = np.unique(g[i], return_inverse=True)[1]
    r = radix_groups(first, lambda j, d: shape[j] if d == 0 else words[j, d - 1] if d <= words.shape[1] else None)
    alone = np.flatnonzero(r < 0)
    r[alone] = (r.max() if len(r) else -1) + 1 + np.arange(len(alone))  # distinct strings
    kind, one, back = np.unique(r, return_index=True, return_inverse=True)
    low = np.full(len(kind), np.iinfo(np.int64).max)
    np.minimum.at(low, back, doc[i])
    # windows of the distinct strings; equal windows have one minimiser at one place
    u = i[one]
    n = num[u]
    owner = np.repeat(np.arange(len(u)), n)
    w_at = np.cumsum(n) - n
    within = np.arange(len(owner)) - w_at[owner]
    start = base[u][owner] + within
    coarse = first[one][owner] * 64 + (place[u][owner] - within)
    view = np.lib.stride_tricks.sliding_window_view(padded, 8)
    tail = np.uint64(((1 << 64) - 1) ^ ((1 << (64 - 8 * (WIDTH % 8))) - 1)) if WIDTH % 8 else np.uint64((1 << 64) - 1)
    last = -(-WIDTH // 8) - 1

    def digit(j, d):
        if d > last:
            return None
        x = view[start[j] + 8 * d].copy().view(">u8").ravel().astype(np.uint64)
        return x & tail if d == last else x

    w = radix_groups(np.unique(coarse, return_inverse=True)[1], digit)
    least = low[owner]
    tied = w >= 0
    if tied.any():
        best = np.full(int(w.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(best, w[tied], least[tied])
        least[tied] = best[w[tied]]
    # back to all strings
    n_all = num[i]
    who = np.repeat(np.arange(len(i)), n_all)
    j = np.arange(len(who)) - np.repeat(np.cumsum(n_all) - n_all, n_all)
    flags[window[i][who] + j] = least[w_at[back[who]] + j] < doc[i][who]


def _spans(sent: DataFrame, homes: int) -> DataFrame:
    """home, blob of (doc, start, end) covered bytes, from a bucket's blobs."""

    def finish(blobs):
        got = [_parts(b, SENT) for b in blobs]
        doc, cdoc = (np.concatenate([np.cumsum(x[k]) for x in got]) for k in (0, 5))
        pos, num, place, data, cpos, cnum = (np.concatenate([x[k] for x in got]) for k in (1, 2, 3, 4, 6, 7))
        pos, num, cnum = pos.astype(np.int64), num.astype(np.int64), cnum.astype(np.int64)
        f = repeated(doc, num, place.astype(np.int64), data)
        who = np.repeat(np.arange(len(doc)), num)
        at = np.arange(len(who)) - np.repeat(np.cumsum(num) - num, num)
        edge = np.ones(len(f), bool)
        edge[1:] = ~f[:-1] | (who[1:] != who[:-1])
        s = np.flatnonzero(f & edge)
        edge = np.ones(len(f), bool)
        edge[:-1] = ~f[1:] | (who[1:] != who[:-1])
        e = np.flatnonzero(f & edge)
        d = np.concatenate([doc[who[s]], cdoc])
        start = np.concatenate([pos[who[s]] + at[s], cpos])
        end = np.concatenate([pos[who[e]] + at[e] + WIDTH, cpos + cnum + WIDTH - 1])
        home = _home(d, homes)
        o = np.lexsort((start, d, home))
        d, start, end, home = d[o], start[o], end[o], home[o]
        cut = np.flatnonzero(np.diff(home)) + 1
        keys, out = [], []
        for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(home)], strict=True):
            if z > a:
                keys.append(int(home[a]))
                out.append(_blob(_delta(d[a:z]), start[a:z].astype(np.int32), (end[a:z] - start[a:z]).astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([NONE] * len(keys), pa.int64()), pa.array(out, pa.binary()), pa.array([0] * len(keys), pa.int32())], ["home", "doc_id", "blob", "kind"])

    def run(it):
        now, held = None, []
        for b in it:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != now and held:
                    yield finish(held)
                    held = []
                now = k
                held.append(x)
        if held:
            yield finish(held)

    return sent.sortWithinPartitions("bucket").mapInArrow(run, "home long, doc_id long, blob binary, kind int")


def _texts(docs: DataFrame, homes: int) -> DataFrame:
    def run(it):
        comp = zstandard.ZstdCompressor(level=3)
        for b in it:
            ids = b.column(0).cast(pa.int64()).fill_null(NONE)
            key = np.array([0 if i == NONE else 1 for i in ids.to_pylist()])
            home = _home(ids.to_numpy(), homes)
            texts = [comp.compress((t or "").encode()) for t in b.column(1).to_pylist()]
            # rows without an id have no spans to meet: they may go anywhere
            home = np.where(key == 1, home, np.arange(len(home)) % homes)
            yield pa.RecordBatch.from_arrays([pa.array(home), ids, pa.array(texts, pa.binary()), pa.array([1] * len(texts), pa.int32())], ["home", "doc_id", "blob", "kind"])

    return docs.select("doc_id", "text").mapInArrow(run, "home long, doc_id long, blob binary, kind int")


def merged(start: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of spans sorted by start."""
    end = np.minimum(end, length)
    ok = start < end
    start, end = start[ok], end[ok]
    if not len(start):
        return start, end
    far = np.maximum.accumulate(end)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > far[:-1]
    i = np.flatnonzero(new)
    return start[i], far[np.concatenate([i[1:] - 1, [len(start) - 1]])]


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of docs (doc_id, text); with_text adds kept (bytes) and spans (array of start, end)."""
    size = input_bytes(bounded_batches(docs))
    conf = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(conf, -(-size // PER_BUCKET))
    parts = max(conf, -(-buckets // 4))
    sent = _send(docs, buckets).repartition(parts, "bucket")
    rows = _spans(sent, buckets).unionByName(_texts(docs, buckets)).repartition(parts, "home").sortWithinPartitions("home", "kind", "doc_id")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept", "spans"] * with_text

    def run(it):
        now, blobs, spans = None, [], None
        decomp = zstandard.ZstdDecompressor()
        for b in it:
            out = [[] for _ in names]
            for home, doc, blob, kind in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if home != now:
                    now, blobs, spans = home, [], None
                if kind == 0:
                    blobs.append(blob)
                    continue
                if spans is None:
                    got = [_parts(x, (np.int64, np.int32, np.int32)) for x in blobs]
                    cat = lambda k: np.concatenate([x[k] for x in got]) if got else np.zeros(0, np.int64)
                    d = np.concatenate([np.cumsum(x[0]) for x in got]) if got else np.zeros(0, np.int64)
                    s = cat(1).astype(np.int64)
                    o = np.lexsort((s, d))
                    spans, blobs = (d[o], s[o], (s + cat(2))[o]), []
                text = decomp.decompress(blob)
                a, z = np.searchsorted(spans[0], [doc, doc + 1]) if doc != NONE else (0, 0)
                start, end = merged(spans[1][a:z], spans[2][a:z], len(text))
                kept, at = [], 0
                for p, q in zip(start.tolist(), end.tolist(), strict=True):
                    kept.append(text[at:p])
                    at = q
                rest = b"".join([*kept, text[at:]])
                row = [None if doc == NONE else doc, len(text), len(text) - len(rest), len(start), hashlib.sha256(rest).hexdigest()]
                if with_text:
                    row += [rest, [{"start": p, "end": q} for p, q in zip(start.tolist(), end.tolist(), strict=True)]]
                for c, v in zip(out, row, strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))] * with_text
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=False)], names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<struct<start: long, end: long>>" * with_text
    return rows.mapInArrow(run, schema)


def op2(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return remove_repeats(table(spark, sf_dir, "documents"))
