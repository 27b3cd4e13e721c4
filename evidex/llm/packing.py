"""Bounded-space online packing of token sequences.

Every partition keeps a fixed number of open windows. A document's full windows go out at once; its rest
goes to the open window it fits best (least room left). When none fits and no window is unused, the
fullest is filled with the first ids of the rest and emitted, so it needs no padding, and what remains is
placed again. The windows still open at the end of a partition are merged in rounds of a fixed fan-in, by
the same rule; the last ids of all are cut at powers of two, which need no padding.

Edge cases: null and empty texts are the single closing id; repeated rows are packed each; a null doc_id
is kept as null; an empty table gives no pieces; columns beyond doc_id and text are ignored. Texts of any
length are handled in memory one at a time; chunks with a run of over LONG white space characters, where tiktoken's
regular expression runs out of stack, are encoded by the tokenizers library.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpoint

WINDOW, OPEN, FAN_IN, CLOSING = 1024, 32, 64, 0
#: Where GPT-2 style pre-tokens always begin: a space before something that isn't white space.
SPLIT = re.compile(r" (?=\S)")
CACHE, LONG = 100_000, 100_000
LONG_WHITE = re.compile(r"\s{%d}" % LONG)

_tokenizers: dict = {}
_libraries: dict = {}


class _Ids(dict):
    """Chunk of text -> its ids as little-endian unsigned 32-bit bytes; prefix is put before the chunk. Bounded."""

    def __init__(self, encoder, prefix: str, path: str):
        self.encoder, self.prefix, self.path = encoder, prefix, path

    def __missing__(self, chunk: str) -> bytes:
        if len(chunk) > LONG and LONG_WHITE.search(chunk):
            return array("I", library_tokenizer(self.path).encode(self.prefix + chunk, add_special_tokens=False).ids).tobytes()
        ids = array("I", self.encoder.encode_ordinary(self.prefix + chunk)).tobytes()
        if len(chunk) <= 48:
            if len(self) >= CACHE:
                self.clear()
            self[chunk] = ids
        return ids


def library_tokenizer(path: str):
    """The tokenizers library's own, for text without added tokens; one per process."""
    if path not in _libraries:
        from tokenizers import Tokenizer

        _libraries[path] = Tokenizer.from_file(path)
        _libraries[path].encode_special_tokens = True
    return _libraries[path]


def added_tokens(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens", [])
    odd = [x["content"] for x in added if any(x.get(k) for k in ("single_word", "lstrip", "rstrip"))]
    if odd:
        raise ValueError(f"added tokens with single_word, lstrip or rstrip are not supported: {odd}")
    return {x["content"]: x["id"] for x in added}


def byte_level_encoder(path: str):
    """A tiktoken encoder with the vocabulary of a byte-level BPE tokenizer.json: the same ids as the tokenizers library gives (tested), several times faster."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # byte-level vocabularies write printable bytes as themselves and the others as code points from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = {x["content"] for x in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in tok): i for tok, i in spec["model"]["vocab"].items() if tok not in special}
    return tiktoken.Encoding("byte_level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokenizer(path: str | None = None, encode_special_tokens: bool = False):
    """text -> bytes of its ids and the closing id; one per process. Chunks between pre-token borders are cached.

    Strings of added tokens in a text are those tokens' ids, as in the tokenizers library; encode_special_tokens takes them for ordinary text.
    """
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    if (path, encode_special_tokens) not in _tokenizers:
        encoder = byte_level_encoder(path)
        first, later, closing = _Ids(encoder, "", path), _Ids(encoder, " ", path), array("I", [CLOSING]).tobytes()
        added = {} if encode_special_tokens else {k: array("I", [v]).tobytes() for k, v in added_tokens(path).items()}
        # the longest of those that start at one place
        border = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

        def ordinary(text: str) -> list[bytes]:
            parts = SPLIT.split(text)
            return [first[parts[0]] if parts[0] else b"", *[later[p] for p in parts[1:]]]

        def encode(text: str | None) -> bytes:
            if not text:
                return closing
            if not any(k in text for k in added):
                return b"".join([*ordinary(text), closing])
            return b"".join([x for i, p in enumerate(border.split(text)) if p for x in ([added[p]] if i % 2 else ordinary(p))] + [closing])

        _tokenizers[path, encode_special_tokens] = encode
    return _tokenizers[path, encode_special_tokens]


class Packer:
    """Open windows of one partition or merge group; emit(doc_id, start, ids, doc_tokens, sequence, offset) gets finished pieces."""

    def __init__(self, emit, base: int, window: int = WINDOW, opened: int = OPEN):
        self.emit, self.next, self.window, self.opened = emit, base, window, opened
        self.open: list[list] = []  # [used, pieces]

    def sequence(self) -> int:
        self.next += 1
        return self.next - 1

    def close(self, pieces: list) -> None:
        n, at = self.sequence(), 0
        for doc, start, ids, total in pieces:
            self.emit(doc, start, ids, total, n, at)
            at += len(ids) // 4

    def add(self, doc, start: int, ids: bytes, total: int) -> None:
        full = self.window * 4
        at = 0
        while len(ids) - at >= full:
            self.close([(doc, start + at // 4, ids[at : at + full], total)])
            at += full
        ids, start = ids[at:], start + at // 4
        while ids:
            need = len(ids) // 4
            best = None
            for w in self.open:
                if w[0] + need <= self.window and (best is None or w[0] > best[0]):
                    best = w
            if best is None and len(self.open) < self.opened:
                best = [0, []]
                self.open.append(best)
            if best is None:
                best = max(self.open, key=lambda w: w[0])
                need = self.window - best[0]
            best[1].append((doc, start, ids[: need * 4], total))
            best[0] += need
            ids, start = ids[need * 4 :], start + need
            if best[0] == self.window:
                self.close(best[1])
                self.open = [w for w in self.open if w is not best]

    def finish(self) -> None:
        """Pour all open windows into one stream and cut it at the window, its end at powers of two."""
        rest = [p for _, pieces in sorted(self.open, key=lambda w: -w[0]) for p in pieces]
        self.open = []
        left = sum(len(p[2]) // 4 for p in rest)
        while left:
            room = self.window if left >= self.window else 1 << (left.bit_length() - 1)
            left -= room
            pieces = []
            while room:
                doc, start, ids, total = rest[0]
                n = min(room, len(ids) // 4)
                pieces.append((doc, start, ids[: n * 4], total))
                rest[:1] = [(doc, start + n, ids[n * 4 :], total)] if len(ids) > n * 4 else []
                room -= n
            self.close(pieces)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, ids binary"
_FIELDS = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in (x.split()[0] for x in SCHEMA.split(", "))])


class _Rows:
    def __init__(self):
        self.cols: list[list] = [[] for _ in _FIELDS]

    def piece(self, doc, start, ids, total, sequence, offset):
        for c, v in zip(self.cols, (doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset, None, None), strict=True):
            c.append(v)

    def left(self, packer: Packer, part: int):
        for k, (_, pieces) in enumerate(packer.open):
            for doc, start, ids, total in pieces:
                for c, v in zip(self.cols, (doc, start, len(ids) // 4, None, total, k, None, part, ids), strict=True):
                    c.append(v)

    def take(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.cols, _FIELDS, strict=True)], schema=_FIELDS)
        self.cols = [[] for _ in _FIELDS]
        return batch


def pack(docs: DataFrame, window: int = WINDOW, opened: int = OPEN, fan_in: int = FAN_IN, tokenizer_path: str | None = None, encode_special_tokens: bool = False) -> DataFrame:
    """Pieces of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    One pass over the documents without a shuffle; only ids of windows left open (at most `opened` a
    partition) go to the merge, which takes `fan_in` partitions at a time until one group is left. Strings of added tokens get their ids, unless
    encode_special_tokens.
    """
    bounded_batches(docs)

    def first(batches):
        encode, rows, part = tokenizer(tokenizer_path, encode_special_tokens), _Rows(), TaskContext.get().partitionId()
        packer = Packer(rows.piece, part << 32, window, opened)
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encode(text)
                packer.add(doc, 0, ids, len(ids) // 4)
            yield rows.take()
        rows.left(packer, part)
        yield rows.take()

    def merger(level: int, last: bool):
        def merge(key, table):
            rows, group = _Rows(), key[0].as_py()
            packer = Packer(rows.piece, level << 57 | group << 32, window, opened)
            order = lambda x: (x["part"], x["sequence_id"], x["doc_id"] is None, x["doc_id"] or 0, x["start"], x["ids"])
            for x in sorted(table.select(["part", "sequence_id", "start", "doc_id", "ids", "doc_tokens"]).to_pylist(), key=order):
                packer.add(x["doc_id"], x["start"], x["ids"], x["doc_tokens"])
            if last:
                packer.finish()
            rows.left(packer, group)
            return pa.Table.from_batches([rows.take()])

        return merge

    pieces = checkpoint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(first, SCHEMA))
    groups, level = max(1, pieces.rdd.getNumPartitions()), 0
    done = [pieces.where("part IS NULL")]
    left = pieces.where("part IS NOT NULL")
    while True:
        groups, level = -(-groups // fan_in), level + 1
        last = groups == 1
        merged = left.groupBy(F.floor(F.col("part") / fan_in).cast("long").alias("g")).applyInArrow(merger(level, last), SCHEMA)
        if last:
            done.append(merged)
            break
        merged = checkpoint(merged)
        done.append(merged.where("part IS NULL"))
        left = merged.where("part IS NOT NULL")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("part", "ids")


def op5(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return pack(table(spark, sf_dir, "documents"))
