"""Secret scans: fixed patterns plus a token-efficiency test.

Random strings are cut into short tokens by a vocabulary learned from text, so their characters per token
are few. Candidates are runs of 20 or more characters of [A-Za-z0-9+/_=-] with a digit and a letter. UUIDs
and spans of the patterns are cut out, and what is left on each side is a run of its own. A run with fewer than
max_ratio characters per token is a span of kind `token` (hexadecimal runs, whose digits often share a token, with
fewer than HEX_RATIO times as many); of any other run each part of 20 or more characters between '/', '_', '-' and '='
is scored alone, so words before or behind a random string don't hide it.

Excluded are known digests: hex of a digest's length that a name (sha256-, md5:, checksum, etag, commit ...) stands
before, in the run or within 24 characters of it, and the digests of nothing. Hex of such a length without a name is
not known. Excluded are identifiers, too: runs with a date, and runs of four or more groups between separators of which
none is over 10 characters (part numbers, product keys, ISBNs).

Edge cases: null and empty texts have no spans; texts are scanned whole; repeated rows are scanned each;
further columns are carried along untouched by `scan`.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: Cheap test for ASSIGN: one of its words must be there.
KEYWORDS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run of 24 or more is what [0-9a-f]+ matches there
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PART = re.compile(r"[A-Za-z0-9+]{20,}")
LEAST = 20
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_HEX = r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})"
_NAMES = r"(?:md5|sha-?[0-9]{1,3}|checksum|digest|etag|commit|revision|fingerprint|integrity)(?:sum)?"
DIGEST = re.compile(_HEX, re.A)
NAMED = re.compile(_NAMES + "[-=_]" + _HEX, re.A | re.I)
#: What names a digest, directly before it.
NAME = re.compile(_NAMES + r"[\"']?\s{0,2}[-:=(_]?\s{0,2}[\"']?$", re.A | re.I)
BEFORE = 24
DATE = re.compile(r"(?<![0-9])(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![0-9])")
EMPTY = frozenset(hashlib.new(n).hexdigest() for n in ("md5", "sha1", "sha256", "sha384", "sha512"))
HEXADECIMAL = re.compile(r"[0-9A-Fa-f]+")
HEX_RATIO = 1.15
ORDER = {"assign": 0, "access": 1, "hex": 2, "token": 3}
MAX_RATIO = 2.0

_encoders: dict = {}


def vocabulary(path: str | None = None):
    """A tiktoken encoder of the ranks in path (byte_bpe_50k.tiktoken of the public tokenizers if None); one per process."""
    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path not in _encoders:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def known(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] is a digest with a name, the digest of nothing, or an identifier in groups."""
    run = text[start:end]
    if NAMED.fullmatch(run) or DATE.search(run):
        return True
    if DIGEST.fullmatch(run):
        return run.lower() in EMPTY or NAME.search(text, max(0, start - BEFORE), start) is not None
    groups = re.split(r"[-_/=]+", run.strip("-_/="))
    return len(groups) >= 4 and max(map(len, groups)) <= 10


def random_like(run: str, encoder, max_ratio: float) -> bool:
    if not any(c.isdigit() for c in run) or not any(c.isalpha() for c in run):
        return False
    return len(run) / len(encoder.encode_ordinary(run)) < max_ratio * (HEX_RATIO if HEXADECIMAL.fullmatch(run) else 1)


def token_spans(text: str, taken: list[tuple[str, int, int]], encoder, max_ratio: float = MAX_RATIO) -> list[tuple[str, int, int]]:
    out = []
    for m in RUN.finditer(text):
        cuts = [(a, z) for _, a, z in taken if a < m.end() and m.start() < z]
        cuts += [u.span() for u in UUID.finditer(text, m.start(), m.end())]
        at = m.start()
        for a, z in [*sorted(cuts), (m.end(), m.end())]:
            if a - at >= LEAST:
                run = text[at:a]
                if not known(text, at, a) and random_like(run, encoder, max_ratio):
                    out.append(("token", at, a))
                else:
                    parts = [(at + p.start(), at + p.end()) for p in PART.finditer(run) if p.end() - p.start() < len(run)]
                    out += [("token", b, e) for b, e in parts if not known(text, b, e) and random_like(text[b:e], encoder, max_ratio)]
            at = max(at, z)
    return out


def spans(text: str | None, encoder, max_ratio: float = MAX_RATIO) -> tuple[list, list]:
    """Spans of the patterns and all spans, each as (kind, start, end) by start, then kind."""
    if not text:
        return [], []
    base = base_spans(text)
    key = lambda s: (s[1], ORDER[s[0]])
    return sorted(base, key=key), sorted(base + token_spans(text, base, encoder, max_ratio), key=key)


def digest(found: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def scan(docs: DataFrame, max_ratio: float = MAX_RATIO, vocabulary_path: str | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_assign, n_access, n_hex, n_token, base_sha256, spans. A map over batches; nothing is shuffled."""

    def run(batches):
        encoder = vocabulary(vocabulary_path)
        for b in batches:
            rows = [spans(t, encoder, max_ratio) for t in b.column("text").to_pylist()]
            count = lambda kind: pa.array([sum(s[0] == kind for s in full) for _, full in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), count("assign"), count("access"), count("hex"), count("token"),
                 pa.array([hashlib.sha256(digest(x).encode()).hexdigest() for x, _ in rows], pa.string()), pa.array([digest(full) for _, full in rows], pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_token", "base_sha256", "spans"])

    return bounded_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_token long, base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[SECRET]", max_ratio: float = MAX_RATIO, vocabulary_path: str | None = None) -> DataFrame:
    """docs with every span replaced by mark (overlapping spans by one) and n_chars, if there, brought up to date; no row is lost."""
    names, schema = docs.columns, docs.schema

    def run(batches):
        encoder = vocabulary(vocabulary_path)
        for b in batches:
            texts = []
            for t in b.column("text").to_pylist():
                if found := spans(t, encoder, max_ratio)[1]:
                    out, at = [], 0
                    for _, a, z in found:
                        if a >= at:
                            out += [t[at:a], mark]
                        at = max(at, z)
                    t = "".join(out) + t[at:]
                texts.append(t)
            cols = {n: b.column(n) for n in names}
            cols["text"] = pa.array(texts, b.schema.field("text").type)
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([None if t is None else len(t) for t in texts], b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], names)

    return bounded_batches(docs).mapInArrow(run, schema)


def op6(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return scan(table(spark, sf_dir, "documents"))
