"""Prefix trie of conversations by smallest-member ownership.

A node is a distinct sequence of first d turns. It belongs to the smallest conversation that starts with it, so each conversation
owns a (possibly empty) suffix of its path from the root, and one number, the depth where that begins, says which nodes are its
own. Tokens of a subtree, repeats left out, are then sums over the conversations that pass its top, with no walk of the tree.

Edge cases: rows without a conv_id take no part; turns are ordered with null first and ties by the SHA-256 of (role, text), so
repeated rows are turns of their own; null role or text is empty; further columns, whatever their names, are ignored; an empty
table gives no node. Texts are read once, as digests and byte counts, and never shuffled; a long conversation is spread over
partitions. Nodes are told apart by 128 bits of position-wise hashes of SHA-256 digests.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpoint, shuffle_parts, table
from .spread import PART, along, dealt, looked_up

NODE = ["depth", "k1", "k2"]
NOBODY = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame, parts: int) -> DataFrame:
    """conv_id, place (1, 2, ... by turn), digest and bytes of every turn."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    light = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.sha2(F.concat(F.octet_length(part("role")).cast("string"), F.lit(":"), part("role"), part("text")), 256)).alias("digest"),
        F.octet_length(part("text")).cast("long").alias("bytes"))
    order = ["turn", "digest"]
    placed = along(dealt(light, ["conv_id"], order, parts), "conv_id", order, {"place": (F.sum, F.lit(1).cast("long"))})
    return placed.select("conv_id", (F.col("place") + 1).alias("place"), "digest", "bytes")


def grafted(own: DataFrame, convs: DataFrame, family: int = 5, most: int = 8) -> DataFrame:
    """own (of turns) with each conversation c rebuilt: the first h turns of c - c % family, then its own after its first h; h = crc32(c) % (most + 1)."""
    c = F.col("conv_id")
    h = (F.crc32(c.cast("string")) % (most + 1)).cast("long")
    first = F.col("conv_id") % family == 0
    tail = own.where(first | (F.col("place") > h)).select("conv_id", F.lit(1).alias("side"), "place", "digest", "bytes")
    asking = convs.where(~first).select("conv_id", h.alias("h"), (c - c % family).alias("base")).where("h > 0")
    heads = own.where(first & (F.col("place") <= most)).select(F.col("conv_id").alias("base"), "place", "digest", "bytes")
    head = asking.join(heads, "base").where("place <= h").select("conv_id", F.lit(0).alias("side"), "place", "digest", "bytes")
    return tail.unionByName(head)


def occurrences(rows: DataFrame, convs: DataFrame, parts: int) -> DataFrame:
    """A row for each conversation and depth from 0: node key (depth, k1, k2), its parent's p1, p2, bytes of its last text and of the texts before that.

    rows: conv_id, order columns side and place, digest, bytes; convs: every conv_id. A key is the exclusive or of hashes of (depth, digest)
    along the path, so it is a running total like the bytes.
    """
    order = ["side", "place"]
    deep = along(dealt(rows, ["conv_id"], order, parts), "conv_id", order, {"depth": (F.sum, F.lit(1).cast("long"))}).withColumn("depth", F.col("depth") + 1)
    deep = deep.withColumns({f"x{i}": F.xxhash64(F.lit(i), "depth", "digest") for i in (1, 2)})
    deep = along(deep, "conv_id", order, {"p1": (F.bit_xor, F.col("x1")), "p2": (F.bit_xor, F.col("x2")), "before": (F.sum, F.col("bytes"))})
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", *[zero.alias(x) for x in (*NODE, "p1", "p2", "before", "bytes")])
    return checkpoint(deep.select("conv_id", "depth", F.col("p1").bitwiseXOR(F.col("x1")).alias("k1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("k2"), "p1", "p2", "before", "bytes").unionByName(roots))


def ends_digest(ends: DataFrame, parts: int) -> DataFrame:
    """NODE and ends_sha256 of the ascending, comma-joined conv_ids in ends (NODE, conv_id).

    Ids are joined inside range partitions first, so a node where very many conversations end is a string for each partition;
    these are hashed in order, batch by batch, without ever being one string.
    """
    cut = dealt(ends.select(*NODE, "conv_id"), NODE, ["conv_id"], parts)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    pieces = cut.groupBy(PART, *NODE).agg(joined.alias("ids"))

    def run(batches):
        at, held = None, None
        for b in batches:
            done = []
            for *node, ids in zip(*[b.column(c).to_pylist() for c in (*NODE, "ids")], strict=True):
                if node == at:
                    held.update(b"," + ids.encode())
                    continue
                if at is not None:
                    done.append((*at, held.hexdigest()))
                at, held = node, hashlib.sha256(ids.encode())
            yield _batch(done)
        if at is not None:
            yield _batch([(*at, held.hexdigest())])

    def _batch(rows):
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())], [*NODE, "ends_sha256"])

    return bounded_batches(pieces.repartition(*NODE).sortWithinPartitions(*NODE, PART)).mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string")


def trie(conversations: DataFrame, rebuild: bool = True, family: int = 5, most: int = 8) -> DataFrame:
    """A row for each node: conv_id (owner), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 (see the module).

    rebuild: graft heads onto conversations first, as `grafted` says; else conversations are taken as they are. Tokens are UTF-8 bytes of texts.
    """
    parts = shuffle_parts(conversations)
    convs = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    own = turns(conversations, parts)
    rows = grafted(own, convs, family, most) if rebuild else own.withColumn("side", F.lit(1))
    occ = occurrences(rows, convs, parts)
    seen = checkpoint(occ.groupBy(*NODE).agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), *[F.first(c).alias(c) for c in ("p1", "p2", "before")]))
    kids = seen.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    nodes = checkpoint(seen.join(kids, NODE, "left").select(*seen.columns, none("n_children")))
    # what a conversation owns begins at its first own node; it is a leaf's owner if its path's end has no child
    owned = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.min_by("before", "depth").alias("shared"), F.max((F.col("n_children") == 0).cast("int")).alias("leaf"))
    last = F.max_by(F.struct("k1", "k2", (F.col("before") + F.col("bytes")).alias("all")), "depth")
    ends = checkpoint(occ.groupBy("conv_id").agg(last.alias("e"), F.max("depth").alias("depth")).select("conv_id", "depth", "e.*"))
    info = ends.join(owned, "conv_id", "left").select("conv_id", (F.col("depth") + 1).alias("rows"), F.coalesce("shared", "all").alias("shared"), none("leaf"))
    # tokens of a member from here on, less its owned ones from here on
    repeated = F.greatest(F.col("shared") - F.col("before"), F.lit(0))
    sums = looked_up(occ, info, ["conv_id"], "rows").groupBy(*NODE).agg(F.sum("leaf").alias("n_leaves"), F.sum(repeated).alias("saved_tokens"))
    above = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("owner").alias("parent_conv_id"), F.col("n_children").alias("asked"))
    below = looked_up(nodes.where("depth > 0").select(*NODE, "p1", "p2"), above, ["depth", "p1", "p2"], "asked").select(*NODE, "parent_conv_id")
    out = nodes.join(sums, NODE).join(below, NODE, "left").join(ends_digest(ends, parts), NODE, "left")
    whole: list[Column] = [F.col("owner").alias("conv_id"), F.col("depth"), F.col("parent_conv_id"), F.col("n_convs"), F.col("n_children"), F.col("n_leaves").cast("long").alias("n_leaves"), F.col("saved_tokens").cast("long").alias("saved_tokens")]
    return out.select(*whole, F.coalesce("ends_sha256", F.lit(NOBODY)).alias("ends_sha256"))


def op11(spark, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


#: crc32 of a decimal string x, bit by bit.
CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length({x}) + 1), lambda i: [ascii({x}[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, s: CASE WHEN s >= 0 THEN xor(c, s) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295)"
OP11_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS place FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {CRC.format(x="(conv_id::VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
b AS (SELECT c.conv_id, 0 AS side, place, digest, text FROM c JOIN o ON o.conv_id = c.base AND place <= h
  UNION ALL SELECT c.conv_id, 1, place, digest, text FROM c JOIN o ON o.conv_id = c.conv_id AND place > h),
d AS (SELECT conv_id, row_number() OVER w AS depth, octet_length(encode(text)) AS n, string_agg(digest, '') OVER w AS path FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY side, place ROWS UNBOUNDED PRECEDING)),
k AS (SELECT conv_id, depth, n, path, lag(path, 1, '') OVER (PARTITION BY conv_id ORDER BY depth) AS parent FROM d UNION ALL SELECT conv_id, 0, 0, '', NULL FROM c),
n AS (SELECT path, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n FROM k GROUP BY path),
f AS (SELECT n.*, coalesce(x.n_children, 0) AS n_children FROM n LEFT JOIN (SELECT parent, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent) x ON x.parent = n.path),
s AS (SELECT k.path, sum((f.n_convs - 1) * f.n) AS saved, count(*) FILTER (f.n_children = 0) AS leaves FROM f JOIN k ON k.conv_id = f.conv_id AND k.depth <= f.depth GROUP BY k.path),
e AS (SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM (SELECT conv_id, max_by(path, depth) AS path FROM k GROUP BY conv_id) GROUP BY path)
SELECT f.conv_id, f.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM f JOIN s USING (path) LEFT JOIN n p ON p.path = f.parent LEFT JOIN e ON e.path = f.path
"""
