"""Mixing sources to target weights by capped water-filling; DataFrame functions only.

Edge cases: null text has size 0; null sources form one source, ordered last; an empty table gives
an empty mix; repeated rows are separate documents; columns beyond doc_id, text and source are
carried along untouched (working columns have a prefix of their own, so clashing names are safe).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint

P = "_mix_"  # prefix of working columns
MOST_BROADCAST = 50_000  # sources whose row of about 100 bytes each may be broadcast; beyond, both sides are shuffled


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """Per source: size, weight, cap and target.

    sizes: a row per source (source, source_size). All sizes together are shared in proportion to the
    weights, none above max_epochs times its source's size; what a capped source leaves is reshared by
    weight. With sources ordered by cap / weight, the capped ones are a prefix, so the fixed point of the
    resharing is found with running sums and no iteration. The windows run over sources, not documents.
    """
    by_name = Window.orderBy(F.col(f"{P}source").asc_nulls_last())
    w = sizes.withColumn(f"{P}w", F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    w = w.withColumn(f"{P}cap", F.col(f"{P}source_size") * F.lit(max_epochs))
    whole = Window.partitionBy(F.lit(0))
    ratio = Window.partitionBy(F.lit(0)).orderBy((F.col(f"{P}cap") / F.col(f"{P}w")).asc(), F.col(f"{P}source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    w = w.withColumns({f"{P}t": F.sum(f"{P}source_size").over(whole), f"{P}ws": F.sum(f"{P}w").over(whole), f"{P}cc": F.sum(f"{P}cap").over(ratio), f"{P}cw": F.sum(f"{P}w").over(ratio)})
    # level if exactly the sources before this one are capped; the first whose cap lies above it ends the capped prefix
    level = (F.col(f"{P}t") - (F.col(f"{P}cc") - F.col(f"{P}cap"))).cast("double") / (F.col(f"{P}ws") - (F.col(f"{P}cw") - F.col(f"{P}w"))).cast("double")
    w = w.withColumn(f"{P}level", level)
    free = F.col(f"{P}cap").cast("double") >= F.col(f"{P}level") * F.col(f"{P}w")
    w = w.withColumn(f"{P}final", F.min_by(F.when(free, F.col(f"{P}level")), F.when(free, F.col(f"{P}cc"))).over(whole))
    target = F.least(F.col(f"{P}cap").cast("double"), F.coalesce(F.col(f"{P}final") * F.col(f"{P}w"), F.col(f"{P}cap").cast("double")))
    return w.select(f"{P}source", f"{P}source_size", target.alias(f"{P}target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """docs with _mix_size, _mix_source_size, _mix_target and _mix_taken (words taken, repeats counted).

    A source with target t and size s takes each document floor(t / s) times. The rest is one more
    repetition of documents in a seeded random order (md5 of id and seed) until floor(t + 1/2) words are
    reached; the document at that border gives its first words only, so every source meets its target to
    half a word. Sizes are summed by source and first three hex digits of the hash; those 4,096 sums say in
    which group of each source the border lies. Groups before it are taken whole, groups after it not at
    all, so only the border group of each source (about a 4,096th of it) is ordered; no text is shuffled but its.
    """
    row = docs.withColumns({
        f"{P}size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"),
        f"{P}h": F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}"))),
        f"{P}source": F.col("source"),
    })
    row = row.withColumn(f"{P}b", F.substring(f"{P}h", 1, 3))
    parts = checkpoint(row.groupBy(f"{P}source", f"{P}b").agg(F.sum(f"{P}size").alias(f"{P}bs")))
    before = Window.partitionBy(f"{P}source").orderBy(f"{P}b").rowsBetween(Window.unboundedPreceding, -1)
    targets = source_targets(parts.groupBy(f"{P}source").agg(F.sum(f"{P}bs").alias(f"{P}source_size")), weights, max_epochs)
    s = F.col(f"{P}source_size")
    times = F.when(s > 0, F.floor(F.col(f"{P}target") / s)).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn(f"{P}times", times).withColumn(f"{P}rest", F.floor(F.col(f"{P}target") + 0.5).cast("long") - times * s)
    sums = parts.withColumn(f"{P}before", F.coalesce(F.sum(f"{P}bs").over(before), F.lit(0)))
    at = sums.alias("p").join(targets.alias("s"), F.expr(f"p.{P}source <=> s.{P}source")).select(F.col(f"s.{P}source").alias(f"{P}src"), f"{P}source_size", f"{P}target", f"{P}times", f"{P}rest", f"{P}b", f"{P}before", f"{P}bs")
    in_it = (F.col(f"{P}before") < F.col(f"{P}rest")) & (F.col(f"{P}before") + F.col(f"{P}bs") >= F.col(f"{P}rest"))
    edges = checkpoint(at.groupBy(f"{P}src", f"{P}source_size", f"{P}target", f"{P}times", f"{P}rest").agg(F.coalesce(F.min(F.when(in_it, F.col(f"{P}b"))), F.lit("")).alias(f"{P}edge"), F.coalesce(F.min(F.when(in_it, F.col(f"{P}before"))), F.lit(0)).alias(f"{P}edge_before")))
    side = F.broadcast(edges) if edges.count() <= MOST_BROADCAST else edges  # one row per source
    out = row.join(side, F.expr(f"{P}source <=> {P}src"))
    size = F.col(f"{P}size")
    plain = out.where(F.col(f"{P}b") != F.col(f"{P}edge")).withColumn(f"{P}extra", F.when(F.col(f"{P}b") < F.col(f"{P}edge"), size).otherwise(F.lit(0)))
    upto = Window.partitionBy(f"{P}source").orderBy(f"{P}h", "doc_id", f"{P}size").rowsBetween(Window.unboundedPreceding, 0)
    prior = F.col(f"{P}edge_before") + F.sum(f"{P}size").over(upto) - size
    border = out.where(F.col(f"{P}b") == F.col(f"{P}edge")).withColumn(f"{P}extra", F.greatest(F.lit(0), F.least(size, F.col(f"{P}rest") - prior)))
    both = plain.unionByName(border).withColumn(f"{P}taken", F.col(f"{P}times") * size + F.col(f"{P}extra"))
    return both.drop(*[f"{P}{c}" for c in ("src", "times", "rest", "edge", "edge_before", "extra", "b", "h", "source")])


def materialise(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: a row per repetition, with the documents' columns; the last, partial repetition holds its first words.

    Documents without words have nothing to repeat and stay once.
    """
    t, n = F.col(f"{P}taken"), F.col(f"{P}size")
    whole, part = F.when(n > 0, F.floor(t / n)).otherwise(F.lit(1)).cast("int"), F.when(n > 0, t % n).otherwise(F.lit(0))
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    rows = mixed.withColumn(f"{P}cut", F.explode(copies))
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(F.col(f"{P}cut") > 0, F.array_join(F.slice(words, 1, F.greatest(F.lit(1), F.col(f"{P}cut")).cast("int")), "")).otherwise(F.col("text"))
    fixed = {"text": text} | ({"n_chars": F.when(F.col(f"{P}cut") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in columns else {})
    return rows.select(*[fixed[c].alias(c) if c in fixed else F.col(c) for c in columns])


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix of docs as rows of docs' columns."""
    return materialise(mix(docs, **options), docs.columns)


def op7(spark, sf_dir: str) -> DataFrame:
    from .common import table

    m = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return m.select("doc_id", F.col(f"{P}size").alias("size"), F.col(f"{P}source_size").alias("source_size"), F.col(f"{P}target").alias("target"), F.col(f"{P}taken").alias("taken"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':17') AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
c AS (SELECT *, 3 * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS t, CAST(sum(w) OVER () AS BIGINT) AS ws,
  CAST(sum(3 * source_size) OVER r AS BIGINT) AS cc, CAST(sum(w) OVER r AS BIGINT) AS cw
  FROM s WINDOW r AS (ORDER BY CAST(3 * source_size AS DOUBLE) / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, CAST(t - (cc - cap) AS DOUBLE) / CAST(ws - (cw - w) AS DOUBLE) AS level FROM c),
f AS (SELECT min_by(level, cc) AS final FROM l WHERE CAST(cap AS DOUBLE) >= level * w),
g AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(final * w, CAST(cap AS DOUBLE))) AS target FROM l, f),
e AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times,
  sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS prior
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(times * size + greatest(0, least(size, CAST(floor(target + 0.5) AS BIGINT) - times * source_size - prior)) AS BIGINT) AS taken FROM e
"""
