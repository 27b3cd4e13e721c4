"""Retrieval for a batch of routed queries: exact, structured, term-scored, fused and distinct hits.

Joins of queries with documents are equi-joins on derived keys (a filter's value, three characters of a name),
followed by the full test; terms reach chunks by inverted lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocab as V
from ..plans.settle import settle
from .inverted import KEY, Computed, Stored, contained, cover_density, grams_held, holding


def _key(kind: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(kind + ":"), value.cast("string")))


FILTERS = ["f_doc_type", "f_doc_number", "f_supplier_name", "f_month", "f_year", "f_amount", "f_gstin"]


def structured(docs: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """query_id, doc_id, place: documents that meet all filters of a query, newest first, at most limit. Queries without a filter have none.

    docs has a row per doc_id. Queries with the same filters are asked once. One meets documents by its most selective filter; a part of a
    name meets the distinct names first, by its rarest three characters, and documents by the whole names that hold it.
    """
    amount = lambda c: F.col(c).cast("decimal(18,2)")
    name, wanted = F.lower("supplier_name"), F.lower("f_supplier_name")
    year, month = F.year("doc_date"), F.month("doc_date")
    both = F.col("f_month").isNotNull() & F.col("f_year").isNotNull()
    kinds = [_key("number", F.col("doc_number")), _key("gst", F.col("gstin")), _key("gst", F.col("buyer_gstin")), _key("amount", amount("amount")), _key("name", name),
             _key("month", F.concat(year, F.lit("-"), month)), _key("year", year), _key("any year", month), _key("type", F.col("doc_type")), F.when(name.isNotNull(), "named")]
    keys = F.array_distinct(F.filter(F.array(*kinds), lambda x: x.isNotNull()))
    d = docs.select("doc_id", "doc_number", "gstin", "buyer_gstin", "amount", "doc_date", "doc_type", "supplier_name", F.explode(keys).alias("k"))
    one = F.coalesce(_key("number", F.col("f_doc_number")), _key("gst", F.col("f_gstin")), _key("amount", amount("f_amount")))
    few = F.when(both, _key("month", F.concat("f_year", F.lit("-"), "f_month")))
    rest = F.coalesce(few, _key("year", F.col("f_year")), _key("any year", F.col("f_month")), _key("type", F.col("f_doc_type")))
    every = queries.select("query_id", F.to_json(F.struct(*FILTERS)).alias("same"), *FILTERS)
    q = every.select(F.col("same").alias("query_id"), *FILTERS).distinct().withColumn("one", one)
    by_name = F.col("one").isNull() & F.coalesce(wanted != "", F.lit(False))
    direct = q.where(~by_name).withColumn("qk", F.coalesce("one", rest, F.when(wanted == "", "named"))).where("qk IS NOT NULL")
    names = docs.select(name.alias("word")).where("word IS NOT NULL").distinct()
    parts = q.where(by_name).select(wanted.alias("term")).distinct().withColumn("piece", F.col("term"))
    pairs = holding(parts, lambda grams: grams_held(names, grams))
    named = q.where(by_name).join(pairs, wanted == F.col("term")).withColumn("qk", _key("name", F.col("word"))).drop("word", "term")
    unless = lambda f, test: F.col(f).isNull() | F.coalesce(test, F.lit(False))
    gst = F.coalesce(F.col("gstin") == F.col("f_gstin"), F.lit(False)) | F.coalesce(F.col("buyer_gstin") == F.col("f_gstin"), F.lit(False))
    ok = (unless("f_doc_number", F.col("doc_number") == F.col("f_doc_number")) & unless("f_gstin", gst) & unless("f_amount", amount("amount") == amount("f_amount"))
          & unless("f_supplier_name", F.contains(name, wanted)) & unless("f_month", month == F.col("f_month")) & unless("f_year", year == F.col("f_year")) & unless("f_doc_type", F.col("doc_type") == F.col("f_doc_type")))
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("doc_date"), "doc_id")
    hits = d.join(direct.unionByName(named), F.col("k") == F.col("qk")).where(ok).select("query_id", "doc_id", "doc_date")
    placed = hits.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select(F.col("query_id").alias("same"), "doc_id", "place")
    return every.select("query_id", "same").join(placed, "same").select("query_id", "doc_id", "place")


def exact(docs: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """query_id, doc_id, lookup_score, place for queries with an identifier: number, file name, labelled numbers, then prefixes.

    Documents are keyed by their names' beginnings of just the lengths that are asked for, so an identifier meets only what begins with it, whatever
    most names begin with.
    """
    low = lambda c: F.lower(F.col(c))
    extra = lambda k: F.try_element_at("extra_fields", F.lit(k))
    i = F.col("identifier")
    asked = settle(queries.where(i.isNotNull() & (i != "")).select("query_id", "identifier", F.lower(i).alias("qk")))
    lengths = sorted(r[0] for r in asked.select(F.length("qk")).distinct().collect())  # a few numbers: lengths of identifiers
    begins = [F.when(F.length(low("source_filename")) >= n, F.substring(low("source_filename"), 1, n)) for n in lengths]
    parts = [F.when(F.substring(low("doc_number"), n + 1, 1) == " ", F.substring(low("doc_number"), 1, n)) for n in lengths]
    whole = [low("doc_number"), *[F.lower(extra(k)) for k in ("invoice no", "invoice number", "ewb no")]]
    keys = F.array_distinct(F.filter(F.array(*whole, *begins, *parts), lambda x: x.isNotNull()))
    d = docs.select("doc_id", "doc_number", "source_filename", extra("invoice no").alias("x1"), extra("invoice number").alias("x2"), extra("ewb no").alias("x3"), F.explode(keys).alias("k"))
    score = (F.when(F.col("doc_number") == i, 1.0).when(F.col("source_filename") == i, 0.98).when(F.col("x1") == i, 0.96).when(F.col("x2") == i, 0.95).when(F.col("x3") == i, 0.9)
             .when(F.startswith(low("doc_number"), F.concat(F.lower(i), F.lit(" "))), 0.88).when(F.startswith(low("source_filename"), F.lower(i)), 0.86))
    hits = d.join(asked, F.col("k") == F.col("qk")).withColumn("lookup_score", score).where("lookup_score IS NOT NULL").select("query_id", "doc_id", "lookup_score").distinct()
    w = Window.partitionBy("query_id").orderBy(F.desc("lookup_score"), "doc_id")
    return hits.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def term_scored(lists: DataFrame | Computed | Stored, queries: DataFrame, allowed: DataFrame | None = None, bound: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, chunk_index, score: 0.8 for a contained term with a digit, 0.18 for another, and the cover density of the text terms' words.

    lists: a table of chunks, or an index over it. Terms are looked for once each, in the vocabulary, whatever the number of queries, and reach
    chunks by postings; covers are swept over the places of the words. Queries of `bound` (query_id) see their `allowed` documents (query_id, doc_id) only.
    """
    lists = Computed(lists) if isinstance(lists, DataFrame) else lists
    phrase = F.lower(X.normal_search("text"))
    asked = F.when(F.size("terms") > 0, F.col("terms")).otherwise(F.filter(F.array(phrase), lambda x: x != ""))
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.array_join("text_terms", " ")), F.lit("[a-z0-9]+"), F.lit(0)))
    q = queries.select("query_id", asked.alias("asked"), words.alias("words"))
    terms = q.select("query_id", F.explode(F.array_distinct("asked")).alias("term"))
    hits = contained(lists, terms, lambda d: only_allowed(d, allowed, bound))
    own = q.select("query_id", F.size("words").alias("n"), F.explode("words").alias("term"))
    at = only_allowed(lists.postings(("search_text",), own.select("term").distinct()).select(*KEY, "term", "places").join(own, "term"), allowed, bound)
    at = at.groupBy("query_id", *KEY, "n").agg(F.collect_list(F.struct("term", "places")).alias("p")).where(F.size("p") == F.col("n"))
    spots = F.flatten(F.transform("p", lambda x: F.transform(x["places"], lambda i: F.struct(i.alias("at"), x["term"].alias("term")))))
    covers = at.select("query_id", *KEY, cover_density(spots, F.col("n")).alias("cover"))
    score = F.col("numeric") * 0.8 + F.col("textual") * 0.18 + F.coalesce("cover", F.lit(0.0))
    return hits.join(covers, ["query_id", *KEY], "left").select("query_id", *KEY, F.round(score, 6).alias("score"))


def only_allowed(scored: DataFrame, allowed: DataFrame | None, restricted: DataFrame | None) -> DataFrame:
    """Hits of restricted queries (query_id) only in their allowed documents (query_id, doc_id); other queries' hits stay."""
    if allowed is None or restricted is None:
        return scored
    free = scored.join(restricted.select("query_id").distinct(), "query_id", "left_anti")
    return free.unionByName(scored.join(allowed.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi").select(*scored.columns))


def fuse(hits: DataFrame, weights: DataFrame) -> DataFrame:
    """query_id, doc_id, chunk_index, score, sources from hits (query_id, doc_id, chunk_index, source, score) and weights (query_id, source, weight).

    Scores are divided by their query's and source's best (1 if that is 0), weighted and summed.
    """
    best = Window.partitionBy("query_id", "source")
    top = F.max("score").over(best)
    part = hits.withColumn("n", F.when(top == 0, 1.0).otherwise(F.col("score") / top)).join(weights.where("weight > 0"), ["query_id", "source"])
    return part.groupBy("query_id", *KEY).agg(F.round(F.sum(F.col("n") * F.col("weight")), 6).alias("score"), F.array_sort(F.collect_set("source")).alias("sources"))


def route_weights(plan: DataFrame) -> DataFrame:
    """query_id, source, weight by the route that is run; the vector source only for semantic queries."""
    table = F.create_map(*[x for r, w in V.ROUTE_WEIGHTS.items() for x in (F.lit(r), F.array(*[F.struct(F.lit(s).alias("source"), F.lit(v).alias("weight")) for s, v in zip(("keyword", "postgres_keyword", "vector"), w, strict=True)]))])
    w = plan.select("query_id", "use_semantic", F.explode(F.element_at(table, F.col("run_route"))).alias("w")).select("query_id", "use_semantic", "w.source", "w.weight")
    return w.where("source <> 'vector' OR use_semantic").drop("use_semantic")


def hydrate(fused: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits with snippet, place and the document's columns; of equal results (path, page, section, type, snippet) the best stays."""
    c = chunks.select(*KEY, "page_number", "section", "evidence_type", X.snippet("chunk_text").alias("snippet"))
    d = docs.select("doc_id", "doc_number", "supplier_name", "doc_type", "doc_date", "amount", "currency", "source_filename", "storage_path", "buyer_name", "po_number", "part_number", "revision", F.array_sort(F.map_entries("extra_fields")).alias("flex_fields"))
    rows = fused.join(c, KEY).join(d, "doc_id")
    w = Window.partitionBy("query_id", "storage_path", "page_number", "section", "evidence_type", "snippet").orderBy(F.desc("score"), *KEY)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k").withColumn("reasons", X.match_reasons(F.col("sources")))


def document_hits(found: DataFrame, firsts: DataFrame, source: str) -> DataFrame:
    """Hits of whole documents (query_id, doc_id, place): their first chunk with score 1."""
    return found.select("query_id", "doc_id").join(firsts.select(*KEY), "doc_id").select("query_id", *KEY, F.lit(1.0).alias("score"), F.array(F.lit(source)).alias("sources"))
