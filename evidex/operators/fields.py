"""Labelled values and document metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parse as P
from ..functions import text as X
from ..functions import vocab as V
from .chunks import by_document, page_lines

LABELS = [a for _, names in V.ALIASES.values() for a in names]


def labelled_values(pages: DataFrame) -> DataFrame:
    """doc_id, pos, label, value, source (inline, next_line, heading) of the lines of one-page documents (doc_id, page_number, text)."""
    order = Window.partitionBy("doc_id").orderBy("page_number", "pos")
    rows = page_lines(pages).select("doc_id", "page_number", "pos", "line")
    ahead = [F.lead("line", k).over(order) for k in (1, 2, 3)]
    rows = rows.withColumn("following", F.coalesce(*[F.when(~x.endswith(":"), x) for x in ahead])).where(~X.is_table_header(F.col("line")))
    line = F.col("line")
    left = X.normal_name(F.split(line, ":", 2)[0])
    right = F.when(F.contains(line, F.lit(":")), X.squeeze(F.split(line, ":", 2)[1]))
    whole = X.normal_name(line)
    colon = right.isNotNull() & X.looks_like_label(left)
    tail = line.endswith(":") & X.looks_like_label(whole)
    rows = rows.withColumn("hit", F.when(colon, F.struct(left.alias("label"), F.when(right != "", right).otherwise(F.col("following")).alias("value"), F.when(right != "", "inline").otherwise("next_line").alias("source")))
        .when(tail, F.struct(whole.alias("label"), F.col("following").alias("value"), F.lit("next_line").alias("source")))
        .when(whole.isin(LABELS), F.struct(whole.alias("label"), F.col("following").alias("value"), F.lit("heading").alias("source"))))
    place = F.row_number().over(order)
    return rows.where("hit.value IS NOT NULL").withColumn("place", place).select("doc_id", F.col("place").alias("pos"), "hit.label", "hit.value", "hit.source")


def _alias_rank(field: str) -> Column:
    """Rank of a label among a field's aliases; null if it is none."""
    names = V.ALIASES[field][1]
    p = F.array_position(X.words_in(names), F.col("label"))
    return F.when(p > 0, p)


def fallbacks(text: Column) -> dict[str, Column]:
    """Values found by pattern anywhere in the text; a total needs a digit."""
    gst = F.regexp_extract_all(F.upper(text), F.lit("[0-9A-Z]{15}"), F.lit(0))
    return {
        "doc_number": X.first_group(text, V.DOC_NUMBER),
        "doc_date": P.parse_date(X.first_group(text, V.DOC_DATE)),
        "gstin": F.try_element_at(gst, F.lit(1)),
        "buyer_gstin": F.try_element_at(gst, F.lit(2)),
        "amount": P.parse_amount(X.first_group(text, [V.TOTAL])),
    }


def metadata(docs: DataFrame) -> DataFrame:
    """docs (doc_id, page_number, text) with doc_type, the canonical fields, sources (map of field to inline, next_line, heading or regex), confidence, extra_fields, missing_fields, field_count.

    Labels of a document are aggregated once: per field the first alias in order of preference, then in order
    of lines. Documents without labels are kept.
    """
    docs = by_document(docs)  # the labels and the join back keep this partitioning
    values = labelled_values(docs)
    active = lambda f: F.col("doc_type").isin([k for k, v in V.ACTIVE.items() if f in v])
    picks = [F.min(F.when(_alias_rank(f).isNotNull(), F.struct(_alias_rank(f).alias("r"), F.col("pos"), F.col("label"), F.col("value"), F.col("source")))).alias(f"_{f}") for f in V.ALIASES]
    found = values.groupBy("doc_id").agg(*picks, F.array_sort(F.collect_list(F.struct("pos", "label", "value"))).alias("_all")).withColumnRenamed("doc_id", "_id")
    d = docs.withColumn("doc_type", P.classify("text")).join(found, F.col("doc_id") == F.col("_id"), "left").drop("_id")
    parsed = {f: F.when(active(f), P.parse_value(kind, F.col(f"_{f}.value"))) for f, (kind, _) in V.ALIASES.items()}
    d = d.withColumns({f"_v_{f}": c for f, c in parsed.items()})
    back = fallbacks(F.col("text"))
    d = d.withColumns({f"_b_{f}": F.when(F.col(f"_v_{f}").isNull(), c) for f, c in back.items()})  # patterns only run where no label gave a value
    final = {f: F.coalesce(F.col(f"_v_{f}"), *([F.col(f"_b_{f}")] if f in back else []), *([F.lit("INR")] if f == "currency" else [])) for f in V.ALIASES}
    source = {f: F.when(F.col(f"_v_{f}").isNotNull(), F.col(f"_{f}.source")).when(F.col(f"_b_{f}").isNotNull() if f in back else F.lit(False), "regex") for f in V.ALIASES}
    pairs = F.filter(F.array(*[F.struct(F.lit(f).alias("k"), c.alias("v")) for f, c in source.items()]), lambda x: x["v"].isNotNull())
    used = F.filter(F.array(*[F.when(F.col(f"_v_{f}").isNotNull(), F.col(f"_{f}.label")) for f in V.ALIASES]), lambda x: x.isNotNull())
    d = d.withColumn("sources", F.map_from_entries(pairs)).withColumn("_used", used)
    rest = F.filter(F.coalesce("_all", F.array().cast("array<struct<pos:int,label:string,value:string>>")), lambda x: ~F.array_contains(F.col("_used"), x["label"]) & ~x["label"].isin(V.SKIP_LABELS))
    d = d.withColumn("_rest", rest).withColumn("_names", F.array_distinct(F.transform("_rest", lambda x: x["label"])))
    first = F.transform("_names", lambda n: F.struct(n.alias("k"), F.element_at(F.filter("_rest", lambda x: x["label"] == n), 1)["value"].alias("v")))
    d = d.withColumn("extra_fields", F.map_from_entries(first)).withColumns(final)
    missing = F.filter(F.array(*[F.when(active(f) & (F.coalesce(F.col(f).cast("string"), F.lit("")) == ""), f) for f in V.ALIASES]), lambda x: x.isNotNull())
    d = d.withColumns({"missing_fields": missing, "field_count": F.size("sources"), "confidence": F.transform_values("sources", lambda k, v: F.when(v == "inline", "high").otherwise("medium"))})
    keep = [*docs.columns, "doc_type", *[f for f in V.ALIASES if f not in docs.columns], "sources", "confidence", "extra_fields", "missing_fields", "field_count"]
    return d.select(*keep)
