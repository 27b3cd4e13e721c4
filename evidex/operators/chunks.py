"""Evidence chunks of pages: text blocks, lines, table rows, header and item chunks.

Pages are (doc_id, page_number, text). Windows run over the lines of one page, so a page bounds what a
task needs together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.parse import number_text

PAGE = ["doc_id", "page_number"]


def page_lines(pages: DataFrame) -> DataFrame:
    """doc_id, page_number, pos (from 0), line, is_heading, section (the last heading so far, at first `body`)."""
    rows = pages.select(*PAGE, F.posexplode(X.clean_lines("text")).alias("pos", "line")).withColumn("is_heading", X.is_heading(F.col("line")))
    so_far = Window.partitionBy(*PAGE).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.coalesce(F.last(F.when(F.col("is_heading"), F.col("line")), ignorenulls=True).over(so_far), F.lit("body")))


def by_document(pages: DataFrame) -> DataFrame:
    """pages dealt by doc_id into the session's number of partitions: windows, grouping and joins by document or page then need no other exchange.

    The number is given, because the work that follows grows with lines, not with the bytes that adaptive coalescing sees.
    """
    return pages.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def _blocks(ls: Column, limit: int) -> Column:
    """The lines of a page (array of struct(line, is_heading, ...), in order) as an array of blocks.

    A heading starts a block; a line starts one if the block's length, joined by spaces, and the line's exceed limit.
    """
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("starts"))

    def step(s, x):
        size, i = F.length(x["line"]), s["i"] + 1
        new = x["is_heading"] | (s["used"] == 0) | (s["used"] + size > limit)
        return F.struct(i.alias("i"), F.when(new, size).otherwise(s["used"] + 1 + size).alias("used"), F.when(new, F.concat(s["starts"], F.array(i))).otherwise(s["starts"]).alias("starts"))

    def cut(starts):
        return F.transform(starts, lambda s, k: F.slice(ls, s, F.coalesce(F.try_element_at(starts, k + 2), F.size(ls) + 1) - s))

    # a list of one, so that the starts are computed once
    return F.flatten(F.transform(F.array(F.aggregate(ls, zero, step, lambda s: s["starts"])), cut))


def _pieces(lines: Column, chunk_size: int) -> Column:
    """array(struct(pos, text)): lines (struct(pos, line)) packed while they fit chunk_size, a single line always."""
    none = F.array().cast("array<struct<pos:int,text:string>>")
    one = lambda pos, text: F.struct(pos.cast("int").alias("pos"), text.alias("text"))

    def step(done, x):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(last["text"], F.lit("\n"), x["line"])
        fits = (F.size(done) > 0) & (F.length(joined) <= chunk_size)
        return F.when(fits, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(one(last["pos"], joined)))).otherwise(F.concat(done, F.array(one(x["pos"], x["line"]))))

    return F.aggregate(lines, none, step)


def _tokens(c: Column) -> Column:
    return X.word_count(X.squeeze(c))


def _chunk(rows: DataFrame, kind: str) -> DataFrame:
    return rows.select(*PAGE, "pos", "section", "chunk_text", _tokens(F.col("chunk_text")).alias("token_count"), F.lit(kind).alias("evidence_type"))


def _of_lines(builder: int, kind: str, pos: Column, section: Column, text: Column) -> Column:
    return F.struct(F.lit(builder).alias("builder"), F.lit(kind).alias("evidence_type"), pos.alias("pos"), section.alias("section"), text.alias("chunk_text"))


def _text_blocks(ls: Column, limit: int = 320, chunk_size: int = 900) -> Column:
    """Greedy blocks; those over chunk_size are packed again, by length with line breaks."""
    return F.flatten(F.transform(_blocks(ls, limit), lambda b: F.transform(_pieces(b, chunk_size), lambda p: _of_lines(0, "text_chunk", p["pos"], F.get(b, F.lit(0))["section"], p["text"]))))


def _lines(ls: Column) -> Column:
    return F.transform(F.filter(ls, lambda x: x["keep"]), lambda x: _of_lines(1, "line_chunk", x["pos"], x["section"], x["line"]))


def _table_rows(ls: Column) -> Column:
    def ahead(x, i):
        """The lines after place i up to a heading, 6 at most; none where the line is a row by itself."""
        after = F.slice(ls, i + 2, F.when(x["single"], 0).otherwise(6))
        stop = F.array_position(F.transform(after, lambda y: y["is_heading"]), True).cast("int")
        return F.slice(after, 1, F.when(stop > 0, stop - 1).otherwise(6))

    rich = F.transform(ls, lambda x, i: F.when(x["rich"] & (x["single"] | ~x["num"]), F.struct(x.alias("x"), ahead(x, i).alias("next"))))
    rows = F.filter(rich, lambda r: r.isNotNull() & (r["x"]["single"] | (F.size(F.filter(r["next"], lambda y: y["num"])) >= 3)))
    return F.transform(rows, lambda r: _of_lines(2, "table_row", r["x"]["pos"], r["x"]["section"], F.array_join(F.concat(F.array(r["x"]["line"]), F.transform(r["next"], lambda y: y["line"])), "\n")))


def _built(lines: DataFrame, *builders) -> DataFrame:
    """Chunks of all builders from one array of lines a page. Tests of a line are made once, before it is collected."""
    line = F.col("line")
    num, plain = X.has_number(line), ~F.col("is_heading")
    flags = {"keep": plain & (F.length(line) >= 12) & (X.word_count(line) >= 2), "rich": plain & X.is_text_rich(line), "num": num,
             "single": num & (X.has_decimal(line) | (X.number_count(line) >= 2) | X.is_row_section(F.col("section")))}
    ls = F.array_sort(F.collect_list(F.struct("pos", "line", "is_heading", "section", *flags)))
    page = lines.withColumns(flags).groupBy(*PAGE).agg(ls.alias("ls"))
    rows = page.select(*PAGE, F.explode(F.concat(*[b(F.col("ls")) for b in builders])).alias("c")).select(*PAGE, "c.*")
    words = X.word_count(F.translate("chunk_text", "\n", " "))  # lines are squeezed
    return rows.select(*PAGE, "pos", "section", "chunk_text", words.alias("token_count"), "evidence_type", "builder")


def text_chunks(lines: DataFrame, limit: int = 320, chunk_size: int = 900) -> DataFrame:
    """Greedy blocks of a page's lines. Blocks over chunk_size can only be single lines or a heading with one, which are not cut."""
    return _built(lines, lambda ls: _text_blocks(ls, limit, chunk_size)).drop("builder")


def line_chunks(lines: DataFrame) -> DataFrame:
    """Lines of at least 12 characters and 2 words that are no headings."""
    return _built(lines, _lines).drop("builder")


def table_row_chunks(lines: DataFrame) -> DataFrame:
    """Lines that look like table rows, and text lines followed (within 6 lines, up to a heading) by at least 3 lines with numbers, as one chunk."""
    return _built(lines, _table_rows).drop("builder")


def build_chunks(pages: DataFrame) -> DataFrame:
    """All chunks of the pages, first of equal ones (page, section, type, text) kept, numbered from 0 in a document by page, builder and place.

    One exchange, of the pages by document; every document's chunks are made, compared and numbered where they are.
    """
    return number_chunks(_built(page_lines(by_document(pages)), _text_blocks, _lines, _table_rows))


def number_chunks(rows: DataFrame) -> DataFrame:
    same = Window.partitionBy(*PAGE, "section", "evidence_type", "chunk_text").orderBy("builder", "pos")
    order = Window.partitionBy("doc_id").orderBy("page_number", "builder", "pos")
    once = rows.withColumn("k", F.row_number().over(same)).where("k = 1")
    return once.withColumn("chunk_index", (F.row_number().over(order) - 1).cast("int")).select("doc_id", "chunk_index", "page_number", "section", "chunk_text", "token_count", "evidence_type")


def _labelled(pairs: list[tuple[str, Column]]) -> Column:
    return F.concat_ws(" | ", *[F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k}: "), v)) for k, v in pairs])


def default_section(first_page: Column, doc_type: Column) -> Column:
    return F.when(F.contains(F.upper(first_page), F.lit("BILL OF MATERIAL")), "BILL OF MATERIAL").otherwise(F.upper(doc_type))


def header_chunks(meta: DataFrame) -> DataFrame:
    """One header_field chunk per document of meta (metadata columns, extra_fields map, text: its first page)."""
    extra = lambda k: F.try_element_at("extra_fields", F.lit(k))
    pairs = [("Document Type", F.col("doc_type")), ("Document Number", F.col("doc_number")), ("Supplier", F.col("supplier_name")), ("Buyer", F.col("buyer_name")), ("Date", F.col("doc_date").cast("string")),
             ("Amount", F.col("amount").cast("decimal(18,2)").cast("string")), ("Currency", F.col("currency")), ("Part Number", F.col("part_number")), ("Revision", F.col("revision"))]
    pairs += [(k.title(), extra(k)) for k in ("product", "invoice no", "ewb no", "vehicle no", "goods description", "place of supply")]
    rows = meta.select("doc_id", F.lit(1).alias("page_number"), F.lit(0).alias("pos"), default_section(F.col("text"), F.col("doc_type")).alias("section"), _labelled(pairs).alias("chunk_text"))
    return _chunk(rows.where("chunk_text <> ''"), "header_field")


def item_chunks(items: DataFrame, meta: DataFrame) -> DataFrame:
    """A table_row chunk per line item."""
    product = F.coalesce(F.try_element_at("extra_fields", F.lit("product")), F.col("part_number"), F.col("doc_number"))
    m = meta.select("doc_id", product.alias("product"), default_section(F.col("text"), F.col("doc_type")).alias("section"))
    pairs = [("Product", F.col("product")), ("Position", F.col("item_no")), ("Material Code", F.col("part_number")), ("Description", F.col("description")), ("Quantity", number_text(F.col("quantity"))), ("Unit", F.col("unit")), ("Revision", F.col("revision")), ("Note", F.col("remarks"))]
    rows = items.join(m, "doc_id").select("doc_id", F.lit(1).alias("page_number"), F.col("row_no").alias("pos"), "section", _labelled(pairs).alias("chunk_text"))
    return _chunk(rows.where("chunk_text <> ''"), "table_row")
