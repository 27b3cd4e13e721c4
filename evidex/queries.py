"""Registered queries of the engine over the test tables, and the same in DuckDB SQL, written independently."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import parse as P
from .functions import text as X
from .functions import vocab as V
from .operators import answer, chunks, evaluate, fields, index, inverted, items, merge, ranges, rerank, retrieve, stores
from .plans import cache, ingest, router, search
from .plans.settle import settle, shared_folder, stored
from .sources.corpus import read_table, rendered
from .streaming import inbox

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- pieces of SQL ----
WS, END = X.WS, X.LINE_END


def lit(v) -> str:
    return "'" + v.replace("'", "''") + "'"


def lst(vs) -> str:
    return "[" + ", ".join(lit(v) for v in vs) + "]"


def sq(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{WS}+', ' ', 'g'))"


def nn(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'))"


def ns(x: str) -> str:
    once = f"regexp_replace(replace(coalesce({x}, ''), ',', ''), '(\\d){WS}+(\\d)', '\\1\\2', 'g')"
    return sq(f"regexp_replace({once}, '(\\d){WS}+(\\d)', '\\1\\2', 'g')")


def wc(x: str) -> str:
    return f"(CASE WHEN {x} = '' THEN 0 ELSE len(string_split({x}, ' ')) END)"


def any_of(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(w)})" for w in words) + ")"


def variants_sql(t: str) -> str:
    parts = f"list_filter(string_split_regex({t}, '[/.-]+'), lambda p: p <> '')"
    dig = f"regexp_replace({t}, '[^0-9.]', '', 'g')"
    return (f"list_concat(CASE WHEN regexp_matches({t}, '[/-]') AND len({parts}) > 1 THEN [array_to_string({parts}, ' '), array_to_string({parts}, '')] ELSE CAST([] AS VARCHAR[]) END,"
            f" CASE WHEN {dig} <> '' AND {dig} <> {t} AND regexp_matches({t}, '\\d') THEN [{dig}] ELSE CAST([] AS VARCHAR[]) END)")


RENDERED = """li AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, p_name FROM lineitem JOIN part ON l_partkey = p_partkey),
it AS (SELECT l_orderkey, count(*) AS n, arg_min(l_suppkey, (l_linenumber, l_partkey, l_suppkey)) AS sk,
  string_agg(CAST(l_linenumber AS VARCHAR) || ' | P-' || lpad(CAST(l_partkey AS VARCHAR), 6, '0') || ' | ' || p_name || ' | ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' | Nos', chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS t FROM li GROUP BY 1),
rd AS (SELECT o_orderkey AS doc_id, o_orderkey % 5 = 0 AS bom, (CASE WHEN o_orderkey % 5 = 0 THEN 'BOM-' ELSE 'INV-' END) || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS doc_number,
  replace(s_name, '#', ' ') AS supplier_name, replace(c_name, '#', ' ') AS buyer_name, CAST(o_orderdate AS DATE) AS doc_date, CAST(o_totalprice AS DECIMAL(14,2)) AS amount, n AS item_count, t
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN it ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = sk),
rendered AS (SELECT *, CASE WHEN bom THEN 'bom' ELSE 'invoice' END AS layout, concat_ws(chr(10), CASE WHEN bom THEN 'BILL OF MATERIAL' ELSE 'TAX INVOICE' END, (CASE WHEN bom THEN 'BOM No: ' ELSE 'Invoice No: ' END) || doc_number,
  'Supplier: ' || supplier_name, 'Buyer Name: ' || buyer_name, 'Invoice Date: ' || strftime(doc_date, '%d/%m/%Y'), 'Item No | Part No | Description | Qty | Unit', t, 'Grand Total: ' || CAST(amount AS VARCHAR)) AS text FROM rd)"""

LINES = f"""ln AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS pos, unnest(ls) AS line FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(coalesce(text, ''), '\\x00', ' ', 'g'), '{END}'), lambda x: {sq('x')}), lambda x: x <> '') AS ls FROM src)),
hd AS (SELECT *, regexp_replace(regexp_replace(lower(line), '^:+', ''), ':+$', '') IN ({', '.join(map(lit, V.HEADINGS))}) OR (upper(line) = line AND lower(line) <> line AND {wc('line')} <= 6) OR (line LIKE '%:' AND {wc('line')} <= 6) AS h FROM ln),
sec AS (SELECT *, coalesce(last_value(CASE WHEN h THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 'body') AS section FROM hd)"""

ROWTEST = f"""(regexp_matches(line, '\\d') AND (regexp_matches(line, '\\d+\\.\\d+') OR len(regexp_extract_all(line, '\\d+(?:\\.\\d+)?')) >= 2 OR {any_of(nn('section'), V.ROW_SECTIONS)}))"""
RICH = "len(regexp_extract_all(line, '[A-Za-z]')) >= 5"


def docs_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page_number"), "text")


DOCS = "src AS (SELECT doc_id, text FROM documents)"


# ---- scalar text functions ----
@query(f"SELECT doc_id, array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(coalesce(text, ''), '\\x00', ' ', 'g'), '{END}'), lambda x: {sq('x')}), lambda x: x <> ''), chr(10)) AS cleaned FROM documents")
def clean_text(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", X.clean_text("text").alias("cleaned"))


@query(f"SELECT s_suppkey AS id, {nn('s_name')} AS normal FROM supplier UNION ALL SELECT p_partkey, {nn('p_name')} FROM part")
def normalize_name(spark, sf):
    return read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), X.normal_name("s_name").alias("normal")).unionByName(read_table(spark, sf, "part").select(F.col("p_partkey").alias("id"), X.normal_name("p_name").alias("normal")))


@query(f"SELECT doc_id, {ns('text')} AS normal FROM documents")
def normalize_search(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", X.normal_search("text").alias("normal"))


@query(f"WITH {RENDERED}, n AS (SELECT doc_id, lower({ns('text')}) AS n FROM rendered), v AS (SELECT doc_id, n, list_distinct(list_filter(flatten(list_transform(regexp_extract_all(n, '[a-z0-9./-]+'), lambda t: {variants_sql('t')})), lambda x: x <> '' AND x <> n)) AS v FROM n) SELECT doc_id, n AS normal, array_to_string(list_sort(v), ' ~ ') AS variants FROM v")
def search_text(spark, sf):
    d = rendered(spark, sf).select("doc_id", F.lower(X.normal_search("text")).alias("normal"), X.search_text("text").alias("s"))
    extra = F.array_except(F.filter(F.array_distinct(F.flatten(F.transform(X.tokens(F.col("normal")), X.variants))), lambda x: x != ""), F.array("normal"))
    return d.select("doc_id", "normal", F.array_join(F.array_sort(extra), " ~ ").alias("variants"))


@query(f"WITH {RENDERED}, n AS (SELECT doc_id, list_filter(regexp_extract_all(lower({ns('text')}), '[a-z0-9./-]+'), lambda t: NOT list_contains({lst(V.SEARCH_STOP)}, t) AND (length(t) >= 3 OR regexp_matches(t, '\\d'))) AS ts FROM rendered), v AS (SELECT doc_id, list_distinct(list_concat(ts, list_filter(flatten(list_transform(ts, lambda t: {variants_sql('t')})), lambda x: length(x) >= 3 OR regexp_matches(x, '\\d')))) AS v FROM n) SELECT doc_id, len(v) AS n_terms, len(list_filter(v, lambda x: regexp_matches(x, '\\d'))) AS n_numeric, array_to_string(list_sort(v), ' ~ ') AS terms FROM v")
def search_terms(spark, sf):
    d = rendered(spark, sf).select("doc_id", X.search_terms("text").alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.size(X.numeric(F.col("t"))).cast("long").alias("n_numeric"), F.array_join(F.array_sort("t"), " ~ ").alias("terms"))


@query(f"SELECT doc_id, CASE WHEN length(s) <= 260 THEN s ELSE rtrim(substring(s, 1, 257)) || '...' END AS snippet FROM (SELECT doc_id, {sq('text')} AS s FROM documents)")
def snippet(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", X.snippet("text").alias("snippet"))


@query(f"WITH {RENDERED} SELECT doc_id, CASE WHEN contains(lower(text), 'bill of material') OR contains(lower(text), chr(10) || 'bom') THEN 'bom' WHEN {any_of('lower(text)', ['tax invoice', 'invoice no', 'invoice number'])} THEN 'invoice' WHEN contains(lower(text), 'receipt') THEN 'receipt' ELSE 'unknown' END AS doc_type FROM rendered UNION ALL SELECT -1 - doc_id, CASE WHEN contains(lower(text), 'bill of material') OR contains(lower(text), chr(10) || 'bom') THEN 'bom' WHEN {any_of('lower(text)', ['tax invoice', 'invoice no', 'invoice number'])} THEN 'invoice' WHEN contains(lower(text), 'receipt') THEN 'receipt' ELSE 'unknown' END FROM documents")
def classify_docs(spark, sf):
    return rendered(spark, sf).select("doc_id", P.classify("text").alias("doc_type")).unionByName(read_table(spark, sf, "documents").select((-1 - F.col("doc_id")).alias("doc_id"), P.classify("text").alias("doc_type")))


SPARK_DATES = ["dd/MM/yyyy", "d-M-yyyy", "dd-MMM-yyyy", "d-MMMM-yyyy", "dd.MM.yyyy", "yyyy-MM-dd", "d MMM yyyy", "dd MMMM yyyy", "d MMM, yyyy", "dd MMMM, yyyy", "MM/yyyy"]


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 10 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS doc_date FROM orders")
def parse_dates(spark, sf):
    o = read_table(spark, sf, "orders")
    shown = functools.reduce(lambda w, kv: w.when(F.col("o_orderkey") % 11 == kv[0], F.date_format("o_orderdate", kv[1])), enumerate(SPARK_DATES[1:], 1), F.when(F.col("o_orderkey") % 11 == 0, F.date_format("o_orderdate", SPARK_DATES[0])))
    return o.select("o_orderkey", P.parse_date(shown).cast("string").alias("doc_date"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS DOUBLE) END AS amount, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS DOUBLE) END AS quantity FROM orders")
def parse_amounts(spark, sf):
    m = F.col("o_totalprice").cast("decimal(14,2)")
    k = F.col("o_orderkey") % 5
    shown = F.when(k == 0, F.concat(F.lit("Rs. "), F.format_number(m, 2))).when(k == 1, F.concat(F.lit("INR "), m.cast("string"))).when(k == 2, F.concat(F.lit("I"), m.cast("string"))).when(k == 3, F.concat(F.lit("item 7: ₹"), F.format_number(m, 2))).otherwise("none")
    plain = F.when(k == 4, "none").otherwise(F.concat(F.format_number(m, 2), F.lit(" Nos of 12")))
    return read_table(spark, sf, "orders").select("o_orderkey", P.parse_amount(shown).alias("amount"), P.parse_quantity(plain).alias("quantity"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE upper(substring(md5(s_name), 1, 15)) END AS gstin FROM supplier")
def parse_gstins(spark, sf):
    g = F.substring(F.md5("s_name"), 1, 15)
    return read_table(spark, sf, "supplier").select("s_suppkey", P.parse_gstin(F.when(F.col("s_suppkey") % 4 == 0, F.lit("GST 27-AB")).otherwise(F.concat(F.lit("gstin "), g, F.lit(" (old)")))).alias("gstin"))


@query("SELECT o_orderkey, to_json({'o_orderkey': o_orderkey, 'amount': CAST(floor(o_totalprice) AS BIGINT), 'day': strftime(o_orderdate, '%Y-%m-%d'), 'note': NULL}) AS js FROM orders")
def json_ready(spark, sf):
    return read_table(spark, sf, "orders").select("o_orderkey", X.json_ready(F.col("o_orderkey"), F.floor("o_totalprice").alias("amount"), F.col("o_orderdate").cast("date").alias("day"), F.lit(None).cast("string").alias("note")).alias("js"))


# ---- chunks ----
@query(f"WITH {DOCS}, {LINES} SELECT doc_id, pos, line, h AS is_heading, section FROM sec")
def page_sections(spark, sf):
    return chunks.page_lines(docs_pages(spark, sf)).select("doc_id", F.col("pos").cast("long").alias("pos"), "line", "is_heading", "section")


@query(f"WITH {DOCS}, {LINES} SELECT doc_id, pos, section, line AS chunk_text, {wc('line')} AS token_count FROM sec WHERE NOT h AND length(line) >= 12 AND {wc('line')} >= 2")
def line_chunks(spark, sf):
    return chunks.line_chunks(chunks.page_lines(docs_pages(spark, sf))).select("doc_id", "pos", "section", "chunk_text", "token_count")


TABLE_ROWS = f"""w AS (SELECT *, list({{'l': line, 'h': h}}) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS nx FROM sec),
w2 AS (SELECT *, list_position(list_transform(coalesce(nx, []), lambda x: x.h), true) AS p FROM w),
w3 AS (SELECT *, list_transform(CASE WHEN p > 0 THEN nx[1:p - 1] ELSE coalesce(nx, []) END, lambda x: x.l) AS follow FROM w2),
tr AS (SELECT doc_id, pos, section, CASE WHEN {ROWTEST} THEN line ELSE array_to_string(list_concat([line], follow), chr(10)) END AS chunk_text FROM w3 WHERE NOT h AND {RICH}
  AND ({ROWTEST} OR (NOT regexp_matches(line, '\\d') AND len(list_filter(follow, lambda x: regexp_matches(x, '\\d'))) >= 3)))"""


@query(f"WITH {RENDERED}, src AS (SELECT doc_id, text FROM rendered), {LINES}, {TABLE_ROWS} SELECT * FROM tr")
def table_rows(spark, sf):
    return chunks.table_row_chunks(chunks.page_lines(rendered(spark, sf))).select("doc_id", "pos", "section", "chunk_text")


@query(f"WITH {DOCS}, {LINES}, {TABLE_ROWS} SELECT * FROM tr")
def table_rows_prose(spark, sf):
    return chunks.table_row_chunks(chunks.page_lines(docs_pages(spark, sf))).select("doc_id", "pos", "section", "chunk_text")


BLOCKS = """RECURSIVE blk AS (SELECT doc_id, pos, 1 AS b, length(line) AS used FROM sec WHERE pos = 0
UNION ALL SELECT s.doc_id, s.pos, CASE WHEN s.h OR used + length(s.line) > 320 THEN b + 1 ELSE b END, CASE WHEN s.h OR used + length(s.line) > 320 THEN length(s.line) ELSE used + 1 + length(s.line) END FROM blk JOIN sec s ON s.doc_id = blk.doc_id AND s.pos = blk.pos + 1)"""


PACKED = """od AS (SELECT blk.doc_id, b, blk.pos, line, section, row_number() OVER (PARTITION BY blk.doc_id, b ORDER BY blk.pos) AS k FROM blk JOIN sec ON sec.doc_id = blk.doc_id AND sec.pos = blk.pos),
pk AS (SELECT doc_id, b, k, pos, line, 1 AS p, length(line) AS u FROM od WHERE k = 1 UNION ALL SELECT o.doc_id, o.b, o.k, o.pos, o.line, CASE WHEN u + 1 + length(o.line) <= 900 THEN p ELSE p + 1 END, CASE WHEN u + 1 + length(o.line) <= 900 THEN u + 1 + length(o.line) ELSE length(o.line) END FROM pk JOIN od o ON o.doc_id = pk.doc_id AND o.b = pk.b AND o.k = pk.k + 1),
sn AS (SELECT doc_id, b, min(section) AS section FROM od GROUP BY 1, 2) SELECT doc_id, min(pos) AS pos, section, string_agg(line, chr(10) ORDER BY k) AS chunk_text FROM pk JOIN sn USING (doc_id, b) GROUP BY doc_id, b, p, section"""


@query(f"WITH RECURSIVE {DOCS}, {LINES}, {BLOCKS.removeprefix('RECURSIVE ')}, {PACKED}")
def text_blocks(spark, sf):
    return chunks.text_chunks(chunks.page_lines(docs_pages(spark, sf))).select("doc_id", F.col("pos").cast("long").alias("pos"), "section", "chunk_text")


@query(f"WITH RECURSIVE {DOCS}, {LINES}, {BLOCKS.removeprefix('RECURSIVE ').replace('320', '4000')}, {PACKED}")
def large_blocks(spark, sf):
    """Blocks of up to 4,000 characters, cut again at 900."""
    return chunks.text_chunks(chunks.page_lines(docs_pages(spark, sf)), limit=4000).select("doc_id", F.col("pos").cast("long").alias("pos"), "section", "chunk_text")


@query(f"""WITH RECURSIVE {RENDERED}, src AS (SELECT doc_id, text FROM rendered), {LINES}, {TABLE_ROWS}, {BLOCKS.removeprefix('RECURSIVE ')},
tb AS (SELECT blk.doc_id, min(blk.pos) AS pos, min(section) AS section, string_agg(line, chr(10) ORDER BY blk.pos) AS chunk_text FROM blk JOIN sec ON sec.doc_id = blk.doc_id AND sec.pos = blk.pos GROUP BY blk.doc_id, b),
u AS (SELECT *, 0 AS o, 'text_chunk' AS evidence_type FROM tb UNION ALL SELECT doc_id, pos, section, line, 1, 'line_chunk' FROM sec WHERE NOT h AND length(line) >= 12 AND {wc('line')} >= 2 UNION ALL SELECT *, 2, 'table_row' FROM tr),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section, evidence_type, chunk_text ORDER BY o, pos) AS r FROM u)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o, pos) - 1 AS chunk_index, section, evidence_type, chunk_text FROM k WHERE r = 1""")
def all_chunks(spark, sf):
    return chunks.build_chunks(rendered(spark, sf)).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "section", "evidence_type", "chunk_text")


# ---- labelled values and metadata ----
def label_ok(x: str) -> str:
    return f"({x} <> '' AND {x} NOT IN ({', '.join(map(lit, V.SKIP_LABELS))}) AND {wc(x)} <= 6 AND NOT regexp_matches({x}, '\\d'))"


LABELLED = f"""la AS (SELECT *, lead(line, 1) OVER o AS n1, lead(line, 2) OVER o AS n2, lead(line, 3) OVER o AS n3 FROM ln WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
lb AS (SELECT doc_id, pos, line, CASE WHEN n1 NOT LIKE '%:' THEN n1 WHEN n2 NOT LIKE '%:' THEN n2 WHEN n3 NOT LIKE '%:' THEN n3 END AS f, {nn('line')} AS whole, {nn("split_part(line, ':', 1)")} AS lft, CASE WHEN contains(line, ':') THEN {sq("substring(line, strpos(line, ':') + 1)")} END AS rgt FROM la
  WHERE NOT (len(string_split({nn('line')}, ' ')) >= 4 AND len(list_filter(string_split({nn('line')}, ' '), lambda t: list_contains({lst(V.TABLE_HEADER)}, t))) >= 4 AND 2 * len(list_filter(string_split({nn('line')}, ' '), lambda t: list_contains({lst(V.TABLE_HEADER)}, t))) >= len(string_split({nn('line')}, ' ')))),
lv AS (SELECT doc_id, pos, CASE WHEN rgt IS NOT NULL AND {label_ok('lft')} THEN lft ELSE whole END AS label,
  CASE WHEN rgt IS NOT NULL AND {label_ok('lft')} THEN CASE WHEN rgt <> '' THEN rgt ELSE f END WHEN line LIKE '%:' AND {label_ok('whole')} THEN f WHEN list_contains({lst(fields.LABELS)}, whole) THEN f END AS value,
  CASE WHEN rgt IS NOT NULL AND {label_ok('lft')} THEN CASE WHEN rgt <> '' THEN 'inline' ELSE 'next_line' END WHEN line LIKE '%:' AND {label_ok('whole')} THEN 'next_line' ELSE 'heading' END AS source FROM lb)"""


@query(f"WITH {RENDERED}, src AS (SELECT doc_id, text FROM rendered), {LINES}, {LABELLED} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS pos, label, value, source FROM lv WHERE value IS NOT NULL")
def labelled_values(spark, sf):
    return fields.labelled_values(rendered(spark, sf)).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {DOCS}, {LINES}, {LABELLED} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS pos, label, value, source FROM lv WHERE value IS NOT NULL")
def labelled_values_prose(spark, sf):
    return fields.labelled_values(docs_pages(spark, sf)).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {RENDERED} SELECT doc_id, layout AS doc_type, doc_number, supplier_name, buyer_name, strftime(doc_date, '%Y-%m-%d') AS doc_date, CAST(amount AS DOUBLE) AS amount, 'INR' AS currency, CASE WHEN bom THEN 'regex' ELSE 'inline' END AS amount_source, CASE WHEN bom THEN 'part_number,revision,plant_code' ELSE 'gstin,buyer_gstin,po_number,payment_terms' END AS missing FROM rendered")
def metadata_fields(spark, sf):
    m = fields.metadata(rendered(spark, sf).select("doc_id", "page_number", "text"))
    active = F.transform(F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f).alias("f")) for i, f in enumerate(["gstin", "buyer_gstin", "po_number", "payment_terms", "part_number", "revision", "plant_code"])]), lambda x: F.array_contains("missing_fields", x["f"])), lambda x: x["f"])
    return m.select("doc_id", "doc_type", "doc_number", "supplier_name", "buyer_name", F.col("doc_date").cast("string").alias("doc_date"), "amount", "currency", F.element_at("sources", "amount").alias("amount_source"), F.array_join(active, ",").alias("missing"))


@query(f"WITH {RENDERED} SELECT doc_id, '1 bom' AS k, 'grand total' AS label, CAST(amount AS VARCHAR) AS value FROM rendered WHERE bom")
def extra_fields(spark, sf):
    m = fields.metadata(rendered(spark, sf).select("doc_id", "page_number", "text"))
    return m.select("doc_id", F.concat(F.size("extra_fields").cast("string"), F.lit(" "), F.col("doc_type")).alias("k"), F.explode("extra_fields").alias("label", "value"))


@query(f"WITH {RENDERED} SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS row_no, CAST(l_linenumber AS VARCHAR) AS item_no, 'P-' || lpad(CAST(l_partkey AS VARCHAR), 6, '0') AS part_number, p_name AS description, CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) AS quantity, 'Nos' AS unit FROM li JOIN rd ON doc_id = l_orderkey WHERE bom")
def line_items(spark, sf):
    d = rendered(spark, sf).where("layout = 'bom'")
    return items.line_items(d.select("doc_id", "text")).select("doc_id", F.col("row_no").cast("long").alias("row_no"), "item_no", "part_number", "description", "quantity", "unit")


@query(f"WITH {RENDERED} SELECT doc_id, CASE WHEN bom THEN 'BILL OF MATERIAL' ELSE 'INVOICE' END AS section, 'Document Type: ' || layout || ' | Document Number: ' || doc_number || ' | Supplier: ' || supplier_name || ' | Buyer: ' || buyer_name || ' | Date: ' || strftime(doc_date, '%Y-%m-%d') || ' | Amount: ' || CAST(amount AS VARCHAR) || ' | Currency: INR' AS chunk_text FROM rendered")
def header_chunks(spark, sf):
    return chunks.header_chunks(fields.metadata(rendered(spark, sf).select("doc_id", "page_number", "text"))).select("doc_id", "section", "chunk_text")


@query(f"WITH {RENDERED} SELECT l_orderkey AS doc_id, 'Product: ' || doc_number || ' | Position: ' || CAST(l_linenumber AS VARCHAR) || ' | Material Code: P-' || lpad(CAST(l_partkey AS VARCHAR), 6, '0') || ' | Description: ' || p_name || ' | Quantity: ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' | Unit: Nos' AS chunk_text FROM li JOIN rd ON doc_id = l_orderkey WHERE bom")
def item_chunks(spark, sf):
    m = fields.metadata(rendered(spark, sf).where("layout = 'bom'").select("doc_id", "page_number", "text"))
    return chunks.item_chunks(items.line_items(m.select("doc_id", "text")), m).select("doc_id", "chunk_text")


# ---- stores ----
@query(f"SELECT sha256({nn('s_name')}) AS supplier_id, {nn('s_name')} AS normalized_name FROM supplier GROUP BY 2")
def supplier_registry(spark, sf):
    s = read_table(spark, sf, "supplier").select(F.col("s_name").alias("name"))
    known = s.limit(0).select(F.lit("").alias("supplier_id"), "name", F.lit("").alias("normalized_name"))
    return stores.register_suppliers(known, s.unionByName(s.select(F.upper("name").alias("name")))).select("supplier_id", "normalized_name")


@query("""WITH RECURSIVE d AS (SELECT doc_id, 'src' || (doc_id % 50) AS doc_number, 'f' || (doc_id % 70) AS source_filename, doc_id % 9 + 1 AS version, doc_id % 2 = 0 AS old FROM documents),
a AS (SELECT doc_number, max(version) AS v FROM d WHERE old GROUP BY 1), b AS (SELECT source_filename, max(version) AS v FROM d WHERE old GROUP BY 1),
n AS (SELECT doc_id, doc_number, source_filename, coalesce(greatest(a.v, b.v), 0) + 1 AS first FROM d LEFT JOIN a USING (doc_number) LEFT JOIN b USING (source_filename) WHERE NOT old),
e AS (SELECT doc_id, lead(doc_id) OVER (PARTITION BY doc_number ORDER BY doc_id) AS then_id FROM n UNION SELECT doc_id, lead(doc_id) OVER (PARTITION BY source_filename ORDER BY doc_id) FROM n),
r AS (SELECT doc_id, first AS version FROM n UNION SELECT e.then_id, r.version + 1 FROM r JOIN e ON e.doc_id = r.doc_id WHERE e.then_id IS NOT NULL)
SELECT doc_id, CAST(max(version) AS BIGINT) AS version FROM r GROUP BY 1""")
def doc_versions(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", F.concat(F.lit("src"), F.col("doc_id") % 50).alias("doc_number"), F.concat(F.lit("f"), F.col("doc_id") % 70).alias("source_filename"), (F.col("doc_id") % 9 + 1).alias("version"))
    return stores.next_versions(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1").drop("version")).select("doc_id", F.col("version").cast("long").alias("version"))


@query("SELECT sha256(text) AS checksum, max(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_docs(spark, sf):
    return stores.find_duplicates(read_table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("checksum"), F.lit(0).alias("created_at")))


@query(f"WITH {RENDERED} SELECT doc_id, doc_number, supplier_name, buyer_name, item_count FROM rendered WHERE doc_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def get_documents(spark, sf):
    """Documents with a returned item, asked for once per such item."""
    asked = read_table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("doc_id"))
    return stores.get_documents(rendered(spark, sf), asked).select("doc_id", "doc_number", "supplier_name", "buyer_name", F.col("item_count").cast("long").alias("item_count"))


@query("""WITH f AS (SELECT doc_id AS n, 'in/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, sha256(text) AS checksum FROM documents),
h AS (SELECT sha256(text) AS checksum, max(doc_id) AS held, arg_max(CASE doc_id % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'processed' ELSE 'partial' END, doc_id) AS st FROM documents WHERE n_chars > 1000 GROUP BY 1),
one AS (SELECT checksum, min(path) AS first FROM f GROUP BY 1), both_ways AS (SELECT unnest([false, true]) AS force),
a AS (SELECT n, path, held, force, CASE WHEN (st = 'processed' AND NOT force) OR path <> first THEN 'duplicate' WHEN held IS NOT NULL AND force THEN 'replace' ELSE 'new' END AS action FROM f LEFT JOIN h USING (checksum) LEFT JOIN one USING (checksum) CROSS JOIN both_ways)
SELECT path, force, action, CASE WHEN action <> 'new' THEN held END AS doc_id, CASE WHEN action = 'duplicate' THEN 'duplicate' WHEN n % 11 = 0 THEN 'failed' WHEN n % 5 <> 0 AND n % 13 <> 0 THEN 'processed' ELSE 'partial' END AS status FROM a""")
def ingest_states(spark, sf):
    """All documents as files of a run, where those over 1,000 characters were stored before in one of three states; without and with force."""
    d = read_table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("checksum"), "n_chars")
    path = F.concat(F.lit("in/"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("path")
    k = F.col("doc_id") % 3
    stored = d.where("n_chars > 1000").select("doc_id", "checksum", F.when(k == 0, "failed").when(k == 1, "processed").otherwise("partial").alias("status"), F.col("doc_id").alias("created_at"))
    results = d.select(path, (F.col("doc_id") % 11 == 0).alias("failed"), F.lit("unreadable").alias("error_message"), (F.col("doc_id") % 5 != 0).alias("vector_ready"), (F.col("doc_id") % 13 != 0).alias("keyword_ready"))
    both = [ingest.outcomes(ingest.planned(d.select(path, "checksum"), stored, f), results).select("path", F.lit(f).alias("force"), "action", "doc_id", "status") for f in (False, True)]
    return both[0].unionByName(both[1])


@query("SELECT k AS doc_id, max(doc_id) AS v FROM (SELECT doc_id, doc_id % 100 AS k FROM documents) GROUP BY 1")
def upsert_latest(spark, sf):
    d = read_table(spark, sf, "documents").select((F.col("doc_id") % 100).alias("doc_id"), F.col("doc_id").alias("v"), F.col("doc_id").alias("updated_at"))
    return stores.upsert_latest(d.where("v % 3 = 0"), d.where("v % 3 <> 0")).select("doc_id", "v")


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'failed' ELSE 'processed' END AS status, CASE WHEN doc_id % 10 = 0 THEN 'bad file' END AS error_message FROM documents")
def update_documents(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", F.lit("processed").alias("status"), F.lit(None).cast("string").alias("error_message"))
    return stores.update_documents(d, d.where("doc_id % 10 = 0").select("doc_id", F.lit("failed").alias("status"), F.lit("bad file").alias("error_message")))


@query("SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS chunk_index, CASE WHEN conv_id % 3 = 0 THEN upper(role) ELSE role END AS role FROM conversations")
def replace_chunks(spark, sf):
    c = read_table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), "role")
    w = Window.partitionBy("doc_id").orderBy("pos")
    old = c.withColumn("chunk_index", (F.row_number().over(w) - 1).cast("int")).drop("pos")
    new = c.where("doc_id % 3 = 0").withColumn("role", F.upper("role"))
    return stores.replace_chunks(old.select("doc_id", "role", "chunk_index"), new).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "role")


@query("""WITH d AS (SELECT doc_id, lang, n_chars, doc_id % 7 AS v FROM documents),
u AS (SELECT doc_id, CASE WHEN doc_id % 20 = 0 AND doc_id % 7 <= 4 THEN 'new' ELSE lang END AS lang, n_chars, CASE WHEN doc_id % 20 = 0 AND v <= 4 THEN 4 ELSE v END AS updated_at FROM d
UNION ALL SELECT -1 - doc_id, 'new', n_chars, 4 FROM d WHERE doc_id % 20 = 0)
SELECT doc_id, lang, n_chars, updated_at, CASE WHEN doc_id % 30 = 0 AND doc_id >= 0 THEN 'failed' ELSE 'processed' END AS status, CASE WHEN doc_id % 30 = 0 AND doc_id >= 0 THEN 'bad file' END AS error_message FROM u WHERE doc_id % 50 <> 0 OR doc_id < 0""")
def kept_documents(spark, sf):
    """All documents as a stored table after an upsert, an update of states and a deletion, each of which rewrites only the buckets that it touches."""
    d = read_table(spark, sf, "documents").select("doc_id", "lang", F.col("n_chars").cast("long").alias("n_chars"), (F.col("doc_id") % 7).alias("updated_at"), F.lit("processed").alias("status"), F.lit(None).cast("string").alias("error_message"))
    table = merge.Kept(spark, f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}", "doc_id long, lang string, n_chars long, updated_at long, status string, error_message string")
    new = d.where("doc_id % 20 = 0").withColumn("updated_at", F.lit(4).cast("long")).withColumn("lang", F.lit("new"))
    table.upsert(d).upsert(new.unionByName(new.withColumn("doc_id", -1 - F.col("doc_id"))))
    table.update(d.where("doc_id % 30 = 0").select("doc_id", F.lit("failed").alias("status"), F.lit("bad file").alias("error_message")))
    return table.delete(d.where("doc_id % 50 = 0").select("doc_id")).rows()


@query("SELECT conv_id AS doc_id, count(*) AS n FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn = 0 AND role = 'system') AND conv_id % 2 = 1 GROUP BY 1")
def delete_documents(spark, sf):
    c = read_table(spark, sf, "conversations").withColumnRenamed("conv_id", "doc_id")
    gone = c.where("(turn = 0 AND role = 'system') OR doc_id % 2 = 0")
    return stores.delete_documents(c, gone).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT conv_id AS doc_id, min(turn) AS chunk_index, arg_min(text, turn) AS text FROM conversations GROUP BY 1")
def first_chunk(spark, sf):
    return stores.first_chunks(read_table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), "text"))


# ---- routing ----
ROUTE_CASES = ["FM-GST-2026-2001", "find me material code for Seat Foam Cushion", "registered office for RIL", "INV-202604-1001", "invoice from ElectroMart India in Apr 2026", "wireless mouse invoice", "which item has the rate of 85000.00?", "TF/2026-27/001",
               "vehicle number for e-way bill TF/2026-27/001", "grand total 351655.36", "271234567890", "premium laptop assembly bom", "balance sheet as on 31-mar-2026", "revenue from operations 4850000", "show invoice total amount 85000.00", ""]
ROUTES = ["exact_match", "lexical", "hybrid", "exact_match", "lexical", "hybrid", "lexical", "exact_match", "exact_match", "lexical", "lexical", "hybrid", "lexical", "lexical", "lexical", "lexical"]


def first_group_sql(x: str, patterns, flags: str = "(?i)") -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({x}, {lit(flags + p)}, 1), '')" for p in patterns) + ")"


MONTH = rf"\b({'|'.join(V.MONTHS)})[a-z]*\s+([0-9]{{4}})\b"
CUT = f"regexp_replace(regexp_replace(replace(trim({first_group_sql('t', V.QUERY_AMOUNT)}), ',', ''), '(?i)^(?:rs\\.?|inr|₹)\\s*', ''), '^I([0-9])', '\\1')"
#: Queries q (query_id, text) to rq: filters, terms, route and the route that is run.
ROUTED = f"""rq0 AS (SELECT query_id, text, coalesce(text, '') AS t, lower(coalesce(text, '')) AS low FROM q),
rq1 AS (SELECT query_id, text, low, CASE WHEN {any_of('low', ['bill of material', 'bom'])} THEN 'bom' WHEN contains(low, 'invoice') THEN 'invoice' END AS f_doc_type, trim({first_group_sql('t', V.QUERY_NUMBER)}) AS f_doc_number,
  nullif(regexp_replace(regexp_extract(t, {lit('(?i)' + V.QUERY_SUPPLIER)}, 1), '^[ .?]+|[ .?]+$', '', 'g'), '') AS f_supplier_name, CAST(nullif(list_position({lst(V.MONTHS)}, regexp_extract(low, {lit(MONTH)}, 1)), 0) AS INTEGER) AS f_month,
  CAST(coalesce(nullif(regexp_extract(low, {lit(MONTH)}, 2), ''), nullif(regexp_extract(low, '\\b(20[0-9]{{2}})\\b', 1), '')) AS INTEGER) AS f_year,
  CASE WHEN ({any_of('low', V.FILTER_TOTAL)} AND NOT {any_of('low', V.FILTER_ROW)}) OR regexp_matches(t, {lit('(?i)' + V.NUMERIC_ONLY)}) THEN CAST(regexp_extract_all({CUT}, '\\d+(?:\\.\\d+)?')[-1] AS DOUBLE) END AS f_amount,
  nullif(regexp_extract(upper(t), '\\b([0-9A-Z]{{15}})\\b', 1), '') AS f_gstin, {any_of('low', V.ROUTER_ROW)} AS row_query, {any_of('low', V.ROUTER_TOTAL)} AS total_query, {wc(sq('text'))} <= 8 AS few FROM rq0),
rq2 AS (SELECT rq1.*, terms, words, list_filter(terms, lambda t: regexp_matches(t, '\\d')) AS nums FROM rq1 JOIN qt USING (query_id)),
rq3 AS (SELECT *, len(nums) AS n, len(words) AS w, len(nums) > 0 AND (row_query OR total_query OR f_gstin IS NOT NULL OR len(nums) >= 2) AS heavy, coalesce(f_supplier_name, CAST(f_month AS VARCHAR), CAST(f_year AS VARCHAR), CAST(f_amount AS VARCHAR), f_gstin) IS NOT NULL AS specific, coalesce(f_doc_type, f_doc_number) IS NOT NULL AS other FROM rq2),
rq4 AS (SELECT *, CASE WHEN f_doc_number IS NOT NULL AND few THEN 'exact_match' WHEN row_query OR heavy OR specific OR (other AND w <= 2) THEN 'lexical' WHEN w >= 2 AND n > 0 THEN 'mixed' WHEN w >= 2 THEN 'hybrid' ELSE 'lexical' END AS route FROM rq3),
rq AS (SELECT *, route IN ('mixed', 'hybrid') AS use_semantic, CASE WHEN route <> 'exact_match' THEN route WHEN w > 0 THEN 'mixed' ELSE 'lexical' END AS run_route FROM rq4)"""
TERMS = f"""qt0 AS (SELECT query_id, text, list_filter(regexp_extract_all(lower({ns('text')}), '[a-z0-9./-]+'), lambda t: NOT list_contains({lst(V.SEARCH_STOP)}, t) AND (length(t) >= 3 OR regexp_matches(t, '\\d'))) AS ts FROM q),
qt1 AS (SELECT query_id, text, list_distinct(list_concat(ts, list_filter(flatten(list_transform(ts, lambda t: {variants_sql('t')})), lambda x: length(x) >= 3 OR regexp_matches(x, '\\d')))) AS terms FROM qt0),
qt AS (SELECT query_id, text, terms, CASE WHEN len(terms) > 0 THEN terms ELSE list_filter([lower({ns('text')})], lambda x: x <> '') END AS asked, list_filter(terms, lambda t: NOT regexp_matches(t, '\\d')) AS words FROM qt1)"""
ROUTE_BATCH = "q AS (SELECT unnest(range(16)) AS query_id, unnest(" + lst(ROUTE_CASES) + """) AS text UNION ALL SELECT 1000000 + o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'show BOM-' ELSE 'show INV-' END || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') FROM orders
UNION ALL SELECT 1000000000 + o_orderkey, 'invoice total ' || CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS VARCHAR) || ' from ' || replace(c_name, '#', ' ') || ' in ' || strftime(o_orderdate, '%b %Y') FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 1000 + item_id, 'tell me about ' || text FROM benchmark)"""


def route_batch(spark, sf):
    """Query batch: the cases, two queries for each order and one for each benchmark item."""
    cases = spark.createDataFrame([(i, t) for i, t in enumerate(ROUTE_CASES)], "query_id long, text string")
    orders = read_table(spark, sf, "orders")
    o = orders.join(read_table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    shown = F.concat(F.when(F.col("o_orderkey") % 5 == 0, "show BOM-").otherwise("show INV-"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"))
    asked = F.concat(F.lit("invoice total "), F.col("o_totalprice").cast("decimal(14,2)").cast("string"), F.lit(" from "), F.regexp_replace("c_name", "#", " "), F.lit(" in "), F.date_format("o_orderdate", "MMM yyyy"))
    b = read_table(spark, sf, "benchmark").select((F.col("item_id") + 1000).alias("query_id"), F.concat(F.lit("tell me about "), "text").alias("text"))
    return cases.unionByName(orders.select((F.col("o_orderkey") + 1_000_000).alias("query_id"), shown.alias("text"))).unionByName(o.select((F.col("o_orderkey") + 1_000_000_000).alias("query_id"), asked.alias("text"))).unionByName(b)


@query(f"WITH {ROUTE_BATCH}, {TERMS}, {ROUTED} SELECT query_id, route, run_route, use_semantic FROM rq")
def route_queries(spark, sf):
    return router.executed(router.routed(route_batch(spark, sf))).select("query_id", "route", "run_route", "use_semantic")


@query(f"WITH {ROUTE_BATCH}, {TERMS}, {ROUTED} SELECT query_id, f_doc_type, f_doc_number, f_supplier_name, f_month, f_year, f_amount, f_gstin FROM rq")
def query_filters(spark, sf):
    return router.with_filters(route_batch(spark, sf)).select("query_id", *router.FILTERS)


# ---- retrieval: a small batch of queries against every rendered document or item row ----
BATCH = [(1, "qty of part P-000017"), (2, "material code P-000123 Nos"), (3, "supplier 000000007 grand total"), (4, "INV-00000501"), (5, "bill of material for customer 000000101"), (6, "invoice total 1234.50"), (7, "the of and"), (8, "part 000000055 nos quantity 12")]
BATCH_SQL = "q(query_id, text) AS (VALUES " + ", ".join(f"({i}, {lit(t)})" for i, t in BATCH) + ")"


def batch(spark) -> DataFrame:
    return spark.createDataFrame(BATCH, "query_id long, text string")


def row_chunks(spark, sf) -> DataFrame:
    """Item rows of all rendered documents as chunks."""
    rows = chunks.table_row_chunks(chunks.page_lines(rendered(spark, sf)))
    return rows.select("doc_id", F.col("pos").alias("chunk_index"), "page_number", "section", "chunk_text", "evidence_type", F.lower(X.normal_search("chunk_text")).alias("search_text"))


ROW_CHUNKS = f"{RENDERED}, src AS (SELECT doc_id, text FROM rendered), {LINES}, {TABLE_ROWS}, ch AS (SELECT doc_id, pos AS chunk_index, section, chunk_text, lower({ns('chunk_text')}) AS search_text FROM tr)"
def scored_sql(p: str, out: str, extra: str = "", where: str = "true") -> str:
    """CTE `out` (query_id, doc_id, chunk_index, score): terms of qt contained in the chunks ch, and cover density by the places of their words.

    For every place of an asked word, the last place so far of each word; a cover begins at the earliest of these, and ends at the first place that gives it.
    """
    return f"""{p}0 AS (SELECT query_id, doc_id, chunk_index, search_text, list_filter(asked, lambda t: contains(lower(search_text), t)) AS hit,
  list_distinct(regexp_extract_all(lower(array_to_string(words, ' ')), '[a-z0-9]+')) AS cw FROM qt, ch WHERE {where} AND len(list_filter(asked, lambda t: contains(lower(search_text), t))) > 0),
{p}1 AS (SELECT query_id, doc_id, chunk_index, len(cw) AS n, unnest(list_filter(list_transform(regexp_extract_all(lower(search_text), '[a-z0-9]+'), lambda x, i: {{'at': i, 'w': x}}), lambda o: list_contains(cw, o.w))) AS o
  FROM {p}0 WHERE len(cw) > 0 AND len(list_filter(cw, lambda w: list_contains(regexp_extract_all(lower(search_text), '[a-z0-9]+'), w))) = len(cw)),
{p}2 AS (SELECT a.query_id, a.doc_id, a.chunk_index, a.n, a.o.at AS r, b.o.w AS w, max(b.o.at) AS last FROM {p}1 a JOIN {p}1 b ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND a.chunk_index = b.chunk_index AND b.o.at <= a.o.at GROUP BY ALL),
{p}3 AS (SELECT query_id, doc_id, chunk_index, r, min(last) AS l FROM {p}2 GROUP BY query_id, doc_id, chunk_index, n, r HAVING count(*) = n),
{p}4 AS (SELECT query_id, doc_id, chunk_index, l, min(r) AS r FROM {p}3 GROUP BY ALL),
{p}5 AS (SELECT c.query_id, c.doc_id, c.chunk_index, 0.1 / (1 + c.r - c.l + 1 - count(*)) AS d FROM {p}4 c JOIN {p}1 a ON a.query_id = c.query_id AND a.doc_id = c.doc_id AND a.chunk_index = c.chunk_index AND a.o.at BETWEEN c.l AND c.r GROUP BY c.query_id, c.doc_id, c.chunk_index, c.l, c.r),
{p}6 AS (SELECT query_id, doc_id, chunk_index, sum(d) AS cover FROM {p}5 GROUP BY ALL),
{out} AS (SELECT query_id, doc_id, chunk_index, round(len(list_filter(hit, lambda x: regexp_matches(x, '\\d'))) * 0.8 + len(list_filter(hit, lambda x: NOT regexp_matches(x, '\\d'))) * 0.18 + coalesce(cover, 0), 6) AS score{extra} FROM {p}0 LEFT JOIN {p}6 USING (query_id, doc_id, chunk_index))"""


SCORED = scored_sql("sc", "sc")


@query(f"WITH {BATCH_SQL}, {ROW_CHUNKS}, {TERMS}, {SCORED}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_index) AS rank FROM sc) SELECT query_id, doc_id, chunk_index, score, rank FROM k WHERE rank <= 20")
def lexical_score(spark, sf):
    c = stored(row_chunks(spark, sf).select(*retrieve.KEY, "search_text"))  # read several times, as a stored corpus is
    scored = retrieve.term_scored(c, settle(router.routed(batch(spark))))
    return index.top_k(scored, 20).withColumn("chunk_index", F.col("chunk_index").cast("long"))


BM25 = f"""bm AS (WITH t AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS w FROM q),
tk AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ts FROM documents), st AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM tk),
p AS (SELECT doc_id, len, w, count(*) AS tf FROM (SELECT doc_id, len(ts) AS len, unnest(ts) AS w FROM tk) GROUP BY 1, 2, 3), df AS (SELECT w, count(*) AS df FROM p GROUP BY 1)
SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score FROM t JOIN p USING (w) JOIN df USING (w), st GROUP BY 1, 2)"""


def whole_docs(spark, sf) -> DataFrame:
    """Every document as one chunk."""
    return read_table(spark, sf, "documents").select("doc_id", F.lit(0).alias("chunk_index"), F.lower(X.normal_search("text")).alias("search_text"))


WHOLE_DOCS = f"ch AS (SELECT doc_id, 0 AS chunk_index, lower({ns('text')}) AS search_text FROM documents)"
TOP20 = "k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc) SELECT query_id, doc_id, score, rank FROM k WHERE rank <= 20"


@query(f"WITH q AS (SELECT item_id AS query_id, text FROM benchmark WHERE item_id % 20 = 0), {WHOLE_DOCS}, {TERMS}, {SCORED}, {TOP20}")
def term_search(spark, sf):
    """Terms of the benchmark items with ids divisible by 20, looked for as parts of words in all documents."""
    q = read_table(spark, sf, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text")
    return index.top_k(retrieve.term_scored(whole_docs(spark, sf), router.routed(q)), 20).drop("chunk_index")


WORDS_3 = "(SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'), lambda x: length(x) BETWEEN 3 AND 6) AS ws FROM documents WHERE doc_id % 20 = 0)"


@query(f"WITH q AS (SELECT doc_id AS query_id, ws[2] || ' ' || ws[3] AS text FROM {WORDS_3} WHERE len(ws) > 2), {WHOLE_DOCS}, {TERMS}, {SCORED}, {TOP20}")
def cover_ranks(spark, sf):
    """Two words of every document whose id is divisible by 20, in all documents: words that occur many times in a text, so it has many covers."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0)), lambda x: F.length(x).between(3, 6))
    q = read_table(spark, sf, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), words.alias("ws")).where(F.size("ws") > 2)
    q = q.select("query_id", F.concat_ws(" ", F.get("ws", F.lit(1)), F.get("ws", F.lit(2))).alias("text"))
    return index.top_k(retrieve.term_scored(whole_docs(spark, sf), router.routed(q)), 20).drop("chunk_index")


@query(f"WITH q AS (SELECT item_id AS query_id, text FROM benchmark), {BM25}, k AS (SELECT query_id, doc_id, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 4) DESC, doc_id) AS rank FROM bm) SELECT * FROM k WHERE rank <= 10")
def bm25_topk(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", F.lit(0).alias("chunk_index"), "text")
    q = read_table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    scored = index.bm25(d, q, {"text": 1.0}).withColumn("score", F.round("score", 4))
    return index.top_k(scored, 10).drop("chunk_index")


@query(SQL["bm25_topk"])
def bm25_bounded(spark, sf):
    """The rows of bm25_topk from ranges with upper bounds."""
    d = read_table(spark, sf, "documents").select("doc_id", F.lit(0).alias("chunk_index"), "text")
    q = read_table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    lists = ranges.ranged(d, ("text",)).write(f"{shared_folder(spark)}/ranges-{uuid.uuid4().hex}")
    return ranges.bounded_top_k(lists, q, 10, {"text": 1.0}, 4).select("query_id", "doc_id", "score", F.col("rank"))


MULTI = """f AS (SELECT p_partkey AS doc_id, unnest(['search_text', 'chunk_text', 'section', 'doc_number', 'supplier_name']) AS field, unnest([4.0, 3.0, 1.5, 2.0, 2.0]) AS boost, unnest([regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+'), regexp_extract_all(lower(p_type), '[a-z0-9]+'), regexp_extract_all(lower(p_brand), '[a-z0-9]+'), ['=' || lower(p_brand)], ['=' || p_name]]) AS ts FROM part),
st AS (SELECT field, count(*) AS n, CASE WHEN field IN ('doc_number', 'supplier_name') THEN 1.0 ELSE avg(len(ts)) END AS mean FROM f GROUP BY 1), t AS (SELECT DISTINCT query_id, unnest(list_append(regexp_extract_all(lower(text), '[a-z0-9]+'), '=' || text)) AS w FROM q),
p AS (SELECT doc_id, field, boost, len, w, count(*) AS tf FROM (SELECT doc_id, field, boost, len(ts) AS len, unnest(ts) AS w FROM f) GROUP BY ALL), df AS (SELECT field, w, count(*) AS df FROM p GROUP BY 1, 2),
b AS (SELECT query_id, doc_id, field, sum(boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS s FROM t JOIN p USING (w) JOIN df USING (field, w) JOIN st USING (field) GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(max(s), 6) AS score FROM b GROUP BY 1, 2))"""


def part_fields(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Parts as chunks of five fields, and queries by name and brand of those whose id is divisible by 20."""
    d = read_table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("chunk_index"), F.concat_ws(" ", "p_name", "p_type").alias("search_text"), F.col("p_type").alias("chunk_text"), F.col("p_brand").alias("section"), F.lower("p_brand").alias("doc_number"), F.col("p_name").alias("supplier_name"))
    own = d.where("doc_id % 20 = 0")
    return d, own.select(F.col("doc_id").alias("query_id"), F.col("supplier_name").alias("text")).unionByName(own.select((-1 - F.col("doc_id")).alias("query_id"), F.col("doc_number").alias("text")))


@query(f"WITH q AS (SELECT p_partkey AS query_id, p_name AS text FROM part WHERE p_partkey % 20 = 0 UNION ALL SELECT -1 - p_partkey, lower(p_brand) FROM part WHERE p_partkey % 20 = 0), {MULTI} SELECT query_id, doc_id, round(score, 4) AS score, rank FROM k WHERE rank <= 10")
def multi_field_topk(spark, sf):
    """Boosted fields, two of which match as whole values only, over the parts."""
    d, q = part_fields(spark, sf)
    one = lambda d, q: index.top_k(index.bm25(d, q).withColumn("score", F.round("score", 6)), 10)
    return index.top_k_of_distinct(d, q, inverted.FIELDS, 10, one).select("query_id", "doc_id", F.round("score", 4).alias("score"), "rank")


@query(SQL["multi_field_topk"])
def multi_field_bounded(spark, sf):
    """The rows of multi_field_topk from ranges with upper bounds, of the best of five fields."""
    d, q = part_fields(spark, sf)
    lists = lambda d: ranges.ranged(d, inverted.FIELDS).write(f"{shared_folder(spark)}/ranges-{uuid.uuid4().hex}")
    return index.top_k_of_distinct(d, q, inverted.FIELDS, 10, lambda d, q: ranges.bounded_top_k(lists(d), q, 10)).select("query_id", "doc_id", F.round("score", 4).alias("score"), "rank")


HASHED = """hv AS (WITH t AS (SELECT id, sha1(unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}'))) AS h FROM hsrc),
s AS (SELECT id, CAST(('0x' || substring(h, 1, 8)) AS BIGINT) % 384 AS slot, sum(CASE WHEN CAST(('0x' || substring(h, 9, 2)) AS BIGINT) % 2 = 0 THEN 1.0 ELSE -1.0 END) AS v FROM t GROUP BY 1, 2)
SELECT id, slot, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS value FROM s WHERE v <> 0)"""


@query(f"WITH hsrc AS (SELECT doc_id AS id, text FROM documents), {HASHED} SELECT id AS doc_id, CAST(slot AS INTEGER) AS slot, round(value, 6) AS value FROM hv")
def hash_embedding(spark, sf):
    return index.hashed(read_table(spark, sf, "documents"), ["doc_id"], "text").select("doc_id", "slot", F.round("value", 6).alias("value"))


@query(f"WITH hsrc AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark), {HASHED}, s AS (SELECT -1 - b.id AS query_id, a.id AS doc_id, round(sum(a.value * b.value), 5) AS score FROM hv a JOIN hv b USING (slot) WHERE a.id >= 0 AND b.id < 0 GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT * FROM k WHERE rank <= 5")
def hashed_topk(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", F.lit(0).alias("chunk_index"), F.col("text").alias("search_text"))
    q = read_table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return index.top_k(index.hashed_search(d, q).withColumn("score", F.round("score", 5)), 5).drop("chunk_index")


@query("WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * list_dot_product(CAST(q AS DOUBLE[]), CAST(q AS DOUBLE[]))), 6) AS score FROM embeddings, q), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT * FROM k WHERE rank <= 10")
def vector_topk(spark, sf):
    """Queries: every row whose id is divisible by 20."""
    e = read_table(spark, sf, "embeddings")
    return index.vector_top_k(e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 10)


QUERIES["vector_topk_all"], SQL["vector_topk_all"] = QUERIES["vector_topk"], SQL["vector_topk"]  # the name it had


@query("WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * list_dot_product(CAST(q AS DOUBLE[]), CAST(q AS DOUBLE[]))), 6) AS score FROM embeddings JOIN q ON vec_id BETWEEN query_id - 25 AND query_id + 25), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT * FROM k WHERE rank <= 10")
def vector_topk_allowed(spark, sf):
    """The same queries, each among the vectors whose ids are at most 25 away."""
    e = read_table(spark, sf, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    near = q.select("query_id", F.explode(F.sequence(F.col("query_id") - 25, F.col("query_id") + 25)).alias("vec_id"))
    return index.vector_top_k(e, q, 10, allowed=near)


def truth_docs(spark, sf, only: DataFrame | None = None) -> DataFrame:
    """Rendered documents (those of only) with their metadata and file names."""
    m = fields.metadata(rendered(spark, sf, only).select("doc_id", "page_number", "text"))
    return m.withColumns({"source_filename": F.concat(F.lower("doc_number"), F.lit(".pdf")), "storage_path": F.concat(F.lit("store/"), "doc_number")})


FILTER_QUERIES = [(1, "invoice from Supplier 000000007 in Mar 1996"), (2, "bom from Supplier 000000011"), (3, "documents in 1999"), (4, "show invoice total amount 153864.67"), (5, "wireless mouse"), (6, "bills in apr 1997")]


@query(f"""WITH {RENDERED}, f(query_id, ty, sup, y, m, am) AS (VALUES (1, 'invoice', 'supplier 000000007', 1996, 3, NULL), (2, 'bom', 'supplier 000000011', NULL, NULL, NULL), (4, 'invoice', NULL, NULL, NULL, 153864.67), (6, NULL, NULL, 1997, 4, NULL) UNION ALL SELECT 1000 + doc_id, layout, lower(supplier_name), year(doc_date), month(doc_date), NULL FROM rendered WHERE doc_id % 20 = 0 UNION ALL SELECT -1000 - doc_id, NULL, substring(lower(supplier_name), 7, 11), NULL, NULL, NULL FROM rendered WHERE doc_id % 20 = 0),
k AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_date DESC, doc_id) AS place FROM f, rendered WHERE (ty IS NULL OR layout = ty) AND (sup IS NULL OR contains(lower(supplier_name), sup)) AND (y IS NULL OR year(doc_date) = y) AND (m IS NULL OR month(doc_date) = m) AND (am IS NULL OR amount = am))
SELECT * FROM k WHERE place <= 200""")
def structured_filter(spark, sf):
    """Typed queries, and two for every document whose id is divisible by 20: its kind, supplier and month, and a part of its supplier's name."""
    d = rendered(spark, sf).where("doc_id % 20 = 0")
    own = d.select((1000 + F.col("doc_id")).alias("query_id"), F.concat_ws(" ", "layout", F.lit("from"), "supplier_name", F.lit("in"), F.date_format("doc_date", "MMM yyyy")).alias("text"))
    part = d.select((-1000 - F.col("doc_id")).alias("query_id"), F.concat(F.lit("papers from "), F.substring(F.lower("supplier_name"), 7, 11)).alias("text"))
    q = spark.createDataFrame(FILTER_QUERIES, "query_id long, text string").unionByName(own).unionByName(part)
    docs = settle(truth_docs(spark, sf).select("doc_id", "doc_number", "gstin", "buyer_gstin", "amount", "doc_date", "doc_type", "supplier_name"))  # read twice, as a stored corpus is
    return retrieve.structured(docs, settle(router.with_filters(q)), 200).withColumn("place", F.col("place").cast("long"))


@query(f"WITH {RENDERED}, q(query_id, i) AS (VALUES (1, 'INV-00000501'), (2, 'BOM-00000505'), (3, 'inv-00000502'), (4, 'INV-000005') UNION ALL SELECT 1000 + doc_id, doc_number FROM rendered WHERE doc_id % 20 = 0 UNION ALL SELECT -1000 - doc_id, lower(doc_number[:11]) FROM rendered WHERE doc_id % 20 = 0), h AS (SELECT query_id, doc_id, CASE WHEN doc_number = i THEN 1.0 WHEN lower(doc_number) || '.pdf' = i THEN 0.98 WHEN starts_with(lower(doc_number) || '.pdf', lower(i)) THEN 0.86 END AS lookup_score FROM q, rendered), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lookup_score DESC, doc_id) AS place FROM h WHERE lookup_score IS NOT NULL) SELECT query_id, doc_id, CAST(lookup_score AS DOUBLE) AS lookup_score, place FROM k WHERE place <= 20")
def exact_lookup(spark, sf):
    """Typed identifiers, and for every document whose id is divisible by 20 its number and the number's first 11 characters."""
    q = spark.createDataFrame([(1, "INV-00000501"), (2, "BOM-00000505"), (3, "inv-00000502"), (4, "INV-000005")], "query_id long, identifier string")
    d = rendered(spark, sf).where("doc_id % 20 = 0")
    q = q.unionByName(d.select((1000 + F.col("doc_id")).alias("query_id"), F.col("doc_number").alias("identifier"))).unionByName(d.select((-1000 - F.col("doc_id")).alias("query_id"), F.lower(F.substring("doc_number", 1, 11)).alias("identifier")))
    return retrieve.exact(truth_docs(spark, sf), q).select("query_id", "doc_id", F.col("lookup_score").cast("double").alias("lookup_score"), F.col("place").cast("long").alias("place"))


@query("""WITH b AS (SELECT event_id % 200 AS query_id, event_id % 1000 AS doc_id, user_id % 5 AS chunk_index, CASE event_id % 3 WHEN 0 THEN 'keyword' WHEN 1 THEN 'postgres_keyword' ELSE 'vector' END AS source, max(abs(value)) AS score FROM events GROUP BY 1, 2, 3, 4),
n AS (SELECT *, CASE WHEN max(score) OVER (PARTITION BY query_id, source) = 0 THEN 1.0 ELSE score / max(score) OVER (PARTITION BY query_id, source) END AS n FROM b)
SELECT query_id, doc_id, chunk_index, round(sum(n * CASE source WHEN 'keyword' THEN 0.2 WHEN 'postgres_keyword' THEN 0.35 ELSE 0.45 END), 6) AS score, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM n GROUP BY 1, 2, 3""")
def fuse_weighted(spark, sf):
    e = read_table(spark, sf, "events")
    s = F.when(F.col("event_id") % 3 == 0, "keyword").when(F.col("event_id") % 3 == 1, "postgres_keyword").otherwise("vector")
    hits = e.groupBy((F.col("event_id") % 200).alias("query_id"), (F.col("event_id") % 1000).alias("doc_id"), (F.col("user_id") % 5).alias("chunk_index"), s.alias("source")).agg(F.max(F.abs("value")).alias("score"))
    plan = hits.select("query_id").distinct().withColumns({"run_route": F.lit("hybrid"), "use_semantic": F.lit(True)})
    return retrieve.fuse(hits, retrieve.route_weights(plan)).withColumn("sources", F.array_join("sources", ","))


HIT_ROWS = f"""{BATCH_SQL}, {ROW_CHUNKS}, {TERMS}, {SCORED}, tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_index) AS r FROM sc) WHERE r <= 40)"""


def row_hits(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Plan, hydrated hits, and what they are made of: chunks, the 40 best of every query, their documents."""
    plan = settle(router.executed(router.routed(batch(spark))))
    c = stored(row_chunks(spark, sf))  # read several times, as a stored corpus is
    top = settle(index.top_k(retrieve.term_scored(c, plan), 40).select("query_id", *retrieve.KEY, "score", F.array(F.lit("postgres_keyword")).alias("sources"), "rank"))
    docs = truth_docs(spark, sf, top.select("doc_id").distinct())
    return plan, retrieve.hydrate(top.drop("rank"), c, docs), c, top, docs


@query(f"WITH {HIT_ROWS}, h AS (SELECT query_id, doc_id, chunk_index, score, CASE WHEN length({sq('chunk_text')}) <= 260 THEN {sq('chunk_text')} ELSE rtrim(substring({sq('chunk_text')}, 1, 257)) || '...' END AS snippet, section, doc_number, supplier_name FROM tp JOIN ch USING (doc_id, chunk_index) JOIN rd USING (doc_id)), k AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_number, section, snippet ORDER BY score DESC, doc_id, chunk_index) AS d FROM h) SELECT query_id, doc_id, chunk_index, score, snippet, doc_number, supplier_name, 'database text match' AS reason, 'store/' || doc_number AS storage_path FROM k WHERE d = 1")
def hydrated_hits(spark, sf):
    h = row_hits(spark, sf)[1]
    return h.select("query_id", "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "score", "snippet", "doc_number", "supplier_name", F.array_join("reasons", ",").alias("reason"), "storage_path")


@query(f"WITH {HIT_ROWS}, d AS (SELECT query_id, doc_id, min(chunk_index) AS fc FROM (SELECT * FROM tp WHERE r <= 3) t JOIN (SELECT doc_id, min(chunk_index) AS chunk_index FROM ch GROUP BY 1) f USING (doc_id) GROUP BY 1, 2)" .replace("min(chunk_index) AS fc", "min(f.chunk_index) AS fc") + f""",
h AS (SELECT query_id, doc_id, chunk_index, score FROM (SELECT tp.*, row_number() OVER (PARTITION BY query_id, tp.doc_id, section, {sq('chunk_text')} ORDER BY score DESC, chunk_index) AS dd FROM tp JOIN ch USING (doc_id, chunk_index)) WHERE dd = 1),
m AS (SELECT query_id, doc_id, chunk_index, round(score + 0.08, 4) AS score, 1 AS o FROM h SEMI JOIN d USING (query_id, doc_id) UNION ALL SELECT query_id, doc_id, chunk_index, score, 1 FROM h ANTI JOIN d USING (query_id, doc_id) UNION ALL SELECT query_id, doc_id, fc, 1.18, 0 FROM d),
s AS (SELECT m.*, section, {sq('chunk_text')} AS sn FROM m JOIN ch USING (doc_id, chunk_index))
SELECT query_id, doc_id, arg_min(chunk_index, (o, chunk_index)) AS chunk_index, max(score) AS score FROM s GROUP BY query_id, doc_id, section, sn""")
def structured_merge(spark, sf):
    _, h, c, top, docs = row_hits(spark, sf)
    found = top.where("rank <= 3").select("query_id", "doc_id").distinct()
    firsts = stores.first_chunks(c.select("doc_id", "chunk_index", "page_number").join(found, "doc_id", "left_semi"))
    whole = retrieve.hydrate(retrieve.document_hits(found, firsts, "structured"), c, docs)
    return rerank.merge(h, whole, 0.18, "structured", "structured metadata filter").select("query_id", "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "score")


RERANKED = f"""hx AS (SELECT query_id, doc_id, chunk_index, score, {sq('chunk_text')} AS snippet, section, doc_number, supplier_name, buyer_name, layout, doc_date, amount FROM tp JOIN ch USING (doc_id, chunk_index) JOIN rendered USING (doc_id)),
hy AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_number, section, snippet ORDER BY score DESC, doc_id, chunk_index) AS d FROM hx) WHERE d = 1),
hz AS (SELECT hy.*, qt.text AS q_text, terms, words, list_filter(terms, lambda t: regexp_matches(t, '\\d')) AS nums, lower({ns("concat_ws(' ', snippet, doc_number, supplier_name, 'table_row', lower(doc_number) || '.pdf', section, layout, doc_number, supplier_name, strftime(doc_date, '%Y-%m-%d'), CAST(CAST(amount AS DOUBLE) AS VARCHAR), 'INR', buyer_name)")}) AS hay,
  {any_of('lower(qt.text)', V.ROUTER_ROW)} AS row_query, list_filter(regexp_extract_all(regexp_extract(lower({ns('snippet')}), '^[^0-9]*'), '[a-z]+'), lambda w: NOT list_contains({lst(V.ROW_CONTEXT_STOP)}, w)) AS ctxw, regexp_extract_all(regexp_extract(lower({ns('snippet')}), '^[^0-9]*'), '[a-z]+') AS ctxa FROM hy JOIN qt USING (query_id)),
hn AS (SELECT *, len(list_filter(nums, lambda t: contains(hay, t))) AS n, len(list_filter(words, lambda t: contains(hay, t))) AS t, CASE WHEN len(ctxw) >= 2 THEN 0.28 WHEN len(ctxw) = 1 THEN 0.08 WHEN len(ctxa) > 0 THEN -0.16 ELSE -0.2 END AS ctx FROM hz),
hs AS (SELECT *, round(score + round(n * 0.14 + t * 0.05, 4) + CASE WHEN run_route = 'lexical' THEN n * 0.22 + least(0.18, t * 0.06) WHEN run_route = 'mixed' THEN n * 0.18 + least(0.16, t * 0.05) ELSE n * 0.08 + least(0.12, t * 0.04) END + CASE WHEN row_query THEN ctx + 0.24 + CASE WHEN n > 0 THEN 0.18 ELSE 0 END ELSE 0 END, 4) AS final FROM hn JOIN rt USING (query_id)),
hr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN row_query THEN ctx ELSE 0.0 END DESC, final DESC, doc_id, chunk_index) AS rank FROM hs)"""
RUN_ROUTES = "rt(query_id, run_route) AS (VALUES (1, 'lexical'), (2, 'lexical'), (3, 'lexical'), (4, 'lexical'), (5, 'lexical'), (6, 'lexical'), (7, 'lexical'), (8, 'lexical'))"


@query(f"WITH {HIT_ROWS}, {RUN_ROUTES}, {RERANKED} SELECT query_id, doc_id, chunk_index, round(final, 3) AS score, rank FROM hr WHERE rank <= 10")
def reranked(spark, sf):
    plan, h, *_ = row_hits(spark, sf)
    return rerank.rerank(h, plan, 10).select("query_id", "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.round("score", 3).alias("score"), "rank")


# ---- the whole search, and its stages, over the rendered corpus ----
SEARCH_BATCH = [(1, "INV-00000501"), (2, "vehicle number for BOM-00000505"), (3, "invoice from Supplier 000000007 in Mar 1996"), (4, "bom from Supplier 000000003"), (5, "material code for small ring P-000000"), (6, "qty of part P-000017"),
                (7, "show invoice total amount 153864.67"), (8, "blue bolt and hot gear details"), (9, "red widget packing note batch 77"), (10, "the of and"), (11, "zzzz qqqq"), (12, "Customer 000000101 grand total"), (13, "hot gear"), (14, "INV-99999999")]
SEARCH_Q = "q(query_id, text) AS (VALUES " + ", ".join(f"({i}, {lit(t)})" for i, t in SEARCH_BATCH) + ")"
WITHOUT = "list_filter(list_filter({x}, lambda x, i: list_position({x}, x) = i), lambda x: x <> '' AND x <> n)"  # first occurrences, in order
CORPUS = f"""{RENDERED}, src AS (SELECT doc_id, text FROM rendered), {LINES}, {TABLE_ROWS}, {BLOCKS.removeprefix('RECURSIVE ')},
tb AS (SELECT blk.doc_id, min(blk.pos) AS pos, min(section) AS section, string_agg(line, chr(10) ORDER BY blk.pos) AS chunk_text FROM blk JOIN sec ON sec.doc_id = blk.doc_id AND sec.pos = blk.pos GROUP BY blk.doc_id, b),
bu AS (SELECT *, 0 AS o, 'text_chunk' AS evidence_type FROM tb UNION ALL SELECT doc_id, pos, section, line, 1, 'line_chunk' FROM sec WHERE NOT h AND length(line) >= 12 AND {wc('line')} >= 2 UNION ALL SELECT *, 2, 'table_row' FROM tr),
bk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, section, evidence_type, chunk_text ORDER BY o, pos) AS r FROM bu) WHERE r = 1),
ex AS (SELECT doc_id, 3 AS o, 0 AS pos, CASE WHEN bom THEN 'BILL OF MATERIAL' ELSE 'INVOICE' END AS section, 'header_field' AS evidence_type, 'Document Type: ' || layout || ' | Document Number: ' || doc_number || ' | Supplier: ' || supplier_name || ' | Buyer: ' || buyer_name || ' | Date: ' || strftime(doc_date, '%Y-%m-%d') || ' | Amount: ' || CAST(amount AS VARCHAR) || ' | Currency: INR' AS chunk_text FROM rendered
  UNION ALL SELECT l_orderkey, 4, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity), 'BILL OF MATERIAL', 'table_row', 'Product: ' || doc_number || ' | Position: ' || CAST(l_linenumber AS VARCHAR) || ' | Material Code: P-' || lpad(CAST(l_partkey AS VARCHAR), 6, '0') || ' | Description: ' || p_name || ' | Quantity: ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' | Unit: Nos' FROM li JOIN rd ON doc_id = l_orderkey WHERE bom),
c0 AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o, pos) - 1 AS chunk_index, section, evidence_type, chunk_text FROM (SELECT doc_id, o, pos, section, evidence_type, chunk_text FROM bk UNION ALL SELECT * FROM ex)),
c1 AS (SELECT c0.*, lower({ns("doc_number || ' ' || supplier_name || ' ' || section || ' ' || chunk_text")}) AS n FROM c0 JOIN rd USING (doc_id)),
c2 AS (SELECT *, flatten(list_transform(regexp_extract_all(n, '[a-z0-9./-]+'), lambda t: {variants_sql('t')})) AS v FROM c1),
ch AS MATERIALIZED (SELECT doc_id, chunk_index, section, evidence_type, chunk_text, rtrim(n || ' ' || array_to_string({WITHOUT.format(x='v')}, ' ')) AS search_text, {sq('chunk_text')} AS sq FROM c2),
cs AS MATERIALIZED (SELECT doc_id, chunk_index, section, evidence_type, CASE WHEN length(sq) <= 260 THEN sq ELSE rtrim(substring(sq, 1, 257)) || '...' END AS snippet FROM ch)"""
SCOPE = f"""fa AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_date DESC, doc_id) AS place FROM rq, rendered WHERE route <> 'exact_match' AND coalesce(f_doc_type, f_doc_number, f_supplier_name, CAST(f_month AS VARCHAR), CAST(f_year AS VARCHAR), CAST(f_amount AS VARCHAR), f_gstin) IS NOT NULL AND f_gstin IS NULL AND (f_doc_number IS NULL OR doc_number = f_doc_number)
  AND (f_doc_type IS NULL OR layout = f_doc_type) AND (f_supplier_name IS NULL OR contains(lower(supplier_name), lower(f_supplier_name))) AND (f_year IS NULL OR year(doc_date) = f_year) AND (f_month IS NULL OR month(doc_date) = f_month) AND (f_amount IS NULL OR amount = CAST(f_amount AS DECIMAL(18,2)))),
al AS (SELECT * FROM fa WHERE place <= 200),
xa AS (SELECT query_id, doc_id, CASE WHEN doc_number = f_doc_number THEN 1.0 WHEN lower(doc_number) || '.pdf' = f_doc_number THEN 0.98 WHEN starts_with(lower(doc_number) || '.pdf', lower(f_doc_number)) THEN 0.86 END AS ls FROM rq, rendered WHERE route = 'exact_match'),
xd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ls DESC, doc_id) AS place FROM xa WHERE ls IS NOT NULL) WHERE place <= 20),
ok AS (SELECT query_id, doc_id FROM al UNION ALL SELECT query_id, doc_id FROM xd),
bo AS (SELECT query_id FROM rq WHERE route = 'exact_match' OR coalesce(f_doc_type, f_doc_number, f_supplier_name, CAST(f_month AS VARCHAR), CAST(f_year AS VARCHAR), CAST(f_amount AS VARCHAR), f_gstin) IS NOT NULL)"""
INSIDE = "(query_id NOT IN (SELECT query_id FROM bo) OR (query_id, doc_id) IN (SELECT query_id, doc_id FROM ok))"
SOURCES = f"""kq AS (SELECT query_id, CASE WHEN len(terms) > 0 THEN array_to_string(terms, ' ') ELSE {ns('text')} END AS kt FROM qt), kw AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(kt), '[a-z0-9]+')) AS w FROM kq),
ft AS (SELECT doc_id, chunk_index, field, boost, regexp_extract_all(lower(v), '[a-z0-9]+') AS ts FROM (SELECT doc_id, chunk_index, unnest(['a', 'b', 'c']) AS field, unnest([4.0, 3.0, 1.5]) AS boost, unnest([search_text, chunk_text, section]) AS v FROM ch)),
fs AS (SELECT field, count(*) AS nd, avg(len(ts)) AS mean FROM ft GROUP BY 1),
fp AS (SELECT doc_id, chunk_index, field, boost, len, w, count(*) AS tf FROM (SELECT doc_id, chunk_index, field, boost, len(ts) AS len, unnest(ts) AS w FROM ft) WHERE w IN (SELECT w FROM kw) GROUP BY ALL), fd AS (SELECT field, w, count(*) AS df FROM fp GROUP BY 1, 2),
s1 AS (SELECT query_id, doc_id, chunk_index, round(max(s), 6) AS score, 'keyword' AS source FROM (SELECT query_id, doc_id, chunk_index, field, sum(boost * ln(1 + (nd - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS s FROM fp JOIN kw USING (w) JOIN fd USING (field, w) JOIN fs USING (field) WHERE {INSIDE} GROUP BY ALL) GROUP BY 1, 2, 3),
{scored_sql("l", "s2", ", 'postgres_keyword' AS source", INSIDE)},
hs0 AS (SELECT doc_id, chunk_index, CAST(NULL AS INTEGER) AS query_id, search_text AS t FROM ch UNION ALL SELECT CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), query_id, text FROM rq WHERE use_semantic),
hs1 AS (SELECT doc_id, chunk_index, query_id, sha1(unnest(regexp_extract_all(lower(t), '[a-z0-9]{{2,}}'))) AS h FROM hs0),
hs2 AS (SELECT doc_id, chunk_index, query_id, CAST(('0x' || substring(h, 1, 8)) AS BIGINT) % 384 AS slot, sum(CASE WHEN CAST(('0x' || substring(h, 9, 2)) AS BIGINT) % 2 = 0 THEN 1.0 ELSE -1.0 END) AS v FROM hs1 GROUP BY ALL),
hs3 AS (SELECT *, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id, chunk_index, query_id)) AS value FROM hs2 WHERE v <> 0),
s3 AS (SELECT b.query_id, a.doc_id, a.chunk_index, round(sum(a.value * b.value), 6) AS score, 'vector' AS source FROM hs3 a JOIN hs3 b ON a.slot = b.slot AND a.doc_id IS NOT NULL AND b.query_id IS NOT NULL GROUP BY 1, 2, 3),
sh AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, query_id ORDER BY score DESC, doc_id, chunk_index) AS r FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3 WHERE {INSIDE})) WHERE r <= 40)"""
WEIGHTS = "CASE run_route " + " ".join(f"WHEN '{r}' THEN CASE source WHEN 'keyword' THEN {k} WHEN 'postgres_keyword' THEN {t} ELSE {v} END" for r, (k, t, v) in V.ROUTE_WEIGHTS.items()) + " END"


def merge_sql(name: str, of: str, docs: str, first: float, tag: str) -> str:
    """Hits `of` with first chunks of the documents `docs` merged in, as `name`."""
    return f"""{name}0 AS (SELECT {of}.query_id, {of}.doc_id, chunk_index, CASE WHEN d.doc_id IS NULL THEN score ELSE round(score + 0.08, 4) END AS score, CASE WHEN d.doc_id IS NULL THEN sources ELSE list_concat(sources, ['structured', '{tag}']) END AS sources, 1 AS o FROM {of} LEFT JOIN {docs} d ON d.query_id = {of}.query_id AND d.doc_id = {of}.doc_id
  UNION ALL SELECT query_id, doc_id, 0, {first}, ['{tag}'], 0 FROM {docs}),
{name} AS (SELECT query_id, doc_id, arg_min(chunk_index, (o, chunk_index)) AS chunk_index, max(score) AS score, list_sort(list_distinct(flatten(list(sources)))) AS sources FROM {name}0 JOIN cs USING (doc_id, chunk_index) GROUP BY query_id, doc_id, section, evidence_type, snippet)"""


def matched(x: str, terms: str) -> str:
    return f"len(list_filter({terms}, lambda t: contains({x}, t)))"


def context_sql(two: float, one: float, stop: float, none: float) -> str:
    return f"CASE WHEN len(ctxw) >= 2 THEN {two} WHEN len(ctxw) = 1 THEN {one} WHEN len(ctxa) > 0 THEN {stop} ELSE {none} END"


SEARCH = f"""fu AS (SELECT query_id, doc_id, chunk_index, round(sum(n * wt), 6) AS score, list_sort(list(DISTINCT source)) AS sources FROM (SELECT sh.*, CASE WHEN max(score) OVER o = 0 THEN 1.0 ELSE score / max(score) OVER o END AS n, {WEIGHTS} AS wt, use_semantic FROM sh JOIN rq USING (query_id) WINDOW o AS (PARTITION BY query_id, source)) WHERE wt > 0 AND (source <> 'vector' OR use_semantic) GROUP BY 1, 2, 3),
hy AS (SELECT fu.* FROM fu JOIN cs USING (doc_id, chunk_index) QUALIFY row_number() OVER (PARTITION BY query_id, doc_id, section, evidence_type, snippet ORDER BY score DESC, chunk_index) = 1),
rk AS (SELECT * FROM hy QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_index) <= 20),
sd AS (SELECT query_id, doc_id FROM al WHERE place <= 10), {merge_sql('m1', 'rk', 'sd', 1.18, 'structured')}, {merge_sql('m2', 'm1', 'xd', 1.0, 'exact')},
z0 AS (SELECT m2.*, section, evidence_type, snippet, doc_number, supplier_name, route, run_route, rq.text AS q_text, rq.low, row_query, words, nums, lower({ns("concat_ws(' ', snippet, doc_number, supplier_name, evidence_type, lower(doc_number) || '.pdf', section, layout, doc_number, supplier_name, strftime(doc_date, '%Y-%m-%d'), CAST(CAST(amount AS DOUBLE) AS VARCHAR), 'INR', buyer_name)")}) AS hay, lower({ns('snippet')}) AS sn,
  strftime(doc_date, '%Y-%m-%d') AS dd, CAST(CAST(amount AS DOUBLE) AS VARCHAR) AS am FROM m2 JOIN cs USING (doc_id, chunk_index) JOIN rendered USING (doc_id) JOIN rq USING (query_id)),
z1 AS (SELECT *, {matched('hay', 'nums')} AS n, {matched('hay', 'words')} AS t, regexp_extract_all(regexp_extract(sn, '^[^0-9]*'), '[a-z]+') AS ctxa, list_filter(regexp_extract_all(regexp_extract(sn, '^[^0-9]*'), '[a-z]+'), lambda w: NOT list_contains({lst(V.ROW_CONTEXT_STOP)}, w)) AS ctxw FROM z0),
z2 AS (SELECT *, {context_sql(0.28, 0.08, -0.16, -0.2)} AS ctx FROM z1),
z3 AS (SELECT * EXCLUDE (score), round(score + (round(n * 0.14 + t * 0.05, 4) + CASE run_route WHEN 'lexical' THEN n * 0.22 + least(0.18, t * 0.06) WHEN 'mixed' THEN n * 0.18 + least(0.16, t * 0.05) ELSE n * 0.08 + least(0.12, t * 0.04) END
  + CASE WHEN row_query THEN CASE evidence_type WHEN 'table_row' THEN ctx + 0.24 WHEN 'line_chunk' THEN 0.16 WHEN 'header_field' THEN -0.12 ELSE -0.08 END + CASE WHEN n > 0 THEN 0.18 ELSE 0 END ELSE 0 END + CASE WHEN evidence_type = 'line_chunk' AND t > 0 THEN least(0.18, t * 0.06) ELSE 0 END + CASE WHEN evidence_type = 'header_field' AND t >= 2 AND NOT row_query THEN 0.08 ELSE 0 END), 4) AS score,
  CASE WHEN list_contains(sources, 'postgres_keyword') THEN 0.4 ELSE 0 END + CASE WHEN list_contains(sources, 'keyword') THEN 0.2 ELSE 0 END + CASE WHEN list_contains(sources, 'structured') THEN 0.1 ELSE 0 END + CASE WHEN list_contains(sources, 'vector') THEN 0.05 ELSE 0 END AS bonus FROM z2),
fh AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN NOT row_query THEN 0.0 WHEN evidence_type = 'table_row' THEN ctx ELSE -1.0 END DESC, score DESC, bonus DESC, doc_id, chunk_index) AS rank FROM z3 QUALIFY rank <= 5)"""
BEGIN = f"WITH RECURSIVE {SEARCH_Q}, {TERMS}, {ROUTED}, {CORPUS}, {SCOPE}"


def search_batch(spark) -> DataFrame:
    return spark.createDataFrame(SEARCH_BATCH, "query_id long, text string")


_corpora: dict[tuple[str, ...], ingest.Corpus] = {}


def corpus_plan(spark, sf) -> ingest.Corpus:
    """The corpus of a folder, of which only the documents are written yet, once per session."""
    key = (spark.sparkContext.applicationId, sf, "plan")
    if key not in _corpora:
        pages = rendered(spark, sf).select("doc_id", "page_number", "text", F.concat(F.lower("doc_number"), F.lit(".pdf")).alias("source_filename"), F.concat(F.lit("store/"), "doc_number").alias("storage_path"))
        _corpora[key] = ingest.ingest(pages)
    return _corpora[key]


def small_corpus(spark, sf) -> ingest.Corpus:
    """The ingested corpus of a folder, whose documents and chunks are written once per session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _corpora:
        c = corpus_plan(spark, sf)
        _corpora[key] = ingest.Corpus(c.documents, stored(c.chunks), c.items)
    return _corpora[key]


@query(BEGIN + " SELECT query_id, doc_id, place, 'structured' AS source FROM al UNION ALL SELECT query_id, doc_id, place, 'exact' FROM xd")
def search_scope(spark, sf):
    """Documents that filters and identifiers allow."""
    plan = search.settle(router.executed(router.routed(search_batch(spark))))
    allowed, found, _, _ = search.scope(corpus_plan(spark, sf).documents, plan)
    one = lambda d, s: d.select("query_id", "doc_id", F.col("place").cast("long").alias("place"), F.lit(s).alias("source"))
    return one(allowed, "structured").unionByName(one(found, "exact"))


@query(BEGIN + f", {SOURCES} SELECT query_id, source, doc_id, chunk_index, round(score, 4) AS score FROM sh")
def search_sources(spark, sf):
    """Hits of the keyword index, of the term search and of the vectors, each inside the allowed documents."""
    c, plan = small_corpus(spark, sf), search.settle(router.executed(router.routed(search_batch(spark))))
    _, _, ok, bound = search.scope(c.documents, plan)
    return search.source_hits(c.chunks, plan, ok, bound, 40).select("query_id", "source", "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.round("score", 4).alias("score"))


def kept_index(spark, sf) -> ingest.Corpus:
    """The corpus of a folder with an index that has come to hold its chunks by changes: two thirds of the documents first, a quarter of these with old texts, and some
    that don't exist; then the rest, the right texts, and the deletion of the others. Written once per session."""
    key = (spark.sparkContext.applicationId, sf, "index")
    if key not in _corpora:
        c = small_corpus(spark, sf)
        d, stale = F.col("doc_id"), F.concat(F.lit("stale nos "), "search_text")
        old = c.chunks.where(d % 3 != 0).withColumns({x: F.when(d % 4 == 0, F.concat(F.lit("stale nos "), x)).otherwise(F.col(x)) for x in ("search_text", "chunk_text")})
        odd = c.chunks.where(d % 50 == 1).withColumns({"doc_id": -1 - d, "search_text": stale})
        stored = inverted.Stored(spark, f"{search.shared_folder(spark)}/index-{uuid.uuid4().hex}")
        stored.add(old.unionByName(odd)).add(c.chunks.where((d % 3 == 0) | (d % 4 == 0))).delete(odd.select("doc_id"))
        _corpora[key] = ingest.Corpus(c.documents, c.chunks, c.items, stored)
    return _corpora[key]


@query(BEGIN + f", {SOURCES} SELECT query_id, source, doc_id, chunk_index, round(score, 4) AS score FROM sh")
def stored_sources(spark, sf):
    """As search_sources, from the stored index after inserts, a replacement and a deletion."""
    c, plan = kept_index(spark, sf), search.settle(router.executed(router.routed(search_batch(spark))))
    _, _, ok, bound = search.scope(c.documents, plan)
    return search.source_hits(c.chunks, plan, ok, bound, 40, c.index).select("query_id", "source", "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.round("score", 4).alias("score"))


@query(BEGIN + f", {SOURCES}, {SEARCH} SELECT query_id, rank, doc_id, chunk_index, evidence_type, round(score, 3) AS score, array_to_string(sources, ',') AS sources, snippet FROM fh")
def search_hits(spark, sf):
    """Ranked evidence of the whole search: fused, merged with structured and exact documents, reranked."""
    _, hits = search.search(kept_index(spark, sf), search_batch(spark), 5)
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "evidence_type", F.round("score", 3).alias("score"), F.array_join(F.array_sort("sources"), ",").alias("sources"), "snippet")


@query(BEGIN + f", {SOURCES}, {SEARCH} SELECT query_id, rank, doc_id, chunk_index, evidence_type, round(score, 3) AS score, array_to_string(sources, ',') AS sources, snippet FROM fh")
def cached_hits(spark, sf):
    """As search_hits, where the results of a third of the queries are held from an earlier batch."""
    c, path = kept_index(spark, sf), f"{search.shared_folder(spark)}/results-{uuid.uuid4().hex}"
    cache.cached_search(c, search_batch(spark).where("query_id % 3 = 0"), path, 5)
    _, hits = cache.cached_search(c, search_batch(spark), path, 5)
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "evidence_type", F.round("score", 3).alias("score"), F.array_join(F.array_sort("sources"), ",").alias("sources"), "snippet")


CODE = f"coalesce(nullif(trim(regexp_extract(snippet, 'Material Code:\\s*([^|]+)', 1)), ''), CASE WHEN wants THEN coalesce(nullif(regexp_extract(snippet, '^\\s*\\d+\\s+({V.MATERIAL})\\b', 1), ''), nullif(regexp_extract(snippet, '\\b({V.MATERIAL})\\b', 1), '')) END)"
ANSWERS = f"""an0 AS (SELECT *, {matched('sn', 'words')} AS st, CASE WHEN {matched('sn', 'nums')} > 0 THEN 1 ELSE 0 END AS s1n, contains(low, 'material code') AS wants, evidence_type = 'table_row' AND {any_of('low', V.ANSWER_ROW)} AS rowhit, CASE WHEN contains(sn, 'material code description') THEN -1.0 ELSE 0 END + CASE WHEN contains(sn, 'process route') THEN -0.6 ELSE 0 END - length(sn) / 1000.0 AS sp, {context_sql(0.3, 0.08, -0.18, -0.22)} AS actx FROM fh),
an1 AS (SELECT *, round(score + s1n * 0.4 + least(0.2, st * 0.08) + actx, 6) AS sc, {CODE} AS code FROM an0),
an2 AS (SELECT query_id, route, arg_min('Found ' || doc_number || '. File: ' || lower(doc_number) || '.pdf. Location: store/' || doc_number || '. Supplier: ' || supplier_name || '. Amount: ' || am || ' INR. Date: ' || dd || '. Evidence: page 1.', rank) AS exact,
  first(CASE WHEN wants AND code IS NOT NULL THEN 'The material code is ' || code || ' in ' || doc_number || ', page 1.' ELSE 'Best matching row in ' || doc_number || ', page 1: ' || snippet END ORDER BY st DESC, s1n DESC, sp DESC, sc DESC, rank) FILTER (WHERE rowhit) AS rowa,
  string_agg(doc_number || ' from ' || supplier_name || ', page 1: ' || snippet, chr(10) ORDER BY rank) FILTER (WHERE rank <= 3) AS extract FROM an1 GROUP BY 1, 2)"""


@query(BEGIN + f", {SOURCES}, {SEARCH}, {ANSWERS} SELECT query_id, route, CASE WHEN route = 'exact_match' THEN exact ELSE coalesce(rowa, extract) END AS answer, CASE WHEN route = 'exact_match' THEN 'deterministic' WHEN rowa IS NOT NULL THEN 'extractive_row' ELSE 'extractive' END AS backend FROM an2")
def search_answers(spark, sf):
    """Whole search: plan, retrieval, fusion, merges, rerank, answers."""
    plan, hits = search.search(kept_index(spark, sf), search_batch(spark), 5)
    return answer.answers(hits, plan)


RESPONSES = """g0 AS (SELECT query_id, rank, doc_id, chunk_index, CASE WHEN list_contains(sources, 'exact') THEN 1.0 ELSE score END AS conf,
  CASE WHEN list_contains(sources, 'exact') OR score >= 0.9 THEN 'high' WHEN score >= 0.55 THEN 'medium' ELSE 'low' END AS label FROM fh),
g AS (SELECT query_id, count(*) AS result_count, arg_min(label, rank) AS label, round(arg_min(conf, rank), 3) AS confidence, string_agg(doc_id || ':' || chunk_index, ',' ORDER BY rank) FILTER (rank <= 3) AS evidence,
  string_agg(doc_id || ':' || chunk_index, ',' ORDER BY rank) FILTER (rank > 1) AS more FROM g0 GROUP BY 1)"""


@query(BEGIN + f", {SOURCES}, {SEARCH}, {ANSWERS}, {RESPONSES} SELECT rq.query_id, rq.route, coalesce(CASE WHEN rq.route = 'exact_match' THEN nullif('deterministic', CASE WHEN exact IS NULL THEN 'deterministic' END) WHEN rowa IS NOT NULL THEN 'extractive_row' WHEN extract IS NOT NULL THEN 'extractive' END, 'none') AS backend, coalesce(result_count, 0)::BIGINT AS result_count, coalesce(label = 'low', false) AS review_recommended, label AS confidence_label, confidence::DOUBLE AS confidence, coalesce(evidence, '') AS evidence, coalesce(more, '') AS more_matches FROM rq LEFT JOIN g USING (query_id) LEFT JOIN an2 USING (query_id)")
def search_responses(spark, sf):
    """Responses of the whole search: number of hits, evidence (the first three), further matches, confidence and whether to review; queries without hits, too."""
    plan, hits = search.search(kept_index(spark, sf), search_batch(spark), 5)
    r = answer.responses(hits, plan)
    at = lambda c: F.coalesce(F.array_join(F.transform(c, lambda h: F.concat(h["doc_id"].cast("string"), F.lit(":"), h["chunk_index"].cast("string"))), ","), F.lit(""))
    best = F.try_element_at("hits", F.lit(1))["confidence"]
    more = F.slice("hits", 2, F.greatest(F.size("hits") - 1, F.lit(0)))
    return r.select("query_id", "route", "backend", F.col("result_count").cast("long").alias("result_count"), "review_recommended", best["label"].alias("confidence_label"), F.round(best["score"].cast("double"), 3).alias("confidence"), at(F.col("evidence")).alias("evidence"), at(more).alias("more_matches"))


# ---- answers, evaluation ----
@query(f"WITH {RENDERED} SELECT doc_id, 'Found ' || doc_number || '. File: ' || lower(doc_number) || '.pdf. Location: store/' || doc_number || '. Supplier: ' || supplier_name || '. Amount: ' || CAST(amount AS VARCHAR) || ' INR. Date: ' || strftime(doc_date, '%Y-%m-%d') || '. Evidence: page 1.' AS answer FROM rendered")
def exact_answers(spark, sf):
    d = truth_docs(spark, sf).withColumn("amount", F.col("amount").cast("decimal(14,2)"))
    return d.select("doc_id", answer.exact_answer().alias("answer"))


@query(f"WITH {ROW_CHUNKS} SELECT doc_id, chunk_index, nullif(regexp_extract(chunk_text, '\\b([A-Z]{{1,5}}-\\d{{2,}}[A-Z0-9-]*)\\b', 1), '') AS code, round(CASE WHEN contains(search_text, 'material code description') THEN -1.0 ELSE 0 END + CASE WHEN contains(search_text, 'process route') THEN -0.6 ELSE 0 END - length(search_text) / 1000.0, 6) AS specificity FROM ch")
def row_features(spark, sf):
    c = row_chunks(spark, sf)
    return c.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), answer.material_code(F.col("chunk_text")).alias("code"), F.round(X.specificity(F.col("search_text")), 6).alias("specificity"))


METRICS = ", ".join(f"round(avg(CASE WHEN r <= {k} THEN 1.0 ELSE 0 END), 4) AS recall_at_{k}, round(avg(CASE WHEN s <= {k} THEN 1.0 ELSE 0 END), 4) AS snippet_at_{k}" for k in (1, 3, 5))


@query(f"""WITH q AS (SELECT doc_id AS query_id, substring(text, 1, 200) AS text, substring(text, 50, 30) AS part FROM documents WHERE doc_id % 20 = 0 AND text IS NOT NULL), {BM25}, k AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 4) DESC, doc_id) AS rank FROM bm),
h AS (SELECT query_id, min(CASE WHEN k.doc_id % 1000 = query_id % 1000 THEN rank END) AS r, min(CASE WHEN k.doc_id % 1000 = query_id % 1000 AND contains(lower(d.text), lower(part)) THEN rank END) AS s FROM q LEFT JOIN (SELECT * FROM k WHERE rank <= 10) k USING (query_id) LEFT JOIN documents d USING (doc_id) GROUP BY 1)
SELECT CASE WHEN query_id % 40 = 0 THEN 'even' ELSE 'odd' END AS query_type, count(*) AS queries, {METRICS}, round(avg(coalesce(1.0 / r, 0)), 4) AS mrr FROM h GROUP BY ROLLUP (query_type)""")
def retrieval_quality(spark, sf):
    """Documents divisible by 20 as queries (200 characters) that should find themselves, or one with the same number."""
    d = read_table(spark, sf, "documents").select("doc_id", F.lit(0).alias("chunk_index"), "text")
    own = d.where("doc_id % 20 = 0 AND text IS NOT NULL").select(F.col("doc_id").alias("query_id"), F.substring("text", 1, 200).alias("text"), F.substring("text", 50, 30).alias("part"))
    hits = index.top_k(index.bm25(d, own.select("query_id", "text"), {"text": 1.0}).withColumn("score", F.round("score", 4)), 10)
    hits = hits.join(d.select("doc_id", F.col("text").alias("snippet")), "doc_id").select("query_id", "rank", F.lit("f").alias("source_filename"), F.lit(1).alias("page_number"), (F.col("doc_id") % 1000).cast("string").alias("doc_number"), "snippet")
    cases = own.select("query_id", F.when(F.col("query_id") % 40 == 0, "even").otherwise("odd").alias("query_type"), F.lit("f").alias("expected_source_filename"), F.lit(1).alias("expected_page"), (F.col("query_id") % 1000).cast("string").alias("expected_doc_number"), F.array("part").alias("expected_snippets"))
    return evaluate.retrieval_metrics(cases, hits)


PAIRS = """p AS (SELECT doc_id, supplier_name, unnest(['doc_number', 'supplier_name', 'buyer_name', 'doc_date', 'amount']) AS field FROM rendered), ok AS (SELECT *, CASE WHEN (field = 'buyer_name' AND doc_id % 7 = 0) OR (field = 'amount' AND doc_id % 11 = 0) THEN 0 ELSE 1 END AS ok FROM p)"""


def extracted_pairs(spark, sf) -> DataFrame:
    """Expected and extracted fields of the rendered documents: some expectations are wrong (buyer, amount), some only written otherwise (supplier, amount)."""
    truth = rendered(spark, sf)
    names = ["doc_number", "supplier_name", "buyer_name", "doc_date", "amount"]
    got = fields.metadata(truth.select("doc_id", "page_number", "text")).select(F.col("doc_id").alias("g_id"), *[F.col(n).cast("string").alias(f"g_{n}") for n in names])
    both = truth.join(got, F.col("doc_id") == F.col("g_id"))
    k = F.col("doc_id")
    want = {n: F.col(n).cast("string") for n in names} | {"buyer_name": F.when(k % 7 == 0, "nobody").otherwise(F.col("buyer_name")), "supplier_name": F.concat(F.lit(" "), F.upper("supplier_name")), "amount": F.when(k % 11 == 0, F.col("amount") + 1).otherwise(F.col("amount")).cast("decimal(18,3)").cast("string")}
    return both.select("doc_id", "supplier_name", F.explode(F.array(*[F.struct(F.lit(n).alias("field"), want[n].alias("expected"), F.col(f"g_{n}").alias("actual")) for n in names])).alias("p")).select("doc_id", "supplier_name", "p.*")


@query(f"WITH {RENDERED}, {PAIRS} SELECT supplier_name, field, count(*) AS checks, CAST(sum(ok) AS BIGINT) AS passed, round(sum(ok) / count(*), 4) AS accuracy FROM ok GROUP BY GROUPING SETS ((supplier_name), (field), ())")
def extraction_accuracy(spark, sf):
    return evaluate.extraction_metrics(extracted_pairs(spark, sf))


@query(f"WITH {RENDERED}, {PAIRS} SELECT doc_id, min(ok) = 1 AS passed FROM ok GROUP BY 1")
def passed_documents(spark, sf):
    return evaluate.documents_passed(extracted_pairs(spark, sf))


@query(f"""WITH {RENDERED}, {PAIRS}, f AS (SELECT doc_id, count(*) AS fc, sum(ok) AS fp FROM ok GROUP BY 1),
d AS (SELECT r.supplier_name, fc, fp, CASE WHEN bom AND doc_id % 7 <> 0 THEN 1 + 3 * item_count ELSE 1 END AS ic, CASE WHEN NOT bom THEN 1 WHEN doc_id % 7 = 0 THEN 0 ELSE 1 + 3 * item_count - CASE WHEN doc_id % 3 = 0 AND item_count >= 2 THEN 1 ELSE 0 END END AS ip FROM rendered r JOIN f USING (doc_id)),
s AS (SELECT supplier_name, count(*) AS documents, CAST(sum(CASE WHEN fc = fp AND ic = ip THEN 1 ELSE 0 END) AS BIGINT) AS passed_documents, CAST(sum(fc) AS BIGINT) AS field_checks, CAST(sum(fp) AS BIGINT) AS passed_field_checks, CAST(sum(ic) AS BIGINT) AS line_item_checks, CAST(sum(ip) AS BIGINT) AS passed_line_item_checks FROM d GROUP BY GROUPING SETS ((supplier_name), ()))
SELECT *, round(passed_documents / documents, 4) AS document_accuracy, round(passed_field_checks / field_checks, 4) AS field_accuracy, round(passed_line_item_checks / line_item_checks, 4) AS line_item_accuracy FROM s""")
def extraction_report(spark, sf):
    """Fields of all rendered documents and line items of their bills of material; one expected item is left out, or one quantity wrong, in some."""
    truth, names = rendered(spark, sf), ["part_number", "description", "quantity"]
    got = items.line_items(truth.where("layout = 'bom'").select("doc_id", "text"))
    w = Window.partitionBy("doc_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    lines = read_table(spark, sf, "lineitem").where("l_orderkey % 5 = 0").join(read_table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumn("doc_id", F.col("l_orderkey")).withColumn("row_no", F.row_number().over(w))
    wrong = F.when((F.col("doc_id") % 3 == 0) & (F.col("row_no") == 2), 1).otherwise(0)
    want = lines.where("NOT (doc_id % 7 = 0 AND row_no = 1)").select("doc_id", "row_no", F.concat(F.lit("P-"), F.lpad(F.col("l_partkey").cast("string"), 6, "0")).alias("part_number"), F.col("p_name").alias("description"), (F.col("l_quantity").cast("long") + wrong).alias("quantity"))
    return evaluate.extraction_report(extracted_pairs(spark, sf), evaluate.item_pairs(truth, want, got, names))


@query("SELECT CASE event_id % 4 WHEN 0 THEN 'processed' WHEN 1 THEN 'duplicate' WHEN 2 THEN 'partial' ELSE 'failed' END AS status, count(*) AS files FROM events GROUP BY 1")
def ingest_summary(spark, sf):
    k = F.col("event_id") % 4
    return evaluate.ingest_summary(read_table(spark, sf, "events").select(F.when(k == 0, "processed").when(k == 1, "duplicate").when(k == 2, "partial").otherwise("failed").alias("status")))


@query("SELECT event_type AS route, count(*) AS queries, CAST(sum(CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS cache_hits, round(avg(CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE value END), 4) AS avg_latency_ms FROM events GROUP BY 1")
def route_metrics(spark, sf):
    return evaluate.route_metrics(read_table(spark, sf, "events").select(F.col("event_type").alias("route"), F.col("value").alias("latency_ms"), (F.col("event_id") % 7 == 0).alias("cache_hit")))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_counts(spark, sf):
    w = inbox.windowed_counts(read_table(spark, sf, "events"), "ts", "event_type")
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))
