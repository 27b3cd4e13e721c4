"""Sources of documents: files, page tables, JSON cases, and a corpus rendered from the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

CASE_SCHEMA = "name string, query string, query_type string, expected_source_filename string, expected_page int, expected_doc_truth string, expected_snippet_contains array<string>"
FILE_SCHEMA = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """path, source_filename, checksum (SHA-256), content of the files directly under path (or of one file)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return with_checksum(files)


def with_checksum(files: DataFrame) -> DataFrame:
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("source_filename"), "modificationTime", F.sha2("content", 256).alias("checksum"), "content")


def stored_path(checksum, filename, root: str):
    """Content-addressed place of a file: checksum and lower-case suffix under root."""
    return F.concat(F.lit(root.rstrip("/") + "/"), checksum, F.lower(F.regexp_extract(filename, r"(\.[^.]*)$", 1)))


def store_files(files: DataFrame, root: str) -> DataFrame:
    """Append contents not stored before, once per checksum, as Parquet under root and return path, checksum, storage_path; a second run stores nothing."""
    spark = files.sparkSession
    once = files.groupBy("checksum").agg(F.first("content").alias("content"), F.first("source_filename").alias("source_filename"))
    try:
        held = spark.read.parquet(f"{root}/blobs").select("checksum")
    except AnalysisException:  # the first run
        held = None
    (once if held is None else once.join(held, "checksum", "left_anti")).write.mode("append").parquet(f"{root}/blobs")
    return files.select("path", "source_filename", "checksum", stored_path(F.col("checksum"), F.col("source_filename"), root).alias("storage_path"))


def extract_pages(files: DataFrame, reader=None) -> DataFrame:
    """Pages (path, checksum, page_number, text) of files by reader(bytes) -> list of page texts; text files if None.

    No PDF library is part of this engine: pass a reader built on one. A file whose reader fails gets one row with
    status `failed` and the error; the others have status `ok`.
    """
    import pandas as pd

    read = reader or (lambda content: content.decode("utf-8", "replace").split("\f"))

    def run(frames):
        for f in frames:
            rows = []
            for path, checksum, content in zip(f["path"], f["checksum"], f["content"], strict=True):
                try:
                    rows += [(path, checksum, i, t, "ok", None) for i, t in enumerate(read(bytes(content)), 1)]
                except Exception as e:  # the row says what went wrong with this file
                    rows.append((path, checksum, 0, None, "failed", str(e)))
            yield pd.DataFrame(rows, columns=["path", "checksum", "page_number", "text", "status", "error_message"])

    return files.select("path", "checksum", "content").mapInPandas(run, "path string, checksum string, page_number int, text string, status string, error_message string")


def read_cases(spark: SparkSession, path: str, schema: str = CASE_SCHEMA) -> DataFrame:
    """Golden cases: a JSON array per file."""
    return spark.read.schema(schema).json(path, multiLine=True)


def money(c):
    return F.col(c).cast("decimal(14,2)").cast("string") if isinstance(c, str) else c.cast("decimal(14,2)").cast("string")


def rendered(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """One business document per order: doc_id, layout, page_number, text, and the truth (doc_number, supplier_name, buyer_name, doc_date, amount, item_count).

    Orders divisible by 5 are bills of material, others invoices. The rows of an order are ordered by
    (line number, part, supplier); a document's rows are bounded by its order. only (doc_id): render these documents.
    """
    part, supp = read_table(spark, sf_dir, "part"), read_table(spark, sf_dir, "supplier")
    line = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    name = lambda c: F.regexp_replace(c, "#", " ")
    own = lambda d, key: d if only is None else d.join(only.select(F.col("doc_id").alias(key)), key, "left_semi")
    line = own(line, "l_orderkey")
    rows = line.join(part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    text = F.concat_ws(" | ", F.col("l_linenumber").cast("string"), F.concat(F.lit("P-"), F.lpad(F.col("l_partkey").cast("string"), 6, "0")), "p_name", F.col("l_quantity").cast("long").cast("string"), F.lit("Nos"))
    rows = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", text.alias("t")))).alias("items"))
    rows = rows.withColumn("first_supp", F.element_at("items", 1)["l_suppkey"]).join(supp.select("s_suppkey", name("s_name").alias("supplier_name")), F.col("first_supp") == F.col("s_suppkey"))
    o = own(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"), "o_orderkey")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", name("c_name").alias("buyer_name"))
    d = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(rows, F.col("o_orderkey") == F.col("l_orderkey"))
    bom = F.col("o_orderkey") % 5 == 0
    number = F.concat(F.when(bom, "BOM-").otherwise("INV-"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"))
    d = d.withColumns({"doc_number": number, "layout": F.when(bom, "bom").otherwise("invoice"), "doc_date": F.col("o_orderdate").cast("date")})
    text = F.concat_ws(
        "\n", F.when(bom, "BILL OF MATERIAL").otherwise("TAX INVOICE"), F.concat(F.when(bom, "BOM No: ").otherwise("Invoice No: "), "doc_number"), F.concat(F.lit("Supplier: "), "supplier_name"),
        F.concat(F.lit("Buyer Name: "), "buyer_name"), F.concat(F.lit("Invoice Date: "), F.date_format("doc_date", "dd/MM/yyyy")), F.lit("Item No | Part No | Description | Qty | Unit"),
        F.array_join(F.transform("items", lambda x: x["t"]), "\n"), F.concat(F.lit("Grand Total: "), money("o_totalprice")))
    return d.select(F.col("o_orderkey").alias("doc_id"), "layout", F.lit(1).alias("page_number"), text.alias("text"), "doc_number", "supplier_name", "buyer_name", "doc_date", F.col("o_totalprice").cast("decimal(14,2)").alias("amount"), F.size("items").alias("item_count"))
