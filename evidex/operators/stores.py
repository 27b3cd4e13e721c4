"""Table operations of the document store: registry, upserts, versions, duplicates, replacement and deletion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normal_name, search_text
from ..plans.settle import settle


def register_suppliers(known: DataFrame, names: DataFrame) -> DataFrame:
    """known (supplier_id, name, normalized_name) and a row for each new normal name of names (name): first spelling in order, id by hash of the normal name."""
    new = names.withColumn("normalized_name", normal_name("name")).where("normalized_name <> ''").groupBy("normalized_name").agg(F.min("name").alias("name"))
    new = new.join(known.select("normalized_name"), "normalized_name", "left_anti").select(F.sha2("normalized_name", 256).alias("supplier_id"), "name", "normalized_name")
    return known.select("supplier_id", "name", "normalized_name").unionByName(new)


def upsert_latest(old: DataFrame, new: DataFrame, key: str = "doc_id", at: str = "updated_at") -> DataFrame:
    """Rows of old and new, the latest of every key; of equally late ones a new row, then the one with the largest hash of all its columns."""
    w = Window.partitionBy(key).orderBy(F.desc(at), F.desc("_n"), F.desc("_h"))
    both = old.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1))).withColumn("_h", F.xxhash64(*old.columns))
    return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_n", "_h")


def update_documents(docs: DataFrame, changes: DataFrame, at: str | None = None) -> DataFrame:
    """docs with status and error_message of changes (doc_id, status, error_message) where there are any; of several for a document the latest by `at`, or else the largest."""
    order = F.struct(*([at] if at else []), "status", "error_message")
    c = changes.groupBy(F.col("doc_id").alias("_id")).agg(F.max_by(F.struct(F.col("status").alias("s"), F.col("error_message").alias("e")), order).alias("_c"))
    changed = F.col("_id").isNotNull()
    return docs.join(c, F.col("doc_id") == F.col("_id"), "left").withColumns({"status": F.coalesce("_c.s", "status"), "error_message": F.when(changed, F.col("_c.e")).otherwise(F.col("error_message"))}).drop("_id", "_c")


def find_duplicates(docs: DataFrame) -> DataFrame:
    """checksum, doc_id of the newest row (largest created_at, then id) and copies of every checksum that occurs again."""
    return docs.groupBy("checksum").agg(F.max_by("doc_id", F.struct("created_at", "doc_id")).alias("doc_id"), F.count("*").alias("copies")).where("copies > 1")


def get_documents(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs that ids (doc_id) ask for, once each."""
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")


def next_versions(stored: DataFrame, incoming: DataFrame, arrived: str = "doc_id", rounds: int = 1000) -> DataFrame:
    """incoming (doc_id, doc_number, source_filename, and `arrived`, an order without ties) with version, as if inserted one after the other.

    A document's version is one more than the largest of the rows before it, stored or arrived, with its number or its file name.
    So it is the length of the longest chain of arrivals that ends at it, where neighbours share one of the two. A window over
    a number's (or a name's) arrivals settles whole chains inside it: the running maximum of version less rank, plus rank.
    Both are repeated until nothing changes, as often as the longest chain goes over from numbers to names and back.
    """
    links = ("doc_number", "source_filename")
    rows = incoming
    for c in links:  # a null links nothing
        held = stored.where(F.col(c).isNotNull()).groupBy(F.col(c).alias(f"_{c}")).agg(F.max("version").alias(f"_v_{c}"))
        rows = rows.join(held, F.col(c) == F.col(f"_{c}"), "left").drop(f"_{c}")
        rows = rows.withColumn(f"_k_{c}", F.when(F.col(c).isNotNull(), F.concat(F.lit("="), c)).otherwise(F.concat(F.lit("#"), F.col("doc_id").cast("string"))))
    rows = rows.withColumn("version", (F.coalesce(F.greatest("_v_doc_number", "_v_source_filename"), F.lit(0)) + 1).cast("long")).drop("_v_doc_number", "_v_source_filename")
    for c in links:
        rows = rows.withColumn(f"_r_{c}", F.row_number().over(Window.partitionBy(f"_k_{c}").orderBy(arrived)))
    rows = settle(rows)
    for _ in range(rounds):
        new = rows.withColumn("_was", F.col("version"))
        for c in links:
            ahead = F.max(F.col("version") - F.col(f"_r_{c}")).over(Window.partitionBy(f"_k_{c}").orderBy(arrived).rowsBetween(Window.unboundedPreceding, 0))
            new = new.withColumn("version", ahead + F.col(f"_r_{c}"))
        new = settle(new)
        rows = new.drop("_was")
        if new.where("version <> _was").isEmpty():
            return rows.select(*incoming.columns, "version")
    raise RuntimeError(f"versions not settled after {rounds} rounds")


def delete_documents(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    return chunks.join(ids.select("doc_id").distinct(), "doc_id", "left_anti")


def enrich_chunks(chunks: DataFrame, meta: DataFrame) -> DataFrame:
    """chunks with doc_type, doc_number, supplier_name and the search text over number, supplier, section and text."""
    c = chunks.join(meta.select("doc_id", "doc_type", "doc_number", "supplier_name"), "doc_id")
    return c.withColumn("search_text", search_text(F.concat_ws(" ", F.coalesce("doc_number", F.lit("")), F.coalesce("supplier_name", F.lit("")), F.coalesce("section", F.lit("")), "chunk_text")))


def replace_chunks(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """chunks without the documents of new, and new, numbered from 0 in each document by its pos."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    rows = new.withColumn("chunk_index", (F.row_number().over(w) - 1).cast("int")).drop("pos")
    return delete_documents(chunks, new).unionByName(rows)


def first_chunks(chunks: DataFrame) -> DataFrame:
    """The first chunk of every document."""
    cols = [c for c in chunks.columns if c not in ("doc_id", "chunk_index")]
    return chunks.groupBy("doc_id").agg(F.min("chunk_index").alias("chunk_index"), F.min_by(F.struct(*cols), "chunk_index").alias("s")).select("doc_id", "chunk_index", "s.*")


def log_queries(log_path: str, responses: DataFrame) -> None:
    """Append query_text, route, latency_ms, result_count to the query log."""
    responses.select("query_text", "route", "latency_ms", "result_count", F.current_timestamp().alias("created_at")).write.mode("append").parquet(log_path)


class Memo:
    """Answers by query text and limit for a driver session; entries are dropped after ttl seconds or when `most` are held."""

    def __init__(self, ttl: float = 600.0, most: int = 10_000):
        self.ttl, self.most, self.held = ttl, most, {}

    @staticmethod
    def key(text: str, limit: int) -> str:
        import hashlib

        return "query:" + hashlib.sha256(f"{text.strip().lower()}::{limit}".encode()).hexdigest()

    def get(self, text: str, limit: int, now: float):
        at, value = self.held.get(self.key(text, limit), (None, None))
        return value if at is not None and now - at < self.ttl else None

    def set(self, text: str, limit: int, value, now: float) -> None:
        if len(self.held) >= self.most:
            self.held.pop(next(iter(self.held)))
        self.held[self.key(text, limit)] = (now, value)
