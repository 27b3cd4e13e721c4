"""Stored tables that are changed in place: rows in buckets of their document, of which a change rewrites only those that it touches.

A change reads the buckets of its documents, writes them again as a version of their own, and then a state that says which version
of every bucket counts. The state is written last and in one file, so a change that was cut off is never seen, and a repeated one
replaces what it left. Files of other buckets stay as they are. One writer at a time; old versions are kept for readers of older states.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .stores import delete_documents, enrich_chunks, replace_chunks, update_documents, upsert_latest

STATE = "places map<int,int>, buckets int, made string, columns string, state int"


class Kept:
    """A table in a folder that all executors share, by bucket of its key. schema (its columns as a DDL string) and buckets are for a new table; one that is there keeps its own.

    An object always reads the newest state. The versions of all buckets (`buckets` pairs of numbers) pass through the driver, rows never do.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str | None = None, key: str = "doc_id", buckets: int = 64):
        self.spark, self.root, self.schema, self.key, self.buckets = spark, root.rstrip("/"), schema, key, buckets

    def state(self) -> tuple[int, dict[int, int]]:
        """Number of the newest state, and the version of every bucket that holds rows."""
        try:
            r = self.spark.read.schema(STATE).parquet(f"{self.root}/states").orderBy(F.desc("state")).first()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            r = None
        if r is None:
            return 0, {}
        self.buckets, self.schema = r["buckets"], r["columns"]
        return r["state"], dict(r["places"])

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def _files(self, places: dict[int, int]) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], self.schema)
        columns = self.spark.createDataFrame([], self.schema).columns
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/rows/version={v}/bucket={b}" for b, v in sorted(places.items())]).select(*columns)

    def rows(self) -> DataFrame:
        return self._files(self.state()[1])

    def rows_of(self, keys: DataFrame) -> DataFrame:
        """Rows of the documents keys (of the key column) from their buckets alone."""
        _, places = self.state()
        own = {r[0] for r in keys.select(self.bucket()).distinct().collect()}
        return self._files({b: v for b, v in places.items() if b in own}).join(keys.select(self.key).distinct(), self.key, "left_semi")

    def rewrite(self, touched: DataFrame, change: Callable[[DataFrame], DataFrame], made: str | None = None) -> Kept:
        """Replace the buckets of touched (of the key column) by change(their rows), whose rows must be of these buckets.

        made names the change: the last one isn't made twice, as a batch of a stream is that comes again.
        """
        state, places = self.state()
        if made is not None and made == self.last():
            return self
        own = {r[0] for r in touched.select(self.bucket()).distinct().collect()}
        n, path = state + 1, f"{self.root}/rows/version={state + 1}"
        new = change(self._files({b: v for b, v in places.items() if b in own})).withColumn("bucket", self.bucket())
        new.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        held = {r[0] for r in self.spark.read.schema(f"{self.schema}, bucket int").parquet(path).select("bucket").distinct().collect()}
        if not held <= own:
            raise ValueError(f"rows of untouched buckets {sorted(held - own)}")
        places = {**{b: v for b, v in places.items() if b not in own}, **dict.fromkeys(held, n)}
        row = self.spark.createDataFrame([(places, self.buckets, made, self.schema)], "places map<int,int>, buckets int, made string, columns string")
        row.coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/states/state={n}")
        return self

    def last(self) -> str | None:
        """The name of the last change, if it had one."""
        n = self.state()[0]
        return self.spark.read.schema(STATE).parquet(f"{self.root}/states").where(F.col("state") == n).first()["made"] if n else None

    # ---- changes of documents and chunks, by the rules of `stores` ----
    def upsert(self, new: DataFrame, at: str = "updated_at", made: str | None = None) -> Kept:
        return self.rewrite(new, lambda old: upsert_latest(old, new.select(*old.columns), self.key, at), made)

    def update(self, changes: DataFrame, at: str | None = None, made: str | None = None) -> Kept:
        return self.rewrite(changes, lambda old: update_documents(old, changes, at), made)

    def replace(self, chunks: DataFrame, made: str | None = None) -> Kept:
        """chunks: rows of documents with pos instead of chunk_index; a document's held rows go."""
        return self.rewrite(chunks, lambda old: replace_chunks(old, chunks), made)

    def delete(self, ids: DataFrame, made: str | None = None) -> Kept:
        return self.rewrite(ids, lambda old: delete_documents(old, ids), made)

    def backfill(self, documents: DataFrame, made: str | None = None) -> Kept:
        """Carry type, number, supplier and search text of changed documents to their chunks; chunks of others, and of documents that are not there, stay."""

        def change(old: DataFrame) -> DataFrame:
            here = documents.select("doc_id").distinct()
            derived = ("doc_type", "doc_number", "supplier_name", "search_text")
            done = enrich_chunks(old.drop(*derived), documents).select(*old.columns)
            return old.join(here, "doc_id", "left_anti").unionByName(done)

        return self.rewrite(documents, change, made)
