"""Inbox of files as a stream: new files once, by content, into a table; windowed counts over a log stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.inverted import Stored
from ..operators.merge import Kept
from ..operators.stores import delete_documents
from ..plans.ingest import REGISTRY, Corpus, ingest_files
from ..plans.settle import settle
from ..sources.corpus import FILE_SCHEMA, with_checksum


def watch(spark: SparkSession, path: str, glob: str = "*.pdf", files_per_trigger: int = 1000) -> DataFrame:
    """Stream of path, source_filename, modificationTime, checksum, content."""
    return with_checksum(spark.readStream.schema(FILE_SCHEMA).format("binaryFile").option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).load(path))


def first_of_each(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Files whose checksum wasn't seen within delay; state is bounded by the watermark."""
    return stream.withWatermark("modificationTime", delay).dropDuplicatesWithinWatermark(["checksum"])


def run_inbox(spark: SparkSession, path: str, target: str, checkpoint: str, handle: Callable[[DataFrame], DataFrame] | None = None, glob: str = "*.pdf"):
    """Ingest what is in the inbox now: each batch without checksums that target holds, handled, is appended to target. Returns the finished query."""

    def batch(files: DataFrame, _: int) -> None:
        new = files.dropDuplicates(["checksum"])
        try:
            known = spark.read.parquet(target).select("checksum").distinct()
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = None
        if known is not None:
            new = new.join(known, "checksum", "left_anti")
        (handle(new) if handle else new.drop("content")).write.mode("append").parquet(target)

    q = watch(spark, path, glob).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


class Inbox:
    """A folder of files ingested as a stream into stored tables under root: registry, documents, chunks, items, and the index of the chunks.

    Each batch asks the registry what to do with its files (`ingest_files`), replaces the rows of its documents bucket by bucket, then
    the index, and writes the registry last, under the batch's name. A batch that was cut off anywhere comes again with the same plan and ids and
    replaces what it left; one that was registered is not made again.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.registry = Kept(spark, f"{self.root}/registry", REGISTRY, key="path", buckets=buckets)

    def table(self, name: str, like: DataFrame | None = None) -> Kept:
        """documents, chunks or items; `like` gives the columns where the table is new."""
        schema = None if like is None else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema.fields)
        return Kept(self.spark, f"{self.root}/{name}", schema, buckets=self.buckets)

    def take(self, files: DataFrame, name: str, reader: Callable | None = None, force: bool = False) -> None:
        """One batch of files (path, source_filename, checksum, content) under its name."""
        files = files.select("path", "source_filename", "checksum", "content")
        if self.registry.last() == name or files.isEmpty():
            return
        corpus, done = ingest_files(files, self.registry.rows(), reader, force)
        done = settle(done)
        read = done.where("action <> 'duplicate'").select("doc_id")
        for part in ("documents", "chunks", "items"):
            new = getattr(corpus, part)
            self.table(part, new).rewrite(read, lambda old, new=new: delete_documents(old, read).unionByName(new))
        index = Stored(self.spark, f"{self.root}/index", self.buckets)
        if not read.join(corpus.chunks, "doc_id", "left_anti").isEmpty():  # files that are held and can't be read any more
            index.delete(read.join(corpus.chunks, "doc_id", "left_anti"))
        if not corpus.chunks.isEmpty():
            index.add(corpus.chunks)
        rows = done.where("action <> 'duplicate'").select("doc_id", "path", "checksum", "status", "error_message", F.current_timestamp().alias("created_at"))
        self.registry.rewrite(rows, lambda old: old.join(rows, "path", "left_anti").unionByName(rows), name)

    def run(self, path: str, checkpoint: str, reader: Callable | None = None, glob: str = "*.pdf", force: bool = False, files_per_trigger: int = 1000):
        """Take what is in the folder path now; a later call with the same checkpoint goes on from there. Returns the finished query."""
        stream = watch(self.spark, path, glob, files_per_trigger)
        batch = lambda files, n: self.take(files, f"{checkpoint}#{n}", reader, force)
        q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        return q

    def corpus(self) -> Corpus:
        return Corpus(*[self.table(n).rows() for n in ("documents", "chunks", "items")], Stored(self.spark, f"{self.root}/index", self.buckets))


def windowed_counts(log: DataFrame, at: str, by: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """window_start, by, n, total of a log (stream or table) with a `value`."""
    base = log.withWatermark(at, delay) if log.isStreaming else log
    return base.groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), by, "n", "total")
