"""Shared helpers: table paths, checkpoint folder, input size, byte views of text columns."""

from __future__ import annotations

import re
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word characters of the word-based operators: everything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of an Arrow batch between the JVM and a Python worker.
ARROW_BYTES = 4 << 20
WHITE = np.zeros(256, dtype=bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir. Where none is set, a temporary folder on a local master, an error on a cluster."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    wanted = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
    if not wanted:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        wanted = tempfile.mkdtemp(prefix="evidex-ckpt-")
    sc.setCheckpointDir(wanted)
    return sc._jsc.sc().getCheckpointDir().get()


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, with its session's Arrow batches held to ARROW_BYTES (unless the session has a smaller bound): what a Python worker and its task hold at once doesn't grow with the rows' size."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(-?\d+)b?", conf.get(key))
    if not now or not 0 < int(now[1]) <= ARROW_BYTES:
        conf.set(key, str(ARROW_BYTES))
    return df


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and cut its lineage; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_only(df: DataFrame) -> DataFrame:
    """checkpoint(df); what was shuffled for it goes from the disk at once, not when the driver happens to collect its garbage. Sets a session setting meanwhile."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        return checkpoint(df.select("*"))  # a query takes the setting as it is made
    finally:
        conf.set(key, before)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of what df reads (file sizes for a scan). Where it has none, the bytes of the strings are summed."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 55:
        return size
    texts = [F.coalesce(F.octet_length(F.col(f"`{n}`")), F.lit(0)) for n, t in df.dtypes if t in ("string", "binary")]
    got = df.agg(F.count("*").alias("n"), F.sum(sum(texts, F.lit(0))).alias("b")).first()
    return int(got["b"] or 0) + 8 * len(df.columns) * int(got["n"])


def shuffle_parts(df: DataFrame, per_part: int = 16 << 20, least: int = 1) -> int:
    """Number of shuffle partitions for df: the session's number, more if the input asks for it."""
    conf = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, conf, min(200_000, -(-input_bytes(df) // per_part)))


def crc32_of(col: Column | str) -> Column:
    return F.crc32(F.col(col).cast("string") if isinstance(col, str) else col.cast("string"))


def string_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array joined, and the n + 1 offsets of its rows in them; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    kind = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    _, offs, data = arr.buffers()
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offs, dtype=kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    d = np.frombuffer(data, dtype=np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (fixed constants of that public generator), in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h
