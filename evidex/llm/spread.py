"""Running totals and lookups along keys of any size: a hot key is spread over partitions and never meets in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

PART = "_part_"


def dealt(df: DataFrame, keys: list[str], order: list[str], parts: int) -> DataFrame:
    """df in range partitions by keys and order (nulls first), written once, with the number of its partition in _part_.

    Rows equal in keys and order stay together, so order should tell the rows of a key apart. parts comes from the size of a table that
    is read: Catalyst takes a join for the product of its sides.
    """
    return checkpoint(df.repartitionByRange(parts, *keys, *order).withColumn(PART, F.spark_partition_id()))


def along(rows: DataFrame, key: str, order: list[str], totals: dict[str, tuple[Callable[[Column], Column], Column]]) -> DataFrame:
    """rows (of dealt, by [key] and order) with, for each name of totals, the total of a column over the key's earlier rows.

    totals: name -> (F.sum or F.bit_xor, column of whole numbers). A window runs inside each partition's part of a key; only keys that
    go on in another partition, at most one for each border between partitions, need what came before: a table of at most
    two rows a partition, which is broadcast.
    """
    both = {F.sum: lambda a, b: a + b, F.bit_xor: lambda a, b: a.bitwiseXOR(b)}
    inside = Window.partitionBy(PART, key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    ends = rows.groupBy(PART).agg(F.array(F.min(key), F.max(key)).alias("e")).select(PART, F.explode("e").alias(key)).distinct()
    spanning = ends.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    parts = rows.join(F.broadcast(spanning), key, "left_semi").groupBy(PART, key).agg(*[f(c).alias(name) for name, (f, c) in totals.items()])
    earlier = Window.partitionBy(key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(F.col(PART).alias("_p"), F.col(key).alias("_k"), *[zero(f(name).over(earlier)).alias(f"_c_{name}") for name, (f, _) in totals.items()])
    out = rows.withColumns({name: zero(f(c).over(inside)) for name, (f, c) in totals.items()})
    out = out.join(F.broadcast(carried), (F.col(PART) == F.col("_p")) & (F.col(key) == F.col("_k")), "left")
    return out.withColumns({name: both[f](F.col(name), zero(F.col(f"_c_{name}"))) for name, (f, _) in totals.items()}).select(*rows.columns, *totals)


def looked_up(rows: DataFrame, table: DataFrame, on: list[str], weight: str, most: int = 10_000) -> DataFrame:
    """rows joined with table, which has one row for each value of on and, in weight, the number of rows that ask for it.

    Values that more than a most-th of all rows ask for are fewer than `most`: that part of table is broadcast, so no hot
    value is shuffled; the rest meets by an ordinary join. rows is read twice: a written table or a checkpoint.
    """
    every = table.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * F.lit(most) > F.lit(every)
    few, rest = table.where(hot), table.where(~hot)
    return rows.join(F.broadcast(few), on).unionByName(rows.join(F.broadcast(few.select(*on)), on, "left_anti").join(rest, on))
