"""Ordered results: top-k, row positions, the default order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_column(spec: str) -> Column:
    """``"n desc"`` or ``"town"`` as a sort column; NULLs come last either way."""
    name, _, direction = spec.strip().partition(" ")
    descending = direction.strip().lower() == "desc"
    return F.col(name).desc_nulls_last() if descending else F.col(name).asc_nulls_last()


def order_columns(df: DataFrame, order_by: list[str] | None) -> list[Column]:
    """The given keys, then every other column ascending, so that the order is total."""
    specs = list(order_by or [])
    named = {s.split()[0] for s in specs}
    return [order_column(s) for s in specs] + [order_column(c) for c in df.columns if c not in named]


def ordered(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    return df.orderBy(*order_columns(df, order_by))


def top(df: DataFrame, order_by: list[str], k: int) -> DataFrame:
    return df.orderBy(*order_columns(df, order_by)).limit(k)


def sequenced(df: DataFrame, order_by: list[str] | None) -> DataFrame:
    """``df`` in order with ``pos``, a number that rises along the order and has gaps between partitions.

    The rows are sorted by ranges, so a result of any length takes many tasks."""
    return own_sequence(df.orderBy(*order_columns(df, order_by)))


def own_sequence(df: DataFrame) -> DataFrame:
    """The same for a query that orders itself: ``pos`` follows its own ORDER BY."""
    return df.withColumn("pos", F.monotonically_increasing_id())


def without_gaps(stored: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows with ``pos`` counted 0, 1, 2, ... per key: the place in its own partition plus the rows of the
    partitions before, so that no result has to meet in one task."""
    split = stored.withColumn("_part", F.shiftright("pos", 33))
    sizes = split.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("pos").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).drop("_n", "_first")
    return split.join(starts, [*keys, "_part"]).withColumn("pos", F.col("pos") + F.col("_shift")).drop("_part", "_shift").select(
        *stored.columns)


def numbered(df: DataFrame, order_by: list[str] | None, path: str) -> DataFrame:
    """``df`` with its places 0, 1, 2, ... in order as ``pos``, by way of a table written at ``path``."""
    sequenced(df, order_by).write.mode("errorifexists").parquet(path)
    return without_gaps(df.sparkSession.read.parquet(path), [])


def top_with_position(df: DataFrame, order_by: list[str] | None, k: int) -> DataFrame:
    """The first ``k`` rows in order with ``pos``: a distributed top-k, then a window over at most k rows."""
    order = order_columns(df, order_by)
    kept = df.orderBy(*order).limit(k)
    return kept.withColumn("pos", F.row_number().over(Window.partitionBy().orderBy(*order)).cast("bigint") - 1)
