"""Window operators over already aggregated series; ``keys`` partition them when given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(keys: list[str] | None):
    return Window.partitionBy(*keys) if keys else Window.partitionBy()


def change_from_previous(df: DataFrame, value: str, order: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """value minus the previous row's value, NULL on the first row."""
    return df.withColumn(name, F.col(value) - F.lag(value).over(_by(keys).orderBy(order)))


def running_sum(df: DataFrame, value: str, order: str, name: str, keys: list[str] | None = None) -> DataFrame:
    frame = _by(keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(value).over(frame))


def running_sum_peers(df: DataFrame, value: str, order: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """Running sum with the default frame: rows with an equal order value share one total."""
    return df.withColumn(name, F.sum(value).over(_by(keys).orderBy(order)))


def month_index(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def rolling_median_by_calendar(df: DataFrame, value: str, day: str, months: int, name: str,
                               keys: list[str] | None = None) -> DataFrame:
    """Median over the current and the ``months - 1`` calendar months before it; gaps stay gaps."""
    frame = _by(keys).orderBy(month_index(F.col(day))).rangeBetween(-(months - 1), Window.currentRow)
    return df.withColumn(name, F.percentile(F.col(value), F.lit(0.5)).over(frame))


def rolling_median_by_rows(df: DataFrame, value: str, order: str, rows: int, name: str,
                           keys: list[str] | None = None) -> DataFrame:
    """Median over the current and the ``rows - 1`` rows before it, whatever months they are."""
    frame = _by(keys).orderBy(order).rowsBetween(-(rows - 1), Window.currentRow)
    return df.withColumn(name, F.percentile(F.col(value), F.lit(0.5)).over(frame))


def first_per_group(df: DataFrame, keys: list[str], order: list[Column], rank: str | None = None, k: int = 1) -> DataFrame:
    """The first ``k`` rows of each group; Spark cuts each task's groups to k rows before the shuffle."""
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(_by(keys).orderBy(*order))).where(F.col(name) <= k)
    return ranked if rank else ranked.drop(name)
