"""Keyed lookups between runs, questions, results and files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def without_match(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` whose keys are absent from ``right``."""
    return left.join(right.select(*keys), keys, "left_anti")


def require_none(df: DataFrame, message: str, key: str) -> None:
    """Stop with a few offending keys when ``df`` has rows."""
    offenders = [r[0] for r in df.select(key).limit(20).collect()]
    if offenders:
        raise ValueError(f"{message}: {sorted(map(str, offenders))}")


def differing_positions(reference: DataFrame, candidate: DataFrame, keys: list[str], line: str,
                        extra_rows: bool = False) -> DataFrame:
    """Positions whose rows differ between two ordered results.

    Without ``extra_rows`` only positions present on both sides are compared.
    """
    on = [*keys, "pos"]
    a = reference.select(*on, F.col(line).alias("reference_line"))
    b = candidate.select(*on, F.col(line).alias("candidate_line"))
    joined = a.join(b, on, "full_outer" if extra_rows else "inner")
    return joined.where(~F.col("reference_line").eqNullSafe(F.col("candidate_line")))


def same_columns(a: str, b: str, columns: list[str]) -> Column:
    """NULL-safe equality of the listed columns of two aliased inputs."""
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns])
