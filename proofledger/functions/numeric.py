"""Rounding and ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_places(x: Column, places: int) -> Column:
    """Round a DOUBLE half away from zero after scaling, so 1.005 at 2 places is 1.0.

    ``F.round`` at 2 places rounds the shortest decimal text instead and gives 1.01; analysts'
    engines scale first, and pinned answers follow them.
    """
    if places == 0:
        return F.round(x.cast("double"), 0)
    scale = F.lit(float(10**places))
    return F.round(x.cast("double") * scale, 0) / scale


def mean(x: Column, places: int = 8) -> Column:
    """Mean over values held at ``places`` decimals.

    A DOUBLE sum depends on the order in which tasks finish, and its last bit can flip a rounded
    answer and with it the answer's fingerprint. DECIMAL addition gives the same sum in any order.
    """
    total = F.sum(x.cast(f"decimal(28,{places})")).cast("double")
    return total / F.nullif(F.count(x).cast("double"), F.lit(0.0))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    return numerator / F.nullif(denominator, F.lit(0).cast("double"))


def share_pct(part: Column, whole: Column, places: int = 2) -> Column:
    """100 * part / whole as DOUBLE; NULL for an empty whole."""
    return round_places(F.lit(100.0) * part / F.nullif(whole.cast("double"), F.lit(0.0)), places)


def is_finite_positive(x: Column) -> Column:
    """NaN is greater than every number in Spark, so it is excluded by name."""
    return F.coalesce((x > 0) & ~F.isnan(x) & (x < F.lit(float("inf"))), F.lit(False))
