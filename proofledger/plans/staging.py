"""Raw typed records to the staged table: derive, exclude by rule, account for every row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofledger import schemas
from proofledger.functions.numeric import safe_ratio
from proofledger.functions.parse import STOREY_HIGH, STOREY_LOW, lease_years, matched_int, month_date


def exclusion_rules() -> dict[str, Column]:
    """Rule name to a predicate that is true on an excluded record; never NULL.

    NaN is not excluded here: the source contract stops it before staging.
    """
    price, area = F.col("resale_price"), F.col("floor_area_sqm")
    # ---- fixed values: the rule names ----
    return {
        "price null or <= 0": price.isNull() | (price <= 0),
        "area null or <= 0": area.isNull() | (area <= 0),
        "bad month": month_date(F.col("month")).isNull(),
        "no lease text": F.col("remaining_lease").isNull(),
    }


def excluded() -> Column:
    return reduce(lambda a, b: a | b, exclusion_rules().values())


def derive(typed: DataFrame) -> DataFrame:
    """The eleven raw columns, seven derived ones and ``sale_year``, which partitions the files."""
    sale_date = month_date(F.col("month"))
    low = matched_int(F.col("storey_range"), STOREY_LOW)
    high = matched_int(F.col("storey_range"), STOREY_HIGH)
    return typed.select(
        *schemas.RAW_FIELDS,
        sale_date.alias("sale_date"),
        F.trunc(sale_date, "MM").alias("sale_month"),
        low.alias("storey_low"),
        high.alias("storey_high"),
        ((low + high) / F.lit(2.0)).alias("storey_mid"),
        lease_years(F.col("remaining_lease")).alias("remaining_lease_years"),
        safe_ratio(F.col("resale_price"), F.col("floor_area_sqm")).alias("price_per_sqm"),
        F.year(sale_date).alias("sale_year"),
    )


def stage(typed: DataFrame, for_writing: bool = False) -> DataFrame:
    """Derived rows of the records no rule excludes; nothing is coerced to a default.

    ``for_writing`` brings each year's records together first, in partitions of even size: AQE splits a
    hot year and joins small ones. It moves the eleven raw columns, and the rest is derived afterwards.
    """
    kept = typed.where(~excluded())
    if for_writing:
        kept = kept.withColumn("_year", F.substring("month", 1, 4)).hint("rebalance", "_year")
    return derive(kept)


def exclusion_counts(typed: DataFrame) -> DataFrame:
    """(rule, n) per rule; a record may match several."""
    counts = typed.agg(*[F.count_if(cond).alias(name) for name, cond in exclusion_rules().items()])
    return counts.unpivot([], counts.columns, "rule", "n")


def accounting(typed: DataFrame, retained: DataFrame | None = None) -> DataFrame:
    """One row: raw, retained, excluded, their reconciliation and the excluded share in percent.

    Pass the written table as ``retained`` to reconcile against what was really stored.
    """
    kept = F.count_if(~excluded())
    counts = typed.agg(F.count(F.lit(1)).alias("raw"), F.count_if(excluded()).alias("excluded"), kept.alias("retained"))
    if retained is not None:
        counts = counts.drop("retained").crossJoin(F.broadcast(retained.agg(F.count(F.lit(1)).alias("retained"))))
    return counts.select(
        "raw",
        "retained",
        "excluded",
        (F.col("retained") + F.col("excluded") == F.col("raw")).alias("reconciled"),
        F.round(F.lit(100.0) * (F.col("raw") - F.col("retained")) / F.nullif(F.col("raw"), F.lit(0)), 3)
        .alias("excluded_pct"),
    )
