"""Profile of the staged table: plain aggregates, recomputable at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofledger import schemas
from proofledger.functions.numeric import mean, round_places
from proofledger.operators.medians import exact_median
from proofledger.operators.ordering import top
from proofledger.operators.windows import rolling_median_by_calendar, rolling_median_by_rows

HAS_MONTHS = "[0-9]+ months?$"


def overview(staged: DataFrame) -> DataFrame:
    """Rows and distinct months, towns, types; counted on the few combinations, not on the rows."""
    cells = counts_by(staged, "month", "town", "flat_type")
    return cells.agg(
        F.sum("n").alias("n_rows"),
        F.count_distinct("month").alias("n_months"),
        F.count_distinct("town").alias("n_towns"),
        F.count_distinct("flat_type").alias("n_types"),
    )


def counts_by(staged: DataFrame, *columns: str) -> DataFrame:
    return staged.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def ranges(staged: DataFrame) -> DataFrame:
    """min and max of price, area and lease years, and the median price, as one row."""
    extremes = staged.agg(
        *[f(c).alias(f"{name}_{c}") for c in ["resale_price", "floor_area_sqm", "remaining_lease_years"]
          for name, f in (("min", F.min), ("max", F.max))]
    )
    return extremes.crossJoin(F.broadcast(exact_median(staged, [], F.col("resale_price"), "median_resale_price")))


def null_counts(staged: DataFrame, columns: list[str]) -> DataFrame:
    counts = staged.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "column_name", "nulls")


def duplicate_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows beyond the first of each set of equal rows, and the number of such sets."""
    sizes = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
                     F.count_if(F.col("n") > 1).alias("repeated_groups"))


def duplicate_texts(df: DataFrame, text: str) -> DataFrame:
    """Duplicates of long texts, grouped by the SHA-256 of the whole text so that only digests move."""
    return duplicate_rows(df.select(F.sha2(F.col(text), 256).alias("digest"), F.octet_length(text).alias("size")),
                          ["digest", "size"])


def duplicate_raw_rows(staged: DataFrame) -> DataFrame:
    return duplicate_rows(staged, schemas.RAW_FIELDS)


def last_month(staged: DataFrame) -> DataFrame:
    """The latest month and its number of rows; it may be partial."""
    by_month = counts_by(staged, "month")
    return by_month.agg(F.max("month").alias("month"), F.max_by("n", "month").alias("n"))


def key_uniqueness(staged: DataFrame) -> DataFrame:
    """Distinct block strings against distinct (town, street, block)."""
    physical = staged.select("town", "street_name", "block").where("block IS NOT NULL").distinct()
    complete = F.col("town").isNotNull() & F.col("street_name").isNotNull()
    return physical.agg(F.count_distinct("block").alias("block_strings"),
                        F.count_if(complete).alias("physical_blocks"))


def block_spread(staged: DataFrame) -> DataFrame:
    """Per block string: rows, towns and streets it occurs in."""
    physical = counts_by(staged, "block", "town", "street_name")
    complete = F.col("town").isNotNull() & F.col("street_name").isNotNull()
    return physical.groupBy("block").agg(
        F.count_distinct("town").alias("towns"),
        F.count_if(complete).alias("streets"),
        F.sum("n").alias("n"),
    )


def near_miss(staged: DataFrame) -> DataFrame:
    """flat_type against flat_model, the pair that is easily taken for each other."""
    return counts_by(staged, "flat_type", "flat_model")


def near_miss_pivot(staged: DataFrame, flat_types: list[str]) -> DataFrame:
    return staged.groupBy("flat_model").pivot("flat_type", flat_types).agg(F.count(F.lit(1))).na.fill(0)


def month_span(staged: DataFrame) -> DataFrame:
    """Every month from the first to the last one of the table."""
    ends = staged.agg(F.min("sale_month").alias("a"), F.max("sale_month").alias("b"))
    return ends.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("sale_month"))


def missing_months(staged: DataFrame) -> DataFrame:
    present = staged.select("sale_month").distinct()
    gaps = month_span(staged).join(present, "sale_month", "left_anti")
    return gaps.select(F.date_format("sale_month", "yyyy-MM").alias("month"))


def calendar_coverage(staged: DataFrame) -> DataFrame:
    """Months present and months in the span."""
    ends = staged.agg(F.count_distinct("sale_month").alias("present"),
                      F.min("sale_month").alias("a"), F.max("sale_month").alias("b"))
    return ends.select("present", (F.months_between("b", "a") + 1).cast("bigint").alias("in_span"))


def frame_contrast(staged: DataFrame, group: Column, period: Column, months: int = 3) -> DataFrame:
    """Months whose rolling median depends on the frame or on filtering before or after the window.

    Three readings per month: calendar frame, row frame, and row frame over the unfiltered history.
    """
    series = exact_median(staged.where(group), ["month", "sale_month"], F.col("price_per_sqm"), "med")
    history = rolling_median_by_rows(series, "med", "month", months, "by_rows_history").where(period)
    inside = rolling_median_by_calendar(series.where(period), "med", "sale_month", months, "by_calendar")
    inside = rolling_median_by_rows(inside, "med", "month", months, "by_rows")
    both = inside.join(history.select("month", "by_rows_history"), "month")
    readings = [round_places(F.col(c), 2).alias(c) for c in ["by_calendar", "by_rows", "by_rows_history"]]
    return both.select("month", *readings).select(
        "*",
        (~F.col("by_calendar").eqNullSafe(F.col("by_rows"))).alias("frame_differs"),
        (~F.col("by_calendar").eqNullSafe(F.col("by_rows_history"))).alias("population_differs"),
    )


def lease_component(staged: DataFrame) -> DataFrame:
    """Rows whose lease text has months, and the mean with and without them."""
    years_only = F.floor("remaining_lease_years")
    return staged.agg(
        F.count_if(F.col("remaining_lease").rlike(HAS_MONTHS)).alias("with_months"),
        round_places(mean(F.col("remaining_lease_years")), 1).alias("mean_years"),
        round_places(mean(years_only, 0), 1).alias("mean_years_only"),
    )


def top_block(staged: DataFrame) -> DataFrame:
    """Busiest block string and busiest physical block, side by side."""
    loose = top(counts_by(staged, "block"), ["n desc", "block"], 1).select(
        F.lit("block string").alias("grain"), F.lit(None).cast("string").alias("town"),
        F.lit(None).cast("string").alias("street_name"), "block", "n")
    exact = top(counts_by(staged, "town", "street_name", "block"), ["n desc", "town", "street_name", "block"], 1)
    return loose.unionByName(exact.withColumn("grain", F.lit("physical block")))
