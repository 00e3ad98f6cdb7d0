"""Checks over the staged table and over a set of verdicts: (check_name, violations) rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofledger import schemas
from proofledger.functions.parse import MONTH_FORMAT


def _missing(name: str) -> Column:
    return F.col(name).isNull() | (F.col(name) == "")


def table_rules(first_day: str, as_of: str) -> dict[str, Column]:
    month, low, high = F.col("sale_month"), F.col("storey_low"), F.col("storey_high")
    lease, ppsm = F.col("remaining_lease_years"), F.col("price_per_sqm")
    # ---- fixed values: the check names ----
    return {
        "price > 0": F.col("resale_price") <= 0,
        "area > 0": F.col("floor_area_sqm") <= 0,
        "sale_month in range": (month < F.lit(first_day).cast("date")) | (month > F.lit(as_of).cast("date")),
        "month text matches date": F.col("month") != F.date_format(month, MONTH_FORMAT),
        "town not null": _missing("town"),
        "flat_type not null": _missing("flat_type"),
        "price/m2 sane": ppsm.isNull() | (ppsm <= 0),
        "storey band sane": low.isNull() | high.isNull() | (low < 1) | (high < low),
        "lease years sane": lease.isNull() | (lease < 0) | (lease > 99),
    }


def count_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """All rules in one scan, then one row per rule."""
    counts = df.agg(*[F.count_if(cond).alias(name) for name, cond in rules.items()])
    return counts.unpivot([], counts.columns, "check_name", "violations")


def table_checks(staged: DataFrame, first_day: str, as_of: str) -> DataFrame:
    return count_rules(staged, table_rules(first_day, as_of))


def verdict_checks(verdicts: DataFrame, totals: DataFrame) -> DataFrame:
    """Do stored verdicts agree with stored totals, and is every row plausible?"""
    passing = F.col("status").isin("pass_first_try", "pass_after_retry")
    rows = verdicts.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in schemas.STATUSES],
        F.count_if(~F.col("status").isin(schemas.STATUSES)).alias("status vocabulary"),
        F.count_if(~F.col("mismatch_type").isin(schemas.MISMATCHES)).alias("mismatch vocabulary"),
        F.count_if(~F.col("trap").isin("true", "false")).alias("trap vocabulary"),
        F.count_if(~F.col("attempts").isin(1, 2)).alias("one or two attempts"),
        F.count_if(passing & (F.col("mismatch_type") != "")).alias("passing row without mismatch"),
    )
    repeats = (verdicts.groupBy("question_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
               .agg(F.count(F.lit(1)).alias("unique question ids")))
    stored = totals.select(*[F.col(c).alias(f"stored_{c}") for c in ["questions", *schemas.STATUSES, "passed"]])
    one = rows.crossJoin(F.broadcast(repeats)).crossJoin(F.broadcast(stored))

    def differs(a: Column, b: Column) -> Column:
        return F.when(a.eqNullSafe(b), 0).otherwise(1).cast("bigint")

    statuses_sum = reduce(lambda a, b: a + b, [F.col(f"stored_{s}") for s in schemas.STATUSES])
    checked = one.select(
        differs(F.col("n"), F.col("stored_questions")).alias("question count"),
        *[differs(F.col(f"n_{s}"), F.col(f"stored_{s}")).alias(f"count of {s}") for s in schemas.STATUSES],
        differs(statuses_sum, F.col("stored_questions")).alias("verdicts sum to questions"),
        differs(F.col("stored_pass_first_try") + F.col("stored_pass_after_retry"), F.col("stored_passed"))
        .alias("passed sum"),
        *[F.col(f"`{c}`") for c in ["status vocabulary", "mismatch vocabulary", "trap vocabulary",
                                    "one or two attempts", "passing row without mismatch", "unique question ids"]],
    )
    return checked.unpivot([], checked.columns, "check_name", "violations")
