"""Contract over raw delimited files: every rule counted, all files, all records."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofledger import schemas
from proofledger.functions.numeric import is_finite_positive
from proofledger.functions.parse import MONTH_TEXT, lease_is_valid, month_date
from proofledger.sources.readers import read_raw_text


@dataclass(frozen=True)
class Floors:
    """Least rows, latest allowed first month, earliest allowed last month."""

    # ---- fixed values: floors of the full source ----
    rows: int = 240_000
    first_month: str = "2017-01"
    last_month: str = "2025-06"


# ---- fixed value: the mark some writers put before the first character ----
BYTE_ORDER_MARK = "\ufeff"

# A field is bare text that does not start with a quote, or quoted text with doubled quotes.
_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",][^,]*+|)'
WELL_FORMED_LINE = rf"^{_FIELD}(?:,{_FIELD})*+$"

FILE_RULES = ["header matches", "valid utf-8", "not empty", "well-formed quoting"]
ROW_RULES = ["eleven fields", "positive finite numbers", "lease text", "month parses"]
TABLE_RULES = ["row floor", "first month floor", "last month floor", "has a month"]


def file_facts(spark: SparkSession, path: str) -> DataFrame:
    """Per file: its first line, lines, lines that are not UTF-8, lines with broken quoting.

    Lines are read as text, so no file is held whole. The first line is the first one of the split
    that starts at byte 0; within a task ``monotonically_increasing_id`` follows reading order.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        (F.col("_metadata.file_block_start") == 0).alias("at_start"),
        F.monotonically_increasing_id().alias("seq"),
    )
    line = F.regexp_replace("value", "\r$", "")
    return lines.groupBy("file").agg(
        F.min_by(line, F.when(F.col("at_start"), F.col("seq"))).alias("first_line"),
        F.count(F.lit(1)).alias("lines"),
        F.count_if(~F.is_valid_utf8("value")).alias("bad_utf8"),
        F.count_if(~line.rlike(WELL_FORMED_LINE)).alias("bad_quoting"),
    )


def file_violations(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Offending files and lines per file rule, as one row.

    With ``multi_line`` a record may go on in the next line inside quotes, so quotes are judged by the reader, which
    counts a record that they break as one without eleven fields.

    A file without a byte gives no line, so empty files are those listed but not seen.
    """
    header = F.regexp_replace(F.trim("first_line"), f"^{BYTE_ORDER_MARK}", "")
    listed = len(spark.read.text(path).inputFiles())
    return file_facts(spark, path).agg(
        F.count_if(~header.eqNullSafe(F.lit(schemas.RAW_HEADER))).alias("header matches"),
        F.coalesce(F.sum("bad_utf8"), F.lit(0)).alias("valid utf-8"),
        (F.lit(listed).cast("bigint") - F.count(F.lit(1))).alias("not empty"),
        (F.lit(0) if multi_line else F.coalesce(F.sum("bad_quoting"), F.lit(0))).alias("well-formed quoting"),
    ).select(*[F.col(f"`{r}`") for r in FILE_RULES])


def row_rules() -> dict[str, Column]:
    """Predicate that is true on a violating record, per row rule; never NULL."""
    area = F.col("floor_area_sqm").try_cast("double")
    price = F.col("resale_price").try_cast("double")
    corrupt = F.col(schemas.CORRUPT).isNotNull()
    return {
        "eleven fields": corrupt,
        "positive finite numbers": ~corrupt & ~(is_finite_positive(area) & is_finite_positive(price)),
        "lease text": ~corrupt & ~lease_is_valid(F.col("remaining_lease")),
        "month parses": ~corrupt & month_date(F.col("month")).isNull(),
    }


def row_violations(raw_text: DataFrame, floors: Floors) -> DataFrame:
    """Violations per row and table rule in one pass over the records."""
    month = F.when(F.col("month").rlike(MONTH_TEXT), F.col("month"))
    rules = [F.count_if(cond).alias(name) for name, cond in row_rules().items()]
    counted = raw_text.agg(
        *rules,
        F.count(F.lit(1)).alias("n"),
        F.min(month).alias("first_month"),
        F.max(month).alias("last_month"),
    )

    def flag(cond: Column) -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), F.lit(1)).otherwise(F.lit(0)).cast("bigint")

    return counted.select(
        *[F.col(f"`{r}`") for r in ROW_RULES],
        flag(F.col("n") < floors.rows).alias("row floor"),
        flag(F.col("first_month") > floors.first_month).alias("first month floor"),
        flag(F.col("last_month") < floors.last_month).alias("last month floor"),
        flag(F.col("first_month").isNull()).alias("has a month"),
    )


def as_checks(one_row: DataFrame) -> DataFrame:
    """(check_name, violations) rows from a one-row table of counters."""
    columns = one_row.columns
    return one_row.select(*[F.col(f"`{c}`").cast("bigint").alias(c) for c in columns]).unpivot(
        [], columns, "check_name", "violations"
    )


def contract_checks(spark: SparkSession, path: str, floors: Floors = Floors(), multi_line: bool = False,
                    records: DataFrame | None = None) -> DataFrame:
    """Every contract rule with its number of violations; see ``read_raw_text`` for ``multi_line``. ``records`` are the records of
    ``path`` where they are already landed."""
    records = records if records is not None else read_raw_text(spark, path, multi_line, check_header=False)
    return as_checks(file_violations(spark, path, multi_line)).unionByName(as_checks(row_violations(records, floors)))


def offenders(raw_text: DataFrame) -> DataFrame:
    """The violating records with the names of the rules they break."""
    rules = row_rules()
    names = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))
    violating = reduce(lambda a, b: a | b, rules.values())
    return raw_text.where(violating).withColumn("rules", names)


def require_clean(checks: DataFrame, what: str) -> None:
    """Raise when any check has violations; only the few check rows reach the driver."""
    failed = {r.check_name: r.violations for r in checks.where("violations > 0").collect()}
    if failed:
        raise ValueError(f"{what} failed: {failed}")
