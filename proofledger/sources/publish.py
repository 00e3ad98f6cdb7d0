"""Write, audit, publish: a version becomes visible only after its checks pass.

Every version has its own folder. A version is published by adding one row to the ``published``
table, and readers take the newest row. Appending a file is a single step on any file system, so a
lost driver leaves either the old or the new version in force, never a mixture.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofledger.plans import checks as table_checks

STAGED_SCHEMA = """
    month STRING, town STRING, flat_type STRING, block STRING, street_name STRING, storey_range STRING,
    floor_area_sqm DOUBLE, flat_model STRING, lease_commence_date INT, remaining_lease STRING, resale_price DOUBLE,
    sale_date DATE, sale_month DATE, storey_low INT, storey_high INT, storey_mid DOUBLE,
    remaining_lease_years DOUBLE, price_per_sqm DOUBLE, sale_year INT
"""
PUBLISHED_SCHEMA = "seq BIGINT, version STRING, published_at STRING"


def write_staged(staged: DataFrame, path: str) -> None:
    """Partitioned by year and sorted inside a file, so that row groups of other towns are skipped."""
    (
        staged.sortWithinPartitions("sale_year", "town", "flat_type", "month")
        .write.mode("errorifexists")
        .partitionBy("sale_year")
        .parquet(path)
    )


def read_staged(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STAGED_SCHEMA).parquet(path)


def published(spark: SparkSession, root: str) -> DataFrame:
    """All published versions; empty before the first one."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(PUBLISHED_SCHEMA).json(f"{root}/published")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], PUBLISHED_SCHEMA)


def current_version(spark: SparkSession, root: str) -> str | None:
    row = published(spark, root).agg(F.max_by("version", F.struct("seq", "published_at", "version")).alias("version")).first()
    return row.version


def current_path(spark: SparkSession, root: str) -> str:
    version = current_version(spark, root)
    if version is None:
        raise ValueError(f"nothing published under {root}")
    return f"{root}/versions/{version}/resale"


def current_table(spark: SparkSession, root: str) -> DataFrame:
    return read_staged(spark, current_path(spark, root))


def current_receipt(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/versions/{current_version(spark, root)}/source_receipt")


def publish(spark: SparkSession, staged: DataFrame, root: str, receipt: DataFrame, accounting: DataFrame,
            as_of: str, first_day: str, published_at: str, version: str | None = None) -> tuple[bool, DataFrame]:
    """Write a new version, check the written files, publish it when clean.

    Returns whether it was published, and the check rows. ``accounting`` is the one-row exclusion
    count; the rows found in the written files and the excluded ones must make up the raw ones. One writer
    publishes at a time: of two with the same number the later ``published_at``, then the larger version, is read.
    """
    version = version or uuid.uuid4().hex
    folder = f"{root}/versions/{version}"
    write_staged(staged, f"{folder}/resale")
    receipt.write.mode("errorifexists").parquet(f"{folder}/source_receipt")
    written = read_staged(spark, f"{folder}/resale")
    results = table_checks.table_checks(written, first_day, as_of)
    stored = written.agg(F.count(F.lit(1)).alias("stored"))
    reconciled = accounting.crossJoin(F.broadcast(stored)).select(
        F.lit("retained + excluded = raw").alias("check_name"),
        F.when(F.col("stored") + F.col("excluded") == F.col("raw"), 0).otherwise(1).cast("bigint").alias("violations"),
    )
    results.unionByName(reconciled).write.mode("errorifexists").parquet(f"{folder}/checks")
    outcome = spark.read.parquet(f"{folder}/checks")
    clean = outcome.where("violations > 0").isEmpty()
    if clean:
        last = published(spark, root).agg(F.coalesce(F.max("seq"), F.lit(0)).alias("seq")).first().seq
        row = spark.createDataFrame([(last + 1, version, published_at)], PUBLISHED_SCHEMA)
        row.coalesce(1).write.mode("append").json(f"{root}/published")
    return clean, outcome
