"""Readers: raw delimited files, nested logs, question sets, verdict files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofledger import schemas


def read_raw_text(spark: SparkSession, path: str, multi_line: bool = False, check_header: bool = True) -> DataFrame:
    """Raw records as text plus ``_corrupt``; plain and gzip files alike.

    Records are parsed whole whatever columns a job uses, else a wrong number of fields goes unseen.
    A gzip file cannot be split, so one big ``.csv.gz`` is one task: see ``spread``. Records with
    line breaks inside quotes need ``multi_line``, which also reads each file in one task. A wrong header
    fails the read unless ``check_header`` is off, as it is where headers are counted as violations.
    """
    return (
        spark.read.schema(schemas.RAW_TEXT_SCHEMA)
        .option("header", True)
        .option("enforceSchema", not check_header)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", schemas.CORRUPT)
        .option("escape", '"')
        .option("columnPruning", False)
        .option("multiLine", multi_line)
        .csv(path)
    )


def landed(raw_text: DataFrame, path: str) -> DataFrame:
    """Raw records written once in even files, with the file each came from: what contract, accounting and staging read."""
    raw_text.withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).hint("rebalance").write.mode(
        "errorifexists").parquet(path)
    return raw_text.sparkSession.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Even out rows after reading files that cannot be split."""
    return df.hint("rebalance")


def typed_raw(raw_text: DataFrame) -> DataFrame:
    """Numbers parsed with NULL for unreadable text; the text columns stay as they are."""
    return raw_text.select(
        *[F.col(f).try_cast(schemas.RAW_NUMERIC[f]).alias(f) if f in schemas.RAW_NUMERIC else F.col(f)
          for f in schemas.RAW_FIELDS]
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log with ``read_at``, which rises along it: by file name, then along the file."""
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return spark.read.schema(schemas.LOG_SCHEMA).json(path).withColumn("read_at", place)


def log_meta(log: DataFrame) -> DataFrame:
    """The run's one meta record, flattened."""
    return log.where("meta IS NOT NULL").select("meta.*")


def log_records(log: DataFrame) -> DataFrame:
    return log.where("id IS NOT NULL").select(F.col("id").alias("question_id"), "question", "model", "attempts", "read_at")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.QUESTION_SCHEMA).json(path)


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """Verdict CSV with '' kept apart from NULL: empty cells are empty text."""
    df = spark.read.schema(schemas.VERDICT_SCHEMA).option("header", True).csv(path)
    return df.na.fill("")
