"""Writers for verdicts, summaries and replay evidence."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofledger import schemas
from proofledger.session import brief_shuffles


def run_path(root: str, run_date: str, serializer_version: int) -> str:
    """Each run has a folder of its own, which belongs to it once it is marked as finished."""
    return f"{root}/run_date={run_date}/serializer_version={serializer_version}"


def require_new(spark: SparkSession, path: str) -> None:
    """Stop before any work when the run has been finished; parts of an unfinished one are written anew."""
    try:
        finished = not spark.read.text(f"{path}/finished").isEmpty()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return
    if finished:
        raise ValueError(f"a finished run is there already: {path}")


def mark_finished(spark: SparkSession, path: str) -> None:
    """The last thing a run writes."""
    spark.range(1).select(F.lit("finished").alias("value")).coalesce(1).write.mode("errorifexists").text(f"{path}/finished")


def write_verdicts(verdicts: DataFrame, path: str) -> None:
    """Verdict CSV in question order: part files follow each other, no single writer task."""
    (
        verdicts.select(*schemas.VERDICT_FIELDS)
        .orderBy("question_id")
        .write.mode("overwrite")  # of an unfinished run: see require_new
        .option("header", True)
        .option("emptyValue", "")
        .csv(path)
    )


def write_summary(summary_json: DataFrame, path: str) -> None:
    # A shuffle of the one row: coalesce would take the scans before it, of a whole log, into one task.
    summary_json.select("value").repartition(1).write.mode("overwrite").text(path)


def replay_documents(attempts: DataFrame) -> DataFrame:
    """One nested record per question with its attempts in order."""
    failed = F.col("outcome") != "ok"
    print_ = F.when(~failed, F.array(F.col("rows").cast("string"), "sha256"))
    entry = F.struct("attempt_n", "outcome", print_.alias("fingerprint"), "match", "direct_rows_equal")
    return attempts.groupBy("question_id").agg(
        F.array_sort(F.collect_list(entry)).alias("attempts"),
        F.any_value("reference_fingerprint").alias("reference_fingerprint"),
        F.when(F.max(F.when(F.col("attempt_n") == 1, F.col("match"))), F.lit("pass_first_try"))
        .when(F.max(F.when(F.col("attempt_n") > 1, F.col("match"))), F.lit("pass_after_retry"))
        .otherwise(F.lit("fail"))
        .alias("status"),
    )


def write_json(df: DataFrame, path: str) -> None:
    with brief_shuffles(df.sparkSession):
        df.write.mode("errorifexists").json(path)
