"""Run reference and candidate answers, keep their rows, compare them.

Each answer is a Spark job of its own that writes its rows to a durable table, so a lost executor or
driver costs one answer. Rows are stored as they are, in one table per list of column types; their text, which takes far more
planning than most answers, is made for all answers of a table together, as are the fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from itertools import batched

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, LongType, StringType, StructField, StructType

from proofledger.functions.cells import storable
from proofledger.operators.ordering import without_gaps
from proofledger.plans.fingerprints import RESULT_KEY, fingerprints, line_columns, placed_rows, with_empty_results
from proofledger.plans.guard import Text, read_text

REFERENCE = 0  # attempt number of a question's own answer
JOBS_AT_ONCE = 8
RUNS_AT_ONCE = 1000  # runs that the driver holds, and attempts whose records are written together
ATTEMPTS_SCHEMA = "question_id STRING, attempt_n INT, outcome STRING, note STRING, ran_question STRING, ran_attempt INT"
ROWS_SCHEMA = ("pos BIGINT, line_v1 STRING, line_v2 STRING, defect STRING, key STRING, "
               "question_id STRING, attempt_n INT")


@dataclass(frozen=True)
class Run:
    """One answer to compute: a lazy DataFrame builder and the order of its rows.

    ``order_by`` None keeps the order the query itself ends with. ``text`` is set for a query text: it is
    judged before anything of it is run. Runs with an equal ``key`` give the same answer and are run once.
    """

    question_id: str
    attempt_n: int
    build: Callable[[], DataFrame]
    order_by: tuple[str, ...] | None = ()
    text: Callable[[], Text] | None = None
    key: tuple | None = None


def sql_run(spark: SparkSession, question_id: str, attempt_n: int, body: str, order_by: Iterable[str] | None = None,
            as_of: str | None = None, tables: Iterable[str] = ("resale",)) -> Run:
    """A stored query text. ``:as_of`` is the run date, so a replay does not depend on the clock.

    Only one query over the views ``tables`` is run. A text that does not end in a sort gets the default order."""
    args = {"as_of": as_of} if as_of else None
    return Run(question_id, attempt_n, lambda: spark.sql(body, args=args),
               None if order_by is None else tuple(order_by), lambda: read_text(spark, body, set(tables), args),
               ("text", body, None if order_by is None else tuple(order_by), as_of, tuple(tables)))


# ---- fixed values: SQLSTATE classes of errors that are the query's own ----
QUERY_ERROR_CLASSES = ("0A", "21", "22", "42")  # unsupported feature, cardinality, data, syntax or names


def is_query_error(error: PySparkException) -> bool:
    """False for a failing cluster or file system, which must stop the run and not judge the query."""
    state, condition = error.getSqlState() or "", error.getCondition() or ""
    return state[:2] in QUERY_ERROR_CLASSES and not condition.startswith("PATH_")


def _note(error: Exception) -> str:
    return f"{type(error).__name__}: {str(error)[:200]}"


Shapes = dict[str, list[DataType]]  # column types of answers by the name of their table


def shape_of(answer: DataFrame) -> tuple[str, list[DataType]]:
    types = [f.dataType for f in answer.schema.fields]
    return hashlib.sha256("\n".join(t.json() for t in types).encode()).hexdigest()[:16], types


def execute(run: Run, path: str, shapes: Shapes) -> tuple[str, int, str, str]:
    """Write one answer's rows; returns its attempt record. A failing query is an outcome, not a crash."""
    own_order = run.order_by is None
    if run.text is not None:
        text = run.text()
        if text.outcome:
            return run.question_id, run.attempt_n, text.outcome, text.note
        own_order = own_order and text.ordered
    try:
        answer = run.build()
        if not answer.columns:
            return run.question_id, run.attempt_n, "result_contract_error", "ValueError: a result without columns"
        name, types = shape_of(answer)
        placed = placed_rows(answer, list(run.order_by or ()), own_order)
        cells = [placed[c].cast(storable(t)).alias(f"c{i}") for i, (c, t) in enumerate(zip(answer.columns, types, strict=True))]
        placed.select("pos", *cells).write.mode("errorifexists").parquet(
            f"{path}/{name}/question_id={run.question_id}/attempt_n={run.attempt_n}")
        shapes[name] = types
    except PySparkException as error:
        if not is_query_error(error):
            raise
        return run.question_id, run.attempt_n, "sql_error", _note(error)
    return run.question_id, run.attempt_n, "ok", ""


def replay(spark: SparkSession, runs: Iterable[Run], path: str) -> tuple[DataFrame, DataFrame]:
    """Execute every run; returns (attempts, result_rows). Independent jobs overlap on the cluster.

    Runs are taken some at a time, so the driver holds neither all texts nor all records; of each answer it keeps
    a digest of the key and the outcome, to run equal ones once."""
    ran: dict[bytes, tuple[str, int, str, str]] = {}
    shapes: Shapes = {}
    with ThreadPoolExecutor(max_workers=JOBS_AT_ONCE) as pool:
        for part in batched(runs, RUNS_AT_ONCE):
            names = [hashlib.sha256(repr(r.key or ("run", r.question_id, r.attempt_n)).encode()).digest() for r in part]
            fresh = {name: run for name, run in reversed(list(zip(names, part, strict=True))) if name not in ran}
            ran.update(zip(fresh, pool.map(lambda r: execute(r, path, shapes), fresh.values()), strict=True))
            records = [(r.question_id, r.attempt_n, *ran[name][2:], *ran[name][:2]) for name, r in zip(names, part, strict=True)]
            spark.createDataFrame(records, ATTEMPTS_SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}-attempts")
    if not ran:
        return spark.createDataFrame([], ATTEMPTS_SCHEMA).drop("ran_question", "ran_attempt"), spark.createDataFrame([], ROWS_SCHEMA)
    attempts = spark.read.schema(ATTEMPTS_SCHEMA).parquet(f"{path}-attempts")
    rows = stored_rows(spark, path, attempts, shapes) if shapes else spark.createDataFrame([], ROWS_SCHEMA)
    return attempts.drop("ran_question", "ran_attempt"), rows


def written_rows(spark: SparkSession, path: str, shapes: Shapes) -> DataFrame:
    """All stored answers as text, with one plan per list of column types."""
    parts = []
    for name, types in sorted(shapes.items()):
        columns = [f"c{i}" for i in range(len(types))]
        schema = StructType([StructField("pos", LongType()), *[StructField(c, storable(t)) for c, t in zip(columns, types, strict=True)],
                             StructField("question_id", StringType()), StructField("attempt_n", IntegerType())])
        cells = spark.read.schema(schema).parquet(f"{path}/{name}")
        parts.append(cells.select("pos", *line_columns(cells, columns, dict(zip(columns, types, strict=True))), *RESULT_KEY))
    return reduce(DataFrame.union, parts)


def stored_rows(spark: SparkSession, path: str, attempts: DataFrame, shapes: Shapes) -> DataFrame:
    """The rows of every attempt with their places in their results; equal answers are stored once."""
    stored = without_gaps(written_rows(spark, path, shapes), RESULT_KEY)
    by = attempts.where("outcome = 'ok'").select(*RESULT_KEY, "ran_question", "ran_attempt")
    ran = stored.withColumnsRenamed({"question_id": "ran_question", "attempt_n": "ran_attempt"})
    return ran.join(by, ["ran_question", "ran_attempt"]).select(*stored.columns)


def fingerprinted(attempts: DataFrame, rows: DataFrame, version: int, cap: int | None = None) -> DataFrame:
    """Attempts with rows, sha256, defect, oversized; a failed attempt has none of them."""
    prints = with_empty_results(attempts, fingerprints(rows, version, cap=cap), version)
    ran = F.col("outcome") == "ok"
    return prints.withColumns({c: F.when(ran, F.col(c)) for c in ["rows", "sha256", "defect", "oversized"]})


def references(prints: DataFrame) -> DataFrame:
    return prints.where(F.col("attempt_n") == REFERENCE).select("question_id", "rows", "sha256", "outcome", "oversized")


def candidates(prints: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Candidate attempts with ``stored``, the number of attempts that the log holds of a question.

    ``stored`` (question_id, stored) is that number where a log is replayed in part; else all attempts count."""
    real = prints.where(F.col("attempt_n") != REFERENCE)
    if stored is None:
        stored = real.groupBy("question_id").agg(F.count(F.lit(1)).cast("int").alias("stored"))
    return real.join(stored, "question_id")


def differing_rows(rows: DataFrame) -> DataFrame:
    """Per candidate attempt with differing rows, how many these are."""
    return row_differences(rows).groupBy(*RESULT_KEY).agg(F.count(F.lit(1)).alias("differing"))


def typed_comparison(prints: DataFrame, rows: DataFrame) -> DataFrame:
    """Per candidate attempt: outcome, fingerprint, whether it matches, and whether all rows are equal."""
    return judged(prints, differing_rows(rows))


def judged(prints: DataFrame, differing: DataFrame) -> DataFrame:
    """``typed_comparison`` from the ``differing_rows``, which a caller may have stored."""
    want = references(prints).select("question_id", F.col("rows").alias("want_rows"), F.col("sha256").alias("want_sha"))
    joined = prints.where(F.col("attempt_n") != REFERENCE).join(want, "question_id").join(differing, RESULT_KEY, "left")
    same_count = F.col("rows").eqNullSafe(F.col("want_rows"))
    return joined.select(
        *RESULT_KEY, "outcome", "rows", "sha256",
        F.array(F.col("want_rows").cast("string"), "want_sha").alias("reference_fingerprint"),
        (same_count & F.col("sha256").eqNullSafe(F.col("want_sha"))).alias("match"),
        (same_count & F.col("differing").isNull()).alias("direct_rows_equal"),
    )


def row_differences(rows: DataFrame) -> DataFrame:
    """Positions at which a candidate's row differs from the reference row, with the reference key."""
    reference = rows.where(F.col("attempt_n") == REFERENCE).select(
        "question_id", "pos", F.col("line_v2").alias("reference_line"), "key")
    candidate = rows.where(F.col("attempt_n") != REFERENCE).select(
        *RESULT_KEY, "pos", F.col("line_v2").alias("candidate_line"))
    return candidate.join(reference, ["question_id", "pos"]).where(
        ~F.col("reference_line").eqNullSafe(F.col("candidate_line")))


def mismatch_keys(differences: DataFrame, question_id: str, attempt_n: int) -> DataFrame:
    """Keys (first column) of one attempt's differing rows in order, as one list."""
    chosen = differences.where((F.col("question_id") == question_id) & (F.col("attempt_n") == attempt_n))
    placed = F.array_sort(F.collect_list(F.struct("pos", "key")))
    return chosen.agg(F.transform(placed, lambda p: p["key"]).alias("keys"))
