from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from proofledger import schemas
from proofledger.plans import checks
from proofledger.plans import verdicts as vd

QUESTIONS = [("Q1", "filter", False), ("Q2", "window", True), ("Q3", "window", True), ("Q4", "ratio", False),
             ("Q5", "date", False), ("Q6", "date", False)]
GOOD = "a" * 64
OTHER = "b" * 64


@pytest.fixture(scope="module")
def questions(spark):
    rows = [(*q, 1, GOOD) for q in QUESTIONS]
    return spark.createDataFrame(rows, "question_id STRING, type STRING, trap BOOLEAN, rows BIGINT, sha256 STRING")


def attempt(n, outcome="ok", rows="1", sha=GOOD, note=""):
    return (n, "SELECT 1", outcome, note, [rows, sha] if outcome == "ok" else None, None)


LOG = [
    ("Q1", None, [attempt(1)]),
    ("Q2", "m2", [attempt(1, sha=OTHER)]),                       # written early, replaced by the full record
    ("Q2", "m2", [attempt(1, sha=OTHER), attempt(2)]),
    ("Q3", "m3", [attempt(1, "timeout", note="slow"), attempt(2, rows="3")]),
    ("Q4", "m3", [attempt(1, "guardrail_reject", note="no"), attempt(2, "sql_error", note="x" * 300)]),
    ("Q5", "m3", [attempt(1, "result_contract_error", note="nan")]),
    ("Q6", "m3", [attempt(1, sha=OTHER), attempt(2, sha=OTHER)]),
]


@pytest.fixture(scope="module")
def records(spark):
    rows = [(i, "?", model, attempts, ("file", 0, at)) for at, (i, model, attempts) in enumerate(LOG)]
    return spark.createDataFrame(rows, f"""question_id STRING, question STRING, model STRING,
        attempts ARRAY<{schemas.ATTEMPT_STRUCT}>, read_at STRUCT<file: STRING, start: BIGINT, id: BIGINT>""")


@pytest.fixture(scope="module")
def verdicts(questions, records):
    attempts = vd.expand_attempts(vd.latest_records(records))
    return vd.verdicts(vd.classified(attempts, questions), questions).cache()


def by_id(df):
    return {r.question_id: r for r in df.collect()}


def test_verdict_of_every_kind(verdicts):
    v = by_id(verdicts)
    assert verdicts.columns == schemas.VERDICT_FIELDS
    assert tuple(v["Q1"])[3:] == ("pass_first_try", "", 1, "pass", "", "", "", "")
    assert tuple(v["Q2"])[3:] == ("pass_after_retry", "", 2, "value_mismatch", "value_mismatch", "pass", "", "")
    assert tuple(v["Q3"])[3:] == ("fail", "wrong_row_count", 2, "timeout", "timeout", "wrong_row_count",
                                  "wrong_row_count", "rows 3 != 1")
    assert tuple(v["Q4"])[3:6] == ("fail", "sql_error", 2) and v["Q4"].note == "x" * 120
    assert tuple(v["Q5"])[3:] == ("fail", "result_contract_error", 1, "result_contract_error",
                                  "result_contract_error", "", "", "nan")
    assert v["Q6"].note == f"rows 1 right, sha {OTHER[:12]} != {GOOD[:12]}"


def test_classes_come_in_order(spark, questions):
    """A rejected attempt stays rejected whatever else is wrong with it."""
    rows = [("Q1", 1, "guardrail_reject", "", None, None, "bad cell", True), ("Q2", 1, "ok", "", 1, GOOD, None, True),
            ("Q3", 1, "ok", "", 9, None, "bad cell", False), ("Q4", 1, "ok", "", 9, OTHER, None, False)]
    attempts = spark.createDataFrame(rows, """question_id STRING, attempt_n INT, outcome STRING, note STRING,
        rows BIGINT, sha256 STRING, defect STRING, oversized BOOLEAN""")
    got = by_id(vd.classified(attempts, questions))
    assert [got[q].mismatch for q in ("Q1", "Q2", "Q3", "Q4")] == [
        "guardrail_reject", "guardrail_reject", "result_contract_error", "wrong_row_count"]
    assert not any(r.ok for r in got.values())


def test_roll_ups(verdicts):
    total = vd.totals(verdicts).first().asDict()
    assert total == {"questions": 6, "pass_first_try": 1, "pass_after_retry": 1, "fail": 4, "passed": 2}
    assert {r.type: (r.n, r.passed) for r in vd.by_type(verdicts).collect()} == {
        "filter": (1, 1), "window": (2, 1), "ratio": (1, 0), "date": (2, 0)}
    assert {r.trap: (r.n, r.passed) for r in vd.by_trap(verdicts).collect()} == {"true": (2, 1), "false": (4, 1)}
    assert {r.mismatch_type: r.n for r in vd.mismatch_counts(verdicts).collect()} == {
        "wrong_row_count": 1, "sql_error": 1, "result_contract_error": 1, "value_mismatch": 1}
    assert [(r.type, r.passed, r.failed) for r in vd.type_chart(verdicts).orderBy("place").collect()] == [
        ("filter", 1, 0), ("ratio", 0, 1), ("window", 1, 1), ("date", 0, 2)]
    assert {r.trap: r.pass_rate for r in vd.trap_rates(verdicts).collect()} == {"true": 50.0, "false": 25.0}
    assert {r.status: r.n for r in vd.verdict_mix(verdicts).collect()} == {
        "pass_first_try": 1, "pass_after_retry": 1, "fail": 4}


def test_trap_without_questions_is_zero(verdicts):
    assert {r.trap: r.n for r in vd.by_trap(verdicts.where("trap = 'true'")).collect()} == {"true": 2, "false": 0}


def test_failure_chart_fills_the_taxonomy(verdicts):
    chart = vd.failure_chart(verdicts.where("mismatch_type <> 'result_contract_error'")).orderBy("place").collect()
    assert [r.mismatch_type for r in chart] == schemas.FAILURE_CLASSES
    assert [r.n for r in chart] == [1, 1, 1, 0, 0]
    assert [r.mismatch_type for r in chart if r.is_largest] == ["sql_error"]  # first name among equals
    assert not any(r.is_largest for r in vd.failure_chart(verdicts.where("status <> 'fail'")).collect())


def test_stored_totals_must_agree(verdicts):
    def failing(v, totals):
        return {r.check_name for r in checks.verdict_checks(v, totals).where("violations > 0").collect()}

    totals = vd.totals(verdicts)
    assert failing(verdicts, totals) == set()
    assert "count of pass_first_try" in failing(verdicts.withColumn("status", F.lit("pass_first_try")), totals)
    inflated = totals.withColumn("pass_first_try", F.col("questions") + 7).withColumn("passed", F.col("pass_first_try"))
    assert {"verdicts sum to questions", "passed sum"} <= failing(verdicts, inflated)
    assert failing(verdicts.unionByName(verdicts.limit(1)), totals) >= {"unique question ids", "question count"}
    odd = verdicts.withColumn("status", F.when(F.col("question_id") == "Q6", "maybe").otherwise(F.col("status")))
    assert "status vocabulary" in failing(odd, totals)


def test_summary_document(spark, verdicts):
    import json

    receipt = spark.createDataFrame([("m", "2026-01-02")], "model STRING, run_date STRING")
    got = json.loads(vd.summary_json(verdicts, receipt).first().value)
    assert got["receipt"] == {"model": "m", "run_date": "2026-01-02"}
    assert got["totals"]["passed"] == 2 and got["by_trap"]["true"] == {"n": 2, "passed": 1}
    assert list(got["by_type"]) == sorted(got["by_type"])


def test_runs_are_compared(verdicts):
    old = vd.totals(verdicts.where("type <> 'date'"))
    rows = {r.measure: (r.old_n, r.new_n, r.difference) for r in vd.compare_totals(old, vd.totals(verdicts)).collect()}
    assert rows["questions"] == (4, 6, 2) and rows["fail"] == (2, 4, 2) and rows["passed"] == (2, 2, 0)


def test_models_and_missing_candidates(spark, questions, records):
    meta = spark.createDataFrame([("m0",)], "model STRING")
    assert sorted(r.model for r in vd.models_used(vd.latest_records(records), meta, questions).collect()) == ["m0", "m2", "m3"]
    vd.require_candidates(questions, records)
    with pytest.raises(ValueError, match="questions without an attempt: \\['Q5'\\]"):
        vd.require_candidates(questions, records.where("question_id <> 'Q5'"))


def test_done_and_pending(questions, records):
    done = vd.done_questions(records, questions)
    assert sorted(r.question_id for r in done.collect()) == ["Q1", "Q2", "Q3", "Q4", "Q6"]
    assert [r.question_id for r in vd.pending_questions(questions, done).collect()] == ["Q5"]


def test_drift_and_repin(questions):
    now = questions.withColumn("sha256", F.when(F.col("question_id") == "Q2", OTHER).otherwise(F.col("sha256")))
    assert [r.question_id for r in vd.drifted(questions, now).collect()] == ["Q2"]
    assert vd.drifted(questions, questions).isEmpty()
    missing = now.where("question_id <> 'Q1'")
    assert sorted(r.question_id for r in vd.drifted(questions, missing).collect()) == ["Q1", "Q2"]
    pinned = vd.repinned(questions, now)
    assert pinned.columns == questions.columns and vd.drifted(pinned, now).isEmpty()


def test_run_identity(spark, questions):
    base = {"provider": "p", "model": "m", "temperature": 0.0, "max_tokens": 5, "golden_set_version": 1,
            "contract_sha256": vd.contract_hash(questions).first()[0], "serializer_version": 2}
    schema = """provider STRING, model STRING, temperature DOUBLE, max_tokens INT, golden_set_version INT,
        contract_sha256 STRING, serializer_version INT"""

    def meta(**changes):
        row = {**base, **changes}
        return spark.createDataFrame([tuple(row[f.split()[0]] for f in schema.split(","))], schema)

    vd.require_same_run(meta(), meta())
    with pytest.raises(ValueError, match="temperature"):
        vd.require_same_run(meta(), meta(temperature=0.5))
    with pytest.raises(ValueError, match="provider"):
        vd.require_same_run(meta(provider=None), meta())
    other = questions.withColumn("type", F.lit("x"))
    assert vd.contract_hash(other).first()[0] != base["contract_sha256"]
    assert vd.contract_hash(questions.orderBy(F.desc("question_id"))).first()[0] == base["contract_sha256"]
