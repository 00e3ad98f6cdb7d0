"""Attempts against pinned references: classes, verdicts, roll-ups, run bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofledger import schemas
from proofledger.functions.numeric import round_places
from proofledger.operators.matching import require_none, without_match


# ---- the log ----


def latest_records(records: DataFrame) -> DataFrame:
    """The record of each question that comes last in the log (``read_at``: file, place in the file)."""
    rec = F.struct("question", "model", "attempts", "read_at")
    return records.groupBy("question_id").agg(F.max_by(rec, "read_at").alias("rec")).select("question_id", "rec.*")


def expand_attempts(records: DataFrame, at_most: int | None = 2) -> DataFrame:
    """One row per attempt; ``stored`` is the number of attempts in the record."""
    counted = F.slice("attempts", 1, at_most) if at_most else F.col("attempts")
    return records.select("question_id", F.size("attempts").alias("stored"),
                          F.posexplode(counted).alias("p", "a")).select(
        "question_id", "stored", (F.col("p") + 1).alias("attempt_n"), "a.sql", "a.outcome",
        F.coalesce("a.note", F.lit("")).alias("note"),
        F.element_at("a.fingerprint", 1).try_cast("bigint").alias("rows"),
        F.element_at("a.fingerprint", 2).alias("sha256"))


def require_candidates(questions: DataFrame, records: DataFrame) -> None:
    require_none(without_match(questions, records, ["question_id"]), "questions without an attempt", "question_id")


def models_used(latest: DataFrame, meta: DataFrame, questions: DataFrame) -> DataFrame:
    """Distinct models of the records that count, the run's own where a record names none.

    Superseded records and records of other questions do not count."""
    run = meta.agg(F.first("model").alias("run_model"))
    return (latest.join(questions.select("question_id"), "question_id", "left_semi").select("model").crossJoin(F.broadcast(run))
            .select(F.coalesce("model", "run_model").alias("model")).distinct())


# ---- references ----


def drifted(pinned: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Questions whose recomputed fingerprint is not the pinned one."""
    a = pinned.select("question_id", F.col("rows").alias("want_rows"), F.col("sha256").alias("want_sha"))
    joined = a.join(recomputed.select("question_id", "rows", "sha256"), "question_id", "left")
    same = F.col("want_rows").eqNullSafe(F.col("rows")) & F.col("want_sha").eqNullSafe(F.col("sha256"))
    return joined.where(~same)


def repinned(questions: DataFrame, recomputed: DataFrame) -> DataFrame:
    """The question set with recomputed fingerprints in place of the pinned ones."""
    new = recomputed.select("question_id", "rows", "sha256")
    return questions.drop("rows", "sha256").join(new, "question_id", "left").select(*questions.columns)


# ---- classification ----


def classified(attempts: DataFrame, references: DataFrame, cap: int | None = None) -> DataFrame:
    """Adds ``mismatch`` ('' for a match), ``reason`` and ``ok`` to each attempt.

    attempts: question_id, attempt_n, outcome, note, rows, sha256, and optionally defect, oversized.
    """
    for name, kind in [("defect", "string"), ("oversized", "boolean")]:
        if name not in attempts.columns:
            attempts = attempts.withColumn(name, F.lit(None).cast(kind))
    want = references.select("question_id", F.col("rows").alias("want_rows"), F.col("sha256").alias("want_sha"))
    outcome, over = F.col("outcome"), F.coalesce("oversized", F.lit(False))
    unreadable = F.col("defect").isNotNull() | (outcome == "result_contract_error")
    mismatch = (
        F.when((outcome == "guardrail_reject") | over, F.lit("guardrail_reject"))
        .when(outcome == "timeout", F.lit("timeout"))
        .when(outcome == "sql_error", F.lit("sql_error"))
        .when(unreadable, F.lit("result_contract_error"))
        .when(~F.col("rows").eqNullSafe(F.col("want_rows")), F.lit("wrong_row_count"))
        .when(~F.col("sha256").eqNullSafe(F.col("want_sha")), F.lit("value_mismatch"))
        .otherwise(F.lit(""))
    )

    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("None"))

    def head(c: str) -> Column:
        return F.substring(text(c), 1, 12)

    # The wording of the notes, which verdict files carry.
    reason = (
        F.when(F.col("mismatch") == "", F.lit(""))
        .when(over, F.lit(f"row cap exceeded ({cap})"))
        .when(F.col("mismatch") == "result_contract_error", F.coalesce("defect", "note"))
        .when(F.col("mismatch") == "wrong_row_count",
              F.concat(F.lit("rows "), text("rows"), F.lit(" != "), text("want_rows")))
        .when(F.col("mismatch") == "value_mismatch",
              F.concat(F.lit("rows "), text("rows"), F.lit(" right, sha "), head("sha256"), F.lit(" != "),
                       head("want_sha")))
        .otherwise(F.coalesce("note", F.lit("")))
    )
    return (attempts.join(want, "question_id", "left").withColumn("mismatch", mismatch)
            .withColumn("reason", reason).withColumn("ok", (outcome == "ok") & (F.col("mismatch") == "")))


# ---- verdicts ----


def verdicts(attempts: DataFrame, questions: DataFrame) -> DataFrame:
    """One row per question from its classified attempts 1 and 2."""
    def of(n: int, c: str) -> Column:
        return F.max(F.when(F.col("attempt_n") == n, F.col(c)))

    per_question = attempts.groupBy("question_id").agg(
        F.max("stored").alias("stored"),
        *[of(n, c).alias(f"{c}{n}") for n in (1, 2) for c in ("ok", "mismatch", "reason")],
    )
    first, second = F.coalesce("ok1", F.lit(False)), F.coalesce("ok2", F.lit(False))
    joined = questions.select("question_id", "type", "trap").join(per_question, "question_id")
    last_mismatch, last_reason = F.coalesce("mismatch2", "mismatch1"), F.coalesce("reason2", "reason1")
    return joined.select(
        "question_id",
        "type",
        F.col("trap").cast("string").alias("trap"),
        F.when(first, "pass_first_try").when(second, "pass_after_retry").otherwise("fail").alias("status"),
        F.when(first | second, "").otherwise(last_mismatch).alias("mismatch_type"),
        F.when(first, 1).when(second, 2).otherwise(F.col("stored")).alias("attempts"),
        F.when(first, "pass").otherwise(F.col("mismatch1")).alias("attempt1_status"),
        F.when(first, "").otherwise(F.col("mismatch1")).alias("attempt1_mismatch"),
        F.when(F.col("ok2").isNull(), "").when(second, "pass").otherwise(F.col("mismatch2")).alias("attempt2_status"),
        F.when(F.col("ok2").isNull() | second, "").otherwise(F.col("mismatch2")).alias("attempt2_mismatch"),
        F.when(first, "").otherwise(F.substring(last_reason, 1, schemas.NOTE_LENGTH)).alias("note"),
    )


def _passed() -> Column:
    return F.count_if(F.col("status").isin("pass_first_try", "pass_after_retry")).alias("passed")


def totals(v: DataFrame) -> DataFrame:
    return v.agg(F.count(F.lit(1)).alias("questions"),
                 *[F.count_if(F.col("status") == s).alias(s) for s in schemas.STATUSES], _passed())


def by_type(v: DataFrame) -> DataFrame:
    return v.groupBy("type").agg(F.count(F.lit(1)).alias("n"), _passed())


def by_trap(v: DataFrame) -> DataFrame:
    """Both trap values, zero-filled."""
    both = v.sparkSession.createDataFrame([("true",), ("false",)], "trap STRING")
    seen = v.groupBy("trap").agg(F.count(F.lit(1)).alias("n"), _passed())
    return both.join(seen, "trap", "left").na.fill(0)


def mismatch_counts(v: DataFrame) -> DataFrame:
    failed = v.where((F.col("status") == "fail") & (F.col("mismatch_type") != ""))
    return failed.groupBy("mismatch_type").agg(F.count(F.lit(1)).alias("n"))


# ---- figures' data ----


def type_chart(v: DataFrame, type_order: list[str] | None = None) -> DataFrame:
    """Passed and failed per type; ``place`` follows the fixed type order, other types share the place after it."""
    order = type_order or schemas.QUESTION_TYPES
    places = v.sparkSession.createDataFrame([(t, i) for i, t in enumerate(order)], "type STRING, place INT")
    return by_type(v).join(F.broadcast(places), "type", "left").select(
        F.coalesce("place", F.lit(len(order))).alias("place"), "type", "passed", (F.col("n") - F.col("passed")).alias("failed"))


def trap_rates(v: DataFrame) -> DataFrame:
    rate = F.lit(100.0) * F.col("passed") / F.nullif(F.col("n"), F.lit(0))
    return by_trap(v).select("trap", "n", "passed", round_places(rate, 2).alias("pass_rate"))


def failure_chart(v: DataFrame) -> DataFrame:
    """Every class of the taxonomy, zero-filled, and after them any other that occurs, with the largest one marked."""
    classes = v.sparkSession.createDataFrame([(c, i) for i, c in enumerate(schemas.FAILURE_CLASSES)],
                                             "mismatch_type STRING, place INT")
    counts = mismatch_counts(v)
    largest = counts.agg(F.max_by("mismatch_type", F.struct(F.col("n"), _name_descending())).alias("largest"))
    filled = classes.join(counts, "mismatch_type", "full_outer").na.fill(0, ["n"])
    return filled.crossJoin(F.broadcast(largest)).select(
        F.coalesce("place", F.lit(len(schemas.FAILURE_CLASSES))).alias("place"), "mismatch_type", "n", F.col("mismatch_type").eqNullSafe(F.col("largest")).alias("is_largest"))


def _name_descending() -> Column:
    """A key that is larger for the alphabetically earlier class, so ties go to the first name."""
    classes = sorted([*schemas.FAILURE_CLASSES, "result_contract_error"])
    return F.lit(len(classes)) - F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("mismatch_type"))


def verdict_mix(v: DataFrame) -> DataFrame:
    return totals(v).unpivot([], schemas.STATUSES, "status", "n")


# ---- summary, run comparison ----


def roll_ups(v: DataFrame) -> DataFrame:
    """kind, key, questions, one column per status, passed: totals (kind total), types, traps and failure classes from one scan."""
    failed = F.when((F.col("status") == "fail") & (F.col("mismatch_type") != ""), F.col("mismatch_type"))
    grouped = v.select("type", "trap", failed.alias("mismatch"), "status").groupingSets(
        [["type"], ["trap"], ["mismatch"], []], "type", "trap", "mismatch").agg(
        F.grouping_id().alias("left_out"), F.count(F.lit(1)).alias("questions"),
        *[F.count_if(F.col("status") == s).alias(s) for s in schemas.STATUSES], _passed())
    # Bits of what a row is not grouped by: type 4, trap 2, mismatch 1.
    kinds = {3: ("type", F.col("type")), 5: ("trap", F.col("trap")), 6: ("mismatch", F.col("mismatch")), 7: ("total", F.lit(""))}
    kind, key = (F.coalesce(*[F.when(F.col("left_out") == bits, found) for bits, found in pairs])
                 for pairs in ([(b, F.lit(name)) for b, (name, _) in kinds.items()], [(b, c) for b, (_, c) in kinds.items()]))
    counted = grouped.select(kind.alias("kind"), key.alias("key"), "questions", *schemas.STATUSES, "passed")
    return counted.where((F.col("kind") != "mismatch") | F.col("key").isNotNull())


def summary_json(v: DataFrame, receipt: DataFrame) -> DataFrame:
    """The run summary as one JSON text row, from one aggregate over the verdicts.

    Types, traps and failure classes are small dimensions, and they are grouped before they are nested.
    """
    measures = ["questions", *schemas.STATUSES, "passed"]
    n_passed = F.struct(F.col("questions").alias("n"), "passed")
    none = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("passed"))

    def of(kind: str, value: Column) -> Column:
        return F.when(F.col("kind") == kind, value)

    def nested(kind: str, value: Column) -> Column:
        return F.map_from_entries(F.array_sort(F.collect_list(of(kind, F.struct("key", value.alias("value"))))))

    def trap(key: str) -> Column:
        return F.coalesce(F.max(F.when((F.col("kind") == "trap") & (F.col("key") == key), n_passed)), none)

    no_totals = F.struct(*[F.lit(0).cast("bigint").alias(m) for m in measures])
    parts = roll_ups(v).agg(
        F.coalesce(F.max(of("total", F.struct(*measures))), no_totals).alias("totals"),
        nested("mismatch", F.col("questions")).alias("mismatch_counts"), nested("type", n_passed).alias("by_type"),
        F.create_map(F.lit("false"), trap("false"), F.lit("true"), trap("true")).alias("by_trap"))
    whole = receipt.select(F.struct("*").alias("receipt")).crossJoin(F.broadcast(parts))
    return whole.select(F.to_json(F.struct("receipt", "totals", "mismatch_counts", "by_type", "by_trap")).alias("value"))


def compare_totals(old: DataFrame, new: DataFrame) -> DataFrame:
    """(measure, old_n, new_n, difference) of two runs' totals."""
    columns = ["questions", *schemas.STATUSES, "passed"]
    a = old.unpivot([], columns, "measure", "old_n")
    b = new.unpivot([], columns, "measure", "new_n")
    return a.join(F.broadcast(b), "measure").withColumn("difference", F.col("new_n") - F.col("old_n"))


# ---- resuming a run ----


def contract_hash(questions: DataFrame) -> DataFrame:
    """Identity of a question set, as one row.

    Questions are hashed where they are, then per bucket in id order, then over the buckets in order,
    so no task holds more than one bucket's digests or 65,536 bucket digests.
    """
    digest = F.sha2(F.to_json(F.struct(*sorted(questions.columns))), 256)
    hashed = questions.select("question_id", digest.alias("digest"))

    def over(entries: Column) -> Column:
        return F.sha2(F.array_join(F.transform(F.array_sort(entries), lambda e: e["digest"]), "\n"), 256)

    bucket = F.substring(F.sha2("question_id", 256), 1, 4)
    buckets = hashed.groupBy(bucket.alias("bucket")).agg(
        over(F.collect_list(F.struct("question_id", "digest"))).alias("digest"))
    return buckets.agg(over(F.collect_list(F.struct("bucket", "digest"))).alias("contract_sha256"))


def identity_differences(stored: DataFrame, now: DataFrame) -> DataFrame:
    """Run settings that differ between a stored run and the one about to resume it."""
    fields = schemas.RUN_IDENTITY

    def tall(df: DataFrame, name: str) -> DataFrame:
        texts = df.select(*[F.col(f).cast("string").alias(f) for f in fields])
        return texts.unpivot([], fields, "field", name)

    joined = tall(stored, "stored_value").join(F.broadcast(tall(now, "new_value")), "field")
    return joined.where(~F.col("stored_value").eqNullSafe(F.col("new_value")))


def require_same_run(stored: DataFrame, now: DataFrame) -> None:
    require_none(identity_differences(stored, now), "settings differ from the run to resume", "field")


def done_questions(records: DataFrame, references: DataFrame) -> DataFrame:
    """Questions that need no further attempt: two stored, or the first one right."""
    first = F.col("attempts")[0]
    want = references.select("question_id", F.col("rows").cast("string").alias("want_rows"),
                             F.col("sha256").alias("want_sha"))
    right = ((first["outcome"] == "ok")
             & first["fingerprint"].eqNullSafe(F.array("want_rows", "want_sha")))
    joined = latest_records(records).join(want, "question_id", "left")
    return joined.where((F.size("attempts") >= 2) | F.coalesce(right, F.lit(False))).select("question_id")


def pending_questions(questions: DataFrame, done: DataFrame) -> DataFrame:
    return without_match(questions, done, ["question_id"])
