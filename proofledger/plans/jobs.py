"""The two jobs end to end: build the table from raw files, verify a log of attempts against it."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofledger.operators.matching import require_none
from proofledger.plans import replay as rp
from proofledger.plans import staging
from proofledger.plans import verdicts as vd
from proofledger.session import work_path
from proofledger.sources import contract, manifest, publish, readers, sinks


def build_table(spark: SparkSession, source: str, root: str, as_of: str, published_at: str,
                floors: contract.Floors = contract.Floors(), first_day: str = "2017-01-01", multi_line: bool = False) -> DataFrame:
    """Raw files to a published table. Raises, and leaves the published version in force, when the raw
    contract or a table check fails. Returns the published table. ``multi_line`` accepts line breaks inside quotes,
    and reads each file in one task. Records are parsed once, and landed; besides, the files are read as lines for the rules
    on lines and as bytes for their identity."""
    raw = readers.read_raw_text(spark, source, multi_line, check_header=False)
    records = readers.landed(raw, work_path(spark, "landed", uuid.uuid4().hex))
    contract.require_clean(contract.contract_checks(spark, source, floors, multi_line, records), "raw source validation")
    typed = readers.typed_raw(records)
    receipt = manifest.file_manifest(spark, source)
    clean, outcome = publish.publish(spark, staging.stage(typed, for_writing=True), root, receipt, staging.accounting(typed),
                                     as_of, first_day, published_at)
    if not clean:
        contract.require_clean(outcome, "table checks")
    return publish.current_table(spark, root)


def manifest_row(spark: SparkSession, source: str, dataset: dict[str, str], now: str,
                 previous: DataFrame | None = None, multi_line: bool = False) -> DataFrame:
    """One manifest row per source file: identity, coverage, receipt time, data set labels."""
    files = manifest.file_manifest(spark, source)
    raw = readers.read_raw_text(spark, source, multi_line).withColumn("file", F.element_at(F.split("_metadata.file_path", "/"), -1))
    covered = manifest.coverage_by_file(raw)
    if previous is None:
        dated = files.withColumn("retrieved_at", F.lit(now))
    else:
        dated = manifest.with_receipt_time(files, previous, now)
    labels = [F.lit(dataset.get(k)).alias(k) for k in ["dataset_id", "dataset_url", "source"]]
    return dated.join(covered, "file").select(
        *labels[:2], "file", "retrieved_at", labels[2], "bytes", "sha256", "rows", "month_min", "month_max", "months")


def text_runs(spark: SparkSession, attempts: DataFrame, as_of: str | None) -> Iterator[rp.Run]:
    """Runs from stored query texts: question_id, attempt_n, sql, order_by (NULL: the text orders itself).
    Each text is a job of its own; the texts are streamed to the driver that submits them."""
    chosen = attempts.select("question_id", "attempt_n", "sql", "order_by")
    for r in chosen.toLocalIterator():
        yield rp.sql_run(spark, r.question_id, r.attempt_n, r.sql, r.order_by, as_of)


def verify_log(spark: SparkSession, questions: DataFrame, log: DataFrame, work: str, out_root: str, cap: int | None = None,
               as_of: str | None = None, candidates_file: str | None = None, set_version: int | None = None) -> DataFrame:
    """Replay every stored attempt against its question and write verdicts, summary and a finished mark.

    ``questions`` carries query text, row order and the pinned version 1 fingerprint; ``log`` is a read log whose
    meta names run date and serializer version. The pins must be reproduced first, whatever version compares the
    attempts. ``as_of`` and ``set_version`` (of the question set) stand for the log's own where they are given.
    Query texts read the view ``resale``. ``cap`` rejects attempts with more rows.
    """
    meta_rows = readers.log_meta(log).limit(2).collect()
    if len(meta_rows) != 1:
        raise ValueError("a log needs exactly one meta record")
    meta = meta_rows[0]
    version = meta.serializer_version or 1
    day = as_of or meta.run_date
    out = sinks.run_path(out_root, meta.run_date, version)
    sinks.require_new(spark, out)
    records = vd.latest_records(readers.log_records(log))
    vd.require_candidates(questions, records)

    own = questions.select("question_id", F.lit(rp.REFERENCE).alias("attempt_n"), "sql", "order_by")
    stored = vd.expand_attempts(records).join(questions.select("question_id"), "question_id").withColumn(
        "order_by", F.lit(None).cast("array<string>"))
    runs = chain(text_runs(spark, own, day), text_runs(spark, stored, day))
    attempts, rows = rp.replay(spark, runs, work)
    pins = rp.references(rp.fingerprinted(attempts, rows, 1, cap))
    require_none(pins.where("outcome <> 'ok' OR oversized"), "a question's own answer failed", "question_id")
    reproduced = vd.drifted(questions, pins).isEmpty()
    if not reproduced:
        require_none(vd.drifted(questions, pins), "pins that the table no longer gives", "question_id")
    found = rp.fingerprinted(attempts, rows, version, cap)
    in_log = stored.groupBy("question_id").agg(F.max("stored").alias("stored"))
    judged = vd.classified(rp.candidates(found, in_log), rp.references(found), cap)
    sinks.write_verdicts(vd.verdicts(judged, questions), f"{out}/results")
    verdicts = readers.read_verdicts(spark, f"{out}/results")
    names = vd.models_used(records, readers.log_meta(log), questions)
    models = names.agg(F.array_sort(F.collect_set("model")).alias("models_used"))
    set_number = F.lit(set_version).cast("int") if set_version is not None else F.col("golden_set_version")
    receipt = readers.log_meta(log).select(
        "model", "run_date", "temperature", "max_tokens", "prompt", set_number.alias("golden_set_version"),
        F.lit(day).alias("as_of"), F.lit(candidates_file).cast("string").alias("candidates_file"),
        F.lit(reproduced).alias("fingerprints_verified"), F.lit(version).alias("serializer_version")).crossJoin(
        F.broadcast(models))
    sinks.write_summary(vd.summary_json(verdicts, receipt), f"{out}/summary")
    sinks.mark_finished(spark, out)
    return verdicts


def verify_published(spark: SparkSession, root: str, source: str, locked: DataFrame, questions: DataFrame,
                     log: DataFrame, work: str, out_root: str, **options) -> DataFrame:
    """``verify_log`` on the published table, after the identity gate: the locked (file, sha256) set must
    equal the source files and the receipt stored with the table, else nothing is run."""
    manifest.require_identity(locked, manifest.file_manifest(spark, source), publish.current_receipt(spark, root))
    publish.current_table(spark, root).createOrReplaceTempView("resale")
    return verify_log(spark, questions, log, work, out_root, **options)
