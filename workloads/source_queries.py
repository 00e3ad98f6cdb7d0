"""Readers, raw-file contract, manifests, publishing and writers, run on files that Spark writes first."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofledger import schemas
from proofledger.plans import staging
from proofledger.plans import verdicts as vd
from proofledger.sources import contract, manifest, publish, readers, sinks
from workloads import analogue as an
from workloads import sql
from workloads.table_queries import SPOILED, spoiled
from workloads.verdict_queries import (
    BY_TYPE_SQL,
    LOG_SQL,
    QUESTION_SQL,
    VERDICT_SQL,
    VOLUME_SQL,
    WITH_VERDICTS,
    questions,
    typed_comparison,
    verdicts,
)

FLOORS = contract.Floors(rows=240_000, first_month="1995-01", last_month="2025-06")

# ---- readers ----


def csv_scan(spark, sf_dir):
    raw = readers.read_raw_text(spark, an.raw_csv(spark, sf_dir, dirty=True))
    return readers.typed_raw(raw)


def gzip_scan(spark, sf_dir):
    raw = readers.spread(readers.read_raw_text(spark, an.raw_csv(spark, sf_dir, codec="gzip")))
    return readers.typed_raw(raw).groupBy("town", "flat_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("resale_price").alias("low"), F.max("resale_price").alias("high"),
        F.sum("lease_commence_date").alias("years"))


def log_scan(spark, sf_dir):
    log = readers.read_log(spark, an.event_log(spark, sf_dir))
    attempts = vd.expand_attempts(vd.latest_records(readers.log_records(log)))
    return attempts.select("question_id", "attempt_n", "stored", "outcome", "note", "rows", "sha256")


def question_scan(spark, sf_dir):
    def make(path):
        sinks.write_json(questions(spark, sf_dir), path)

    read = readers.read_questions(spark, an.made_once(spark, sf_dir, "questions", make))
    return read.select("question_id", "type", "trap", "rows", "sha256")


def verdict_csv(spark, sf_dir):
    def make(path):
        sinks.write_verdicts(verdicts(spark, sf_dir), path)

    return readers.read_verdicts(spark, an.made_once(spark, sf_dir, "verdict_csv", make))


# ---- raw-file contract ----


def broken_csv(spark, sf_dir):
    """Raw files with broken records: too few fields, NaN, inf, odd quoting, besides the dirty values.

    Every file starts with the header.
    """
    def make(path):
        raw = an.raw_table(spark, sf_dir, dirty=True)
        brand, block = F.col("street_name"), F.col("block")
        price = (F.when((brand == "Brand#9") & (block == "7"), F.lit("inf"))
                 .when((brand == "Brand#8") & (block == "8"), F.lit("NaN"))
                 .otherwise(F.col("resale_price").cast("string")))
        model = (F.when((brand == "Brand#2") & (block == "3"), F.lit('"hot" gear'))
                 .when((brand == "Brand#2") & (block == "4"), F.lit('"big, ""red"" gear"'))
                 .otherwise(F.col("flat_model")))
        fields = raw.withColumn("resale_price", price).withColumn("flat_model", model)
        whole = F.concat_ws(",", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in schemas.RAW_FIELDS])
        line = F.when((brand == "Brand#5") & (block == "5"), F.concat_ws(",", "month", "town")).otherwise(whole)
        # One column named as the header, without quoting: the writer starts every file with it, and no line moves.
        (fields.select(line.alias(schemas.RAW_HEADER)).write.mode("errorifexists").option("header", True).option("quote", "")
         .option("sep", "\x01").option("emptyValue", "").option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False).csv(path))

    return an.made_once(spark, sf_dir, "broken_csv", make)


def contract_checks(spark, sf_dir):
    return contract.contract_checks(spark, broken_csv(spark, sf_dir), FLOORS)


def contract_offenders(spark, sf_dir):
    """Broken records per set of broken rules and town."""
    bad = contract.offenders(readers.read_raw_text(spark, broken_csv(spark, sf_dir)))
    return bad.groupBy(F.array_join("rules", ", ").alias("rules"), "town").agg(F.count(F.lit(1)).alias("n"))


def coverage(spark, sf_dir):
    return manifest.coverage(readers.read_raw_text(spark, broken_csv(spark, sf_dir)))


# ---- file identity ----


def files(spark, sf_dir):
    return manifest.file_manifest(spark, sf_dir, "*.parquet")


def text_files(spark, sf_dir):
    """Identity of text files whose lines are known: a file of customers per nation."""
    def make(path):
        line = F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment")
        lines = an.table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", line.alias("value"))
        placed = lines.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey")
        placed.select("c_nationkey", "value").write.partitionBy("c_nationkey").text(path)

    return manifest.file_manifest(spark, f"{an.made_once(spark, sf_dir, 'customer_files', make)}/*").select("bytes", "sha256")


def receipt_times(spark, sf_dir):
    """Earlier receipts keep their time for unchanged files; one file is made to look changed."""
    now = files(spark, sf_dir)
    before = now.withColumn("retrieved_at", F.lit("2026-01-01T23:30:00+08:00")).withColumn(
        "sha256", F.when(F.col("file") == "events.parquet", F.lit("0" * 64)).otherwise(F.col("sha256")))
    kept = manifest.with_receipt_time(now, before, "2026-06-01T08:00:00+08:00")
    return kept.select("file", "retrieved_at",
                       manifest.receipt_day(F.col("retrieved_at"), "Asia/Singapore").alias("local_day"))


def identity_gate(spark, sf_dir):
    """Locked hashes against source files and against the receipt stored with the staged table."""
    locked = manifest.file_manifest(spark, sf_dir, "lineitem.parquet")
    receipt = publish.current_receipt(spark, an.staged_root(spark, sf_dir))
    doctored = receipt.withColumn("sha256", F.reverse("sha256"))
    return (manifest.identity_problems(locked, receipt, "table")
            .unionByName(manifest.identity_problems(locked, doctored, "doctored table"))
            .select("side", "file"))


# ---- publishing ----


def partition_counts(spark, sf_dir):
    """Rows per partition of the written table, one partition pruned away."""
    t = an.staged(spark, sf_dir).where("sale_year <> 1997")
    return t.groupBy("sale_year").agg(F.count(F.lit(1)).alias("n"), F.min("month").alias("first"),
                                      F.max("month").alias("last"))


def publish_gate(spark, sf_dir):
    """A clean version is published, a spoiled one after it is not, and readers keep the clean one."""
    def make(path):
        raw = an.raw_table(spark, sf_dir)
        clean = staging.stage(raw, for_writing=True)
        receipt = manifest.file_manifest(spark, sf_dir, "lineitem.parquet")
        counted = staging.accounting(raw)
        root = f"{path}/table"
        for label, table in [("clean", clean), ("spoiled", spoiled(clean))]:
            done, results = publish.publish(spark, table, root, receipt, counted, an.LAST_DAY, an.FIRST_DAY,
                                            an.AS_OF, version=label)
            seen = publish.current_table(spark, root).agg(F.count(F.lit(1)).alias("visible_rows"),
                                                          F.min("resale_price").alias("visible_low"))
            violations = results.agg(F.sum("violations").alias("violations"))
            row = violations.crossJoin(seen).select(F.lit(label).alias("version"), F.lit(done).alias("published"), "*")
            row.write.mode("append").parquet(f"{path}/outcome")

    return spark.read.parquet(f"{an.made_once(spark, sf_dir, 'gate', make)}/outcome")


# ---- writers ----


def summary_document(spark, sf_dir):
    """The written JSON summary, read back and unfolded: one row per type."""
    def make(path):
        receipt = readers.log_meta(readers.read_log(spark, an.event_log(spark, sf_dir))).select("model", "run_date")
        sinks.write_summary(vd.summary_json(verdicts(spark, sf_dir), receipt), path)

    schema = """STRUCT<receipt: STRUCT<model: STRING, run_date: STRING>, totals: STRUCT<questions: BIGINT,
        pass_first_try: BIGINT, pass_after_retry: BIGINT, fail: BIGINT, passed: BIGINT>,
        mismatch_counts: MAP<STRING, BIGINT>, by_type: MAP<STRING, STRUCT<n: BIGINT, passed: BIGINT>>,
        by_trap: MAP<STRING, STRUCT<n: BIGINT, passed: BIGINT>>>"""
    text = spark.read.text(an.made_once(spark, sf_dir, "summary", make))
    whole = text.select(F.from_json("value", schema).alias("s")).select("s.*")
    return whole.select(F.col("receipt.model").alias("model"), "totals.questions", "totals.passed",
                        F.col("by_trap")["true"]["n"].alias("traps"),
                        F.coalesce(F.col("mismatch_counts")["timeout"], F.lit(0).cast("bigint")).alias("timeouts"),
                        F.explode("by_type").alias("type", "t")).select(
        "model", "questions", F.col("passed").alias("all_passed"), "traps", "timeouts", "type", "t.n",
        F.col("t.passed").alias("type_passed"))


def replay_documents(spark, sf_dir):
    """Nested evidence per question, written and read back."""
    def make(path):
        sinks.write_json(sinks.replay_documents(typed_comparison(spark, sf_dir)), path)

    schema = """question_id BIGINT, status STRING, reference_fingerprint ARRAY<STRING>, attempts ARRAY<STRUCT<attempt_n: INT, outcome: STRING,
        fingerprint: ARRAY<STRING>, match: BOOLEAN, direct_rows_equal: BOOLEAN>>"""
    docs = spark.read.schema(schema).json(an.made_once(spark, sf_dir, "evidence", make))
    wanted = F.element_at("reference_fingerprint", 1).alias("reference_rows")
    return docs.select("question_id", "status", wanted, F.explode("attempts").alias("a")).select(
        "question_id", "status", "reference_rows", "a.attempt_n", "a.outcome", F.element_at("a.fingerprint", 1).alias("rows"),
        "a.match", "a.direct_rows_equal")


def separate_runs(spark, sf_dir):
    """Two runs of the same verdicts land in folders of their own; a repeated one is refused."""
    def make(path):
        v = verdicts(spark, sf_dir)
        for day, version in [("2001-06-30", 1), ("2001-07-01", 2)]:
            sinks.write_json(v, sinks.run_path(path, day, version))
        try:
            sinks.write_json(v, sinks.run_path(path, "2001-06-30", 1))
        except Exception as refused:  # noqa: BLE001
            if "PATH_ALREADY_EXISTS" not in str(refused):
                raise
        else:
            raise ValueError("a recorded run was overwritten")

    schema = f"{schemas.VERDICT_SCHEMA}, run_date DATE, serializer_version INT"
    runs = spark.read.schema(schema).json(an.made_once(spark, sf_dir, "runs", make))
    return runs.groupBy("run_date", "serializer_version", "status").agg(F.count(F.lit(1)).alias("n"))


_BROKEN = sql.raw("""
    , broken AS (SELECT *,
        CASE WHEN street_name = 'Brand#9' AND block = '7' THEN 'inf'
          WHEN street_name = 'Brand#8' AND block = '8' THEN 'NaN' ELSE CAST(resale_price AS VARCHAR) END AS price_text,
        street_name = 'Brand#5' AND block = '5' AS short FROM raw),
    ruled AS (SELECT *,
        NOT short AND (price_text IS NULL OR price_text IN ('inf', 'NaN') OR resale_price <= 0 OR floor_area_sqm <= 0)
          AS bad_number,
        NOT short AND (remaining_lease IS NULL OR remaining_lease LIKE '%99 months') AS bad_lease,
        NOT short AND month = 'bad' AS bad_month FROM broken)
""", dirty=True)

ENTRIES: dict[str, tuple] = {
    "source_csv_scan": (csv_scan, sql.raw("SELECT * FROM raw", dirty=True)),
    "source_gzip_scan": (gzip_scan, sql.raw("""
        SELECT town, flat_type, count(*) AS n, min(resale_price) AS low, max(resale_price) AS high,
          CAST(sum(lease_commence_date) AS BIGINT) AS years FROM raw GROUP BY 1, 2""")),
    "source_log_scan": (log_scan, f"""{LOG_SQL}
        SELECT question_id, attempt_n, stored, outcome, note, rows, sha256 FROM att"""),
    "source_question_set": (question_scan, f"{QUESTION_SQL} SELECT * FROM qs"),
    "sink_verdict_csv": (verdict_csv, VERDICT_SQL),
    "contract_checks": (contract_checks, _BROKEN + f"""
        SELECT 'header matches' AS check_name, 0 AS violations UNION ALL SELECT 'valid utf-8', 0
        UNION ALL SELECT 'not empty', 0
        UNION ALL SELECT 'well-formed quoting', count(*) FROM ruled WHERE street_name = 'Brand#2' AND block = '3'
        UNION ALL SELECT 'eleven fields', count(*) FROM ruled WHERE short
        UNION ALL SELECT 'positive finite numbers', count(*) FROM ruled WHERE bad_number
        UNION ALL SELECT 'lease text', count(*) FROM ruled WHERE bad_lease
        UNION ALL SELECT 'month parses', count(*) FROM ruled WHERE bad_month
        UNION ALL SELECT 'row floor', CAST(count(*) < {FLOORS.rows} AS BIGINT) FROM ruled
        UNION ALL SELECT 'first month floor', CAST(min(month) > '{FLOORS.first_month}' AS BIGINT) FROM ruled
        UNION ALL SELECT 'last month floor', CAST(max(month) < '{FLOORS.last_month}' AS BIGINT) FROM ruled
          WHERE month <> 'bad'
        UNION ALL SELECT 'has a month', 0"""),
    "contract_offenders": (contract_offenders, _BROKEN + """
        SELECT concat_ws(', ', CASE WHEN short THEN 'eleven fields' END,
            CASE WHEN bad_number THEN 'positive finite numbers' END,
            CASE WHEN bad_lease THEN 'lease text' END, CASE WHEN bad_month THEN 'month parses' END) AS rules,
          town, count(*) AS n
        FROM ruled WHERE short OR bad_number OR bad_lease OR bad_month GROUP BY 1, 2"""),
    "contract_coverage": (coverage, _BROKEN + """
        SELECT count(*) AS rows, min(month) AS month_min, max(month) AS month_max, count(DISTINCT month) AS months
        FROM (SELECT CASE WHEN month <> 'bad' THEN month END AS month FROM ruled)"""),
    "manifest_files": (text_files, """WITH whole AS (
          SELECT string_agg(c_custkey || ',' || c_name || ',' || c_mktsegment || chr(10), '' ORDER BY c_custkey) AS bytes
          FROM customer GROUP BY c_nationkey)
        SELECT CAST(strlen(bytes) AS BIGINT) AS bytes, sha256(bytes) AS sha256 FROM whole"""),
    "manifest_receipt_times": (receipt_times, f"""
        SELECT name || '.parquet' AS file,
          CASE name WHEN 'events' THEN '2026-06-01T08:00:00+08:00' ELSE '2026-01-01T23:30:00+08:00' END AS retrieved_at,
          CASE name WHEN 'events' THEN DATE '2026-06-01' ELSE DATE '2026-01-01' END AS local_day
        FROM (VALUES {', '.join(f"('{t}')" for t in an.TABLES)}) t(name)"""),
    "manifest_identity_gate": (identity_gate, "SELECT 'doctored table' AS side, 'lineitem.parquet' AS file"),
    "publish_partition_counts": (partition_counts, sql.resale("""
        SELECT sale_year, count(*) AS n, min(month) AS first, max(month) AS last FROM resale
        WHERE sale_year <> 1997 GROUP BY 1""")),
    "publish_gate": (publish_gate, sql.resale("").rstrip() + f""", {SPOILED},
        low AS (SELECT count(*) AS visible_rows, min(resale_price) AS visible_low FROM resale),
        bad AS (SELECT CAST(sum(
            CAST(resale_price <= 0 AS INTEGER) + CAST(floor_area_sqm <= 0 AS INTEGER)
            + CAST(sale_month < DATE '{an.FIRST_DAY}' OR sale_month > DATE '{an.LAST_DAY}' AS INTEGER)
            + CAST(month <> strftime(sale_month, '%Y-%m') AS INTEGER)
            + CAST(coalesce(town, '') = '' AS INTEGER) + CAST(coalesce(flat_type, '') = '' AS INTEGER)
            + CAST(coalesce(price_per_sqm, 0) <= 0 AS INTEGER) + CAST(storey_low < 1 OR storey_high < storey_low AS INTEGER)
            + CAST(remaining_lease_years NOT BETWEEN 0 AND 99 AS INTEGER)) AS BIGINT) AS violations FROM spoiled)
        SELECT 'clean' AS version, true AS published, CAST(0 AS BIGINT) AS violations, * FROM low
        UNION ALL SELECT 'spoiled', false, violations, low.* FROM bad, low"""),
    "sink_summary_json": (summary_document, f"""{WITH_VERDICTS}
        SELECT 'model-default' AS model, t.questions, t.all_passed, t.traps, t.timeouts, b.type, b.n, b.type_passed
        FROM (SELECT count(*) AS questions, count(*) FILTER (WHERE status <> 'fail') AS all_passed,
                count(*) FILTER (WHERE trap = 'true') AS traps,
                count(*) FILTER (WHERE mismatch_type = 'timeout') AS timeouts FROM v) t,
             ({BY_TYPE_SQL}) b"""),
    "sink_replay_documents": (replay_documents, f"""{VOLUME_SQL}
        SELECT question_id, CASE WHEN match THEN 'pass_first_try' ELSE 'fail' END AS status, attempt_n, outcome,
          CAST(want_rows AS VARCHAR) AS reference_rows, CAST(rows AS VARCHAR) AS rows, match, direct_rows_equal FROM typed"""),
    "sink_separate_runs": (separate_runs, f"""{WITH_VERDICTS}
        SELECT CAST(d AS DATE) AS run_date, s AS serializer_version, status, count(*) AS n
        FROM v, (VALUES ('2001-06-30', 1), ('2001-07-01', 2)) r(d, s) GROUP BY 1, 2, 3"""),
}
