from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from proofledger.operators.folding import BLOCK, FOLDS
from proofledger.plans import jobs
from proofledger.plans import replay as rp
from proofledger.plans import verdicts as vd
from proofledger.plans.guard import read_text
from proofledger.plans.questions import BY_ID, QUESTIONS, Subject, answer
from proofledger.plans.staging import stage
from proofledger.plans.verdicts import repinned
from proofledger.sources import readers


@pytest.fixture(scope="module")
def resale(spark):
    """A few hand-made sales with sparse months, an even split, a near-miss label and repeated blocks."""
    base = {"town": "TAMPINES", "flat_type": "4 ROOM", "block": "27", "street_name": "ST 1", "storey_range": "13 TO 15",
            "floor_area_sqm": 100.0, "flat_model": "Model A", "lease_commence_date": 2000,
            "remaining_lease": "85 years 06 months", "resale_price": 500000.0}
    rows = []
    for m in range(1, 13):
        rows.append({**base, "month": f"2023-{m:02d}", "resale_price": 500000.0 + 1000 * m})
        rows.append({**base, "month": f"2022-{m:02d}", "resale_price": 480000.0 + 500 * m, "town": "BEDOK"})
    rows += [{**base, "month": "2023-03", "town": "BUKIT MERAH", "block": b, "street_name": s}
             for b, s in [("28", "A"), ("28", "B"), ("30", "A")]]
    for month, price in [("2022-01", 300000.0), ("2022-02", 350000.0), ("2022-05", 310000.0), ("2022-06", 400000.0)]:
        rows.append({**base, "month": month, "town": "HOUGANG", "flat_type": "2 ROOM", "flat_model": "2-room",
                     "resale_price": price, "floor_area_sqm": 45.0})
    columns = ["month", *base]
    df = spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], """month STRING, town STRING,
        flat_type STRING, block STRING, street_name STRING, storey_range STRING, floor_area_sqm DOUBLE,
        flat_model STRING, lease_commence_date INT, remaining_lease STRING, resale_price DOUBLE""")
    return stage(df).cache()


def rows_of(resale, question_id):
    return [tuple(r) for r in answer(BY_ID[question_id], resale, Subject()).collect()]


def test_every_question_runs(resale):
    assert [q.id for q in QUESTIONS] == [f"Q{i:02d}" for i in range(1, 33)]
    assert sum(q.trap for q in QUESTIONS) == 6


@pytest.mark.parametrize("question_id, want", [
    ("Q01", [(12,)]),
    ("Q03", [(0,)]),
    ("Q05", [(505000.0,)]),
    ("Q12", [("TAMPINES", "ST 1", "27", 12)]),
    ("Q13", [(3,)]),
    ("Q15", [("2022-01", 6666.67), ("2022-02", 7222.22), ("2022-05", 6888.89), ("2022-06", 7888.89)]),
    ("Q20", [(1,)]),
    ("Q21", [("TAMPINES",)]),
    ("Q22", []),
    ("Q26", [(None,)]),
    ("Q28", [("2023-12", 512000.0)]),
    ("Q32", [(6,)]),
])
def test_answers_by_hand(resale, question_id, want):
    assert rows_of(resale, question_id) == want


def test_first_change_is_null_and_year_is_text(resale):
    assert rows_of(resale, "Q14")[0][2] is None
    assert [r[0] for r in rows_of(resale, "Q17")] == ["2022", "2023"]


BODY = "SELECT town, count(*) AS n FROM resale WHERE sale_date <= CAST(:as_of AS DATE) GROUP BY town"


def replayed(spark, tmp_path, runs, version=2, cap=None):
    attempts, rows = rp.replay(spark, runs, str(tmp_path / "rows"))
    return rp.fingerprinted(attempts, rows, version, cap), rows


def test_replay_outcomes(spark, resale, tmp_path):
    resale.createOrReplaceTempView("resale")
    q = "Q1"
    runs = [
        rp.sql_run(spark, q, 0, BODY, ["n desc"], "2026-01-01"),
        rp.sql_run(spark, q, 1, "SELECT nope FROM resale"),
        rp.sql_run(spark, q, 2, "SELEC 1"),
        rp.sql_run(spark, q, 3, "SELECT CAST(concat('x', block) AS INT) AS a FROM resale"),
        rp.sql_run(spark, q, 4, "SELECT month, block FROM resale"),
        rp.sql_run(spark, q, 5, BODY + " HAVING n > 99", ["n desc"], "2026-01-01"),
        rp.sql_run(spark, q, 6, "SELECT double('NaN') AS a"),
        rp.sql_run(spark, q, 7, BODY, ["n desc"], "2022-12-31"),
        rp.sql_run(spark, q, 8, BODY, ["n"], "2026-01-01"),
        rp.sql_run(spark, q, 9, "SELECT array(1, 2) AS a"),
        rp.sql_run(spark, q, 10, BODY + " ORDER BY 2 DESC, 1", None, "2026-01-01"),
        rp.sql_run(spark, q, 11, BODY + " ORDER BY count(*) DESC, town LIMIT 50", None, "2026-01-01"),
    ]
    found, rows = replayed(spark, tmp_path, runs, cap=20)
    judged = {r.attempt_n: r for r in vd.classified(rp.candidates(found), rp.references(found), 20).collect()}
    assert [judged[n].mismatch for n in range(1, 12)] == [
        "sql_error", "sql_error", "sql_error", "guardrail_reject", "wrong_row_count", "result_contract_error",
        "wrong_row_count", "value_mismatch", "result_contract_error", "", ""]
    assert judged[4].reason == "row cap exceeded (20)" and judged[5].rows == 0
    assert judged[1].stored == 11
    typed = {r.attempt_n: r for r in rp.typed_comparison(found, rows).collect()}
    assert [n for n, r in sorted(typed.items()) if r.match] == [10, 11]


@pytest.mark.parametrize("body,outcome", [
    ("DROP VIEW resale", "guardrail_reject"), ("SELECT 1 AS a; DROP VIEW resale", "guardrail_reject"),
    ("SELECT * FROM other", "guardrail_reject"), ("SELECT * FROM parquet.`/tmp/x`", "guardrail_reject"),
    ("INSERT INTO resale SELECT 1", "guardrail_reject"), ("SELECT * FROM range(3)", "guardrail_reject"),
    ("WITH r AS (SELECT 1 AS a) SELECT * FROM r JOIN secret", "guardrail_reject"),
    ("SELECT a FROM resale WHERE (SELECT max(x) FROM hidden) > 1", "guardrail_reject"),
    ("SELECT * FROM (WITH secret AS (SELECT 1 AS x) SELECT * FROM secret) a CROSS JOIN secret b", "guardrail_reject"),
    ("SELECT 'CTE [secret]' AS c, secret.* FROM secret", "guardrail_reject"), ("SELECT * FROM global_temp.apart", "guardrail_reject"),
    ("SELECT reflect('java.lang.System', 'getenv', 'PATH') AS x FROM resale", "guardrail_reject"),
    ("SELECT * FROM VALUES (java_method('java.lang.System', 'getenv', 'PATH')) t(a)", "guardrail_reject"),
    ("SELECT TRANSFORM(town) USING 'cat' AS (a) FROM resale", "guardrail_reject"), ("SELECT CURRENT_USER AS u", "guardrail_reject"),
    ("SELECT * FROM IDENTIFIER('secret')", "guardrail_reject"), ("SELECT input_file_name() AS f FROM resale", "guardrail_reject"),
    ("SELECT twice(1) AS a", "guardrail_reject"), ("SELECT rand() AS a FROM resale", "guardrail_reject"), (" \n", "guardrail_reject"),
    ("SELECT nosuch(1) AS a FROM resale", "sql_error"), ("SELECT nope FROM resale", "sql_error"),
    ("WITH secret AS (SELECT town FROM resale) SELECT count(*) AS n FROM secret", ""), ("FROM resale |> SELECT town", ""),
    ("SELECT t.a FROM resale LATERAL VIEW explode(array(1)) t AS a", ""),
    ("SELEC 1", "sql_error"), ("SELECT ';' AS a", ""), ("WITH r AS (SELECT town FROM resale) SELECT * FROM r;", ""),
])
def test_texts_are_judged_before_they_run(spark, resale, tmp_path, body, outcome):
    resale.createOrReplaceTempView("resale")
    for name in ("secret", "hidden"):
        spark.range(1).createOrReplaceTempView(name)
    spark.range(1).createOrReplaceGlobalTempView("apart")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION twice(x INT) RETURNS INT RETURN 2 * x")
    assert read_text(spark, body, {"resale"}).outcome == outcome
    record = rp.execute(rp.sql_run(spark, "Q", 1, body), str(tmp_path), {})
    assert record[2] == (outcome or "ok")
    assert spark.catalog.tableExists("resale")


def test_unordered_text_has_one_hash(spark, resale, tmp_path):
    many = resale.unionByName(resale.withColumn("town", F.concat("town", F.lit("2")))).unionByName(
        resale.withColumn("town", F.concat("town", F.lit("3"))))
    many.createOrReplaceTempView("resale")
    body = "SELECT town, block, count(*) AS n FROM resale GROUP BY town, block"
    assert not read_text(spark, body, {"resale"}).ordered
    assert read_text(spark, f"WITH a AS ({body}) SELECT * FROM a ORDER BY n LIMIT 3", {"resale"}).ordered
    hashes = set()
    for k, partitions in enumerate((2, 3, 8)):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        found, _ = replayed(spark, tmp_path / str(k), [rp.sql_run(spark, "Q", 0, body)])
        hashes.add(rp.references(found).first().sha256)
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    resale.createOrReplaceTempView("resale")
    assert len(hashes) == 1


def test_a_long_result_is_counted_and_folded(spark, tmp_path):
    import hashlib

    df = spark.range(30_000, numPartitions=5).select((F.lit(30_000) - F.col("id")).alias("v"))
    found, rows = replayed(spark, tmp_path, [rp.Run("Q", 0, lambda: df, ("v",)), rp.Run("Q", 1, lambda: df, ("v desc",))], 3)
    assert {r.attempt_n: r.rows for r in found.collect()} == {0: 30_000, 1: 30_000}
    digests = [hashlib.sha256(f'[["number","{v}.00"]]'.encode()).hexdigest() for v in range(1, 30_001)]
    for _ in range(FOLDS):
        digests = [hashlib.sha256("\n".join(digests[k:k + BLOCK]).encode()).hexdigest() for k in range(0, len(digests), BLOCK)]
    assert [rp.references(found).first().sha256] == digests
    compared = rp.typed_comparison(found, rows).first()
    assert not compared.match and not compared.direct_rows_equal


def test_equal_texts_run_once(spark, resale, tmp_path, monkeypatch):
    resale.createOrReplaceTempView("resale")
    monkeypatch.setattr(rp, "RUNS_AT_ONCE", 2)
    done = []
    monkeypatch.setattr(rp, "execute", lambda run, path, shapes, real=rp.execute: (done.append(run.attempt_n), real(run, path, shapes))[1])
    runs = [rp.sql_run(spark, "Q", n, text) for n, text in enumerate(
        ["SELECT town FROM resale", "SELECT 1 AS a", "SELECT town FROM resale", "DROP VIEW resale", "SELECT 1 AS a"])]
    found, _ = replayed(spark, tmp_path, iter(runs))
    assert sorted(done) == [0, 1, 3]
    got = {r.attempt_n: (r.outcome, r.sha256) for r in found.collect()}
    assert got[0] == got[2] and got[1] == got[4] and got[0] != got[1] and got[3][0] == "guardrail_reject"


def test_a_failing_file_system_is_no_verdict(spark, tmp_path):
    run = rp.sql_run(spark, "Q", 1, "SELECT 1 AS a")
    assert rp.execute(run, str(tmp_path), {})[2] == "ok"
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        rp.execute(run, str(tmp_path), {})


def test_typed_comparison_agrees_with_rows(spark, resale, tmp_path):
    s = Subject()
    q14, runs = BY_ID["Q14"], []
    from proofledger.plans.questions import spellings

    wrong = {x.name: x for x in spellings("2026-01-01")}
    runs.append(rp.Run("Q15", 0, lambda: BY_ID["Q15"].build(resale, s), ("month",)))
    runs.append(rp.Run("Q15", 1, lambda: wrong["row_frame_over_history"].build(resale, s), ("month",)))
    runs.append(rp.Run("Q14", 0, lambda: q14.build(resale, s), q14.order_by))
    runs.append(rp.Run("Q14", 1, lambda: q14.build(resale, s).withColumnRenamed("med_ppsm", "m"), q14.order_by))
    found, rows = replayed(spark, tmp_path, runs)
    got = {r.question_id: (r.match, r.direct_rows_equal) for r in rp.typed_comparison(found, rows).collect()}
    assert got == {"Q15": (False, False), "Q14": (True, True)}
    differences = rp.row_differences(rows)
    keys = rp.mismatch_keys(differences, "Q15", 1).first()["keys"]
    assert keys == ["2022-06"]


def test_unchanged_answer_with_one_mutation_changes_class(spark, resale, tmp_path):
    """Dropped row, swapped order, changed grain: each is noticed as what it is."""
    by_town = resale.groupBy("town").agg(F.count("*").alias("n"))
    runs = [
        rp.Run("Q", 0, lambda: by_town, ("town",)),
        rp.Run("Q", 1, lambda: by_town.where("town <> 'BEDOK'"), ("town",)),
        rp.Run("Q", 2, lambda: by_town, ("town desc",)),
        rp.Run("Q", 3, lambda: by_town.withColumn("n", F.col("n") + F.lit(0.004)), ("town",)),
        rp.Run("Q", 4, lambda: by_town.withColumn("n", F.col("n").cast("string")), ("town",)),
    ]
    found, _ = replayed(spark, tmp_path, runs)
    judged = {r.attempt_n: r.mismatch for r in vd.classified(rp.candidates(found), rp.references(found)).collect()}
    assert judged == {1: "wrong_row_count", 2: "value_mismatch", 3: "", 4: "value_mismatch"}


def log_file(tmp_path, version, attempts):
    path = tmp_path / f"log{version}.jsonl"
    meta = {"meta": {"model": "m", "run_date": "2026-01-01", "temperature": 0, "serializer_version": version}}
    record = {"id": "Q1", "question": "?", "attempts": [
        {"n": n, "sql": text, "outcome": "ok", "note": "", "fingerprint": None} for n, text in enumerate(attempts, 1)]}
    path.write_text(json.dumps(meta) + "\n" + json.dumps(record) + "\n")
    return str(path)


@pytest.mark.parametrize("version", [1, 2])
def test_verify_log_end_to_end(spark, resale, tmp_path, version):
    resale.createOrReplaceTempView("resale")
    schema = """question_id STRING, type STRING, trap BOOLEAN, question STRING, why STRING, sql STRING,
        order_by ARRAY<STRING>, rows BIGINT, sha256 STRING"""
    unpinned = spark.createDataFrame([("Q1", "grouping", True, "?", "", BODY, ["n desc"], None, None)], schema)
    found, _ = replayed(spark, tmp_path / "pin", [rp.sql_run(spark, "Q1", 0, BODY, ["n desc"], "2026-01-01")], 1)
    questions = repinned(unpinned, rp.references(found))
    log = readers.read_log(spark, log_file(tmp_path, version, ["SELECT 1 AS a", BODY.replace("AS n", "AS c") + " ORDER BY c DESC, town"]))
    verdicts = jobs.verify_log(spark, questions, log, str(tmp_path / "work"), str(tmp_path / "out"))
    assert [(r.status, r.attempts, r.attempt1_status) for r in verdicts.collect()] == [
        ("pass_after_retry", 2, "wrong_row_count")]
    out = tmp_path / "out" / "run_date=2026-01-01" / f"serializer_version={version}" / "summary"
    summary = json.loads(spark.read.text(str(out)).first().value)
    assert summary["totals"]["passed"] == 1 and summary["receipt"]["models_used"] == ["m"]
    for _ in range(1):
        stale = questions.withColumn("sha256", F.lit("0"))
        with pytest.raises(ValueError, match="no longer gives"):
            jobs.verify_log(spark, stale, log, str(tmp_path / "work2"), str(tmp_path / "out2"))


def test_a_log_with_superseded_foreign_and_long_records(spark, resale, tmp_path):
    """The last record counts whatever its length, other questions' records do not, and all stored attempts are counted."""
    resale.createOrReplaceTempView("resale")
    schema = """question_id STRING, type STRING, trap BOOLEAN, question STRING, why STRING, sql STRING,
        order_by ARRAY<STRING>, rows BIGINT, sha256 STRING"""
    unpinned = spark.createDataFrame([("Q1", "grouping", True, "?", "", BODY, ["n desc"], None, None)], schema)
    found, _ = replayed(spark, tmp_path / "pin", [rp.sql_run(spark, "Q1", 0, BODY, ["n desc"], "2026-01-01")], 1)
    questions = repinned(unpinned, rp.references(found))

    def line(question, model, *texts):
        return {"id": question, "model": model, "attempts": [{"n": n, "sql": t, "outcome": "ok"} for n, t in enumerate(texts, 1)]}

    meta = {"meta": {"model": "m", "run_date": "2026-01-01", "serializer_version": 2, "golden_set_version": 7}}
    lines = [meta, line("Q1", "old", *[f"SELECT {k} AS a" for k in range(4)]), line("Q9", "foreign", "SELECT 1 AS a"),
             line("Q1", "new", "SELECT 1 AS a", "DROP VIEW resale", "SELECT 3 AS a")]
    path = tmp_path / "log.jsonl"
    path.write_text("\n".join(json.dumps(x) for x in lines))
    log = readers.read_log(spark, str(path))
    got = jobs.verify_log(spark, questions, log, str(tmp_path / "w"), str(tmp_path / "o"), as_of="2026-01-01",
                          candidates_file="log.jsonl", set_version=3).collect()
    assert [(r.status, r.attempts, r.attempt2_status) for r in got] == [("fail", 3, "guardrail_reject")]
    out = str(tmp_path / "o" / "run_date=2026-01-01" / "serializer_version=2")
    receipt = json.loads(spark.read.text(f"{out}/summary").first().value)["receipt"]
    assert receipt["models_used"] == ["new"] and receipt["golden_set_version"] == 3
    assert receipt["as_of"] == "2026-01-01" and receipt["candidates_file"] == "log.jsonl" and receipt["fingerprints_verified"]
    with pytest.raises(ValueError, match="finished run"):
        jobs.verify_log(spark, questions, log, str(tmp_path / "w2"), str(tmp_path / "o"))
    assert spark.catalog.tableExists("resale")


def test_identity_gate_comes_before_any_query(spark, tmp_path):
    from proofledger import schemas
    from proofledger.sources import contract, manifest, publish

    source = tmp_path / "src"
    source.mkdir()
    line = "2017-01,TOWN,4 ROOM,1,ST,01 TO 03,90,Model,2000,80 years,500000"
    (source / "raw.csv").write_text(f"{schemas.RAW_HEADER}\n{line}\n{line}\n")
    root = str(tmp_path / "table")
    jobs.build_table(spark, str(source), root, "2026-01-01", "t", contract.Floors(1, "2017-01", "2017-01"))
    locked = manifest.file_manifest(spark, str(source)).select("file", "sha256").collect()
    locked = spark.createDataFrame(locked)
    schema = """question_id STRING, type STRING, trap BOOLEAN, question STRING, why STRING, sql STRING,
        order_by ARRAY<STRING>, rows BIGINT, sha256 STRING"""
    questions = spark.createDataFrame([("Q1", "grouping", False, "?", "", BODY, ["n desc"], None, None)], schema)
    publish.current_table(spark, root).createOrReplaceTempView("resale")
    found, _ = replayed(spark, tmp_path / "pin", [rp.sql_run(spark, "Q1", 0, BODY, ["n desc"], "2026-01-01")], 1)
    questions = repinned(questions, rp.references(found))
    log = readers.read_log(spark, log_file(tmp_path, 2, [BODY + " ORDER BY n DESC"]))
    args = (root, str(source), locked, questions, log)
    done = jobs.verify_published(spark, *args, str(tmp_path / "w"), str(tmp_path / "o"))
    assert [r.status for r in done.collect()] == ["pass_first_try"]
    (source / "raw.csv").write_text(f"{schemas.RAW_HEADER}\n{line}\n{line}\n{line}\n")
    with pytest.raises(ValueError, match="identity drift"):
        jobs.verify_published(spark, *args, str(tmp_path / "w2"), str(tmp_path / "o2"))
    assert not (tmp_path / "w2").exists()


def test_documents_leave_no_shuffles_behind(spark, tmp_path):
    from workloads import source_queries

    def shuffle_files():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f for f in files.split("\n") if "/shuffle_" in f}

    items = spark.range(60).selectExpr(
        "id DIV 3 AS l_orderkey", "id + 5 AS l_partkey", "id % 4 AS l_suppkey", "cast(id % 3 AS int) AS l_linenumber", "2.0D AS l_quantity",
        "id * 1.25D AS l_extendedprice", "0.04D AS l_discount", "id % 2 / 10 AS l_tax", "'A' AS l_returnflag", "'O' AS l_linestatus",
        "timestamp_ntz'1996-03-01 00:00:00' + make_dt_interval(cast(id AS int)) AS l_shipdate")
    items.write.parquet(f"{tmp_path}/lineitem.parquet")
    before = shuffle_files()
    found = source_queries.replay_documents(spark, str(tmp_path))
    wait = time.time() + 20
    while shuffle_files() - before and time.time() < wait:
        time.sleep(0.1)
    assert not shuffle_files() - before
    kinds = {k: {(r.match, r.direct_rows_equal) for r in found.collect() if r.question_id % 7 == k} for k in (0, 1, 3, 5)}
    assert kinds == {0: {(True, True)}, 1: {(False, False)}, 3: {(False, False)}, 5: {(False, False)}}
