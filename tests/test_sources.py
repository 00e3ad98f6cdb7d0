from __future__ import annotations

import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from proofledger import schemas
from proofledger.plans import jobs
from proofledger.sources import contract, manifest, publish, readers, sinks

VALID = "2017-01,TOWN,4 ROOM,1,ST,01 TO 03,90,Model,2000,80 years 01 months,500000"
FLOORS = contract.Floors(rows=1, first_month="2017-01", last_month="2017-01")


@pytest.fixture()
def write(tmp_path):
    def make(*lines, name="raw.csv", header=schemas.RAW_HEADER, end="\n"):
        folder = tmp_path / f"src{len(list(tmp_path.iterdir()))}"
        folder.mkdir()
        data = (end.join([header, *lines]) + end).encode() if header is not None else b""
        (folder / name).write_bytes(gzip.compress(data) if name.endswith(".gz") else data)
        return str(folder)

    return make


def violations(spark, path, floors=FLOORS):
    return {r.check_name: r.violations for r in contract.contract_checks(spark, path, floors).collect() if r.violations}


def test_valid_records(spark, write):
    quoted = VALID.replace(",ST,", ',"ST, ""ONE""",')
    years_only = VALID.replace(" 01 months", "")
    path = write(VALID, quoted, years_only)
    assert violations(spark, path) == {}
    rows = readers.typed_raw(readers.read_raw_text(spark, path))
    assert sorted(r.street_name for r in rows.collect()) == ["ST", "ST", 'ST, "ONE"']
    assert rows.first().resale_price == 500000.0


@pytest.mark.parametrize("line, rule", [
    ("2017-01,TOWN", "eleven fields"),
    (VALID + ",extra", "eleven fields"),
    (VALID.replace(",90,", ",NaN,"), "positive finite numbers"),
    (VALID.replace(",500000", ",inf"), "positive finite numbers"),
    (VALID.replace(",500000", ","), "positive finite numbers"),
    (VALID.replace("01 months", "99 months"), "lease text"),
    (VALID.replace("80 years 01 months", "long"), "lease text"),
    (VALID.replace("2017-01", "2017-13"), "month parses"),
    (VALID.replace(",ST,", ',"ST" x,'), "well-formed quoting"),
])
def test_each_broken_record(spark, write, line, rule):
    found = violations(spark, write(VALID, line))
    assert found == {rule: 1}


def test_file_rules(spark, write, tmp_path):
    assert violations(spark, write(VALID, header="month,town"))["header matches"] == 1
    assert violations(spark, write(VALID, header="﻿" + schemas.RAW_HEADER, end="\r\n")) == {}
    folder = tmp_path / "bytes"
    folder.mkdir()
    (folder / "a.csv").write_bytes((schemas.RAW_HEADER + "\n").encode() + VALID.replace("TOWN", "T\xff").encode("latin-1"))
    assert violations(spark, str(folder))["valid utf-8"] == 1
    (folder / "b.csv").write_bytes(b"")
    assert violations(spark, str(folder))["not empty"] == 1


def test_floors(spark, write):
    path = write(VALID, VALID.replace("2017-01", "2018-03"))
    assert violations(spark, path, contract.Floors(3, "2016-12", "2018-04")) == {
        "row floor": 1, "first month floor": 1, "last month floor": 1}
    summary = manifest.coverage(readers.read_raw_text(spark, path)).first()
    assert tuple(summary) == (2, "2017-01", "2018-03", 2)


def test_offenders_name_their_rules(spark, write):
    bad = VALID.replace(",90,", ",0,").replace("2017-01", "soon")
    rows = contract.offenders(readers.read_raw_text(spark, write(VALID, bad))).collect()
    assert [list(r.rules) for r in rows] == [["positive finite numbers", "month parses"]]


def test_gzip(spark, write):
    path = write(VALID, VALID, name="raw.csv.gz")
    assert readers.spread(readers.read_raw_text(spark, path)).count() == 2
    assert violations(spark, path) == {}


def test_build_publishes_only_clean_data(spark, write, tmp_path):
    root = str(tmp_path / "table")
    args = {"as_of": "2026-01-01", "published_at": "t", "floors": FLOORS}
    table = jobs.build_table(spark, write(VALID, VALID), root, **args)
    row = table.first()
    assert table.count() == 2 and len(table.columns) == 19
    assert (str(row.sale_date), row.storey_low, row.storey_high, row.storey_mid) == ("2017-01-01", 1, 3, 2.0)
    assert row.remaining_lease_years == 80 + 1 / 12.0 and row.price_per_sqm == 500000 / 90
    with pytest.raises(ValueError, match="positive finite numbers"):
        jobs.build_table(spark, write(VALID.replace(",500000", ",NaN")), root, **args)
    with pytest.raises(ValueError, match="storey band sane"):
        jobs.build_table(spark, write(VALID.replace("01 TO 03", "05 TO 03")), root, **args)
    assert publish.current_table(spark, root).count() == 2
    jobs.build_table(spark, write(VALID), root, **args)
    assert publish.current_table(spark, root).count() == 1


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_identity_is_the_hash_of_the_bytes(spark, tmp_path):
    (tmp_path / "src").mkdir()
    long = b"".join(b"%d;\xff\r\n" % (k * 7919 % 10_007) for k in range(12_000)) + b"last"
    packed = gzip.compress(long)
    contents = {"a.csv": long, "b.csv": long + b"\n", "empty.csv": b"", "one.csv": b"\n", "two.csv": b"x\n\n", "mark.csv": b"\xef\xbb\xbfx,y\n",
                "only_mark.csv": b"\xef\xbb\xbf", "bytes.bin": bytes(range(256)) * 300, "c.csv.gz": packed, "a name é.csv": b"a"}
    for name, data in contents.items():
        (tmp_path / "src" / name).write_bytes(data)
    for size in ("16k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        found = {r.file: (r.bytes, r.sha256) for r in manifest.file_manifest(spark, str(tmp_path / "src")).collect()}
        assert found == {name: (len(data), sha(data)) for name, data in contents.items()}
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    locked = spark.createDataFrame([(name, sha(data)) for name, data in contents.items()], "file STRING, sha256 STRING")
    found = manifest.file_manifest(spark, str(tmp_path / "src"))
    manifest.require_identity(locked, found, found)
    (tmp_path / "src" / "a.csv").write_bytes(b"")
    with pytest.raises(ValueError, match="source:a.csv"):
        manifest.require_identity(locked, manifest.file_manifest(spark, str(tmp_path / "src")), locked)


def test_a_long_file_is_hashed_in_parts(spark, tmp_path, monkeypatch):
    """No task reads a long file whole, and the hash is that of its bytes."""
    from proofledger.functions import resuming

    lines = b"".join(b"%d;\xff\r\n" % (k * 7919 % 10_007) for k in range(9_000))
    contents = {"a.csv": lines, "b é+.csv": lines + b"last", "mark.csv": b"\xef\xbb\xbf" + lines * 2, "one_line.bin": b"x" * 90_000, "small.csv": b"x\n",
                "gap.bin": b"a\n" + b"x" * 90_000 + b"\nq\n" + b"y" * 5000, "empty.csv": b"", "ends.bin": b"\n" * 70_000, "c.csv.gz": gzip.compress(lines * 9)}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    monkeypatch.setattr(resuming, "PART_BYTES", 30_000)
    read = []
    real = manifest._part
    monkeypatch.setattr(manifest, "_part", lambda states: (read.append(len(states)), real(states))[1])
    found = {r.file: (r.bytes, r.sha256) for r in manifest.file_manifest(spark, str(tmp_path)).collect()}
    assert found == {name: (len(data), sha(data)) for name, data in contents.items()}
    # As many steps as the longest file has parts, of all long files together.
    assert read[0] == 6 and len(read) == -(-len(contents["mark.csv"]) // 30_000)


def test_line_break_inside_quotes_is_published(spark, write, tmp_path):
    broken = VALID.replace(",ST,", ',"ST\nONE",')
    path = write(VALID, broken)
    assert violations(spark, path)["well-formed quoting"] > 0
    assert contract.contract_checks(spark, path, FLOORS, multi_line=True).where("violations > 0").isEmpty()
    table = jobs.build_table(spark, path, str(tmp_path / "table"), "2026-01-01", "t", FLOORS, multi_line=True)
    assert sorted(r.street_name for r in table.collect()) == ["ST", "ST\nONE"]


def test_records_are_parsed_once(spark, write, tmp_path, monkeypatch):
    reads = []
    real = readers.read_raw_text
    monkeypatch.setattr(readers, "read_raw_text", lambda *a, **k: (reads.append(a), real(*a, **k))[1])
    monkeypatch.setattr(contract, "read_raw_text", readers.read_raw_text)
    table = jobs.build_table(spark, write(VALID, VALID), str(tmp_path / "table"), "2026-01-01", "t", FLOORS)
    assert table.count() == 2 and len(reads) == 1


def test_a_manifest_counts_records_with_line_breaks(spark, write):
    path = write(VALID, VALID.replace(",ST,", ',"ST\nONE",'))
    row = jobs.manifest_row(spark, path, {}, "now", multi_line=True).first()
    assert (row.rows, row.months) == (2, 1)


def test_a_short_table_is_not_published(spark, write, tmp_path):
    """Rows that staging lost on the way show against the written files."""
    from proofledger.plans import staging

    typed = readers.typed_raw(readers.read_raw_text(spark, write(VALID, VALID, VALID)))
    receipt = spark.createDataFrame([("raw.csv", 1, "x")], "file STRING, bytes BIGINT, sha256 STRING")
    short = staging.stage(typed.limit(2), for_writing=True)
    clean, checks = publish.publish(spark, short, str(tmp_path / "t"), receipt, staging.accounting(typed), "2026-01-01", "2017-01-01", "t")
    assert not clean and checks.where("check_name = 'retained + excluded = raw' AND violations = 1").count() == 1


def test_manifest_and_receipt_time(spark, write):
    path = write(VALID, VALID.replace("2017-01", "2017-02"))
    data = open(f"{path}/raw.csv", "rb").read()
    labels = {"dataset_id": "d", "dataset_url": "u", "source": "s"}
    first = jobs.manifest_row(spark, path, labels, "2026-01-01T23:00:00+08:00")
    row = first.first()
    assert (row.bytes, row.sha256) == (len(data), sha(data))
    assert (row.rows, row.month_min, row.month_max, row.months) == (2, "2017-01", "2017-02", 2)
    again = jobs.manifest_row(spark, path, labels, "later", first).first()
    assert again.retrieved_at == "2026-01-01T23:00:00+08:00"
    changed = first.withColumn("sha256", F.lit("x"))
    assert jobs.manifest_row(spark, path, labels, "later", changed).first().retrieved_at == "later"
    day = first.select(manifest.receipt_day(F.col("retrieved_at"), "Asia/Singapore")).first()[0]
    assert str(day) == "2026-01-01"


def test_identity_gate(spark, write):
    locked = manifest.file_manifest(spark, write(VALID))
    manifest.require_identity(locked, locked, locked)
    grown = manifest.file_manifest(spark, write(VALID, VALID))
    with pytest.raises(ValueError, match="source:raw.csv"):
        manifest.require_identity(locked, grown, locked)
    with pytest.raises(ValueError, match="table:raw.csv"):
        manifest.require_identity(locked, locked, locked.where("false"))
    doubled = locked.unionByName(locked.withColumn("sha256", F.lit("other")))
    with pytest.raises(ValueError, match="table:raw.csv"):
        manifest.require_identity(locked, locked, doubled)


def test_log_meta_is_kept_apart(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    attempt = {"n": 1, "sql": "SELECT 1", "outcome": "ok", "note": "", "fingerprint": [1, "abc"]}
    path.write_text("\n".join(json.dumps(x) for x in [
        {"meta": {"model": "m", "run_date": "2026-01-02", "temperature": 0, "max_tokens": 5}},
        {"id": "Q1", "question": "?", "attempts": [attempt]}]) + "\n\n")
    log = readers.read_log(spark, str(path))
    assert [r.model for r in readers.log_meta(log).collect()] == ["m"]
    record = readers.log_records(log).collect()
    assert [r.question_id for r in record] == ["Q1"] and list(record[0].attempts[0].fingerprint) == ["1", "abc"]


def test_a_summary_leaves_the_scans_before_it_spread(spark, tmp_path):
    def task(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"value": [str(TaskContext.get().partitionId())] * batch.num_rows})

    sinks.write_summary(spark.range(0, 8, 1, 8).where("id = 7").mapInArrow(task, "value STRING"), str(tmp_path / "summary"))
    assert [r.value for r in spark.read.text(str(tmp_path / "summary")).collect()] == ["7"]


def test_a_recorded_run_is_not_overwritten(spark, tmp_path):
    df = spark.createDataFrame([("Q1",)], "question_id STRING")
    path = sinks.run_path(str(tmp_path), "2026-01-02", 2)
    sinks.write_json(df, path)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_json(df, path)


def test_wide_records_are_landed_without_a_shuffle_of_their_own(spark, sf_dir, monkeypatch):
    """Raw records and broken files are written by the tasks that make them."""
    from pyspark.sql import DataFrame

    from workloads import analogue as an
    from workloads import source_queries as sq

    asked = []
    hint = DataFrame.hint
    monkeypatch.setattr(type(spark.range(0)), "hint", lambda self, name, *args: asked.append(name) or hint(self, name, *args))
    monkeypatch.setattr(an, "_made", {})
    path = sq.broken_csv(spark, sf_dir)
    assert "rebalance" not in asked
    lines = spark.read.text(path)
    headers, files = lines.where(F.col("value") == schemas.RAW_HEADER).count(), len(lines.inputFiles())
    assert headers == files and lines.count() == files + an.raw_table(spark, sf_dir, dirty=True).count()
    assert not lines.where(F.col("value").contains("\x00")).count()


def test_rows_of_orders_are_stored_as_cells(spark, sf_dir):
    from workloads import analogue as an

    path = an.order_rows(spark, sf_dir, 1).inputFiles()[0].split("attempt_n=")[0]
    assert not {"line_v1", "line_v2", "key"} & set(spark.read.parquet(path).columns)
