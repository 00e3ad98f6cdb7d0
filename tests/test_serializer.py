from __future__ import annotations

import hashlib
import json
import random
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofledger.functions.cells import contract_defect, json_text, typed_pair
from proofledger.plans.fingerprints import fingerprint, fingerprints, result_rows

# ---- fixed values: known answers and the first digits of their version 1 hashes ----
KNOWN = [
    ([(1634,)], "125c1f49db57"),
    ([(125,)], "20fd6820930b"),
    ([(1545,)], "2d1a29d45dca"),
    ([(688,)], "eb3bb117fdb3"),
    ([(550000,)], "560a18993900"),
    ([(145.4,)], "dc29842ac3e7"),
    ([(44.10,)], "5adff50c522f"),
    ([("4 ROOM", 11357), ("3 ROOM", 6355), ("5 ROOM", 5842), ("EXECUTIVE", 1503), ("2 ROOM", 688), ("1 ROOM", 6),
      ("MULTI-GENERATION", 3)], "5ae67a844d17"),
    ([("BUKIT BATOK", "BT BATOK ST 21", "293D", 41)], "d69ee58c5191"),
    ([(295,)], "228e8d338727"),
    ([(196,)], "ea2a48354ec4"),
    ([(9,)], "4cc019de7a74"),
    ([("2020-12", 2486)], "ca3a359884c8"),
    ([(484502.70,)], "fe8afa8af1fe"),
    ([(77.9,)], "e6f50e48ee68"),
    ([(6,)], "017144e2271f"),
    ([("2023-06", 1500000)], "ff1269dd15f8"),
    ([(6665,)], "a74653f023c1"),
]


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


@pytest.mark.parametrize("rows, prefix", KNOWN)
def test_known_answers(spark, rows, prefix):
    columns = [f"c{i}" for i in range(len(rows[0]))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["place", *columns])
    ordered = result_rows(df, "Q", 1, ["place"]).count()
    assert ordered == len(rows)
    if len(rows) == 1:
        got = one(fingerprint(df.drop("place")))
    else:
        got = one(fingerprint(df.drop("place"), ["c1 desc", "c0"]))
    assert (got.rows, got.sha256[:12]) == (len(rows), prefix)


def print_of(spark, values, schema, version=2):
    return one(fingerprint(spark.createDataFrame(values, schema), version=version))


def test_typed_cells_match_plain_json(spark):
    schema = "t STRING, i BIGINT, d DOUBLE, x DECIMAL(20,5), b BOOLEAN, day DATE, at TIMESTAMP_NTZ, n STRING"
    values = [('q"\\/é\x01\n\x7f', 9007199254740993, -0.001, Decimal("12.34500"), True, date(2024, 2, 29),
               datetime(2024, 2, 29, 1, 2, 3, 450000), None)]
    got = print_of(spark, values, schema)
    expected = [[["text", values[0][0]], ["number", "9007199254740993.00"], ["number", "-0.00"],
                 ["number", "12.34"], ["bool", True], ["date", "2024-02-29"],
                 ["datetime", "2024-02-29T01:02:03.450000"], ["null"]]]
    text = json.dumps(expected, ensure_ascii=False, separators=(",", ":"))
    assert got.sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_json_text_of_every_ascii_character(spark):
    texts = [chr(i) for i in range(1, 128)] + ["", "a\\\"b ü😀"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    for row in df.select("t", json_text(F.col("t")).alias("j")).collect():
        assert row.j == json.dumps(row.t, ensure_ascii=False)


@pytest.mark.parametrize("a, b, schema", [
    ([("A\x1fB", None)], [("A", "B")], "a STRING, b STRING"),
    ([(None,)], [("null",)], "a STRING"),
    ([(datetime(2026, 1, 1, 1),)], [(datetime(2026, 1, 1, 2),)], "a TIMESTAMP_NTZ"),
    ([(9007199254740992,)], [(9007199254740993,)], "a BIGINT"),
])
def test_typed_prints_tell_apart(spark, a, b, schema):
    assert print_of(spark, a, schema).sha256 != print_of(spark, b, schema).sha256


def test_equal_numbers_of_different_types(spark):
    assert print_of(spark, [(42,)], "a INT").sha256 == print_of(spark, [(42.0,)], "a DOUBLE").sha256
    assert print_of(spark, [(0.0,)], "a DOUBLE").sha256 == print_of(spark, [(-0.0,)], "a DOUBLE").sha256


def test_plain_doubles_match_python(spark):
    values = [0.005, 0.015, 1.005, 2.675, -0.004, 1e9 + 0.125, 123456.785, 1 / 3, 99999999.995]
    rows = spark.createDataFrame([(v,) for v in values], "a DOUBLE")
    lines = {r.line_v1 for r in result_rows(rows, "Q", 1).select("line_v1").collect()}
    assert lines == {f"{v:.2f}" for v in values}


@pytest.mark.parametrize("value", [float("nan"), float("inf"), float("-inf")])
def test_non_finite_breaks_the_typed_contract(spark, value):
    got = print_of(spark, [(1, value)], "a INT, b DOUBLE")
    assert got.sha256 is None and "non-finite" in got.defect
    assert print_of(spark, [(1, value)], "a INT, b DOUBLE", version=1).sha256 is not None


def test_list_cell_breaks_the_typed_contract(spark):
    got = print_of(spark, [([1, 2],)], "a ARRAY<INT>")
    assert got.sha256 is None and "unsupported result type" in got.defect


@pytest.mark.parametrize("version, text", [(1, ""), (2, "[]")])
def test_empty_result(spark, version, text):
    got = print_of(spark, [], "a INT", version)
    assert (got.rows, got.sha256) == (0, hashlib.sha256(text.encode()).hexdigest())


def test_unknown_version_is_refused(spark):
    with pytest.raises(ValueError):
        print_of(spark, [(1,)], "a INT", version=4)


def test_order_and_cap(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "a INT")
    up, down = one(fingerprint(df, ["a"])), one(fingerprint(df, ["a desc"]))
    assert up.rows == down.rows == 10 and up.sha256 != down.sha256
    over = one(fingerprint(df, ["a"], cap=9))
    assert over.oversized and over.sha256 is None and over.rows == 10
    assert not one(fingerprint(df, ["a"], cap=10)).oversized


def test_numbers_of_any_size(spark):
    rng = random.Random(4)
    values = [rng.choice([1, -1]) * rng.uniform(1, 10) * 10.0 ** rng.randrange(36, 308) for _ in range(2_000)]
    values += [float(2 ** e) for e in range(50, 1024, 9)] + [1e36, 1.7976931348623157e308, 1e15 + 0.375, 9007199254740993.0, 1411969363236394.8, 2.604742617978011e17]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    got = df.select("v", typed_pair(F.col("v"), T.DoubleType()).alias("t"), contract_defect(F.col("v"), T.DoubleType()).alias("d")).collect()
    assert len(got) == len(values) and all(r.d is None and r.t == f'["number","{Decimal(str(r.v)):.2f}"]' for r in got)
    wide = spark.sql("SELECT CAST('-9999999999999999999999999999999999999.9' AS DECIMAL(38,1)) a, CAST('-0.001' AS DECIMAL(38,20)) b")
    pairs = wide.select(*[typed_pair(wide[c], wide.schema[c].dataType) for c in wide.columns]).first()
    assert tuple(pairs) == ('["number","-9999999999999999999999999999999999999.90"]', '["number","-0.00"]')


def test_large_numbers_are_read_as_few_times_as_needed(spark):
    cell = spark.range(1).select(typed_pair(F.col("id").cast("double") * 1e60, T.DoubleType()).alias("t"))
    plan = cell._jdf.queryExecution().analyzed().toString()
    assert plan.count("pmod") < 10 and plan.count("substring_index") < 10


def test_a_long_result_is_hashed_in_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    rows = [("long", 1, k, f"a{k}", f"[b{k}]", None, "k") for k in range(100)] + [("é", 0, k, None, f"c{k}", None, "k") for k in range(3)]
    df = spark.createDataFrame(rows[::-1], "question_id STRING, attempt_n INT, pos BIGINT, line_v1 STRING, line_v2 STRING, defect STRING, key STRING")
    got = {v: {r.question_id: r.sha256 for r in fingerprints(df, v).collect()} for v in (1, 2)}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    texts = {1: {"long": "\x1e".join(f"a{k}" for k in range(100)), "é": "\x1e\x1e"},
             2: {"long": "[" + ",".join(f"[b{k}]" for k in range(100)) + "]", "é": "[c0,c1,c2]"}}
    assert got == {v: {q: hashlib.sha256(t.encode()).hexdigest() for q, t in by.items()} for v, by in texts.items()}


def test_a_long_result_is_hashed_in_parts(spark, monkeypatch):
    """Results longer than a part take several tasks, and their hashes are those of the whole text."""
    from proofledger.functions import resuming
    from proofledger.plans import fingerprints as fp

    sizes = {"a": 900, "b": 3, "c": 1, "d": 2_000, "e": 0, None: 700}
    rows = [(q, 1, 3 * k, f"{q}é{k}", None if k % 50 == 7 else f'["{q}",{k}]', None, "") for q, n in sizes.items() for k in range(n)]
    df = spark.createDataFrame(rows[::-1], """question_id STRING, attempt_n INT, pos LONG, line_v1 STRING, line_v2 STRING, defect STRING,
        key STRING""").repartition(5)
    monkeypatch.setattr(resuming, "PART_BYTES", 4_000)
    parts = []
    real = fp._taken_up
    monkeypatch.setattr(fp, "_taken_up", lambda *a: (parts.append(a), real(*a))[1])
    whole = {}
    for q, _, _, one, two, *_ in rows:
        whole.setdefault(q, ([], []))
        whole[q][0].append(one)
        whole[q][1].append(two or "")
    for version in (1, 2):
        before, between, after = fp.FRAMES[version]
        want = {q: (len(t[0]), hashlib.sha256((before + between.join(t[version - 1]) + after).encode()).hexdigest() if q else None)
                for q, t in whole.items()}
        for chosen, what in ((df, want), (df.where("question_id = 'd'"), {"d": want["d"]}), (df.where("question_id = 'b'"), {"b": want["b"]})):
            got = {r.question_id: (r.rows, r.sha256) for r in fingerprints(chosen, version, long=True).collect()}
            assert got == what
    assert len(parts) > 20
