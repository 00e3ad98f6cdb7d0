from __future__ import annotations

import math
import random
import statistics
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from proofledger.functions.numeric import is_finite_positive, round_places
from proofledger.operators.matching import differing_positions, require_none, without_match
from proofledger.operators import medians as median_module
from proofledger.operators.medians import exact_median, period_medians
from proofledger.operators.ordering import numbered, ordered, top_with_position
from proofledger.operators.windows import (
    change_from_previous,
    first_per_group,
    rolling_median_by_calendar,
    rolling_median_by_rows,
    running_sum,
    running_sum_peers,
)


def medians(spark, rows):
    """Both ways must agree."""
    df = spark.createDataFrame(rows, "k STRING, v DOUBLE")
    by_key, by_broadcast = [{r.k: r.m for r in exact_median(df, ["k"], F.col("v"), "m", bound).collect()} for bound in (None, 1_000)]
    assert by_key == by_broadcast
    return by_key


def test_median_against_brute_force_with_a_hot_group(spark):
    random.seed(3)
    rows = [("hot", random.gauss(0, 1000)) for _ in range(6000)]  # a third of all rows in one group
    rows += [("tied", random.choice([5.0, 5.0, 7.0])) for _ in range(4000)]
    rows += [(f"g{random.randrange(300)}", round(random.uniform(-50, 50), 2)) for _ in range(8000)]
    rows += [(None, float(i)) for i in range(7)] + [("nulls", None)] * 3 + [("mixed", None), ("mixed", 4.0)]
    want: dict = {}
    for k, v in rows:
        want.setdefault(k, []).append(v)
    got = medians(spark, rows)
    assert got.keys() == want.keys()
    for k, values in want.items():
        present = [v for v in values if v is not None]
        assert got[k] == (statistics.median(present) if present else None), k


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=32), min_size=1, max_size=40))
def test_median_of_any_doubles(spark, values):
    values = [float(v) + 0.0 for v in values]
    assert medians(spark, [("k", v) for v in values])["k"] == statistics.median(values)


def test_order_key_is_the_bits_of_the_double(spark):
    random.seed(5)
    values = [struct.unpack("<d", random.randbytes(8))[0] for _ in range(3000)]
    values += [s * x for s in (1, -1) for x in (0.0, 5e-324, 2.0 ** -1022, 2.0 ** -1022 * (1 - 2 ** -52), 1.0, 1.7976931348623157e308, math.inf)]
    values += [s * math.nextafter(2.0 ** e, to) for e in range(-1074, 1024, 7) for s in (1, -1) for to in (0.0, math.inf, 2.0 ** e)]
    values = [v for v in values if not math.isnan(v)]
    df = spark.createDataFrame([(1, v) for v in values], "g INT, v DOUBLE")
    got = spark.sql(median_module._KEYED.replace("{values}", "{df}"), df=df).collect()
    for r in got:
        bits = struct.unpack("<q", struct.pack("<d", abs(r.v)))[0]
        assert r.k == (bits if r.v >= 0 else -bits), r.v
    special = spark.createDataFrame([(1, None), (1, -math.inf), (1, math.inf), (1, math.nan)], "g INT, v DOUBLE")
    keys = [r.k for r in spark.sql(median_module._KEYED.replace("{values}", "{df}"), df=special).collect()]
    assert keys == sorted(set(keys))


def test_groups_beyond_the_bound_are_not_broadcast(spark):
    df = spark.range(100).select((F.col("id") % 10).alias("k"), F.col("id").cast("double").alias("v"))
    few = exact_median(df, ["k"], F.col("v"), "m", 10)
    many = exact_median(df, ["k"], F.col("v"), "m", median_module.BROADCAST_GROUPS + 1)
    assert sorted(many.collect()) == sorted(few.collect())
    assert "BROADCAST" in few._jdf.queryExecution().logical().toString()
    assert "BROADCAST" not in many._jdf.queryExecution().logical().toString()


def test_median_of_everything_and_of_nothing(spark):
    df = spark.createDataFrame([(1.0,), (9.0,), (2.0,), (float("inf"),)], "v DOUBLE")
    assert exact_median(df, [], F.col("v"), "m").collect()[0].m == 5.5
    empty = exact_median(df.where("v < 0"), [], F.col("v"), "m").collect()
    assert len(empty) == 1 and empty[0].m is None
    assert exact_median(df.withColumn("k", F.lit(1)).where("v < 0"), ["k"], F.col("v"), "m").count() == 0


def test_period_medians(spark):
    df = spark.createDataFrame([(1, 10.0), (1, 20.0), (2, 5.0), (3, 99.0)], "y INT, v DOUBLE")
    got = period_medians(df, {"a": F.col("y") == 1, "b": F.col("y") == 2}, F.col("v")).collect()
    assert [tuple(r) for r in got] == [(15.0, 5.0)]


def test_rounding_scales_first(spark):
    df = spark.createDataFrame([(1.005,), (2.5,), (-2.5,), (0.125,)], "x DOUBLE")
    got = [tuple(r) for r in df.select(round_places(F.col("x"), 2), round_places(F.col("x"), 0)).collect()]
    assert got == [(1.0, 1.0), (2.5, 3.0), (-2.5, -3.0), (0.13, 0.0)]


def test_finite_positive(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (0.0,), (None,), (1.0,)], "x DOUBLE")
    assert [r[0] for r in df.select(is_finite_positive(F.col("x"))).collect()] == [False, False, False, False, True]


SERIES = [("2023-01", "2023-01-01", 10.0), ("2023-02", "2023-02-01", 30.0), ("2023-05", "2023-05-01", 20.0),
          ("2023-06", "2023-06-01", 80.0)]


@pytest.fixture()
def series(spark):
    return spark.createDataFrame(SERIES, "month STRING, d STRING, v DOUBLE").withColumn("day", F.to_date("d"))


def column(df, name):
    return [r[name] for r in df.orderBy("month").collect()]


def test_windows_with_gaps(series):
    assert column(change_from_previous(series, "v", "month", "c"), "c") == [None, 20.0, -10.0, 60.0]
    assert column(rolling_median_by_calendar(series, "v", "day", 3, "r"), "r") == [10.0, 20.0, 20.0, 50.0]
    assert column(rolling_median_by_rows(series, "v", "month", 3, "r"), "r") == [10.0, 20.0, 20.0, 30.0]
    assert column(running_sum(series, "v", "month", "s"), "s") == [10.0, 40.0, 60.0, 140.0]
    assert column(running_sum_peers(series, "v", "month", "s"), "s") == [10.0, 40.0, 60.0, 140.0]


def test_windows_per_key(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 5), ("b", 1, 7)], "k STRING, month INT, v INT")
    got = change_from_previous(df, "v", "month", "c", ["k"]).orderBy("k", "month")
    assert [r.c for r in got.collect()] == [None, 4, None]


def test_first_per_group_cuts_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id").repartition(4)
    first = first_per_group(df, ["k"], [F.col("id").desc()], "n", 2)
    assert sorted((r.k, r.id, r.n) for r in first.collect()) == [
        (0, 996, 2), (0, 999, 1), (1, 994, 2), (1, 997, 1), (2, 995, 2), (2, 998, 1)]
    assert "WindowGroupLimit" in first._jdf.queryExecution().executedPlan().toString()


def test_order_puts_nulls_last_and_is_total(spark, tmp_path):
    df = spark.createDataFrame([("b", 1), (None, 1), ("a", 2), ("a", 1)], "k STRING, n INT")
    assert [tuple(r) for r in ordered(df).collect()] == [("a", 1), ("a", 2), ("b", 1), (None, 1)]
    placed = numbered(df, ["n desc"], str(tmp_path / "n")).orderBy("pos").collect()
    assert [(r.k, r.n, r.pos) for r in placed] == [("a", 2, 0), ("a", 1, 1), ("b", 1, 2), (None, 1, 3)]
    assert sorted((r.pos, r.k) for r in top_with_position(df, ["n desc"], 2).collect()) == [(0, "a"), (1, "a")]


def test_places_of_a_long_result_in_many_partitions(spark, tmp_path):
    df = spark.range(50_000, numPartitions=7).select((F.col("id") * 7919 % 50_021).alias("v"))
    placed = numbered(df, ["v"], str(tmp_path / "long"))
    assert placed.count() == 50_000
    before = placed.alias("a").join(placed.alias("b"), F.col("a.pos") + 1 == F.col("b.pos"))
    assert before.where("a.v < b.v").count() == 49_999


def test_matching(spark):
    a = spark.createDataFrame([("q", 0, "x"), ("q", 1, "y"), ("q", 2, "z")], "question_id STRING, pos INT, line STRING")
    b = spark.createDataFrame([("q", 0, "x"), ("q", 1, "Y")], "question_id STRING, pos INT, line STRING")
    assert [r.pos for r in differing_positions(a, b, ["question_id"], "line").collect()] == [1]
    both = differing_positions(a, b, ["question_id"], "line", extra_rows=True)
    assert sorted(r.pos for r in both.collect()) == [1, 2]
    assert [r.pos for r in without_match(a, b, ["pos"]).collect()] == [2]
    with pytest.raises(ValueError, match="gone: \\['2'\\]"):
        require_none(without_match(a, b, ["pos"]), "gone", "pos")
