"""Every registered query against its SQL statement on the small tables, and the shape of a few plans."""

from __future__ import annotations

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

from proofledger.operators.medians import exact_median
from proofledger.plans.questions import BY_ID
from tests.oracle import compare, connect
from workloads import analogue as an
from workloads.registry import ENTRIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(ENTRIES))
def test_query_against_sql(spark, con, sf_dir, name):
    fn, statement = ENTRIES[name]
    if statement is None:
        assert fn(spark, sf_dir).columns
    else:
        assert compare(spark, con, fn, statement, sf_dir).startswith("ok")


def test_contract_functions(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 32


def plan(df) -> str:
    execution = df._jdf.queryExecution()
    return df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(execution, "formatted")


def test_month_filters_reach_the_files(spark, sf_dir):
    text = plan(BY_ID["Q01"].build(an.staged(spark, sf_dir), an.SUBJECT))
    assert "PartitionFilters: [isnotnull(sale_year" in text
    assert "EqualTo(town,NATION_3)" in text and "GreaterThanOrEqual(month,1998-01)" in text
    assert "resale_price" not in text  # only the columns in use are read


def test_questions_on_the_last_date_read_its_years_only(spark, sf_dir):
    from proofledger.plans.questions import q24_mean_by_last_date
    from workloads.table_queries import above_scalar

    for df in (q24_mean_by_last_date(an.staged(spark, sf_dir), an.SUBJECT), above_scalar(spark, sf_dir)):
        filters = [line for line in plan(df).splitlines() if "PartitionFilters" in line]
        assert filters and any("sale_year" in line and ">=" in line for line in filters)


def test_median_of_many_groups_reads_its_input_once(spark, sf_dir):
    df = exact_median(an.staged(spark, sf_dir), ["town"], F.col("price_per_sqm"), "m")
    df.collect()
    assert "ReusedExchange" in plan(df)


def test_median_of_few_groups_shuffles_counts_only(spark, sf_dir):
    df = exact_median(an.staged(spark, sf_dir), ["town"], F.col("price_per_sqm"), "m", 25)
    assert "BroadcastHashJoin Inner BuildRight" in plan(df)


def test_checks_take_one_scan(spark, sf_dir):
    from proofledger.plans.checks import table_checks

    text = plan(table_checks(an.staged(spark, sf_dir), an.FIRST_DAY, an.LAST_DAY))
    assert text.count("ReadSchema") == 1


def test_mistaken_spellings_fail_and_the_others_pass(spark, sf_dir):
    from workloads.question_queries import SPELLINGS, verdict_table

    wrong = {s.question_id for s in SPELLINGS if s.expected}
    got = {r.question_id: r for r in verdict_table(spark, sf_dir, 2).collect()}
    assert {q for q, r in got.items() if r.status == "fail"} == wrong
    assert {r.mismatch_type for q, r in got.items() if q in wrong} == {"value_mismatch"}
