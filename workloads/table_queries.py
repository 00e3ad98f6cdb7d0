"""Staging, accounting, table checks, profiles, and operators of their own over the staged table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofledger.functions.numeric import mean, round_places, safe_ratio, share_pct
from proofledger.functions.parse import STOREY_HIGH, STOREY_LOW, lease_years, matched_int, month_date
from proofledger.operators import windows as wn
from proofledger.operators.medians import exact_median, period_medians
from proofledger.operators.ordering import numbered, top_with_position
from proofledger.plans import checks, profiles, staging
from proofledger.plans.questions import sparse_rows, years
from workloads import analogue as an
from workloads import sql

S = an.SUBJECT


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.raw_table(spark, sf_dir, dirty=True)


# ---- staging ----


def staged_rows(spark, sf_dir):
    return staging.stage(dirty(spark, sf_dir))


def parsed_text(spark, sf_dir):
    """Month, storey band and lease text of every raw record, parsable or not."""
    raw = dirty(spark, sf_dir)
    low, high = (matched_int(F.col("storey_range"), p) for p in (STOREY_LOW, STOREY_HIGH))
    return raw.select(
        "month", "storey_range", "remaining_lease",
        month_date(F.col("month")).alias("sale_date"),
        F.trunc(month_date(F.col("month")), "MM").alias("sale_month"),
        low.alias("storey_low"), high.alias("storey_high"), ((low + high) / F.lit(2.0)).alias("storey_mid"),
        lease_years(F.col("remaining_lease")).alias("lease_years"),
        safe_ratio(F.col("resale_price"), F.col("floor_area_sqm")).alias("price_per_sqm"),
    ).distinct()


def exclusions(spark, sf_dir):
    return staging.exclusion_counts(dirty(spark, sf_dir))


def reconciliation(spark, sf_dir):
    raw = dirty(spark, sf_dir)
    return staging.accounting(raw, staging.stage(raw))


# ---- table checks ----


def clean_checks(spark, sf_dir):
    return checks.table_checks(an.staged(spark, sf_dir), an.FIRST_DAY, an.LAST_DAY)


def spoiled(t: DataFrame) -> DataFrame:
    """The staged table with defects of every kind a check looks for."""
    n = F.col("lease_commence_date") + F.col("storey_low")
    return t.withColumns({
        "resale_price": F.when(n % 97 == 0, -F.col("resale_price")).otherwise(F.col("resale_price")),
        "floor_area_sqm": F.when(n % 89 == 0, F.lit(0.0)).otherwise(F.col("floor_area_sqm")),
        "sale_month": F.when(n % 83 == 0, F.add_months("sale_month", 120))
        .when(n % 79 == 0, F.add_months("sale_month", -120)).otherwise(F.col("sale_month")),
        "town": F.when(n % 73 == 0, F.lit("")).when(n % 71 == 0, F.lit(None)).otherwise(F.col("town")),
        "flat_type": F.when(n % 67 == 0, F.lit(None)).otherwise(F.col("flat_type")),
        "price_per_sqm": F.when(n % 61 == 0, F.lit(None)).otherwise(F.col("price_per_sqm")),
        "storey_high": F.when(n % 59 == 0, F.lit(0)).otherwise(F.col("storey_high")),
        "remaining_lease_years": F.when(n % 53 == 0, F.lit(120.0)).otherwise(F.col("remaining_lease_years")),
    })


_N = "(lease_commence_date + storey_low)"
SPOILED = f"""spoiled AS (SELECT * REPLACE (
    CASE WHEN {_N} % 97 = 0 THEN -resale_price ELSE resale_price END AS resale_price,
    CASE WHEN {_N} % 89 = 0 THEN 0.0::DOUBLE ELSE floor_area_sqm END AS floor_area_sqm,
    CAST(CASE WHEN {_N} % 83 = 0 THEN sale_month + INTERVAL 120 MONTH
      WHEN {_N} % 79 = 0 THEN sale_month - INTERVAL 120 MONTH ELSE sale_month END AS DATE) AS sale_month,
    CASE WHEN {_N} % 73 = 0 THEN '' WHEN {_N} % 71 = 0 THEN NULL ELSE town END AS town,
    CASE WHEN {_N} % 67 = 0 THEN NULL ELSE flat_type END AS flat_type,
    CASE WHEN {_N} % 61 = 0 THEN NULL ELSE price_per_sqm END AS price_per_sqm,
    CASE WHEN {_N} % 59 = 0 THEN 0 ELSE storey_high END AS storey_high,
    CASE WHEN {_N} % 53 = 0 THEN 120.0::DOUBLE ELSE remaining_lease_years END AS remaining_lease_years)
  FROM resale)"""


def _checks_sql(table: str) -> str:
    rules = [
        ("price > 0", "resale_price <= 0"),
        ("area > 0", "floor_area_sqm <= 0"),
        ("sale_month in range", f"sale_month < DATE '{an.FIRST_DAY}' OR sale_month > DATE '{an.LAST_DAY}'"),
        ("month text matches date", "month <> strftime(sale_month, '%Y-%m')"),
        ("town not null", "coalesce(town, '') = ''"),
        ("flat_type not null", "coalesce(flat_type, '') = ''"),
        ("price/m2 sane", "coalesce(price_per_sqm, 0) <= 0"),
        ("storey band sane", "coalesce(storey_low, 0) < 1 OR storey_high IS NULL OR storey_high < storey_low"),
        ("lease years sane", "coalesce(remaining_lease_years, -1) NOT BETWEEN 0 AND 99"),
    ]
    return " UNION ALL ".join(
        f"SELECT '{name}' AS check_name, count(*) AS violations FROM {table} WHERE {rule}" for name, rule in rules)


def spoiled_checks(spark, sf_dir):
    return checks.table_checks(spoiled(an.staged(spark, sf_dir)), an.FIRST_DAY, an.LAST_DAY)


# ---- profiles ----

KEY_COLUMNS = ["town", "flat_type", "resale_price", "remaining_lease_years"]


def overview(spark, sf_dir):
    return profiles.overview(an.staged(spark, sf_dir))


def type_counts(spark, sf_dir):
    return profiles.counts_by(an.staged(spark, sf_dir), "flat_type")


def ranges(spark, sf_dir):
    return profiles.ranges(an.staged(spark, sf_dir))


def nulls(spark, sf_dir):
    return profiles.null_counts(spoiled(an.staged(spark, sf_dir)), [*KEY_COLUMNS, "price_per_sqm"])


def duplicate_rows(spark, sf_dir):
    return profiles.duplicate_rows(an.staged(spark, sf_dir), ["month", "town", "flat_type", "block", "street_name"])


def duplicate_raw_rows(spark, sf_dir):
    return profiles.duplicate_raw_rows(an.staged(spark, sf_dir))


def duplicate_documents(spark, sf_dir):
    return profiles.duplicate_texts(an.table(spark, sf_dir, "documents"), "text")


def last_month(spark, sf_dir):
    return profiles.last_month(an.staged(spark, sf_dir))


def key_uniqueness(spark, sf_dir):
    return profiles.key_uniqueness(an.staged(spark, sf_dir))


def block_spread(spark, sf_dir):
    return profiles.block_spread(an.staged(spark, sf_dir))


def near_miss(spark, sf_dir):
    return profiles.near_miss(an.staged(spark, sf_dir))


def near_miss_pivot(spark, sf_dir):
    return profiles.near_miss_pivot(an.staged(spark, sf_dir), ["SMALL", "PROMO"])


def _sparse(spark, sf_dir):
    return sparse_rows(an.staged(spark, sf_dir), S)


def calendar_coverage(spark, sf_dir):
    return profiles.calendar_coverage(_sparse(spark, sf_dir).where(years(*S.sparse_years)))


def missing_months(spark, sf_dir):
    return profiles.missing_months(_sparse(spark, sf_dir).where(years(*S.sparse_years)))


def frame_contrast(spark, sf_dir):
    first, last = S.sparse_years
    return profiles.frame_contrast(_sparse(spark, sf_dir), F.lit(True),
                                   F.col("month").between(f"{first}-01", f"{last}-12"))


def lease_component(spark, sf_dir):
    return profiles.lease_component(an.staged(spark, sf_dir).where(years(S.lease_year)))


def top_block(spark, sf_dir):
    return profiles.top_block(an.staged(spark, sf_dir).where(years(S.year)))


# ---- predicates, joins, aggregates, windows and ordering on the whole table ----


def date_range(spark, sf_dir):
    t = an.staged(spark, sf_dir)
    first, last = S.sparse_years
    half_open = (F.col("sale_date") >= f"{first}-01-01") & (F.col("sale_date") < f"{last + 1}-01-01")
    rows = t.where(F.col("sale_year").between(first, last) & half_open)
    return rows.groupBy("sale_year").agg(F.count(F.lit(1)).alias("n"), F.min("sale_date").alias("first_day"),
                                         F.max("sale_date").alias("last_day"))


def in_list(spark, sf_dir):
    t = an.staged(spark, sf_dir).where(F.col("sale_year").isin(1996, 1998) & F.col("town").isin("NATION_1", "NATION_2"))
    return t.groupBy("town", "sale_year").agg(F.count(F.lit(1)).alias("n"))


def null_tests(spark, sf_dir):
    t = spoiled(an.staged(spark, sf_dir))
    return t.groupBy("flat_type").agg(F.count_if(F.col("town").isNull()).alias("town_null"),
                                      F.count_if(F.col("town") == "").alias("town_empty"),
                                      F.count_if(F.col("price_per_sqm").isNotNull()).alias("ppsm_present"))


def above_scalar(spark, sf_dir):
    """Rows of the last 12 months of the table, by a scalar subquery on the latest date, in SQL."""
    return spark.sql(
        """WITH newest AS (SELECT max(sale_year) AS sale_year FROM {resale}),
             latest AS (SELECT max(sale_date) - INTERVAL 12 MONTH AS day FROM {resale}
                        WHERE sale_year = (SELECT sale_year FROM newest))
           SELECT town, count(*) AS n FROM {resale}
           WHERE sale_year >= (SELECT sale_year - 1 FROM newest) AND sale_date > (SELECT day FROM latest) GROUP BY 1""",
        resale=an.staged(spark, sf_dir))


def as_of_clock(spark, sf_dir):
    """The run date is a bound parameter, so the same text gives the same answer on any day."""
    return spark.sql(
        """SELECT extract(YEAR FROM sale_date) AS yr, count(*) AS n, max(sale_date) AS last_day FROM {resale}
           WHERE sale_year BETWEEN year(CAST(:as_of AS DATE)) - 2 AND year(CAST(:as_of AS DATE))
             AND sale_date >= date_trunc('YEAR', CAST(:as_of AS DATE)) - INTERVAL 2 YEAR
             AND sale_date <= CAST(:as_of AS DATE) GROUP BY yr""",
        args={"as_of": an.AS_OF}, resale=an.staged(spark, sf_dir))


def having_alias(spark, sf_dir):
    return spark.sql(
        """SELECT town, street_name, count(*) AS n FROM {resale} GROUP BY town, street_name HAVING n > 100""",
        resale=an.staged(spark, sf_dir))


def grouped_medians(spark, sf_dir):
    med = exact_median(an.staged(spark, sf_dir), ["town", "flat_type"], F.col("price_per_sqm"), "med")
    return med.select("town", "flat_type", round_places(F.col("med"), 2).alias("med"))


def sql_percentile(spark, sf_dir):
    """The ordered-set form in SQL, on monthly counts: one value per month, so its buffer is bounded."""
    return spark.sql(
        """SELECT town, percentile_cont(0.5) WITHIN GROUP (ORDER BY n) AS median_monthly_sales
           FROM (SELECT town, month, count(*) AS n FROM {resale} GROUP BY town, month) GROUP BY town""",
        resale=an.staged(spark, sf_dir))


def means_and_sums(spark, sf_dir):
    t = an.staged(spark, sf_dir)
    return t.groupBy("flat_type").agg(
        round_places(mean(F.col("resale_price"), 4), 2).alias("mean_price"),
        F.sum("storey_low").alias("sum_storey"),
        F.min("resale_price").alias("min_price"),
        F.max("resale_price").alias("max_price"))


def composite_distinct(spark, sf_dir):
    """Two distinct counts per town from one pass: the pairs are made distinct first."""
    physical = an.staged(spark, sf_dir).select("town", "street_name", "block").distinct()
    return physical.groupBy("town").agg(F.count_distinct("block").alias("blocks"),
                                        F.count(F.lit(1)).alias("physical_blocks"))


def months_above_mean(spark, sf_dir):
    by_month = an.staged(spark, sf_dir).groupBy("town", "month").agg(F.count(F.lit(1)).alias("n"))
    average = by_month.groupBy("town").agg(F.avg("n").alias("mean_n"))
    return by_month.join(average, "town").where("n > mean_n").groupBy("town").agg(F.count(F.lit(1)).alias("months"))


def max_pivot(spark, sf_dir):
    t = an.staged(spark, sf_dir).where(F.col("sale_year").isin(1997, 1998))
    per = t.groupBy("town", "sale_year").agg(F.max("resale_price").alias("p"))
    return per.groupBy("town").agg(F.max(F.when(F.col("sale_year") == 1997, F.col("p"))).alias("max_1997"),
                                   F.max(F.when(F.col("sale_year") == 1998, F.col("p"))).alias("max_1998"))


def type_shares(spark, sf_dir):
    t = an.staged(spark, sf_dir)
    return t.groupBy("town").agg(share_pct(F.count_if(F.col("flat_type") == "SMALL"), F.count(F.lit(1))).alias("pct"))


def two_periods(spark, sf_dir):
    t = an.staged(spark, sf_dir)
    meds = period_medians(t, {"late": years(1999, 2000), "early": years(1995, 1996)}, F.col("resale_price"))
    return meds.select(round_places(F.col("late"), 2).alias("late"), round_places(F.col("early"), 2).alias("early"))


def _town_months(spark, sf_dir):
    med = exact_median(an.staged(spark, sf_dir), ["town", "month", "sale_month"], F.col("price_per_sqm"), "med")
    return med.withColumn("med", round_places(F.col("med"), 2))


def town_month_windows(spark, sf_dir):
    """Change, calendar and row rolling medians per town over its monthly medians."""
    t = wn.change_from_previous(_town_months(spark, sf_dir), "med", "month", "change", ["town"])
    t = wn.rolling_median_by_calendar(t, "med", "sale_month", 3, "by_calendar", ["town"])
    t = wn.rolling_median_by_rows(t, "med", "month", 3, "by_rows", ["town"])
    return t.select("town", "month", "med", *[round_places(F.col(c), 2).alias(c)
                                              for c in ["change", "by_calendar", "by_rows"]])


def town_running_counts(spark, sf_dir):
    counts = an.staged(spark, sf_dir).groupBy("town", "month").agg(F.count(F.lit(1)).alias("n"))
    t = wn.running_sum(counts, "n", "month", "upto", ["town"])
    return wn.running_sum_peers(t, "n", "month", "upto_peers", ["town"])


def interval_frame(spark, sf_dir):
    """The calendar frame written as an interval in SQL."""
    return spark.sql(
        """SELECT town, month, percentile(n, 0.5) OVER (PARTITION BY town ORDER BY sale_month
             RANGE BETWEEN INTERVAL 2 MONTH PRECEDING AND CURRENT ROW) AS rolling
           FROM (SELECT town, month, sale_month, count(*) AS n FROM {resale} GROUP BY town, month, sale_month)""",
        resale=an.staged(spark, sf_dir))


def dearest_per_town(spark, sf_dir):
    """Three dearest sales per town with their rank; cut to three per task before the shuffle."""
    t = an.staged(spark, sf_dir).select("town", "resale_price", "month", "street_name", "block", "flat_type")
    order = [F.col("resale_price").desc(), F.col("month"), F.col("street_name"), F.col("block"), F.col("flat_type")]
    return wn.first_per_group(t, ["town"], order, "rk", 3)


def arg_max_struct(spark, sf_dir):
    """The other form of arg-max per group: an aggregate, no window."""
    counts = an.staged(spark, sf_dir).groupBy("town", "month").agg(F.count(F.lit(1)).alias("n"))
    # Month text is turned around with a negative month index, so that the earlier month is larger.
    key = F.struct("n", (-(F.substring("month", 1, 4).cast("int") * 12 + F.substring("month", 6, 2).cast("int")))
                   .alias("earlier"))
    return counts.groupBy("town").agg(F.max_by("month", key).alias("month"), F.max("n").alias("n"))


def top_positions(spark, sf_dir):
    """Top twenty (town, street, block) with the place of each in the order."""
    counts = an.staged(spark, sf_dir).groupBy("town", "street_name", "block").agg(F.count(F.lit(1)).alias("n"))
    return top_with_position(counts, ["n desc", "town", "street_name", "block"], 20)


def default_order(spark, sf_dir):
    """No order given: every column ascending, NULLs last; positions show the order."""
    counts = spoiled(an.staged(spark, sf_dir)).groupBy("town", "flat_type").agg(F.count(F.lit(1)).alias("n"))
    return numbered(counts, None, an.fresh_path(spark, "numbered"))


def check_union(spark, sf_dir):
    """Check rows of two tables side by side."""
    return (clean_checks(spark, sf_dir).withColumn("version", F.lit("clean"))
            .unionByName(spoiled_checks(spark, sf_dir).withColumn("version", F.lit("spoiled"))))


_SPARSE = sql.SPARSE
_SPAN = sql.year(*S.sparse_years)
_STAGED = ", ".join(sql.STAGED_COLUMNS)
_SPOILED_PREFIX = sql.resale("").rstrip() + ", " + SPOILED


def _spoiled_sql(body: str) -> str:
    return f"{_SPOILED_PREFIX}\n{body}"


ENTRIES: dict[str, tuple] = {
    "stage_rows": (staged_rows, sql.resale(f"SELECT {_STAGED} FROM resale", dirty=True)),
    "stage_parsed_text": (parsed_text, sql.raw("""
        SELECT DISTINCT month, storey_range, remaining_lease,
          CAST(try_strptime(month, '%Y-%m') AS DATE) AS sale_date,
          CAST(date_trunc('month', try_strptime(month, '%Y-%m')) AS DATE) AS sale_month,
          TRY_CAST(split_part(storey_range, ' TO ', 1) AS INTEGER) AS storey_low,
          TRY_CAST(split_part(storey_range, ' TO ', 2) AS INTEGER) AS storey_high,
          (TRY_CAST(split_part(storey_range, ' TO ', 1) AS INTEGER)
            + TRY_CAST(split_part(storey_range, ' TO ', 2) AS INTEGER)) / 2.0::DOUBLE AS storey_mid,
          TRY_CAST(split_part(remaining_lease, ' ', 1) AS INTEGER)
            + coalesce(TRY_CAST(nullif(split_part(remaining_lease, ' ', 3), '') AS INTEGER), 0) / 12.0::DOUBLE
            AS lease_years,
          resale_price / nullif(floor_area_sqm, 0) AS price_per_sqm FROM raw""", dirty=True)),
    "stage_exclusion_counts": (exclusions, sql.raw("""
        SELECT 'price null or <= 0' AS rule, count(*) AS n FROM raw WHERE coalesce(resale_price, 0) <= 0
        UNION ALL SELECT 'area null or <= 0', count(*) FROM raw WHERE coalesce(floor_area_sqm, 0) <= 0
        UNION ALL SELECT 'bad month', count(*) FROM raw WHERE try_strptime(month, '%Y-%m') IS NULL
        UNION ALL SELECT 'no lease text', count(*) FROM raw WHERE remaining_lease IS NULL""", dirty=True)),
    "stage_accounting": (reconciliation, sql.resale("""
        SELECT raw, retained, raw - retained AS excluded, true AS reconciled,
          round(100.0::DOUBLE * (raw - retained) / raw, 3) AS excluded_pct
        FROM (SELECT (SELECT count(*) FROM raw) AS raw, (SELECT count(*) FROM resale) AS retained)""", dirty=True)),
    "check_staged_table": (clean_checks, sql.resale(_checks_sql("resale"))),
    "check_spoiled_table": (spoiled_checks, _spoiled_sql(_checks_sql("spoiled"))),
    "check_union": (check_union, _spoiled_sql(f"""
        SELECT *, 'clean' AS version FROM ({_checks_sql('resale')})
        UNION ALL SELECT *, 'spoiled' FROM ({_checks_sql('spoiled')})""")),
    "profile_overview": (overview, sql.resale("""
        SELECT count(*) AS n_rows, count(DISTINCT month) AS n_months, count(DISTINCT town) AS n_towns,
          count(DISTINCT flat_type) AS n_types FROM resale""")),
    "profile_type_counts": (type_counts, sql.resale("SELECT flat_type, count(*) AS n FROM resale GROUP BY 1")),
    "profile_ranges": (ranges, sql.resale("""
        SELECT min(resale_price) AS min_resale_price, max(resale_price) AS max_resale_price,
          min(floor_area_sqm) AS min_floor_area_sqm, max(floor_area_sqm) AS max_floor_area_sqm,
          min(remaining_lease_years) AS min_remaining_lease_years,
          max(remaining_lease_years) AS max_remaining_lease_years,
          median(resale_price) AS median_resale_price FROM resale""")),
    "profile_null_counts": (nulls, _spoiled_sql(" UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls FROM spoiled"
        for c in [*KEY_COLUMNS, "price_per_sqm"]))),
    "profile_duplicate_keys": (duplicate_rows, sql.resale("""
        SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows, count(*) FILTER (WHERE n > 1)
          AS repeated_groups
        FROM (SELECT count(*) AS n FROM resale GROUP BY month, town, flat_type, block, street_name)""")),
    "profile_duplicate_raw_rows": (duplicate_raw_rows, sql.raw("""
        SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows, count(*) FILTER (WHERE n > 1)
          AS repeated_groups
        FROM (SELECT count(*) AS n FROM raw GROUP BY month, town, flat_type, block, street_name, storey_range,
              floor_area_sqm, flat_model, lease_commence_date, remaining_lease, resale_price)""")),
    "profile_duplicate_documents": (duplicate_documents, """
        SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows, count(*) FILTER (WHERE n > 1)
          AS repeated_groups
        FROM (SELECT count(*) AS n FROM documents GROUP BY text)"""),
    "profile_last_month": (last_month, sql.resale("""
        SELECT month, count(*) AS n FROM resale WHERE month = (SELECT max(month) FROM resale) GROUP BY 1""")),
    "profile_key_uniqueness": (key_uniqueness, sql.resale("""
        SELECT count(DISTINCT block) AS block_strings,
          count(DISTINCT town || '|' || street_name || '|' || block) AS physical_blocks FROM resale""")),
    "profile_block_spread": (block_spread, sql.resale("""
        SELECT block, count(DISTINCT town) AS towns, count(DISTINCT town || '|' || street_name) AS streets,
          count(*) AS n FROM resale GROUP BY block""")),
    "profile_near_miss": (near_miss, sql.resale("""
        SELECT flat_type, flat_model, count(*) AS n FROM resale GROUP BY 1, 2""")),
    "profile_near_miss_pivot": (near_miss_pivot, sql.resale("""
        SELECT flat_model, count(*) FILTER (WHERE flat_type = 'SMALL') AS "SMALL",
          count(*) FILTER (WHERE flat_type = 'PROMO') AS "PROMO" FROM resale GROUP BY 1""")),
    "profile_calendar_coverage": (calendar_coverage, sql.resale(f"""
        SELECT count(DISTINCT sale_month) AS present,
          date_diff('month', min(sale_month), max(sale_month)) + 1 AS in_span
        FROM resale WHERE {_SPARSE} AND {_SPAN}""")),
    "profile_missing_months": (missing_months, sql.resale(f"""
        , present AS (SELECT DISTINCT sale_month FROM resale WHERE {_SPARSE} AND {_SPAN})
        SELECT strftime(m, '%Y-%m') AS month
        FROM (SELECT unnest(generate_series(min(sale_month), max(sale_month), INTERVAL 1 MONTH)) AS m FROM present)
        WHERE CAST(m AS DATE) NOT IN (SELECT sale_month FROM present)""")),
    "profile_frame_contrast": (frame_contrast, sql.resale(f"""
        , series AS (SELECT month, sale_month, median(price_per_sqm) AS med FROM resale WHERE {_SPARSE} GROUP BY ALL),
        inside AS (SELECT month,
            round(median(med) OVER (ORDER BY sale_month {sql.THREE_MONTHS}), 2) AS by_calendar,
            round(median(med) OVER (ORDER BY month ROWS 2 PRECEDING), 2) AS by_rows
          FROM series WHERE {_SPAN}),
        history AS (SELECT month, round(median(med) OVER (ORDER BY month ROWS 2 PRECEDING), 2) AS by_rows_history
          FROM series)
        SELECT *, by_calendar IS DISTINCT FROM by_rows AS frame_differs,
          by_calendar IS DISTINCT FROM by_rows_history AS population_differs
        FROM inside JOIN history USING (month)""")),
    "profile_lease_component": (lease_component, sql.resale(f"""
        SELECT count(*) FILTER (WHERE remaining_lease LIKE '%month%') AS with_months,
          round({sql.mean('remaining_lease_years')}, 1) AS mean_years,
          round({sql.mean('floor(remaining_lease_years)', 0)}, 1) AS mean_years_only
        FROM resale WHERE {sql.year(S.lease_year)}""")),
    "profile_top_block": (top_block, sql.resale(f"""
        SELECT * FROM (SELECT 'block string' AS grain, NULL::VARCHAR AS town, NULL::VARCHAR AS street_name, block,
            count(*) AS n FROM resale WHERE {sql.year(S.year)} GROUP BY block ORDER BY n DESC, block LIMIT 1)
        UNION ALL SELECT * FROM (SELECT 'physical block', town, street_name, block, count(*) AS n FROM resale
          WHERE {sql.year(S.year)} GROUP BY town, street_name, block
          ORDER BY n DESC, town, street_name, block LIMIT 1)""")),
    "filter_date_range": (date_range, sql.resale(f"""
        SELECT sale_year, count(*) AS n, min(sale_date) AS first_day, max(sale_date) AS last_day FROM resale
        WHERE sale_date >= DATE '{S.sparse_years[0]}-01-01' AND sale_date < DATE '{S.sparse_years[1] + 1}-01-01'
        GROUP BY 1""")),
    "filter_in_list": (in_list, sql.resale("""
        SELECT town, sale_year, count(*) AS n FROM resale
        WHERE sale_year IN (1996, 1998) AND town IN ('NATION_1', 'NATION_2') GROUP BY 1, 2""")),
    "filter_null_and_empty": (null_tests, _spoiled_sql("""
        SELECT flat_type, count(*) FILTER (WHERE town IS NULL) AS town_null,
          count(*) FILTER (WHERE town = '') AS town_empty, count(price_per_sqm) AS ppsm_present
        FROM spoiled GROUP BY flat_type""")),
    "filter_scalar_subquery": (above_scalar, sql.resale("""
        SELECT town, count(*) AS n FROM resale
        WHERE sale_date > (SELECT max(sale_date) FROM resale) - INTERVAL 12 MONTH GROUP BY 1""")),
    "filter_as_of_clock": (as_of_clock, sql.resale(f"""
        SELECT CAST(year(sale_date) AS INTEGER) AS yr, count(*) AS n, max(sale_date) AS last_day FROM resale
        WHERE sale_date BETWEEN DATE '1999-01-01' AND DATE '{an.AS_OF}' GROUP BY 1""")),
    "filter_having_alias": (having_alias, sql.resale("""
        SELECT town, street_name, count(*) AS n FROM resale GROUP BY 1, 2 HAVING count(*) > 100""")),
    "aggregate_grouped_medians": (grouped_medians, sql.resale("""
        SELECT town, flat_type, round(median(price_per_sqm), 2) AS med FROM resale GROUP BY 1, 2""")),
    "aggregate_percentile_cont": (sql_percentile, sql.resale("""
        SELECT town, median(n) AS median_monthly_sales
        FROM (SELECT town, count(*) AS n FROM resale GROUP BY town, month) GROUP BY town""")),
    "aggregate_means_and_sums": (means_and_sums, sql.resale(f"""
        SELECT flat_type, round({sql.mean('resale_price', 4)}, 2) AS mean_price, CAST(sum(storey_low) AS BIGINT) AS sum_storey,
          min(resale_price) AS min_price, max(resale_price) AS max_price FROM resale GROUP BY 1""")),
    "aggregate_composite_distinct": (composite_distinct, sql.resale("""
        SELECT town, count(DISTINCT block) AS blocks, count(DISTINCT street_name || '|' || block) AS physical_blocks
        FROM resale GROUP BY 1""")),
    "aggregate_months_above_mean": (months_above_mean, sql.resale("""
        SELECT town, count(*) AS months FROM (SELECT town, count(*) AS n, avg(count(*)) OVER (PARTITION BY town) AS m
          FROM resale GROUP BY town, month) WHERE n > m GROUP BY town""")),
    "aggregate_max_pivot": (max_pivot, sql.resale("""
        SELECT town, max(resale_price) FILTER (WHERE sale_year = 1997) AS max_1997,
          max(resale_price) FILTER (WHERE sale_year = 1998) AS max_1998
        FROM resale WHERE sale_year IN (1997, 1998) GROUP BY town""")),
    "aggregate_type_shares": (type_shares, sql.resale("""
        SELECT town, round(100.0::DOUBLE * count(*) FILTER (WHERE flat_type = 'SMALL') / count(*), 2) AS pct
        FROM resale GROUP BY 1""")),
    "aggregate_two_periods": (two_periods, sql.resale("""
        SELECT round(median(resale_price) FILTER (WHERE sale_year IN (1999, 2000)), 2) AS late,
          round(median(resale_price) FILTER (WHERE sale_year IN (1995, 1996)), 2) AS early FROM resale""")),
    "window_town_month": (town_month_windows, sql.resale("""
        , series AS (SELECT town, month, sale_month, round(median(price_per_sqm), 2) AS med FROM resale GROUP BY ALL)
        SELECT town, month, med,
          round(med - lag(med) OVER (PARTITION BY town ORDER BY month), 2) AS change,
          round(median(med) OVER (PARTITION BY town ORDER BY sale_month
            RANGE BETWEEN INTERVAL 2 MONTH PRECEDING AND CURRENT ROW), 2) AS by_calendar,
          round(median(med) OVER (PARTITION BY town ORDER BY month ROWS 2 PRECEDING), 2) AS by_rows
        FROM series""")),
    "window_running_counts": (town_running_counts, sql.resale("""
        SELECT town, month, n, CAST(sum(n) OVER w AS BIGINT) AS upto, CAST(sum(n) OVER w AS BIGINT) AS upto_peers
        FROM (SELECT town, month, count(*) AS n FROM resale GROUP BY 1, 2)
        WINDOW w AS (PARTITION BY town ORDER BY month)""")),
    "window_interval_frame": (interval_frame, sql.resale("""
        SELECT town, month, median(n) OVER (PARTITION BY town ORDER BY sale_month
          RANGE BETWEEN INTERVAL 2 MONTH PRECEDING AND CURRENT ROW) AS rolling
        FROM (SELECT town, month, sale_month, count(*) AS n FROM resale GROUP BY ALL)""")),
    "order_dearest_per_town": (dearest_per_town, sql.resale("""
        SELECT town, resale_price, month, street_name, block, flat_type, CAST(rk AS INTEGER) AS rk FROM (
          SELECT *, row_number() OVER (PARTITION BY town
            ORDER BY resale_price DESC, month, street_name, block, flat_type) AS rk FROM resale) WHERE rk <= 3""")),
    "order_arg_max_by_struct": (arg_max_struct, sql.resale("""
        SELECT town, month, n FROM (SELECT town, month, count(*) AS n FROM resale GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY town ORDER BY n DESC, month) = 1""")),
    "order_top_with_positions": (top_positions, sql.resale("""
        SELECT *, row_number() OVER (ORDER BY n DESC, town, street_name, block) - 1 AS pos
        FROM (SELECT town, street_name, block, count(*) AS n FROM resale GROUP BY 1, 2, 3)
        QUALIFY pos < 20""")),
    "order_default_with_positions": (default_order, _spoiled_sql("""
        SELECT *, row_number() OVER (ORDER BY town NULLS LAST, flat_type NULLS LAST, n) - 1 AS pos
        FROM (SELECT town, flat_type, count(*) AS n FROM spoiled GROUP BY 1, 2)""")),
}
