"""The 32 analyst questions, each a DataFrame of the staged table, and other spellings of some.

A question's ``build`` gives the unordered answer; ``order_by`` and the columns after it give the
total order in which the answer is read and fingerprinted.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofledger.functions.numeric import mean, round_places, share_pct
from proofledger.functions.parse import year_text
from proofledger.operators.medians import exact_median, period_medians
from proofledger.operators.ordering import ordered, top
from proofledger.operators.windows import (
    change_from_previous,
    first_per_group,
    rolling_median_by_calendar,
    rolling_median_by_rows,
    running_sum,
    running_sum_peers,
)


@dataclass(frozen=True)
class Subject:
    """What the questions ask about. The defaults are the fixed values of the property data set."""

    year: int = 2023
    counted_town: str = "TAMPINES"
    half_town: str = "BEDOK"
    half_type: str = "5 ROOM"
    half_year: int = 2024
    min_area: float = 110.0
    min_storey: int = 13
    near_miss_type: str = "2 ROOM"
    main_type: str = "4 ROOM"
    area_type: str = "EXECUTIVE"
    blocks_town: str = "BUKIT MERAH"
    sparse_town: str = "HOUGANG"
    sparse_type: str = "2 ROOM"
    sparse_streets: tuple[str, ...] = ()
    sparse_years: tuple[int, int] = (2022, 2024)
    complete_years: tuple[int, int] = (2017, 2025)
    min_lease: float = 80.0
    active_grain: tuple[str, ...] = ("town",)
    busiest_year: int = 2020
    price_years: tuple[int, int] = (2024, 2025)
    block: str = "27"
    lease_year: int = 2019
    high_ppsm: float = 6000.0
    above_town: str = "QUEENSTOWN"
    cumulative_town: str = "TOA PAYOH"
    cumulative_type: str = "3 ROOM"


Build = Callable[[DataFrame, Subject], DataFrame]


@dataclass(frozen=True)
class Question:
    id: str
    type: str
    trap: bool
    question: str
    why: str
    build: Build
    order_by: tuple[str, ...] = ()


@dataclass(frozen=True)
class Spelling:
    """Another way to answer a question, with the verdict it must get against the reference."""

    question_id: str
    name: str
    build: Build
    expected: str = ""
    order_by: tuple[str, ...] = field(default=())


def months(first_year: int, first: int, last_year: int, last: int) -> Column:
    """A span of months on the stored text, with the year range that prunes partitions."""
    span = F.col("month").between(f"{first_year}-{first:02d}", f"{last_year}-{last:02d}")
    return F.col("sale_year").between(first_year, last_year) & span


def years(first: int, last: int | None = None) -> Column:
    return months(first, 1, first if last is None else last, 12)


def like_year(year: int) -> Column:
    return (F.col("sale_year") == year) & F.col("month").like(f"{year}-%")


def _count() -> Column:
    return F.count(F.lit(1)).alias("n")


def _ppsm() -> Column:
    return F.col("price_per_sqm")


def _years_in(span: tuple[int, int]) -> int:
    return span[1] - span[0] + 1


def _months_in(span: tuple[int, int]) -> int:
    """Staged month text is strictly YYYY-MM, so a span of years has no more months than this."""
    return 12 * _years_in(span)


# ---- filters and single figures ----


def q01(t, s):
    return t.where(years(s.year) & (F.col("town") == s.counted_town)).agg(_count())


def q02(t, s):
    half = months(s.half_year, 1, s.half_year, 6)
    return t.where(half & (F.col("town") == s.half_town) & (F.col("flat_type") == s.half_type)).agg(_count())


def q03(t, s):
    tall_and_large = (F.col("floor_area_sqm") >= s.min_area) & (F.col("storey_low") >= s.min_storey)
    return t.where(years(s.year) & tall_and_large).agg(_count())


def q04(t, s):
    return t.where(years(s.year) & (F.col("flat_type") == s.near_miss_type)).agg(_count())


def q05(t, s):
    rows = t.where(years(s.year) & (F.col("flat_type") == s.main_type))
    med = exact_median(rows, [], F.col("resale_price"), "med")
    return med.select(round_places(F.col("med"), 0).alias("median_price"))


def q06(t, s):
    rows = t.where(years(s.year) & (F.col("flat_type") == s.area_type))
    return rows.agg(round_places(mean(F.col("floor_area_sqm"), 4), 1).alias("avg_area_sqm"))


def q07(t, s):
    rows = t.where(years(s.year))
    return rows.agg(share_pct(F.count_if(F.col("flat_type") == s.main_type), F.count(F.lit(1))).alias("pct_type"))


def q08(t, s):
    return t.where(years(s.year)).groupBy("flat_type").agg(_count())


def q09(t, s):
    med = exact_median(t.where(years(s.year)), ["town"], _ppsm(), "med")
    return top(med.select("town", round_places(F.col("med"), 2).alias("median_ppsm")), ["median_ppsm desc", "town"], 1)


def q10(t, s):
    return t.where(years(s.year)).groupBy("town").agg(_count())


def q11(t, s):
    rows = t.where(years(s.year) & (F.col("flat_type") == s.main_type))
    prices = rows.groupBy("town").agg(round_places(mean(F.col("resale_price"), 4), 2).alias("avg_price"))
    return top(prices, ["avg_price desc", "town"], 5)


def q12(t, s):
    counts = t.where(years(s.year)).groupBy("town", "street_name", "block").agg(_count())
    return top(counts, ["n desc", "town", "street_name", "block"], 1)


def q13(t, s):
    rows = t.where(years(s.year) & (F.col("town") == s.blocks_town))
    return rows.agg(F.count_distinct("street_name", "block").alias("n"))


def q14(t, s):
    med = exact_median(t.where(years(s.year)), ["month"], _ppsm(), "med", groups_at_most=12)
    change = change_from_previous(med, "med", "month", "change")
    return change.select("month", round_places(F.col("med"), 2).alias("med_ppsm"),
                         round_places(F.col("change"), 2).alias("change_from_prev"))


def sparse_rows(t, s):
    rows = t.where((F.col("town") == s.sparse_town) & (F.col("flat_type") == s.sparse_type))
    return rows.where(F.col("street_name").isin(*s.sparse_streets)) if s.sparse_streets else rows


def q15(t, s):
    rows = sparse_rows(t, s).where(years(*s.sparse_years))
    series = exact_median(rows, ["month", "sale_month"], _ppsm(), "med", _months_in(s.sparse_years))
    rolled = rolling_median_by_calendar(series, "med", "sale_month", 3, "rolled")
    return rolled.select("month", round_places(F.col("rolled"), 2).alias("rolling_3m_median_ppsm"))


def q16(t, s):
    counts = t.where(years(s.year)).groupBy("town", "month").agg(_count())
    return first_per_group(counts, ["town"], [F.col("n").desc(), F.col("month")])


def q17(t, s):
    rows = t.where(years(*s.complete_years)).withColumn("yr", year_text(F.col("sale_month")))
    series = exact_median(rows, ["yr"], _ppsm(), "med", _years_in(s.complete_years))
    change = change_from_previous(series, "med", "yr", "change")
    return change.select("yr", round_places(F.col("med"), 2).alias("med_ppsm"),
                         round_places(F.col("change"), 2).alias("change_from_prev_year"))


def q18(t, s):
    rows = t.where(years(s.year))
    overall = exact_median(rows, [], _ppsm(), "med_all")  # one row by construction
    by_town = exact_median(rows, ["town"], _ppsm(), "med").crossJoin(F.broadcast(overall))
    return by_town.select("town", round_places(F.col("med") / F.col("med_all"), 2).alias("ratio_to_overall"))


def q19(t, s):
    rows = t.where(years(s.year) & (F.col("remaining_lease_years") >= s.min_lease))
    return rows.agg(round_places(mean(_ppsm()), 2).alias("avg_ppsm"))


def q20(t, s):
    rows = t.where(years(s.year) & (F.col("town") == s.counted_town))
    return rows.agg(F.count_distinct("flat_model").alias("n"))


def q21(t, s):
    grain = list(s.active_grain)
    active = t.where(years(s.year)).groupBy(*grain).agg(F.count_distinct("month").alias("months_seen"))
    return active.where("months_seen = 12").select(*grain)


def q22(t, s):
    counts = t.where(years(s.busiest_year)).groupBy("month").agg(_count())
    return top(counts, ["n desc", "month"], 1)


def q23(t, s):
    meds = period_medians(t.where(years(s.year - 1, s.year)),
                          {"later": years(s.year), "earlier": years(s.year - 1)}, _ppsm())
    return meds.select(round_places(F.col("later") - F.col("earlier"), 2).alias("change_ppsm"))


def q24(t, s):
    before, after = s.price_years
    meds = period_medians(t.where(years(before, after)), {"later": years(after), "earlier": years(before)},
                          F.col("resale_price"))
    return meds.select(round_places(F.col("later") - F.col("earlier"), 2).alias("change_price"))


def q25(t, s):
    rows = t.where(years(s.year) & (F.col("block") == s.block))
    return rows.agg(round_places(mean(F.col("resale_price"), 4), 2).alias("avg_price"))


def q26(t, s):
    rows = t.where(years(s.lease_year) & (F.col("flat_type") == s.main_type))
    return rows.agg(round_places(mean(F.col("remaining_lease_years")), 1).alias("avg_lease_years"))


def q27(t, s):
    by_month = t.where(years(s.year)).groupBy("month").agg(_count())
    average = by_month.agg(F.avg("n").alias("mean_n"))
    return by_month.crossJoin(F.broadcast(average)).where("n > mean_n").agg(_count())


def q28(t, s):
    return top(t.where(years(s.year)).select("month", "resale_price"), ["resale_price desc", "month"], 1)


def q29(t, s):
    med = exact_median(t.where(years(s.year)), ["flat_type"], _ppsm(), "med").where(F.col("med") > s.high_ppsm)
    return med.select("flat_type", round_places(F.col("med"), 2).alias("median_ppsm"))


def q30(t, s):
    rows = t.where(years(s.year))
    overall = exact_median(rows, [], F.col("resale_price"), "med_all")
    town = rows.where(F.col("town") == s.above_town).crossJoin(F.broadcast(overall))
    above = F.count_if(F.col("resale_price") > F.col("med_all"))
    return town.agg(share_pct(above, F.count(F.lit(1))).alias("pct_above"))


def q31(t, s):
    rows = t.where(years(s.year) & (F.col("town") == s.cumulative_town) & (F.col("flat_type") == s.cumulative_type))
    return running_sum(rows.groupBy("month").agg(_count()), "n", "month", "cumulative_n").select("month", "cumulative_n")


def q32(t, s):
    return t.where(months(s.year, 1, s.year, 3)).agg(_count())


QUESTIONS = [
    Question("Q01", "filter", False, "How many sales did one town register in one year?",
             "point lookup", q01),
    Question("Q02", "filter", False, "How many sales of one type did one town register from January to June?",
             "half-year window on month text", q02),
    Question("Q03", "filter", False, "How many sales of a year have at least a given area and start at a given storey?",
             "conditions on a raw and on a parsed column", q03),
    Question("Q04", "filter", True, "How many sales of one flat type were there in a year?",
             "flat_model has nearly the same label", q04),
    Question("Q05", "aggregation", False, "What was the median price of one type in a year, in whole units?",
             "median of a skewed distribution", q05),
    Question("Q06", "aggregation", False, "What was the mean area of one type in a year, to one decimal?",
             "rounding is part of the answer", q06),
    Question("Q07", "ratio", False, "What percent of a year's sales were of one type, to two decimals?",
             "filtered count over the full count", q07),
    Question("Q08", "grouping", False, "How many sales per type in a year, most first, ties by name?",
             "grouping with a total order", q08, ("n desc", "flat_type")),
    Question("Q09", "grouping", False, "Which town had the highest median price per square metre, ties by name?",
             "top 1 with a tie-break", q09, ("median_ppsm desc", "town")),
    Question("Q10", "grouping", False, "How many sales per town in a year, by town name?",
             "complete enumeration", q10, ("town",)),
    Question("Q11", "grouping", False, "Which five towns had the highest mean price for one type, ties by name?",
             "top 5 on a rounded mean", q11, ("avg_price desc", "town")),
    Question("Q12", "grouping", True, "Which physical block saw the most sales in a year, ties by town, street, block?",
             "block numbers repeat across towns and streets", q12, ("n desc", "town", "street_name", "block")),
    Question("Q13", "grouping", True, "How many distinct physical blocks of a town had sales in a year?",
             "distinct block numbers undercount", q13),
    Question("Q14", "window", False, "Monthly median price per square metre and its change from the month before?",
             "round after the difference; the first change is NULL", q14, ("month",)),
    Question("Q15", "window", True, "Rolling median over three calendar months of a sparse series?",
             "gaps make row frames wrong, and the filter comes before the window", q15, ("month",)),
    Question("Q16", "window", False, "Busiest month of each town, the earlier one on ties?",
             "arg-max per group", q16, ("town",)),
    Question("Q17", "window", False, "Yearly median price per square metre and its change, complete years only?",
             "the year is text; the last year is partial", q17, ("yr",)),
    Question("Q18", "ratio", False, "Each town's median price per square metre over the overall median?",
             "the overall figure is computed once", q18, ("town",)),
    Question("Q19", "aggregation", False, "Mean price per square metre of sales with at least a given lease?",
             "filter on a parsed column", q19),
    Question("Q20", "distinct", False, "How many flat models appear in one town's sales of a year?",
             "distinct count", q20),
    Question("Q21", "distinct", False, "Which towns had a sale in every month of a year?",
             "completeness over 12 months", q21),
    Question("Q22", "date", False, "Which month of a year had the most sales, the earliest on ties?",
             "arg-max over months", q22, ("n desc", "month")),
    Question("Q23", "ratio", False, "By how much did the median price per square metre change between two years?",
             "later minus earlier", q23),
    Question("Q24", "ambiguous", True, "How much have prices gone up in the last year?",
             "pinned reading: median price, later year minus earlier year", q24),
    Question("Q25", "grouping", False, "What was the mean price for one block number in a year, in any town?",
             "taken literally over all towns", q25),
    Question("Q26", "aggregation", True, "What was the mean remaining lease of one type in a year, to one decimal?",
             "the lease text has months", q26),
    Question("Q27", "aggregation", False, "How many months of a year had more sales than its average month?",
             "aggregate of an aggregate", q27),
    Question("Q28", "date", False, "What was the highest price of a year and in which month, the earliest on ties?",
             "row extreme with a tie-break", q28, ("resale_price desc", "month")),
    Question("Q29", "grouping", False, "Which types had a median price per square metre above a threshold?",
             "condition on an aggregate", q29, ("flat_type",)),
    Question("Q30", "ratio", False, "What percent of a town's sales were priced above the overall median?",
             "row-level comparison with one figure", q30),
    Question("Q31", "window", False, "Cumulative monthly sales of one type in one town across a year?",
             "running total", q31, ("month",)),
    Question("Q32", "date", False, "How many sales were registered in the first quarter of a year?",
             "quarter on month text", q32),
]
BY_ID = {q.id: q for q in QUESTIONS}


def answer(question: Question, table: DataFrame, subject: Subject) -> DataFrame:
    """The question's answer in its total order."""
    return ordered(question.build(table, subject), list(question.order_by))


# ---- other spellings that give the same answer ----


def q04_like(t, s):
    return t.where(like_year(s.year) & (F.col("flat_type") == s.near_miss_type)).agg(_count())


def q07_case(t, s):
    hits = F.count(F.when(F.col("flat_type") == s.main_type, 1))
    return t.where(like_year(s.year)).agg(share_pct(hits, F.count(F.lit(1))).alias("pct_type"))


def q08_like(t, s):
    return t.where(like_year(s.year)).groupBy("flat_type").agg(_count())


def q18_joined(t, s):
    by_town = exact_median(t.where(like_year(s.year)), ["town"], _ppsm(), "town_median")
    overall = exact_median(t.where(like_year(s.year)), [], _ppsm(), "overall_median")
    ratio = round_places(F.col("town_median") / F.col("overall_median"), 2)
    return by_town.join(F.broadcast(overall)).select("town", ratio.alias("ratio"))


def q22_like(t, s):
    counts = t.where(like_year(s.busiest_year)).groupBy("month").agg(_count())
    return top(counts, ["n desc", "month"], 1)


def q23_pivot(t, s):
    two = t.where(F.col("sale_year").isin(s.year - 1, s.year)).withColumn("yr", F.year("sale_month"))
    by_year = exact_median(two, ["yr"], _ppsm(), "med", groups_at_most=2)
    wide = by_year.groupBy().pivot("yr", [s.year - 1, s.year]).agg(F.max("med"))
    return wide.select(round_places(F.col(f"`{s.year}`") - F.col(f"`{s.year - 1}`"), 2).alias("change"))


def q25_like(t, s):
    rows = t.where(like_year(s.year) & (F.col("block") == s.block))
    return rows.agg(round_places(mean(F.col("resale_price"), 4), 2).alias("avg_price"))


def q26_like(t, s):
    rows = t.where(like_year(s.lease_year) & (F.col("flat_type") == s.main_type))
    return rows.agg(round_places(mean(F.col("remaining_lease_years")), 1).alias("avg_lease"))


def q27_joined(t, s):
    by_month = t.where(like_year(s.year)).groupBy("month").agg(_count())
    average = by_month.agg(F.avg("n").alias("mean_n"))
    return by_month.join(F.broadcast(average), F.col("n") > F.col("mean_n")).agg(_count())


def q28_like(t, s):
    return top(t.where(like_year(s.year)).select("month", "resale_price"), ["resale_price desc", "month"], 1)


def q29_alias(t, s):
    med = exact_median(t.where(like_year(s.year)), ["flat_type"], _ppsm(), "med")
    rounded = med.select("flat_type", round_places(F.col("med"), 2).alias("median_ppsm"))
    return rounded.where(F.col("median_ppsm") > s.high_ppsm)


def q30_dates(t, s):
    """Date range instead of month text, CASE count, comma join with the one-row median."""
    days = (F.col("sale_date") >= f"{s.year}-01-01") & (F.col("sale_date") <= f"{s.year}-12-31")
    rows = t.where((F.col("sale_year") == s.year) & days)
    overall = exact_median(rows, [], F.col("resale_price"), "median_price")
    town = rows.where(F.col("town") == s.above_town).join(F.broadcast(overall))
    above = F.count(F.when(F.col("resale_price") > F.col("median_price"), 1))
    return town.agg(share_pct(above, F.count(F.lit(1))).alias("pct"))


def q31_peers(t, s):
    rows = t.where(years(s.year) & (F.col("town") == s.cumulative_town) & (F.col("flat_type") == s.cumulative_type))
    return running_sum_peers(rows.groupBy("month").agg(_count()), "n", "month", "total").select("month", "total")


# ---- spellings with a known mistake ----


def q13_block_only(t, s):
    return t.where(years(s.year) & (F.col("town") == s.blocks_town)).agg(F.count_distinct("block").alias("n"))


def q13_block_only_dates(t, s):
    days = (F.col("sale_date") >= f"{s.year}-01-01") & (F.col("sale_date") <= f"{s.year}-12-31")
    rows = t.where((F.col("sale_year") == s.year) & days & (F.col("town") == s.blocks_town))
    return rows.agg(F.count_distinct("block").alias("n"))


def q14_rounds_first(t, s):
    med = exact_median(t.where(years(s.year)), ["month"], _ppsm(), "med", groups_at_most=12)
    rounded = med.select("month", round_places(F.col("med"), 2).alias("med"))
    change = change_from_previous(rounded, "med", "month", "change")
    return change.select("month", "med", round_places(F.col("change"), 2).alias("change"))


def q14_rounds_both(t, s):
    med = exact_median(t.where(years(s.year)), ["month"], _ppsm(), "raw", groups_at_most=12)
    both = med.select("month", round_places(F.col("raw"), 2).alias("med"))
    change = change_from_previous(both, "med", "month", "change")
    return change.select("month", "med", round_places(F.col("change"), 2).alias("change"))


def q15_row_frame(t, s):
    """Row frame over the whole history, months cut afterwards."""
    series = exact_median(sparse_rows(t, s), ["month", "sale_month"], _ppsm(), "med")
    rolled = rolling_median_by_rows(series, "med", "month", 3, "rolled").where(
        F.col("month").between(f"{s.sparse_years[0]}-01", f"{s.sparse_years[1]}-12"))
    return rolled.select("month", round_places(F.col("rolled"), 2).alias("rolling_median"))


def q15_row_frame_inside(t, s):
    series = exact_median(sparse_rows(t, s).where(years(*s.sparse_years)), ["month"], _ppsm(), "med",
                          _months_in(s.sparse_years))
    rolled = rolling_median_by_rows(series, "med", "month", 3, "rolled")
    return rolled.select("month", round_places(F.col("rolled"), 2).alias("rolling_median"))


def _integer_years(rows, s):
    rows = rows.withColumn("year", F.year("sale_date"))
    series = exact_median(rows, ["year"], _ppsm(), "med", _years_in(s.complete_years))
    change = change_from_previous(series, "med", "year", "change")
    return change.select("year", round_places(F.col("med"), 2).alias("median"),
                         round_places(F.col("change"), 2).alias("change"))


def q17_integer_year(t, s):
    return _integer_years(t.where(years(*s.complete_years)), s)


def q17_integer_year_by_date(t, s):
    first, last = s.complete_years
    days = (F.col("sale_date") >= f"{first}-01-01") & (F.col("sale_date") <= f"{last}-12-31")
    return _integer_years(t.where(F.col("sale_year").between(first, last) & days), s)


def q24_mean_by_clock(as_of: str) -> Build:
    """Mean instead of median, anchored on the run date, rounded to whole units."""
    def build(t, s):
        this_year = F.year(F.lit(as_of).cast("date"))
        by_year = t.where(F.col("sale_year") >= this_year - 2).groupBy("sale_year").agg(
            mean(F.col("resale_price"), 4).alias("mean"))
        # Only the last two years are kept before the difference, as the mistaken query does.
        change = change_from_previous(by_year.where(F.col("sale_year") >= this_year - 1), "mean", "sale_year", "d")
        return change.where("d IS NOT NULL").select(round_places(F.col("d"), 0).alias("price_increase"))
    return build


def q24_mean_by_last_date(t, s):
    """Mean instead of median, anchored on the last date of the table, which is looked up in its newest year."""
    newest = t.agg(F.max("sale_year")).scalar()
    last = t.where(F.col("sale_year") == newest).agg(F.max("sale_date")).scalar()
    rows = t.where((F.col("sale_year") >= newest - 2) & (F.col("sale_date") >= F.add_months(last, -24)))
    by_year = rows.groupBy("sale_year").agg(mean(F.col("resale_price"), 4).alias("mean"))
    change = change_from_previous(by_year, "mean", "sale_year", "d").where(F.col("sale_year") >= newest - 1)
    return change.where("d IS NOT NULL").agg(round_places(F.max_by("d", "sale_year"), 0).alias("price_increase"))


def spellings(as_of: str) -> list[Spelling]:
    wrong = "value_mismatch"
    return [
        Spelling("Q04", "like", q04_like),
        Spelling("Q07", "like_and_case_count", q07_case),
        Spelling("Q08", "like", q08_like, order_by=("n desc", "flat_type")),
        Spelling("Q13", "block_only", q13_block_only, wrong),
        Spelling("Q13", "block_only_by_date", q13_block_only_dates, wrong),
        Spelling("Q14", "round_before_difference", q14_rounds_first, wrong, ("month",)),
        Spelling("Q14", "round_both_before_difference", q14_rounds_both, wrong, ("month",)),
        Spelling("Q15", "row_frame_over_history", q15_row_frame, wrong, ("month",)),
        Spelling("Q15", "row_frame_inside_period", q15_row_frame_inside, wrong, ("month",)),
        Spelling("Q17", "integer_year", q17_integer_year, wrong, ("year",)),
        Spelling("Q17", "integer_year_by_date", q17_integer_year_by_date, wrong, ("year",)),
        Spelling("Q18", "two_medians_joined", q18_joined, order_by=("town",)),
        Spelling("Q22", "like", q22_like, order_by=("n desc", "month")),
        Spelling("Q23", "pivot", q23_pivot),
        Spelling("Q24", "mean_by_clock", q24_mean_by_clock(as_of), wrong),
        Spelling("Q24", "mean_by_last_date", q24_mean_by_last_date, wrong),
        Spelling("Q25", "like", q25_like),
        Spelling("Q26", "like", q26_like),
        Spelling("Q27", "join_on_mean", q27_joined),
        Spelling("Q28", "like", q28_like, order_by=("resale_price desc", "month")),
        Spelling("Q29", "having_on_alias", q29_alias, order_by=("flat_type",)),
        Spelling("Q30", "date_range_and_case_count", q30_dates),
        Spelling("Q31", "sum_of_count_default_frame", q31_peers, order_by=("month",)),
    ]
