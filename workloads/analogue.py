"""Sales records made from the order tables, and a verdict log made from the event table."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from proofledger import schemas
from proofledger.functions.cells import plain_text
from proofledger.functions.numeric import round_places
from proofledger.operators.medians import exact_median
from proofledger.operators.ordering import numbered
from proofledger.plans import staging
from proofledger.plans.fingerprints import line_columns
from proofledger.plans.questions import Subject
from proofledger.session import brief_shuffles, work_path
from proofledger.sources import publish
from proofledger.sources.manifest import file_manifest

# ---- fixed values: what the questions ask about on the test tables ----
SUBJECT = Subject(
    year=1998,
    counted_town="NATION_3",
    half_town="NATION_7",
    half_type="STANDARD",
    half_year=1999,
    min_area=40.0,
    min_storey=13,
    near_miss_type="SMALL",
    main_type="STANDARD",
    area_type="LARGE",
    blocks_town="NATION_3",
    sparse_town="NATION_3",
    sparse_type="PROMO",
    sparse_streets=("Brand#4", "Brand#5", "Brand#6"),
    sparse_years=(1996, 1998),
    complete_years=(1995, 2000),
    min_lease=80.0,
    active_grain=("town", "flat_type"),
    busiest_year=1996,
    price_years=(1999, 2000),
    block="27",
    lease_year=1997,
    high_ppsm=2070.0,
    above_town="NATION_11",
    cumulative_town="NATION_5",
    cumulative_type="ECONOMY",
)
AS_OF = "2001-06-30"
FIRST_DAY = "1995-01-01"
LAST_DAY = "2001-12-31"


TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_sales(spark: SparkSession, sf_dir: str, dirty: bool = False) -> DataFrame:
    """Eleven raw fields per line item. ``dirty`` breaks some records of every kind the rules look for."""
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    # Towns come to the orders first: line items, several times as many, then move for two joins at most.
    town = (order.join(customer, order.o_custkey == customer.c_custkey)
            .join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey).select("o_orderkey", "n_name"))
    joined = line.join(town, line.l_orderkey == town.o_orderkey).join(part, line.l_partkey == part.p_partkey)
    lease_months = F.col("l_suppkey") % 12
    lease = F.concat(
        (F.col("p_size") + 40).cast("string"), F.lit(" years"),
        F.when(lease_months == 0, F.lit("")).otherwise(
            F.concat(F.lit(" "), F.lpad(lease_months.cast("string"), 2, "0"), F.lit(" months"))))
    month = F.date_format("l_shipdate", "yyyy-MM")
    area, price = F.col("l_quantity"), F.col("l_extendedprice")
    if dirty:
        key = F.col("l_orderkey")
        price = F.when(key % 997 == 0, F.lit(None)).when(key % 983 == 0, F.lit(-1.0)).otherwise(price)
        month = F.when(key % 991 == 0, F.lit("bad")).otherwise(month)
        lease = (F.when(F.col("l_partkey") % 499 == 0, F.lit(None))
                 .when(key % 977 == 0, F.lit("80 years 99 months")).otherwise(lease))
        area = F.when(key % 971 == 0, F.lit(0.0)).otherwise(area)
    band = F.col("l_linenumber") * 3
    return joined.select(
        month.alias("month"),
        F.col("n_name").alias("town"),
        F.col("p_type").alias("flat_type"),
        F.col("p_size").cast("string").alias("block"),
        F.col("p_brand").alias("street_name"),
        F.concat(F.lpad((band - 2).cast("string"), 2, "0"), F.lit(" TO "), F.lpad(band.cast("string"), 2, "0"))
        .alias("storey_range"),
        area.alias("floor_area_sqm"),
        F.col("p_name").alias("flat_model"),
        (F.year("l_shipdate") - 59 + F.col("p_size")).cast("int").alias("lease_commence_date"),
        lease.alias("remaining_lease"),
        price.alias("resale_price"),
    )


# ---- things written once per application and input folder ----

_made: dict[tuple[str, str, str], str] = {}
_lock = threading.RLock()


def made_once(spark: SparkSession, sf_dir: str, what: str, make) -> str:
    """Path of something ``make(path)`` writes into the shared folder the first time it is needed."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    with _lock:
        if key not in _made:
            path = fresh_path(spark, what)
            make(path)
            _made[key] = path
        return _made[key]


def write_once(df: DataFrame, path: str, *parts: str) -> None:
    """``df`` in a new folder, without the shuffles that made it."""
    with brief_shuffles(df.sparkSession):
        df.write.mode("errorifexists").partitionBy(*parts).parquet(path)


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path nobody has written to yet."""
    return work_path(spark, what, uuid.uuid4().hex)


def raw_table(spark: SparkSession, sf_dir: str, dirty: bool = False) -> DataFrame:
    """The raw records, joined once and landed as the joins leave them: AQE splits and merges their partitions, so that
    the wide records move no more."""
    def make(path: str) -> None:
        raw_sales(spark, sf_dir, dirty).write.mode("errorifexists").parquet(path)

    return spark.read.parquet(made_once(spark, sf_dir, f"landed_{'dirty' if dirty else 'clean'}", make))


def staged_root(spark: SparkSession, sf_dir: str) -> str:
    """The staged table, written, checked and published through the library's own path."""
    def make(path: str) -> None:
        raw = raw_table(spark, sf_dir)
        receipt = file_manifest(spark, sf_dir, "lineitem.parquet")
        counted = staging.accounting(raw)
        clean, results = publish.publish(spark, staging.stage(raw, for_writing=True), path, receipt, counted, LAST_DAY, FIRST_DAY,
                                         f"{AS_OF}T00:00:00Z")
        if not clean:
            raise ValueError(f"staging failed: {results.where('violations > 0').collect()}")

    return made_once(spark, sf_dir, "staged", make)


_current: dict[str, str] = {}


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published table; which version is current is looked up once per application."""
    root = staged_root(spark, sf_dir)
    if root not in _current:
        _current[root] = publish.current_path(spark, root)
    return publish.read_staged(spark, _current[root])


def raw_csv(spark: SparkSession, sf_dir: str, dirty: bool = False, codec: str = "none") -> str:
    """The raw records as delimited files with a header."""
    def make(path: str) -> None:
        (raw_table(spark, sf_dir, dirty).write.mode("errorifexists").option("header", True)
         .option("compression", codec).option("escape", '"').csv(path))

    return made_once(spark, sf_dir, f"raw_{'dirty' if dirty else 'clean'}_{codec}", make)


# ---- verdict log: each (user, day) is a question, its events are the attempts ----


def event_outcome():
    return F.expr("CASE event_type WHEN 'error' THEN 'sql_error' WHEN 'signup' THEN 'timeout' ELSE 'ok' END")


def event_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    day = F.to_date("ts")
    return events.select(
        F.concat(F.lit("U"), F.col("user_id").cast("string"), F.lit("-"), F.date_format(day, "yyyyMMdd"))
        .alias("question_id"),
        "ts", "event_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def value_print(value) -> list:
    """Row count and version 1 hash of a one-cell result."""
    return [F.lit(1).cast("bigint").alias("rows"), F.sha2(plain_text(value, DoubleType()), 256).alias("sha256")]


def event_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """type and trap come from the first event; the pinned answer is the group's median value at 2 places."""
    groups = event_groups(spark, sf_dir)
    first = groups.groupBy("question_id").agg(F.min_by("k", F.struct("ts", "event_id")).alias("k"))
    med = exact_median(groups, ["question_id"], F.col("value"), "med")
    pinned = med.select("question_id", round_places(F.col("med"), 2).alias("answer"))
    return first.join(pinned, "question_id").select(
        "question_id",
        F.concat(F.lit("bucket"), F.lpad(F.col("k").cast("string"), 2, "0")).alias("type"),
        (F.col("k") % 5 == 0).alias("trap"),
        *value_print(F.col("answer")),
    )


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested log record per question with all its attempts, as a log holds them."""
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("ts", "event_id"))
    kept = event_groups(spark, sf_dir).withColumn("n", place)
    ok = F.col("outcome") == "ok"
    rows, sha = value_print(F.col("value"))
    entry = F.struct(
        F.col("n").cast("int").alias("n"),
        F.concat(F.lit("SELECT "), F.col("value").cast("string")).alias("sql"),
        "outcome",
        F.when(ok, "").otherwise(F.concat(F.lit("event "), F.col("event_id").cast("string"))).alias("note"),
        F.when(ok, F.array(rows.cast("string"), sha)).alias("fingerprint"),
    )
    return (
        kept.withColumn("outcome", event_outcome()).groupBy("question_id").agg(
            F.array_sort(F.collect_list(entry)).alias("attempts"),
            F.min_by("event_type", "n").alias("first_type"))
        .select(
            F.col("question_id").alias("id"),
            F.concat(F.lit("What happened to "), F.col("question_id")).alias("question"),
            F.when(F.col("first_type") != "click", F.concat(F.lit("model-"), F.col("first_type"))).alias("model"),
            "attempts")
    )


META = {"serializer_version": 1, "provider": "local", "run_date": AS_OF, "model": "model-default",
        "temperature": 0.0, "max_tokens": 2048, "golden_set_version": 1}


def event_log(spark: SparkSession, sf_dir: str) -> str:
    """The log as JSON lines: a meta record, first-attempt records as written early, then full records."""
    def make(path: str) -> None:
        records = event_records(spark, sf_dir)
        meta = spark.createDataFrame([(META,)], f"meta {schemas.META_STRUCT}")
        early = records.where(F.size("attempts") >= 2).withColumn("attempts", F.slice("attempts", 1, 1))
        log = meta.unionByName(early, allowMissingColumns=True).unionByName(records, allowMissingColumns=True)
        log.write.mode("errorifexists").json(path)

    return made_once(spark, sf_dir, "event_log", make)


# ---- result rows at volume: every order is a result, its line items are the rows ----

CELLS = ["label", "part", "price", "signed", "tax", "shipped", "day", "open"]
ITEM_KEYS = ["l_orderkey"]
# Total up to line items that are equal in every cell.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_shipdate",
              "l_returnflag", "l_linestatus"]


def order_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered result rows per order with cells of every kind, all items of every order."""
    line = table(spark, sf_dir, "lineitem")
    placed = line.withColumn("place", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)))
    return item_cells(placed, F.col("l_orderkey"), F.col("place").cast("bigint") - 1)


def item_cells(placed: DataFrame, question_id: Column, pos: Column) -> DataFrame:
    """Line items as result rows."""
    odd_text = F.when(F.col("l_linenumber") % 2 == 0, F.lit('"\\\t\x01é/')).otherwise("")
    return placed.select(
        question_id.alias("question_id"),
        pos.alias("pos"),
        F.concat(F.col("l_returnflag"), odd_text).alias("label"),
        F.col("l_partkey").alias("part"),
        F.col("l_extendedprice").alias("price"),
        (F.col("l_discount") - 0.05).alias("signed"),
        F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("tax"),
        F.col("l_shipdate").alias("shipped"),
        F.to_date("l_shipdate").alias("day"),
        (F.col("l_linestatus") == "O").alias("open"),
    )


def as_result_rows(cells: DataFrame, attempt_n: int) -> DataFrame:
    return cells.select("question_id", F.lit(attempt_n).alias("attempt_n"), "pos", *line_columns(cells, CELLS))


def order_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_result_rows(order_results(spark, sf_dir), 0)


def order_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_result_rows(changed_results(order_results(spark, sf_dir)), 1)


def changed_results(cells: DataFrame) -> DataFrame:
    """Candidate rows per order: unchanged, without the last row, reversed, with a changed cell, with a
    number that cannot be serialized, or without any row, by the order number."""
    kind = F.col("question_id") % 7
    size = F.count(F.lit(1)).over(Window.partitionBy("question_id"))
    last = F.col("size") - 1
    return (
        cells.withColumn("size", size)
        .where(~((kind == 1) & (F.col("pos") == last)) & (kind != 5))
        .withColumn("pos", F.when(kind == 2, last - F.col("pos")).otherwise(F.col("pos")))
        .withColumn("price", F.when(kind == 3, F.col("price") + 0.01)
                    .when((kind == 4) & (F.col("pos") == 0), F.lit(float("nan"))).otherwise(F.col("price")))
        .drop("size")
    )


def order_rows(spark: SparkSession, sf_dir: str, attempt_n: int) -> DataFrame:
    """Reference (0) or candidate (1) rows of all orders. Their cells are written once, as they are; the text, many times as long, is
    made where it is read, and only the version that is asked for."""
    def make(path: str) -> None:
        cells = order_results(spark, sf_dir)
        both = cells.withColumn("attempt_n", F.lit(0)).unionByName(changed_results(cells).withColumn("attempt_n", F.lit(1)))
        write_once(both, path, "attempt_n")

    cells = spark.read.parquet(made_once(spark, sf_dir, "order_cells", make)).where(F.col("attempt_n") == attempt_n)
    return as_result_rows(cells, attempt_n)


def all_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items as the rows of one result, by the hundred thousand and more."""
    def make(path: str) -> None:
        placed = numbered(table(spark, sf_dir, "lineitem"), [*ITEM_KEYS, *LINE_ORDER], f"{path}-places")
        as_result_rows(item_cells(placed, F.lit("items"), F.col("pos")), 0).write.mode("errorifexists").parquet(path)

    return spark.read.parquet(made_once(spark, sf_dir, "all_items", make))


def order_log(spark: SparkSession, sf_dir: str, attempt_n: int) -> DataFrame:
    """One executed attempt per order."""
    ids = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("question_id")).distinct()
    return ids.select("question_id", F.lit(attempt_n).alias("attempt_n"), F.lit("ok").alias("outcome"),
                      F.lit("").alias("note"))
