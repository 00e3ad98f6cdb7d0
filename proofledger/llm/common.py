"""Helpers that several operators share: settled tables, distributed positions, bounded Arrow batches."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.window import Window

from proofledger.session import brief_shuffles, work_path

#: A word of the contracts: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Arrow batches that Python tasks hand back hold about this many bytes.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and no lineage to repeat when an
    executor is lost. The files stay until ``let_go``, or until the application's folder is removed."""
    path = work_path(df.sparkSession, "llm", f"{name}-{uuid.uuid4().hex[:12]}")
    with brief_shuffles(df.sparkSession):
        df.write.parquet(path)
    settled = df.sparkSession.read.schema(df.schema).parquet(path)
    _settled[settled] = path
    return settled


_settled: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def let_go(*tables: DataFrame) -> None:
    """Remove the files of settled tables that nothing will read again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_settled.pop(df))
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once per row, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def positions(df: DataFrame, order: list[Column], name: str, group: str | None = None) -> DataFrame:
    """``df`` with a column ``name``: the row's number from 0 in ``order``, or in ``order`` within ``group``.

    ``order`` starts with the group's column. Rows are dealt by ranges of the order, so no group and no table
    meets in one task; a row's number is its number in its own part plus the sizes of the parts before.
    The result is settled. Rows that tie in the whole order are interchangeable.
    """
    parts = [group] if group else []
    laid = settle(df.repartitionByRange(*order).sortWithinPartitions(*order)
                  .withColumn("_at", F.monotonically_increasing_id()), "positions")
    split = laid.withColumn("_part", F.shiftright("_at", 33)).withColumn("_row", F.col("_at").bitwiseAND((1 << 33) - 1))
    sizes = split.groupBy("_part", *parts).agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy(*parts).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col("_part").alias("_p"), *[F.col(g).alias("_g") for g in parts],
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    same = F.col("_part") == F.col("_p")
    if group:
        same = same & F.col(group).eqNullSafe(F.col("_g"))
    return split.join(starts, same).withColumn(name, F.col("_row") + F.col("_shift")).drop(
        "_at", "_part", "_row", "_p", "_g", "_n", "_first", "_shift")


def portions(batch: pa.RecordBatch, chars: int) -> Iterator[tuple[list, list[str]]]:
    """First column and second column (text, NULL as empty) of a batch, cut after every ``chars`` characters."""
    keys, texts, size = [], [], 0
    for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        keys.append(key)
        texts.append(text.as_py() or "")
        size += len(texts[-1])
        if size >= chars:
            yield keys, texts
            keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, which need not see the driver's folders: a small archive
    that Spark hands to them, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="code-"), "proofledger.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    archive.write(file, os.path.relpath(file, os.path.dirname(package)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def by_tasks(df: DataFrame, tasks: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: pa.Schema) -> DataFrame:
    """``df`` through ``tasks``, a function from Arrow batches to Arrow batches that runs once per partition."""
    ship(df.sparkSession)
    return df.mapInArrow(tasks, from_arrow_schema(schema))


def by_rows(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, tuple]]], schema: pa.Schema) -> DataFrame:
    """As ``by_tasks``; ``rows`` gives each row with its size in bytes."""
    return by_tasks(df, lambda batches: in_batches(rows(batches), schema), schema)


def in_batches(rows: Iterator[tuple[int, tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows, each with its size in bytes, as Arrow batches of bounded size."""
    held: list[tuple] = []
    size = 0
    for weight, row in rows:
        held.append(row)
        size += weight + 16 * len(row)
        if size >= BATCH_BYTES:
            yield batch_of(held, schema)
            held, size = [], 0
    if held:
        yield batch_of(held, schema)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
