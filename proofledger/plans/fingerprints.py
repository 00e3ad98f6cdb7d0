"""Results as rows of text, and one (row count, SHA-256) fingerprint per result.

A long table ``result_rows(question_id, attempt_n, pos, line_v1, line_v2, defect, key)`` carries any
number of results at once; ``pos`` rises along the result's own order, and is its place once the
rows are stored and read back.

Versions 1 and 2 hash a result as one text, as pinned questions need it: the lines of one result stream past
one task in order, or, where the caller expects long results, past a task per part, one after another. Version 3 folds: rows are hashed where they are, then per block of positions, then over the
blocks, so a long result takes many tasks.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofledger.functions import resuming
from proofledger.functions.cells import RECORD_SEPARATOR, plain_text, row_defect, row_line
from proofledger.operators.folding import fold
from proofledger.operators.ordering import own_sequence, sequenced

RESULT_KEY = ["question_id", "attempt_n"]


def line_columns(df: DataFrame, columns: list[str], types: dict[str, T.DataType] | None = None) -> list[Column]:
    types = types or {f.name: f.dataType for f in df.schema.fields}
    return [
        row_line(df, columns, 1, types).alias("line_v1"),
        row_line(df, columns, 2, types).alias("line_v2"),
        row_defect(df, columns, types).alias("defect"),
        plain_text(df[columns[0]], types[columns[0]]).alias("key"),
    ]


def placed_rows(df: DataFrame, order_by: list[str] | None = None, own_order: bool = False) -> DataFrame:
    """A result with ``pos``. Its order is ``order_by`` and then all columns, or what the query itself ends with (``own_order``)."""
    return own_sequence(df) if own_order else sequenced(df, order_by)


def result_rows(df: DataFrame, question_id: str, attempt_n: int, order_by: list[str] | None = None,
                own_order: bool = False) -> DataFrame:
    """One whole result in the long form, in the order of ``placed_rows``."""
    columns = df.columns
    placed = placed_rows(df, order_by, own_order)
    return placed.select(F.lit(question_id).alias("question_id"), F.lit(attempt_n).alias("attempt_n"), "pos",
                         *line_columns(placed, columns))


#: What the lines of a result stand between, per version: before, between, after.
FRAMES = {1: ("", RECORD_SEPARATOR, ""), 2: ("[", ",", "]")}


def fingerprints(rows: DataFrame, version: int, keys: list[str] | None = None, cap: int | None = None, long: bool = False) -> DataFrame:
    """(keys, rows, sha256, defect, oversized) per result that has rows; ``rows`` is the true count.

    A result of more than ``cap`` rows, where a run sets one, is oversized and gets no hash. Pass ``long`` where a result may have more
    text than a task should read and ``rows`` are stored: they are read for their sizes at once.
    """
    keys = keys or RESULT_KEY
    whole = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min_by("defect", F.when(F.col("defect").isNotNull(), F.col("pos"))).alias("found_defect"))
    oversized = F.col("rows") > cap if cap is not None else F.lit(False)
    counted = whole.withColumn("oversized", oversized)
    if cap is not None:
        rows = rows.join(counted.where(~F.col("oversized")).select(*keys), keys, "left_semi")
    hashed = folded(rows, keys) if version == 3 else in_parts(rows, version, keys) if long else flat(rows, version, keys)
    defect = F.lit(None).cast("string") if version == 1 else F.col("found_defect")
    return counted.join(hashed, keys, "left").select(
        *keys,
        "rows",
        F.when(~F.col("oversized") & defect.isNull(), F.col("sha256")).alias("sha256"),
        F.when(~F.col("oversized"), defect).alias("defect"),
        "oversized",
    )


def flat(rows: DataFrame, version: int, keys: list[str]) -> DataFrame:
    """One hash over the text of a whole result, which is sequential: a result's lines come to one task in order, and the
    task holds a batch of them, however long the result is. The sort before it spills."""
    placed = _text(rows, version, keys).repartition(*keys).sortWithinPartitions(*keys, "pos").select(*keys, "line")
    return placed.mapInArrow(_hashes(*[part.encode() for part in FRAMES[version]]), _schema(rows, keys))


def _text(rows: DataFrame, version: int, keys: list[str]) -> DataFrame:
    if version not in FRAMES:
        raise ValueError(f"unsupported serializer version: {version}")
    return rows.select(*keys, "pos", F.coalesce(F.col(f"line_v{version}"), F.lit("")).alias("line"))


def _schema(rows: DataFrame, keys: list[str]) -> T.StructType:
    return T.StructType([*[T.StructField(k, rows.schema[k].dataType) for k in keys], T.StructField("sha256", T.StringType())])


def in_parts(rows: DataFrame, version: int, keys: list[str]) -> DataFrame:
    """The same for results of any length. Those with more text than ``resuming.PART_BYTES`` are sorted by ranges of about that size and
    hashed range after range: a task takes up the hash where the one before has left it. The other results go through ``flat``."""
    text = _text(rows, version, keys)
    sizes = text.groupBy(*keys).agg(F.sum(F.octet_length("line") + 1).alias("bytes"))
    large = (F.col("bytes") > resuming.PART_BYTES) & ~F.greatest(F.lit(False), *[F.col(k).isNull() for k in keys])
    # Each of these results has a part's bytes at least, so there are few.
    known = sizes.agg(F.count(F.lit(1)).alias("results"), F.collect_list(F.when(large, F.struct(*keys, "bytes"))).alias("large")).first()
    if not known.large or not resuming.can_resume():
        return flat(rows, version, keys)
    spark = rows.sparkSession
    few = F.broadcast(spark.createDataFrame([tuple(r[k] for k in keys) for r in known.large], T.StructType(_schema(rows, keys).fields[:-1])))
    mixed = len(known.large) < known.results
    chosen = text.join(few, keys, "left_semi") if mixed else text
    parts = sum(r.bytes for r in known.large) // resuming.PART_BYTES + 1
    placed = chosen.repartitionByRange(parts, *keys, "pos").sortWithinPartitions(*keys, "pos").select(*keys, "line")
    before, between, after = [part.encode() for part in FRAMES[version]]
    pieces = T.StructType([*_schema(rows, keys).fields[:-1], T.StructField("piece", T.BinaryType())])
    # All ranges are sorted and joined side by side and kept on the executors' disks; what goes range after range is the hash alone.
    joined = placed.mapInArrow(_pieces(between), pieces).rdd.persist(StorageLevel.DISK_ONLY)
    joined.count()
    done, state = [], None
    for n in range(joined.getNumPartitions()):
        (ended, state), = spark.sparkContext.runJob(joined, _taken_up(state, before, between, after), [n])
        done += ended
    joined.unpersist()
    if state is not None:
        digest = resuming.resuming()()(after, state[1])
        done.append((*state[0], digest.hexdigest()))
    hashed = spark.createDataFrame(done, _schema(rows, keys))
    return hashed.unionByName(flat(rows.join(few, keys, "left_anti"), version, keys)) if mixed else hashed


def _pieces(between: bytes):
    """A task over sorted (keys, line): the lines of one result that come in one batch as one piece."""
    def task(batches):
        import pyarrow as pa

        for batch in batches:
            *keys, lines = [c.to_pylist() for c in batch.columns]
            of, out, begin = list(zip(*keys)), [], 0
            while begin < len(of):
                end = begin + 1
                while end < len(of) and of[end] == of[begin]:
                    end += 1
                out.append((*of[begin], between.join(line.encode() for line in lines[begin:end])))
                begin = end
            if out:
                kinds = [f.type for f in list(batch.schema)[:-1]] + [pa.binary()]
                names = [f.name for f in list(batch.schema)[:-1]] + ["piece"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return task


def _taken_up(state, before: bytes, between: bytes, after: bytes):
    """A task over one part's pieces in order, with the key and the hash's state that the part before has left: the hashes that end
    in it, and the key and state that it leaves."""
    make = resuming.resuming()

    def task(rows):
        digests, done = make(), []
        key, digest = (state[0], digests(b"", state[1])) if state is not None else (None, None)
        for *of, piece in rows:
            if digest is not None and tuple(of) == key:
                digest.update(between)
            else:
                if digest is not None:
                    digest.update(after)
                    done.append((*key, digest.hexdigest()))
                key, digest = tuple(of), digests(before)
            digest.update(bytes(piece))
        yield done, None if digest is None else (key, digest.state())

    return task


def _hashes(before: bytes, between: bytes, after: bytes):
    """A task over sorted (keys, line). Self-contained, as Python workers need not have this package."""
    def task(batches):
        import hashlib

        key, digest, fields = None, None, None
        for batch in batches:
            *keys, lines = [c.to_pylist() for c in batch.columns]
            fields, done, begin = batch.schema, [], 0
            of = list(zip(*keys))
            while begin < len(of):
                end = begin + 1
                while end < len(of) and of[end] == of[begin]:
                    end += 1
                block = between.join(line.encode() for line in lines[begin:end])
                if of[begin] != key or digest is None:
                    if digest is not None:
                        digest.update(after)
                        done.append((*key, digest.hexdigest()))
                    key, digest = of[begin], hashlib.sha256(before + block)
                else:
                    digest.update(between + block)
                begin = end
            if done:
                yield rows_of(done, fields)
        if digest is not None:
            digest.update(after)
            yield rows_of([(*key, digest.hexdigest())], fields)

    def rows_of(done, fields):
        import pyarrow as pa

        columns = list(zip(*done))
        kinds = [f.type for f in list(fields)[:-1]] + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*[f.name for f in list(fields)[:-1]], "sha256"])

    return task


def folded(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One hash over the typed lines of a result, from the hashes of its rows; needs ``pos`` without gaps."""
    return fold(rows.select(*keys, "pos", F.sha2(F.coalesce("line_v2", F.lit("")), 256).alias("sha256")), keys)


def empty_sha(version: int) -> Column:
    return F.sha2(F.lit("[]" if version == 2 else ""), 256)


def with_empty_results(results: DataFrame, prints: DataFrame, version: int, keys: list[str] | None = None) -> DataFrame:
    """Every listed result, those without rows included: 0 rows and the hash of the empty text."""
    keys = keys or RESULT_KEY
    joined = results.join(prints, keys, "left")
    return joined.withColumns({
        "sha256": F.when(F.col("rows").isNull(), empty_sha(version)).otherwise(F.col("sha256")),
        "oversized": F.coalesce("oversized", F.lit(False)),
        "rows": F.coalesce("rows", F.lit(0).cast("bigint")),
    })


def fingerprint(df: DataFrame, order_by: list[str] | None = None, version: int = 1, cap: int | None = None) -> DataFrame:
    """One row (rows, sha256, defect, oversized) for one result."""
    if version not in (1, 2):
        raise ValueError(f"unsupported serializer version: {version}")
    rows = result_rows(df, "", 1, order_by)
    one = df.sparkSession.range(1).select(F.lit("").alias("question_id"), F.lit(1).alias("attempt_n"))
    return with_empty_results(one, fingerprints(rows, version, cap=cap), version).drop(*RESULT_KEY)
