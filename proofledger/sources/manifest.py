"""File identity: one row per source file, receipts and the identity gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from proofledger.functions import resuming
from proofledger.functions.parse import MONTH_TEXT

# ---- fixed values: the mark that readers skip at the start of a text, suffixes of files that readers unpack ----
BYTE_ORDER_MARK = b"\xef\xbb\xbf"
PACKED = r"\.(gz|bz2|zst|lz4|snappy|deflate|xz)$"

DIGEST_SCHEMA = "path STRING, sha256 STRING"


def file_manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """name, bytes and SHA-256 of the bytes of every file under ``path``, files without a byte included.

    A hash over a file is sequential. A file of up to ``resuming.PART_BYTES`` is one task, which streams past its lines (cut at LF alone)
    and holds a batch of them; a larger one takes a task per part, one after another, as soon as this is called. Packed files,
    which readers would unpack, are read as one value, of 2 GB at most."""
    source = _files(spark, "binaryFile", glob).load(path)
    scanned = source.select(_place(F.col("_metadata.file_path")), F.col("length").alias("bytes"))
    # Scans pass over files without a byte; the driver's own listing has them.
    names = spark.createDataFrame([(f,) for f in source.inputFiles()], "path STRING").select(_place(F.col("path")))
    listed = names.join(scanned, "path", "left").select("path", F.coalesce("bytes", F.lit(0).cast("bigint")).alias("bytes"))
    packed = F.col("_metadata.file_name").rlike(PACKED)
    values = source.where(packed).select(
        _place(F.col("_metadata.file_path")), F.sha2("content", 256).alias("sha256"))
    size, part = F.col("_metadata.file_size"), resuming.PART_BYTES
    found = source.where(~packed & (size > part)).select(_place(F.col("_metadata.file_path")), "length").collect() if resuming.can_resume() else []
    # A condition on the size keeps files out of the scan, not their lines alone.
    short = size <= part if found else F.lit(True)
    lines = _lines(_apart(spark, 1 << 60), path, glob).where(~packed & short).select(
        _place(F.col("_metadata.file_path")), size.alias("size"), F.col("value").cast("binary").alias("line"))
    digests = values.unionByName(lines.mapInArrow(_digests(), DIGEST_SCHEMA))
    if found:
        long = _lines(_apart(spark, part), path, glob).where(~packed & (size > part))
        digests = digests.unionByName(spark.createDataFrame(_in_parts(long, {r.path: r.length for r in found}), DIGEST_SCHEMA))
    empty = F.when(F.col("bytes") == 0, F.sha2(F.lit(b""), 256)).when(F.col("bytes") == 3, F.sha2(F.lit(BYTE_ORDER_MARK), 256))
    # Paths are URIs; a plus in them is a plus.
    name = F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B"))).alias("file")
    return listed.join(digests, "path", "left").select(name, "bytes", F.coalesce("sha256", empty).alias("sha256"))


def _place(uri: Column) -> Column:
    """A path that readers and listings spell alike: without an empty authority."""
    return F.regexp_replace(uri, "^([A-Za-z][A-Za-z0-9+.-]*):///+", "$1:/").alias("path")


def _files(spark: SparkSession, kind: str, glob: str) -> DataFrameReader:
    return spark.read.format(kind).option("pathGlobFilter", glob)


def _lines(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return _files(spark, "text", glob).option("lineSep", "\n").load(path)


def _apart(spark: SparkSession, part: int) -> SparkSession:
    """A session of its own whose scans give each part of ``part`` bytes of each file to one task."""
    apart = spark.newSession()
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        apart.conf.set(key, str(part))
    return apart


def _in_parts(lines: DataFrame, sizes: dict[str, int]) -> list[tuple[str, str]]:
    """(path, SHA-256) of long files whose parts are the partitions of ``lines``. The n-th parts of all files are read together; each takes
    up the hash where the part before has left it, so a task reads one part and only hashes' states come to the driver."""
    start = F.col("_metadata.file_block_start").alias("start")
    # Which partition is which part. A part in which no line begins has none.
    firsts = lines.select(_place(F.col("_metadata.file_path")), start, F.spark_partition_id().alias("number")).distinct().collect()
    parts: dict[str, list[tuple[int, int]]] = {}
    for path, begin, number in firsts:
        parts.setdefault(path, []).append((begin, number))
    states = {path: (begins[0][0], 0, None, None) for path, begins in parts.items() if not begins.sort()}
    read = lines.select(_place(F.col("_metadata.file_path")), start, F.col("value").cast("binary").alias("line"))
    for n in range(max(map(len, parts.values()))):
        due = {path: begins[n] for path, begins in parts.items() if n < len(begins)}
        task = _part({path: (begin, *states[path][1:]) for path, (begin, _) in due.items()})
        done = read.mapInArrow(task, "path STRING, start BIGINT, hashed BIGINT, plain BINARY, marked BINARY").rdd
        for row in lines.sparkSession.sparkContext.runJob(done, list, [number for _, number in due.values()]):
            states[row.path] = (row.start, row.hashed, bytes(row.plain), bytes(row.marked))
    digest = resuming.resuming()()
    out = []
    for path, (_, hashed, *contexts) in states.items():
        marked, ended = _left_out(path, sizes[path], hashed)
        out.append((path, digest(b"\n" * ended, contexts[marked]).hexdigest()))
    return out


def _left_out(path: str, size: int, hashed: int) -> tuple[int, int]:
    """What the lines leave out of a file: a byte order mark at its start, a line end at its end."""
    marked, ended = divmod(size - hashed, 3)
    if marked not in (0, 1) or ended not in (0, 1):
        raise ValueError(f"{path} changed while it was read")
    return marked, ended


def _part(states: dict):
    """A task over one part of each of the files of ``states`` (start, bytes so far, states of the hashes without and with a mark)."""
    make = resuming.resuming()

    def task(batches):
        import pyarrow as pa

        digest, path = None, None
        for batch in batches:
            paths, starts, lines = (c.to_pylist() for c in batch.columns)
            if not paths:
                continue
            block = b"\n".join(lines)
            if path is None:
                path, digest = paths[0], make()
                start, hashed, *contexts = states[path]
                hashes = [digest(b"" if c else mark, c) for c, mark in zip(contexts, (b"", b"\xef\xbb\xbf"))]
                begun = contexts[0] is not None
            if begun:
                block = b"\n" + block
            if set(paths) != {path} or set(starts) != {start}:
                raise ValueError(f"{path} changed while it was read")
            for one in hashes:
                one.update(block)
            hashed, begun = hashed + len(block), True
        if path is not None:
            columns = [path], [start], [hashed], [hashes[0].state()], [hashes[1].state()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["path", "start", "hashed", "plain", "marked"])

    return task


def _digests():
    """A task over whole files, line after line. Self-contained, as Python workers need not have this package."""
    def task(batches):
        import hashlib

        import pyarrow as pa

        mark = b"\xef\xbb\xbf"
        path, size, hashed, hashes = None, 0, 0, []

        def closed():
            # What the lines leave out: a line end at the end of the file, a byte order mark at its start.
            marked, ended = divmod(size - hashed, 3)
            if marked not in (0, 1) or ended not in (0, 1):
                raise ValueError(f"{path} changed while it was read")
            digest = hashes[marked]
            digest.update(b"\n" * ended)
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([digest.hexdigest()])], names=["path", "sha256"])

        for batch in batches:
            paths, sizes, lines = (c.to_pylist() for c in batch.columns)
            begin = 0
            while begin < len(paths):
                end = begin
                while end < len(paths) and paths[end] == paths[begin]:
                    end += 1
                block = b"\n".join(lines[begin:end])
                if paths[begin] != path:
                    if path is not None:
                        yield closed()
                    path, size, hashed, hashes = paths[begin], sizes[begin], 0, [hashlib.sha256(), hashlib.sha256(mark)]
                else:
                    block = b"\n" + block
                for digest in hashes:
                    digest.update(block)
                hashed += len(block)
                begin = end
        if path is not None:
            yield closed()

    return task


def coverage(raw_text: DataFrame) -> DataFrame:
    """rows, month_min, month_max and distinct months over well-formed month text."""
    return raw_text.agg(*_coverage())


def coverage_by_file(raw_text: DataFrame) -> DataFrame:
    """The same per source file, for records that carry a ``file`` column."""
    return raw_text.groupBy("file").agg(*_coverage())


def _coverage() -> list[Column]:
    month = F.when(F.col("month").rlike(MONTH_TEXT), F.col("month"))
    return [
        F.count(F.lit(1)).alias("rows"),
        F.min(month).alias("month_min"),
        F.max(month).alias("month_max"),
        F.count_distinct(month).alias("months"),
    ]


def with_receipt_time(manifest: DataFrame, previous: DataFrame, now: str) -> DataFrame:
    """Keep the earlier ``retrieved_at`` of a file whose bytes did not change, else ``now``."""
    kept = previous.select("file", "sha256", F.col("retrieved_at").alias("kept_at"))
    return (
        manifest.join(kept, ["file", "sha256"], "left")
        .withColumn("retrieved_at", F.coalesce("kept_at", F.lit(now)))
        .drop("kept_at")
    )


def receipt_day(retrieved_at, zone: str):
    """Local calendar day of a receipt timestamp text with offset (or UTC without)."""
    return F.to_date(F.from_utc_timestamp(F.to_timestamp(retrieved_at), zone))


def identity_problems(locked: DataFrame, found: DataFrame, what: str) -> DataFrame:
    """Files whose hash differs between two (file, sha256) sets, or that only one side has."""
    a = locked.select("file", F.col("sha256").alias("locked_sha"))
    b = found.select("file", F.col("sha256").alias("found_sha"))
    joined = a.join(b, "file", "full_outer").where(~F.col("locked_sha").eqNullSafe(F.col("found_sha")))
    return joined.select(F.lit(what).alias("side"), "file", "locked_sha", "found_sha")


def require_identity(locked: DataFrame, source: DataFrame, receipt: DataFrame) -> None:
    """Raise before any question runs unless lock, source files and stored receipt agree."""
    problems = identity_problems(locked, source, "source").unionByName(identity_problems(locked, receipt, "table"))
    bad = [f"{r.side}:{r.file}" for r in problems.limit(20).collect()]
    if bad or locked.isEmpty():
        raise ValueError(f"source identity drift: {bad or 'no locked files'}")
