"""Session defaults and the shared working folder."""

from __future__ import annotations

import tempfile
import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local_dirs: dict[str, str] = {}
_cleaning: dict[str, tuple[int, str | None]] = {}
_lock = threading.Lock()


def build_session(app_name: str = "proofledger", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans rely on; a cluster passes its own sizes in ``conf``."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # Result text is long generated code; above this size the JVM would only interpret it.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local-mode session without that setting gets a fresh temporary folder.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _local_dirs[app]


def work_path(spark: SparkSession, *parts: str) -> str:
    """A path below the shared folder that belongs to this application only."""
    return "/".join([shared_dir(spark), spark.sparkContext.applicationId, *parts])


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query run herein go when it ends, not when the driver next collects its garbage: for queries that
    write what they find, which nothing computes again."""
    key = spark.conf.get("spark.app.id")
    with _lock:
        depth, before = _cleaning.get(key) or (0, spark.conf.get(CLEANUP_KEY, None))
        _cleaning[key] = depth + 1, before
        spark.conf.set(CLEANUP_KEY, "true")
    try:
        yield
    finally:
        with _lock:
            depth, before = _cleaning.pop(key)
            if depth > 1:
                _cleaning[key] = depth - 1, before
            elif before is None:
                spark.conf.unset(CLEANUP_KEY)
            else:
                spark.conf.set(CLEANUP_KEY, before)
