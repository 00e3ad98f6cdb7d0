"""One hash over any number of ordered entries without gathering them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 4096  # entries that one fold hashes together
FOLDS = 5  # 4096 ** 5 entries


def fold(digests: DataFrame, keys: list[str]) -> DataFrame:
    """keys, sha256 from entries (keys, pos, sha256) with places 0, 1, 2, ... per key.

    Each of always FOLDS steps hashes the hashes of 4,096 neighbours, one per line."""
    for _ in range(FOLDS):
        entries = F.array_sort(F.collect_list(F.struct("pos", "sha256")))
        digests = digests.groupBy(*keys, F.floor(F.col("pos") / BLOCK).alias("block")).agg(entries.alias("entries")).select(
            *keys, F.col("block").alias("pos"),
            F.sha2(F.array_join(F.transform("entries", lambda e: e["sha256"]), "\n"), 256).alias("sha256"))
    return digests.drop("pos")
