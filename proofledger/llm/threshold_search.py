"""Exact top-k search by inner product with the threshold algorithm.

The vectors are cut into shards of bounded size. A shard holds, for every dimension, the list of its vectors sorted
by that component. A query reads all lists of its non-zero components in step, each from the end that raises its
score, a few places at a time; every vector met for the first time is scored in full. No vector that has not been met
can score above the sum of the query's components times the list values just read, so the search of a shard ends
once the k-th best score is above that sum; a tie reads on, as a smaller id might follow. The shards' lists of k are
merged per query. Shards are parallel work; query blocks stream past them, so neither side has to fit a task.

Components are integers, floor(scale * x). Scores are exact: in floating point while every possible sum is below
2^53, in whole numbers of any size beyond; a score beyond 64 bits is cut to the largest or smallest such number.

Defined results: a vector that is NULL, or holds NULL or a component that is not finite, or has no id, takes no
part; shorter vectors count as filled up with zeros; a query is not its own result, but another row with its id may
be; equal scores go to the smaller id; a table with fewer candidates gives all of them; an empty table gives an empty
table; other columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofledger.llm.common import by_rows, positions

#: Vectors of a shard, and shards whose queries form a block.
SHARD, BLOCK = 1024, 32
#: Places that a search reads in each list at first; each time it reads twice as many.
PLACES = 8
EXACT = 2.0 ** 53
FOUND = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def whole_numbers(vectors: list[list[float]], scale: float, width: int) -> np.ndarray:
    """Rows of floor(scale * x), filled up with zeros to ``width``."""
    out = np.zeros((len(vectors), width))
    for row, vector in zip(out, vectors, strict=True):
        row[:len(vector)] = vector
    return np.floor(out * scale)


class Shard:
    """Vectors in order of their ids, and their sorted lists."""

    def __init__(self, at: list[int], ids: list[int], vectors: list[list[float]], scale: float):
        self.place = {a: i for i, a in enumerate(at)}
        self.ids = ids
        self.width = max(map(len, vectors))
        self.values = whole_numbers(vectors, scale, self.width)
        self.largest = np.abs(self.values).max(initial=0)
        up = np.argsort(self.values, axis=0, kind="stable").T
        sorted_up = np.take_along_axis(self.values.T, up, axis=1)
        #: By direction (0 rising, 1 falling), then dimension: rows of the list, and their components.
        self.lists = np.stack([up, up[:, ::-1]])
        self.heights = np.stack([sorted_up, sorted_up[:, ::-1]])

    def top(self, query: np.ndarray, k: int, own: int | None) -> list[tuple[int, int]]:
        """The k best (id, score), best first."""
        values, heights = self.values, self.heights
        if self.largest * np.abs(query).max(initial=0) * self.width >= EXACT:
            values, heights, query = (np.vectorize(int, otypes=[object])(x) for x in (values, heights, query))
        n, used = len(self.ids), np.flatnonzero(query)
        seen = np.zeros(n, bool)
        if own is not None:
            seen[own] = True
        falling = (query[used] > 0).astype(int)
        weights = query[used]
        best, scores = np.zeros(0, int), np.zeros(0, values.dtype)
        depth, step = 0, PLACES
        while depth < n:
            stop = min(n, depth + step)
            met = np.zeros(n, bool)
            met[self.lists[falling, used, depth:stop] if len(used) else slice(depth, stop)] = True
            new = np.flatnonzero(met & ~seen)
            seen |= met
            best, scores = np.concatenate([best, new]), np.concatenate([scores, values[new] @ query])
            order = np.lexsort((best, -scores))[:k] if scores.dtype != object else np.array(
                sorted(range(len(best)), key=lambda i: (-scores[i], best[i]))[:k], int)
            best, scores = best[order], scores[order]
            if len(best) == k and len(used) and scores[-1] > (weights * heights[falling, used, stop - 1]).sum():
                break
            if len(best) == k and not len(used):
                break
            depth, step = stop, 2 * step
        return [(self.ids[i], max(-(1 << 63), min((1 << 63) - 1, int(s)))) for i, s in zip(best.tolist(), scores.tolist(), strict=True)]


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the ``k`` best vectors for each row of ``vectors`` (vec_id, embedding)
    for which ``is_query`` holds."""
    x = F.col("embedding").cast("array<double>")
    broken = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    valid = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~broken).select(
        F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    placed = positions(valid, [F.col("vec_id")], "at")
    row = F.struct("at", "vec_id", "embedding")
    members = placed.select(F.floor(F.col("at") / SHARD).alias("shard"), F.lit(-1).cast("long").alias("block"), F.array(row).alias("rows"))
    last = members.agg(F.max("shard")).first()[0]
    shards = F.sequence(F.lit(0).cast("long"), F.lit(last if last is not None else 0).cast("long"))
    # A block holds the queries of BLOCK shards at most, and goes to every shard.
    asked = placed.where("asks").groupBy(F.floor(F.col("at") / (SHARD * BLOCK)).alias("block")).agg(F.collect_list(row).alias("rows")).select(
        F.explode(shards).alias("shard"), "block", "rows")
    dealt = members.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "block")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        number, held, shard = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                key, block, content = (c[i].as_py() for c in batch.columns)
                if key != number:
                    number, held, shard = key, [], None
                if block < 0:
                    held += content
                    continue
                if shard is None:
                    held.sort(key=lambda r: r["at"])
                    shard = Shard([r["at"] for r in held], [r["vec_id"] for r in held], [r["embedding"] for r in held], scale)
                for q in content:
                    width = max(shard.width, len(q["embedding"]))
                    query = whole_numbers([q["embedding"]], scale, width)[0][:shard.width]
                    for vec_id, score in shard.top(query, k, shard.place.get(q["at"])):
                        yield 32, (q["at"], q["vec_id"], vec_id, score)

    found = by_rows(dealt, rows, FOUND)
    by = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
