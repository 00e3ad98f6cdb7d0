"""Hard-negative mining with exact scores by the method of the Four Russians.

A vector's components are whole numbers, floor(scale * x). For every group of eight dimensions an anchor has a table
of 256 sums, one for each subset of its eight components. A candidate is held as bit planes: per plane and group one byte,
the bits of eight components. A plane's inner product with the anchor is the sum of one table entry per group; planes are added
from the sign downwards, doubling in between, which gives the whole exact score without a multiplication. Tables of
some hundred anchors lie side by side, so that one byte fetches the entries of all of them.

Anchors come in blocks of bounded size, each broadcast and met by every candidate where the candidates are read: one pass
finds the positives of the block, one the negatives, whose range of scores depends on the positive. A task keeps the
best few per anchor and hands them on; the lists of all tasks are merged per anchor. Nothing of the table passes
through the driver but the block of anchors with its bounded lists.

Defined results: a row without id, label or vector, or with a component that is NULL or not finite once scaled, takes no part;
shorter vectors count as filled up with zeros, as an empty one does; equal scores go to the smaller id; rows
with the anchor's id are the anchor, not its candidates; an anchor that is repeated repeats its results; a
score beyond 64 bits is cut to the largest or smallest such number when it is returned, after exact comparison within a task; fewer candidates than asked for
give all of them; an empty table gives an empty table; other columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofledger.llm.common import by_tasks, positions, settle

#: Anchors of a block, and of the tables that lie side by side.
BLOCK, SIDE = 1 << 15, 256
#: Candidates scored at once, once the best lists are filled; at first fewer, as all of them enter the lists.
ROWS, FIRST_ROWS = 2048, 64
EXACT_FLOAT, EXACT_INT = 2.0 ** 53, 1 << 62
FOUND = pa.schema([("at", pa.int64()), ("slot", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


def whole(vectors: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x), as Python's own numbers where a DOUBLE's steps are above one."""
    scaled = np.floor(vectors * scale)
    if np.abs(scaled).max(initial=0) < EXACT_FLOAT:
        return scaled.astype(np.int64)
    return np.vectorize(int, otypes=[object])(scaled)


def matrix(lists: pa.Array, width: int | None = None) -> np.ndarray:
    """Lists of numbers as rows, filled up with zeros, or cut, to ``width``."""
    lengths = pc.list_value_length(lists).to_numpy()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    own = int(lengths.max(initial=0))
    out = np.zeros((len(lists), max(own, width or 0)))
    if len(flat):
        out[np.repeat(np.arange(len(lists)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out if width is None else out[:, :width]


def filled(values: np.ndarray, more: int) -> np.ndarray:
    """``more`` dimensions of zeros at the end."""
    return np.concatenate([values, np.full((len(values), more), 0, values.dtype)], axis=1)


def grouped(values: np.ndarray) -> np.ndarray:
    """Dimensions filled up to whole groups of eight."""
    return filled(values, -values.shape[1] % 8)


class Planes:
    """Candidates as bit planes, the sign's first: a byte per plane and group of eight dimensions."""

    def __init__(self, values: np.ndarray):
        values = grouped(values)
        self.largest = max(abs(int(values.max(initial=0))), abs(int(values.min(initial=0))))
        bits = self.largest.bit_length() + 1
        self.bytes = np.stack([
            np.packbits(((values >> b) & 1).astype(np.uint8).reshape(len(values), values.shape[1] // 8, 8), axis=2)[:, :, 0].T
            for b in range(bits - 1, -1, -1)])


class Tables:
    """Subset sums of some anchors: by group and byte, the anchors side by side."""

    def __init__(self, values: np.ndarray, planes: Planes):
        values = grouped(values)
        bound = int(np.abs(values).sum(axis=1).max(initial=0)) * 4 * (planes.largest + 1)
        kind = np.int32 if bound < 1 << 31 else np.int64 if bound < EXACT_INT else object
        groups = values.shape[1] // 8
        self.sums = np.zeros((groups, 256, len(values)), kind)
        for g in range(groups):
            for bit in range(8):
                self.sums[g, 1 << bit:2 << bit] = self.sums[g, :1 << bit] + values[:, 8 * g + 7 - bit].astype(kind)

    def scores(self, planes: Planes, rows: np.ndarray) -> np.ndarray:
        """Inner products of candidates (rows) and anchors (columns)."""
        total = np.zeros((len(rows), self.sums.shape[2]), self.sums.dtype)
        for plane, packed in enumerate(planes.bytes):
            total += total
            for sums, byte in zip(self.sums, packed[:, rows], strict=True):
                if plane:
                    total += sums[byte]
                else:
                    total -= sums[byte]  # the sign's plane counts negative
        return total


class Best:
    """The best ``k`` candidates of every (anchor, slot): by score, then by the smaller id."""

    def __init__(self, anchors: int, slots: int, k: int):
        self.k, self.slots = k, slots
        self.scores = np.zeros((anchors * slots, k), object)
        self.ids = np.zeros((anchors * slots, k), np.int64)
        self.counts = np.zeros(anchors * slots, np.int64)
        # The k-th of a full list, so that few candidates are looked at.
        self.last_score = np.zeros(anchors * slots, np.int64)
        self.last_id = np.zeros(anchors * slots, np.int64)

    def enters(self, scores: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
        last = self.last_score[keys] if scores.dtype != object else np.array([self.scores[i, -1] for i in keys], object)
        full = self.counts[keys] == self.k
        ahead = (scores > last) | ((scores == last) & (ids[:, None] < self.last_id[keys]))
        return ahead.astype(bool) | ~full

    def take(self, keys: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Candidates for the lists ``keys``, each of which may come several times."""
        changed = np.unique(keys)
        held_key = np.repeat(changed, self.counts[changed])
        place = np.arange(len(held_key)) - np.repeat(np.cumsum(self.counts[changed]) - self.counts[changed], self.counts[changed])
        keys = np.concatenate([held_key, keys])
        scores = np.concatenate([self.scores[held_key, place], scores.astype(object)])
        ids = np.concatenate([self.ids[held_key, place], ids])
        if max((abs(int(s)) for s in (scores.max(), scores.min())), default=0) < EXACT_INT:
            order = np.lexsort((ids, -scores.astype(np.int64), keys))
        else:
            order = np.array(sorted(range(len(keys)), key=lambda i: (keys[i], -scores[i], ids[i])), np.int64)
        keys, scores, ids = keys[order], scores[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        place = np.arange(len(keys)) - np.repeat(first, np.diff(np.append(first, len(keys))))
        stay = place < self.k
        self.scores[keys[stay], place[stay]] = scores[stay]
        self.ids[keys[stay], place[stay]] = ids[stay]
        self.counts[changed] = np.minimum(self.k, np.diff(np.append(first, len(keys))))
        full = changed[self.counts[changed] == self.k]
        self.last_id[full] = self.ids[full, -1]
        self.last_score[full] = [cut(s) for s in self.scores[full, -1].tolist()]

    def rows(self, at: np.ndarray) -> pa.RecordBatch:
        key = np.repeat(np.arange(len(self.counts)), self.counts)
        place = np.arange(len(key)) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)
        scores = [cut(s) for s in self.scores[key, place].tolist()]
        return pa.RecordBatch.from_arrays([
            pa.array(at[key // self.slots], pa.int64()), pa.array(key % self.slots, pa.int32()), pa.array(self.ids[key, place], pa.int64()),
            pa.array(scores, pa.int64())], schema=FOUND)


def cut(score: int) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, int(score)))


@dataclass
class Anchors:
    """A block: place in the order of anchors, id, label, components, and in the second pass the range of scores
    of each slot (empty where low is above high)."""

    at: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    values: np.ndarray
    low: np.ndarray
    high: np.ndarray


def part_of(batch: pa.RecordBatch, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and components of a batch, in order of ids."""
    ids = batch.column("vec_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], batch.column("label").to_numpy()[order], whole(matrix(batch.column("embedding")), scale)[order]


def runs(n: int, first: int) -> Iterator[np.ndarray]:
    """Rows of a batch in growing runs."""
    begin, size = 0, first
    while begin < n:
        yield np.arange(begin, min(n, begin + size))
        begin, size = begin + size, min(ROWS, 2 * size)


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return filled(a, width - a.shape[1]), filled(b, width - b.shape[1])


def mined(rows: DataFrame, block: Broadcast, k: int, positive: bool, scale: float) -> DataFrame:
    """at, slot, vec_id, score: what each task found for the anchors of ``block``, ``k`` per slot at most."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: Anchors = block.value
        slots = anchors.low.shape[1]
        best, begun = Best(len(anchors.at), slots, k), False
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, labels, values = part_of(batch, scale)
            values, own = same_width(values, anchors.values)
            planes = Planes(values)
            # Anchors are in the order of their labels: for positives a label's anchors meet its candidates alone.
            for begin, end in sides(anchors.labels, positive):
                candidates = np.flatnonzero(labels == anchors.labels[begin]) if positive else np.arange(len(ids))
                if not len(candidates):
                    continue
                tables = Tables(own[begin:end], planes)
                for run in runs(len(candidates), ROWS if begun else FIRST_ROWS):
                    chosen = candidates[run]
                    scores = tables.scores(planes, chosen)
                    other = ids[chosen][:, None] != anchors.ids[begin:end]
                    if not positive:
                        other &= labels[chosen][:, None] != anchors.labels[begin:end]
                    for slot in range(slots):
                        keys = np.arange(begin, end) * slots + slot
                        fits = other & best.enters(scores, ids[chosen], keys)
                        if not positive:
                            fits &= (scores >= anchors.low[begin:end, slot]) & (scores <= anchors.high[begin:end, slot])
                        c, a = np.nonzero(fits)
                        if len(c):
                            best.take(keys[a], scores[c, a], ids[chosen][c])
            begun = True
        yield best.rows(anchors.at)

    return by_tasks(rows, task, FOUND)


def sides(labels: np.ndarray, by_label: bool) -> Iterator[tuple[int, int]]:
    edges = [0, *(np.flatnonzero(labels[1:] != labels[:-1]) + 1).tolist(), len(labels)] if by_label else [0, len(labels)]
    for begin, end in zip(edges, edges[1:]):
        for at in range(begin, end, SIDE):
            yield at, min(end, at + SIDE)


def merged(found: DataFrame, k: int, name: str) -> DataFrame:
    by = Window.partitionBy("at", "slot").orderBy(F.col("score").desc(), "vec_id")
    return settle(found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k), name)


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 3,
                   share: tuple[int, int] = (50, 95), scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score for each row of ``vectors`` (vec_id,
    label, embedding) for which ``is_anchor`` holds: its best ``positives`` rows of its ``label``, and for each of these the best
    ``negatives`` of other labels that score from ``share[0]`` to ``share[1]`` hundredths of it."""
    x = F.col("embedding").cast("array<double>")
    broken = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v * scale) == float("inf")))
    valid = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~broken).select(
        F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("embedding"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks")).where(F.col("label").isNotNull())
    rows = valid.select("vec_id", "label", "embedding")
    placed = positions(valid.where("asks").drop("asks"), [F.col("vec_id"), F.col("label")], "at")
    last = placed.agg(F.max("at")).first()[0]
    spark, results = vectors.sparkSession, []
    for begin in range(0, 0 if last is None else last + 1, BLOCK):
        # Bounded by BLOCK anchors, and below by ``positives`` rows for each of them.
        held = placed.where(F.col("at").between(begin, begin + BLOCK - 1)).orderBy("label", "at").toArrow()
        at = held["at"].to_numpy()
        values = whole(matrix(held["embedding"].combine_chunks()), scale)
        no_range = np.zeros((len(at), 1), np.int64)
        anchors = Anchors(at, held["vec_id"].to_numpy(), held["label"].to_numpy(), values, no_range, no_range)
        near = merged(mined(rows, spark.sparkContext.broadcast(anchors), positives, True, scale), positives, "positives")
        chosen = near.select("at", F.col("rank"), "score").toArrow()
        place = np.argsort(at)[np.searchsorted(np.sort(at), chosen["at"].to_numpy())]
        low, high = np.ones((len(at), positives), object), np.zeros((len(at), positives), object)
        for i, rank, score in zip(place, chosen["rank"].to_numpy(), chosen["score"].to_pylist(), strict=True):
            low[i, rank - 1], high[i, rank - 1] = -(-share[0] * score // 100), share[1] * score // 100
        ranges = Anchors(at, anchors.ids, anchors.labels, values, low.astype(np.int64), high.astype(np.int64))
        far = merged(mined(rows, spark.sparkContext.broadcast(ranges), negatives, False, scale), negatives, "negatives")
        pairs = near.select("at", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        results.append(far.join(pairs, ["at", "slot"]).join(placed.select("at", F.col("vec_id").alias("anchor_id")), "at"))
    if not results:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    whole_result = results[0]
    for more in results[1:]:
        whole_result = whole_result.unionByName(more)
    return whole_result.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
                               F.col("score").alias("negative_score"))
