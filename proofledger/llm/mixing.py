"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same number of expected copies: the source's target over its size. The
documents of a source stand in a fixed order, by size and then by a keyed hash, so that every run of neighbours
is alike in size; their expected copies are summed up along it, one random offset is added, and a document is
taken once for every whole number its interval crosses. Whatever the sizes, the words taken then differ from
the target by no more than about the longest document.

Defined results: text NULL or without a word has size 0; source NULL is a source of its own, last in code-point
order; a source whose size is 0 has target 0 and its documents are not taken; an empty table gives an empty
table; repeated rows, and repeated doc_ids, are separate documents; other columns, whatever their names, are
carried along as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofledger.llm.common import WORD, positions, settle

#: Sources in code-point order weigh this much, repeating.
WEIGHTS = (3, 1, 2)
#: The mix is this share of all words.
SHARE = 1.5
#: No source and no document is taken more often than this.
MOST = 2.0


def weighed_sources(sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """One row per source: source, source_size, weight by its place in code-point order, NULL last."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = positions(totals, [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    return settle(placed.select("source", "source_size", weight.alias("weight")), "sources")


def water_level(sources: DataFrame, share: float, most: float) -> float | None:
    """Words per unit of weight once the excess of all sources that reach their limit has been shared anew.

    Each step is one aggregate over the sources; it ends when no further source is above its limit."""
    limit, level, stopped = F.col("source_size") * most, None, -1
    while True:
        above = limit < F.lit(level) * F.col("weight") if level is not None else F.lit(False)
        row = sources.agg(
            F.sum("source_size").alias("size"), F.sum(above.cast("int")).alias("stopped"),
            F.sum(F.when(above, limit).otherwise(0.0)).alias("given"),
            F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("weight")).first()
        if not row.size or row.stopped == stopped or not row.weight:
            return level
        stopped, level = row.stopped, (share * row.size - row.given) / row.weight


def uniform(seed: str, source: Column) -> Column:
    """A fixed number in [0, 1) for each seed and source, in steps of 2^-20 so that sums with it stay exact."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.concat(F.lit("="), source), F.lit("-"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 5), 16, 10).cast("double") / F.lit(float(1 << 20))


def allocate(docs: DataFrame, keep: list[str] | None = None, share: float = SHARE, most: float = MOST,
             weights: tuple[int, ...] = WEIGHTS, seed: str = "mix") -> DataFrame:
    """How often each document is taken: doc (a struct of the kept columns), size, source_size, target, copies, taken.

    ``docs`` needs doc_id, text and source."""
    kept = F.struct(*[F.col(f"`{c}`") for c in (keep or docs.columns)])
    sized = settle(docs.select(
        kept.alias("doc"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.col("doc_id").cast("string").cast("binary")).alias("key"), "doc_id",
        F.monotonically_increasing_id().alias("row")), "sizes")
    sources = weighed_sources(sized, weights)
    level = water_level(sources, share, most)
    limit = F.col("source_size") * most
    target = F.least(limit, F.lit(level).cast("double") * F.col("weight"))
    shares = sources.select(
        F.col("source").alias("own"), "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("key"), F.col("doc_id")]
    # Documents are put in order without their columns, which move once, to the number of their copies.
    placed = positions(sized.drop("doc"), order, "place", "source").join(shares, F.col("source").eqNullSafe(F.col("own")))
    expected = F.coalesce(F.least(F.lit(most), F.try_divide("target", "source_size")), F.lit(0.0))
    offset = uniform(seed, F.col("source"))
    crossed = F.floor(offset + expected * (F.col("place") + 1)) - F.floor(offset + expected * F.col("place"))
    copies = F.when(F.col("size") > 0, crossed).otherwise(F.lit(0)).cast("long")
    plan = placed.select("row", "size", "source_size", "target", copies.alias("copies"))
    return sized.select("row", "doc").join(plan, "row").select(
        "doc", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents with the columns of ``docs``, each as many times as it is taken."""
    times = F.when(F.col("copies") > 0, F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return allocate(docs, **options).select("doc", F.explode(times).alias("copy")).select("doc.*")
