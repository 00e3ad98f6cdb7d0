"""Exact interpolated median that never gathers a group in one task.

The built-in ``median`` keeps every distinct value of a group in one buffer, which a hot group cannot afford. Here a
DOUBLE is a BIGINT of the same order, its own bits, and the middle ranks are narrowed down by fixed ranges of these bits: the first pass
counts rows per group and highest 22 bits, the second per next 21 bits among the rows in the bins that hold the middle ranks, the third
per whole number. A pass has at most 2^22 counters a group, added up before the shuffle, whether the values of
a group are spread or all but equal, and however many rows one of them has; no pass ranks values.

Rows find the middle bins of their group in one of two ways, by what the question bounds, not by what the data hold:

* a known number of groups: the bins, two a group at most, are broadcast, and each pass scans the input;
* any number of groups: equal (group, value) pairs are counted first, which shuffles the distinct pairs once, and the pairs are
  joined with the bins by key. The rows of a bin that holds much of the table come straight from a shuffle, so AQE can split them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_GROUPS = 10_000  # the most that a question may bound for a broadcast: two bins a group, well under a megabyte
#: Bits that are still open after each pass.
OPEN_BITS = (42, 21, 0)

# The bits of the DOUBLE v as a BIGINT, negated for negative v. Declared non-NULL by coalesce, so that the join adds no filter.
# Quotients of a power of two are exact; the logarithm may miss the exponent by one, which the quotient tells.
ORDER_KEY = f"""coalesce(CASE
    WHEN v IS NULL THEN {-2**63 + 1}
    WHEN isnan(v) THEN {0x7FF8 << 48}
    WHEN v = double('inf') THEN {0x7FF << 52}
    WHEN v = double('-inf') THEN {-(0x7FF << 52)}
    WHEN v = 0 THEN 0
    ELSE CAST(sign(v) AS BIGINT) * CASE
      WHEN q >= 2 THEN (e + 1023) * {2**52} + CAST(q * {2**51} AS BIGINT)
      WHEN q < 1 AND e > -1022 THEN (e + 1021) * {2**52} + CAST(q * {2**53} AS BIGINT)
      ELSE (e + 1022) * {2**52} + CAST(q * {2**52} AS BIGINT) END
    END, 0)"""
_EXPONENT = "CASE WHEN v <> 0 AND abs(v) < double('inf') THEN least(greatest(CAST(floor(log2(abs(v))) AS BIGINT), -1022), 1023) ELSE 0 END"
_KEYED = f"SELECT g, v, {ORDER_KEY} AS k FROM (SELECT g, v, e, abs(v) / pow(2, e) AS q FROM (SELECT g, v, {_EXPONENT} AS e FROM {{values}}))"



def _passes(hint: str) -> str:
    """CTEs middle1 to middle3: per group the at most two bins that hold its middle ranks, rows ``before`` them, rows in all."""
    out = []
    for i, bits in enumerate(OPEN_BITS):
        if i == 0:
            group, rows = "g", f"SELECT g, shiftright(k, {bits}) AS p, 0L AS start, sum(n) AS m, max(v) AS v FROM keyed GROUP BY 1, 2"
            total = "sum(m) OVER (PARTITION BY g)"
        else:
            # The rows of the bins found before, whose own bins are narrower now.
            out.append(f"""rows{i} AS (
      SELECT {hint}r.g, r.v, r.k, r.n, b.before, b.total
      FROM {"keyed" if i == 1 else f"rows{i - 1}"} r JOIN middle{i} b ON r.g = b.g AND shiftright(r.k, {OPEN_BITS[i - 1]}) = b.p)""")
            group, total = f"g, shiftright(p, {OPEN_BITS[i - 1] - bits})", "total"
            rows = f"SELECT g, shiftright(k, {bits}) AS p, before AS start, total, sum(n) AS m, max(v) AS v FROM rows{i} GROUP BY 1, 2, 3, 4"
        out.append(f"""middle{i + 1} AS (
      SELECT g, p, v, m, upto, upto - m AS before, total FROM (
        SELECT g, p, v, m, start + sum(m) OVER (PARTITION BY {group} ORDER BY p ROWS UNBOUNDED PRECEDING) AS upto, {total} AS total
        FROM ({rows}))
      WHERE total = 0 OR (upto > (total - 1) div 2 AND upto - m <= total div 2))""")
    return ",\n    ".join(out)


def exact_median(df: DataFrame, keys: list[str], value: Column, name: str, groups_at_most: int | None = None) -> DataFrame:
    """Median of ``value`` per ``keys`` (the whole input for no keys), NULL values left out.

    Pass ``groups_at_most`` where the question bounds the groups (months of a period); leave it out for any number of groups,
    or an input that is costly to compute more than once. A group with only NULL values keeps a row with NULL, and so does an empty
    input without keys.
    """
    # A struct key compares equal field by field, NULLs included, and is never NULL itself.
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    values = df.select(group.alias("g"), value.cast("double").alias("v"))
    bound = groups_at_most if keys else 1
    few = bound is not None and bound <= BROADCAST_GROUPS
    keyed = (f"SELECT g, v, k, CASE WHEN v IS NULL THEN 0L ELSE 1L END AS n FROM ({_KEYED})" if few
             else f"SELECT g, v, k, count(v) AS n FROM ({_KEYED}) GROUP BY g, v, k")
    select = "".join(f"g.`{k}` AS `{k}`, " for k in keys)
    statement = f"""WITH keyed AS ({keyed}),
    {_passes("/*+ BROADCAST(b) */ " if few else "")}
    SELECT {select}
      max(v) FILTER (WHERE upto > (total - 1) div 2 AND upto - m <= (total - 1) div 2) * 0.5D
        + max(v) FILTER (WHERE upto > total div 2 AND upto - m <= total div 2) * 0.5D AS `{name}`
    FROM middle{len(OPEN_BITS)} {"GROUP BY g" if keys else ""}"""
    return df.sparkSession.sql(statement, values=values)


def period_medians(df: DataFrame, periods: dict[str, Column], value: Column) -> DataFrame:
    """One row with one median per named period (a predicate each), from scans of all periods together."""
    label = F.coalesce(*[F.when(cond, F.lit(name)) for name, cond in periods.items()])
    by_period = exact_median(df.select(label.alias("period"), value.alias("v")).where("period IS NOT NULL"),
                             ["period"], F.col("v"), "med", groups_at_most=len(periods))
    return by_period.agg(*[F.max(F.when(F.col("period") == p, F.col("med"))).alias(p) for p in periods])
