"""Quality by weak supervision: rules vote good, vote bad or abstain, and no rule decides alone.

For every document the rules' votes are computed from its text. How often each rule is right about good and about
bad documents, and how many are good, is estimated from all documents by expectation-maximisation: the votes
form at most 3^12 patterns, their counts are one aggregate over the documents, and every step is one aggregate over
the pattern counts. A document's posterior probability of being good is the result. DataFrame functions only.

Defined results: text NULL, empty or without words has no words, all rules abstain and its posterior is the prior; a
table without votes leaves the accuracies as they start; repeated rows count as often as they occur; a long text is
measured whole; an empty table gives an empty table; the columns of a document travel in one struct, so their names do not
matter.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofledger.llm.common import let, settle

SPACE = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: A word without a letter or digit.
BARE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}\p{N}]++(?![^\x20\x09-\x0D])"
#: Words of a window that may repeat.
WINDOW = 8
#: Steps of the estimation at most, and the change at which it ends.
STEPS, STILL = 50, 1e-4
#: Where the estimation starts: the share of good documents, and how often a vote is right about a good and a bad
#: one. A rule knows one kind of junk and takes the other kinds for good.
PRIOR, RIGHT = 0.8, (0.97, 0.3)
#: A rule's accuracy is estimated with this many right and wrong votes added.
ADDED = 1.0
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeat_words(hashes: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more, from the words' hashes."""
    n = F.size(hashes) - WINDOW + 1
    windows = F.when(n > 1, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(hashes, i, F.lit(WINDOW)))))

    def covered(values: Column) -> Column:
        placed = F.sort_array(F.transform(values, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("sum"))
        twice = let(placed, lambda p: F.filter(p, lambda x, k: (
            F.get(p, k - 1)["h"].eqNullSafe(x["h"]) | F.get(p, k + 1)["h"].eqNullSafe(x["h"]))))
        at = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return F.aggregate(at, start, lambda s, i: F.struct(
            i.alias("last"), (s["sum"] + F.least(i - s["last"], F.lit(WINDOW))).alias("sum")))["sum"]

    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0).cast("long")))


def measures() -> Column:
    """A struct of the measures of the column ``text``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def left_out(pattern: str) -> Column:
        return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")

    from_words = let(let(words, lambda w: F.transform(w, lambda x: F.xxhash64(x))), lambda h: F.struct(
        F.size(h).cast("long").alias("n_words"), F.size(F.array_distinct(h)).cast("long").alias("n_distinct"),
        F.size(F.filter(h, lambda x, i: F.get(h, i - 1) == x)).cast("long").alias("n_echoes"),
        F.coalesce(repeat_words(h), F.lit(0).cast("long")).alias("n_repeat_words")))
    row = r"\|[^|]*\||\t[^\t]*\t"  # of a table
    from_lines = let(lines, lambda x: F.struct(
        F.size(F.filter(x, lambda line: line.rlike(row))).cast("long").alias("n_rows"),
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(x, lambda line: line.rlike(r"[.!?][\"')\x20\x09-\x0D]*$"))).cast("long").alias("n_ended")))
    return F.struct(
        from_words.alias("of_words"), from_lines.alias("of_lines"), F.length(F.regexp_replace(text, SPACES, "")).cast("long").alias("word_chars"),
        left_out(SYMBOLS).alias("n_symbols"), left_out(r"\p{Lu}").alias("n_capitals"), left_out(r"\p{L}").alias("n_letters"),
        left_out("!").alias("n_cries"), F.regexp_count(text, F.lit(BARE)).cast("long").alias("n_bare"))


def measured(docs: DataFrame, kept: list[str]) -> DataFrame:
    """The columns ``kept`` in one struct ``doc``, and the measures of every text."""
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"), measures().alias("found"))
    return found.select("doc", "found.of_words.*", "found.of_lines.*", *[f"found.{c}" for c in (
        "word_chars", "n_symbols", "n_capitals", "n_letters", "n_cries", "n_bare")])


def rules() -> dict[str, Column]:
    """The votes: 1 good, 0 bad, NULL abstains. The limits are fixed numbers a document is held against alone."""
    words, lines = F.col("n_words"), F.col("n_lines")

    def vote(bad: Column, good: Column, asked: Column) -> Column:
        return F.when(asked & bad, 0).when(asked & good, 1)

    def above(count: str, share: float) -> Column:  # of the words; no division, as there may be none
        return F.col(count) > share * words

    any_ = words > 0
    return {
        "symbols": vote(above("n_symbols", 0.1), ~above("n_symbols", 0.02), any_),
        "capitals": vote(F.col("n_capitals") > 0.4 * F.col("n_letters"), F.col("n_capitals") < 0.15 * F.col("n_letters"), F.col("n_letters") >= 20),
        "cries": vote(above("n_cries", 0.2), ~above("n_cries", 0.05), any_),
        "letters": vote(F.col("n_letters") < 0.75 * F.col("word_chars"), F.col("n_letters") > 0.85 * F.col("word_chars"), words >= 20),
        "bare_marks": vote(above("n_bare", 0.1), ~above("n_bare", 0.03), any_),
        "table_rows": vote(F.col("n_rows") > 0.4 * lines, F.col("n_rows") < 0.1 * lines, any_),
        "echoes": vote(above("n_echoes", 0.2), ~above("n_echoes", 0.08), words >= 20),
        "word_length": vote(~above("word_chars", 3) | above("word_chars", 7.5), above("word_chars", 4) & ~above("word_chars", 6.5), words >= 20),
        "variety": vote(~above("n_distinct", 0.3), above("n_distinct", 0.45), words.between(20, 5000)),
        "line_ends": vote(F.col("n_ended") < 0.3 * lines, F.col("n_ended") > 0.7 * lines, any_),
        "line_copies": vote(F.col("n_dup_lines") > 0.4 * lines, F.col("n_dup_lines") < 0.1 * lines, lines >= 3),
        "window_copies": vote(F.col("n_repeat_words") > 0.3 * words, F.col("n_repeat_words") < 0.1 * words, words >= 20),
    }


@dataclass(frozen=True)
class Beliefs:
    """Share of good documents, and for each rule how often its votes on good and on bad documents are right."""

    good: float
    right: dict[str, tuple[float, float]]

    def posterior(self) -> Column:
        odds = F.lit(log(self.good) - log(1 - self.good))
        for rule, (on_good, on_bad) in self.right.items():
            odds = odds + F.when(F.col(rule) == 1, log(on_good) - log(1 - on_bad)).when(
                F.col(rule) == 0, log(1 - on_good) - log(on_bad)).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def estimated(patterns: DataFrame, names: list[str]) -> Beliefs:
    """Beliefs from pattern counts (a column for each rule, and n)."""
    now = Beliefs(PRIOR, dict.fromkeys(names, RIGHT))
    for _ in range(STEPS):
        good = F.col("n") * now.posterior()
        bad = F.col("n") - good
        sums = [F.sum("n").alias("n"), F.sum(good).alias("good")]
        for name in names:
            for vote, word in ((0, "bad"), (1, "good")):
                sums += [F.sum(F.when(F.col(name) == vote, of)).alias(f"{name}_{word}_{about}")
                         for of, about in ((good, "good"), (bad, "bad"))]
        row = patterns.agg(*sums).first()
        if not row.n:
            return now

        def share(right: float | None, wrong: float | None) -> float:
            return ((right or 0) + ADDED) / ((right or 0) + (wrong or 0) + 2 * ADDED)

        new = Beliefs((row.good + ADDED) / (row.n + 2 * ADDED), {
            name: (share(row[f"{name}_good_good"], row[f"{name}_bad_good"]), share(row[f"{name}_bad_bad"], row[f"{name}_good_bad"]))
            for name in names})
        change = max(abs(new.good - now.good), *(abs(a - b) for k in names for a, b in zip(new.right[k], now.right[k], strict=True)))
        now = new
        if change < STILL:
            break
    return now


def judged(docs: DataFrame, kept: list[str]) -> DataFrame:
    """doc (the columns ``kept`` of ``docs``), the measures, the votes and the posterior of every document."""
    votes = rules()
    voted = settle(measured(docs, kept).select("*", *[v.alias(k) for k, v in votes.items()]), "votes")
    patterns = settle(voted.groupBy(*votes).agg(F.count("*").alias("n")), "patterns")
    return voted.withColumn("posterior", estimated(patterns, list(votes)).posterior())


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def with_verdict(docs: DataFrame, kept: list[str], least: float = 0.5) -> DataFrame:
    """``judged`` with base_failed and kept: the base rules hold and the posterior is ``least`` or more."""
    return judged(docs, kept).withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & (F.col("posterior") >= least))


def passed(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents of ``docs`` (text) that are kept, with their columns."""
    return with_verdict(docs, docs.columns, least).where("kept").select("doc.*")
