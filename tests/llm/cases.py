"""Small documents with every awkward case, and frames of them."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as extra columns of the input.
CLASHES = ["size", "target", "copies", "taken", "n", "node", "label", "mark", "word", "row", "score", "at", "place", "own", "runs",
           "ids", "kept", "posterior", "symbols", "key", "held_out", "doc", "found", "_at", "_part", "_row", "__near_mark", "__names"]


def prose(rng: random.Random, words: int) -> str:
    syllables = ["the", "an", "ing", "tion", "er", "on", "at", "of", "ble", "st", "wh", "ea", "or", "ß", "ñ"]
    out = []
    for k in range(words):
        word = "".join(rng.choice(syllables) for _ in range(rng.choice([1, 1, 2, 3])))
        word = word.capitalize() if k == 0 or out[-1][-1:] == "." else word
        out.append(word + ("." if rng.random() < 0.1 else ""))
    return " ".join(out)


def documents() -> list[tuple]:
    rng = random.Random(7)
    base = prose(rng, 300)
    passage = prose(rng, 70) + "."
    near = base.split()
    rows = [base, " ".join(near[:150] + ["changed"] + near[151:]), base, base, passage, prose(rng, 60) + " " + passage + " " + prose(rng, 30),
            None, "", " \t\n", "one", "two words", "three little words", "x" * 60_000, prose(rng, 9_000), "na " * 500,
            "Mail a.person@mail.example.com or +1 (212) 555-0199.\nCard 4111 1111 1111 1111, 4111111111111112, 10.20.30.40, 2024-02-29.",
            "Mail a.person@mail.example.com again, 999.1.1.1 and <|endoftext|> and <s>.\x00▁é́　漢字😀",
            "| a | b |\n| c | d |\n| e | f |", "WHAT!! IS!! THIS!! " * 10, "line\nline\nline\n" + prose(rng, 40)]
    rows += [prose(rng, rng.randrange(20, 200)) for _ in range(25)]
    out = [(i, text, "en", f"s{i % 5}" if i % 11 else None, len(text or "")) for i, text in enumerate(rows)]
    out += [out[0], out[5], (None, "no id here " * 9, None, None, None), (3, "the same id with another text, " * 8, "en", "s1", 1)]
    return out


def frame(spark, rows=None, clashes=False, parts=3):
    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(parts)
    return df.select("*", *[F.lit(f"{c}!").alias(c) for c in CLASHES]) if clashes else df


def unique(rows=None) -> list[tuple]:
    """One document per doc_id, with an id."""
    seen: dict[int, tuple] = {}
    for row in documents() if rows is None else rows:
        if row[0] is not None:
            seen.setdefault(row[0], row)
    return list(seen.values())


def nodes(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
