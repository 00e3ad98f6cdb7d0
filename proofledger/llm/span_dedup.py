"""Substring dedup by sliding runs of sentences.

A text is cut into sentences: after an end sign, at line ends, before a capital letter, and after the word of the least
hash of every ``WINDOW`` words of a sentence in a row. A cut inside a sentence follows from fewer than ``WINDOW`` words on either
side, and none is further than ``WINDOW`` words from the next: any 51 words are cut alike from the ninth to the ninth last, and hold
a run of parts whatever surrounds them. Every run of consecutive sentences, at least two, that is as short as
``LEAST`` words allow is hashed, once from its first sentence on and once back from its last, so that a repeated
passage is covered up to its own borders. The runs of all documents meet by hash; sentences that lie in
a run that is not the first of its kind, by doc_id and place, are removed.

Defined results: text NULL or empty stays as it is; words are compared, white space between
them is not; a run that repeats within a document is removed there too; runs are compared by 64-bit hashes; rows equal in doc_id and text are
one document and stay alike; doc_id NULL comes first; a long text is cut whole; an empty table gives an empty
table; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofledger.llm.common import by_rows, by_tasks, settle

#: White space after an end sign, at a line end, or before a capital letter (Latin, Greek, Cyrillic).
BORDER = re.compile(r"(?:[.!?]\s|\n|\s(?=[A-ZÀ-ÖØ-ÞΑ-ΩА-Я]))\s*")
WORDS = re.compile(r"\s*\S+\s*")
#: Words of a run at least, and words of which one ends a part. A passage of 4 * WINDOW + LEAST - 2 words holds a run.
LEAST, WINDOW = 16, 9

#: Runs that a task holds before it hands them on.
HELD = 1 << 17
#: span: first sentence * 2^32 + sentence after the last.
SPAN = pa.schema([("run", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("span", pa.int64())])
CLEANED = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_removed", pa.int64())])


def sentences(text: str) -> list[str]:
    """The sentences of a text, each with the white space after it; joined they are the text."""
    found, at = [], 0
    for border in BORDER.finditer(text):
        if border.end() > at:
            found.append(text[at:border.end()])
            at = border.end()
    if at < len(text):
        found.append(text[at:])
    return [part for sentence in found for part in shortened(sentence)]


def shortened(sentence: str) -> list[str]:
    """A sentence in parts: cut after the last word of the least hash in each window, so that equal passages are cut alike."""
    words = WORDS.findall(sentence)
    if len(words) < WINDOW:
        return [sentence]
    hashes = [crc32(word.strip().encode()) for word in words]
    least, parts, start = -1, [], 0
    for last in range(WINDOW - 1, len(words)):
        first = last - WINDOW + 1
        if least < first:
            least = min(range(last, first - 1, -1), key=hashes.__getitem__)
        elif hashes[last] <= hashes[least]:
            least = last
        if least >= start:
            parts.append("".join(words[start:least + 1]))
            start = least + 1
    return [*parts, "".join(words[start:])] if start < len(words) else parts


def runs(found: list[str]) -> tuple[list[int], list[int]]:
    """Span and hash of every run."""
    words = [s.split() for s in found]
    joined = [" ".join(w).encode() for w in words]
    n = len(found)
    total = np.zeros(n + 1, np.int64)
    total[1:] = np.cumsum([len(w) for w in words])
    first = np.arange(n)
    stop = np.maximum(np.searchsorted(total, total[:n] + LEAST), first + 2)
    # The latest start from which the words up to this sentence's end are enough.
    start = np.minimum(np.searchsorted(total, total[1:] - LEAST, side="right") - 1, first - 1)
    spans = np.unique(np.concatenate([(first << 32 | stop)[stop <= n], (start << 32 | first + 1)[start >= 0]])).tolist()
    return spans, [xxhash.xxh3_64_intdigest(b" ".join(joined[span >> 32:span & 0xFFFFFFFF])) for span in spans]


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, a hash that tells texts with one doc_id apart, text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), "text")


def spans(docs: DataFrame) -> DataFrame:
    """The runs of every document: run (hash), doc_id, mark, span."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, hashes, owners, sizes = [], [], [], []

        def handed_on():
            doc_ids, marks = zip(*owners, strict=True)
            own = pa.array(np.repeat(np.arange(len(owners)), sizes))
            return pa.RecordBatch.from_arrays([
                pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array(doc_ids, pa.int64()).take(own),
                pa.array(marks, pa.int64()).take(own), pa.array(places, pa.int64())], schema=SPAN)

        for batch in batches:
            for doc_id, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found, values = runs(sentences(text.as_py() or ""))
                places += found
                hashes += values
                owners.append((doc_id, mark))
                sizes.append(len(found))
                if len(places) >= HELD:
                    yield handed_on()
                    places, hashes, owners, sizes = [], [], [], []
        if places:
            yield handed_on()

    return by_tasks(marked(docs), tasks, SPAN)


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, mark and the spans (runs) of each document that another place holds before."""
    every = settle(spans(docs), "spans")
    known = every.groupBy("run").agg(F.count("*").alias("n")).where("n > 1").select("run")
    shared = settle(every.join(known, "run"), "shared")
    place = F.struct("doc_id", "mark", "span")
    first = shared.groupBy("run").agg(F.min(place).alias("first"))
    later = shared.join(first, "run").where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "mark").agg(F.collect_set("span").alias("runs"))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, text without repeated runs of sentences, n_removed (sentences), of ``docs`` (doc_id, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        for batch in batches:
            for doc_id, text, covered in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                text, covered = text.as_py(), covered.as_py()
                if not covered:
                    yield len(text or ""), (doc_id, text, 0)
                    continue
                found = sentences(text)
                kept = np.ones(len(found), bool)
                for run in covered:
                    kept[run >> 32:run & 0xFFFFFFFF] = False
                text = "".join(s for s, keep in zip(found, kept.tolist(), strict=True) if keep)
                yield len(text), (doc_id, text, int((~kept).sum()))

    texts = marked(docs)
    found = repeats(docs).select(F.col("doc_id").alias("own"), F.col("mark").alias("own_mark"), "runs")
    same = F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("mark") == F.col("own_mark"))
    return by_rows(texts.join(found, same, "left").select("doc_id", "text", "runs"), rows, CLEANED)
