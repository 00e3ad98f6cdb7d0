"""Token counts of documents without their ids.

A piece never reaches across the border before a blank, so a text's count is the sum over its pre-tokens (a blank
run and what follows it). Every distinct pre-token of the corpus is counted once. Each document's pre-token
frequencies then meet these counts in a join: the pre-tokens at the head of the corpus, a table of bounded size, are
broadcast and resolved where the text is read; the rest, each rare, goes through a shuffle join on the pre-token.

Defined results: text NULL or empty has 0 bytes and 0 tokens; a pre-token of any length is one value, never cut;
repeated rows and repeated doc_ids are counted each on their own; an empty table gives an empty table; other
columns, whatever their names, are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from proofledger.llm.common import batch_of, by_tasks, settle

#: At most this many pre-tokens are broadcast, and only those of at most so many bytes: a bound of 16 MB.
HEAD_ENTRIES, HEAD_BYTES = 1 << 18, 64
#: A task hands on its counts when it holds this many distinct pre-tokens.
HELD = 1 << 18
RUN = re.compile(r" +[^ ]*")
#: The model's sign for a blank.
BLANK = "▁"


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text, each without its first blank; the model itself puts one before the text."""
    if not text:
        return []
    if BLANK in text:
        text = text.replace(BLANK, " ")
    parts = text.split(" ")
    return [run[1:] for run in RUN.findall(" " + text)] if "" in parts else parts


def vocabulary(docs: DataFrame) -> DataFrame:
    """Distinct pre-tokens and their number in the corpus: word, n."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                held.update(pretokens(text.as_py()))
                if len(held) >= HELD:
                    yield batch_of(list(held.items()), schema)
                    held.clear()
        if held:
            yield batch_of(list(held.items()), schema)

    return by_tasks(docs.select("text").where("text <> ''"), tasks, schema).groupBy("word").agg(
        F.sum("n").alias("n"))


_models: dict[str, SentencePieceProcessor] = {}


def model(path: str) -> SentencePieceProcessor:
    """One per worker process; the file is part of a package that every machine has."""
    if path not in _models:
        _models[path] = SentencePieceProcessor(model_file=path)
    return _models[path]


def with_pieces(words: DataFrame, path: str) -> DataFrame:
    """word, n and the number of pieces of each pre-token."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("pieces", pa.int64())])

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            counts = [len(ids) if key else 1 for key, ids in zip(keys, pieces.encode(keys, num_threads=1), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], schema=schema)

    return by_tasks(words.select("word", "n"), tasks, schema)


def head(words: DataFrame, entries: int) -> dict[str, int]:
    """Pieces of the most frequent short pre-tokens, ``entries`` of them at most."""
    short = words.where(F.octet_length("word") <= HEAD_BYTES).withColumn("band", F.floor(F.log2("n") * 16))
    bands = short.groupBy("band").agg(F.count("*").alias("size")).collect()  # at most 16 * 63 rows
    least, total = None, 0
    for row in sorted(bands, key=lambda r: -r.band):
        total += row.size
        if total > entries:
            break
        least = row.band
    if least is None:
        return {}
    return {r.word: r.pieces for r in short.where(F.col("band") >= least).select("word", "pieces").toLocalIterator()}


def frequencies(docs: DataFrame, known: dict[str, int]) -> DataFrame:
    """Per document one row (row, doc_id, n_bytes, the tokens that ``known`` resolves), under a word that no text
    has; and per document and other pre-token one row (row, word, n)."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("resolved", pa.int64()),
                        ("word", pa.string()), ("n", pa.int64())])
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value.get
        held: list[tuple] = []
        for batch in batches:
            for row, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = text.as_py() or ""
                counts, resolved = Counter(pretokens(text)), 0
                for word, n in counts.items():
                    k = pieces(word)
                    if k is None:
                        held.append((row, None, None, None, word, n))
                    else:
                        resolved += k * n
                held.append((row, doc_id, len(text.encode()), resolved, f"{row} ", 0))
                if len(held) >= HELD:
                    yield batch_of(held, schema)
                    held = []
        if held:
            yield batch_of(held, schema)

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    return by_tasks(numbered, tasks, schema)


def token_counts(docs: DataFrame, path: str, head_entries: int = HEAD_ENTRIES) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every document of ``docs`` (doc_id, text)."""
    words = settle(with_pieces(vocabulary(docs), path), "pretokens")
    parts = frequencies(docs, head(words, head_entries))
    found = parts.join(words.select("word", "pieces"), "word", "left")
    return found.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"),
        F.sum(F.coalesce("resolved", F.lit(0)) + F.col("n") * F.coalesce("pieces", F.lit(0))).alias("n_tokens"),
    ).select("doc_id", "n_bytes", "n_tokens")
