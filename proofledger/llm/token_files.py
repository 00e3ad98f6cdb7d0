"""Token ids in files of blocks, coded by one canonical length-limited Huffman code.

1. Documents are dealt by ranges of doc_id and tokenised in that order into blocks of whole documents (ids in plain
   binary form), while the ids are counted.
2. The global counts, one per id of the vocabulary, give the code lengths (package-merge, at most ``LIMIT`` bits).
3. Every block is coded on its own, in parallel, and written: bits, and the bit offset of every ``STEP``-th id.
4. The reader decodes a block by table: all checkpoints of its blocks advance together, one id each per step.

A file is Parquet, uncompressed: Spark's writers commit it, retry it and reach every store; a row is a block.
``bucket`` and ``block`` order the blocks, ``at`` is the number of ids before a block in its bucket. The codebook
lies beside the blocks.

Defined results: text NULL or empty is a document of the end id alone; documents with equal doc_id stand in the
order of a hash of their texts; doc_id NULL comes first; a long text is one document of one block, however long; an empty
table gives files without blocks; other columns are left out.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.window import Window
from tokenizers import Tokenizer, pre_tokenizers

from proofledger.llm.common import by_rows, portions
from proofledger.session import work_path

#: Longest code in bits.
LIMIT = 18
#: A block is closed once it holds this many ids.
BLOCK_IDS = 1 << 16
#: Ids between two checkpoints.
STEP = 256
MEMO_ENTRIES, MEMO_LONGEST, BATCH_CHARS = 1 << 20, 256, 1 << 21
#: Chunks that the library gets in one call.
JOINED = 1000

#: Blocks of ids in plain form (kind 0), and counts of ids (kind 1).
PLAIN = pa.schema([
    ("kind", pa.int32()), ("bucket", pa.int64()), ("block", pa.int64()), ("at", pa.int64()), ("n_ids", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("ids", pa.binary()), ("id", pa.int64()), ("n", pa.int64())])
#: Blocks as they lie in the files.
CODED = pa.schema([
    ("bucket", pa.int64()), ("block", pa.int64()), ("at", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("sizes", pa.list_(pa.int64())), ("checkpoints", pa.list_(pa.int64())), ("bits", pa.binary())])
DOCUMENT = pa.schema([("bucket", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("ids", pa.binary())])


#: A chunk of which lower-casing and cutting are plain: a word of Latin letters, then marks that end it.
PLAIN_CHUNK = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")
#: Chunks that must come out alike both ways before the plain way is taken.
PROBES = ["a", "The", "Été", "straße.", "ÑANDÚ,", "élève?!", "word...", "ÿ", "Ångström;", "internationalisation"]


class Chunked:
    """The library's ids of texts. White space never lies inside a token, so chunks between blanks are encoded
    once and kept in a bounded memo. Plain chunks go to the library's model at once, without its general steps before it."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special and not t.normalized]
        #: A special string splits a text before anything else is done to it.
        self.mark = special[0] if special else None
        self.mark_id = self.tokenizer.token_to_id(self.mark) if special else -1
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.memo: dict[str, bytes] = {}
        self.model = self.tokenizer.model
        self.packed = [np.array(i, self.type).tobytes() for i in range(self.tokenizer.get_vocab_size())]
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {ord(c): as_bytes.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xC0, 0x100))}
        self.ends: dict[str, bytes] = {"": b""}
        self.words = True
        self.words = all(self.word(c) == ids for c, ids in zip(PROBES, self.plain(PROBES), strict=True))

    def word(self, chunk: str) -> bytes | None:
        """Ids of a plain chunk, None of any other."""
        found = PLAIN_CHUNK.fullmatch(chunk) if self.words else None
        if found is None:
            return None
        word, end = found.groups()
        if end not in self.ends:
            if len(self.ends) > MEMO_LONGEST:
                return None
            self.ends[end] = self.plain([end])[0]
        word = word.lower()
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(word if word.isascii() else word.translate(self.letters))]) + self.ends[end]

    def plain(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.type).tobytes()
                for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def joined(self, chunks: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(chunks)], add_special_tokens=False)[0].ids, self.type)
        cuts = (np.flatnonzero(ids == self.mark_id) * self.type.itemsize).tolist()
        packed, width = ids.tobytes(), self.type.itemsize
        return [packed[a:b] for a, b in zip([0, *[c + width for c in cuts]], [*cuts, len(packed)], strict=True)]

    def learn(self, missing: list[str]) -> list[str]:
        """Put the ids of chunks in the memo; returns those too long to stay there."""
        fresh = {c: ids for c in missing if (ids := self.word(c)) is not None}
        missing = [c for c in missing if c not in fresh]
        alone = [c for c in missing if self.mark is None or self.mark in c]
        others = [c for c in missing if self.mark is not None and self.mark not in c]
        if alone:
            fresh.update(zip(alone, self.plain(alone), strict=True))
        for k in range(0, len(others), JOINED):
            part = others[k:k + JOINED]
            fresh.update(zip(part, self.joined(part), strict=True))
        self.memo.update(fresh)
        return [c for c in fresh if len(c) > MEMO_LONGEST]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text. The memo holds all their chunks meanwhile."""
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.clear()
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        missing = set().union(*cut).difference(self.memo)
        long = self.learn(list(missing)) if missing else []
        ids = [b"".join(map(self.memo.__getitem__, chunks)) for chunks in cut]
        for chunk in long:
            del self.memo[chunk]
        return ids


_chunked: dict[str, Chunked] = {}


def chunked(path: str) -> Chunked:
    """One per worker process and vocabulary; the file is part of a package that every machine has."""
    if path not in _chunked:
        _chunked[path] = Chunked(path)
    return _chunked[path]


# ---- the code ----


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Length of each id's code, 0 where it never occurs: least total bits with no code longer than ``limit``."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("too many ids for this code length")
    leaves = np.sort(counts[used])
    by_count = used[np.argsort(counts[used], kind="stable")]
    rows, merged = [], leaves
    for _ in range(limit):
        pairs = merged[:len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1) if rows else np.zeros(0, leaves.dtype)
        both = np.concatenate([leaves, pairs])
        order = np.argsort(both, kind="stable")
        rows.append(order < len(leaves))
        merged = both[order]
    take = 2 * len(leaves) - 2
    for is_leaf in reversed(rows):
        n_leaves = int(is_leaf[:take].sum())
        lengths[by_count[:n_leaves]] += 1
        take = 2 * (take - n_leaves)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id, each the one before plus one."""
    codes = np.zeros(len(lengths), np.uint64)
    code = at = 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    sizes = np.bincount(lengths, minlength=LIMIT + 1)
    for length in range(1, len(sizes)):
        n = int(sizes[length])
        codes[order[at:at + n]] = np.arange(code, code + n)
        at, code = at + n, code + n << 1
    return codes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of ``ids``, first bit highest, and the bit offset of every STEP-th id."""
    size = lengths[ids]
    stop = np.cumsum(size)
    start = stop - size
    words = np.zeros((int(stop[-1]) >> 6) + 2 if len(ids) else 1, np.uint64)
    if len(ids):
        word, room = start >> 6, 64 - (start & 63) - size  # room < 0: that many bits belong to the next word
        code = codes[ids]
        here = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] = np.bitwise_or.reduceat(here, first)
        over = np.flatnonzero(room < 0)
        words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
    n_bytes = (int(stop[-1]) + 7 >> 3) if len(ids) else 0
    return words.astype(">u8").tobytes()[:n_bytes], start[::STEP]


class Table:
    """For every LIMIT-bit window: the id it starts with and the length of its code."""

    def __init__(self, lengths: np.ndarray):
        codes = canonical(lengths).astype(np.int64)
        self.ids, self.sizes = np.zeros(1 << LIMIT, np.uint32), np.zeros(1 << LIMIT, np.int64)
        used = np.flatnonzero(lengths)
        used = used[np.argsort(codes[used] << (LIMIT - lengths[used]))]
        spans = 1 << (LIMIT - lengths[used])
        self.ids[:spans.sum()] = np.repeat(used, spans)
        self.sizes[:spans.sum()] = np.repeat(lengths[used], spans)

    def unpack(self, blocks: list[tuple[bytes, np.ndarray, int]]) -> list[np.ndarray]:
        """Ids of blocks given as (bits, checkpoints, number of ids); all checkpoints advance side by side."""
        whole = np.frombuffer(b"".join(bits + b"\0\0\0\0" for bits, _, _ in blocks) + b"\0\0\0\0", np.uint8).astype(np.uint32)
        window = whole[:-3] << 24 | whole[1:-2] << 16 | whole[2:-1] << 8 | whole[3:]
        bases = np.cumsum([0, *[len(bits) + 4 for bits, _, _ in blocks]])
        at = np.concatenate([base * 8 + np.asarray(marks, np.int64) for base, (_, marks, _) in zip(bases, blocks, strict=False)])
        out = np.empty((STEP, len(at)), np.uint32)
        last = int(bases[-1]) * 8 + 7
        for k in range(STEP):
            np.minimum(at, last, out=at)  # a lane that has reached the end of its block reads on without effect
            found = (window[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(32 - LIMIT)
            out[k] = self.ids[found]
            at += self.sizes[found]
        lanes = np.cumsum([0, *[len(marks) for _, marks, _ in blocks]])
        flat = out.T
        return [flat[a:b].reshape(-1)[:n] for a, b, (_, _, n) in zip(lanes, lanes[1:], blocks, strict=False)]


# ---- the files ----


def plain_blocks(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Blocks of ids in order of doc_id (kind 0), and the counts of ids of each task (kind 1)."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        from pyspark import TaskContext

        source = chunked(path)
        end, width = np.array([end_id], source.type).tobytes(), source.type.itemsize
        bucket, block, at = TaskContext.get().partitionId(), 0, 0
        counts = np.zeros(max(source.tokenizer.get_vocab_size(), end_id + 1), np.int64)
        doc_ids, held, n = [], [], 0

        def closed():
            packed = b"".join(held)
            counts[:] += np.bincount(np.frombuffer(packed, source.type), minlength=len(counts))
            return len(packed), (0, bucket, block, at, n, doc_ids, [len(h) // width for h in held], packed, None, None)

        for batch in batches:
            for keys, texts in portions(batch, BATCH_CHARS):
                for doc_id, ids in zip(keys, source.encode(texts), strict=True):
                    doc_ids.append(doc_id)
                    held.append(ids + end)
                    n += len(held[-1]) // width
                    if n >= BLOCK_IDS:
                        yield closed()
                        block, at, doc_ids, held, n = block + 1, at + n, [], [], 0
        if held:
            yield closed()
        for i in np.flatnonzero(counts).tolist():
            yield 16, (1, None, None, None, None, None, None, None, i, int(counts[i]))

    # Ranges are found from a sample of the keys, which the driver gathers, so texts are no keys.
    order = [F.col("doc_id").asc_nulls_first(), F.col("mark")]
    texts = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("mark"))
    return by_rows(texts.repartitionByRange(*order).sortWithinPartitions(*order, "text"), rows, PLAIN)


def write(docs: DataFrame, out: str, tokenizer: str, end_id: int) -> None:
    """Tokenise ``docs`` (doc_id, text), end each document with ``end_id``, and write blocks and codebook below ``out``."""
    spark = docs.sparkSession
    staged = work_path(spark, "llm", f"ids-{uuid.uuid4().hex[:12]}")
    plain_blocks(docs, tokenizer, end_id).write.partitionBy("kind").option("compression", "zstd").parquet(staged)
    plain = spark.read.schema(from_arrow_schema(PLAIN)).parquet(staged)
    # One row per id of the vocabulary, whatever the number of documents.
    totals = plain.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.id for r in totals), default=0) + 1, np.int64)
    for r in totals:
        counts[r.id] = r.n
    lengths = code_lengths(counts, LIMIT)
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id long, length long").coalesce(1).write.parquet(f"{out}/codebook")
    wide = np.dtype("<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else "<u4")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        codes = canonical(lengths)
        for batch in batches:
            for row in batch.to_pylist():
                bits, marks = pack(np.frombuffer(row.pop("ids"), wide), codes, lengths)
                yield len(bits), (*row.values(), marks.tolist(), bits)

    blocks = plain.where("kind = 0").select("bucket", "block", "at", "n_ids", "doc_ids", "sizes", "ids")
    by_rows(blocks, rows, CODED).write.option("compression", "none").parquet(f"{out}/blocks")


def read(spark: SparkSession, out: str) -> DataFrame:
    """The documents of the files: doc_id, start (ids before it), ids (packed unsigned 32-bit little-endian)."""
    blocks = spark.read.schema(from_arrow_schema(CODED)).parquet(f"{out}/blocks")
    book = spark.read.schema("id long, length long").parquet(f"{out}/codebook").collect()  # at most the vocabulary
    lengths = np.zeros(max((r.id for r in book), default=0) + 1, np.int64)
    for r in book:
        lengths[r.id] = r.length

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        coded = Table(lengths)

        def decoded(held):
            for row, ids in zip(held, coded.unpack([(r["bits"], r["checkpoints"], r["n_ids"]) for r in held]), strict=True):
                packed, at = ids.astype("<u4").tobytes(), 0
                for doc_id, size in zip(row["doc_ids"], row["sizes"], strict=True):
                    yield 4 * size, (row["bucket"], doc_id, row["at"] + at, packed[4 * at:4 * (at + size)])
                    at += size

        for batch in batches:
            held, n = [], 0
            for k in range(batch.num_rows):
                held.append(batch.slice(k, 1).to_pylist()[0])
                n += held[-1]["n_ids"]
                if n >= 16 * BLOCK_IDS:
                    yield from decoded(held)
                    held, n = [], 0
            if held:
                yield from decoded(held)

    documents = by_rows(blocks.select("bucket", "at", "n_ids", "doc_ids", "sizes", "checkpoints", "bits"), rows, DOCUMENT)
    sizes = blocks.groupBy("bucket").agg(F.sum("n_ids").alias("n"))  # a row for each range of doc_id
    before = Window.orderBy("own").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("bucket").alias("own"), "n").select("own", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    # The buckets are the partitions that the writer dealt: some bytes each.
    return documents.join(F.broadcast(starts), F.col("bucket") == F.col("own")).select("doc_id", (F.col("at") + F.col("shift")).alias("start"), "ids")


