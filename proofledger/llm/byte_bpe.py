"""Byte-level BPE encoding and decoding with rank files.

Merging keeps a queue of ranks: each rank has a bucket of positions in a linked list of pieces, and a bitmap of
64-bit words in levels says which buckets hold something. Finding the lowest rank takes one find-first-set per
level, so a pre-token of any length costs a few steps per merge; entries of pieces that have changed since are
stale and skipped. All pre-tokens of a batch that are not known yet stand in one linked list with borders between
them, so that a bucket serves all of them. Pieces of text that recur take their ids from a bounded memo.

Ids travel packed, as unsigned 32-bit little-endian integers in one binary value per document.

Defined results: text NULL or empty has no ids and decodes to no bytes; repeated rows are encoded each on their
own; long texts are one value each, never cut; an empty table gives an empty table; a NULL doc_id stays NULL; other
columns, whatever their names, are left out.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofledger.llm.common import by_rows, portions

#: White space and the characters after it up to the next white space: no pre-token crosses such a border.
CHUNK = regex.compile(r"\p{White_Space}*\P{White_Space}+|\p{White_Space}+")
#: White space other than single blanks and line ends.
OTHER_SPACE = regex.compile(r"[^\P{White_Space} \n]")
#: The memo of a task holds about this many bytes at most, so many of them for the objects of each entry. When its young half
#: is full that becomes the old one, and what was not met again since the last time goes.
MEMO_BYTES, ENTRY_BYTES = 144 << 20, 180
#: And never more entries than that.
MEMO_ENTRIES = MEMO_BYTES // ENTRY_BYTES
#: Longer pieces are not kept in the memo.
MEMO_LONGEST = 256
#: A task encodes texts of about this many characters at a time, and merges unknown pre-tokens of about this many bytes.
BATCH_CHARS, MERGED_BYTES = 1 << 20, 100_000
BITS = 6
#: Shift of the left id in the key of a pair of ids.
PAIR = 20


class RankQueue:
    """Buckets of positions by rank, and which of them hold something."""

    def __init__(self, ranks: int):
        self.levels: list[list[int]] = []
        words = ranks
        while not self.levels or words > 1:
            words = (words + 63) >> BITS
            self.levels.append([0] * words)
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, positions: list[int]) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket += positions
            return
        self.buckets[rank] = positions
        for level in self.levels:
            word = rank >> BITS
            filled = level[word]
            level[word] = filled | 1 << (rank & 63)
            if filled:
                return
            rank = word

    def lowest(self) -> int:
        """The lowest rank with an entry, or -1."""
        rank = 0
        for level in reversed(self.levels):
            word = level[rank]
            if not word:
                return -1
            rank = rank << BITS | (word & -word).bit_length() - 1
        return rank

    def take(self, rank: int) -> list[int]:
        """The positions of a rank, leftmost first; its bucket is empty then."""
        positions = self.buckets.pop(rank)
        for level in self.levels:
            word = rank >> BITS
            level[word] &= ~(1 << (rank & 63))
            if level[word]:
                break
            rank = word
        positions.sort()
        return positions


class Encoder:
    """Ids of texts by merge ranks: token bytes to rank, and a pattern whose matches are merged each on its own."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.border = max(ranks.values()) + 1
        self.queue = RankQueue(self.border)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        #: Rank of two neighbouring ids, for every way to cut a token in two tokens.
        self.pairs = {
            ranks[token[:k]] << PAIR | ranks[token[k:]]: rank
            for token, rank in ranks.items() for k in range(1, len(token))
            if token[:k] in ranks and token[k:] in ranks}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each pre-token, merged some at a time: they do not depend on each other."""
        out, begin, size = [], 0, 0
        for i, piece in enumerate(pieces, 1):
            size += len(piece)
            if size >= MERGED_BYTES or i == len(pieces):
                out += self.merge(pieces[begin:i])
                begin, size = i, 0
        return out

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each pre-token."""
        text = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
        ends = np.cumsum([len(p) + 1 for p in pieces]) - 1  # a border stands behind each piece
        start = self.bytes[text]
        start[ends] = self.border
        n = len(start)
        # One long pre-token is held in four bytes an entry; lists are faster, and some ten times as large.
        row = partial(array, "i" if n < 1 << 31 else "q") if n > 2 * MERGED_BYTES else list
        ids, after, before = row(start.tolist()), row(range(1, n + 1)), row(range(-1, n - 1))
        known, queue = self.pairs.get, self.queue
        keys = start[:-1] << PAIR | start[1:]
        found, of = np.unique(keys, return_inverse=True)
        first = np.array([known(k, -1) for k in found.tolist()], np.int64)[of] if n > 1 else np.zeros(0, np.int64)
        ranks = row(np.append(first, -1).tolist())  # of each piece with the one after it
        at = np.flatnonzero(first >= 0)
        at = at[np.argsort(first[at], kind="stable")]
        for group in np.split(at, np.flatnonzero(np.diff(first[at])) + 1):
            if len(group):
                queue.push(int(first[group[0]]), group.tolist())
        del start, keys, found, of, first, at
        buckets, push = queue.buckets, queue.push
        while (rank := queue.lowest()) >= 0:
            positions = queue.take(rank)
            shifted, lower = rank << PAIR, False
            for k, i in enumerate(positions):
                if ranks[i] != rank:
                    continue  # stale
                j = after[i]
                right = after[j]
                ids[i], ids[j], ranks[j] = rank, -1, -1
                after[i], before[right] = right, i
                ranks[i] = new = known(shifted | ids[right], -1)
                if new >= 0:
                    if new in buckets:
                        buckets[new].append(i)
                    else:
                        push(new, [i])
                    lower = new < rank
                left = before[i]
                if left >= 0:
                    ranks[left] = new = known(ids[left] << PAIR | rank, -1)
                    if new >= 0:
                        if new in buckets:
                            buckets[new].append(left)
                        else:
                            push(new, [left])
                        lower |= new < rank
                if lower:  # goes first
                    if positions[k + 1:]:
                        push(rank, positions[k + 1:])
                    break
        left_over = np.array(ids)
        kept = (left_over >= 0) & (left_over != self.border)
        packed = left_over[kept].astype("<u4").tobytes()
        stops = (np.cumsum(kept)[ends] * 4).tolist()
        return [packed[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def learn(self, missing: list[str]) -> dict[str, bytes]:
        """Packed ids of chunks that are not in the memo."""
        cut = [self.pattern.findall(c) for c in missing]
        # A pre-token may be a token, or a chunk that is in the memo.
        known: dict[str, bytes | None] = {p: self.memo.get(p) for pieces in cut for p in pieces}
        rest, unknown = [], []
        for p, ids in known.items():
            if ids is None:
                text = p.encode()
                if (whole := self.ranks.get(text)) is not None:
                    known[p] = whole.to_bytes(4, "little")
                else:
                    rest.append(p)
                    unknown.append(text)
        known.update(zip(rest, self.merged(unknown), strict=True))
        return {c: b"".join([known[p] for p in pieces]) for c, pieces in zip(missing, cut, strict=True)}

    def keep(self, fresh: dict[str, bytes]) -> None:
        """Short chunks go to the young half of the memo."""
        for c, ids in fresh.items():
            if len(c) > MEMO_LONGEST:
                continue
            size = len(c) + len(ids) + ENTRY_BYTES
            if 2 * (self.held + size) > MEMO_BYTES or 2 * len(self.memo) >= MEMO_ENTRIES:
                self.older, self.memo, self.held = self.memo, {}, 0
            self.memo[c] = ids
            self.held += size

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        found = self.memo.get
        cut = [chunks(t) for t in texts]
        looked = [list(map(found, c)) for c in cut]
        missing = {c for cs, ids in zip(cut, looked, strict=True) if None in ids
                   for c, i in zip(cs, ids, strict=True) if i is None}
        if missing:
            old = self.older
            fresh = {c: old[c] for c in missing if c in old}
            fresh |= self.learn([c for c in missing if c not in fresh])
            self.keep(fresh)
            looked = [[fresh[c] if i is None else i for c, i in zip(cs, ids, strict=True)] if None in ids else ids
                      for cs, ids in zip(cut, looked, strict=True)]
        return [b"".join(ids) for ids in looked]


def chunks(text: str) -> list[str]:
    """``text`` in pieces that start where white space follows other characters."""
    if "\0" not in text and not OTHER_SPACE.search(text):
        # Blanks and line ends are all borders then; a piece of white space alone means a longer run.
        pieces = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
        if " " not in pieces and "\n" not in pieces:
            return pieces if pieces[0] else pieces[1:]
    return CHUNK.findall(text)


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.sizes = np.array([len(t) for t in tokens])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, "<u4")
        sizes = self.sizes[ids]
        stops = np.cumsum(sizes)
        total = int(stops[-1]) if len(ids) else 0
        return self.bytes[np.repeat(self.starts[ids] - (stops - sizes), sizes) + np.arange(total)].tobytes()


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank from the content of a rank file: a base64 token and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


_built: dict[tuple, object] = {}


def once(kind: type, path: str, *more):
    """One encoder or decoder per worker process and vocabulary. The file is part of an installed package, so
    every machine has it."""
    key = (kind, path, *more)
    if key not in _built:
        with open(path, "rb") as file:
            _built[key] = kind(read_ranks(file.read()), *more)
    return _built[key]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (packed), n_tokens of every text."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("n_tokens", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        encoder = once(Encoder, path, pattern)
        for batch in batches:
            for doc_ids, texts in portions(batch, BATCH_CHARS):
                for doc_id, ids in zip(doc_ids, encoder.encode(texts), strict=True):
                    yield len(ids), (doc_id, ids, len(ids) // 4)

    return by_rows(docs.select(F.col("doc_id").cast("long"), "text"), rows, schema)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The columns of ``decode`` for every text: it is encoded and its ids are decoded by one worker a task, where ``decode`` on
    ``encode`` keeps two for each running task."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("n_tokens", pa.int64()), ("decoded", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        encoder, decoder = once(Encoder, path, pattern), once(Decoder, path)
        for batch in batches:
            for doc_ids, texts in portions(batch, BATCH_CHARS):
                for doc_id, ids in zip(doc_ids, encoder.encode(texts), strict=True):
                    text = decoder.decode(ids)
                    yield len(ids) + len(text), (doc_id, ids, len(ids) // 4, text)

    return by_rows(docs.select(F.col("doc_id").cast("long"), "text"), rows, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The columns of ``encode`` and ``decoded``, the bytes of the text."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("n_tokens", pa.int64()), ("decoded", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        decoder = once(Decoder, path)
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                doc_id, ids, n_tokens = (x.as_py() for x in row)
                text = decoder.decode(ids)
                yield len(ids) + len(text), (doc_id, ids, n_tokens, text)

    return by_rows(encoded.select("doc_id", "ids", "n_tokens"), rows, schema)
