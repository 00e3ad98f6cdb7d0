"""Benchmark decontamination: words of documents inside passages that a benchmark holds, by an FM-index per shard.

The benchmark is cut into windows of ten words. A shard is a run of about a million words of training text; its index is
the Burrows-Wheeler transform of its words as a wavelet matrix, with suffix positions kept at every eighth word. All
windows of a block are searched backward at once, word by word, by ranks in the matrix; the rows found walk back to
the nearest kept position; the places found are merged to spans. Words that no window of the block holds are one
symbol that ends a stretch of words; a stretch shorter than every window is left out of the index, as nothing can be found in it.

Shards are built, searched and forgotten by the tasks that read the texts, so no text is shuffled or written. Windows
go to the tasks in blocks of bounded size, one broadcast and one narrow pass each, however large the benchmark is.
Windows that belong to the same items form one class, and documents are listed once per set of classes, so that
neither a passage of many items nor one of many documents is multiplied out.

Defined results: words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII; an item with fewer
words is one window, with none it is none; NULL text has no words; an item without id is found, but not named; items
and documents that repeat, repeat nothing but their rows; a text of any length is searched whole, in pieces that
overlap; an empty benchmark finds nothing; an empty table gives an empty table; other columns, whatever their names,
are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from proofledger.llm.common import by_tasks, positions, settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What parts lower-cased words.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters of words before lower-casing.
ANY_CASE = r"0-9A-Za-z\x{80}-\x{10FFFF}"
WINDOW = 10
#: Words of a shard, and windows of a block: some 60 bytes each.
SHARD, BLOCK = 1 << 20, 1 << 18
#: One suffix position of so many is kept.
KEPT = 8
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


# ---- the benchmark ----


@dataclass
class Windows:
    """A block of windows: their words by number (from 1, right-aligned), lengths, and classes."""

    words: list[str]
    symbols: np.ndarray
    lengths: np.ndarray
    classes: np.ndarray

    @staticmethod
    def of(texts: list[str], classes: list[int], width: int) -> Windows:
        parts = [t.split(" ") for t in texts]
        words = sorted({w for p in parts for w in p})
        number = {w: i for i, w in enumerate(words, 1)}
        symbols = np.zeros((len(parts), width), np.int64)
        for row, part in zip(symbols, parts, strict=True):
            row[width - len(part):] = [number[w] for w in part]
        return Windows(words, symbols, np.array([len(p) for p in parts], np.int64), np.array(classes, np.int64))


def item_windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """item_id, window (words joined by blanks) of every item of ``items`` (item_id, text)."""
    words = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORDS), F.lit(0))
    cut = items.select(F.col("item_id").cast("string").alias("item_id"), words.alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1)))
    return cut.select("item_id", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i, width), " "))).alias("window"))


def classified(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(window, class, at) with windows numbered from 0, and (class, item_id): windows of the same items share a class.

    A set of items is known by its size and two sums of hashes, so that no list of items is gathered."""
    pairs = settle(windows.distinct(), "window-items")
    seeds = [F.xxhash64("item_id"), F.xxhash64(F.lit(1), "item_id")]
    sets = [F.sum(h.cast("decimal(20,0)")).alias(f"set{i}") for i, h in enumerate(seeds)]
    by_window = pairs.groupBy("window").agg(F.count("item_id").alias("set2"), *sets)
    key = ["set0", "set1", "set2"]
    # The first place of a class in the order of sets is its number.
    placed = positions(by_window, [*map(F.col, key), F.col("window")], "at")
    firsts = placed.groupBy(*key).agg(F.min("at").alias("class"), F.min_by("window", "at").alias("window"))
    numbered = settle(placed.join(firsts.drop("window").withColumnsRenamed({k: f"_{k}" for k in key}), F.expr(
        " AND ".join(f"{k} <=> _{k}" for k in key))).select("window", "class", "at"), "windows")
    owned = firsts.select("class", "window").join(pairs, "window").where("item_id IS NOT NULL").select("class", "item_id")
    return numbered, settle(owned, "class-items")


# ---- the index ----


class Ranks:
    """Ranks in an array of bits: counts before each 64-bit word, then the bits of the word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, "<u8")
        self.words.view(np.uint8)[:len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])
        self.ones = int(self.before[-1] + np.bitwise_count(self.words[-1]))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def bit(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    """Ranks of symbols: a level per bit, highest first, zeros before ones."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = []
        for b in range(max(int(top).bit_length(), 1) - 1, -1, -1):
            bits = (symbols >> b) & 1 == 1
            self.levels.append((b, Ranks(bits), len(symbols) - int(bits.sum())))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])
        self.starts = np.zeros(top + 1, np.int64)
        self.starts = self.down(np.arange(top + 1), self.starts)

    def down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for b, ranks, zeros in self.levels:
            ones = ranks.rank(at)
            at = np.where((symbols >> b) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol is before its place."""
        return self.down(symbols, at) - self.starts[symbols]

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        symbols = np.zeros(len(at), np.int64)
        for _, ranks, zeros in self.levels:
            bit, ones = ranks.bit(at), ranks.rank(at)
            symbols = symbols * 2 + bit
            at = np.where(bit, zeros + ones, at - ones)
        return symbols, at - self.starts[symbols]


def suffix_order(text: np.ndarray, left: np.ndarray, top: int) -> np.ndarray:
    """Suffixes in order. ``left`` is the distance to the next separator (symbol 0); separators rank by their place,
    so no suffix is read beyond one. Packed first symbols, then doubling within what is still tied."""
    n = len(text)
    bits = max(int(top).bit_length(), 1)
    packed = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for j in range(packed):
        ahead = np.zeros(n, np.int64)
        ahead[:max(n - j, 0)] = text[j:]
        key = key << bits | np.where(left >= j, ahead, 0)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    fresh = np.ones(n, bool)
    fresh[1:] = (sorted_key[1:] != sorted_key[:-1]) | (left[order[1:]] < packed)
    rank = np.empty(n, np.int64)
    group = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank[order] = group
    step = packed
    while True:
        single = fresh.copy()
        single[:-1] &= fresh[1:]
        tied = np.flatnonzero(~single)
        if not len(tied):
            return order
        members = order[tied]
        first, second = group[tied], rank[members + step]
        sort = np.lexsort((second, first))
        order[tied] = members[sort]
        first, second = first[sort], second[sort]
        new = np.ones(len(tied), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        fresh[tied] = new
        group[tied] = np.maximum.accumulate(np.where(new, tied, 0))
        rank[order[tied]] = group[tied]
        step *= 2


class PhraseIndex:
    """FM-index of one shard: ``symbols`` with 0 for words that no phrase holds; phrases have ``shortest`` words at least."""

    def __init__(self, symbols: np.ndarray, top: int, shortest: int):
        known = np.concatenate([[False], symbols > 0, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1])
        starts, lengths = edges[::2], edges[1::2] - edges[::2]
        long = lengths >= shortest
        starts, lengths = starts[long], lengths[long]
        begins = np.cumsum(lengths + 1) - (lengths + 1)
        total = int((lengths + 1).sum())
        into = np.arange(total) - np.repeat(begins, lengths + 1)
        #: Place in the shard of each word of the index.
        place = np.repeat(starts, lengths + 1) + into
        left = np.repeat(lengths, lengths + 1) - into
        text = np.where(left > 0, symbols[np.minimum(place, len(symbols) - 1)], 0) if total else np.zeros(0, np.int64)
        order = suffix_order(text, left, top)
        self.matrix = WaveletMatrix(text[order - 1], top)
        counts = np.bincount(text, minlength=top + 1)
        self.first = np.cumsum(counts) - counts
        self.size = total
        kept = (into % KEPT == 0)[order]
        self.kept, self.positions = Ranks(kept), place[order[kept]]

    def rows(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all right-aligned phrases at once: first row and end."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        for j in range(phrases.shape[1]):
            open_ = np.flatnonzero((lengths > j) & (low < high))
            if not len(open_):
                break
            symbol = phrases[open_, phrases.shape[1] - 1 - j]
            low[open_] = self.first[symbol] + self.matrix.rank(symbol, low[open_])
            high[open_] = self.first[symbol] + self.matrix.rank(symbol, high[open_])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the shard: back to the nearest kept position. Every stretch begins with one."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(~self.kept.bit(at))
        while len(walking):
            symbol, rank = self.matrix.symbol_and_rank(at[walking])
            at[walking] = self.first[symbol] + rank
            steps[walking] += 1
            walking = walking[~self.kept.bit(at[walking])]
        return self.positions[self.kept.rank(at)] + steps


def occurrences(symbols: np.ndarray, windows: Windows) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and windows found in ``symbols``, shard by shard; shards overlap by less than a window."""
    width = windows.symbols.shape[1]
    for begin in range(0, len(symbols) if len(windows.lengths) else 0, SHARD):
        index = PhraseIndex(symbols[begin:begin + SHARD + width - 1], len(windows.words), int(windows.lengths.min()))
        if not index.size:
            continue
        low, high = index.rows(windows.symbols, windows.lengths)
        found = np.flatnonzero(high > low)
        sizes = high[found] - low[found]
        # Each place of a shard begins one window of each length at most.
        for part in np.array_split(np.arange(len(found)), max(1, int(sizes.sum()) >> 20)):
            count = sizes[part]
            rows = np.repeat(low[found[part]], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            place = index.locate(rows)
            own = place < SHARD
            yield begin + place[own], np.repeat(found[part], count)[own]


# ---- documents ----


def word_numbers(texts: pa.Array, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words' numbers of all texts in a row (0: not one of ``words``), and the number of words per text."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), BREAKS)
    flat = lists.flatten()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    found = pc.index_in(flat, value_set=words).to_numpy(zero_copy_only=False)
    numbers = np.where(np.isnan(found), 0, found + 1) if found.dtype.kind == "f" else found + 1
    return numbers[real].astype(np.int64), np.bincount(owner[real], minlength=len(texts))


def search(texts: pa.Array, spans: pa.Array, classes: pa.Array, windows: Windows) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """n_words, n_hit, spans and classes of every text, those found before included."""
    numbers, sizes = word_numbers(texts, pa.array(windows.words, pa.string()))
    # A text's words and one more place, that of a separator.
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    total = int((sizes + 1).sum())
    symbols = np.zeros(total, np.int64)
    symbols[np.arange(len(numbers)) + np.repeat(np.arange(len(sizes)), sizes)] = numbers
    change = np.zeros(total + 1, np.int64)
    before = spans.flatten()
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(spans).to_numpy())
    for name, sign in (("start", 1), ("end", -1)):
        np.add.at(change, begins[owner] + pc.struct_field(before, name).to_numpy(), sign)
    texts_found = [np.repeat(np.arange(len(texts)), pc.list_value_length(classes).to_numpy())]
    classes_found = [classes.flatten().to_numpy()]
    for place, window in occurrences(symbols, windows):
        np.add.at(change, place, 1)
        np.add.at(change, place + windows.lengths[window], -1)
        pairs = np.unique(np.stack([np.searchsorted(begins, place, "right") - 1, windows.classes[window]]), axis=1)
        texts_found.append(pairs[0])
        classes_found.append(pairs[1])
    hit = np.cumsum(change)[:-1] > 0
    text_of = np.repeat(np.arange(len(sizes)), sizes + 1)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    start, end = edges[::2], edges[1::2]
    by = text_of[start]
    merged = pa.StructArray.from_arrays([pa.array(start - begins[by]), pa.array(end - begins[by])], fields=list(SPANS.value_type))
    pairs = np.unique(np.stack([np.concatenate(texts_found), np.concatenate(classes_found)]), axis=1)
    return (sizes, np.bincount(text_of[hit], minlength=len(sizes)), listed(merged, by, len(sizes)),
            listed(pa.array(pairs[1], pa.int64()), pairs[0], len(sizes)))


def listed(values: pa.Array, owners: np.ndarray, n: int) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(np.bincount(owners.astype(np.int64), minlength=n))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def fitted(values, kind: pa.DataType) -> pa.Array:
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return values if values.type == kind else values.cast(kind)


def slices(texts: pa.Array, chars: int) -> Iterator[tuple[int, int]]:
    """Rows from, to: cut after every ``chars`` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
    begin, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        held += size
        if held >= chars:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(sizes):
        yield begin, len(sizes)


def marked(texts: DataFrame, windows: Broadcast, last: bool) -> DataFrame:
    """One block of windows searched in all texts; the texts go on unless this is the last block."""
    kept = [c for c in texts.columns if c != "text" or not last]
    schema = to_arrow_schema(texts.select(*kept).schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = windows.value
        for batch in batches:
            for begin, end in slices(batch.column("text"), 6 * SHARD):
                part = batch.slice(begin, end - begin)
                found = search(part.column("text"), part.column("spans"), part.column("classes"), block)
                columns = {c: part.column(c) for c in kept} | dict(zip(["n_words", "n_hit", "spans", "classes"], found, strict=True))
                yield pa.RecordBatch.from_arrays([fitted(columns[f.name], f.type) for f in schema], schema=schema)

    return by_tasks(texts, task, schema)


def searched(docs: DataFrame, items: DataFrame, width: int = WINDOW, keep_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """For every row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, spans (start and end in words, merged) and
    classes of windows found, and the text if asked for; and (class, item_id) of ``items`` (item_id, text)."""
    numbered, owned = classified(item_windows(items, width))
    last = numbered.agg(F.max("at")).first()[0]
    blocks = 1 if last is None else last // BLOCK + 1
    found = docs.select(
        "doc_id", "text", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
        F.array().cast("array<struct<start: bigint, end: bigint>>").alias("spans"), F.array().cast("array<bigint>").alias("classes"))
    for b in range(blocks):
        # Bounded by BLOCK, whatever the benchmark holds.
        rows = numbered.where(F.col("at").between(b * BLOCK, (b + 1) * BLOCK - 1)).select("window", "class").toArrow()
        block = Windows.of(rows["window"].to_pylist(), rows["class"].to_pylist(), width)
        found = marked(found, docs.sparkSession.sparkContext.broadcast(block), b == blocks - 1 and not keep_text)
    return found, owned


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 (of the ids, as sorted strings joined by commas), contaminated, spans."""
    found, owned = searched(docs, items, width)
    found = settle(found, "found")
    sets = found.where(F.size("classes") > 0).select("classes").distinct()
    ids = F.sort_array(F.collect_set("item_id"))
    names = sets.select("classes", F.explode("classes").alias("class")).join(owned, "class").groupBy("classes").agg(
        F.size(F.collect_set("item_id")).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"))
    out = ["doc_id", "n_words", "n_hit", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
           F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "spans"]
    hit, clean = found.where(F.size("classes") > 0), found.where(F.size("classes") == 0)
    nothing = [F.lit(None).cast("long").alias("n_items"), F.lit(None).cast("string").alias("items_sha256")]
    return hit.join(names, "classes", "left").select(*out).unionByName(clean.select("*", *nothing).select(*out))


def without_passages(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, text (spans taken out, each with what parts its words and follows them) and n_hit of every document."""
    found, _ = searched(docs, items, width, keep_text=True)
    words = F.regexp_extract_all("text", F.lit(f"[{ANY_CASE}]+[^{ANY_CASE}]*"), F.lit(0))
    # What lies between one span's end and the next one's start.
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["end"]))
    starts = F.concat(F.transform("spans", lambda s: s["start"]), F.array("n_words"))
    left = F.flatten(F.zip_with(ends, starts, lambda a, b: F.slice(F.col("words"), (a + 1).cast("int"), (b - a).cast("int"))))
    head = F.regexp_extract("text", f"^[^{ANY_CASE}]*", 0)
    return found.withColumn("words", words).select(
        "doc_id", F.when(F.col("n_hit") > 0, F.concat(head, F.array_join(left, ""))).otherwise(F.col("text")).alias("text"), "n_hit")
