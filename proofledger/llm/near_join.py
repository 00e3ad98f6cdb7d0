"""Self-join of documents on the Jaccard similarity of their word shingles, by PartEnum signatures.

Two linked sets differ in few elements, at most ``k`` in a band of sizes. The elements' domain is cut by hash into
``n1`` groups of ``n2`` parts. In some group at most ``k2`` of the differences lie, so the sets agree on one of
the subsets of ``n2 - k2`` parts of it: a set's signatures are the hashes of its elements in each such subset of each
group. Sets of a band and the next one share a scheme. A subset in which a set has nothing says nothing; a set
with so many of them that the argument might rest on these alone also signs, for that scheme, with the elements of its
prefix (the elements with the smallest hashes, of which linked sets share one).

Equal sets are one node. Nodes that share a signature are candidates, but pairs are not enumerated: a group of
nodes is done once all its nodes are in one component. First each node is compared with the least node of each of
its groups. What remains is searched in blocks for pairs that might link, by odd sketches: a set's elements counted
modulo 2 in as many cells as its band needs; two sketches differ in no more cells than the sets in elements. Each
node proposes its nearest partners, the pairs are compared exactly, and so on until no group has a pair left that is in
two components, might link and has not been compared.

Defined results: text NULL, empty or without words has no shingles, links with nothing and is its own component;
with fewer words than a shingle the whole sequence is one; repeated rows are equal documents; a long text is one
set, never cut; unlike texts with one doc_id are documents of their own; doc_id NULL takes part like any other, and is the
least of a component only where all are NULL; an empty table gives an empty table; other columns are not read.
Shingles, and sets, are compared by 64-bit hashes.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations
from math import comb, exp, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofledger.llm.common import by_rows, by_tasks, let_go, settle

#: A signature covers at least this many elements of an average set, where the scheme can be chosen so.
COVER = 2
#: Cells of a sketch for each difference that linked sets may have.
CELLS = 32
#: Partners that a node gets compared with from one group at a time, the nearest first; where the group is searched in blocks, a share of
#: them from each, and one at least.
PARTNERS = 8
#: Nodes of a group that are searched together; a larger group is searched in pairs of blocks.
BLOCK = 512
#: Shares of the signatures that are shuffled one after another.
TURNS = 4
#: Members of groups that are searched in one turn: so many, or so many for each node that shares a signature.
SEARCHED, SEARCHED_EACH = 1 << 18, 4
#: Nodes of so many sets at most are broadcast to find them where they are.
WANTED = 1 << 20
#: Nodes that a task knows as signed already.
SIGNED = 1 << 17
MEMO_ENTRIES, MEMO_LONGEST = 1 << 19, 64
U = np.uint64


class Words(dict):
    """Hashes of words, with a bounded memo."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= MEMO_LONGEST:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[word] = value
        return value


_words = Words()


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of each element."""
    x = x + U(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles of ``size`` words, A-Z in lower case."""
    words = text.lower().split()  # of bytes: lowers and splits at ASCII characters only
    if not words:
        return np.zeros(0, U)
    hashes = np.fromiter(map(_words.__getitem__, words), U, len(words))
    width = min(size, len(words))
    count = len(words) - width + 1
    value, factor = np.full(count, width, U), 1
    for k in range(width):
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
        value += hashes[k:k + count] * U(factor)
    value = mixed(value, 1)
    value.sort()
    return value[np.concatenate([[True], value[1:] != value[:-1]])]


class Scheme:
    """Signatures for the sets of sizes ``least`` to ``most`` that differ in at most ``k`` elements."""

    def __init__(self, number: int, least: int, most: int, share: tuple[int, int]):
        part, whole = share
        self.number, self.k = number, 2 * most * (whole - part) // (whole + part)
        k = self.k
        self.cells = 64
        while self.cells < CELLS * (k + 1):
            self.cells *= 2
        best = None
        for k2 in range(min(k, 4) + 1):
            needed = k // (k2 + 1) + 1
            for n2 in range(k2 + 1, k2 + 4):
                n1 = self.with_spare(needed, least, n2, k2)
                cover, count = least * (n2 - k2) / (n1 * n2), n1 * comb(n2, k2)
                if n1 == needed and n1 * comb(n2, k2) * exp(-cover) > 0.05:
                    count += k  # many sets sign with their prefixes too
                rank = (0, count) if cover >= COVER else (1, -cover)
                if best is None or rank < best[0]:
                    best = rank, n1, n2, k2
        _, self.n1, self.n2, self.k2 = best
        #: So many groups at least have no more than k2 differences.
        self.sure = self.n1 - k // (self.k2 + 1)
        self.subsets = np.array(list(combinations(range(self.n2), self.n2 - self.k2)))
        parts = self.n1 * self.n2
        #: A part is a range of the hashes.
        self.borders = np.array([(p << 64) // parts for p in range(1, parts)], U)
        names = np.arange(self.n1 * len(self.subsets), dtype=np.uint64).reshape(self.n1, -1)
        self.salts = mixed(names + U(number << 32), 2)

    @staticmethod
    def with_spare(needed: int, least: int, n2: int, k2: int) -> int:
        """Groups, with some more than needed where sets are likely to leave subsets empty."""
        for n1 in range(needed, needed + needed // 4 + 4):
            empty = n1 * comb(n2, k2) * exp(-least * (n2 - k2) / (n1 * n2))
            if n1 - needed + 1 > empty + 3 * sqrt(empty):
                return n1
        return needed

    def signatures(self, hashes: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, bool]:
        """Signatures of the subsets with elements, from the sorted hashes and the running sums of numbers made from
        them; whether the other subsets might be all that a linked set shares."""
        stops = np.concatenate([[0], np.searchsorted(hashes, self.borders), [len(hashes)]])
        sizes, held = np.diff(stops).reshape(self.n1, self.n2), np.diff(sums[stops]).reshape(self.n1, self.n2)
        if self.n2 > 1:
            sizes, held = sizes[:, self.subsets].sum(axis=2), held[:, self.subsets].sum(axis=2, dtype=U)
        filled = sizes > 0
        return mixed(held[filled] ^ self.salts[filled], 5), int((~filled.all(axis=1)).sum()) >= self.sure


class Bands:
    """Bands of sizes, each reaching as far as sets can link with its smallest, and their schemes."""

    def __init__(self, share: tuple[int, int]):
        self.share = share
        self.tops = [1]

    def band(self, size: int) -> int:
        part, whole = self.share
        while self.tops[-1] < size:
            self.tops.append((self.tops[-1] + 1) * whole // part)
        return bisect_left(self.tops, size)

    @lru_cache(maxsize=None)  # noqa: B019  one per band, which are few
    def scheme(self, band: int) -> Scheme:
        part, whole = self.share
        while len(self.tops) <= band:
            self.tops.append((self.tops[-1] + 1) * whole // part)
        return Scheme(band, self.tops[band - 2] + 1 if band > 1 else 1, self.tops[band], self.share)

    def record(self, hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
        """A set's signatures and odd sketch."""
        part, whole = self.share
        n, band = len(hashes), self.band(len(hashes))
        found = []
        sums = np.concatenate([np.zeros(1, U), np.cumsum(mixed(hashes, 4))])
        for scheme in (self.scheme(band), self.scheme(band + 1)):
            if scheme.k:
                values, hollow = scheme.signatures(hashes, sums)
                found.append(values)
                if hollow:
                    prefix = hashes[:n - -(-n * part // whole) + 1]
                    found.append(mixed(prefix ^ mixed(np.array([scheme.number], U), 6), 7))
        cells = self.scheme(band + 1).cells
        odd = np.bincount((hashes & U(cells - 1)).astype(np.int64), minlength=cells) & 1
        return np.concatenate(found) if found else np.zeros(0, U), np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


_bands: dict[tuple[int, int], Bands] = {}


def bands(share: tuple[int, int]) -> Bands:
    return _bands.setdefault(share, Bands(share))


RECORD = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("node", pa.int64()), ("n", pa.int64()),
                    ("signatures", pa.list_(pa.int64())), ("sketch", pa.binary())])
SET = pa.schema([("node", pa.int64()), ("members", pa.list_(pa.int64()))])
PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
JUDGED = pa.schema([*PAIR, ("near", pa.bool_())])


def node_of(hashes: np.ndarray) -> int:
    """One number for a set."""
    total = mixed(hashes, 9).sum(dtype=np.uint64) ^ U(len(hashes))
    return int(mixed(np.array([total]), 10).astype(np.int64)[0])


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text that tells rows with one doc_id apart, and the text's bytes."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.cast("binary").alias("text"))


def records(docs: DataFrame, size: int, share: tuple[int, int]) -> DataFrame:
    """doc_id, mark, node, n (shingles), signatures, sketch of every document; sketch NULL, and no signatures, where the task has
    just given them for an equal set."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        schemes = bands(share)
        signed: set[int] = set()
        for batch in batches:
            for doc_id, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                hashes = shingles(text.as_py(), size)
                if not len(hashes):
                    yield 0, (doc_id, mark, None, 0, [], None)
                    continue
                node = node_of(hashes)
                if node in signed:
                    yield 0, (doc_id, mark, node, len(hashes), [], None)
                    continue
                if len(signed) >= SIGNED:
                    signed.clear()
                signed.add(node)
                found, sketch = schemes.record(hashes)
                yield 8 * len(found) + len(sketch), (doc_id, mark, node, len(hashes), found.astype(np.int64), sketch)

    return by_rows(marked(docs), rows, RECORD)


def sets(docs: DataFrame, size: int, wanted: DataFrame) -> DataFrame:
    """node and its shingles (members) for the documents in ``wanted`` (doc_id, mark)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        for batch in batches:
            for text in batch.column(0):
                hashes = shingles(text.as_py(), size)
                yield 8 * len(hashes), (node_of(hashes), hashes.astype(np.int64))

    return by_rows(one_each(marked(docs), wanted).select("text"), rows, SET)


def judged(pairs: DataFrame, sketches: DataFrame, share: tuple[int, int]) -> DataFrame:
    """``pairs`` (a, b) and ``near``: whether the sketches leave it open that the sets link."""
    part, whole = share
    left, right = (sketches.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"of_{c}")) for c in "ab")

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for n, x, y in zip((batch.column(2).to_numpy() + batch.column(4).to_numpy()).tolist(), batch.column(3).to_pylist(),
                               batch.column(5).to_pylist(), strict=True):
                width = min(len(x), len(y))
                apart = int(np.bitwise_count(folded(x, width) ^ folded(y, width)).sum(dtype=np.int64))
                near.append(apart * (whole + part) <= (whole - part) * n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.bool_())], schema=JUDGED)

    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "n_a", "of_a", "n_b", "of_b")
    return by_tasks(both, tasks, JUDGED)


def linked(pairs: DataFrame, shapes: DataFrame, sketches: DataFrame, share: tuple[int, int]) -> DataFrame:
    """``pairs`` (a, b) and ``ok``: whether the sets link, by their exact intersection. Sets whose sketches are too far apart do not
    move."""
    part, whole = share
    every = settle(judged(pairs, sketches, share), "judged")
    far, pairs = every.where("NOT near").select("a", "b", F.lit(False).alias("ok")), every.where("near")
    few = 2 * pairs.count() <= WANTED

    def side(name: str) -> DataFrame:
        own = shapes.select(F.col("node").alias(name), F.col("members").alias(f"of_{name}"))
        wanted = pairs.select(name).distinct()
        return own.join(F.broadcast(wanted) if few else wanted, name, "left_semi")  # other sets need not move

    left, right = side("a"), side("b")
    both = F.size(F.array_intersect("of_a", "of_b"))
    union = F.size("of_a") + F.size("of_b") - F.col("both")
    return pairs.select("a", "b").join(left, "a").join(right, "b").withColumn("both", both).select(
        "a", "b", (F.col("both") * whole >= union * part).alias("ok")).unionByName(far)


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) after every link has joined its nodes' components; the least label stays.

    The components are nodes of a smaller graph in each step: each goes to its least neighbour, and on to where that
    one goes, until no edge is left."""
    of_a = labels.select(F.col("node").alias("a"), F.col("label").alias("x"))
    of_b = labels.select(F.col("node").alias("b"), F.col("label").alias("y"))
    edges = settle(links.join(of_a, "a").join(of_b, "b").where("x <> y").select("x", "y").distinct(), "edges")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        goes = settle(both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("to")), "goes")
        for _ in range(2):
            step = goes.select(F.col("x").alias("to"), F.col("to").alias("on"))
            goes = goes.join(step, "to", "left").select("x", F.coalesce("on", "to").alias("to"))
        goes = settle(goes, "goes")
        labels = settle(labels.join(goes, F.col("label") == F.col("x"), "left").select(
            "node", F.coalesce("to", "label").alias("label")), "labels")
        x, y = (goes.select(F.col("x").alias(c), F.col("to").alias(f"{c}_to")) for c in "xy")
        edges = settle(edges.join(x, "x").join(y, "y").where("x_to <> y_to").select(
            F.col("x_to").alias("x"), F.col("y_to").alias("y")).distinct(), "edges")
    return labels


def open_groups(members: DataFrame, labels: DataFrame, active: DataFrame | None) -> DataFrame:
    """The members of signatures whose nodes lie in several components, and of which one is active, with their labels and
    the blocks of their signature."""
    by = Window.partitionBy("signature")
    if active is None:
        known = members.join(labels, "node").withColumn("active", F.lit(True))
    else:
        known = members.join(labels.join(active.withColumn("active", F.lit(True)), "node", "left"), "node").withColumn(
            "active", F.coalesce("active", F.lit(False)))
    return known.withColumn("low", F.min("label").over(by)).withColumn("high", F.max("label").over(by)).withColumn(
        "any", F.max("active").over(by)).withColumn("blocks", F.ceil(F.count("*").over(by) / BLOCK).cast("int")).where("low <> high AND any")


def stars(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b): every node with the node of the least label in each of its groups."""
    by = Window.partitionBy("signature")
    centre = F.min(F.struct("label", "node")).over(by)
    return members.join(labels, "node").withColumn("centre", centre).where("centre.node <> node").select(
        F.col("centre.node").alias("a"), F.col("node").alias("b")).distinct()


def proposals(members: DataFrame, labels: DataFrame, sketches: DataFrame, failed: DataFrame, share: tuple[int, int],
              active: DataFrame | None) -> DataFrame:
    """Pairs (a, b) that might link: for every active node its nearest partners in other components.

    A node that proposes nothing has no untried partner within reach, and gets none by later merges; so those that
    took part in the last proposals are active, and at first (``active`` None) all. The pairs are settled; groups are searched in
    turns, as each of their nodes comes with its sketch."""
    open_ = settle(open_groups(members, labels, active).select("signature", "node", "label", "active", "blocks"), "open")
    rows = open_.agg(F.sum("blocks").cast("long").alias("n")).first().n or 0
    turns = max(1, -(-rows // max(SEARCHED, SEARCHED_EACH * sketches.count())))
    found = [settle(proposed(open_.where(F.pmod(F.xxhash64("signature"), F.lit(turns)) == turn), sketches, failed, share), "proposed")
             for turn in range(turns)]
    pairs = settle(reduce(DataFrame.unionByName, found).distinct(), "pairs")
    let_go(open_, *found)
    return pairs


def proposed(groups: DataFrame, sketches: DataFrame, failed: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of nodes in ``groups`` that might link."""
    both = failed.unionByName(failed.select(F.col("b").alias("a"), F.col("a").alias("b"), "ok"))
    tried = both.groupBy("b").agg(F.collect_set("a").alias("tried")).withColumnRenamed("b", "node")
    open_ = groups.join(sketches, "node").join(tried, "node", "left")
    part, whole = share
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    # A pair of blocks is named by the lower and the higher; a block meets each other one, and itself.
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
        F.least(o.cast("long"), F.col("own")).alias("p"), F.greatest(o.cast("long"), F.col("own")).alias("q")))
    dealt = open_.withColumn("own", own).withColumn("pair", F.explode(others)).select(
        "signature", F.col("pair.p").alias("p"), F.col("pair.q").alias("q"), "node", "label", "n", "sketch", "tried", "active", "blocks")
    placed = dealt.repartition("signature", "p", "q").sortWithinPartitions("signature", "p", "q", "node")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        key, held = None, []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[:3] != key:
                    yield from search(held, part, whole)
                    key, held = row[:3], []
                held.append(row[3:])
        yield from search(held, part, whole)

    return by_rows(placed, rows, PAIR).distinct()


def search(held: list[tuple], part: int, whole: int) -> Iterator[tuple[int, tuple]]:
    """For each active one of the nodes (node, label, n, sketch, tried, active, blocks) those of other components within reach, each pair once."""
    if not any(r[5] for r in held):
        return
    width = min(len(r[3]) for r in held)
    sketches = np.stack([folded(r[3], width) for r in held])
    labels, sizes = np.array([r[1] for r in held]), np.array([r[2] for r in held])
    most, made = max(1, PARTNERS // held[0][6]), set()
    for node, label, n, sketch, tried, active, _ in held:
        if not active:
            continue
        own = folded(sketch, width)
        others = np.flatnonzero(labels != label)
        apart = np.bitwise_count(sketches[others] ^ own).sum(axis=1, dtype=np.int64)
        near = np.flatnonzero(apart * (whole + part) <= (whole - part) * (sizes[others] + n))
        known, found = set(tried or ()), 0
        for i in others[near[np.argsort(apart[near], kind="stable")]].tolist():
            other = held[i][0]
            if other not in known:
                pair = min(node, other), max(node, other)
                if pair not in made:
                    made.add(pair)
                    yield 16, pair
                found += 1
                if found == most:
                    break


def folded(sketch: bytes, width: int) -> np.ndarray:
    """The sketch with as many cells as ``width`` bytes hold."""
    cells = np.frombuffer(sketch, np.uint64)
    while len(cells) * 8 > width:
        cells = cells[:len(cells) // 2] ^ cells[len(cells) // 2:]
    return cells


def one_each(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row of ``df`` (doc_id, mark, other columns) for each doc_id and mark that are also in ``wanted``, NULLs alike. The keys have no
    NULLs, so that rows which the join has brought together need not move again to meet their equals."""
    keys = {"__unnamed": F.col("doc_id").isNull(), "__doc": F.coalesce("doc_id", F.lit(0)), "__mark": F.col("mark")}
    there = wanted.select(*[c.alias(k) for k, c in keys.items()]).distinct()
    return df.withColumns(keys).join(there, list(keys), "left_semi").dropDuplicates(list(keys)).drop(*keys)


def shared_signatures(one: DataFrame, turn: int) -> DataFrame:
    """signature, node of the signatures whose turn it is and that several nodes have."""
    mine = F.filter("signatures", lambda s: s.bitwiseAND(TURNS - 1) == turn)
    by = Window.partitionBy("signature")
    signed = one.select("node", F.explode(mine).alias("signature"))
    # Equal sets of several tasks are no group.
    shared = signed.withColumn("low", F.min("node").over(by)).withColumn("high", F.max("node").over(by)).where("low < high")
    return shared.select("signature", "node").distinct()


def unlike_groups(members: DataFrame) -> DataFrame:
    """``members`` (signature, node; no row twice) without the signatures that have the same nodes as a lesser one: near copies share
    hundreds, and a pair is the same pair in each."""
    groups = members.groupBy("signature").agg(
        F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    return members.join(groups.groupBy("size", "x", "y").agg(F.min("signature").alias("signature")), "signature", "left_semi")


def first_row() -> Column:
    """The row by which a set or a component is named: least doc_id, NULL last, then least mark."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")).alias("first")


def near_join(docs: DataFrame, size: int = 5, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """doc_id, mark (of the text), n_shingles, component (the least of its sets' numbers, NULL without shingles), component_id (the
    least doc_id that links reach) of every document of ``docs`` (doc_id, text). Two link when their shingles' intersection is at
    least ``share`` of the union."""
    signed = settle(records(docs, size, share), "records")
    every = settle(signed.drop("signatures", "sketch"), "every")
    nodes = settle(every.where("n > 0").groupBy("node").agg(first_row()).select("node", "first.*"), "nodes")
    one = signed.where("sketch IS NOT NULL").select("node", "n", "signatures", "sketch")
    shared = [settle(shared_signatures(one, turn), "shared") for turn in range(TURNS)]
    members = settle(unlike_groups(reduce(DataFrame.unionByName, shared)), "members")
    sharing = settle(members.select("node").distinct(), "sharing")
    # A component is named by a set, as doc_ids may be NULL or stand for several texts.
    labels = sharing.select("node", F.col("node").alias("label"))
    sketches = settle(one.join(sharing, "node", "left_semi").select("node", "n", "sketch").dropDuplicates(["node"]), "sketches")
    let_go(signed, *shared)
    shapes = settle(sets(docs, size, nodes.join(sharing, "node", "left_semi").select("doc_id", "mark")), "sets")
    pairs = settle(stars(members, labels), "pairs")
    failed = active = None
    while not pairs.isEmpty():
        compared = settle(linked(pairs, shapes, sketches, share), "compared")
        labels = merged(labels, compared.where("ok"))
        missed = compared.where("NOT ok")
        failed = missed.limit(0) if failed is None else failed.unionByName(missed)
        pairs = proposals(members, labels, sketches, failed, share, active)
        active = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    let_go(shapes, sketches)
    named = settle(nodes.join(labels, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("component")), "named")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    component = named.select("node", "component").join(least, "component")
    return every.select("doc_id", "mark", "node", F.col("n").alias("n_shingles")).join(component, "node", "left").select(
        "doc_id", "mark", "n_shingles", "component", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """One document of ``docs`` for each group that links join, that with the least doc_id; of equal rows one. Documents without
    shingles are linked with nothing."""
    found = near_join(docs, size, share)
    first = found.where("component IS NOT NULL").groupBy("component").agg(first_row()).select("first.doc_id", "first.mark")
    kept = first.unionByName(found.where("component IS NULL").select("doc_id", "mark"))
    whole = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c != "__near_mark"])
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), whole.alias("row"))
    return one_each(keyed, kept).select("row.*")
