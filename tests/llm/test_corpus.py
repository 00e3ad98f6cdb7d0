"""Mixing, similarity join, search, language model and the pipeline against plain Python."""

from __future__ import annotations

import math
import os
import random
import time
import zlib
from collections import Counter, defaultdict
from urllib.parse import urlparse

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from proofledger.llm import class_lm, mixing, near_join, queries, threshold_search
from proofledger.llm.common import positions
from tests.llm.cases import documents, frame, prose, unique
from tests.oracle import compare, connect

DOC = "doc_id long, text string, source string"


# ---- positions and mixing ----


def test_positions_do_not_need_one_task(spark):
    rows = [(i % 3 if i % 7 else None, (i * 37) % 101, i) for i in range(500)]
    df = spark.createDataFrame(rows, "g long, k long, i long")
    got = positions(df, [F.col("g").asc_nulls_last(), F.col("k"), F.col("i")], "at", "g").collect()
    groups = defaultdict(list)
    for g, k, i in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2])):
        groups[g].append(i)
    assert {(r.g, r.i): r["at"] for r in got} == {(g, i): n for g, v in groups.items() for n, i in enumerate(v)}
    assert positions(df.limit(0), [F.col("k")], "at").collect() == []


def shares(sizes: dict) -> dict:
    """Targets by sharing out the excess until none is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not above:
            return target | {s: level * weight[s] for s in open_}
        for s in above:
            target[s] = 2.0 * sizes[s]
        left -= sum(2 * sizes[s] for s in above)
        open_ -= above
    return target


@pytest.mark.parametrize("source_of", [lambda i: f"s{i % 4}", lambda i: "big" if i % 10 else f"small{i % 7}", lambda i: None if i % 3 else "é"])
def test_targets_and_taken_words(spark, source_of):
    rows = [(i, "w " * (i % 23 + 1), source_of(i)) for i in range(600)]
    got = mixing.allocate(spark.createDataFrame(rows, DOC)).select("doc.*", "size", "source_size", "target", "copies", "taken").collect()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    target, taken = shares(sizes), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 46 for s in sizes)
    again = mixing.allocate(spark.createDataFrame(rows, DOC).repartition(7)).select("doc.doc_id", "copies").collect()
    assert sorted(tuple(r) for r in again) == sorted((r.doc_id, r.copies) for r in got)


def test_documents_are_put_in_order_without_their_columns(spark, monkeypatch):
    moved, positions = [], mixing.positions
    monkeypatch.setattr(mixing, "positions", lambda df, *a: moved.append(df.columns) or positions(df, *a))
    rows = [(None if i % 3 else 7, "w " * (i % 5 + 1), "s") for i in range(60)]
    assert mixing.mix(spark.createDataFrame(rows, DOC)).count() > 60
    assert len(moved) == 2 and not any({"doc", "text"} & set(columns) for columns in moved)


def test_mixing_of_awkward_documents(spark):
    docs = frame(spark, clashes=True)
    plan = mixing.allocate(docs)
    assert plan.count() == len(documents())
    wanted = Counter()
    for r in plan.select("doc.doc_id", "doc.n_chars", "copies").collect():
        wanted[r.doc_id, r.n_chars] += r.copies
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter((r.doc_id, r.n_chars) for r in mixed.collect()) == +wanted
    assert mixing.allocate(frame(spark, [])).count() == 0 and mixing.mix(frame(spark, [])).count() == 0
    nothing = mixing.allocate(spark.createDataFrame([(1, None, "a"), (2, " ", None)], DOC)).collect()
    assert [(r.size, r.target, r.taken) for r in nothing] == [(0, 0.0, 0)] * 2


def test_queries_with_sql(spark, sf_dir):
    con = connect(sf_dir)
    for name in ("op5_source_mixing", "op7_threshold_search"):
        fn, statement = queries.ENTRIES[name]
        assert compare(spark, con, fn, statement, sf_dir).startswith("ok")


# ---- similarity join ----


def components(rows, size, share):
    part, whole = share
    sets = {}
    for doc_id, text, *_ in rows:
        words = (text or "").encode().lower().split()
        width = min(size, len(words))
        sets[doc_id] = {tuple(words[k:k + width]) for k in range(len(words) - width + 1)} if words else set()
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and both * whole >= part * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                least[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def family():
    """Copies of one text with a growing number of changes, so that many pairs are near the limit."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for k in rng.integers(0, 120, int(rng.integers(0, 12))):
            words[k] = f"x{rng.integers(0, 10 ** 6)}"
        rows.append((i, " ".join(words), "en", "s", 0))
    return rows + [(1000 + i, t, *r) for i, t, *r in rows[:20]]


@pytest.mark.parametrize("rows,size,share", [(unique(), 3, (9, 10)), (unique(), 5, (4, 5)), (family(), 3, (9, 10))])
def test_components_equal_brute_force(spark, rows, size, share):
    got = near_join.near_join(frame(spark, rows, clashes=True), size, share).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components(rows, size, share)


def test_large_groups_are_searched_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_join, "BLOCK", 20)
    rows = family()
    got = near_join.near_join(frame(spark, rows), 3, (9, 10)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components(rows, 3, (9, 10))


def test_groups_of_the_same_nodes_are_searched_once(spark, monkeypatch):
    words = [f"w{k}" for k in range(300)]
    rows = [(i, " ".join(words[:i] + ["other"] + words[i:]), None, None, None) for i in range(0, 300, 50)]
    rows += [rows[0], (901, rows[1][1], None, None, None)]  # equal sets, in other tasks, are one node
    kept, settle = {}, near_join.settle

    def seen(df, name):
        kept[name] = settle(df, name)
        return kept[name]

    monkeypatch.setattr(near_join, "settle", seen)
    docs = frame(spark, rows).repartition(8)
    assert {r.component_id for r in near_join.near_join(docs).collect()} == {0}
    assert {r.component_id for r in near_join.near_join(frame(spark, rows).coalesce(1)).collect()} == {0}
    groups = defaultdict(set)
    for r in kept["members"].collect():
        groups[r.signature].add(r.node)
    sets = [frozenset(g) for g in groups.values()]
    assert sets and min(map(len, sets)) > 1 and len(sets) == len(set(sets))


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "/shuffle_" in f}


def test_disk_holds_what_is_still_read(spark, monkeypatch):
    kept, settle, moved = defaultdict(list), near_join.settle, []

    def seen(df, name):
        before = shuffle_files(spark)
        kept[name].append(settle(df, name))
        wait = time.time() + 20
        while shuffle_files(spark) - before and time.time() < wait:
            time.sleep(0.1)
        assert not shuffle_files(spark) - before
        if name == "judged":
            moved.extend(kept[name][-1].collect())
        return kept[name][-1]

    monkeypatch.setattr(near_join, "settle", seen)
    words = [f"v{k}" for k in range(400)]
    # Passages in common, but too few to link: their sets stay where they are.
    apart = [(2000 + i, " ".join(words[:200] + [f"z{i}.{k}" for k in range(200)]), None, None, None) for i in range(12)]
    rows = family() + apart
    got = near_join.near_join(frame(spark, rows), 3, (9, 10)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components(rows, 3, (9, 10))
    assert any(r.near for r in moved) and not all(r.near for r in moved)
    for name in ("records", "shared", "sets", "sketches"):
        assert kept[name] and not any(os.path.exists(urlparse(d).path) for t in kept[name] for d in {f.rsplit("/", 1)[0] for f in t.inputFiles()})


def test_a_group_makes_a_pair_once():
    """Both nodes of a pair propose it, and a group in several blocks takes its partners from all of them."""
    rng = np.random.default_rng(5)
    sketches = [rng.integers(0, 256, 64, dtype=np.uint8).tobytes() for _ in range(60)]
    for blocks, partners in ((1, near_join.PARTNERS), (4, near_join.PARTNERS // 4), (100, 1)):
        held = [(k, k, 10_000, s, None, True, blocks) for k, s in enumerate(sketches)]
        pairs = [pair for _, pair in near_join.search(held, 9, 10)]
        assert len(set(pairs)) == len(pairs) <= 60 * partners and {k for pair in pairs for k in pair} == set(range(60))


@pytest.mark.parametrize("share", [(9, 10), (4, 5)])
def test_linked_sets_share_a_signature(share):
    rng, found = np.random.default_rng(1), near_join.bands(share)
    part, whole = share
    for n in [2, 3, 5, 8, 10, 15, 30, 60, 150, 600] * 40:
        a = np.unique(rng.integers(0, 2 ** 63, n).astype(np.uint64))
        most = (whole - part) * 2 * n // (whole + part)
        gone = int(rng.integers(0, most + 1))
        new = rng.integers(0, 2 ** 63, int(rng.integers(0, most + 1 - gone))).astype(np.uint64)
        b = np.unique(np.concatenate([a[rng.permutation(len(a))[gone:]], new]))
        both = len(np.intersect1d(a, b))
        if len(b) and both * whole >= (len(a) + len(b) - both) * part and both < max(len(a), len(b)):
            (one, x), (two, y) = found.record(a), found.record(b)
            assert set(one.tolist()) & set(two.tolist())
            width = min(len(x), len(y))
            apart = int(np.bitwise_count(near_join.folded(x, width) ^ near_join.folded(y, width)).sum())
            assert apart <= len(a) + len(b) - 2 * both


def test_links_of_rows_without_ids_and_with_equal_ids(spark):
    rng = random.Random(12)
    texts = [prose(rng, 120).replace("ß", "sz").replace("ñ", "n") for _ in range(4)]

    def near(text, k):
        words = text.split()
        words[k] = "changed"
        return " ".join(words)

    rows = [(None, texts[0]), (1, texts[0].upper()), (2, near(texts[0], 50)), (5, texts[1]), (5, near(texts[1], 40)), (4, near(texts[1], 90)),
            (7, texts[2]), (7, texts[3]), (3, near(texts[3], 20)), (None, texts[3]), (None, None), (9, ""), (9, ""), (2, near(texts[0], 50))]
    # Documents are numbered; equal words are links as well.
    sets = [frozenset(zip(*[(t or "").lower().split()[k:] for k in range(3)], strict=False)) for _, t in rows]
    of = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 10 * len(sets[i] & sets[j]) >= 9 * len(sets[i] | sets[j]):
                a, b = of[i], of[j]
                of = [b if x == a else x for x in of]
    want = Counter()
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if of[j] == of[i] and rows[j][0] is not None]
        want[doc_id, len(sets[i]), min(ids, default=None) if sets[i] else doc_id] += 1
    docs = [(d, t, "en", "s", 0) for d, t in rows]
    got = near_join.near_join(frame(spark, docs, clashes=True), 3, (9, 10)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    kept = Counter((r.doc_id, r.text) for r in near_join.one_of_each(frame(spark, docs), 3, (9, 10)).collect())
    assert kept == Counter([(1, texts[0].upper()), (4, near(texts[1], 90)), (7, texts[2]), (3, near(texts[3], 20)), (None, None), (9, "")])


def test_one_of_each_keeps_rows_and_columns(spark):
    docs = frame(spark, clashes=True)
    kept = near_join.one_of_each(docs, 3, (9, 10))
    assert set(kept.columns) == set(docs.columns) - {"__near_mark"}
    want = components(unique(), 3, (9, 10))
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert Counter(i for i in ids if i is not None and i != 3) == Counter(i for i, (_, c) in want.items() if i == c and i != 3)
    assert near_join.near_join(frame(spark, [])).count() == 0 and near_join.one_of_each(frame(spark, [])).count() == 0


def test_near_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.near_classes(spark, sf_dir).collect()}
    assert got == components(rows, 3, (9, 10))


# ---- search ----


def best(vectors, k):
    """(query_id, rank, vec_id, score) by scoring every pair."""
    whole = [(at, i, [math.floor(1024 * x) for x in v]) for at, (i, v) in enumerate(sorted(vectors))]
    out = []
    for at, i, q in whole:
        if i % 100 == 0:
            scored = sorted((-sum(x * y for x, y in zip(q, v)), j) for a, j, v in whole if a != at)
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard", [3, 1024])
def test_search_with_ties_and_broken_vectors(spark, monkeypatch, shard):
    monkeypatch.setattr(threshold_search, "SHARD", shard)
    rng = np.random.default_rng(2)
    good = [(int(i), [float(x) / 1024 for x in rng.integers(-2, 3, 4)]) for i in range(0, 620, 20)] + [(700, [0.0] * 4), (40, [0.001] * 4)]
    broken = [(800, None), (801, [1.0, None, 0.0, 0.0]), (802, [float("nan")] * 4), (900, [float("inf")] * 4), (None, [1.0] * 4)]
    df = spark.createDataFrame(good + broken, "vec_id long, embedding array<double>").withColumn("at", F.lit("x")).withColumn("shard", F.lit(1))
    got = threshold_search.top_k(df, F.col("vec_id") % 100 == 0, 5).collect()
    assert sorted(tuple(r) for r in got) == best(good, 5)


def test_search_in_few_vectors_and_large_numbers(spark):
    few = [(0, [1e12, -1e12]), (100, [1e12, 1.0]), (1, [3.0, 1e12])]
    df = spark.createDataFrame(few, "vec_id long, embedding array<double>")
    got = threshold_search.top_k(df, F.col("vec_id") % 100 == 0).collect()
    limit = (1 << 63) - 1
    assert sorted(tuple(r) for r in got) == [(q, n, j, max(-limit - 1, min(limit, s))) for q, n, j, s in best(few, 10)]
    assert threshold_search.top_k(df.limit(0), F.lit(True)).count() == 0
    assert threshold_search.top_k(df.limit(1), F.lit(True)).count() == 0


def test_search_reads_lists_only_as_far_as_needed():
    values = [[1.0 - i / 1000, 0.0] for i in range(900)]
    shard = threshold_search.Shard(list(range(900)), list(range(900)), values, 1024.0)
    reads = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, tuple) and len(key) == 3:
                reads.append(key[2])
            return np.asarray(self)[key]

    shard.lists = shard.lists.view(Watched)
    assert [i for i, _ in shard.top(np.array([1024.0, 0.0]), 3, 0)] == [1, 2, 3]
    assert max(r.stop for r in reads) <= 2 * threshold_search.PLACES


# ---- language model ----


def test_base_scores_and_counts(spark, monkeypatch):
    monkeypatch.setattr(class_lm, "KNOWN", 30)  # most words come by the join
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    got = class_lm.scores(frame(spark, clashes=True), held_out, rounds=2).collect()
    rows = [(i, (t or "").encode().lower().split(), i is not None and zlib.crc32(str(i).encode()) % 7 == 2) for i, t, *_ in documents()]
    counts, texts = Counter(), 0
    for _, words, held in rows:
        if not held:
            counts.update(words)
            texts += 1
    tokens, types = sum(counts.values()) + texts, len(counts) + 1
    want = sorted((str(i), held, len(w) + 1, sum(counts[x] > 0 for x in w) + 1, round(
        sum(math.log10((counts[x] + 1) / (tokens + types + 1)) for x in w) + math.log10((texts + 1) / (tokens + types + 1)), 4)) for i, w, held in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
    assert {r.train_tokens for r in got} == {tokens} and all(math.isfinite(r.score) and r.score <= 0 for r in got)


def test_model_is_a_distribution(spark):
    docs = class_lm.prepared(frame(spark), F.lit(False))
    words = class_lm.vocabulary(docs).cache()
    model = class_lm.learned(words, docs, rounds=2)
    own = defaultdict(float)  # emission times the class's tokens, by class
    for r in words.collect():
        unit = model.heads.get(r.word, class_lm.HEADS + r.form)
        own[int(model.classes[unit])] += r.n - model.discount
    for c in range(class_lm.CLASSES):
        if c in own:
            own[c] += 10 ** model.unknown[c]
    own[class_lm.CLASSES] += model.texts
    for before in (0, class_lm.CLASSES):
        assert sum(10 ** model.steps[before, c] * n for c, n in own.items()) == pytest.approx(1, abs=0.02)


def test_exchange_finds_two_languages(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"{side}{rng.integers(0, 40)}" for _ in range(60)) for side in ("aa", "bb") for _ in range(60)]
    docs = class_lm.prepared(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), F.lit(False))
    words = class_lm.vocabulary(docs).cache()
    model = class_lm.learned(words, docs, rounds=6)
    sides = defaultdict(set)
    for side in ("aa", "bb"):
        for k in range(40):
            sides[int(model.classes[model.heads[class_lm.word_hash(f"{side}{k}".encode())]])].add(side)
    assert all(len(v) == 1 for v in sides.values())


def test_best_classes_raise_the_likelihood_most():
    rng, size, n = np.random.default_rng(4), 5, 14
    pairs = rng.poisson(2.0, (n + 1, n + 1)) * (rng.random((n + 1, n + 1)) < 0.4)  # the last is the end
    np.fill_diagonal(pairs, 0)
    of = np.append(rng.integers(0, size - 1, n), size - 1)

    def by_class(classes):
        out = np.zeros((size, size))
        np.add.at(out, (classes[:, None].repeat(n + 1, 1), classes[None].repeat(n + 1, 0)), pairs)
        return out

    at, other, counts = [], [], []
    for w in range(n):
        cells = Counter()
        for v in range(n + 1):
            cells[of[v]] += pairs[w, v]
            cells[of[v] + size] += pairs[v, w]
        for c, x in cells.items():
            if x:
                at, other, counts = [*at, w], [*other, c], [*counts, x]
    got = class_lm.best_classes(of[:n], np.array(at), np.array(other), np.array(counts), by_class(of))
    for w in range(n):
        found = []
        for c in range(size - 1):
            new = of.copy()
            new[w] = c
            found.append(class_lm.likelihood(by_class(new)))
        assert found[got[w]] == pytest.approx(max(found))


@pytest.mark.parametrize("whole", [1 << 20, 0])
def test_words_of_any_rank_are_exchanged_one_by_one(spark, monkeypatch, whole):
    monkeypatch.setattr(class_lm, "WHOLE", whole)
    rng = np.random.default_rng(6)
    # Two languages of 6,000 rare words each, between 20 frequent ones; rare words of both have one form.
    texts = [" ".join(f"{side}{rng.integers(0, 20)} {k}{side}same" for k in rng.integers(100_000, 106_000, 200))
             for side in ("x", "y") for _ in range(300)]
    docs = class_lm.prepared(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), F.lit(False))
    words = class_lm.vocabulary(docs).cache()
    model = class_lm.learned(words, docs, rounds=2)
    of = {r.word: r["class"] for r in model.table.collect()}
    held = {c: Counter() for c in set(of.values())}
    for k in range(100_000, 106_000):
        for side in ("x", "y"):
            if (c := of.get(class_lm.word_hash(f"{k}{side}same".encode()))) is not None:
                held[c][side] += 1
    found = sum(map(Counter.total, held.values()))
    assert found > 11_900 and sum(max(c.values(), default=0) for c in held.values()) > 0.9 * found


def test_rounds_read_words_where_they_are(spark, monkeypatch):
    rng, found = np.random.default_rng(8), []
    texts = [" ".join(f"w{k}" for k in rng.geometric(0.02, 60)) for _ in range(120)]
    docs = class_lm.prepared(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), F.lit(False))
    words = class_lm.vocabulary(docs).cache()
    for whole in (0, 1 << 24):
        monkeypatch.setattr(class_lm, "WHOLE", whole)
        model = class_lm.learned(words, docs, rounds=3)
        found.append({r.word: r["class"] for r in model.table.collect()})
    assert found[0] == found[1] and len(set(found[0].values())) > 20

    class Seen(class_lm.Arrays):
        def move(self, *args):
            before = shuffle_files(spark)
            super().move(*args)
            assert not shuffle_files(spark) - before  # no pair moves in a round

    monkeypatch.setattr(class_lm, "Arrays", Seen)
    class_lm.learned(words, docs, rounds=2)


def test_classes_grow_and_scores_do_not_depend_on_what_is_broadcast(spark, sf_dir, monkeypatch):
    assert class_lm.n_classes(100) == 48 < class_lm.n_classes(10 ** 6) < class_lm.n_classes(10 ** 7)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 20 < 3")
    held_out = F.col("doc_id") % 3 == 0
    found = []
    for known in (1 << 18, 50):
        monkeypatch.setattr(class_lm, "KNOWN", known)
        found.append({r.doc_id: (r.n_known, r.score) for r in class_lm.scores(docs, held_out, rounds=2).collect()})
    one, two = found
    assert one.keys() == two.keys() and all(one[i][0] == two[i][0] and one[i][1] == pytest.approx(two[i][1]) for i in one)


def test_scores_beat_the_base(spark, sf_dir):
    got = [r for r in queries.language_scores(spark, sf_dir).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 0.1 * sum(r.n_tokens for r in got)


def test_nothing_to_learn_from(spark):
    assert class_lm.scores(frame(spark, []), F.lit(False)).count() == 0
    got = class_lm.scores(frame(spark, unique()[:4]), F.lit(True)).collect()
    assert {(r.train_tokens, r.n_known, r.base_score, r.score) for r in got} == {(0, 0, 0.0, 0.0)}


# ---- pipeline ----


def test_stages_keep_columns_and_clean_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    seen = {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        from proofledger.llm.common import settle

        out = settle(stage(spark, docs, sf_dir), f"stage-{k}")
        if k < 4:
            assert out.columns == docs.columns, name
        if k == 0:
            kept = {r.doc_id for r in out.collect()}
            verdicts = {r.doc_id: r for r in queries.quality_verdicts(spark, sf_dir).collect()}
            assert kept == {i for i, r in verdicts.items() if r.kept}
            assert all(i in kept for i, q in quality.items() if q and not verdicts[i].base_failed)
        if k == 1:
            want = components([(i, seen[i]) for i in kept], 5, (4, 5))
            kept = {r.doc_id for r in out.collect()}
            assert kept == {i for i, (_, c) in want.items() if i == c}
        if k == 3:
            assert {r.doc_id for r in out.collect()} <= kept
            texts = sorted((r.doc_id, r.text) for r in out.collect())
        if k == 4:
            assert sorted((r.doc_id, r.text) for r in out.collect()) == texts
        docs = out
