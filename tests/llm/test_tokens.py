"""Operators on token ids against the libraries whose results they must give."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from proofledger.llm import byte_bpe, queries, token_counts, token_files
from tests.llm.cases import documents, frame, unique

RANKS, PIECES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.tiktoken", "piece_bpe_32k.model", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def ranks():
    with open(RANKS, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder(ranks):
    return byte_bpe.Encoder(ranks, public_tokenizers.PATTERN)


MIXED = st.lists(st.sampled_from(list("ab c\n\t's1é漢😀\x00\x1c\x85　▁!") + ["the ", "  ", " it's", "<|endoftext|>", "\r\n", "aaaa"]),
                 max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(MIXED)
def test_merges_equal_the_library(encoder, ranks, library, text):
    ids = encoder.encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    assert byte_bpe.Decoder(ranks).decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["\t \u00a0 \u00a0", "a \u00a0 \u00a0 .", "a \u00a0 \u00a0", "x \r \u3000 y", "a\n\t\n\tb", "a b\u00a0c d"])
def test_white_space_of_several_kinds_is_one_pretoken(encoder, library, text):
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == library.encode_ordinary(text)


SPACES = st.lists(st.sampled_from([" ", "\n", "\t", "\r", "\u00a0", "\u2003", "\u3000", "\x85", " \u00a0 \u00a0", "a", ".", "the"]),
                  max_size=30).map("".join)


@settings(max_examples=300, deadline=None)
@given(SPACES)
def test_merges_around_white_space_equal_the_library(encoder, library, text):
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == library.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 20_001, "ab" * 9_000 + "é" * 999, "".join(random.Random(1).choices("abcdefgh", k=30_000))])
def test_one_long_pretoken(encoder, library, text):
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == library.encode_ordinary(text)


def test_memo_is_bounded(encoder, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO_ENTRIES", 10)
    texts = [f"word{i} other{i * 7} the" for i in range(50)]
    assert [np.frombuffer(x, "<u4").tolist() for t in texts for x in encoder.encode([t])] == [library.encode_ordinary(t) for t in texts]
    assert len(encoder.memo) <= 10


def test_memo_keeps_what_is_met_again(ranks, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO_ENTRIES", 20)
    encoder, merged = byte_bpe.Encoder(ranks, public_tokenizers.PATTERN), []
    monkeypatch.setattr(encoder, "merge", lambda pieces, merge=encoder.merge: merged.extend(pieces) or merge(pieces))
    texts = [f"word{i}qz frequentzq other{i * 7}qz" for i in range(50)]
    got = [x for t in texts for x in encoder.encode([t])]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode_ordinary(t) for t in texts]
    assert len(encoder.memo) + len(encoder.older) <= 20
    assert merged.count(b" frequentzq") == 1


def test_a_lower_rank_that_turns_up_goes_first():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"abc": 270, b"cc": 280}
    encoder = byte_bpe.Encoder(ranks, r"\S+")
    library = tiktoken.Encoding("t", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    for text in ("abcabc", "bcbcc", "abcc", "cccc", "aabccbc"):
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == library.encode_ordinary(text)


def test_byte_bpe_of_awkward_documents(spark, library):
    docs = frame(spark, clashes=True)
    got = byte_bpe.decode(byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert sorted(byte_bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect(), key=str) == sorted(got, key=str)
    want = sorted((str(r[0]), library.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in documents())
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in got) == want
    assert all(r.n_tokens * 4 == len(r.ids) for r in got)


def test_byte_bpe_query(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.byte_bpe_digests(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = np.array(library.encode_ordinary(texts[r.doc_id]), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(MIXED)
def test_pretokens_hold_all_pieces(text):
    model = token_counts.model(PIECES)
    keys = token_counts.pretokens(text)
    assert sum(len(x) if k else 1 for k, x in zip(keys, model.encode(keys, num_threads=1), strict=True)) == len(model.encode(text))


@pytest.mark.parametrize("entries", [0, 20, 1 << 18])
def test_token_counts_of_awkward_documents(spark, entries):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = token_counts.token_counts(frame(spark, clashes=True), PIECES, entries).collect()
    want = sorted((str(r[0]), len((r[1] or "").encode()), len(model.encode(r[1] or ""))) for r in documents())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want


def test_token_counts_query(spark, sf_dir):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.piece_counts(spark, sf_dir).collect()
    assert {(r.doc_id, r.n_tokens, r.over_limit) for r in got} == {
        (i, n, n > 4096) for i, t in texts.items() for n in [len(model.encode(t))]}


@settings(max_examples=200, deadline=None)
@given(MIXED)
def test_chunks_equal_the_library(text):
    source = token_files.chunked(WORDS)
    assert np.frombuffer(source.encode([text])[0], source.type).tolist() == source.tokenizer.encode(text, add_special_tokens=False).ids


def least_bits(counts: list[int], limit: int) -> int:
    """Total bits of the best code by trying all lengths, by recursion over the free code space."""
    counts = sorted((c for c in counts if c), reverse=True)

    def best(k: int, length: int, space: int) -> float:
        if k == len(counts):
            return 0
        if length > limit or space <= 0:
            return float("inf")
        # Take a code of this length for the k-th id, or go on with longer codes.
        return min(counts[k] * length + best(k + 1, length, space - 1), best(k, length + 1, space * 2))

    return best(0, 1, 2)


@pytest.mark.parametrize("counts,limit", [([5, 3, 2, 1, 1], 4), ([100, 50, 20, 9, 4, 2, 1, 1], 4), ([1] * 8, 3), ([40, 1, 1, 1, 1, 1], 3), ([7, 0, 7], 18)])
def test_code_lengths_are_the_best_within_the_limit(counts, limit):
    lengths = token_files.code_lengths(np.array(counts), limit)
    assert lengths.max() <= limit and (lengths > 0).tolist() == [c > 0 for c in counts]
    assert sum(2.0 ** -n for n in lengths if n) <= 1
    assert int((lengths * counts).sum()) == least_bits(counts, limit)


@pytest.mark.parametrize("kinds,size", [(1, 3), (2, 1000), (300, 1), (300, 5000), (5, 0)])
def test_coded_blocks_decode_side_by_side(kinds, size):
    rng = np.random.default_rng(kinds)
    blocks = [rng.integers(0, kinds, n) ** 2 // kinds for n in (size, size // 2, 257 if size else 0)]
    counts = np.bincount(np.concatenate([*blocks, [0]]))
    lengths = token_files.code_lengths(counts, token_files.LIMIT)
    packed = [token_files.pack(b, token_files.canonical(lengths), lengths) for b in blocks]
    out = token_files.Table(lengths).unpack([(bits, marks, len(b)) for (bits, marks), b in zip(packed, blocks, strict=True)])
    assert [o.tolist() for o in out] == [b.tolist() for b in blocks]


def test_token_files_of_awkward_documents(spark, tmp_path, monkeypatch):
    library = Tokenizer.from_file(WORDS)
    token_files.write(frame(spark, clashes=True), f"{tmp_path}/out", WORDS, end_id=1)
    got = sorted(token_files.read(spark, f"{tmp_path}/out").collect(), key=lambda r: r.start)
    marks = {r.text: r.mark for r in frame(spark).select("text", F.xxhash64("text").alias("mark")).collect()}
    want = sorted(documents(), key=lambda r: (r[0] is not None, r[0] or 0, marks[r[1]]))
    at = 0
    for r, (doc_id, text, *_) in zip(got, want, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) == (doc_id, at, ids)
        at += len(ids)


def test_token_files_of_nothing(spark, tmp_path):
    token_files.write(frame(spark, []), f"{tmp_path}/out", WORDS, end_id=1)
    assert token_files.read(spark, f"{tmp_path}/out").collect() == []


def test_token_file_query(spark, sf_dir):
    library = Tokenizer.from_file(WORDS)
    rows = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in queries.token_file_digests(spark, sf_dir).collect()}
    at = 0
    for doc_id, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[doc_id].start, got[doc_id].n_tokens, got[doc_id].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_nothing_to_encode(spark):
    empty = frame(spark, [])
    assert byte_bpe.decode(byte_bpe.encode(empty, RANKS, public_tokenizers.PATTERN), RANKS).count() == 0
    assert token_counts.token_counts(empty, PIECES).count() == 0
    assert frame(spark, unique()).agg(F.countDistinct("doc_id")).first()[0] == len(unique())
