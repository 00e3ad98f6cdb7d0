"""One registered query per operator, with the SQL that checks it where SQL can express it."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from proofledger.llm import (
    bit_planes, byte_bpe, class_lm, mixing, near_join, phrase_index, pseudonyms, span_dedup, threshold_search, token_counts, token_files,
    turn_repair, weak_rules)
from proofledger.llm.common import table
from proofledger.session import work_path

BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def private_values(spark, sf_dir):
    return pseudonyms.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), count="n_values")


def without_repeats(spark, sf_dir):
    return span_dedup.dedup(table(spark, sf_dir, "documents"))


def byte_bpe_digests(spark, sf_dir):
    ids = byte_bpe.encode(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)
    return byte_bpe.decode(ids, BYTE_RANKS).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def piece_counts(spark, sf_dir):
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def token_file_digests(spark, sf_dir):
    out = work_path(spark, "llm", f"token-files-{uuid.uuid4().hex[:12]}")
    token_files.write(table(spark, sf_dir, "documents"), out, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.read(spark, out).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def quality_verdicts(spark, sf_dir):
    return weak_rules.with_verdict(table(spark, sf_dir, "documents"), ["doc_id"]).select(
        F.col("doc.doc_id").alias("doc_id"), *weak_rules.BASE, "base_failed", "kept", "posterior")


def language_scores(spark, sf_dir):
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return class_lm.scores(table(spark, sf_dir, "documents"), held_out)


def best_matches(spark, sf_dir):
    return threshold_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


BEST_MATCHES_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def near_classes(spark, sf_dir):
    return near_join.near_join(table(spark, sf_dir, "documents"), size=3, share=(9, 10)).select(
        "doc_id", "n_shingles", "component_id")


def mixture(spark, sf_dir):
    return mixing.allocate(table(spark, sf_dir, "documents"), keep=["doc_id"]).select(
        "doc.doc_id", "size", "source_size", "target", "taken")


MIXTURE_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, md5(doc_id::VARCHAR) AS key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source),
whole AS (SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE AS words, sum(weight)::DOUBLE AS weight FROM sources),
levels AS (
  SELECT 0 AS step, (SELECT words / weight FROM whole) AS level
  UNION ALL
  SELECT step + 1, ((SELECT words FROM whole) - l.given) / l.weight FROM (
    SELECT step, sum(CASE WHEN 2 * source_size < level * weight THEN 2 * source_size ELSE 0 END)::DOUBLE AS given,
           sum(CASE WHEN 2 * source_size < level * weight THEN 0 ELSE weight END)::DOUBLE AS weight
    FROM levels, sources WHERE step < 40 GROUP BY step) l WHERE l.weight > 0),
shares AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, (SELECT max(level) FROM levels) * weight) AS target,
         ('0x' || substr(md5('mix' || coalesce('=' || source, '-')), 1, 5))::BIGINT::DOUBLE / 1048576.0::DOUBLE AS start
  FROM sources),
placed AS (
  SELECT d.doc_id, size, source_size, target, start,
         CASE WHEN source_size > 0 THEN least(2.0::DOUBLE, target / source_size) ELSE 0 END AS expected,
         row_number() OVER (PARTITION BY d.source ORDER BY size, key, doc_id) - 1 AS place
  FROM sized d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN size > 0 THEN floor(start + expected * (place + 1)) - floor(start + expected * place) ELSE 0 END::BIGINT
         * size AS taken
FROM placed
"""

def benchmark_words(spark, sf_dir):
    return phrase_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


BENCHMARK_WORDS_SQL = r"""
WITH items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS win
  FROM items, unnest(range(1, greatest(len(w) - 8, 2))) AS t(i) WHERE len(w) > 0),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
grams AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM docs, (SELECT DISTINCT n FROM windows), unnest(range(1, len(w) - n + 2)) AS t(i)),
found AS (SELECT r, i, n, win FROM grams SEMI JOIN windows USING (n, win)),
hits AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM found, unnest(range(0, n)) AS t(k) GROUP BY r),
named AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM found JOIN windows USING (n, win) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""


def hard_negatives(spark, sf_dir):
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return bit_planes.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, noisy)


HARD_NEGATIVES_SQL = """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM whole a JOIN whole c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank,
       s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same
WHERE 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY rank <= 3
"""


def repaired_conversations(spark, sf_dir):
    rows, present = turn_repair.damaged(table(spark, sf_dir, "conversations"))
    return turn_repair.totals(turn_repair.repair(rows, present))


REPAIRED_CONVERSATIONS_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
kinds AS (
  SELECT *, xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(range(1, len(key) + 1), lambda i: ord(key[i])::BIGINT)),
           lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                                    lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS kind FROM keyed),
turns AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, unnest(range(0, CASE WHEN kind = 3 THEN 2 ELSE 1 END)) WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen) AS i,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ends
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen FROM turns)),
judged AS (
  SELECT *, left(role, 1) AS c, CASE WHEN ends = '' THEN 1 WHEN seen > 1 THEN 2 WHEN ends NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
         count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
         count(*) FILTER (WHERE fault = 3) AS truncated,
         count(*) FILTER (WHERE before || c NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM judged GROUP BY conv_id),
steps(state, edit, c, next, price) AS (VALUES
  ('e', 'K', 's', 's', 0), ('e', 'K', 'u', 'u', 0), ('s', 'K', 'u', 'u', 0), ('a', 'K', 'u', 'u', 0), ('u', 'K', 'a', 'a', 0),
  ('e', 'R', NULL, 'u', 1), ('s', 'R', NULL, 'u', 1), ('a', 'R', NULL, 'u', 1), ('u', 'R', NULL, 'a', 1),
  ('e', 'D', NULL, 'e', 2), ('s', 'D', NULL, 's', 2), ('a', 'D', NULL, 'a', 2), ('u', 'D', NULL, 'u', 2)),
names(state, name) AS (VALUES ('u', 'user'), ('a', 'assistant')),
inserts(state, put) AS (VALUES ('e', 'u'), ('s', 'u'), ('a', 'u'), ('u', 'a')),
moves AS (
  SELECT state, edit AS edits, edit, c, next, price, []::VARCHAR[] AS line FROM steps
  UNION ALL
  SELECT i.state, 'I' || edit, edit, c, next, price + 5, [name || ':'] FROM inserts i JOIN names n ON n.state = put JOIN steps s ON s.state = put),
walk(conv_id, i, state, cost, audit, lines) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 'e', 0::BIGINT, '', []::VARCHAR[] FROM conversations
  UNION ALL
  SELECT conv_id, i, next, cost, audit, lines FROM (
    SELECT w.conv_id, j.i, m.next, w.cost + m.price + CASE WHEN fault = 3 AND edit <> 'D' THEN 5 ELSE 0 END AS cost, w.audit || m.edits AS audit,
           w.lines || m.line || CASE edit WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [j.role || ':' || j.text] ELSE [name || ':' || j.text] END AS lines
    FROM walk w JOIN judged j ON w.conv_id IS NOT DISTINCT FROM j.conv_id AND j.i = w.i + 1
    JOIN moves m ON m.state = w.state AND (m.c IS NULL OR m.c = j.c) AND (edit = 'D' OR fault NOT IN (1, 2))
    LEFT JOIN names n ON n.state = m.next)
  QUALIFY row_number() OVER (PARTITION BY conv_id, next ORDER BY cost, audit) = 1),
ends(state, edits, price, line) AS (VALUES
  ('e', '', 0, []::VARCHAR[]), ('a', '', 0, []::VARCHAR[]), ('u', 'I', 5, ['assistant:']), ('s', 'II', 10, ['user:', 'assistant:'])),
best AS (
  SELECT w.conv_id, w.cost + e.price AS cost, w.audit || e.edits AS audit, array_to_string(w.lines || e.line, chr(10)) AS body
  FROM walk w JOIN ends e USING (state) LEFT JOIN counts c ON w.conv_id IS NOT DISTINCT FROM c.conv_id
  WHERE w.i = coalesce(c.n, 0)
  QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + e.price, w.audit || e.edits) = 1)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM best b LEFT JOIN counts c ON b.conv_id IS NOT DISTINCT FROM c.conv_id
"""


ENTRIES = {
    "op1_pseudonyms": (private_values, None),
    "op2_span_dedup": (without_repeats, None),
    "op3_byte_bpe": (byte_bpe_digests, None),
    "op4_token_counts": (piece_counts, None),
    "op5_source_mixing": (mixture, MIXTURE_SQL),
    "op6_class_lm": (language_scores, None),
    "op7_threshold_search": (best_matches, BEST_MATCHES_SQL),
    "op8_weak_rules": (quality_verdicts, None),
    "op9_token_files": (token_file_digests, None),
    "op10_near_join": (near_classes, None),
    "op11_phrase_index": (benchmark_words, BENCHMARK_WORDS_SQL),
    "op12_bit_planes": (hard_negatives, HARD_NEGATIVES_SQL),
    "op13_turn_repair": (repaired_conversations, REPAIRED_CONVERSATIONS_SQL),
}
