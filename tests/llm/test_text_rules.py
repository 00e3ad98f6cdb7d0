"""Pseudonyms, quality rules and repeated spans against plain Python."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from proofledger.llm import pseudonyms, queries, span_dedup, weak_rules
from tests.llm.cases import CLASHES, documents, frame, nodes, unique


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def named(spark, texts, key="proofledger"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = sorted(pseudonyms.pseudonymised(df, key, "n").collect())
    return [r.text for r in rows], [r.n for r in rows]


# ---- pseudonyms ----


def test_formats_and_validity_stay(spark):
    texts = ["4111 1111 1111 1111", "5555555555554444", "the.72@mail3.example.com", "THE.72@mail3.example.com", "240.56.125.154",
             "+1 (275) 555-5927", "+44 20 7946 0958", "212-555-1234", "GB82 WEST 1234 5698 7654 32", "123-45-6789", "2024-02-29",
             "29.02.2024", "12/31/1999", "1900/01/01"]
    new, counts = named(spark, [f"See {t}, please." for t in texts])
    assert counts == [1] * len(texts)
    for old, text in zip(texts, new, strict=True):
        value = text[4:-9]
        shape = [re.sub(p, s, v) for v in (old, value) for p, s in [("[0-9]", "0")]]
        assert re.sub("[a-z]", "a", re.sub("[A-Z]", "A", shape[0])) == re.sub("[a-z]", "a", re.sub("[A-Z]", "A", shape[1]))
        assert value != old
    assert luhn(new[0][4:-9].replace(" ", "")) and luhn(new[1][4:-9])
    assert new[3][4:-9].lower() == new[2][4:-9]
    account = new[8][4:-9].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1
    assert all(0 <= int(o) <= 255 for o in new[4][4:-9].split("."))
    assert len({re.sub(r"\D", "", d) for d in (new[10], )}) == 1
    assert new[11][4:-9].split(".")[::-1] == new[10][4:-9].split("-")  # one day, one pseudonym, in either format


def test_what_does_not_validate_stays(spark):
    texts = ["4111111111111112", "300.1.1.1 1.2.3.4.5", "2023-02-29 13/13/2000", "DE89370400440532013001", "000-12-3456", "a@b",
             "a7ceca6f2adb7b9e012196032067fe2", "no values", "", None, "1234567"]
    new, counts = named(spark, texts)
    assert new == texts and counts == [0] * len(texts)


def test_phones_and_dates_of_every_grouping_are_found(spark):
    texts = ["212 555 0199", "(212) 555 0199", "+7 495 123 45 67", "+33 1 23 45 67 89", "+49 30 12 34 56 78 90 1", "3/5/2020", "13.5.2020",
             "3.12.1999", "2020-3-5", "2/29/2020"]
    new, counts = named(spark, [f"See {t}, please." for t in texts])
    assert counts == [1] * len(texts)
    for old, text in zip(texts, new, strict=True):
        value = text[4:-9]
        assert value != old and re.sub("[0-9]", "0", value) == re.sub("[0-9]", "0", old)
    assert new[2][4:-9].startswith("+7 ") and new[3][4:-9].startswith("+33 ")
    assert not re.search("23 45 67 89", new[3])
    assert named(spark, ["2/30/2020 2/29/2019 0/5/2020 13/5/2020"])[1] == [0]


def test_short_dates_are_permuted(spark):
    days = spark.range(1900, 2100).selectExpr("explode(sequence(make_date(id, 1, 1), make_date(id, 2, 29 - int(id % 4 != 0 or id = 1900)))) AS day")
    texts = days.selectExpr("concat(month(day), '/', day(day), '/', year(day)) AS text").where("length(text) < 10")
    new = pseudonyms.pseudonymised(texts)
    assert new.distinct().count() == texts.count() == 200 * 59 + 49


def test_valid_values_next_to_other_digits_are_found(spark):
    card, phone = "4111111111111111", "212-555-0199"
    texts = [f"{card} 12/27", "4111 1111 1111 1111 123", f"12 {card}", f"{card} {phone}", card, phone, "4111 1111 1111 1111",
             "BE68 5390 0754 7034 EUR", "AT61 1904 3002 3457 3201 BIC GIBAATWW", "BE68 5390 0754 7034", "AT61 1904 3002 3457 3201",
             f"1 2 3 {card} 4 5 6"]
    new, counts = named(spark, texts)
    assert counts == [1, 1, 1, 2, 1, 1, 1, 1, 1, 1, 1, 1]
    assert new[0] == new[4] + " 12/27" and new[1] == new[6] + " 123" and new[2] == "12 " + new[4]
    assert new[3] == f"{new[4]} {new[5]}" and new[7] == new[9] + " EUR" and new[8] == new[10] + " BIC GIBAATWW"
    assert new[11] == f"1 2 3 {new[4]} 4 5 6" and card not in "".join(new)


def test_equal_values_stay_linked_and_neighbours_apart(spark):
    new, counts = named(spark, ["x 4111 1111 1111 1111 y", "4111111111111111", "+1 (826) 555-4081 190.137.223.204", "190.137.223.204",
                                "a" * 100_000 + " 190.137.223.204"])
    assert new[0].replace(" ", "")[1:-1] == new[1]
    assert counts[2] == 2 and new[2].endswith(new[3]) and new[4].endswith(new[3])


def test_a_format_is_permuted(spark):
    days = spark.range(2000).select("id", F.date_add(F.lit("1999-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("text"))
    octets = spark.range(2000).select("id", F.concat_ws(".", (F.col("id") % 10).cast("string"), F.lit("1"), F.floor(F.col("id") / 10 % 10).cast(
        "string"), (F.floor(F.col("id") / 100) + 100).cast("string")).alias("text"))
    for values in (days, octets):
        assert pseudonyms.pseudonymised(values).select("text").distinct().count() == 2000
    one, two = (named(spark, ["4111111111111111"], key)[0] for key in ("k1", "k2"))
    assert one != two


def test_pseudonyms_of_awkward_documents(spark):
    docs = frame(spark, clashes=True)
    out = pseudonyms.pseudonymised(docs)
    assert out.columns == docs.columns or set(out.columns) == set(docs.columns) - {"__names"}
    assert out.count() == len(documents())
    got = {(r.doc_id, r.n_chars): r.text for r in out.collect()}
    for doc_id, text, _, _, n in unique():
        assert (got[doc_id, n] is None) == (text is None) and len(got[doc_id, n] or "") == len(text or "")
        if text and not re.search(r"@mail|4111", text):
            assert got[doc_id, n] == text
    assert pseudonyms.pseudonymised(frame(spark, [])).count() == 0


def test_native_operators_have_no_python_nodes(spark):
    docs = frame(spark, unique())
    for df in (pseudonyms.pseudonymised(docs), weak_rules.with_verdict(docs, ["doc_id"])):
        assert not re.search("Python|Pandas|Arrow|Scan ExistingRDD.*MapIn", nodes(df).replace("Scan ExistingRDD", ""))


# ---- quality rules ----


def base_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = defaultdict(list)
    for k in range(len(words) - 7):
        windows[tuple(words[k:k + 8])].append(k)
    covered = {j for v in windows.values() if len(v) > 1 for k in v for j in range(k, k + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_base_measures_of_awkward_documents(spark):
    got = weak_rules.with_verdict(frame(spark, clashes=True), ["doc_id"]).select("doc.doc_id", *weak_rules.BASE, "base_failed", "kept").collect()
    want = sorted((str(r[0]), *base_measures(r[1])) for r in documents())
    assert sorted((str(r[0]), *r[1:6]) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert weak_rules.with_verdict(frame(spark, []), ["doc_id"]).count() == 0
    assert weak_rules.passed(frame(spark, [])).count() == 0


def test_estimation_equals_plain_python(spark):
    names = ["a", "b", "c"]
    patterns = [(1, 1, None, 60), (1, 1, 1, 30), (0, 0, 1, 12), (0, None, 0, 9), (None, None, None, 5), (1, 0, 0, 3)]
    df = spark.createDataFrame(patterns, "a int, b int, c int, n long")
    got = weak_rules.estimated(df, names)
    good, right = weak_rules.PRIOR, {k: weak_rules.RIGHT for k in names}

    def posterior(votes):
        p, q = good, 1 - good
        for k, v in zip(names, votes, strict=True):
            if v is not None:
                p *= right[k][0] if v else 1 - right[k][0]
                q *= 1 - right[k][1] if v else right[k][1]
        return p / (p + q)

    for _ in range(weak_rules.STEPS):
        post = [posterior(r[:3]) for r in patterns]
        n = [r[3] for r in patterns]
        new = {}
        for j, k in enumerate(names):
            def total(vote, of, j=j):
                return sum(m * (p if of else 1 - p) for r, p, m in zip(patterns, post, n, strict=True) if r[j] == vote)
            new[k] = ((total(1, True) + 1) / (total(1, True) + total(0, True) + 2), (total(0, False) + 1) / (total(0, False) + total(1, False) + 2))
        share = (sum(m * p for m, p in zip(n, post, strict=True)) + 1) / (sum(n) + 2)
        change = max(abs(share - good), *(abs(x - y) for k in names for x, y in zip(new[k], right[k], strict=True)))
        good, right = share, new
        if change < weak_rules.STILL:
            break
    assert got.good == pytest.approx(good) and all(got.right[k] == pytest.approx(right[k]) for k in names)


def test_verdicts_follow_the_labels(spark, sf_dir):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = [r for r in queries.quality_verdicts(spark, sf_dir).collect() if r.doc_id in labels and not r.base_failed]
    assert sum(r.kept == bool(labels[r.doc_id]) for r in got) >= 0.97 * len(got)
    assert all(r.kept for r in got if labels[r.doc_id])


def test_passed_documents_keep_their_columns(spark):
    docs = frame(spark, clashes=True)
    out = weak_rules.passed(docs)
    assert out.columns == docs.columns and out.count() < docs.count()
    assert set(CLASHES) <= set(out.columns)


# ---- repeated spans ----


def plain_dedup(rows):
    """Text of each document without the sentences of runs that stood before."""
    seen, out = {}, {}
    for doc_id, text, *_ in sorted(rows):
        found = span_dedup.sentences(text or "")
        gone = set()
        for span in span_dedup.runs(found)[0]:
            a, b = span >> 32, span & 0xFFFFFFFF
            key = " ".join("".join(found[a:b]).split())
            if key in seen:
                gone.update(range(a, b))
            else:
                seen[key] = doc_id
        out[doc_id] = "".join(s for k, s in enumerate(found) if k not in gone) if gone else text
    return out


def test_sentences_join_to_the_text():
    for _, text, *_ in documents():
        assert "".join(span_dedup.sentences(text or "")) == (text or "")


@pytest.mark.parametrize("blank,ends", [("\t", (10 ** 6, 10 ** 6)), (" ", (10 ** 6, 10 ** 6)), (" ", (16, 23)), (" ", (18, 30)), (" ", (3, 12))])
def test_any_passage_of_51_words_shares_a_run(blank, ends):
    rng = random.Random(9)

    def words(n, at):
        out = []
        for _ in range(n):
            at -= 1
            out.append(f"w{rng.randrange(10 ** 6)}" + ("." if at <= 0 else ""))
            at = at if at > 0 else rng.randint(*ends)
        return out

    for _ in range(300):
        passage, shared = words(51, rng.randint(1, ends[1])), []
        for _ in range(2):
            text = blank.join(words(rng.randrange(60), rng.randint(1, ends[1])) + passage + words(rng.randrange(60), rng.randint(1, ends[1])))
            shared.append(set(span_dedup.runs(span_dedup.sentences(text))[1]))
        assert shared[0] & shared[1]


def test_repeated_spans_go(spark):
    rows = unique()
    got = {r.doc_id: r.text for r in span_dedup.dedup(frame(spark, rows, clashes=True)).collect()}
    assert got == plain_dedup(rows)
    passage = rows[4][1]
    assert got[4] == passage and passage not in got[5]  # the first stays


def test_repeated_rows_and_missing_ids(spark):
    assert span_dedup.dedup(frame(spark)).count() == len(documents())
    assert span_dedup.dedup(frame(spark, [])).count() == 0


def test_span_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: r.text for r in queries.without_repeats(spark, sf_dir).collect()}
    assert got == plain_dedup(rows)
    windows = defaultdict(set)
    for doc_id, text in got.items():
        words = (text or "").split()
        for k in range(len(words) - 49):
            windows[tuple(words[k:k + 50])].add(doc_id)
    assert all(len(v) == 1 for v in windows.values())


def test_a_very_long_domain_ends_no_reader(spark):
    text = "x@" + "b." * 500_000 + "com"
    docs = spark.createDataFrame([(1, text), (2, "x@b.com")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pseudonyms.pseudonymised(docs).collect()}
    assert got[1] == text and got[2] != "x@b.com" and len(got[2]) == 7
