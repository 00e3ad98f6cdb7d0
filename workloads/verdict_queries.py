"""Fingerprints, comparisons and verdicts at volume: orders as results, (user, day) as questions."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from proofledger import schemas
from proofledger.functions.cells import typed_pair
from proofledger.functions.numeric import round_places
from proofledger.operators.folding import BLOCK, FOLDS
from proofledger.operators.matching import differing_positions, without_match
from proofledger.plans import checks
from proofledger.plans import replay as rp
from proofledger.plans import verdicts as vd
from proofledger.plans.fingerprints import fingerprints, with_empty_results
from proofledger.sources import readers
from workloads import analogue as an

# ---- orders as results ----


def order_fingerprints(spark, sf_dir, version):
    prints = fingerprints(an.order_rows(spark, sf_dir, 0), version)
    return prints.select("question_id", "rows", "sha256", "oversized")


def _order_prints(spark, sf_dir):
    references = with_empty_results(an.order_log(spark, sf_dir, 0),
                                    fingerprints(an.order_rows(spark, sf_dir, 0), 2), 2)
    attempts = with_empty_results(an.order_log(spark, sf_dir, 1),
                                  fingerprints(an.order_rows(spark, sf_dir, 1), 2), 2)
    return references, attempts


def whole_table_fingerprint(spark, sf_dir, version):
    """One result with a row for every line item."""
    return fingerprints(an.all_items(spark, sf_dir), version, long=True).select("question_id", "rows", "sha256", "oversized")


LARGE = ("1e31", "1e60", "1e150", "1e299", "1e303")


def large_numbers(spark, sf_dir):
    """Typed cells of numbers from 1e33 to 1e308, each price by each of the factors."""
    items = an.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    scaled = items.withColumn("factor", F.explode(F.array(*[F.lit(float(x)) for x in LARGE]))).withColumn("x", F.col("l_extendedprice") * F.col("factor"))
    return scaled.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "factor", typed_pair(F.col("x"), DoubleType()).alias("cell"))


def order_classes(spark, sf_dir):
    """The class of every changed result, with its note."""
    references, attempts = _order_prints(spark, sf_dir)
    judged = vd.classified(attempts, references)
    return judged.select("question_id", "mismatch", "reason", "ok")


def compared(spark, sf_dir):
    return typed_comparison(spark, sf_dir).drop("reference_fingerprint")


def typed_comparison(spark, sf_dir):
    """Prints and numbers of differing rows are written before they meet: the rows' text is shuffled for each, and would lie on the disk
    for both until the end."""
    def prints(path):
        references, attempts = _order_prints(spark, sf_dir)
        an.write_once(references.unionByName(attempts), path)

    def differing(path):
        rows = an.order_rows(spark, sf_dir, 0).unionByName(an.order_rows(spark, sf_dir, 1))
        an.write_once(rp.differing_rows(rows), path)

    found, differ = (spark.read.parquet(an.made_once(spark, sf_dir, f"order_{make.__name__}", make)) for make in (prints, differing))
    return rp.judged(found, differ)


def order_differences(spark, sf_dir, extra_rows=False):
    """Differing positions per order, with rows only one side has when ``extra_rows``."""
    found = differing_positions(an.order_rows(spark, sf_dir, 0), an.order_rows(spark, sf_dir, 1),
                                ["question_id"], "line_v1", extra_rows)
    return found.select("question_id", "pos", F.col("reference_line").isNotNull().alias("in_reference"),
                        F.col("candidate_line").isNotNull().alias("in_candidate"))


# ---- the event log as questions and attempts ----


def questions(spark, sf_dir):
    """The question set with its pinned answers, computed and written once."""
    def make(path):
        an.event_questions(spark, sf_dir).write.mode("errorifexists").parquet(path)

    return spark.read.parquet(an.made_once(spark, sf_dir, "event_questions", make))


def records(spark, sf_dir):
    log = readers.read_log(spark, an.event_log(spark, sf_dir))
    return vd.latest_records(readers.log_records(log))


def judged(spark, sf_dir, at_most=2):
    attempts = vd.expand_attempts(records(spark, sf_dir), at_most)
    return vd.classified(attempts, questions(spark, sf_dir))


def computed_verdicts(spark, sf_dir):
    return vd.verdicts(judged(spark, sf_dir), questions(spark, sf_dir))


def verdicts(spark, sf_dir):
    """Verdicts written once and read by every roll-up."""
    def make(path):
        computed_verdicts(spark, sf_dir).write.mode("errorifexists").parquet(path)

    return spark.read.parquet(an.made_once(spark, sf_dir, "verdicts", make))


def classes(spark, sf_dir):
    return judged(spark, sf_dir).select("question_id", "attempt_n", "mismatch", "reason", "ok")


def rolled_up(roll_up):
    return lambda spark, sf_dir: roll_up(verdicts(spark, sf_dir))


TYPE_ORDER = [f"bucket{i:02d}" for i in reversed(range(100))]


def type_chart(spark, sf_dir):
    return vd.type_chart(verdicts(spark, sf_dir), TYPE_ORDER)


def stored_checks(spark, sf_dir):
    v = verdicts(spark, sf_dir)
    return checks.verdict_checks(v, vd.totals(v))


def doctored_checks(spark, sf_dir):
    """Every row set to a first-try pass must disagree with the stored totals."""
    v = verdicts(spark, sf_dir)
    return checks.verdict_checks(v.withColumn("status", F.lit("pass_first_try")), vd.totals(v))


def runs_compared(spark, sf_dir):
    """Totals when only first attempts count, against the full log."""
    first = vd.verdicts(judged(spark, sf_dir, 1), questions(spark, sf_dir))
    return vd.compare_totals(vd.totals(first), vd.totals(verdicts(spark, sf_dir)))


def models(spark, sf_dir):
    log = readers.read_log(spark, an.event_log(spark, sf_dir))
    return vd.models_used(records(spark, sf_dir), readers.log_meta(log), questions(spark, sf_dir))


def done(spark, sf_dir):
    return vd.done_questions(records(spark, sf_dir), questions(spark, sf_dir))


def pending(spark, sf_dir):
    return vd.pending_questions(questions(spark, sf_dir).select("question_id", "type"), done(spark, sf_dir))


def unanswered(spark, sf_dir):
    """Questions for which the log of the run with ``click`` first has no record."""
    some = records(spark, sf_dir).where("model IS NULL")
    return without_match(questions(spark, sf_dir).select("question_id", "trap"), some, ["question_id"])


def _means(spark, sf_dir):
    groups = an.event_groups(spark, sf_dir).groupBy("question_id").agg(F.max("value").alias("answer"))
    return groups.select("question_id", *an.value_print(round_places(F.col("answer"), 2)))


def drift(spark, sf_dir):
    """Pinned medians against recomputed maxima: drift wherever they differ."""
    return vd.drifted(questions(spark, sf_dir), _means(spark, sf_dir)).select("question_id", "want_sha", "sha256")


def repinned(spark, sf_dir):
    return vd.repinned(questions(spark, sf_dir), _means(spark, sf_dir))


def identity(spark, sf_dir):
    """Settings in which a resumed run would differ: its temperature and its question set."""
    stored = readers.log_meta(readers.read_log(spark, an.event_log(spark, sf_dir))).drop("contract_sha256").crossJoin(
        F.broadcast(vd.contract_hash(questions(spark, sf_dir))))
    other = vd.contract_hash(questions(spark, sf_dir).where("type <> 'bucket00'"))
    now = stored.drop("contract_sha256").crossJoin(F.broadcast(other)).withColumn("temperature", F.lit(0.7))
    return vd.identity_differences(stored, now).select("field")


# ---- SQL ----

_EVENTS = """
    ev AS (
      SELECT 'U' || user_id || '-' || strftime(ts, '%Y%m%d') AS question_id, ts, event_id, event_type, value,
        CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
        row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS n,
        count(*) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS stored
      FROM events
    ),
    att AS (
      SELECT question_id, CAST(n AS INTEGER) AS attempt_n,
        CAST(stored AS INTEGER) AS stored,
        CASE event_type WHEN 'error' THEN 'sql_error' WHEN 'signup' THEN 'timeout' ELSE 'ok' END AS outcome,
        CASE WHEN event_type IN ('error', 'signup') THEN 'event ' || event_id ELSE '' END AS note,
        CASE WHEN event_type NOT IN ('error', 'signup') THEN CAST(1 AS BIGINT) END AS rows,
        CASE WHEN event_type NOT IN ('error', 'signup') THEN sha256(printf('%.2f', value)) END AS sha256
      FROM ev WHERE n <= 2
    ),
    qs AS (
      SELECT question_id, 'bucket' || lpad(CAST(max(k) FILTER (WHERE n = 1) AS VARCHAR), 2, '0') AS type,
        max(k) FILTER (WHERE n = 1) % 5 = 0 AS trap, CAST(1 AS BIGINT) AS rows,
        sha256(printf('%.2f', round(median(value), 2))) AS sha256
      FROM ev GROUP BY question_id
    ),
    judged AS (
      SELECT a.question_id, a.attempt_n, a.stored, a.outcome,
        CASE WHEN a.outcome <> 'ok' THEN a.outcome WHEN a.sha256 <> q.sha256 THEN 'value_mismatch' ELSE '' END
          AS mismatch,
        CASE WHEN a.outcome <> 'ok' THEN a.note
          WHEN a.sha256 <> q.sha256 THEN 'rows 1 right, sha ' || left(a.sha256, 12) || ' != ' || left(q.sha256, 12)
          ELSE '' END AS reason
      FROM att a JOIN qs q USING (question_id)
    ),
    wide AS (
      SELECT question_id, type, CAST(trap AS VARCHAR) AS trap, max(stored) AS stored,
        max(mismatch) FILTER (WHERE attempt_n = 1) AS m1, max(mismatch) FILTER (WHERE attempt_n = 2) AS m2,
        max(reason) FILTER (WHERE attempt_n = 1) AS r1, max(reason) FILTER (WHERE attempt_n = 2) AS r2
      FROM qs JOIN judged USING (question_id) GROUP BY ALL
    )"""
_VERDICT_SELECT = """SELECT question_id, type, trap,
      CASE WHEN m1 = '' THEN 'pass_first_try' WHEN m2 = '' THEN 'pass_after_retry' ELSE 'fail' END AS status,
      CASE WHEN m1 = '' OR m2 = '' THEN '' ELSE coalesce(m2, m1) END AS mismatch_type,
      CAST(CASE WHEN m1 = '' THEN 1 WHEN m2 = '' THEN 2 ELSE stored END AS INTEGER) AS attempts,
      CASE WHEN m1 = '' THEN 'pass' ELSE m1 END AS attempt1_status, m1 AS attempt1_mismatch,
      CASE WHEN m2 IS NULL THEN '' WHEN m2 = '' THEN 'pass' ELSE m2 END AS attempt2_status,
      coalesce(m2, '') AS attempt2_mismatch,
      CASE WHEN m1 = '' THEN '' ELSE left(coalesce(r2, r1), 120) END AS note
    FROM wide"""
LOG_SQL = f"WITH {_EVENTS}"
QUESTION_SQL = LOG_SQL
VERDICT_SQL = f"{LOG_SQL}\n{_VERDICT_SELECT}"
WITH_VERDICTS = f"{LOG_SQL}, v AS ({_VERDICT_SELECT})"
BY_TYPE_SQL = """SELECT type, count(*) AS n, count(*) FILTER (WHERE status <> 'fail') AS type_passed
                 FROM v GROUP BY type"""
_TOTALS = """SELECT count(*) AS questions, count(*) FILTER (WHERE status = 'pass_first_try') AS pass_first_try,
    count(*) FILTER (WHERE status = 'pass_after_retry') AS pass_after_retry,
    count(*) FILTER (WHERE status = 'fail') AS fail, count(*) FILTER (WHERE status <> 'fail') AS passed FROM v"""

_LABEL = "l_returnflag || CASE WHEN l_linenumber % 2 = 0 THEN chr(34) || chr(92) || chr(9) || chr(1) || 'é/' ELSE '' END"
_LABEL_JSON = ("l_returnflag || CASE WHEN l_linenumber % 2 = 0 THEN chr(92) || chr(34) || chr(92) || chr(92) || "
               "chr(92) || 't' || chr(92) || 'u0001é/' ELSE '' END")

def _lines(price: str, version: int) -> str:
    if version == 1:
        return f"""concat_ws(chr(31), {_LABEL}, printf('%.2f', CAST(l_partkey AS DOUBLE)), printf('%.2f', {price}),
            printf('%.2f', l_discount - 0.05), CASE WHEN l_tax > 0 THEN printf('%.2f', l_tax) ELSE 'null' END,
            strftime(l_shipdate, '%Y-%m-%d'), strftime(l_shipdate, '%Y-%m-%d'),
            CASE WHEN l_linestatus = 'O' THEN 'true' ELSE 'false' END)"""
    return f"""'[["text","' || {_LABEL_JSON} || '"],["number","' || l_partkey || '.00"],["number","'
        || printf('%.2f', {price}) || '"],["number","' || printf('%.2f', l_discount - 0.05) || '"],'
        || CASE WHEN l_tax > 0 THEN '["number","' || printf('%.2f', l_tax) || '"]' ELSE '["null"]' END
        || ',["datetime","' || strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') || '"],["date","'
        || strftime(l_shipdate, '%Y-%m-%d') || '"],["bool",' || CASE WHEN l_linestatus = 'O' THEN 'true' ELSE 'false' END
        || ']]'"""


_ORDERED = f"""WITH placed AS (
      SELECT *, l_orderkey AS question_id,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(an.LINE_ORDER)}) - 1 AS pos,
        count(*) OVER (PARTITION BY l_orderkey) AS size
      FROM lineitem
    ),
    ref AS (SELECT question_id, pos, size, {_lines('l_extendedprice', 1)} AS line1,
        {_lines('l_extendedprice', 2)} AS line2 FROM placed),
    cand AS (
      SELECT question_id, CASE WHEN question_id % 7 = 2 THEN size - 1 - pos ELSE pos END AS pos,
        CASE WHEN question_id % 7 = 4 AND pos = 0 THEN NULL
          ELSE {_lines('CASE WHEN question_id % 7 = 3 THEN l_extendedprice + 0.01 ELSE l_extendedprice END', 2)}
          END AS line2,
        CASE WHEN question_id % 7 = 4 AND pos = 0 THEN 'other'
          ELSE {_lines('CASE WHEN question_id % 7 = 3 THEN l_extendedprice + 0.01 ELSE l_extendedprice END', 1)}
          END AS line1
      FROM placed WHERE question_id % 7 <> 5 AND NOT (question_id % 7 = 1 AND pos = size - 1)
    )"""


def _order_print_sql(version: int) -> str:
    text = ("string_agg(line1, chr(30) ORDER BY pos)" if version == 1
            else "'[' || string_agg(line2, ',' ORDER BY pos) || ']'")
    return f"""{_ORDERED}
    SELECT question_id, count(*) AS rows, sha256({text}) AS sha256, false AS oversized FROM ref GROUP BY 1"""


def folded_sql(rows: str) -> str:
    """Hash of ``rows`` (question_id, pos, line2) folded block by block."""
    steps = [f"f0 AS (SELECT question_id, pos, sha256(line2) AS d FROM {rows})"]
    for k in range(FOLDS):
        steps.append(f"""f{k + 1} AS (SELECT question_id, pos // {BLOCK} AS pos, sha256(string_agg(d, chr(10) ORDER BY pos)) AS d
            FROM f{k} GROUP BY 1, 2)""")
    return ", ".join(steps)


_FOLDED_ORDERS = f"""{_ORDERED}, {folded_sql('ref')}
    SELECT question_id, rows, d AS sha256, false AS oversized FROM f{FOLDS}
    JOIN (SELECT question_id, count(*) AS rows FROM ref GROUP BY 1) USING (question_id)"""
_ALL_ITEMS = f"""WITH items AS (SELECT 'items' AS question_id, {_lines('l_extendedprice', 2)} AS line2,
        row_number() OVER (ORDER BY {', '.join([*an.ITEM_KEYS, *an.LINE_ORDER])}) - 1 AS pos FROM lineitem),
    {folded_sql('items')}
    SELECT question_id, (SELECT count(*) FROM items) AS rows, d AS sha256, false AS oversized FROM f{FOLDS}"""


def _all_items_sql(version: int) -> str:
    text = ("string_agg(line, chr(30) ORDER BY pos)" if version == 1 else "'[' || string_agg(line, ',' ORDER BY pos) || ']'")
    return f"""WITH items AS (SELECT {_lines('l_extendedprice', version)} AS line,
        row_number() OVER (ORDER BY {', '.join([*an.ITEM_KEYS, *an.LINE_ORDER])}) - 1 AS pos FROM lineitem)
    SELECT 'items' AS question_id, count(*) AS rows, sha256({text}) AS sha256, false AS oversized FROM items"""


# The shortest text of a DOUBLE has an exponent here; its digits are followed by zeros up to the point.
_LARGE_SQL = f"""WITH scaled AS (
      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, factor, CAST(l_extendedprice * factor AS VARCHAR) AS t
      FROM lineitem, (VALUES {', '.join(f'({x}::DOUBLE)' for x in LARGE)}) v(factor)),
    parts AS (SELECT *, replace(split_part(t, 'e', 1), '.', '') AS digits, CAST(replace(split_part(t, 'e', 2), '+', '') AS INTEGER) AS power FROM scaled)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, factor, '["number","' || rpad(digits, power + 1, '0') || '.00"]' AS cell FROM parts"""


VOLUME_SQL = f"""{_ORDERED},
    rp AS (SELECT question_id, count(*) AS rows,
        sha256('[' || string_agg(line2, ',' ORDER BY pos) || ']') AS sha256
      FROM ref GROUP BY 1),
    cp AS (SELECT question_id, count(c.pos) AS rows,
        count(c.pos) > count(c.line2) AS defect,
        CASE WHEN count(c.pos) = 0 THEN sha256('[]')
          WHEN count(c.pos) = count(c.line2)
          THEN sha256('[' || string_agg(c.line2, ',' ORDER BY c.pos) || ']') END AS sha256
      FROM (SELECT DISTINCT question_id FROM placed) LEFT JOIN cand c USING (question_id) GROUP BY 1),
    diff AS (SELECT question_id, count(*) AS differing FROM ref JOIN cand USING (question_id, pos)
      WHERE ref.line2 IS DISTINCT FROM cand.line2 GROUP BY 1),
    typed AS (SELECT question_id, 1 AS attempt_n, 'ok' AS outcome, cp.rows, cp.sha256, rp.rows AS want_rows,
        cp.rows = rp.rows AND cp.sha256 IS NOT DISTINCT FROM rp.sha256 AS match,
        cp.rows = rp.rows AND differing IS NULL AS direct_rows_equal
      FROM cp JOIN rp USING (question_id) LEFT JOIN diff USING (question_id))"""

_CLASS_SQL = f"""{VOLUME_SQL}
    SELECT question_id, mismatch, CASE mismatch WHEN '' THEN ''
        WHEN 'result_contract_error' THEN 'ValueError: non-finite result number'
        WHEN 'wrong_row_count' THEN 'rows ' || rows || ' != ' || want_rows
        ELSE 'rows ' || rows || ' right, sha ' || left(sha256, 12) || ' != ' || left(want_sha, 12) END AS reason,
      mismatch = '' AS ok
    FROM (SELECT cp.*, rp.rows AS want_rows, rp.sha256 AS want_sha,
        CASE WHEN defect THEN 'result_contract_error'
          WHEN cp.rows <> rp.rows THEN 'wrong_row_count'
          WHEN cp.sha256 IS DISTINCT FROM rp.sha256 THEN 'value_mismatch' ELSE '' END AS mismatch
      FROM cp JOIN rp USING (question_id))"""


def _check_rows(doctored: bool) -> str:
    status = "'pass_first_try'" if doctored else "status"
    head = f"""{WITH_VERDICTS}, d AS (SELECT * REPLACE ({status} AS status) FROM v), t AS ({_TOTALS})"""
    rows = ["SELECT 'question count' AS check_name, CAST(count(*) <> max(t.questions) AS BIGINT) AS violations FROM d, t"]
    for s in schemas.STATUSES:
        rows.append(f"SELECT 'count of {s}', CAST(count(*) FILTER (WHERE status = '{s}') <> max(t.{s}) AS BIGINT) FROM d, t")
    rows += [
        "SELECT 'verdicts sum to questions', CAST(pass_first_try + pass_after_retry + fail <> questions AS BIGINT) FROM t",
        "SELECT 'passed sum', CAST(pass_first_try + pass_after_retry <> passed AS BIGINT) FROM t",
        "SELECT 'status vocabulary', 0", "SELECT 'mismatch vocabulary', 0", "SELECT 'trap vocabulary', 0",
        "SELECT 'one or two attempts', count(*) FROM d WHERE attempts NOT IN (1, 2)",
        "SELECT 'passing row without mismatch', count(*) FROM d WHERE status <> 'fail' AND mismatch_type <> ''",
        "SELECT 'unique question ids', count(*) - count(DISTINCT question_id) FROM d",
    ]
    return head + " " + " UNION ALL ".join(rows)


_CHANGED = "SELECT question_id, sha256(printf('%.2f', round(max(value), 2))) AS sha256 FROM ev GROUP BY 1"
_COMPARE = f"""{WITH_VERDICTS}, a AS ({_TOTALS}),
    b AS (SELECT count(*) AS questions, count(*) FILTER (WHERE m1 = '') AS pass_first_try,
      CAST(0 AS BIGINT) AS pass_after_retry, count(*) FILTER (WHERE m1 <> '') AS fail,
      count(*) FILTER (WHERE m1 = '') AS passed FROM wide)
    SELECT measure, old_n, new_n, new_n - old_n AS difference
    FROM (UNPIVOT b ON COLUMNS(*) INTO NAME measure VALUE old_n)
    JOIN (UNPIVOT a ON COLUMNS(*) INTO NAME measure VALUE new_n) USING (measure)"""
_DONE = """done AS (SELECT question_id FROM att JOIN qs USING (question_id)
    WHERE stored >= 2 OR (attempt_n = 1 AND outcome = 'ok' AND att.sha256 = qs.sha256) GROUP BY 1)"""

ENTRIES: dict[str, tuple] = {
    "print_orders_v1": (partial(order_fingerprints, version=1), _order_print_sql(1)),
    "print_orders_v2": (partial(order_fingerprints, version=2), _order_print_sql(2)),
    "print_orders_v3": (partial(order_fingerprints, version=3), _FOLDED_ORDERS),
    "print_all_items_v1": (partial(whole_table_fingerprint, version=1), _all_items_sql(1)),
    "print_all_items_v2": (partial(whole_table_fingerprint, version=2), _all_items_sql(2)),
    "print_all_items_v3": (partial(whole_table_fingerprint, version=3), _ALL_ITEMS),
    "print_large_numbers": (large_numbers, _LARGE_SQL),
    "compare_order_classes": (order_classes, _CLASS_SQL),
    "compare_order_typed": (compared, f"""{VOLUME_SQL}
        SELECT question_id, attempt_n, outcome, rows, sha256, match, direct_rows_equal FROM typed"""),
    "compare_order_positions": (order_differences, f"""{_ORDERED}
        SELECT question_id, pos, true AS in_reference, true AS in_candidate FROM ref JOIN cand USING (question_id, pos)
        WHERE ref.line1 <> cand.line1"""),
    "compare_order_positions_all": (partial(order_differences, extra_rows=True), f"""{_ORDERED}
        SELECT question_id, pos, ref.line1 IS NOT NULL AS in_reference, cand.line1 IS NOT NULL AS in_candidate
        FROM ref FULL JOIN cand USING (question_id, pos) WHERE ref.line1 IS DISTINCT FROM cand.line1"""),
    "verdict_classes": (classes, f"{LOG_SQL} SELECT question_id, attempt_n, mismatch, reason, mismatch = '' AS ok FROM judged"),
    "verdict_rows": (computed_verdicts, VERDICT_SQL),
    "verdict_totals": (rolled_up(vd.totals), f"{WITH_VERDICTS} {_TOTALS}"),
    "verdict_by_type": (rolled_up(vd.by_type), f"""{WITH_VERDICTS}
        SELECT type, n, type_passed AS passed FROM ({BY_TYPE_SQL})"""),
    "verdict_by_trap": (rolled_up(vd.by_trap), f"""{WITH_VERDICTS}
        SELECT trap, count(*) AS n, count(*) FILTER (WHERE status <> 'fail') AS passed FROM v GROUP BY 1"""),
    "verdict_mismatch_counts": (rolled_up(vd.mismatch_counts), f"""{WITH_VERDICTS}
        SELECT mismatch_type, count(*) AS n FROM v WHERE status = 'fail' GROUP BY 1"""),
    "verdict_roll_ups": (rolled_up(vd.roll_ups), f"""{WITH_VERDICTS},
        tall AS (SELECT 'total' AS kind, '' AS key, status FROM v UNION ALL SELECT 'type', type, status FROM v
          UNION ALL SELECT 'trap', trap, status FROM v UNION ALL SELECT 'mismatch', mismatch_type, status FROM v WHERE status = 'fail')
        SELECT kind, key, count(*) AS questions, {', '.join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in schemas.STATUSES)},
          count(*) FILTER (WHERE status <> 'fail') AS passed FROM tall GROUP BY 1, 2"""),
    "verdict_type_chart": (type_chart, f"""{WITH_VERDICTS}
        SELECT 99 - CAST(right(type, 2) AS INTEGER) AS place, type, type_passed AS passed, n - type_passed AS failed
        FROM ({BY_TYPE_SQL})"""),
    "verdict_trap_rates": (rolled_up(vd.trap_rates), f"""{WITH_VERDICTS}
        SELECT *, round(100.0::DOUBLE * passed / n, 2) AS pass_rate FROM (
          SELECT trap, count(*) AS n, count(*) FILTER (WHERE status <> 'fail') AS passed FROM v GROUP BY 1)"""),
    "verdict_failure_chart": (rolled_up(vd.failure_chart), f"""{WITH_VERDICTS},
        c AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{c}')" for i, c in enumerate(schemas.FAILURE_CLASSES))})
              x(place, mismatch_type)),
        f AS (SELECT place, c.mismatch_type, count(v.question_id) AS n FROM c
              LEFT JOIN v ON v.mismatch_type = c.mismatch_type AND v.status = 'fail' GROUP BY 1, 2)
        SELECT *, row_number() OVER (ORDER BY n DESC, mismatch_type) = 1 AS is_largest FROM f"""),
    "verdict_mix": (rolled_up(vd.verdict_mix), f"""{WITH_VERDICTS}
        SELECT status, count(*) AS n FROM v GROUP BY 1"""),
    "verdict_stored_checks": (stored_checks, _check_rows(False)),
    "verdict_doctored_checks": (doctored_checks, _check_rows(True)),
    "verdict_runs_compared": (runs_compared, _COMPARE),
    "log_models_used": (models, f"""{LOG_SQL}
        SELECT DISTINCT CASE WHEN event_type = 'click' THEN 'model-default' ELSE 'model-' || event_type END AS model
        FROM ev WHERE n = 1"""),
    "log_done_questions": (done, f"{LOG_SQL}, {_DONE} SELECT * FROM done"),
    "log_pending_questions": (pending, f"""{LOG_SQL}, {_DONE}
        SELECT question_id, type FROM qs WHERE question_id NOT IN (SELECT question_id FROM done)"""),
    "log_missing_candidates": (unanswered, f"""{LOG_SQL}
        SELECT question_id, trap FROM qs
        WHERE question_id NOT IN (SELECT question_id FROM ev WHERE n = 1 AND event_type = 'click')"""),
    "log_run_identity": (identity, """SELECT unnest(['temperature', 'contract_sha256']) AS field
        WHERE (SELECT count(*) FROM events) > 0"""),
    "pins_drift": (drift, f"""{LOG_SQL}, x AS ({_CHANGED})
        SELECT question_id, qs.sha256 AS want_sha, x.sha256 AS sha256 FROM qs JOIN x USING (question_id)
        WHERE qs.sha256 <> x.sha256"""),
    "pins_rewritten": (repinned, f"""{LOG_SQL}, x AS ({_CHANGED})
        SELECT question_id, type, trap, CAST(1 AS BIGINT) AS rows, x.sha256 FROM qs JOIN x USING (question_id)"""),
}
