"""The 32 questions, their other spellings, and the replay of all of them."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofledger.plans import replay as rp
from proofledger.plans import verdicts as vd
from proofledger.plans.guard import judged_texts
from proofledger.plans.questions import BY_ID, QUESTIONS, Question, Spelling, answer, spellings
from workloads import analogue as an
from workloads import sql

SPELLINGS = spellings(an.AS_OF)


def ask(question: Question, spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer(question, an.staged(spark, sf_dir), an.SUBJECT)


def spell(spelling: Spelling, spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.build(an.staged(spark, sf_dir), an.SUBJECT)


def reference_runs(table: DataFrame) -> list[rp.Run]:
    return [rp.Run(q.id, rp.REFERENCE, partial(q.build, table, an.SUBJECT), q.order_by, key=(q.id, "own")) for q in QUESTIONS]


def attempt_plan() -> list[tuple[str, int, Spelling | None]]:
    """Stored attempts: the listed spellings (mistaken ones get two attempts), else the question's own."""
    plan: list[tuple[str, int, Spelling | None]] = []
    for q in QUESTIONS:
        mine = [s for s in SPELLINGS if s.question_id == q.id] or [None]
        plan.extend((q.id, i, s) for i, s in enumerate(mine, 1))
    return plan


def attempt_runs(table: DataFrame) -> list[rp.Run]:
    runs = []
    for question_id, n, spelling in attempt_plan():
        build = spelling.build if spelling else BY_ID[question_id].build
        order_by = spelling.order_by if spelling else BY_ID[question_id].order_by
        key = (question_id, spelling.name if spelling else "own")
        runs.append(rp.Run(question_id, n, partial(build, table, an.SUBJECT), order_by, key=key))
    return runs


def question_table(spark: SparkSession) -> DataFrame:
    rows = [(q.id, q.type, q.trap, q.question, q.why) for q in QUESTIONS]
    return spark.createDataFrame(rows, "question_id STRING, type STRING, trap BOOLEAN, question STRING, why STRING")


def replayed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Attempts and result rows of all references and candidates, computed once per input folder."""
    def make(path: str) -> None:
        table = an.staged(spark, sf_dir)
        attempts, rows = rp.replay(spark, reference_runs(table) + attempt_runs(table), f"{path}/rows")
        attempts.write.parquet(f"{path}/attempts")
        rows.write.parquet(f"{path}/placed")

    path = an.made_once(spark, sf_dir, "replay", make)
    return spark.read.parquet(f"{path}/attempts"), spark.read.parquet(f"{path}/placed")


def prints(spark: SparkSession, sf_dir: str, version: int) -> DataFrame:
    attempts, rows = replayed(spark, sf_dir)
    return rp.fingerprinted(attempts, rows, version)


def reference_fingerprints(spark: SparkSession, sf_dir: str, version: int = 1) -> DataFrame:
    return rp.references(prints(spark, sf_dir, version)).select("question_id", "rows", "sha256")


def verdict_table(spark: SparkSession, sf_dir: str, version: int = 1) -> DataFrame:
    """The flagship: every stored attempt of every question replayed, compared and judged."""
    found = prints(spark, sf_dir, version)
    judged = vd.classified(rp.candidates(found), rp.references(found))
    return vd.verdicts(judged, question_table(spark))


def typed_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = replayed(spark, sf_dir)
    return rp.typed_comparison(prints(spark, sf_dir, 2), rows).drop("reference_fingerprint")


def rolling_mismatch_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = replayed(spark, sf_dir)
    differences = rp.row_differences(rows).where("question_id = 'Q15'")
    return differences.select("attempt_n", "pos", F.col("key").alias("month"))


# ---- a table of texts ----

#: A text about a town, the outcome it must get, why it is rejected, whether it ends in a sort.
TEXTS = [
    ("SELECT count(*) AS n FROM sales WHERE town = '{town}'", "", "", False),
    ("SELECT month, median(resale_price) AS m FROM sales WHERE town = '{town}' GROUP BY month ORDER BY month", "", "", True),
    ("WITH secret AS (SELECT block FROM sales WHERE town = '{town}') SELECT * FROM secret", "", "", False),
    ("SELECT * FROM (WITH secret AS (SELECT '{town}' AS x) SELECT * FROM secret) a CROSS JOIN secret b", "guardrail_reject", "reads secret", False),
    ("SELECT 'CTE [secret]' AS c, secret.* FROM secret WHERE town = '{town}'", "guardrail_reject", "reads secret", False),
    ("SELECT reflect('java.lang.System', 'getenv', '{town}') AS x FROM sales", "guardrail_reject", "calls reflect", False),
    ("SELECT * FROM csv.`/{town}`", "guardrail_reject", "reads csv./{town}", False),
    ("SELECT 1 AS a; SELECT '{town}' AS b", "guardrail_reject", "more than one statement", False),
    ("CREATE TABLE {town} AS SELECT * FROM sales", "guardrail_reject", "not a query", False),
    ("SELECT town_{town} FROM sales", "sql_error", "", False),
    ("SELECT '{town} FROM sales", "sql_error", "", False),
]


def judged_town_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of every town, judged before anything of it is run; ``secret`` is a view that texts may not read."""
    an.staged(spark, sf_dir).createOrReplaceTempView("sales")
    an.staged(spark, sf_dir).createOrReplaceTempView("secret")
    towns = an.table(spark, sf_dir, "nation").select(F.explode(F.array(*[F.lit(t) for t, *_ in TEXTS])).alias("text"), "n_name")
    texts = towns.select(F.replace("text", F.lit("{town}"), "n_name").alias("sql"))
    judged = judged_texts(spark, texts, ["sales"], an.fresh_path(spark, "judged"))
    why = F.when(F.col("outcome") == "guardrail_reject", F.col("note")).otherwise("")
    return judged.select("sql", "outcome", why.alias("note"), "ordered")


def _texts_sql() -> str:
    quoted = ["(" + ", ".join("'" + part.replace("'", "''") + "'" for part in text) + f", {ordered})" for *text, ordered in TEXTS]
    return f"""SELECT replace(t, '{{town}}', n_name) AS sql, outcome, replace(note, '{{town}}', n_name) AS note, ordered
    FROM nation, (VALUES {', '.join(quoted)}) v(t, outcome, note, ordered)"""


# ---- SQL ----


def _prints_sql(version: int = 1) -> str:
    """reference and candidate fingerprints as CTEs ``ref`` and ``cand``."""
    ref = " UNION ALL ".join(sql.print_of(t, q, 0, version) for q, t in sql.QUESTIONS.items())
    cand = []
    for question_id, n, spelling in attempt_plan():
        triple = sql.SPELLINGS[(question_id, spelling.name)] if spelling else sql.QUESTIONS[question_id]
        cand.append(sql.print_of(triple, question_id, n, version))
    return f"""ref AS MATERIALIZED ({ref}), cand AS MATERIALIZED ({' UNION ALL '.join(cand)})"""


def _verdict_sql() -> str:
    meta = ", ".join(f"('{q.id}', '{q.type}', {str(q.trap).lower()})" for q in QUESTIONS)
    return sql.resale("SELECT 1").rsplit("\n", 1)[0] + f""", {_prints_sql()},
    judged AS (
      SELECT c.question_id, c.attempt_n, count(*) OVER (PARTITION BY c.question_id) AS stored,
        CASE WHEN c.rows <> r.rows THEN 'wrong_row_count' WHEN c.sha256 <> r.sha256 THEN 'value_mismatch'
          ELSE '' END AS mismatch,
        CASE WHEN c.rows <> r.rows THEN 'rows ' || c.rows || ' != ' || r.rows
          WHEN c.sha256 <> r.sha256 THEN 'rows ' || c.rows || ' right, sha ' || left(c.sha256, 12) || ' != '
            || left(r.sha256, 12) ELSE '' END AS reason
      FROM cand c JOIN ref r USING (question_id)
    ),
    q(question_id, type, trap) AS (VALUES {meta}),
    wide AS (
      SELECT q.question_id, q.type, CAST(q.trap AS VARCHAR) AS trap, max(stored) AS stored,
        max(mismatch) FILTER (WHERE attempt_n = 1) AS m1, max(mismatch) FILTER (WHERE attempt_n = 2) AS m2,
        max(reason) FILTER (WHERE attempt_n = 1) AS r1, max(reason) FILTER (WHERE attempt_n = 2) AS r2
      FROM q JOIN judged USING (question_id) GROUP BY ALL
    )
    SELECT question_id, type, trap,
      CASE WHEN m1 = '' THEN 'pass_first_try' WHEN m2 = '' THEN 'pass_after_retry' ELSE 'fail' END AS status,
      CASE WHEN m1 = '' OR m2 = '' THEN '' ELSE coalesce(m2, m1) END AS mismatch_type,
      CAST(CASE WHEN m1 = '' THEN 1 WHEN m2 = '' THEN 2 ELSE stored END AS INTEGER) AS attempts,
      CASE WHEN m1 = '' THEN 'pass' ELSE m1 END AS attempt1_status, m1 AS attempt1_mismatch,
      CASE WHEN m2 IS NULL THEN '' WHEN m2 = '' THEN 'pass' ELSE m2 END AS attempt2_status,
      coalesce(m2, '') AS attempt2_mismatch,
      CASE WHEN m1 = '' THEN '' ELSE left(coalesce(r2, r1), 120) END AS note
    FROM wide"""


def _typed_sql() -> str:
    return sql.resale("SELECT 1").rsplit("\n", 1)[0] + f""", {_prints_sql(2)}
    SELECT c.question_id, c.attempt_n, 'ok' AS outcome, c.rows, c.sha256,
      c.rows = r.rows AND c.sha256 = r.sha256 AS match, c.rows = r.rows AND c.sha256 = r.sha256 AS direct_rows_equal
    FROM cand c JOIN ref r USING (question_id)"""


def _month_sql() -> str:
    parts = []
    for n, name in [(1, "row_frame_over_history"), (2, "row_frame_inside_period")]:
        parts.append(f"""SELECT {n} AS attempt_n, CAST(row_number() OVER (ORDER BY month) - 1 AS BIGINT) AS pos, month,
            g.rolling_3m_median_ppsm AS want, w.rolling_median AS got
            FROM ({sql.QUESTIONS['Q15'][0]}) g JOIN ({sql.SPELLINGS[('Q15', name)][0]}) w USING (month)""")
    both = " UNION ALL ".join(parts)
    return sql.resale(f"SELECT attempt_n, pos, month FROM ({both}) WHERE want IS DISTINCT FROM got")


ENTRIES: dict[str, tuple] = {}
for _q in QUESTIONS:
    _select, _, _ = sql.QUESTIONS[_q.id]
    ENTRIES[f"{_q.id.lower()}_{_q.type}"] = (partial(ask, _q), sql.resale(_select))
for _s in SPELLINGS:
    _select, _, _ = sql.SPELLINGS[(_s.question_id, _s.name)]
    ENTRIES[f"{_s.question_id.lower()}_spelled_{_s.name}"] = (partial(spell, _s), sql.resale(_select))

_references = " UNION ALL ".join(sql.print_of(t, q, 0) for q, t in sql.QUESTIONS.items())
_references_v2 = " UNION ALL ".join(sql.print_of(t, q, 0, 2) for q, t in sql.QUESTIONS.items())
_KEEP = "SELECT question_id, rows, sha256 FROM"
ENTRIES |= {
    "replay_reference_fingerprints_v1": (reference_fingerprints, sql.resale(f"{_KEEP} ({_references})")),
    "replay_reference_fingerprints_v2": (partial(reference_fingerprints, version=2),
                                         sql.resale(f"{_KEEP} ({_references_v2})")),
    "replay_verdicts": (verdict_table, _verdict_sql()),
    "replay_typed_comparison": (typed_replay, _typed_sql()),
    "replay_judged_texts": (judged_town_texts, _texts_sql()),
    "replay_mismatch_months": (rolling_mismatch_months, _month_sql()),
}
