"""Registered queries: clarifications and answer application."""

from __future__ import annotations

from pyspark.sql import functions as F

from relaylake import constants as K
from relaylake.operators import clarify as C
from relaylake.operators import planning
from relaylake.plans.q_intake import tickets
from relaylake.plans.sqlviews import with_views
from relaylake.sources.tables import table

QUERIES: dict = {}
ORACLE: dict = {}

WS_SQL = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"

PAIR_CTES = [
    ("pairs", """SELECT q.conv_id, q.turn, q.text AS question, a.text AS answer
      FROM conversations q LEFT JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
      WHERE q.role = 'user'"""),
    ("creq", """SELECT 'clr-' || CAST(conv_id AS VARCHAR) AS request_id, conv_id AS work_item_id, count(*) AS n_questions,
        CASE WHEN bool_and(answer IS NOT NULL) THEN 'answered' ELSE 'pending' END AS status
      FROM pairs GROUP BY conv_id"""),
]


def pairs(spark, sf):
    return C.qa_pairs(table(spark, sf, "conversations"))


def q_qa_pairing(spark, sf):
    return pairs(spark, sf).select("conv_id", "turn", "question", "answer")


QUERIES["qa_pairing"] = q_qa_pairing
ORACLE["qa_pairing"] = with_views([], "SELECT conv_id, turn, question, answer FROM pairs", extra=PAIR_CTES)


def q_clarification_pending(spark, sf):
    r = C.requests(pairs(spark, sf))
    return r.where(F.col("status") == "pending").select("request_id", "work_item_id", "n_questions")


QUERIES["clarification_pending"] = q_clarification_pending
ORACLE["clarification_pending"] = with_views(
    [], "SELECT request_id, work_item_id, n_questions FROM creq WHERE status = 'pending'", extra=PAIR_CTES)


def q_clarification_comments(spark, sf):
    p = pairs(spark, sf)
    r = C.requests(p).where(F.col("status") == "answered")
    return C.comment_lines(p, r)


QUERIES["clarification_comments"] = q_clarification_comments
ORACLE["clarification_comments"] = with_views([], """
SELECT request_id, CAST(0 AS BIGINT) AS line_no, '[Agent Clarification Record] request_id=' || request_id AS line FROM creq WHERE status = 'answered'
UNION ALL
SELECT c.request_id, p.turn * 2 + 1, 'Q: ' || p.question FROM pairs p JOIN creq c ON c.work_item_id = p.conv_id
  WHERE c.status = 'answered' AND p.answer IS NOT NULL
UNION ALL
SELECT c.request_id, p.turn * 2 + 2, 'A: ' || p.answer FROM pairs p JOIN creq c ON c.work_item_id = p.conv_id
  WHERE c.status = 'answered' AND p.answer IS NOT NULL""", extra=PAIR_CTES)


def _answered_sql(q: str, n: str) -> str:
    hit = (f"(contains(lower({q}), 'catalog') AND contains(e.a, '.'))"
           f" OR (contains(lower({q}), 'source type') AND (contains(lower(e.q) || ' ' || lower(e.a), 'jdbc')"
           f" OR contains(lower(e.q) || ' ' || lower(e.a), 'flat') OR contains(lower(e.q) || ' ' || lower(e.a), 'volume')"
           f" OR contains(lower(e.q) || ' ' || lower(e.a), 'csv')))"
           f" OR (contains(lower({q}), 'append or overwrite') AND (contains(lower(e.q) || ' ' || lower(e.a), 'append')"
           f" OR contains(lower(e.q) || ' ' || lower(e.a), 'overwrite')))"
           f" OR (contains(lower({q}), 'repository') AND trim(e.a, {WS_SQL}) <> '')"
           f" OR (contains(lower({q}), 'acceptance criteria') AND trim(e.a, {WS_SQL}) <> '')")
    return f"len(list_filter({n}, lambda e: {hit})) > 0"


def _apply_sql(source: str) -> str:
    """SELECT list applying answers ``n`` (normalised) with blob ``b``."""
    P = K.TABLE_PATTERN
    repo = ("coalesce(nullif(trim(regexp_replace(replace(trim(struct_extract(list_filter(n, lambda e: contains(lower(e.q), 'repository'))[1], 'a'), "
            f"{WS_SQL}), 'repo:', ''), '[^a-zA-Z0-9_.-]+', '-', 'g'), '-'), ''), target_repo)")
    return f"""SELECT work_item_id,
  CASE WHEN ajd OR aff THEN array_to_string(list_sort(list_filter([CASE WHEN ajd THEN 'jdbc' END, CASE WHEN aff THEN 'flat_file' END],
       lambda x: x IS NOT NULL)), ',') ELSE array_to_string(source_types, ',') END AS source_types,
  CASE WHEN contains(b, 'overwrite') THEN 'overwrite' WHEN contains(b, 'append') THEN 'append' ELSE ingestion_mode END AS ingestion_mode,
  CASE WHEN ahit THEN regexp_extract(b, '{P}', 1) ELSE target_catalog END AS target_catalog,
  CASE WHEN ahit THEN regexp_extract(b, '{P}', 2) ELSE target_schema END AS target_schema,
  CASE WHEN ahit THEN regexp_extract(b, '{P}', 3) ELSE target_table END AS target_table,
  {repo} AS target_repo,
  array_to_string(list_filter(clarification_questions, lambda q: NOT ({_answered_sql('q', 'n')})), '|') AS remaining_questions,
  len(list_filter(clarification_questions, lambda q: NOT ({_answered_sql('q', 'n')}))) > 0 AS needs_clarification
  {{extra}}
FROM (SELECT *, contains(b, 'jdbc') OR contains(b, 'edw') AS ajd,
        contains(b, 'flat file') OR contains(b, 'volume') OR contains(b, 'csv') AS aff,
        regexp_matches(b, '{P}') AS ahit
      FROM (SELECT *, lower(array_to_string(list_transform(n, lambda e: e.a), ' ')) AS b FROM ({source})))"""


def _applied_out(df):
    return df.select(
        "work_item_id", F.array_join("source_types", ",").alias("source_types"), "ingestion_mode",
        "target_catalog", "target_schema", "target_table", "target_repo",
        F.array_join("clarification_questions", "|").alias("remaining_questions"), "needs_clarification")


def q_plan_answers(spark, sf):
    """C12-C14 + E5: human answers from the ticket's conversation applied to
    each plan that asked questions, with the resulting clarification status."""
    p = planning.with_plan(tickets(spark, sf))
    pr = pairs(spark, sf)
    out = C.clarification_status(p, C.requests(pr), pr)
    return _applied_out(out).join(out.select("work_item_id", "clarification_status"), "work_item_id")


ANS_CTES = PAIR_CTES + [
    ("ranked", "SELECT conv_id AS work_item_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, "
               "coalesce(answer, '') AS a FROM pairs"),
    ("need", "SELECT * FROM plans WHERE len(clarification_questions) > 0"),
    ("qx", "SELECT work_item_id, unnest(clarification_questions) AS q, "
           "unnest(generate_series(0, len(clarification_questions) - 1)) AS idx FROM need"),
    ("ans", f"SELECT work_item_id, list(struct_pack(q := q, a := trim(a, {WS_SQL})) ORDER BY idx) "
            f"FILTER (WHERE trim(a, {WS_SQL}) <> '') AS n FROM qx JOIN ranked USING (work_item_id, idx) GROUP BY work_item_id"),
    ("src", "SELECT need.*, coalesce(ans.n, []) AS n, creq.status AS request_status FROM need "
            "JOIN creq USING (work_item_id) LEFT JOIN ans USING (work_item_id)"),
]

QUERIES["plan_answers"] = q_plan_answers
ORACLE["plan_answers"] = with_views(["plans"], _apply_sql("SELECT * FROM src").replace(
    "{extra}", ", CASE WHEN request_status <> 'answered' THEN request_status WHEN len(list_filter(clarification_questions, "
    "lambda q: NOT (" + _answered_sql("q", "n") + "))) > 0 THEN 'incomplete' ELSE 'answered' END AS clarification_status"),
    extra=ANS_CTES)


def q_plan_answers_auto(spark, sf):
    """Auto mode over every ticket: each question answered 'auto-default'.
    Only the table question can stay open (it needs a '.')."""
    p = planning.with_plan(tickets(spark, sf))
    p = p.withColumn("answers", F.transform("clarification_questions",
                                            lambda q: F.struct(q.alias("q"), F.lit(K.AUTO_ANSWER).alias("a"))))
    return _applied_out(C.apply_answers(p))


QUERIES["plan_answers_auto"] = q_plan_answers_auto
ORACLE["plan_answers_auto"] = with_views(["plans"], _apply_sql(
    "SELECT *, list_transform(clarification_questions, lambda q: struct_pack(q := q, a := 'auto-default')) AS n FROM plans"
).replace("{extra}", ""))


def q_map_merge(spark, sf):
    """Automatic defaults merged with human answers, human side wins."""
    p = planning.with_plan(tickets(spark, sf)).where(F.col("needs_clarification"))
    pr = pairs(spark, sf)
    ans = C.answers_for_plans(p, pr)
    reqs = C.requests(pr).select("work_item_id")
    j = p.join(reqs, "work_item_id").join(ans, "work_item_id", "left")
    defaults = F.map_from_arrays("clarification_questions",
                                 F.array_repeat(F.lit(K.AUTO_ANSWER), F.size("clarification_questions")))
    human = C.entries_to_map(C.normalize_answers(F.coalesce(F.col("answers"),
                                                            F.array().cast("array<struct<q:string,a:string>>"))))
    merged = C.merge_maps(defaults, human)
    return j.select("work_item_id", F.size(merged).alias("n_answers"), F.array_join(F.transform(
        F.array_sort(F.map_entries(merged)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|").alias("answers"))


QUERIES["map_merge"] = q_map_merge
ORACLE["map_merge"] = with_views(["plans"], """
SELECT work_item_id, CAST(len(clarification_questions) AS INTEGER) AS n_answers,
  array_to_string(list_sort(list_transform(clarification_questions,
    lambda q: q || '=' || coalesce(struct_extract(list_filter(n, lambda e: e.q = q)[1], 'a'), 'auto-default'))), '|') AS answers
FROM src""", extra=ANS_CTES)


# ---- X3: clarification wait with a deadline (batch twin and stream) --------
CLARIFICATION_TIMEOUT_S = 25 * 60


def clar_events(spark, sf):
    return C.clarification_events(table(spark, sf, "conversations"))


def q_clarification_timeout(spark, sf):
    """X3 batch twin: answered before the deadline, else timed_out by
    system-timeout with empty answers; a later answer overwrites."""
    from relaylake.operators import approvals as A
    t = A.timeout_outcomes(clar_events(spark, sf), CLARIFICATION_TIMEOUT_S, "overwrite", decisions=("answered",))
    return t.select("request_id", "outcome", "outcome_actor", "final_status")


CLAR_SQL = f"""
WITH conv AS (SELECT conv_id, min(turn) FILTER (WHERE role = 'user') AS t0, max(turn) AS tmax FROM conversations GROUP BY conv_id),
pairs AS ({PAIR_CTES[0][1]}),
done AS (SELECT conv_id, bool_and(answer IS NOT NULL) AS answered FROM pairs GROUP BY conv_id),
c AS (SELECT conv.*, done.answered,
        TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(conv.conv_id AS INTEGER)) AS base FROM conv JOIN done USING (conv_id)
      WHERE t0 IS NOT NULL)
SELECT 'clr-' || CAST(conv_id AS VARCHAR) AS request_id,
  CASE WHEN answered AND tmax * 10 <= t0 * 10 + 25 AND tmax >= t0 THEN 'answered' ELSE 'timed_out' END AS outcome,
  CASE WHEN answered AND tmax * 10 <= t0 * 10 + 25 AND tmax >= t0 THEN 'responder' ELSE 'system-timeout' END AS outcome_actor,
  CASE WHEN answered AND tmax >= t0 THEN 'answered' ELSE 'timed_out' END AS final_status
FROM c"""

QUERIES["clarification_timeout"] = q_clarification_timeout
ORACLE["clarification_timeout"] = CLAR_SQL
