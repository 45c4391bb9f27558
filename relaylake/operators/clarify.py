"""Clarification requests, answers and their effect on plans.

Operators W7, F3, F5, C12, C13, C14, C29, E5, S5, B12.

Answers are carried as an ordered ``array<struct<q, a>>`` (question order
matters: the first repository answer wins), and converted to a map only
where order no longer matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relaylake.functions import text as T

MAX_QUESTIONS = 5  # a plan asks at most the five fixed questions


def qa_pairs(conversations: DataFrame) -> DataFrame:
    """Every user turn with the text of the following turn as its answer.

    A self equi-join on (conv_id, turn + 1) instead of ``lead`` over a
    window: no single conversation has to be sorted in one task."""
    q = conversations.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("question"))
    a = conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return q.join(a, ["conv_id", "turn"], "left")


def requests(pairs: DataFrame) -> DataFrame:
    """One clarification request per conversation; answered when every
    question has an answer, otherwise pending."""
    return pairs.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_questions"),
        F.bool_and(F.col("answer").isNotNull()).alias("_all")) \
        .select(F.concat(F.lit("clr-"), F.col("conv_id").cast("string")).alias("request_id"),
                F.col("conv_id").alias("work_item_id"), "n_questions",
                F.when(F.col("_all"), F.lit("answered")).otherwise(F.lit("pending")).alias("status"))


ENTRY_QUESTIONS = 32  # questions in one entry of a state document


def answered_questions(pairs: DataFrame) -> DataFrame:
    """Each question of a conversation once, with its latest answer if any."""
    latest = F.max(F.when(F.col("answer").isNotNull(), F.struct("turn", "answer")))
    return pairs.where(F.col("question").isNotNull()).groupBy("conv_id", "question").agg(F.min("turn").alias("turn"), latest["answer"].alias("answer"))


def clarification_entries(questions: DataFrame, requests: DataFrame, size: int = ENTRY_QUESTIONS) -> DataFrame:
    """A3: clarification entries as a state document holds them: questions and
    the answers by question. An entry takes the questions of ``size`` turns; a
    request with more has several, so none grows with its conversation."""
    ids = requests.select(F.col("work_item_id").alias("conv_id"), "request_id", "work_item_id", "status")
    q = F.struct("turn", "question", "answer")
    grouped = (questions.withColumn("part", F.expr(f"turn div {size}")).groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(q)).alias("qs"))
               .join(ids, "conv_id"))
    answered = F.filter("qs", lambda x: x["answer"].isNotNull())
    return grouped.select(
        "request_id", "work_item_id", F.transform("qs", lambda x: x["question"]).alias("questions"), "status",
        F.map_from_arrays(F.transform(answered, lambda x: x["question"]), F.transform(answered, lambda x: x["answer"])).alias("answers"),
        F.lit("agent").alias("requester"), F.when(F.col("status") == "answered", F.lit("conversation")).alias("responder"))


def comment_lines(pairs: DataFrame, answered: DataFrame) -> DataFrame:
    """The discussion comment as ordered lines (header, then Q:/A:
    per answered question), one row per line; joining them with newlines is
    left to the sink so no conversation is concatenated in one task."""
    ids = answered.select(F.col("work_item_id").alias("conv_id"), "request_id")
    p = pairs.where(F.col("answer").isNotNull()).join(ids, "conv_id")
    header = ids.select("request_id", F.lit(0).cast("bigint").alias("line_no"),
                        F.concat(F.lit("[Agent Clarification Record] request_id="), F.col("request_id")).alias("line"))
    qs = p.select("request_id", (F.col("turn") * 2 + 1).alias("line_no"), F.concat(F.lit("Q: "), F.col("question")).alias("line"))
    an = p.select("request_id", (F.col("turn") * 2 + 2).alias("line_no"), F.concat(F.lit("A: "), F.col("answer")).alias("line"))
    return header.unionByName(qs).unionByName(an)


def answers_for_plans(plans: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pair the i-th open question of a plan with the i-th answered question
    of the ticket's conversation (ticket id = conversation id).

    Only the first five pairs of a conversation can match, so the ranking
    is filtered before anything is collected; the collected list per plan
    holds at most five entries."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    # the limit on the bare row number lets Spark cut each group before the sort's exchange
    ranked = pairs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= MAX_QUESTIONS).withColumn("idx", F.col("_rn") - 1).drop("_rn")
    qs = plans.select("work_item_id", F.posexplode("clarification_questions").alias("idx", "q"))
    j = qs.join(ranked.select(F.col("conv_id").alias("work_item_id"), "idx", F.col("answer").alias("a")),
                ["work_item_id", "idx"])
    return j.groupBy("work_item_id").agg(
        F.array_sort(F.collect_list(F.struct("idx", "q", F.coalesce(F.col("a"), F.lit("")).alias("a")))).alias("_e")) \
        .select("work_item_id", F.transform("_e", lambda e: F.struct(e["q"].alias("q"), e["a"].alias("a"))).alias("answers"))


def normalize_answers(entries: Column) -> Column:
    """strip values, drop blank ones."""
    stripped = F.transform(entries, lambda e: F.struct(e["q"].alias("q"), T.strip(e["a"]).alias("a")))
    return F.filter(stripped, lambda e: e["a"] != "")


def answered(question: Column, entries: Column) -> Column:
    """Does any answer settle the question? The five fixed cases."""
    qk = F.lower(question)

    def hit(e):
        cand = F.concat(F.lower(e["q"]), F.lit(" "), F.lower(e["a"]))
        return ((qk.contains("catalog") & e["a"].contains("."))
                | (qk.contains("source type") & T.contains_any(cand, ["jdbc", "flat", "volume", "csv"]))
                | (qk.contains("append or overwrite") & T.contains_any(cand, ["append", "overwrite"]))
                | (qk.contains("repository") & (T.strip(e["a"]) != ""))
                | (qk.contains("acceptance criteria") & (T.strip(e["a"]) != "")))
    return F.exists(entries, hit)


def repo_from_answers(entries: Column) -> Column:
    """C14: the first answer to a question that mentions a repository,
    cleaned; if it cleans to empty the plan keeps its repo."""
    first = F.get(F.filter(entries, lambda e: F.lower(e["q"]).contains("repository")), 0)
    cleaned = F.btrim(F.regexp_replace(F.replace(T.strip(first["a"]), F.lit("repo:"), F.lit("")),
                                       "[^a-zA-Z0-9_.-]+", "-"), F.lit("-"))
    return F.nullif(cleaned, F.lit(""))


def apply_answers(plans_with_answers: DataFrame) -> DataFrame:
    """Apply answers (column ``answers``) to plan columns."""
    df = plans_with_answers.withColumn("_n", normalize_answers(F.coalesce(
        F.col("answers"), F.array().cast("array<struct<q:string,a:string>>"))))
    blob = F.lower(F.array_join(F.transform("_n", lambda e: e["a"]), " "))
    df = df.withColumn("_b", blob)
    b = F.col("_b")
    df = df.withColumn("_m", T.table_match(b))
    parts = F.split(F.col("_m"), r"\.")
    hit = F.col("_m") != ""
    jd, ff = T.has_jdbc(b), T.has_flat_file(b)
    new_sources = F.array_sort(F.array_compact(F.array(F.when(jd, F.lit("jdbc")), F.when(ff, F.lit("flat_file")))))
    repo = repo_from_answers(F.col("_n"))
    df = df.withColumns({
        "target_catalog": F.when(hit, F.get(parts, 0)).otherwise(F.col("target_catalog")),
        "target_schema": F.when(hit, F.get(parts, 1)).otherwise(F.col("target_schema")),
        "target_table": F.when(hit, F.get(parts, 2)).otherwise(F.col("target_table")),
        "ingestion_mode": F.when(b.contains("overwrite"), F.lit("overwrite"))
                           .when(b.contains("append"), F.lit("append")).otherwise(F.col("ingestion_mode")),
        "source_types": F.when(jd | ff, new_sources).otherwise(F.col("source_types")),
        "target_repo": F.coalesce(repo, F.col("target_repo")),
        "clarification_questions": F.filter("clarification_questions", lambda q: ~answered(q, F.col("_n"))),
    })
    return df.withColumn("needs_clarification", F.size("clarification_questions") > 0).drop("_b", "_m") \
        .withColumnRenamed("_n", "applied_answers")


def merge_maps(left: Column, right: Column) -> Column:
    """Map merge where the right side wins, without relying on the
    session's map-key dedup policy."""
    return F.map_concat(F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k)), right)


def entries_to_map(entries: Column) -> Column:
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["q"], e["a"])))


def clarification_status(plans: DataFrame, reqs: DataFrame, pairs: DataFrame) -> DataFrame:
    """E5: status gate per plan that needed clarification and has a request:
    pending → not completed; answered but questions remain → incomplete."""
    need = plans.where(F.col("needs_clarification"))
    ans = answers_for_plans(need, pairs)
    applied = apply_answers(need.join(ans, "work_item_id", "left"))
    r = reqs.select("work_item_id", F.col("status").alias("request_status"))
    j = applied.join(r, "work_item_id")
    status = (F.when(F.col("request_status") != "answered", F.col("request_status"))
              .when(F.col("needs_clarification"), F.lit("incomplete"))
              .otherwise(F.lit("answered")))
    return j.withColumn("clarification_status", status)


CLARIFICATION_STEP_MINUTES = 10


def clarification_events(conversations: DataFrame) -> DataFrame:
    """X3 input: one request per conversation at its first user turn, and an
    ``answered`` submission at its last turn when every question has an
    answer. Turns are ``CLARIFICATION_STEP_MINUTES`` apart from a
    per-conversation start (2024-01-01 plus ``conv_id`` hours)."""
    pairs = qa_pairs(conversations)
    per = conversations.groupBy("conv_id").agg(
        F.min(F.when(F.col("role") == "user", F.col("turn"))).alias("t0"), F.max("turn").alias("tmax"))
    done = requests(pairs).select(F.col("work_item_id").alias("conv_id"), "status", "n_questions")
    j = per.join(done, "conv_id").where(F.col("t0").isNotNull())
    base = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("conv_id").cast("int"))

    def at(turn):
        return base + F.make_dt_interval(mins=(turn * CLARIFICATION_STEP_MINUTES).cast("int"))

    rid = F.concat(F.lit("clr-"), F.col("conv_id").cast("string"))
    common = [rid.alias("request_id"), F.lit("clarification").alias("stage"), F.col("conv_id").alias("work_item_id"),
              F.concat(F.lit("questions="), F.col("n_questions").cast("string")).alias("summary"),
              F.lit(None).cast("string").alias("comment")]
    req = j.select(*common, F.lit("requested").alias("event"), F.lit("agent").alias("actor"), at(F.col("t0")).alias("ts"),
                   (F.col("conv_id") * 2).alias("seq"))
    ans = j.where(F.col("status") == "answered").select(
        *common, F.lit("answered").alias("event"), F.lit("responder").alias("actor"), at(F.col("tmax")).alias("ts"),
        (F.col("conv_id") * 2 + 1).alias("seq"))
    return req.unionByName(ans)
