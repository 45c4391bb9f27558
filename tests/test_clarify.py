"""Clarification requests, comment lines, map merge, artefacts."""

from pyspark.sql import functions as F

from relaylake.operators import clarify as C
from relaylake.sinks import artifacts


def conv(spark):
    return spark.createDataFrame([
        (1, 0, "user", "Which table?"), (1, 1, "assistant", "main.silver.t"), (1, 2, "user", "Mode?"),
        (1, 3, "assistant", "append"), (2, 0, "system", "hi"), (2, 1, "user", "Repo?")],
        "conv_id long, turn long, role string, text string")


def test_pairs_requests_and_lines(spark):
    p = C.qa_pairs(conv(spark))
    assert {(r.conv_id, r.turn): r.answer for r in p.collect()} == {(1, 0): "main.silver.t", (1, 2): "append", (2, 1): None}
    reqs = {r.work_item_id: r.status for r in C.requests(p).collect()}
    assert reqs == {1: "answered", 2: "pending"}
    lines = C.comment_lines(p, C.requests(p).where(F.col("status") == "answered")).orderBy("line_no").collect()
    text = "\n".join(r.line for r in lines)
    assert text == ("[Agent Clarification Record] request_id=clr-1\nQ: Which table?\nA: main.silver.t\n"
                    "Q: Mode?\nA: append")


def test_merge_maps_right_wins(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": "4"})], "l map<string,string>, r map<string,string>")
    got = df.select(C.merge_maps(F.col("l"), F.col("r")).alias("m")).first().m
    assert got == {"a": "1", "b": "3", "c": "4"}


def test_artifact_texts(spark):
    p = spark.createDataFrame([(7, "dev", "main", "bronze", "t", "append", ["create_unity_catalog_table"], "T", 2, "repo",
                                "feature/pbi-7-t", ["jdbc", "flat_file"])],
                              "work_item_id long, environment string, target_catalog string, target_schema string, "
                              "target_table string, ingestion_mode string, notebook_tasks array<string>, title string, "
                              "priority int, target_repo string, branch_name string, source_types array<string>")
    spec = artifacts.job_specs(p).first().spec
    assert spec == ("# local simulation artifact\nwork_item_id: 7\nenvironment: dev\ntarget_table: main.bronze.t\n"
                    "ingestion_mode: append\nnotebook_tasks:\n  - create_unity_catalog_table\n")
    note = artifacts.change_notes(p).first()
    assert note.path == "generated_changes/work_item_7.md"
    assert note.note.splitlines()[-1] == "Source Types: jdbc, flat_file"


def test_document_entries_hold_every_question(spark):
    from relaylake.operators import clarify as C

    turns = [(1, 2 * i, f"q{i % 70}", f"a{i}" if i != 75 else None) for i in range(80)] + [(2, 0, "only", None), (3, 0, None, "x")]
    pairs = spark.createDataFrame(turns, "conv_id long, turn long, question string, answer string")
    rows = C.clarification_entries(C.answered_questions(pairs), C.requests(pairs)).collect()
    one = [r for r in rows if r.work_item_id == 1]
    assert len(one) == 5 and max(len(r.questions) for r in one) <= C.ENTRY_QUESTIONS
    answers = {q: r.answers.get(q) for r in one for q in r.questions}
    # a repeated question keeps its latest answer
    assert answers == {f"q{i}": f"a{i + 70}" if i < 10 and i != 5 else f"a{i}" for i in range(70)}
    two = [r for r in rows if r.work_item_id == 2]
    assert [(r.questions, r.answers, r.status, r.responder) for r in two] == [(["only"], {}, "pending", None)]
    assert not [r for r in rows if r.work_item_id == 3]
