"""Repeated line runs against a quadratic search over line lists."""

import hashlib
import random
import re

import pytest

from relaylake.llm import line_runs as lr

SCHEMA = "doc_id long, text string, n_chars int, piece string, r0 string"
BLANK = "\x20\t\n\x0b\x0c\r"


def brute(rows, min_words):
    """doc index → numbers of its lines (with a word) that go."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    lines = {i: [x.strip(BLANK) for x in (rows[i][1] or "").split("\n") if x.strip(BLANK)] for i in order}
    places = [(i, p) for i in order for p in range(len(lines[i]))]
    gone = {i: set() for i in order}
    for n, (i, p) in enumerate(places):
        best = 0
        for j, q in places[:n]:
            m = 0
            while p + m < len(lines[i]) and q + m < len(lines[j]) and lines[i][p + m] == lines[j][q + m]:
                m += 1
            best = max(best, m)
        if sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines[i][p:p + best]) >= min_words:
            gone[i].update(range(p, p + best))
    return gone


def rest_of(text, gone):
    at = [k for k, x in enumerate((text or "").split("\n")) if x.strip(BLANK)]
    drop = {at[g] for g in gone}
    return "\n".join(x for k, x in enumerate((text or "").split("\n")) if k not in drop)


@pytest.mark.parametrize("seed,min_words", [(1, 4), (2, 9), (3, 1)])
def test_equals_brute_force(spark, seed, min_words):
    rng = random.Random(seed)
    vocab = ["a b", "c", "d e f", "g", " ", "", "h i\t", "ü j"]
    rows = [(i, "\n".join(rng.choice(vocab) for _ in range(rng.randint(0, 25))), 0, "", "") for i in range(12)]
    rows += [(50 + i, "\n".join(f"u{rng.randint(0, 40)} x" for _ in range(20)), 0, "", "") for i in range(8)]
    rows += [(90, rows[4][1], 0, "", ""), (91, "\n".join(["same line here"] * 20), 0, "", ""), (92, None, None, None, None), (93, "", 0, "", ""),
             (None, rows[13][1], 0, "", "")]
    want = brute(rows, min_words)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r._doc.doc_id: r for r in lr.without_copies(docs, min_words).collect()}
    for i, row in enumerate(rows):
        assert set(got[row[0]]._gone or []) == want[i], (row[0], row[1])
        assert got[row[0]].text == (row[1] if row[1] is None else rest_of(row[1], want[i]))
    kept = lr.dedup_lines(docs, min_words)
    assert kept.columns == docs.columns
    left = {r.doc_id for r in kept.collect()}
    for i, row in enumerate(rows):
        n = len([x for x in (row[1] or "").split("\n") if x.strip(BLANK)])
        assert (row[0] in left) == (n == 0 or len(want[i]) < n)


def test_repeated_rows_and_empty_tables(spark):
    text = "\n".join(f"line {i} of a long text" for i in range(30))
    docs = spark.createDataFrame([(1, text, 0, "", ""), (1, text, 0, "", ""), (2, "own\n" + text + "\nend", 0, "", "")], SCHEMA)
    got = sorted((r.doc_id, r.text) for r in lr.dedup_lines(docs).collect())
    assert got == [(1, text), (1, text), (2, "own\nend")]
    assert lr.dedup_lines(docs.limit(0)).count() == 0


def test_clashing_column_names(spark):
    text = "\n".join(f"line {i} of a long text" for i in range(30))
    names = ["_g_id", "_g_h", "_gone", "_had", "_doc", "_id", "_h", "i", "gone", "piece.x"]
    docs = spark.createDataFrame([(1, text, *names), (2, text + "\nend", *names), (None, None, *[None] * len(names)), (3, text, *names)],
                                 "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = sorted((tuple(r) for r in lr.dedup_lines(docs).collect()), key=repr)
    assert got == sorted([(1, text, *names), (2, "end", *names), (None, None, *[None] * len(names))], key=repr)


def test_query_digest(spark, tmp_path):
    text = "\n".join(f"line {i} of a long text" for i in range(30))
    spark.createDataFrame([(1, text, 0, "", ""), (2, "own\n" + text + "\nend", 0, "", ""), (3, None, 0, "", "")], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = sorted(tuple(r) for r in lr.op10_line_runs(spark, str(tmp_path)).collect())
    assert got == [(1, 30, 0, 0, sha(text)), (2, 32, 30, 1, sha("own\nend")), (3, 0, 0, 0, sha(""))]


def test_rows_of_lines_are_not_broadcast(spark, monkeypatch):
    """Their compressed files say little of how large they are (F1)."""
    plans, write = {}, lr.stored
    monkeypatch.setattr(lr, "stored", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and write(df, name))
    text = "\n".join(f"one two three {k}" for k in range(9))
    docs = spark.createDataFrame([(i, text, 0, "", "") for i in range(3)], SCHEMA)
    assert [r.text for r in lr.dedup_lines(docs, 4).collect()] == [text]
    assert plans["runs-named"].count("SortMergeJoin") == 2 and "BroadcastHashJoin" not in plans["runs-named"]
