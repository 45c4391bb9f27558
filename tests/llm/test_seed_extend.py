"""Repeated word passages against a table of all windows."""

import hashlib
import random

import pytest

from relaylake.llm import seed_extend as se

SCHEMA = "doc_id long, text string, at string, g string, words string"


def brute(rows, length):
    """(doc_id, words, removed, hash of the rest) of each row, null ids last."""
    key = lambda i: (i is None, i or 0)
    words = [(r[0], (r[1] or "").encode().split()) for r in rows]
    least = {}
    for i, w in words:
        for p in range(len(w) - length + 1):
            g = tuple(w[p:p + length])
            least[g] = min(least.get(g, key(i)), key(i))
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - length + 1):
            if least[tuple(w[p:p + length])] < key(i):
                gone.update(range(p, p + length))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, vocab, n):
    rng = random.Random(seed)
    word = lambda: rng.choice(vocab)
    new = lambda k: [word() for _ in range(k)]
    passages = [new(k) for k in (6, 9, 12, 20, 40)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += new(rng.randint(0, 12)) + (rng.choice(passages)[rng.randint(0, 5):] if rng.random() < 0.8 else [])
        rows.append((rng.randint(0, 2 * n), rng.choice([" ", "\n", " \t\r\n\x0b\x0c "]).join(w), "", "", ""))
    for _ in range(n // 2):  # near copies
        i, text, *_ = rng.choice(rows)
        w = text.split()
        for _ in range(rng.randint(0, 3)):
            w.insert(rng.randint(0, len(w)), word())
        rows.append((rng.randint(0, 3 * n), " ".join(w), "", "", ""))
    return rows + [(9000, None, None, None, None), (9001, "", "", "", ""), (None, rows[3][1], "", "", ""), (None, rows[3][1] + " x", "", "", ""),
                   rows[5], rows[5], (9002, "z " * 60, "", "", ""), (9003, "z\n" * 40, "", "", ""), (9004, "é " * 30 + "z " * 30, "", "", "")]


@pytest.mark.parametrize("seed,length,gram,size", [(1, 8, 3, 40), (2, 8, 8, 40), (3, 5, 1, 4), (4, 12, 4, 300)])
def test_equals_all_windows(spark, seed, length, gram, size):
    rows = corpus(seed, [f"w{k}" for k in range(size)] + ["ü", " "], 40)
    docs = spark.createDataFrame(rows, SCHEMA)
    out = se.without_repeats(docs, length, gram).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in out), key=repr)
    assert got == brute(rows, length)
    texts = {}
    for r in rows:
        texts.setdefault(r[0], []).append((r[1] or "").encode().split())
    for r in out:  # each repeat is where it says
        for x in r.repeats:
            src = None if x.src_id == se.base_columns.__globals__["NULL_ID"] else x.src_id
            assert any(a[x.s:x.e] == b[x.src_s:x.src_s + x.e - x.s] for a in texts[r.doc_id] for b in texts[src])


def test_hot_group_stays_linear(spark):
    """A passage in 400 documents, each between its own words."""
    rng = random.Random(8)
    shared = [f"p{k}" for k in range(30)]
    rows = [(i, " ".join([f"a{i}_{k}" for k in range(rng.randint(0, 15))] + shared + [f"b{i}_{k}" for k in range(15)]), "", "", "") for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert se.matches(docs, 20, 5).count() <= 400 * 30
    got = sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in se.without_repeats(docs, 20, 5).collect()), key=repr)
    assert got == brute(rows, 20)


def test_query_and_empty_table(spark, tmp_path):
    rows = corpus(5, [f"w{k}" for k in range(400)], 20)
    shared = " ".join(f"s{k}" for k in range(120))
    rows += [(300, "left " + shared + " right", "", "", ""), (301, shared.split(" ", 30)[-1] + " other", "", "", ""), (299, " ".join(shared.split()[:49]), "", "", "")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in se.op12_seed_extend(spark, str(tmp_path)).collect()), key=repr)
    assert got == brute(rows, 50)
    assert se.without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_row_over_blocks(spark, monkeypatch):
    """Windows over the edges of blocks (the constant is read on the driver's side only here)."""
    import numpy as np
    words = np.random.default_rng(1).integers(0, 1 << 60, 500).astype(np.uint64)
    whole = se.anchor_runs(words, np.array([500]), 20, 5)
    parts = [[x + b if k < 3 else x for k, x in enumerate(se.anchor_runs(words[b:b + 100 + 19], np.array([500]) - b, 20, 5))] for b in range(0, 500, 100)]
    windows = lambda runs: {(w, a, int(g)) for lo, hi, at, g in runs for w, a in zip(range(lo, hi + 1), [at] * (hi - lo + 1))}
    assert windows(zip(*whole)) == set().union(*(windows(zip(*p)) for p in parts))
