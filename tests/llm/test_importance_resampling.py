"""Importance resampling against plain strings and zlib."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from relaylake.llm import importance_resampling as ir

SCHEMA = "doc_id long, text string, score string, rank string, _row string, word string"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))
    return w, [zlib.crc32(x.encode()) % 10000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def brute(rows, target, percent=25, min_words=20, seed=7):
    s, t = Counter(), Counter()
    for r in rows:
        s.update(features(r[1])[1])
    for x in target:
        t.update(features(x)[1])
    S, T = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log(((t[b] + 1) * (S + 10000)) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)}
    out = []
    for i, text, *_ in rows:
        w, f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= min_words])
    able = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    drawn = able[:percent * len(able) // 100]
    for x in out:
        x[4] = next((k for k, y in enumerate(drawn, 1) if y is x), None)
    return sorted(map(tuple, out), key=repr)


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocab = ["The", "a", "Ünder", "z9", "x" * 70, "é" * 90, "word"] + [f"v{k}" for k in range(60)]
    sep = [" ", " ", ", ", "\n", "--", "\x7f", "  ", "'"]
    text = lambda: "".join(rng.choice(vocab) + rng.choice(sep) for _ in range(rng.choice([0, 1, 5, 19, 20, 40, 90])))
    rows = [(i, text(), "", "", "", "") for i in range(n)]
    rows += [(900, None, None, None, None, None), (901, "", "", "", "", ""), (902, " .. ", "", "", "", ""), (None, rows[0][1], "", "", "", "")]
    return rows, [text() for _ in range(15)] + [None, ""]


def test_composed_checksums():
    rng = random.Random(2)
    pairs = [(rng.randbytes(rng.randint(0, 30)), rng.randbytes(rng.choice([0, 1, 7, 63, 64, 65, 200]))) for _ in range(200)]
    crc = lambda x: np.array([zlib.crc32(y) for y in x], dtype=np.uint32)
    got = ir.composed(crc(a for a, _ in pairs), crc(b for _, b in pairs), np.array([len(b) for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


@pytest.mark.parametrize("seed,words", [(1, 0), (2, 10), (3, 1 << 16)])
def test_equals_plain_strings(spark, seed, words):
    """Whatever part of the words the dictionary holds."""
    rows, target = corpus(seed)
    docs, aim = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(x, "") for x in target], "text string, word string")
    assert len(ir.frequent_words(docs, words)) == min(words, len({w for r in rows for w in features(r[1])[0] if len(w.encode()) <= 64}))
    got = sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in ir.resampled(docs, aim, words=words).collect()), key=repr)
    assert got == brute(rows, target)


def test_ties_and_repeated_rows(spark):
    rows = [(i % 3, "one two three", "", "", "", "") for i in range(60)] + [(None, "one two three", "", "", "", "")] * 10
    docs = spark.createDataFrame(rows, SCHEMA)
    out = ir.resampled(docs, spark.createDataFrame([("one",)], "text string"), percent=50, min_words=3).collect()
    assert sorted(r["rank"] for r in out if r["rank"]) == list(range(1, 36))
    order = [(-r.score, r.doc_id is None, r.doc_id or 0) for r in sorted((r for r in out if r["rank"]), key=lambda r: r["rank"])]
    assert order == sorted(order)
    last = order[-1]
    assert all((-r.score, r.doc_id is None, r.doc_id or 0) >= last for r in out if not r["rank"])


def test_query_and_empty_tables(spark, tmp_path):
    rows, target = corpus(4, 60)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, x) for k, x in enumerate(target)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((tuple(r) for r in ir.op13_importance_resampling(spark, str(tmp_path)).collect()), key=repr)
    assert got == brute(rows, target)
    none = spark.createDataFrame([], SCHEMA)
    assert ir.resampled(none, none).count() == 0
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in ir.resampled(docs, none).collect()), key=repr)
    assert got == brute(rows, [])
