"""Repeated strings against a table of all windows."""

import hashlib
import random
from collections import Counter

import pytest

from relaylake.llm import bwt_repeats as br

SCHEMA = "doc_id long, text string, starts string, _row string, bytes string"


def brute(rows, length):
    texts = [(r[1] or "").encode() for r in rows]
    often = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for row, t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if often[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((row[0], len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_expansion_equals_all_windows():
    rng = random.Random(4)
    for trial in range(40):
        length = rng.choice([3, 5, 12, 40])
        alphabet = b"ab" if trial % 2 else b"abcdefgh"
        parts = [bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 120))) for _ in range(rng.randint(1, 8))]
        if trial % 3 == 0:
            parts += [parts[0][10:80] + b"x" + parts[-1][:50], parts[0]]
        often = Counter(p[i:i + length] for p in parts for i in range(len(p) - length + 1))
        want = [[i for i in range(len(p) - length + 1) if often[p[i:i + length]] > 1] for p in parts]
        assert [x.tolist() for x in br.repeated_places(parts, length)] == want


def corpus(seed):
    rng = random.Random(seed)
    new = lambda n: "".join(rng.choice("abcdefghij é\n") for _ in range(n))
    passages = [new(n) for n in (30, 45, 60, 90, 200, 400)]
    rows = []
    for i in range(60):
        text = "".join(new(rng.randint(0, 150)) + (rng.choice(passages)[rng.randint(0, 10):] if rng.random() < 0.8 else "") for _ in range(rng.randint(0, 5)))
        rows.append((i, text, "", "", ""))
    rows += [(100 + i, rows[i][1][:-7] + new(5) + rows[i][1][-3:], "", "", "") for i in range(20)]
    rows += [(200, "z" * 500, "", "", ""), (201, None, None, None, None), (202, "", "", "", ""), (None, new(300), "", "", ""), rows[7], (7, new(100), "", "", ""),
             (203, "ab" * 300, "", "", "")]
    return rows


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"max_contexts": 3, "bucket_bytes": 2000})])
def test_equals_brute_force(spark, tmp_path, seed, options):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, SCHEMA)
    out = br.without_repeats(docs, 40, anchor=20, **options).collect()
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans) // 2, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out), key=repr)
    assert got == brute(rows, 40)


def test_query_and_empty_table(spark, tmp_path):
    rows = corpus(3)
    shared = "".join(random.Random(9).choice("abcdefgh ") for _ in range(900))
    rows += [(300, "left " + shared + " right", "", "", ""), (301, shared[100:] + " other", "", "", ""), (302, shared[:450], "", "", ""), (303, shared[300:699], "", "", "")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in br.op5_bwt_repeats(spark, str(tmp_path)).collect()), key=repr)
    assert got == brute(rows, 400)
    assert br.without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
