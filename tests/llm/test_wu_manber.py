"""Benchmark search against a brute force over word lists."""

import hashlib
import random
import re

import pytest

from relaylake.llm import wu_manber as wm

SCHEMA = "doc_id long, text string, lang string, _id string, hits string"


def words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def brute(docs, bench, window=10):
    strings = {}
    for item, text in bench:
        w = words(text)
        m = min(len(w), window)
        for i in range(len(w) - m + 1 if m else 0):
            strings.setdefault(tuple(w[i:i + m]), set()).add(str(item))
    out = []
    for d in docs:
        w = words(d[1])
        hit, items = set(), set()
        for m in {len(k) for k in strings}:
            for i in range(len(w) - m + 1):
                got = strings.get(tuple(w[i:i + m]))
                if got is not None:
                    hit.update(range(i, i + m))
                    items |= got
        out.append((d[0], len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("table_bits,filter_bits", [(18, 24), (3, 5)])
def test_equals_brute_force(spark, table_bits, filter_bits):
    rng = random.Random(7)
    vocab = ["alpha", "Beta", "gamma", "délta", "x1", "the", "Of"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", " -- "]) for _ in range(n))
    bench = [(i, text(rng.choice([0, 1, 2, 4, 9, 10, 11, 25]))) for i in range(14)] + [(3, None), (77, "alpha beta gamma")]
    bench.append((78, bench[5][1]))
    docs = [(i, text(rng.randint(0, 200)), "en", "", "") for i in range(60)]
    docs += [(100 + i, text(20) + bench[i][1] + text(30), "en", "", "") for i in range(14)]
    docs += [(200, None, None, None, None), (None, "alpha beta gamma", "en", "", ""), (201, text(4000), "en", "", ""), docs[0], (202, "", "", "", "")]
    bench = [b for b in bench if len(words(b[1])) != 1]
    got = wm.contamination(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(bench, "item_id long, text string"), table_bits=table_bits, filter_bits=filter_bits)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, bench)


def test_single_words_empty_tables_and_filter(spark):
    docs = [(1, "clean words only"), (2, "a secret stays"), (3, None)]
    table = spark.createDataFrame([(*d, "x", None, None) for d in docs], SCHEMA)
    bench = spark.createDataFrame([(5, "SECRET!"), (None, "...")], "item_id long, text string")
    got = sorted(tuple(r) for r in wm.contamination(table, bench).collect())
    assert got == brute(docs, [(5, "SECRET!")])
    kept = wm.drop_contaminated(table, bench)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert wm.contamination(table, bench.limit(0)).where("contaminated").count() == 0
    assert wm.contamination(table.limit(0), bench).count() == 0
