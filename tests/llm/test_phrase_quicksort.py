"""Phrase collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from relaylake.llm import phrase_quicksort as pq

SCHEMA = "doc_id long, text string, lang string, phrase string, f string, k string"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, max_words, least, contained, top):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII_LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    candidates = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    covered = Counter()
    for (lang, w), a in candidates.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                covered[lang, w[i:i + m]] = max(covered[lang, w[i:i + m]], a)
    out = []
    for (lang, w), a in candidates.items():
        if covered[lang, w] and 100 * covered[lang, w] >= contained * a:
            continue
        score, k = min((1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    ranked = []
    for lang in n:
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(x[0], r, *x[1:]) for r, x in enumerate(mine[:top], 1)]
    return sorted(ranked)


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["The", "of", "a", "Ünder", "x'y", "z-", "É", "tab", "end"] + [f"w{k}" for k in range(40)]
    weights = [40, 25, 20] + [3] * (len(vocab) - 3)
    rows = []
    for i in range(120):
        w = rng.choices(vocab, weights, k=rng.randint(0, 60))
        for _ in range(3):
            w.insert(rng.randint(0, len(w)), rng.choice(["New York City", "new york", "hot pair", "a a a a", "of the end"]))
        text = "".join(x + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "! ", "\x0b", " "]) for x in w)
        rows.append((i, text, rng.choice(["en", "en", "de", None]), "", "", ""))
    return rows + [rows[0], rows[0], (500, None, "en", None, None, None), (501, "", None, "", "", ""), (502, "hot pair " * 300, "en", "", "", ""),
                   (503, "only words in fr " * 3, "fr", "", "", ""), (None, "null id", "und", "", "", "")]


def test_three_way_counts_prefixes():
    rng = np.random.default_rng(3)
    for trial in range(60):
        n, deep = int(rng.integers(1, 80)), int(rng.integers(1, 4))
        keys = rng.integers(0, rng.integers(1, 7), (n, deep))
        stop = rng.integers(0, deep + 1, n)
        keys[np.arange(deep)[None, :] >= stop[:, None]] = -1
        weight = rng.integers(1, 4, n)
        begin = np.unique(np.append(0, rng.integers(0, n, 3)))
        group = np.searchsorted(begin, np.arange(n), side="right")
        least = int(rng.integers(1, 6))
        want = Counter()
        for g, row, w, s in zip(group.tolist(), keys.tolist(), weight.tolist(), stop.tolist()):
            for d in range(1, s + 1):
                want[g, tuple(row[:d])] += w
        got = [((int(group[i]), tuple(keys[i, :d].tolist())), int(c)) for d, own, count in pq.three_way(keys, weight, begin, least) for i, c in zip(own, count)]
        assert len(got) == len(dict(got))
        assert dict(got) == {x: c for x, c in want.items() if c >= least}


@pytest.mark.parametrize("seed,max_words,least,contained,split", [(1, 3, 10, 50, 8), (2, 3, 4, 80, 1 << 20), (3, 2, 3, 50, 40), (4, 4, 3, 60, 60), (5, 3, 2, 50, 1)])
def test_equals_plain_counts(spark, seed, max_words, least, contained, split):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, SCHEMA)
    found = pq.best(pq.collocations(docs, max_words, least, contained, split), 25)
    got = sorted(tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == brute(rows, max_words, least, contained, 25)


def test_long_text_in_parts(spark, tmp_path, monkeypatch):
    rows = corpus(6) + [(900, "a long text without ends " * 200, "en", "", "", "")]
    monkeypatch.setattr(pq, "SLICE_BYTES", 700)
    import pyarrow as pa
    for text in (rows[0][1] * 40, "no piece ends " * 200, "x. " * 900, "end at last " * 100 + "."):
        part = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], names=["lang", "text"])
        parts = [bytes(data) for _, data, _ in pq.short_parts(part)]
        assert b"".join(parts).decode() == text.translate(ASCII_LOWER)
        assert all(p[-1:] in b".,;:!?\n\x0b\x0c\r" for p in parts[:-1])
    monkeypatch.undo()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in pq.op11_phrase_quicksort(spark, str(tmp_path)).collect())
    assert got == brute(rows, 3, 10, 50, 2000)


def test_dealing_holds_little_memory(monkeypatch):
    """12 MB of texts in one Arrow batch: a task's arrays stay under 160 MB."""
    import tracemalloc

    import pyarrow as pa

    class Docs:
        def mapInArrow(self, deal, schema):
            return deal

    monkeypatch.setattr(pq, "texts_of", lambda docs: docs)
    rng = np.random.default_rng(8)
    vocab = np.array([f"word{k}" for k in range(50_000)])
    texts = [" ".join(vocab[rng.integers(0, 50_000, 600)]) + "." for _ in range(2200)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], names=["lang", "text"])
    hot = [{("en", f"word{k}") for k in range(30)}]
    tracemalloc.start()
    pool = pa.total_allocated_bytes()
    n = most = 0
    for part in pq.suffixes(Docs(), hot, 3)(iter([batch])):
        n += int(pq.utf8(part.column("weights"))[0].view(np.int64).sum())
        most = max(most, pa.total_allocated_bytes() - pool)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 2200 * 600
    assert peak + most < 160 << 20


@pytest.mark.parametrize("extra", [0, 50])
def test_hot_words_by_either_way(extra):
    import pyarrow as pa

    words = pa.array(["a", "b", "é", "c"], pa.large_string())
    strings = {("en", "a"), ("de", "é"), ("fr", "b")} | {("en", f"x{k}") for k in range(extra)}
    assert pq.codes_of(strings, ["en", "de"], words).tolist() == [[True, False, False, False], [False, False, True, False]]


def test_empty_table(spark):
    assert pq.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_exact_beyond_64_bits(spark):
    a, l, r = 10**13, 3 * 10**13, 7 * 10**13
    spark.createDataFrame([(a, l, r)], "a long, l long, r long").createOrReplaceTempView("big_counts")
    got = spark.sql("SELECT cast((cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0)))) div (cast(l as decimal(19,0)) * cast(r as decimal(18,0))) as bigint) AS s FROM big_counts").first()[0]
    assert got == 1000000 * a * a // (l * r)
