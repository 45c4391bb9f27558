"""Token operators against the library and a sequential brute force."""

import random
import zlib

import numpy as np
import pytest

from relaylake.llm import mixture_packing as mp
from relaylake.llm import overlap_counts as oc
from relaylake.llm.tokens import ByteCounter, WordEncoder, load_tokenizer, tokenizer_path

ODD = ["", " ", "a  b", "a \n b", "\n a", "a\n \nb", "a\n ", " \n", "<|endoftext|> x<|endoftext|>y", "a\x1cb c",
       "it's 'll '", "café ́a", "a b", "ΑΣ ΑΣ.", "İ I", "aaaaaaa", "ÿ þ ¼²ª", "<|startoftext|>hey",
       "\x00\x01 a\x85b\xa0c", "wwww.....!!!! 123456 a1b2", "日本語 テキスト", "👩‍👩‍👧 ok"]


def test_words_equal_the_library():
    path = tokenizer_path("word_bpe_49k.json")
    encoder, library = WordEncoder(path), load_tokenizer(path)
    for text, ids in zip(ODD, encoder.ids(ODD)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


PARTS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", "''", "l", "S", "É", "ÿ", "ß", "é", "12", "½", "²", "ª", "µ", "×", ".", ",", "-", " ", "\t", "\n",
         "\u00a0", "\x85", "\x1c", "\x00", "İ", "Ⱥ", "ŉ", "ǅ", "word", "The", "it", "qxzzv", "<", "|"]


@pytest.mark.parametrize("more", [[], ["日", "<|endoftext|>", "\u0301", "\x01", "\x02", "“"]])
def test_mixed_texts_equal_the_library(more):
    path = tokenizer_path("word_bpe_49k.json")
    encoder, library = WordEncoder(path, max_words=2000), load_tokenizer(path)
    rng = random.Random(11)
    for _ in range(40):
        texts = ["".join(rng.choices(PARTS + more, k=rng.randint(0, 60))) for _ in range(50)]
        for text, ids in zip(texts, encoder.ids(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
    assert encoder.ids([]) == []


def test_pieces_are_encoded_once():
    """A word next to other punctuation is no new piece."""
    encoder = WordEncoder(tokenizer_path("word_bpe_49k.json"))
    encoder.ids([f"qxzzv{a}{b} {a}qxzzv{b}" for a in ".,;:!?-" for b in ".,;:!?-"])
    assert not encoder.known and len(encoder.met) < 60
    assert sum(x.isalpha() for x in encoder.met) == 1


def test_counts_equal_the_library():
    path = tokenizer_path("byte_bpe_50k.json")
    library = load_tokenizer(path)
    assert ByteCounter(path).counts(ODD) == [len(library.encode(x, add_special_tokens=False)) for x in ODD]


@pytest.mark.parametrize("chunk,overlap", [(64, 16), (200, 70), (1000, 300)])
def test_overlapping_chunks_equal_whole_texts(chunk, overlap):
    from tokenizers import processors

    library = load_tokenizer(tokenizer_path("byte_bpe_50k.json"))
    library.post_processor = processors.ByteLevel(trim_offsets=False)
    rng = random.Random(chunk)
    parts = ["the ", "token", "  ", "\n\n", "<|endoftext|>", "'ll", " 12", "é", "日本", "x" * 40, " " * 50, "...", "don't "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 400))) for _ in range(60)]
    texts += ["x" * 3000, " " * 3000, "<|endoftext|>" * 200, "word " * 900, ""]
    for text in texts:
        want = len(library.encode(text, add_special_tokens=False))
        assert oc.count_overlapping(text, library, chunk, overlap, 32) == want


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _row string, ids string")


def test_count_query_shapes(spark):
    rows = [(1, "Hello there", "en", "a", "x", "y"), (1, "Hello there", "en", "a", "x", "y"), (None, None, None, None, None, None),
            (3, "", "en", "a", "", ""), (4, "word " * 30000, "en", "b", "", "")]
    out = {(r.doc_id, r.n_bytes): r for r in oc.count_tokens(docs_of(spark, rows)).collect()}
    library = load_tokenizer(tokenizer_path("byte_bpe_50k.json"))
    assert out[(4, 150000)].n_tokens == len(library.encode("word " * 30000, add_special_tokens=False))
    assert out[(4, 150000)].over_limit and out[(None, 0)].n_tokens == 0
    assert oc.count_tokens(docs_of(spark, [])).count() == 0
    assert oc.count_tokens(docs_of(spark, rows)).count() == 5


def brute_rounds(chunks, quantum):
    """Deficit round-robin, one chunk after the other."""
    queues = {q: list(c) for q, c in chunks.items()}
    deficit = {q: 0 for q in queues}
    out, rnd = {}, 0
    while any(queues.values()):
        for q in sorted(queues):
            deficit[q] += quantum[q]
            while queues[q] and queues[q][0][1] <= deficit[q]:
                key, n = queues[q].pop(0)
                deficit[q] -= n
                out[key] = rnd
        rnd += 1
    return out


def test_schedule_is_deficit_round_robin(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abc"), i, i, 0, rng.randint(1, 60)) for i in range(300)]
    chunks = spark.createDataFrame(rows, "queue string, _id long, _row long, start long, len long")
    weights = spark.createDataFrame([("a", 5.0), ("b", 3.0), ("c", 2.0)], "queue string, weight double")
    got = mp.schedule(chunks, weights, 100, 1).collect()
    quantum = {"a": 50, "b": 30, "c": 20}
    per_queue = {q: [(r[1], r[4]) for r in sorted(rows) if r[0] == q] for q in "abc"}
    want = brute_rounds(per_queue, quantum)
    assert {r._id: r["round"] for r in got} == want
    spans = sorted((r["at"], r["len"]) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0


def test_packing_is_an_exact_round_trip(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma,"]) for _ in range(rng.choice([0, 3, 40, 900]))), "en",
             rng.choice(["s0", "s0", "s1", None]), "", "") for i in range(120)]
    rows += [rows[5], (None, None, None, None, None, None)]
    pieces = mp.pack_mixture(docs_of(spark, rows), seq_len=256, window_sequences=4).collect()
    encoder = WordEncoder(tokenizer_path("word_bpe_49k.json"))
    total = sum(len(encoder.ids([r[1] or ""])[0]) // 4 + 1 for r in rows)
    assert sum(p.length for p in pieces) == total
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert sorted(by_sequence) == list(range(-(-total // 256)))
    for s, spans in by_sequence.items():
        spans.sort()
        at = 0
        for offset, n in spans:
            assert offset == at
            at += n
        assert at == 256 or s == max(by_sequence)
    for i in (0, 1, 2, 3, 4, 10):
        own = sorted((p.start, bytes(p.ids)) for p in pieces if p.doc_id == i)
        assert b"".join(x for _, x in own) == encoder.ids([rows[i][1]])[0] + (2).to_bytes(4, "little")
    assert len({p.doc_id for p in pieces}) == 121
    got = mp.digest(mp.pack_mixture(docs_of(spark, rows[:3]), seq_len=256)).collect()
    assert all(r.ids_crc32 == zlib.crc32(b"".join(x for s, x in [(r.start, (encoder.ids([rows[r.doc_id][1]])[0] + b"\x02\0\0\0")[4 * r.start: 4 * (r.start + r.length)])])) for r in got)
    assert mp.pack_mixture(docs_of(spark, [])).count() == 0


def test_windows_hold_the_mixture(spark):
    rows = [(i, "one two three four five six seven " * 6, "en", "big" if i % 4 else "small", "", "") for i in range(400)]
    pieces = mp.pack_mixture(docs_of(spark, rows), seq_len=128, window_sequences=16).groupBy("window_id").pivot("source").sum("length").collect()
    whole = [r for r in pieces if (r.big or 0) + (r.small or 0) == 2048]
    assert whole and all(abs(r.small / 2048 - 0.25) < 0.07 for r in whole)
