"""Best-fit-decreasing packing: against a plain search, and as a round trip."""

import random

import numpy as np

from relaylake.llm import bfd_packing as bp
from relaylake.llm.tokens import WordEncoder, tokenizer_path

SCHEMA = "doc_id long, text string, row string, ids string, group string"


def brute(lengths, capacity):
    rows, room = [], []
    for p in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [r for r in range(len(rows)) if room[r] >= lengths[p]]
        if fits:
            least = min(room[r] for r in fits)
            r = [x for x in fits if room[x] == least]
            r = r[0]
        else:
            r = len(rows)
            rows.append([])
            room.append(capacity)
        rows[r].append(p)
        room[r] -= lengths[p]
    return sorted(room), len(rows)


def test_best_fit_equals_a_plain_search():
    rng = random.Random(1)
    for _ in range(60):
        capacity = rng.choice([1, 7, 64, 100])
        lengths = np.array([rng.randint(1, capacity) for _ in range(rng.randint(0, 200))], dtype=np.int64)
        rows = bp.best_fit_decreasing(lengths, capacity)
        assert sorted(p for r in rows for p in r) == list(range(len(lengths)))
        room = [capacity - int(lengths[r].sum()) for r in rows]
        assert min(room, default=0) >= 0 and (sorted(room), len(rows)) == brute(lengths.tolist(), capacity)


def test_round_trip(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma,", "Ünder"]) for _ in range(rng.choice([0, 1, 5, 30, 700]))), "", "", "") for i in range(150)]
    rows += [rows[4], (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    packed = bp.pack_matrix(docs, seq_len=128, group_rows=40, block_tokens=3000).collect()
    encoder = WordEncoder(tokenizer_path("word_bpe_49k.json"))
    want = {r[0]: encoder.ids([r[1] or ""])[0] + b"\x02\0\0\0" for r in rows}
    pieces = {}
    for r in packed:
        ids, positions = bytes(r.ids), np.frombuffer(bytes(r.positions), "<u4")
        assert len(ids) == 4 * 128 and r.cu_lengths[0] == 0 and r.cu_lengths[-1] == r.n_tokens <= 128
        assert ids[4 * r.n_tokens:] == bytes(4 * (128 - r.n_tokens))
        for s, a, b in zip(r.segments, r.cu_lengths, r.cu_lengths[1:]):
            assert positions[a:b].tolist() == list(range(b - a))
            assert s.doc_tokens == len(want[s.doc_id]) // 4
            pieces.setdefault(s.doc_id, []).append((s.start, ids[4 * a:4 * b]))
    assert set(pieces) == set(want)
    for doc, parts in pieces.items():
        copies = 2 if doc == 4 else 1
        assert b"".join(x for _, x in sorted(parts)[::copies]) == want[doc] and len({s for s, _ in parts}) * copies == len(parts)
    assert len({(r.group, r.block, r.row) for r in packed}) == len(packed)
    bp.write_matrix(docs, f"{tmp_path}/matrix", seq_len=128)
    assert spark.read.parquet(f"{tmp_path}/matrix").agg({"n_tokens": "sum"}).first()[0] == sum(len(want[r[0]]) // 4 for r in rows)
    assert bp.pack_matrix(docs.limit(0)).count() == 0
