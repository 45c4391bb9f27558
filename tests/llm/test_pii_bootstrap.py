"""Personal data: base spans against Python's re, patterns on planted contexts."""

import hashlib
import random
import re

from relaylake.llm import pii_bootstrap as pb

SCHEMA = "doc_id long, text string, v string, base string, kind string"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = 2 * d - 9 if 2 * d > 9 else 2 * d
        total += d
    return total % 10 == 0


def brute(text):
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def run(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    return {r.doc_id: r for r in pb.op9_pii_bootstrap(spark, str(path)).collect()}


def test_base_spans(spark, tmp_path):
    rng = random.Random(2)
    alphabet = ["a", "@", ".", "-", "+", "1", "23", "255", "256", " ", "(", ")", "é", "😀", "\n", "%", "4111 1111 1111 1111", "a.b@c.d", "+1 (555) 123-4567", "1.2.3.4"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    texts += [None, "", "x@y.z@w.v", "a@b@c.d", "a@b..c.d@e.f", "1.2.3.4.5.6.7.8", "000001.2.3.4", "9" * 30000, "a" * 60000 + "@b.c", "1." * 20000,
              "x" * 100000, "+1" + "(" * 20000, "😀 mail me@x.yz now", "4111-1111-1111-1111", "4111-1111-1111-1112", "99999999999.1.1.1", "1 " * 3000]
    out = run(spark, tmp_path, [(i, t, "", "", "") for i, t in enumerate(texts)])
    for i, t in enumerate(texts):
        want = brute(t)
        told = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        base = ",".join(x for x in out[i].spans.split(",") if not x.startswith("id:"))
        assert base == told, (t and t[:80], base[:200], told[:200])
        assert out[i].base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [out[i].n_email, out[i].n_ip, out[i].n_card, out[i].n_phone] == [sum(w[0] == k for w in want) for k in ("email", "ip", "card", "phone")]


def test_contexts_find_unseen_identifiers(spark, tmp_path):
    rows = [(i, f"Please write to customer contact: user{i}@mail.example today", "", "", "") for i in range(8)]
    rows += [(20, "He said customer contact: ID-77812-X, thanks", "", "", ""), (21, "the invoice total of 123456 euros", "", "", ""),
             (22, "the invoice total of 999999 euros", "", "", ""), (23, None, None, None, None), (20, "He said customer contact: ID-77812-X, thanks", "", "", ""),
             (None, "customer contact: ID-55555", "", "", "")]
    out = run(spark, tmp_path, rows)
    start = rows[8][1].index("ID-77812-X")
    assert out[20].spans == f"id:{start}:{start + 10}"
    assert out[None].spans == "id:18:26"
    assert out[21].spans == "" and out[22].spans == "" and out[23].spans == ""
    assert all(out[i].spans.startswith("email:") and "id" not in out[i].spans for i in range(8))


def test_found_identifiers_bring_forth_patterns(spark, tmp_path):
    rows = [(i, f"Please write to customer contact: user{i}@mail.example today", "", "", "") for i in range(40)]
    known = [f"EMP-7781{k}" for k in range(6)]
    rows += [(100 + k, f"the customer contact: {v} called", "", "", "") for k, v in enumerate(known)]
    rows += [(200 + k, f"on the form staff number: {v} stands", "", "", "") for k, v in enumerate([*known, "EMP-90001"])]
    rows += [(300, "customer contact:" + " " * 100 + "ID-55555 stands apart", "", "", ""), (301, "customer " + " " * 70000 + "contact: ID-66666", "", "", ""),
             (302, "an order number: 4711000", "", "", "")]
    out = run(spark, tmp_path, rows)
    for i, t, *_ in rows[40:-1]:
        value = next(w for w in t.split() if w.startswith(("EMP", "ID")))
        assert out[i].spans == f"id:{t.index(value)}:{t.index(value) + len(value)}", t[:80]
    assert out[302].spans == ""


def brute_places(text):
    """Base spans and candidates with the two words before, of the whole text at once."""
    base = brute(text)
    found = [(0 if k == "email" else 1 if k == "ip" else 2 if k == "card" else 3, s, e) for k, s, e in base]
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        bare = re.fullmatch(r"([\W_]*)(.*?)([\W_]*)", m[0], re.S)
        if sum(c in "0123456789" for c in m[0]) >= pb.MIN_DIGITS:
            s, e = m.start() + len(bare[1]), m.end() - len(bare[3])
            if not any(s < f and b < e for _, b, f in base):
                found.append((4, s, e))
    out = []
    for k, s, e in sorted(found):
        words = [w for w in (re.sub(r"[^\w:=]|_", "", w) for w in re.split(r"[\x20\x09-\x0D]+", text[:s].lower())) if w]
        out.append((k, s, e, text[s:e].lower(), " ".join(words[-2:]) if len(words) > 1 else None))
    return out


def test_pieces_give_the_spans_of_the_whole_text(spark):
    rng = random.Random(7)
    tokens = ["word", "Total:", "x=", "(", "-", "id", "12345", "(A-1234),", "4111 1111 1111 1111", "a.b@c.de", "+1 (555) 123-4567", "10.0.0.7", "é", "99 88", "K7", "5555-6666"]
    seps = [" ", " ", "\n", "  ", "\t", " \r\n", "\x0b"]
    texts = ["".join(rng.choice(tokens) + rng.choice(seps) for _ in range(n)) for n in (0, 1, 5, 60, 200, 400, 900, 1500) for _ in range(4)]
    texts += ["12345 " * 900, "a\n" + "67890\n" * 700 + "b 4444"]
    rows = [(i, t, "", "", "") for i, t in enumerate(texts)]
    assert max(len(t) for t in texts) > 6 * pb.PIECE_CHARS
    for r in pb.span_table(spark.createDataFrame(rows, SCHEMA)).collect():
        assert [(x.kind, x.s, x.e, x.v, x.left) for x in r.found] == brute_places(texts[r.doc_id])


def test_long_document_in_time(spark):
    """1 MB with 50,000 candidates in one text."""
    import time
    text = " ".join(f"word{k % 7} account number 1{k:06d} there" if k % 2 else f"20{k:06d}" for k in range(50_000))
    assert len(text) > 1_000_000
    start = time.time()
    row = pb.span_table(spark.createDataFrame([(1, text, "", "", "")], SCHEMA)).selectExpr("size(found) n", "found[49999] x").first()
    assert row.n == 50_000
    assert time.time() - start < 60


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert pb.personal_data(docs).count() == 0
