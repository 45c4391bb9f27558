"""Quality rules: base counts against plain Python, the fit against numpy."""

import random
import re
from collections import Counter

import numpy as np

from relaylake.llm import quality_mcd as q

SCHEMA = "doc_id long, text string, lang string, source string, w string, z0 string"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_base_counts(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t ", "a", "a b", "a b c a b c", "x x x x x", "é# ü\x0b|<\n\né# ü", "a\n a\na\r\n"]
    texts += [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    texts += ["\n".join(rng.choice(["one two", "three", "", " "]) for _ in range(rng.randint(0, 30))) for _ in range(20)]
    texts += ["word " * 40000, "q" * 200000]
    rows = [(i, t, "en", "s", "w", "z") for i, t in enumerate(texts)]
    out = {r.doc_id: r for r in q.quality_verdicts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        r, want = out[i], brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, (i, t and t[:50])
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_distances_match_numpy(spark):
    rng = np.random.default_rng(2)
    z = rng.multivariate_normal([10, 20, 30, 40, 50], np.diag([9, 4, 16, 25, 1]) + 1.0, 400) * 100
    rows = spark.createDataFrame([("en", "s", *map(int, r)) for r in z.round()], "lang string, source string, " + ", ".join(f"z{k} long" for k in range(5)))
    first = q.whitened(q.starting_fit(rows))
    d0 = np.array([r.d2 for r in q.with_distance(rows, first).orderBy("z0", "z1").collect()])
    zs = np.array(sorted(map(tuple, z.round())))
    bins = np.floor(64 * np.log2(1 + d0))
    edge = np.sort(bins)[int(np.ceil(0.75 * len(bins))) - 1]
    inside = zs[bins <= edge]
    cov = np.cov(inside.T, bias=True)
    np.fill_diagonal(cov, np.maximum(np.diag(cov), (np.array(q.FLOOR) * q.SCALE) ** 2))
    diff = zs - inside.mean(0)
    want = np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff)
    got = [r.d2 for r in q.with_distance(rows, q.whitened(q.concentrated(rows, first))).orderBy("z0", "z1").collect()]
    assert np.allclose(sorted(got), sorted(want), rtol=1e-6)


def test_outliers_go_and_clean_rows_stay(spark):
    rng = random.Random(4)
    clean = [(i, " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet,"]) + str(rng.randint(0, 999)) for _ in range(rng.randint(60, 300))),
              "en", rng.choice(["a", None]), "", "") for i in range(200)]
    junk = [(1000 + i, " ".join(f"w{rng.randint(0, 999)}###$$$" for _ in range(80)), "en", "a", "", "") for i in range(5)]
    docs = spark.createDataFrame(clean + junk + clean[:1] + [(None, None, None, None, None, None)], SCHEMA)
    verdicts = q.quality_verdicts(docs).collect()
    assert len(verdicts) == 207
    assert {r.doc_id for r in verdicts if r.kept} == set(range(200))
    kept = q.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == 201
    assert q.quality_verdicts(docs.limit(0)).count() == 0


def plain_fit(z):
    """The whole fit in numpy: distances over ``grow`` and the least log-determinant."""
    z, floor, n = z.astype(float), (np.array(q.FLOOR) * q.SCALE) ** 2, len(z)
    at = lambda p: np.sort(z, axis=0)[int(np.ceil(p * n)) - 1]
    mid, var = at(0.5), np.maximum(((at(0.75) - at(0.25)) / 1.349) ** 2, floor)
    score = (z - mid) / np.sqrt(var)
    away = np.maximum(np.sqrt((score ** 2).sum(1)), 1e-9)[:, None]
    half_up = lambda x: np.sign(x) * np.floor(np.abs(x) * q.SCALE + 0.5)
    starts = [np.diag(var)]
    for t in (half_up(np.tanh(score)), half_up(score / away)):
        m = t.T @ t
        r = m / np.sqrt(np.outer(np.maximum(np.diag(m), 1), np.maximum(np.diag(m), 1)))
        np.fill_diagonal(r, 1)
        starts.append(r * np.sqrt(np.outer(var, var)))
    bins = lambda d: np.floor(64 * np.log2(1 + d))
    distance = lambda mean, cov: np.einsum("ij,jk,ik->i", z - mean, np.linalg.inv(cov), z - mean)
    best = None
    for cov in starts:
        mean, last = mid, np.inf
        while True:
            b = bins(distance(mean, cov))
            inside = z[b <= np.sort(b)[int(np.ceil(q.SHARE * n)) - 1]]
            mean, cov = inside.mean(0), np.cov(inside.T, bias=True)
            np.fill_diagonal(cov, np.maximum(np.diag(cov), floor))
            logdet = np.linalg.slogdet(cov)[1]
            if best is None or logdet < best[0] - 1e-9:
                best = logdet, mean, cov
            if not logdet < last - q.TOLERANCE:
                break
            last = logdet
    d = distance(*best[1:])
    grow = max(1.0, (2 ** ((np.sort(bins(d))[int(np.ceil(0.5 * n)) - 1] + 1) / 64) - 1) / q.CHI2_MEDIAN)
    return d / grow, best[0]


def test_whole_fit_matches_numpy(spark):
    rng = np.random.default_rng(5)
    turn = rng.normal(size=(5, 5)) * 200
    parts = {"near": rng.normal(size=(300, 5)) @ turn,
             "mixed": np.vstack([rng.normal(size=(200, 5)) @ turn, rng.normal(size=(70, 5)) * 150 + 3000]),
             "small": rng.normal(size=(7, 5)) * 300}
    data = {name: z.round().astype(int) for name, z in parts.items()}
    rows = spark.createDataFrame([("en", name, *map(int, r)) for name, z in data.items() for r in z],
                                 "lang string, source string, " + ", ".join(f"z{k} long" for k in range(5)))
    fit = q.fitted(rows)
    got = q.with_distance(rows, fit.drop("grow")).join(fit.select("source", "grow", "logdet"), "source").collect()
    for name, z in data.items():
        want, logdet = plain_fit(z)
        mine = {tuple(r[f"z{k}"] for k in range(5)): r.d2 / r.grow for r in got if r.source == name}
        assert np.allclose([mine[tuple(map(int, r))] for r in z], want, rtol=1e-6), name
        assert abs(next(r.logdet for r in got if r.source == name) - logdet) < 1e-6
    far = np.array([r.d2 / r.grow for r in got if r.source == "mixed" and r.z0 > 2000 and r.z1 > 2000 and r.z2 > 2000])
    assert len(far) and (far > q.CUTOFF).mean() > 0.9


def test_least_determinant_over_the_starts(spark):
    rng = np.random.default_rng(8)
    z = np.vstack([rng.normal(size=(150, 5)) @ (rng.normal(size=(5, 5)) * 300), rng.normal(size=(50, 5)) * 900]).round()
    rows = spark.createDataFrame([("en", "s", *map(int, r)) for r in z], "lang string, source string, " + ", ".join(f"z{k} long" for k in range(5)))
    least = q.least_determinant(rows).first().logdet
    fit = q.whitened(q.starting_fits(rows))
    assert sorted(r.start for r in fit.collect()) == [0, 1, 2]
    once = q.whitened(q.concentrated(rows, fit)).collect()
    twice = q.whitened(q.concentrated(rows, q.whitened(q.concentrated(rows, fit)))).collect()
    assert all(least <= r.logdet + 1e-9 for r in once + twice)


def test_groups_without_spread(spark):
    rows = [("en", "equal", 1, 2, 3, 4, 5)] * 4 + [("en", "one", 9, 9, 9, 9, 9)]
    rows += [("en", "line", 5000 * i, 5000 * i, 5000 * i, 0, 0) for i in range(8)]  # statistics that give each other
    rows = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"z{k} long" for k in range(5)))
    fit = q.fitted(rows)
    d = q.with_distance(rows, fit.drop("grow")).collect()
    assert len(d) == 13 and all(r.d2 == 0 for r in d if r.source in ("equal", "one"))
    assert all(np.isfinite(r.d2) for r in d)


def test_prose_with_a_table_stays(spark):
    rng = random.Random(9)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "rosa", "terra", "mare", "luna", "sol"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 9999)) for _ in range(n))
    rows = [(i, prose(rng.randint(80, 300)), "en", "s", "", "") for i in range(200)]
    rows += [(500 + i, prose(150) + "\n| a%d | b%d |\n" % (i, i), "en", "s", "", "") for i in range(5)]
    kept = {r.doc_id for r in q.quality_verdicts(spark.createDataFrame(rows, SCHEMA)).collect() if r.kept}
    assert kept == {r[0] for r in rows}
