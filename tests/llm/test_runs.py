import random
import re
import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest

from shopgrain.llm import runs as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, times=4, least=6):
    """Every maximal stretch of every period by comparing all words; of equal stretches the smallest period."""
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least, times * q):
                out.setdefault((s, i + q - s), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in out.items())


def rewritten(doc_id, text):
    w = WORD.findall(text or "")
    if doc_id is None:
        return w
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def expected(doc_id, text):
    w = rewritten(doc_id, text)
    runs = brute(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    mark = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (str(doc_id), len(runs), *map(str, mark), sha256(lines.encode()).hexdigest(), sha256(kept.encode()).hexdigest())


def test_runs_of_arrays_against_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        texts = []
        for _ in range(rng.randrange(1, 6)):
            n, k = rng.choice([0, 1, 5, 6, 7, 8, 30, 100, 300]), rng.choice([1, 2, 3, 50])
            w = [rng.randrange(1, k + 1) for _ in range(n)]
            for _ in range(rng.randrange(4) if n > 8 else 0):
                s, p = rng.randrange(n), rng.randrange(1, max(2, n // 4))
                for x in range(s + p, min(n, s + p * rng.randrange(2, 9) + rng.randrange(p))):
                    w[x] = w[x - p]
            texts.append(w)
        ids, of = np.array([x for w in texts for x in w], np.int64), np.append(0, np.cumsum([len(w) for w in texts])).astype(np.int64)
        got = list(zip(*(a.tolist() for a in R.find_runs(ids, of))))
        assert got == [(d, *r) for d, w in enumerate(texts) for r in brute(w)]


def test_extensions_against_comparison():
    rng = random.Random(4)
    texts = [[rng.randrange(1, 3) for _ in range(200)], [1] * 60, [1, 2, 3, 4, 5] * 40]
    ids = np.array([x for w in texts for x in w + [0]], np.int64)
    text = np.repeat(np.arange(3), [len(w) + 1 for w in texts])
    common = R.Extensions(ids, text, np.ones(3, bool))
    for d, w in enumerate(texts):
        base = int(np.flatnonzero(text == d)[0])
        i, j = (np.array([rng.randrange(len(w)) for _ in range(300)]) for _ in range(2))
        i, j = np.minimum(i, j), np.maximum(i, j)
        i, j = i[i < j], j[i < j]
        want = []
        for a, b in zip(i, j):
            n = 0
            while b + n < len(w) and w[a + n] == w[b + n]:
                n += 1
            want.append(n)
        assert common(base + i, base + j).tolist() == want


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = []
    for i in range(120):
        own = [f"w{rng.randrange(30)}" for _ in range(rng.randrange(0, 150))]
        out.append((i, rng.choice([" ", "\n", " \t"]).join(own + own[:3] * rng.randrange(0, 9) + ["é"] * rng.randrange(0, 8) + own)))
    out += [(500, None), (501, ""), (502, " \n\x0b"), (None, "a b " * 9), (None, None), (503, "x " * 3000), (3, out[3][1]), (504, " ".join(f"v{k % 700}" for k in range(4000)))]
    out += [(505, "a a a a a a b b b b b b"), (506, "a b a b a b a"), (507, "a b a b a b a b"), (508, "a\x1ca " * 7), (-4, "z " * 40 + "y")]
    return out


def test_query_against_brute_force(spark, rows, tmp_path):
    spark.createDataFrame([(i, t, "x", 7, 1) for i, t in rows], "doc_id long, text string, w string, n int, start int").write.parquet(f"{tmp_path}/documents.parquet")
    got = R.op11_difference_cover(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {c: t for c, t in got.dtypes if not c.endswith("sha256")} == dict.fromkeys(["doc_id", *got.columns[1:6]], "bigint")
    assert sorted((str(r[0]), r[1], *map(str, r[2:6]), *r[6:]) for r in got.collect()) == sorted(expected(i, t) for i, t in rows)


def test_real_outputs_and_parameters(spark):
    docs = spark.createDataFrame([(1, "q a b a b a b c c c c")], "doc_id long, text string")
    r = R.periodic_runs(docs, times=3, least=4).first()
    assert [tuple(x) for x in r.runs] == [(1, 6, 2), (7, 4, 1)] and tuple(r.best) == (7, 4, 1) and r.collapsed == "q a b c" and r.n_words == 11


def test_empty(spark):
    assert R.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
