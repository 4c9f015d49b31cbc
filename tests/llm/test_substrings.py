import random
from hashlib import sha256

from shopgrain.llm import substrings as S

W = S.WINDOW


def expected(rows):
    order = {i: (2**63 - 1 if i is None else i) for i, _ in rows}
    words = [(order[i], (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - W + 1):
            key = tuple(w[k : k + W])
            first[key] = min(first.get(key, 2**63), i)
    out = []
    for (i, w), (doc_id, _) in zip(words, rows):
        gone = [False] * len(w)
        for k in range(len(w) - W + 1):
            if first[tuple(w[k : k + W])] < i:
                gone[k : k + W] = [True] * W
        out.append((str(doc_id), len(w), sum(gone), sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(2)
    passage, line = [f"p{i}" for i in range(130)], ["same"] * 70
    rows = []
    for i in range(40):
        own = [f"w{rng.randrange(1000)}" for _ in range(rng.randrange(0, 200))]
        at = rng.randrange(len(own) + 1)
        rows.append((i, " ".join(own[:at] + rng.choice([passage, passage[20:90], passage[:49], line, []]) + own[at:])))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, None), (103, ""), (104, " \t\n"), (None, rows[5][1]), (None, " ".join(passage)), (105, "x " * 40_000), (106, "x " * 40_000), (107, "Ünïcode " * 60), (108, "y\x0b\x1cz " * 60)]
    rows += [(109, "a " * 60 + "b"), (109, "a " * 60 + "b"), (109, "c " + "a " * 60)]
    docs = spark.createDataFrame([(i, t, "k", 5) for i, t in rows], "doc_id long, text string, m string, start int")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, sha256(r.kept.encode()).hexdigest()) for r in S.without_repeats(docs).collect())
    assert got == expected(rows)


def test_empty(spark):
    assert S.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
