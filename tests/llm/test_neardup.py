import random
from itertools import combinations

import numpy as np
import pytest

from shopgrain.llm import neardup as N
from shopgrain.llm.components import components


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def expected(rows):
    sets = [shingles(t) for _, t in rows]
    ids = [2**63 - 1 if i is None else i for i, _ in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            group[root(a)] = root(b)
    low = {}
    for i in range(len(rows)):
        low[root(i)] = min(low.get(root(i), 2**63), ids[i])
    return sorted((ids[i], len(sets[i]), low[root(i)]) for i in range(len(rows)))


def edited(words, rng, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.random()}"
    return " ".join(words)


def compare(spark, rows, **how):
    docs = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, n string")
    got = sorted((r.did, r.n_shingles, r.component) for r in N.near_duplicates(docs, **how).collect())
    assert got == expected(rows)


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(12):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(30, 120))]
        rows += [(len(rows) + k, edited(base, rng, rng.randrange(0, 4))) for k in range(rng.randrange(1, 7))]
    rows += [(900, None), (901, ""), (902, " \t"), (903, "One two"), (904, "one TWO"), (None, "one two"), (None, "alone"), (905, "long word " * 9000), (905, "long word " * 9000), (905, "other text here with some words")]
    compare(spark, rows)


def test_large_nodes(spark):
    """Leaves of two sets: everything goes through branching, stars and blocks."""
    rng = random.Random(6)
    base, passage = [f"w{i}" for i in range(300)], [f"p{i}" for i in range(60)]
    rows = [(i, edited(base, rng, rng.randrange(0, 12))) for i in range(60)]
    rows += [(100 + i, " ".join(passage + [f"z{rng.random()}" for _ in range(rng.randrange(0, 60))])) for i in range(60)]
    compare(spark, rows, leaf=2)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100)]
    out = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 102), 100)}


def test_empty(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("percent", [50, 85, 99])
def test_least_equal_is_below_the_threshold(percent):
    assert 0 < N.least_equal(percent) < N.COORDINATES * percent / 100


@pytest.mark.parametrize("percent", [80, 85])
def test_branches_keep_pairs_at_the_threshold(percent):
    s, b = percent / 100, N.branches(percent)
    assert (1 - s * (1 - (1 - s**N.PATH) ** b) ** N.LEVELS) ** N.TREES <= N.MISSED


@pytest.mark.parametrize("n, leaf", [(120, N.LEAF), (60, 16)])
def test_rows_do_not_grow_with_the_pairs_of_a_group(spark, monkeypatch, n, leaf):
    """Near copies just below the threshold of one another, and a few above it: no table that is written holds their pairs."""
    rng = random.Random(9)
    base, written = [f"w{i}" for i in range(200)], []
    rows = [(i, edited(base, rng, 4)) for i in range(n)]
    rows += [(n + i, rows[i][1] + " end") for i in range(3)]
    whole = N.materialized

    def counting(df):
        out = whole(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(N, "materialized", counting)
    compare(spark, rows, leaf=leaf)
    if leaf == N.LEAF:
        assert max(written) < n * n / 4 and max(written) <= len(rows) * N.TREES


def test_shared():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 50, 90):
        sets = [np.unique(rng.integers(0, 400, rng.integers(1, 60)).astype(np.uint64)) for _ in range(n)]
        got = N.shared(sets)
        assert all(got[i, j] == len(set(sets[i]) & set(sets[j])) for i, j in combinations(range(n), 2))


def test_joined():
    links = np.zeros((40, 40), bool)
    for i in (*range(0, 20, 2), *range(21, 38)):
        links[i, i + 2] = links[i + 2, i] = True
    found = [set(np.flatnonzero(N._joined(links) == r)) for r in range(40)]
    assert [f for f in found if f] == [set(range(0, 21, 2)), *({i} for i in range(1, 21, 2)), set(range(21, 40, 2)), set(range(22, 40, 2))]


def test_long_bundles_are_cut(spark, monkeypatch):
    """Parts of a few hashes: every two of them still meet."""
    monkeypatch.setattr(N, "PART", 150)
    rng = random.Random(10)
    base = [f"w{i}" for i in range(120)]
    compare(spark, [(i, edited(base, rng, rng.randrange(0, 6))) for i in range(40)])
