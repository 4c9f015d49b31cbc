import random

import pytest

from shopgrain.llm import decontamination as D


def plain(pattern, text):
    """Least edit distance of the pattern to any part of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@pytest.mark.parametrize("seed", range(40))
def test_distance_and_matcher(seed):
    rng = random.Random(seed)
    pattern = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 80))).strip() or "a"
    text = "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 120)))
    if seed % 2:
        edited = list(pattern)
        for _ in range(rng.randrange(4)):
            edited[rng.randrange(len(edited))] = rng.choice(["", "x", "ab"])
        text = text[:50] + "".join(edited) + text[50:]
    pattern, text = D.normal(pattern), D.normal(text)
    want = plain(pattern, text) if text else len(pattern)
    for most in (0, 3, 100):
        got = D.distance(pattern, text, most)
        assert (got[0] if got else None) == (want if want <= most else None)
    item = D.prepared(1, pattern, 0.1)
    got = D.Matcher([item]).find(text) if item else []
    assert bool(got) == bool(item and text and want <= item[2]) and (not got or got[0][1] == want)


def test_edges(spark):
    passage = "The quick brown fox jumps over the lazy dog near the river bank at noon"
    docs = spark.createDataFrame(
        [(1, f"start {passage.upper()} end", 1), (2, passage.replace("quick", "quack").replace(" ", "  "), 2), (3, "nothing here", 3), (4, None, 4), (4, "", 4), (None, passage, 5), (5, passage, 6), (5, passage, 6), (6, "word " * 20_000 + passage, 7)],
        "doc_id long, text string, distance int",
    )
    items = spark.createDataFrame([(7, passage, "a"), (8, None, "b"), (9, "", "c"), (None, "start the quick", "d"), (7, passage, "e")], "item_id long, text string, doc_id string")
    got = sorted({(str(r.doc_id), str(r.item_id), r.distance) for r in D.contaminations(docs, items).collect()})
    assert got == [("1", "7", 0), ("1", "None", 0), ("2", "7", 1), ("5", "7", 0), ("6", "7", 0), ("None", "7", 0)]
    assert D.contaminations(docs, items, block_chars=1).distinct().count() == len(got)
    assert sorted(str(r.doc_id) for r in D.decontaminated(docs, items).collect()) == ["3", "4", "4"]
    assert D.contaminations(docs, items.limit(0)).count() == 0 and D.contaminations(docs.limit(0), items).count() == 0
    assert D.decontaminated(docs, items.limit(0)).count() == 9
