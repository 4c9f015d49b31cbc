import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline as P
from shopgrain.llm.registry import ORACLES, QUERIES
from tests.llm.test_neardup import edited, shingles
from tests.oracle import compare, connect


def test_registered():
    assert {f"op{n}" for n in range(1, 11)} == {name.split("_")[0] for name in QUERIES} and set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert [n for n, _ in P.STAGES] == ["language", "near_duplicates", "repeated_strings", "benchmark_items", "sequences"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, name):
    ok, message = compare(name, spark, connect(sf), QUERIES, ORACLES, sf)
    assert ok, message


def test_edges(spark, tmp_path):
    """Nulls, repeated rows, long texts and an extra column through all stages."""
    item = "which of these rivers is the longest one on the whole wide continent of stone"
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    story = " ".join(f"word{i} and" for i in range(80))
    rows = [
        (1, story, "en", 1), (2, story + " end", "en", 2), (2, story + " end", "en", 2), (3, None, "en", 3), (4, "", None, 4), (5, "12 34 !!", "de", 5), (6, "some tale " + item + " told here", "en", 6),
        (None, "some other tale told here with no end", "en", 7), (7, "lange rede kurzer sinn " * 4000, "de", 8), (8, "ein ganz anderer kurzer satz", "de", 9), (9, "quite another short text", None, 9),
    ]
    docs = spark.createDataFrame([(*r[:3], "s", len(r[1] or ""), r[3]) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, did int")
    seen = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "sequences":
            assert out.columns == docs.columns
        docs = P.materialized(out)
        seen[name] = sorted(str(r.doc_id) for r in docs.select("doc_id").collect())
    assert seen["language"] == sorted(["1", "2", "2", "6", "None", "7", "8", "9"])
    assert seen["near_duplicates"] == sorted(["1", "6", "None", "7", "8", "9"]) == seen["repeated_strings"]
    assert seen["benchmark_items"] == sorted(["1", "None", "7", "8", "9"])
    assert set(seen["sequences"]) == set(seen["benchmark_items"])


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_run_keeps_whole_documents(spark, sf):
    out = P.run(spark, sf)
    assert out.count() > 0 and out.where("offset + length > 1024 OR offset < 0").count() == 0


def test_near_duplicates_with_null_and_repeated_ids(spark, tmp_path):
    """Different texts under one id, or under none, are documents of their own."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(120)) for x in "abcd")
    rows = [(None, a), (None, b), (None, c), (None, c + " end"), (None, c), (None, "one two"), (None, None), (None, " "), (4, a), (5, d), (5, b + " end"), (5, "three four"), (6, "three four"), (6, "five six")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = P.near_duplicates(spark, docs, str(tmp_path)).select("doc_id", "text").collect()
    texts = sorted((r.doc_id or 99, r.text or "") for r in got)
    of_c = [r.text for r in got if r.text in (c, c + " end")]
    assert len(of_c) == 1
    assert texts == sorted([(4, a), (5, d), (5, b + " end"), (5, "three four"), (6, "five six"), (99, of_c[0]), (99, "one two"), (99, ""), (99, " ")])


def test_near_duplicates_at_eighty_percent(spark, tmp_path):
    """The stage against brute force at 0.8, with pairs on both sides of it and of 0.85."""
    rng = random.Random(8)
    texts = []
    for k in range(20):
        base = [f"b{k}w{i}" for i in range(200)]
        texts += [" ".join(base), edited(base, rng, 1 + k % 6)]
    sets = [shingles(t) for t in texts]
    similar = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2])]
    assert min(similar) < 0.8 and sum(0.8 <= s < 0.85 for s in similar) >= 2 and max(similar) > 0.85
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.doc_id for r in P.near_duplicates(spark, docs, str(tmp_path)).select("doc_id").collect())
    assert got == sorted([*range(0, 40, 2), *(2 * k + 1 for k, s in enumerate(similar) if s < 0.8)])
