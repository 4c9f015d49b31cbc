from zlib import crc32

from shopgrain.llm import sharding as S


def test_map_edits():
    load = {s: (s * 37) % 91 + 1 for s in range(200)}
    start = S.initial_map(256, 8)
    after = S.rebalanced(start, load, 8)
    full = lambda m, n: [sum(load.get(s, 0) for s in range(256) if m[s] == i) for i in range(n)]
    assert max(full(after, 8)) - min(full(after, 8)) <= 20 < max(full(start, 8)) - min(full(start, 8))
    more = S.grown(after, load, 8)
    assert all(a == b or b == 8 for a, b in zip(after, more))
    assert max(full(more, 9)) < 1.1 * sum(load.values()) / 9
    assert S.rebalanced(start, {}, 8) == start


def test_shards(spark, sf):
    rows = S.op8_virtual_slots(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    by = {}
    for r in rows:
        assert r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == crc32(texts[r.doc_id].encode()) and r.grown_shard is None
        by.setdefault(r.shard, []).append(r)
    assert sorted(by) == list(range(8))
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    sizes = [sum(r.size for r in v) for v in by.values()]
    assert max(sizes) < 1.05 * sum(sizes) / 8


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, "x", "c"), (None, "x", "d"), (3, "é" * 50_000, "e")] + [(9, "same", "f")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot string")
    placed, maps = S.shard(docs)
    got = placed.collect()
    assert len(got) == len(rows) and {(r.doc_id, r.size, r.text_crc32) for r in got} == {(i, len((t or "").encode()) + 1, crc32((t or "").encode())) for i, t, _ in rows}
    for shard in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert maps.groupBy("version").count().count() == 2
    assert S.shard(docs.limit(0))[0].count() == 0


def test_native_plan(spark, sf):
    plan = S.op8_virtual_slots(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
