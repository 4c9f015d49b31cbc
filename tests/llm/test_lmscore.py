import math
import tracemalloc
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from shopgrain.llm import lmscore as L


def model(texts):
    code = L.Code(np.bincount(np.frombuffer(b"".join(texts), np.uint8), minlength=256))
    counts = np.zeros((L._OFFSETS[-1], 2), np.uint32)
    L.count(counts, code, texts)
    return code, L.logits(counts)


def test_predictions_are_probabilities():
    """The probabilities of all bytes after a common beginning add up to one."""
    texts = [b"the cat sat on the mat\n", b"the dog sat\n"] * 20
    code, table = model(texts)
    ends = [bytes([b]) for b in range(256)]
    begin = L.mixed_scores(code, table, [b"the c"])[0]
    total = sum(10 ** (s - begin) for s in L.mixed_scores(code, table, [b"the c" + e for e in ends]))
    assert total == pytest.approx(1, abs=1e-3)


def test_scores_do_not_depend_on_company():
    texts = [b"a b c\n", b"\n", b"word " * 900 + b"x\n", b"the cat\n"]
    code, table = model(texts)
    together = L.mixed_scores(code, table, texts)
    assert np.allclose(together, [L.mixed_scores(code, table, [t])[0] for t in texts])
    assert L.mixed_scores(code, table, [texts[2]])[0] > L.mixed_scores(code, table, [b"qz7 " * 900 + b"x\n"])[0]


def check(spark, docs, rows):
    out = {(r.did, round(r.base_score, 6)): r for r in L.score(docs, lambda i: L.fold(i, 10) != 0).collect()}
    train = [t for i, t in rows if crc32(("" if i is None else str(i)).encode()) % 10]
    words = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
    c = Counter(w for t in train for w in words(t))
    n, v = sum(c.values()) + len(train), len(c) + (len(train) > 0)
    for i, t in rows:
        base = sum(math.log10((k + 0.1) / (n + 0.1 * (v + 1))) for k in [*(c[w] for w in words(t)), len(train)])
        r = out[L.F and (2**63 - 1 if i is None else i), round(base, 6)]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words(t)) + 1, sum(c[w] > 0 for w in words(t)) + (len(train) > 0), n)
        assert r.score < 0 and r.bits_per_byte > 0
    return out


def test_edges(spark):
    rows = [(0, "The cat The mat"), (1, None), (2, ""), (3, "caté CATÉ cat"), (4, "the cat " * 3000), (4, "the cat " * 3000), (None, "unseen words here"), (5, "new"), (20, "the new")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, score int")
    out = check(spark, docs, rows)
    assert len(out) == len(rows) - 1
    assert L.score(docs.limit(0), lambda i: L.fold(i, 10) != 0).count() == 0


def test_held_out_beats_unigrams(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(spark, docs, rows)
    r = L.op5_context_mixing(spark, sf).where("held_out").toPandas()
    assert len(r) and r.score.sum() > r.base_score.sum()


def test_counting_needs_little_beside_its_table():
    """Of several megabytes of text only a small part is taken apart at a time, and the counts are those of all."""
    texts = ["".join(chr(97 + (i * j) % 26) if j % 6 else " " for j in range(4000)) for i in range(1, 800)]
    code = L.Code(np.bincount(np.frombuffer("".join(texts[:9]).encode(), np.uint8), minlength=256))
    batch = pa.RecordBatch.from_pydict({"text": texts})
    tracemalloc.start()
    try:
        total = np.zeros((L._OFFSETS[-1] // L._PIECE, L._PIECE, 2), np.uint32)
        before = tracemalloc.get_traced_memory()[0]
        pieces = [(r["part"][0].as_py(), r["counts"][0].as_py()) for r in L._counts(code)(iter([batch]))]
        peak = tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()
    for part, packed in pieces:
        total[part] = np.frombuffer(zstandard.decompress(packed), np.uint32).reshape(-1, 2)
    whole = np.zeros((L._OFFSETS[-1], 2), np.uint32)
    L.count(whole, code, [" ".join(t.split()).encode() + L.END for t in texts])
    assert (total.reshape(-1, 2) == whole).all()
    assert peak < whole.nbytes + (100 << 20)
