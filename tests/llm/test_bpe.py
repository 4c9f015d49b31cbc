import random
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shopgrain.llm import bpe as B

PATH = public_tokenizers.path(B.VOCABULARY)
#: Letters, marks, numbers, white space and pictures of one to four bytes; characters whose lower case is longer, and one newer than this Python's tables.
ALPHABET = "aaabbeestrndiou'éÉßΣİé 　 \n\t\x1c0123٣½!\"?.-_<|>endoftext中文字のを🙂👍ǅᲉ"
TEXTS = [
    "", " \n\t", "a<|endoftext|>b <|startoftext|><|endoftext|>", "<|EndOfText|> <|endoftext", "it's we'll '' 's 'sx ''s don'ts I'd'd 'RE you're'", "ΑΣ ΟΔΟΣ", "ᲊx a'ſ",
    "a" * 4000, "ab" * 2000, "x" * 70 + " " + "y" * 70, "the " * 3000, "12345 ١٢", "é" * 300, "'", "<|endoftext|>", "n'" * 50,
]


@pytest.fixture(scope="module")
def model():
    return B.PrefixModel(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(seed, n):
    rng = random.Random(seed)
    return TEXTS + ["".join(rng.choice(ALPHABET) for _ in range(rng.choice([0, 1, 3, 20, 200]))) for _ in range(n)]


def test_ids_equal_the_library(model, library):
    docs = texts(1, 400)
    ids, counts = B.encode_texts(model, docs)
    at = np.append(0, np.cumsum(counts))
    for k, t in enumerate(docs):
        assert ids[at[k] : at[k + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_every_vocabulary_entry_encodes_like_the_library(model, library):
    words = [s.replace("</w>", "") for s in model.strings[512:]]
    ids, counts = B.encode_texts(model, words)
    at = np.append(0, np.cumsum(counts))
    for k, e in enumerate(library.encode_batch(words, add_special_tokens=False)):
        assert ids[at[k] : at[k + 1]].tolist() == e.ids


def test_random_words_and_both_programmes(model, library):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghinoprstu") for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    ids, _ = B.encode_texts(model, [" ".join(words)])
    assert ids.tolist() == library.encode(" ".join(words), add_special_tokens=False).ids
    one_by_one = np.concatenate([B.encode_texts(model, [w])[0] for w in words[:200]])  # below FEW words the plain programme runs
    assert one_by_one.tolist() == ids[: len(one_by_one)].tolist()


def test_query_against_the_library(spark, library, tmp_path):
    rows = [(i, t) for i, t in enumerate(texts(2, 60))] + [(None, "null id"), (7, None), (3, "again"), (3, "again")]
    spark.createDataFrame([(i, t, b"", 5) for i, t in rows], "doc_id long, text string, ids binary, n_tokens int").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((str(i), len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(decoded.encode()).hexdigest()))
    got = B.op13_prefix_bpe(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == sorted(want)


def test_decoding_of_any_ids_and_empty_tables(spark, library):
    tables = B.model(spark)
    cells = [np.array(x, "<u4").tobytes() for x in ([5, 49407, 600], [10**6, 5], [], [49405])] + [None]
    rows = spark.createDataFrame([(k, bytearray(c) if c is not None else None) for k, c in enumerate(cells)], "k int, ids binary")
    got = {r.k: r.decoded for r in B.decoded(rows, tables).collect()}
    assert got == {k: library.decode(np.frombuffer(c or b"", "<u4").tolist(), skip_special_tokens=False) for k, c in enumerate(cells)}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert B.decoded(B.encoded(empty, tables), tables).count() == 0


def test_a_merge_before_its_parts_is_refused(tmp_path):
    import json

    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    bad = tmp_path / "bad.json"
    bad.write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError, match="before its parts"):
        B.PrefixModel(str(bad))
