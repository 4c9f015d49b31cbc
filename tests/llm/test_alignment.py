import random
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from shopgrain.llm import alignment as A
from shopgrain.llm.bpe import byte_alphabet

ALPHABET = "aaabbeestrndi  \n\t\x1c  　 éÉß0123.,'!-中文のカ🙂\x00"
SPECIAL = ["<|endoftext|>", "<s> </s>", "<unk>", "<0x41>", " a", "a ", "a  ", " ", "   ", "\n", " \n ", "x▁y", "▁", "a　 b", "ab\n cd", "word " * 50, "don't we'll  it's"]


@pytest.fixture(scope="module")
def library():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte_of = {c: i for i, c in enumerate(byte_alphabet())}

    def tokens(text):
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        ta = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ia]
        tb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        return ia, ib, ta, tb

    return tokens


def aligned(library, text):
    """n_a, n_b, groups and the list of linked pairs, comparing byte ranges one by one."""
    if not text:
        return 0, 0, [], []
    ia, ib, ta, tb = library(text)
    if not b"".join(ta) == b"".join(tb) == (" " + text).encode():
        return 0, 0, [], []
    ea, eb = np.cumsum([len(t) for t in ta]), np.cumsum([len(t) for t in tb])
    links = [(x, y) for x, p, n in zip(ia, ea, ta) for y, q, m in zip(ib, eb, tb) if p - len(n) < q and q - len(m) < p]
    groups, i, j = [], 0, 0
    for cut in sorted(set(ea.tolist()) & set(eb.tolist())):
        k, l = int(np.searchsorted(ea, cut)) + 1, int(np.searchsorted(eb, cut)) + 1
        groups.append((ia[i:k], ib[j:l]))
        i, j = k, l
    return len(ia), len(ib), groups, links


def expected(library, rows):
    found = [(i, aligned(library, t)) for i, t in rows]
    count = Counter(p for _, f in found for p in set(f[3]))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for i, (n_a, n_b, groups, links) in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = sha256(text.encode()).hexdigest() if text else ""
        out.append((str(i), n_a, n_b, len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), digest))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    words = ["".join(rng.choice("aeioutnrs") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    out = [(i, t) for i, t in enumerate(SPECIAL)] + [(None, None), (None, "null id"), (50, ""), (3, "again x"), (3, "again x"), (51, "ab" * 700)]
    out += [(100 + k, "".join(rng.choice(ALPHABET) for _ in range(rng.choice([1, 5, 80])))) for k in range(60)]
    out += [(200 + k, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for k in range(60)]
    return out


def digests(df):
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


def test_query_against_brute_force(spark, library, rows, tmp_path):
    spark.createDataFrame([(i, t, 1, b"") for i, t in rows], "doc_id long, text string, block int, keys binary").write.parquet(f"{tmp_path}/documents.parquet")
    got = A.op12_minimal_hash(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {t for _, t in got.dtypes[:-1]} == {"bigint"}
    assert digests(got) == expected(library, rows)


def test_parts_levels_and_slices_do_not_matter(spark, library, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = A.aligned(docs, task_pairs=50, blocks=5, fan=2, slice_bytes=4000)
    want = A.aligned(docs)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert len(A._slices([(r.block, r.size) for r in A.pair_counts(docs, A.vocabulary_paths(), blocks=5).selectExpr("block", "length(hash) + length(vector) AS size").collect()], 4000)) > 1


def test_minimal_hash_is_perfect_and_verified():
    keys = np.random.default_rng(3).choice(1 << 31, 20_000, replace=False).astype(np.int64)
    for n in (0, 1, 2, 20_000):
        assert sorted(A.MinimalHash(keys[:n])(keys[:n]).tolist()) == list(range(n))
    counts = A.Counts.of(keys[:1000])
    assert (counts.keys[counts.index(keys[:1000])] == keys[:1000]).all()
    with pytest.raises(KeyError):
        counts.index(keys[1000:1010])


def test_real_output(spark, library):
    docs = spark.createDataFrame([(1, "straightforwardness untied")], "doc_id long, text string")
    r = A.aligned(docs).first()
    groups = [tuple([int(i) for i in side.split(",")] for side in g.split("|")) for g in r.groups.split(";")]
    assert groups == aligned(library, "straightforwardness untied")[2] and r.n_best <= r.n_links == r.count_sum


def test_empty(spark):
    assert A.aligned(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only_null = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [tuple(r) for r in A.aligned(only_null).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]
