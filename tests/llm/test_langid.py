import random
import string

import numpy as np
from pyspark.sql import functions as F

from shopgrain.llm import langid as L

WORDS = {"aa": ["kola", "mira", "tunu", "sabe"], "bb": ["zwix", "qrelt", "vrunsk", "drobh"]}


def rows():
    rng = np.random.default_rng(1)
    return [(i, " ".join(rng.choice(WORDS[k], 30)), k) for i in range(60) for k in [("aa", "bb")[i % 2]]]


def test_grams_count_inside_rows():
    data, offsets = np.frombuffer(b"abcABCa", np.uint8), np.array([0, 3, 6, 7])
    c = L.grams(data, offsets)
    assert c.sum(1).tolist() == [3, 3, 0] and (c[0] == c[1]).all()


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("0.001", "0.01")
    r = L.op3_nearest_centroid(spark, sf).toPandas()
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas()
    m = r.merge(truth, on="doc_id")
    m = m[m.held_out]
    assert len(r) == len(truth) and (m.lang == m.lang_pred).mean() > 0.97
    assert r.score.between(0, 1).all() and r.rejected.mean() < 0.02


def test_edges(spark):
    train = spark.createDataFrame([*rows(), (100, None, "aa"), (101, "kola mira", None), (102, "", "bb")], "doc_id long, text string, lang string")
    model = L.fit(train)
    docs = spark.createDataFrame([(1, "kola tunu mira sabe", 9.0), (1, "vrunsk drobh", 9.0), (2, None, 9.0), (3, "123 !!", 9.0), (None, "", 9.0), (4, "あいうえお" * 40, 9.0), (5, "kola mira " * 30000, 9.0)], "doc_id long, text string, score double")
    out = {(r.doc_id, r.text): r for r in L.predict(docs, model).collect()}
    assert out[1, "kola tunu mira sabe"].lang_pred == "aa" and out[1, "vrunsk drobh"].lang_pred == "bb"
    for key in ((2, None), (3, "123 !!"), (None, "")):
        assert out[key].lang_pred == "und" and out[key].score == 0 and out[key].rejected
    assert out[4, "あいうえお" * 40].rejected
    assert not out[5, "kola mira " * 30000].rejected
    assert len(out) == 7


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert L.fit(empty) is None and L.predict(empty, None).count() == 0


def test_unlearnt_languages_and_random_letters_are_rejected(spark, sf):
    """With the false rejections of held-out rows beside."""
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/documents.parquet").select("doc_id", "text", "lang")
    held_out = L.fold(F.col("doc_id"), 3) == 1
    model = L.fit(docs.where(~held_out))
    rng = random.Random(3)
    strange = [
        "tämä on suomenkielinen kertomus talvesta ja järvistä sekä metsistä joita meillä on paljon ja joissa kuljemme hiihtäen kun lunta riittää keväälle asti ja yöllä näemme tähtiä "
        "kylän vanhin muistaa vielä kuinka veneet vedettiin rannalle ennen jäiden tuloa ja miten verkot korjattiin tuvassa takkatulen ääressä pitkinä pimeinä iltoina",
        "to jest polskie opowiadanie o zimie i jeziorach oraz lasach których jest bardzo dużo w tym kraju gdzie śnieg leży aż do wiosny a nocą widać wszystkie gwiazdy nad polami "
        "najstarszy mieszkaniec wsi pamięta jeszcze jak łodzie wyciągano na brzeg przed nadejściem lodu i jak naprawiano sieci w izbie przy ogniu podczas długich wieczorów",
        "это русское предложение о зиме и озерах а также о лесах которых очень много в этой стране где снег лежит до самой весны а ночью видны все звезды над полями",
        "这是一个关于冬天和湖泊以及森林的中文句子这里有很多雪一直下到春天晚上可以看到田野上所有的星星村里最老的人还记得冰来之前船是怎样被拉到岸上的渔网又是怎样在炉火旁边修补好的漫长的夜晚",
        *(" ".join("".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randrange(3, 9))) for _ in range(60)) for _ in range(10)),
        *("".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(400)) for _ in range(10)),
    ]
    out = {r.doc_id: r.rejected for r in L.predict(spark.createDataFrame(list(enumerate(strange)), "doc_id long, text string"), model).collect()}
    assert [i for i in range(24) if not out[i]] == []
    good = L.predict(docs.where(held_out & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}")), model)
    assert good.count() > 3000 and good.where("rejected").count() <= 0.002 * good.count()
