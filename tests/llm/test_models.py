"""Language identification, toxicity, quality and language-model scoring on the small tables."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from apiarium.llm import common, langid, lm, quality, queries, textcore, toxicity

SF = "/root/testdata/sf0.01"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [(-1, None), (-2, ""), (-3, " 123 !"), (-4, "de la que " * 60_000), (-5, "é"), (-6, "\x00 a"), (-1, None)]
SCHEMA = "doc_id long, text string, lang string, label string, score string, word string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(d, t, None, None, None, None) for d, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def labelled(spark):
    return common.documents(spark, SF).join(common.labels(spark, SF), "doc_id")


def test_folds(spark):
    got = {r[0]: r[1] for r in spark.range(50).select("id", common.fold_of(F.col("id"), 4)).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 for i in range(50)}


def test_language_id(spark, odd):
    docs = common.documents(spark, SF)
    held = queries.op2_language_id(spark, SF).join(docs, "doc_id").filter("held_out")
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    got = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert [got[d].lang_pred for d in (-1, -2, -3)] == ["und"] * 3 and got[-1].score == 0
    assert got[-4].lang_pred in model.langs and got[-5].lang_pred in model.langs
    assert langid.predict(odd, model).count() == len(ODD)
    none = langid.fit(docs.filter("false").select("doc_id", "text", "lang"))
    assert {r.lang_pred for r in langid.predict(odd, none).collect()} == {"und"}


def test_more_languages_than_a_block(spark):
    names = [chr(0x4E00 + i) * 3 for i in range(300)]  # a language of one sign each
    train = spark.createDataFrame([(i, t, f"l{i:03}") for i, t in enumerate(names)], "doc_id long, text string, lang string")
    model = langid.fit(train)
    assert len(model.langs) == 300
    got = langid.predict(train, model).join(train, "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.9 and {r.lang_pred for r in got} & {f"l{i}" for i in range(256, 300)}


def test_language_sample_is_bounded_and_needs_no_identifier(spark):
    words = ["der hund und die katze", "the dog and the cat"]
    rows = [(1 if i % 2 else None, f"{words[i % 2]} {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}", ("de", "en")[i % 2]) for i in range(3000)]
    rows += [(7, "one text of many copies", "en")] * 3000
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    few = langid.sample(train, 100).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in few} == {"de": 100, "en": 100}
    assert langid.fit(train).langs == ["de", "en"]


def test_quality(spark, odd, labelled):
    docs = common.documents(spark, SF)
    held = queries.op8_quality(spark, SF).filter("held_out").join(common.labels(spark, SF), "doc_id")
    assert held.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.9
    model = quality.fit(docs, common.labels(spark, SF))
    got = quality.score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert kept.join(common.labels(spark, SF), "doc_id").filter("quality = 1").count() > 0.97 * labelled.filter("quality = 1").count()
    one = common.labels(spark, SF).filter("quality = 1")
    assert {r.score for r in quality.score(odd, quality.fit(docs, one)).collect()} == {1.0}


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5))
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    p = quality.Network().fit(x, y).probability(rng.normal(size=(4000, 5)))
    assert 0.4 < p.mean() < 0.6
    again = quality.Network().fit(x, y).probability(x)
    assert np.array_equal(again, quality.Network().fit(x, y).probability(x))
    assert abs(((again > 0.8) * y).sum() / (again > 0.8).sum() - again[again > 0.8].mean()) < 0.08


def test_toxicity(spark, odd):
    rng = np.random.default_rng(1)
    word = lambda n: " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}or" for i in rng.integers(0, 500, n))
    rows = []
    for i in range(1200):
        toxic = i % 6 == 0
        w = word(60).split()
        for k in range(4 * toxic):
            w.insert(int(rng.integers(0, len(w))), ["bastardly", "zzyxqua", "grumpfh"][int(rng.integers(0, 3))])
        rows.append((i, " ".join(w), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    train = docs.filter("doc_id % 5 <> 0").select("doc_id", "toxic")
    model = toxicity.fit(docs.drop("toxic"), train)
    got = toxicity.score(docs.drop("toxic"), model).join(docs, "doc_id").filter("doc_id % 5 = 0").toPandas()
    assert ((got["score"] >= 0.5) == (got["toxic"] == 1)).mean() > 0.97
    odd_scores = toxicity.score(odd, model).collect()
    assert len(odd_scores) == len(ODD) and all(0 <= r.score <= 1 for r in odd_scores)
    assert all(r.score < 0.5 for r in odd_scores if r.doc_id != -4)
    assert {r.score for r in toxicity.score(odd, toxicity.fit(docs.drop("toxic"), train.filter("toxic = 0"))).collect()} == {0.0}


def test_windows_cover_all_words():
    text = "Ab cd, é-f " * 40 + "x" * 300
    data = np.frombuffer((text + "second row").encode(), dtype=np.uint8)
    off = np.array([0, len(data) - 10, len(data) - 10, len(data)])
    s, e, row = textcore.words(data, off, toxicity.IS_LETTER)
    for shift in (0, 24):
        start, size, rows = toxicity.windows(s, e, row, off, shift)
        covered = np.zeros(len(data) + 2, bool)
        for a, n in zip(start, size, strict=True):
            covered[a : a + n] = True
        assert all(covered[a + 1 : b + 1].all() for a, b in zip(s, e, strict=True)) and set(rows) == {0, 2}


def test_language_model(spark):
    got = queries.op7_lm_scoring(spark, "/root/testdata/sf0.001").toPandas().set_index("doc_id")
    docs = {r.doc_id: SPACED.findall((r.text or "").translate(LOWER)) + [None] for r in common.documents(spark, "/root/testdata/sf0.001").collect()}
    count: Counter = Counter()
    for d, w in docs.items():
        if zlib.crc32(str(d).encode()) % 5 != 1:
            count.update(w)
    n, v = sum(count.values()), len(count)
    for d, w in docs.items():
        r = got.loc[d]
        base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert abs(base - r.base_score) < 1e-6 * abs(base) and (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(count[x] > 0 for x in w), n)
    assert got["score"].sum() > got["base_score"].sum()


def test_language_model_cases(spark, odd):
    model, counts = lm.fit(common.documents(spark, "/root/testdata/sf0.001"), rounds=1, steps=5)
    got = {r.doc_id: r for r in lm.score(odd, model, counts).collect()}
    assert len(got) == 6 and lm.score(odd, model, counts).count() == len(ODD)
    assert (got[-1].n_tokens, got[-2].n_tokens, got[-4].n_tokens) == (1, 1, 180_001)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got.values())
    none, counts = lm.fit(odd.filter("false"))
    assert all(r.train_tokens == 0 and math.isfinite(r.score) for r in lm.score(odd, none, counts).collect())


def test_language_model_end_below_the_frequent_cut(spark):
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(words * 3))], "doc_id long, text string")
    model, counts = lm.fit(docs, frequent=8, rounds=1, steps=2)
    got = lm.score(docs, model, counts).first()
    n, v = 121, 41
    want = sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in [3] * 120 + [1])
    assert model.vocabulary.ends == 1 and abs(got.base_score - want) < 1e-6 * abs(want)


def test_language_model_tells_same_shaped_words_apart(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(300):
        w = [f"w{j:03}" for j in rng.permutation(260)]
        for k, pair in enumerate(("cat dog", "hen pig") * (i % 2)):
            w.insert(60 * k + 20, pair)
        rows.append((i, " ".join(w)))
    model, counts = lm.fit(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), rounds=1)
    asked = spark.createDataFrame([(1, "cat dog"), (2, "cat pig"), (3, "hen pig"), (4, "hen dog")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score(asked, model, counts).collect()}
    assert got[1] + got[3] > got[2] + got[4] + 1


def test_every_token_is_trained_on(monkeypatch):
    class Held:
        def __init__(self, value):
            self.value = value

    v = lm.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), 3, 9, 3, 1 + lm.CLASSES)
    net = lm.LogBilinear(np.full(v.size, 1 / v.size), dim=4)
    seen = []
    monkeypatch.setattr(net, "step", lambda one, two, w, rng, **_: seen.append(len(w)))
    texts = pa.array(["a bc " * 50_000, None, "d" + " e" * 130_000])
    out = list(lm._steps(Held(v), Held(net), Held(net.pack()), 1, 0)(iter([pa.RecordBatch.from_arrays([texts], names=["text"])])))
    assert sum(seen) == 100_000 + 130_001 + 3 and {n for b in out for n in b.column("n").to_pylist()} == {sum(seen)}


def test_probabilities_are_normalised():
    net = lm.LogBilinear(np.full(40, 1 / 40), dim=8)
    rng = np.random.default_rng(0)
    net.train(rng.integers(0, 40**3, 500), rng.integers(1, 9, 500).astype(float), steps=20, batch=64)
    w = np.arange(40)
    for one, two in ((0, 0), (3, 39)):
        assert abs((10 ** net.log10(np.full(40, one), np.full(40, two), w)).sum() - 1) < 1e-5


def test_noise_contrastive_training_finds_a_bigram():
    k = 20  # after word a stands a + 1
    code = np.array([(2 * k + a) * k + (a + 1) % k for a in range(k)])
    net = lm.LogBilinear(np.full(k, 1 / k), dim=16)
    net.train(code, np.ones(k), steps=400, batch=256, noise=64)
    a = np.arange(k)
    assert net.log10(a, np.full(k, 2), (a + 1) % k).mean() > math.log10(0.5)
