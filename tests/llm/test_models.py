import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import language, quality

WORDS = {
    "en": "the of and to in that with water stone river light".split(),
    "de": "der die und zu in dass mit wasser stein fluß licht über".split(),
    "fr": "le la et de dans que avec eau pierre rivière lumière été".split(),
}


def _corpus(spark, n=600, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        words = [rng.choice(WORDS[lang]) for _ in range(rng.randint(20, 120))]
        bad = rng.random() < 0.3
        if bad:
            words = rng.choice([[w + "$$$" for w in words], [words[0]] * len(words), [w.upper() + "!!" for w in words]])
        rows.append((i, " ".join(words), lang, "s", 0))
        labels.append((i, int(not bad), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(spark):
    docs, labels = _corpus(spark)
    model = quality.train(docs, labels)
    rows = {r.doc_id: r for r in quality.classify(docs, model).collect()}
    want = {r.doc_id: r.quality for r in labels.collect()}
    held = [i for i in rows if rows[i].held_out]
    assert held == [i for i in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([rows[i].predicted == want[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.predicted}


def test_held_out_labels_do_not_matter(spark):
    docs, labels = _corpus(spark, 200)
    turned = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - quality, quality) as quality", "toxic")
    a, b = (quality.train(docs, x) for x in (labels, turned))
    assert np.array_equal(a.weights, b.weights) and a.shift == b.shift


def test_quality_of_odd_tables(spark):
    docs, labels = _corpus(spark, 100)
    model = quality.train(docs, labels)
    odd = spark.createDataFrame([(None, None, 1.0), (1, "", 2.0), (1, "", 2.0), (2, " \n ", 0.0), (3, "a" * 100_000, 0.0)], "doc_id long, text string, score double")
    rows = quality.classify(odd, model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert quality.classify(docs.limit(0), model).count() == 0
    only_good = quality.train(docs, labels.where("quality = 1"))
    assert {r.predicted for r in quality.classify(docs, only_good).collect()} == {1}
    nothing = quality.train(docs, labels.limit(0))
    assert quality.classify(docs, nothing).count() == 100
    assert len(quality.features(None)) == len(quality.features("a b")) == quality.N_FEATURES


def test_ranking_prefers_by_features():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, quality.N_FEATURES))
    y = (x[:, 3] - x[:, 5] > 0).astype(int)
    model = quality.fit(x, y)
    assert ((model.score(x) >= quality.THRESHOLD) == y).mean() > 0.97


def test_language_on_held_out_rows(spark):
    docs, _ = _corpus(spark)
    model = language.train(docs)
    rows = language.identify(docs, model).collect()
    want = {r.doc_id: r.lang for r in docs.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == want[r.doc_id] for r in rows if r.held_out]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_tables(spark):
    docs, _ = _corpus(spark, 150)
    model = language.train(docs)
    odd = spark.createDataFrame([(None, None, "x"), (1, "", "x"), (2, "12 34 !!", "x"), (3, "日本", "x"), (3, "日本", "x"), (4, "the water " * 30_000, "x")], "doc_id long, text string, lang_pred string")
    got = {r.doc_id: r for r in language.identify(odd, model).collect()}
    assert [got[i].lang_pred for i in (None, 1, 2)] == ["und"] * 3 and got[2].score == 0
    assert got[3].lang_pred in WORDS and got[4].lang_pred == "en"
    assert language.identify(docs.limit(0), model).count() == 0
    empty = language.train(docs.limit(0))
    assert {r.lang_pred for r in language.identify(docs, empty).collect()} == {"und"}


def _put(*texts):
    return np.unique(np.concatenate([language.ngrams(t) for t in texts])).view(np.int64)


def test_filters_hold_what_was_put_in():
    h = language.ngrams("the quick brown fox")
    model = language.build({"en": _put("the quick brown fox"), "fr": np.zeros(0, np.int64)})
    assert (model.masks(h) & np.uint64(1) == 1).all()
    assert model.predict("the quick")[0] == "en" and (model.rates >= 0).all() and model.rates[1] == 0


@pytest.mark.parametrize("n", [3, 70, 130])
def test_masks_equal_exact_sets(n):
    """Every language that holds an n-gram is in its mask; others only as often as the rates say; hits are the masks' bits."""
    rng = random.Random(n)
    held = {f"l{i:03d}": np.array(sorted({rng.getrandbits(63) for _ in range(rng.choice([5, 400, 3000]))}), np.int64) for i in range(n)}
    model = language.build(held)
    asked = np.array([rng.getrandbits(63) for _ in range(500)] + [int(x) for v in held.values() for x in v[:20]], np.int64)
    masks = model.masks(asked.view(np.uint64))
    names = sorted(held)
    got = np.array([[bool(int(row[i // 64]) >> (i % 64) & 1) for i in range(n)] for row in masks])
    want = np.stack([np.isin(asked, held[k]) for k in names], axis=1)
    assert (got | ~want).all()  # nothing held is missed
    assert np.array_equal(model.hits(asked.view(np.uint64)), got.sum(axis=0))
    false = (got & ~want).mean(axis=0)
    assert np.all(np.abs(false - model.rates) < 0.05)


def test_many_languages_of_unequal_size(spark):
    """Eighty languages, of 4 to 200 documents: each is learned and predicted on its held-out rows."""
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    vocabulary = {f"l{i:02d}": ["".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(40)] for i in range(80)}
    rows, i = [], 0
    for n, (lang, words) in enumerate(vocabulary.items()):
        for _ in range(200 if n < 4 else 4 + n % 9):
            rows.append((i, " ".join(rng.choice(words) for _ in range(40)), lang))
            i += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs, sample=50)
    assert len(model.languages) == 80 and model.table.shape[1] == 2
    want = {r[0]: r[2] for r in rows}
    held = [r for r in language.identify(docs, model).collect() if r.held_out]
    assert len({want[r.doc_id] for r in held}) > 62
    assert all(r.lang_pred == want[r.doc_id] for r in held)


def test_each_language_keeps_its_own_ngrams(spark):
    """The limit on n-grams holds for each language alone, by rate: a rare language loses none to a large one."""
    counts = [("big", h, 900 + h % 50) for h in range(100)] + [("rare", 1000 + h, 2 + h % 2) for h in range(10)] + [("rare", 5, 1)]
    rows = spark.createDataFrame(counts, "lang string, h long, n long")
    sizes = spark.createDataFrame([("big", 1000), ("rare", 4)], "lang string, n long")
    got = {}
    for r in language.held_ngrams(rows, sizes, 10).collect():
        got.setdefault(r.lang, set()).add(r.h)
    assert got["rare"] == set(range(1000, 1010)) and got["big"] == {49, 99, 48, 98, 47, 97, 46, 96, 45, 95}


def test_held_out_languages_do_not_matter(spark):
    docs, _ = _corpus(spark, 200)
    turned = docs.withColumn("lang", F.expr("if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 'xx', lang)"))
    a, b = (language.train(d) for d in (docs, turned))
    assert a.languages == b.languages and np.array_equal(a.table, b.table)


def test_ngrams_equal_brute_force(monkeypatch):
    text = "Ab, c'É straße\n12 x日本 İ"
    import re

    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    padded = re.sub(r" +", " ", "".join(c if c.isalpha() else " " for c in " " + low + " "))
    want = [padded[i : i + n] for n in language.SIZES for i in range(len(padded) - n + 1)]
    want = [g for g in want if " " not in g[1:-1] and g.strip()]
    assert len(language.ngrams(text)) == len(want) and len(set(language.ngrams(text).tolist())) == len(set(want))
    long = "alpha beta gamma " * 50
    whole = sorted(language.ngrams(long).tolist())
    monkeypatch.setattr(language, "CHUNK", 40)
    parts = sorted(language.ngrams(long).tolist())
    assert set(whole) == set(parts)
