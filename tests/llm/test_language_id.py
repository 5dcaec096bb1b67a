"""Language identification: held-out accuracy, what teaches it, and the cases of rows."""

import zlib
from pathlib import Path

import numpy as np
import pytest

from palimpsest.llm import language_id as L

SF = Path("/root/testdata/sf0.01")
WORDS = {"en": "the of and to in is that for with was", "de": "der die und das nicht ist mit ein auch von", "fr": "les des est une dans pour qui pas vous avec", "es": "los las una por con para como más pero está", "fi": "ja on ei että hän mutta kun niin ovat myös"}


def toy(n=40):
    rng = np.random.default_rng(5)
    return [(int(i * 5 + k), " ".join(rng.choice(w.split(), 30)), lang) for i in range(n) for k, (lang, w) in enumerate(WORDS.items())]


def test_families():
    assert L.family_of("en") == L.family_of("de-AT") == "germanic" and L.family_of("PT_br") == "romance" and L.family_of("qq") == "other"


def test_grams_are_whole_texts():
    assert L.grams("12 .,! \n") is None and L.grams("") is None
    (one, *_) = L.grams("Ab")
    assert len(one) == 4  # a blank on either side
    a, b = L.sparse("hello world"), L.sparse("HELLO,   world 42")
    assert (a[0] == b[0]).all() and a[1] == pytest.approx(b[1])
    assert sum(a[1]) == pytest.approx(L.ORDERS)


def test_letters_are_category_l():
    for none in ("½ ² Ⅷ ①", "٣ 42 _", "\u0301\u0300", "🙂"):
        assert L.grams(none) is None
    every = "".join(chr(c) + "x" for c in range(0x250) if not 0xD800 <= c < 0xE000)
    assert L.letters(every) == L._NO_LETTERS.sub(" ", every.lower()) and L.letters(every[:300]) == L._NO_LETTERS.sub(" ", every[:300].lower())
    # vowel signs stay in their words
    assert L.grams("किताब")[0].size == len("किताब") + 2


def test_many_languages_in_small_families():
    rng = np.random.default_rng(1)
    rows = []
    for k in range(200):
        words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(4)]
        for _ in range(3):
            ids, v = L.sparse(" ".join(rng.choice(words, 20)))
            rows.append((f"x{k:03}", ids, (v * L.SCALE).astype(np.float32)))
        rows[-1] = (rows[-1][0], rows[-1][1], rows[-1][2])
    families = L.families_of(rows)
    assert sorted(x for langs in families.values() for x in langs) == sorted({r[0] for r in rows})
    assert max(map(len, families.values())) <= L.MAX_FAMILY


def slow_prediction(model, text):
    """Votes and score by the definition, one machine at a time over plain dictionaries."""
    import math

    values = dict(zip(*map(list, L.sparse(text))))

    def sure(key):
        c = model.column[key]
        weights = model.blocks[0][:, c] if len(model.blocks) == 1 else None
        if weights is None:
            names = list(model.families)
            if len(key) == 1:
                weights = model.blocks[0][:, c]
            else:
                at = next(i for i, f in enumerate(names) if key[0] in model.families[f])
                pairs = [(x, y) for i, x in enumerate(model.families[names[at]]) for y in model.families[names[at]][i + 1 :]]
                weights = model.blocks[1 + at][:, pairs.index(key)]
        margin = sum(float(weights[f]) * v for f, v in values.items()) + model.bias[c]
        return 1 / (1 + math.exp(min(500, max(-500, model.platt[c][0] * margin + model.platt[c][1]))))

    of = {f: sure((f,)) if (f,) in model.column else 1.0 for f in model.families}
    family = max(of, key=of.get)
    langs = model.families[family]
    against = {x: {y: (sure((x, y)) if (x, y) in model.column else 1 - sure((y, x))) for y in langs if y != x} for x in langs}
    votes = {x: sum(q > 0.5 or (q == 0.5 and x < y) for y, q in against[x].items()) for x in langs}
    lang = max(langs, key=lambda x: (votes[x], sum(against[x].values())))
    return lang, of[family] / sum(of.values()) * (sum(against[lang].values()) / (len(langs) - 1) if len(langs) > 1 else 1)


@pytest.mark.parametrize("at_once", [64, 0])
def test_votes_equal_plain_ones(spark, monkeypatch, at_once):
    monkeypatch.setattr(L, "AT_ONCE", at_once)
    rows = toy()
    model = L.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.blocks) == (1 if at_once else 1 + len(model.families))
    for text in [t for _, t, _ in rows[::7]] + ["the der les las", "x"]:
        lang, score = model.predict(text)
        want = slow_prediction(model, text)
        assert lang == want[0] and score == pytest.approx(want[1], rel=1e-4)


def test_no_language_is_left_out_and_copies_count_once(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "".join(rng.choice(list("abcdefghij"), 30)), f"x{i % 150:03}") for i in range(450)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    copies = spark.range(100_000).selectExpr("7L as doc_id", "'the same text again' as text", "'x000' as lang")
    model = L.fit_languages(docs.unionByName(copies), sample=3)
    assert sum(map(len, model.families.values())) == 150


def test_tasks_fit_the_same_machines(spark):
    rows = [(lang, *(a, (v * L.SCALE).astype(np.float32))) for _, t, lang in toy(8) for a, v in [L.sparse(t)]]
    here, there = L.fit(rows), L.fit(rows, spark)
    assert here.column == there.column and np.allclose(here.blocks[0], there.blocks[0]) and np.allclose(here.platt, there.platt)


def test_machines_separate():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 6))
    y = np.where(x[:, 0] - 2 * x[:, 3] > 0.3, 1, -1)
    rows = [(np.arange(6, dtype=np.int32), r) for r in x]
    w, bias, a, b = L._svm(rows, y, 6, epochs=3000)
    cost = 10 * len(y) / 2 / np.where(y > 0, (y > 0).sum(), (y < 0).sum())

    def objective(w, bias):
        return 0.5 * w @ w + 0.5 * (10 * bias) ** 2 + cost @ np.maximum(0, 1 - y * (x @ w + bias))

    # the optimum of the primal problem: nothing near it is better
    best = objective(w, bias)
    for _ in range(300):
        assert objective(w + rng.normal(size=6) * 0.05, bias + rng.normal() * 0.005) >= best - 1e-3 * best
    margin = x @ w + bias
    p = 1 / (1 + np.exp(a * margin + b))
    assert p[y > 0].mean() > 0.8 > 0.2 > p[y < 0].mean()


def test_predicts_by_family_then_language(spark):
    rows = toy()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r._language for r in L.identify(docs).collect()}
    right = [out[i].lang_pred == lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(right) > 20 and np.mean(right) > 0.97
    assert all(0 <= p.score <= 1 for p in out.values())
    model = L.fit_languages(docs)
    assert model.families == {"germanic": ["de", "en"], "romance": ["es", "fr"], "uralic": ["fi"]}
    assert ("en",) not in model.column and ("de", "en") in model.column and ("de", "fr") not in model.column


def test_held_out_rows_teach_nothing(spark):
    rows = toy()
    wrong = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    schema = "doc_id long, text string, lang string"
    a, b = (L.identify(spark.createDataFrame(r, schema)).select("doc_id", "_language.*").collect() for r in (rows, wrong))
    assert sorted(a) == sorted(b)


def test_cases_of_rows(spark):
    rows = toy(20) + [(10_001, None, "en"), (10_002, "", None), (10_003, "123 !?", "de"), (None, WORDS["fr"], None), (10_004, WORDS["de"], None), (10_004, WORDS["de"], None), (10_005, (WORDS["fi"] + " ") * 20_000, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    out = L.identify(docs).collect()
    assert len(out) == len(rows) and {r.score for r in out} == {"x"}
    found = {r.doc_id: tuple(r._language) for r in out}
    assert found[10_001] == found[10_002] == found[10_003] == ("und", 0.0)
    assert found[None][0] == "fr" and found[10_004][0] == "de" and found[10_005][0] == "fi"
    schema = "doc_id long, text string, lang string"
    assert L.identify(spark.createDataFrame([], schema)).collect() == []
    none = L.identify(spark.createDataFrame([(1, "some text", None)], schema)).collect()
    assert tuple(none[0]._language) == ("und", 0.0)
    one = L.identify(spark.createDataFrame([(i, WORDS["en"], "en") for i in range(8)], schema)).collect()
    assert {tuple(r._language) for r in one} == {("en", 1.0)}


def test_stage_returns_the_columns_of_documents(spark):
    rows = toy(20) + [(10_001, None, "en"), (10_002, "12 34", "de")]
    docs = spark.createDataFrame([(*r, "y") for r in rows], "doc_id long, text string, lang string, _language string")
    out = L.stage(spark, docs, "")
    assert out.columns == docs.columns
    got = out.collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows[:-2]} and {r._language for r in got} == {"y"}


@pytest.mark.skipif(not SF.exists(), reason="no test data")
def test_held_out_accuracy_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    out = L.op7_language_id(spark, str(SF)).collect()
    assert len(out) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    right = [r.lang_pred == lang[r.doc_id] for r in out if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert len(right) > 150 and np.mean(right) >= 0.97
