import pytest
import zlib

import numpy as np
import pandas as pd

from demandlake.llm import language_id as L

from ..conftest import SF_SMALL
from . import util


def brute(train, values, langs):
    """Naive Bayes over the same hashed n-grams, one text and one n-gram at a time."""
    def grams(t):
        points = np.array([32, *L._fold(t or ""), 32], np.uint32)
        points = points[L._squeeze(points)]
        return np.concatenate([L._hashes(points, n, L.BUCKETS) for n in L.ORDERS])

    counts = {lang: np.zeros(L.BUCKETS) for lang in langs}
    for lang, t in train:
        np.add.at(counts[lang], grams(t), 1)
    n = {lang: sum(1 for x, _ in train if x == lang) for lang in langs}
    logp = {lang: np.log((c + 0.5) / (c.sum() + 0.5 * L.BUCKETS)) for lang, c in counts.items()}
    out = []
    for t in values:
        ll = np.array([np.log(n[lang] / len(train)) + logp[lang][grams(t)].sum() for lang in langs])
        out.append((langs[int(ll.argmax())], 1 / np.exp(ll - ll.max()).sum()) if t and any(map(str.isalpha, t)) else ("und", 0.0))
    return out


def test_predictions_equal_brute_force(spark, monkeypatch):
    data = util.rows()
    train = [(r[2], r[1]) for r in data if r[2] is not None and r[1] is not None]
    want = brute(train, [r[1] for r in data], sorted({x for x, _ in train}))
    monkeypatch.setattr(L, "BLOCK_CHARS", 3000)  # long texts come in parts
    model = L.fit(util.docs(spark))
    lang, score = L.score_texts([r[1] for r in data], model)
    assert lang == [w[0] for w in want]
    np.testing.assert_allclose(score, [w[1] for w in want], rtol=1e-3, atol=1e-6)


def test_held_out_accuracy(spark):
    got = L.op1_language_id(spark, SF_SMALL).toPandas().merge(pd.read_parquet(f"{SF_SMALL}/documents.parquet"))
    assert len(got) == 200 and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    own = got[got.held_out]
    assert len(own) > 20 and (own.lang_pred == own.lang).mean() > 0.97


def test_columns_and_defined_results(spark):
    docs = util.docs(spark)
    got = L.predict(docs, L.fit(docs), out=("p", "q")).toPandas()
    assert len(got) == len(util.rows()) and list(got.columns) == [*docs.columns, "p", "q"] and set(got.score) == {"x"}
    no_letter = [t is None or not any(map(str.isalpha, t)) for t in got.text]
    assert ((got.p == "und") == no_letter).all() and (got.q[no_letter] == 0).all()
    kept = L.keep_identified(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < got.shape[0]


def test_empty_and_unlabelled(spark):
    none = util.empty(spark)
    assert L.predict(none, L.fit(none), out=("p", "q")).count() == 0 and L.keep_identified(none).count() == 0
    bare = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert L.predict(bare, L.fit(bare)).first().lang_pred == "und"


def test_floor_rejects_what_no_language_explains(spark):
    import random

    rng = random.Random(5)
    words = {"en": "the river runs over stone and under the old bridge".split(), "de": "der fluss liegt unter einer alten bruecke und daneben steht ein haus".split()}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(40)), lang) for i, lang in enumerate(["en", "de"] * 60)]
    noise = [(900, "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(400)), "en"), (901, " ".join("".join(chr(rng.randint(0x400, 0x44F)) for _ in range(9)) for _ in range(60)), None), (902, "12 34 ...", "de")]
    short = [(903, "the old bridge", "en"), (904, "haus", None)]
    got = {r.doc_id for r in L.keep_identified(spark.createDataFrame(rows + noise + short, "doc_id long, text string, lang string")).collect()}
    assert got == {i for i, _, _ in rows + short}


def test_too_many_languages_are_refused_before_counting(spark):
    docs = spark.createDataFrame([(f"l{i}", "text") for i in range(L.MAX_LANGS + 1)], "lang string, text string")
    with pytest.raises(ValueError, match="languages"):
        L.fit(docs)
