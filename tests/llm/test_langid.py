import random
import unicodedata
import zlib

import numpy as np
from pyspark.sql import functions as F

from weft.llm import langid


def corpus(n, seed):
    rng = random.Random(seed)
    syllables = {"aa": ["ka", "ki", "ku", "zo"], "bb": ["ble", "the", "ing", "er"]}
    return [("".join(rng.choice(syllables[y]) + (" " if rng.random() < 0.3 else "") for _ in range(rng.randint(3, 300))), y) for y in rng.choices(list(syllables), k=n)]


def test_held_out_accuracy_on_the_table(spark, data):
    got = langid.op3_language_id(spark, data).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.count() > 30 and got.filter("lang = lang_pred").count() >= 0.97 * got.count()
    assert got.filter("score < 0 OR score > 1").count() == 0


def test_odd_texts(spark):
    df = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(corpus(400, 1))], "doc_id long, text string, lang string")
    model = langid.learn(df)
    odd = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "123 -- !!", 0.5), (4, "the ing " * 50_000, 0.5), (5, "kakizo", 0.5), (5, "kakizo", 0.5)], "doc_id long, text string, score double")
    rows = sorted(langid.identify(odd, model).collect(), key=lambda r: r.doc_id)
    assert [r.lang_pred for r in rows] == ["und", "und", "und", "bb", "aa", "aa"]
    assert [r.score for r in rows[:3]] == [0.0] * 3 and not any(r.accepted for r in rows[:3]) and rows[3].accepted and rows[4] == rows[5]
    assert langid.identify(odd.limit(0), model).collect() == []


def test_reruns_agree_and_labels_alone_count(spark):
    df = spark.createDataFrame([(i, t, y if i % 3 else None) for i, (t, y) in enumerate(corpus(300, 2))], "doc_id long, text string, lang string")
    a, b = langid.learn(df), langid.learn(df.repartition(5))
    assert np.array_equal(a.table, b.table) and a.least == b.least and a.langs == ["aa", "bb"]


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score, r.accepted) for r in langid.identify(df, langid.learn(df)).select("lang_pred", "score", "accepted").collect()] == [("und", 0.0, False)]


def test_blocks_of_starts(monkeypatch):
    model = langid.fit([(t, y, k % 5 == 0) for k, (t, y) in enumerate(corpus(200, 3))])
    texts = [t for t, _ in corpus(30, 4)] + ["", "ka"]
    whole = model.logits(texts)
    monkeypatch.setattr(langid, "STARTS", 17)
    assert np.allclose(model.logits(texts), whole)


def test_rejection_is_calibrated():
    model = langid.fit([(t, y, k % 5 == 0) for k, (t, y) in enumerate(corpus(500, 5))])
    clean = [t for t, _ in corpus(300, 6)]
    _, score, accepted = model.predict(clean)
    assert accepted.mean() > 0.97 and ((score >= 0) & (score <= 1)).all()


def test_unlearned_language_is_rejected():
    rng = random.Random(8)
    syllables = {"aa": ["ka", "ki", "ku", "zo"], "bb": ["ble", "the", "ing", "er"], "cc": ["sha", "lom", "ovo", "ny"], "dd": ["tak", "mak", "ak", "zap"]}
    text = lambda y: "".join(rng.choice(syllables[y]) + (" " if rng.random() < 0.3 else "") for _ in range(rng.randint(20, 100)))
    model = langid.fit([(text(y), y, k % 5 == 0) for k, y in enumerate(["aa", "bb", "cc"] * 200)])
    clean = model.predict([text(y) for y in ["aa", "bb", "cc"] * 100])[2]
    langs, score, other = model.predict([text("dd") for _ in range(200)])
    assert clean.mean() > 0.95 and other.mean() < 0.1, (clean.mean(), other.mean(), score.mean())


def plain_score(model, text):
    """Averaged embeddings and softmax, one subword after the other."""
    text, sums, n = text.lower(), np.zeros(len(model.langs)), 0
    for i in range(len(text)):
        value = 0
        for c in text[i : i + langid.SUBWORDS]:
            value = (value * int(langid.STEP) + ord(c) + 1) % 2**64
            sums += model.table[(value * int(langid.SPREAD) % 2**64) * langid.BUCKETS // 2**64]
            n += 1
    x = (sums / max(n, 1) + model.bias) / model.heat
    p = np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    return model.langs[int(p.argmax())], float(p.max())


def test_query_by_a_plain_score(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = langid.learn(docs.filter(langid.crc_mod4("doc_id") != 2).select("text", "lang"))
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = langid.op3_language_id(spark, data).collect()
    assert len(rows) == len(text)
    for r in rows:
        t = text[r.doc_id]
        want = plain_score(model, t) if t and any(unicodedata.category(c)[0] == "L" for c in t) else ("und", 0.0)
        assert r.lang_pred == want[0] and abs(r.score - want[1]) < 1e-9
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_letters_by_category(spark):
    model = langid.fit([(t, y, k % 5 == 0) for k, (t, y) in enumerate(corpus(200, 3))])
    odd = ["½", "²", "①", "Ⅳ", "_", "٣", "ª", "日", "é"]
    assert [langs == "und" for langs in model.predict(odd)[0]] == [not any(unicodedata.category(c)[0] == "L" for c in t) for t in odd]


def test_copies_count_once_in_the_sample(spark, monkeypatch):
    monkeypatch.setattr(langid, "TEXTS_EACH", 40)
    rows = corpus(300, 9)
    seen = {}
    monkeypatch.setattr(langid, "fit", lambda windows: seen.update(w=windows))
    langid.learn(spark.createDataFrame([*rows, *[rows[0]] * 3000, *[(rows[0][0], "cc")] * 50], "text string, lang string"))
    by = {}
    for w, y, _ in seen["w"]:
        by.setdefault(y, []).append(w)
    assert {y: len(w) <= 80 for y, w in by.items()} == {"aa": True, "bb": True, "cc": True} and len(by["cc"]) == 2
    assert all(len(set(by[y])) > 60 for y in ("aa", "bb"))
