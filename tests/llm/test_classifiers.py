import zlib

import numpy as np

from panelkit.llm import language, quality

SF = "/root/testdata/sf0.01"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_quality_of_held_out_rows(spark):
    rows = {r.doc_id: r for r in quality.op8_quality(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == held(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in rows.items())
    test = [(rows[i].score, q) for i, q in labels.items() if held(i)]
    good, bad = [s for s, q in test if q], [s for s, q in test if not q]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.9
    assert np.mean([s >= 0.3 for s in good]) > 0.95


def test_interactions_equal_their_definition():
    rng = np.random.default_rng(1)
    n = len(quality.STATS)
    m = quality.FactorisationMachine(0.1, rng.normal(size=quality.BUCKETS + n), rng.normal(size=(quality.BUCKETS + n, 3)), np.zeros(n), np.ones(n))
    col, value, stats = np.array([3, 9, 44]), np.array([0.5, 0.25, 0.7]), rng.normal(size=(1, n))
    x = np.zeros(quality.BUCKETS + n)
    x[col], x[quality.BUCKETS :] = value, m.scaled(stats)[0]
    at = np.flatnonzero(x)
    pairs = sum(m.factor[i] @ m.factor[j] * x[i] * x[j] for a, i in enumerate(at) for j in at[a + 1 :])
    assert np.isclose(m.margin(np.zeros(3, int), col, value, stats)[0], 0.1 + m.weight @ x + pairs)


def test_quality_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "x y", "c"), (2, "w " * 100_000, "d"), (3, "!!", "e")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (9, None), (2, 0)], "doc_id long, quality int")
    rows = quality.judged(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert quality.judged(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality.judged(docs, labels.limit(0)).collect()} == {0.5}


def test_language_of_held_out_rows(spark):
    rows = language.op9_language(spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    test = [(r.lang_pred == docs[r.doc_id].lang, r) for r in rows if r.held_out and docs[r.doc_id].lang]
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([x for x, _ in test]) > 0.97
    kept = [x for x, r in test if not r.rejected]
    assert len(kept) > 0.8 * len(test) and np.mean(kept) > 0.97


def test_language_edge_rows(spark):
    docs = spark.createDataFrame([(i, "le chat est la" if i % 2 else "der hund ist da", "fr" if i % 2 else "de", "x") for i in range(60)] + [(90, None, "fr", "x"), (91, "", None, "x"), (92, "12 ½ _ !", "de", "x"), (None, "der hund " * 50_000, None, "x")], "doc_id long, text string, lang string, score string")
    rows = {r.doc_id: r for r in language.identified(docs, language.learn(docs)).collect()}
    assert [rows[i].lang_pred for i in (90, 91, 92, None, 1, 2)] == ["und", "und", "und", "de", "fr", "de"]
    assert rows[90].score == 0 and rows[90].rejected
    none = language.identified(docs, language.learn(docs.filter("lang is null"))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert language.identified(docs.limit(0), language.learn(docs)).count() == 0


def plain_prediction(model, text):
    """The prediction from its definition: every n-gram of every word looked up by itself."""
    sums, n = np.zeros(len(model.langs)), 0
    for word in language.LETTERS.findall(text.lower()):
        if not any(map(str.isalpha, word)):
            continue
        w = f"<{word}>"
        for g in language.GRAMS:
            for i in range(len(w) - g + 1):
                h = ord(w[i]) + 1
                for c in w[i + 1 : i + g]:
                    h = (h * 0x100000001B3 + ord(c)) % (1 << 64)
                bucket = int(language.mixed(np.array([h + (g << 40)], np.uint64))[0] % np.uint64(language.BUCKETS))
                sums += model.table[bucket]
                n += 1
    if not n:
        return "und", 0.0
    z = (sums / n + model.bias) / model.temperature
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    return model.langs[int(p.argmax())], float(p.max())


def test_language_against_plain_sums(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.learn(docs)
    rows = language.identified(docs.select("doc_id", "text"), model).collect()
    for r in rows[:60]:
        lang, score = plain_prediction(model, r.text or "")
        assert r.lang_pred == lang and np.isclose(r.score, score, atol=1e-4)


def test_code_points_of_all_planes():
    kinds = quality._classes()
    assert kinds[0x2A6D6] == quality.LETTER and kinds[0x30000] == quality.LETTER and kinds[0x1F600] == quality.MARK and kinds[ord("|")] & quality.PIPE
