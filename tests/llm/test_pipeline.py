import re

import sentencepiece

import corpus_pipeline
from panelkit.llm import near, pieces, quality

LIB = sentencepiece.SentencePieceProcessor(model_file=pieces.vocabulary())


def test_every_stage_on_what_the_one_before_kept(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "secrets", "mixing", "sentencepiece"]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        stage(spark, docs, sf).write.parquet(path := str(tmp_path / name))
        after = spark.read.parquet(path)
        rows = kept[name] = after.collect()
        if i < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns
        if name == "quality":
            machine = quality.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            good = {r.doc_id for r in quality.scored(docs, machine).filter("score >= 0.3").collect()}
            assert {r.doc_id for r in rows} == good and 0 < len(good) < len(before)
        if name == "near_dedup":
            classes = near.near_duplicates(docs).collect()
            assert sorted(r.doc_id for r in rows) == sorted({r.class_id for r in classes}) and len(rows) < len(before)
        if name == "secrets":
            assert len(rows) == len(before)
            assert not any(re.search(r"AKIA[0-9A-Z]{16}|password=[0-9a-f]{16,}", r.text) for r in rows)
        if name == "sentencepiece":
            want = sorted((i, tuple(LIB.encode(t))) for i, t in before)
            assert sorted((r.doc_id, tuple(r.ids)) for r in rows) == want
        docs = after
    again = corpus_pipeline.run(spark, sf)
    assert sorted((r.doc_id, tuple(r.ids)) for r in again.collect()) == sorted((r.doc_id, tuple(r.ids)) for r in kept["sentencepiece"])


def test_edge_rows_through_all_stages(spark, tmp_path):
    row = "doc_id long, text string, lang string, source string, n_chars long, score double, label string, _row string"
    prose = "the quick brown fox jumps over the lazy dog near the river bank while seven tired travellers watch"
    rows = [
        (1, prose, "en", "a", 9, 0.5, "x", "y"), (1, prose, "en", "a", 9, 0.5, "x", "y"), (2, prose.upper(), None, "a", None, None, None, None), (3, None, None, None, None, None, None, None),
        (None, "another text of some words that nobody else has written down before today", "en", None, 1, 1.0, "l", "r"), (4, "", "en", "b", 0, 0.0, "", ""), (5, "long words " * 60_000 + "password=0a1b2c3d4e5f60718293", "en", "b", 3, 0.1, "z", "w"),
    ]
    docs = spark.createDataFrame(rows, row)
    spark.createDataFrame([(1, 1, 0), (5, 1, 0), (4, 0, 0), (None, None, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        if name != "sentencepiece":
            assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        after = stage(spark, docs, str(tmp_path))
        got = after.collect()
        if name != "sentencepiece":
            assert after.columns == docs.columns
        if name == "near_dedup":
            assert sorted(str(r.doc_id) for r in got) == ["1", "3", "5", "None"]
        if name == "secrets":
            assert len(got) == len(rows) and [r.text[-8:] for r in got if r.doc_id == 5] == ["[SECRET]"]
        if name == "mixing":
            assert {r.doc_id for r in got} >= {1, 5} and all(r.text.strip() for r in got)
            assert all(r.label == "x" for r in got if r.doc_id == 1)
        if name == "sentencepiece":
            assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), len(LIB.encode(t or ""))) for i, t, *_ in rows)
