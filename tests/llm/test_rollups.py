from collections import defaultdict

from panelkit.llm import rollups


def test_query_against_plain_counts(spark, sf):
    import public_tokenizers

    enc = rollups._encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    want, seen = defaultdict(lambda: [0, 0, 0, 0]), set()
    for r in sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r.doc_id):
        t = r.text or ""
        for version, n in ((rollups.WORDS, len(t.split())), (rollups.BYTE_BPE, len(enc.encode_ordinary(t)))):
            x = want[r.source, r.lang, version]
            x[0], x[1] = x[0] + 1, x[1] + n
            if t not in seen:
                x[2], x[3] = x[2] + 1, x[3] + n
        seen.add(t)
    got = {(r.source, r.lang, r.tokenizer): [r.docs, r.tokens, r.distinct_docs, r.distinct_tokens] for r in rollups.op1_token_counts(spark, sf).collect()}
    assert got == want


def test_signed_changes_and_batches_sent_again(spark):
    row = "doc_id long, source string, lang string, text string"
    docs = spark.createDataFrame([(1, "a", "en", "one two"), (2, "a", None, "three"), (3, None, "en", None), (3, None, "en", ""), (None, "a", "en", " x  y\n")], row).withColumn("batch", rollups.F.lit("q"))
    r = rollups.Rollup(spark)
    words = rollups.counted(docs, rollups.WORDS)
    r.commit("1", rollups.inserts(words))
    r.commit("1", rollups.inserts(words))
    totals = lambda: {(x.source, x.lang): (x.docs, x.tokens) for x in r.totals().collect()}
    assert totals() == {("a", "en"): (2, 4), ("a", None): (1, 1), (None, "en"): (2, 0)}
    old = words.filter("doc_id = 2")
    r.commit("2", rollups.revisions(old, old.withColumn("lang", rollups.F.lit("en")).withColumn("tokens", rollups.F.lit(9).cast("long"))))
    r.commit("3", rollups.deletes(words.filter("doc_id = 1")))
    r.commit("3", rollups.deletes(words.filter("doc_id = 1")))
    r.commit("4", rollups.deletes(words.limit(0)))
    assert totals() == {("a", "en"): (2, 11), (None, "en"): (2, 0)}
    r = r.compacted("all")
    assert totals() == {("a", "en"): (2, 11), (None, "en"): (2, 0)}
    assert not r.commit("1", rollups.inserts(words))  # a late copy of a folded batch counts no second time
    assert r.commit("odd id / = 'x' \n", rollups.inserts(words.filter("doc_id = 1"))) and r.commit("odd id / = 'x' \n", rollups.inserts(words.filter("doc_id = 1")))
    assert totals() == {("a", "en"): (3, 13), (None, "en"): (2, 0)}
    again = rollups.Rollup(spark, r.path)
    assert sorted(map(repr, again.totals().collect())) == sorted(map(repr, r.totals().collect()))


def test_batch_that_breaks_off_leaves_what_was_there(spark):
    docs = spark.createDataFrame([(1, "a", "en", "one two")], "doc_id long, source string, lang string, text string")
    words = rollups.counted(docs, rollups.WORDS)
    r = rollups.Rollup(spark)
    r.commit("1", rollups.inserts(words))
    try:
        r.commit("1", rollups.inserts(words.withColumn("tokens", rollups.F.raise_error(rollups.F.lit("stop")).cast("long"))))
        raise AssertionError
    except Exception as e:
        assert "stop" in str(e)
    assert r.totals().first().tokens == 2


def test_repeated_rows_are_copies(spark):
    docs = spark.createDataFrame([(1, "a", "en", "x y"), (1, "a", "en", "x y"), (2, "a", "en", "x y"), (None, "a", "en", "x y"), (3, None, None, None), (4, "b", None, "")], "doc_id long, source string, lang string, text string")
    got = {(r.source, r.lang): (r.docs, r.tokens, r.distinct_docs, r.distinct_tokens) for r in rollups.token_counts(docs).filter("tokenizer = 'words-1'").collect()}
    assert got == {("a", "en"): (4, 8, 1, 2), (None, None): (1, 0, 1, 0), ("b", None): (1, 0, 0, 0)}


def test_long_text_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a", "en", "word " * 300_000)], "doc_id long, source string, lang string, text string")
    assert rollups.token_counts(docs).filter(rollups.F.col("tokenizer") == rollups.BYTE_BPE).first().tokens > 300_000
    assert rollups.token_counts(docs.limit(0)).count() == 0
