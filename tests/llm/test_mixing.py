import re

import duckdb
import pytest

from panelkit.llm import mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        unit = left / sum(w[s] for s in open_)
        full = {s for s in open_ if unit * w[s] > 2 * sizes[s]}
        if not full:
            return target | {s: unit * w[s] for s in open_}
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2.0 * sizes[s] for s in full)
        open_ -= full
    return target


def test_query(spark, sf):
    docs = {r.doc_id: (r.source, len(re.findall(r"[^\x20\x09-\x0d]+", r.text or ""))) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = mixing.op7_mixing(spark, sf).collect()
    assert len(rows) == len(docs)
    sizes, taken = {}, {}
    for s, n in docs.values():
        sizes[s] = sizes.get(s, 0) + n
    want = brute_targets(sizes)
    for r in rows:
        s, n = docs[r.doc_id]
        assert (r.size, r.source_size) == (n, sizes[s]) and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    for s, t in taken.items():
        assert t == round(want[s])
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.op7_mixing(spark, sf).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(con.execute(mixing.SQL).fetchall(), key=repr) == sorted((tuple(r) for r in rows), key=repr)


def test_permutation_is_one(spark):
    for n in (1, 2, 3, 10, 97, 1000):
        df = spark.range(n).withColumn("n", mixing.F.lit(n).cast("long"))
        got = [r.p for r in df.select(mixing.permuted(mixing.F.col("id"), mixing.F.col("n"), mixing.F.lit("k")).alias("p")).collect()]
        assert sorted(got) == list(range(n))


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, "a b c", "x"), (1, "a b c", "x"), (None, "d e", None), (3, None, None), (4, "", "empty"), (5, "w " * 5000, "y")], "doc_id long, text string, source string")
    rows = mixing.taken(df.withColumn("key", df.source).withColumn("part", df.source)).collect()
    assert len(rows) == 6
    assert sorted((r.size, r.source_size) for r in rows) == [(0, 0), (0, 2), (2, 2), (3, 6), (3, 6), (5000, 5000)]
    assert all(r.taken <= 2 * r.size for r in rows)
    assert mixing.taken(df.limit(0)).count() == 0
    assert mixing.mixed_documents(df.limit(0)).count() == 0


def test_mixed_documents_hold_the_words_that_are_taken(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {}
    for r in mixing.mixed_documents(docs).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(re.findall(r"[^\x20\x09-\x0d]+", r.text))
        assert r.n_chars == len(r.text)
    assert got == {r.doc_id: r.taken for r in mixing.taken(docs).collect() if r.taken}


def test_shards_hold_the_slots_that_were_drawn_for_them(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    monkeypatch.setattr(mixing.slots, "__defaults__", (mixing.BLOCK_WORDS, 64, mixing.SEED))
    _, plan, drawn = mixing.mix(docs)
    each = mixing.passes(plan)
    want = {(r.key, r.shard): r["count"] for r in mixing.shard_counts(each, 64).collect()}
    rows, got = drawn.collect(), {}
    for r in rows:
        got[r.key, r.shard] = got.get((r.key, r.shard), 0) + 1
    assert got == want and len({s for _, s in got}) > 5
    assert len({(r.key, r.slot) for r in rows}) == len(rows) == sum(r.slots for r in each.collect())
    assert len({(r.key, r["pass"], r.block) for r in rows}) == len(rows)
    texts = mixing.mixed_blocks(docs).collect()
    assert len(texts) == len(rows) and max(len(r.text.split(" ")) for r in texts) == mixing.BLOCK_WORDS
    sizes = {}
    for r in texts:
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split(" "))
    assert sizes == {r.source: round(r.target) for r in plan.collect() if r.target}


def test_repeated_rows_keep_their_other_columns(spark):
    df = spark.createDataFrame([(1, "a b c", "x", "left"), (1, "a b c", "x", "right"), (2, "w " * 300, "y", "long")], "doc_id long, text string, source string, note string")
    rows = mixing.mixed_documents(df).collect()
    assert {r.note for r in rows} == {"left", "right", "long"}
    assert sum(len(r.text.split()) for r in rows) == sum(r.taken for r in mixing.taken(df).collect())


def test_targets_met_to_the_word(spark):
    for words in (1, 127, 128, 129, 1000):
        df = spark.createDataFrame([(i, "w " * words, "abc"[i % 3]) for i in range(6)], "doc_id long, text string, source string")
        rows, got = mixing.taken(df).collect(), {}
        for r in rows:
            got[r.target, r.source_size] = got.get((r.target, r.source_size), 0) + r.taken
        assert len(got) == 3 and got == {k: round(k[0]) for k in got}


def test_several_shards_draw_at_the_small_scale(spark):
    rows = mixing.op7_mixing(spark, "/root/testdata/sf0.01").select("n_shards", "first_shard").distinct().collect()
    assert max(r.n_shards for r in rows) > 1 and len({r.first_shard for r in rows}) > 2


def test_rows_without_an_id_are_spread_by_their_text(spark):
    texts = [f"w{i} " * (i % 3 + 1) for i in range(400)]
    df = spark.createDataFrame([(None, t, "x") for t in texts] + [(None, None, "x")] * 2, "doc_id long, text string, source string")
    laid, _, _ = mixing.mix(df, ["text"])
    at = {r.text: r.start for r in laid.collect()}
    order = sorted(texts, key=at.get)
    assert order != sorted(texts) and [at[t] for t in order] == [sum(len(u.split()) for u in order[:i]) for i in range(400)]
    rows = mixing.taken(df).collect()
    assert len(rows) == 402 and sum(r.taken for r in rows) == int(rows[0].target + 0.5)
    again = {r.text: r.start for r in mixing.mix(df.orderBy("text"), ["text"])[0].collect()}
    assert again == at
