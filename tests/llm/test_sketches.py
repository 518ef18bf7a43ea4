import hashlib
import re

import pytest
import xxhash

from panelkit.llm import sketches


def shingles(text):
    w = [x for x in re.split(r"[\W]+", text.lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(text, after):
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def test_against_exact_sets(spark, sf):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    rows = {r.doc_id: r for r in sketches.op6_fingerprints(spark, sf).collect()}
    assert len(rows) == len(docs)
    worst = 0
    for (i, t), (_, after) in zip(docs, docs[1:] + docs[:1]):
        e, r = edited(t, after), rows[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        sets = shingles(t), shingles(e), shingles(after)
        exact = max(map(len, sets)) < sketches.K
        for got, want in ((r.near_edited, jaccard(*sets[:2])), (r.near_next, jaccard(sets[0], sets[2]))):
            worst = max(worst, abs(got - want))
            if exact:
                assert got == pytest.approx(want, abs=1e-12)
        assert r.n_shingles == pytest.approx(len(sets[0]), rel=0.3)
        assert r.kept_in_edited == pytest.approx(len(sets[0] & sets[1]) / len(sets[0]) if sets[0] else 1, abs=0.2)
    assert worst < 0.15
    by_text = {}
    for i, t in docs:
        assert by_text.setdefault(t, rows[i].fingerprint) == rows[i].fingerprint


def test_edge_rows(spark):
    long = "wort " * 30_000
    df = spark.createDataFrame([(3, "a b c"), (3, "a b c"), (None, None), (10**12, ""), (-5, long), (7, "x y z x y z 1 2 3")], "doc_id long, text string")
    rows = sketches.fingerprints(df.withColumn("piece", df.doc_id).withColumn("copy", df.text)).collect()
    order = [(None, ""), (-5, long), (3, "a b c"), (3, "a b c"), (7, "x y z x y z 1 2 3"), (10**12, "")]
    want = sorted((str(i), hashlib.sha256(edited(t, n).encode()).hexdigest()) for (i, t), (_, n) in zip(order, order[1:] + order[:1]))
    assert sorted((str(r.doc_id), r.edited_sha256) for r in rows) == want
    assert {r.doc_id: r.n_shingles for r in rows} == {None: 0, -5: 1, 3: 1, 7: 5, 10**12: 0}
    assert sketches.fingerprints(df.limit(0)).count() == 0
    one = sketches.fingerprints(df.filter("doc_id = 7")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(edited(order[4][1], order[4][1]).encode()).hexdigest()


def test_merge_is_the_sketch_of_the_whole(spark):
    texts = [" ".join(f"w{i * j % 97}" for i in range(400)) for j in range(1, 9)]
    df = sketches.sketched(spark.createDataFrame([(i % 2 or None, t) for i, t in enumerate(texts)], "g int, text string"), "text", "sketch")
    got = {r.g: r.sketch for r in sketches.merged(df, ["g"]).collect()}
    for g in (1, None):
        whole = sorted({h for r in df.filter(df.g.eqNullSafe(g)).collect() for h in r.sketch})[: sketches.K]
        assert got[g] == whole


def test_hash_of_one_word(spark):
    df = sketches.sketched(spark.createDataFrame([("Word!",)], "text string"), "text", "s")
    h = xxhash.xxh64_intdigest(b"word", seed=42)
    assert len(df.first().s) == 1 and 0 <= df.first().s[0] < 1 << sketches.BITS and h > 0


def test_pieces_of_outlying_and_missing_ids(spark):
    rows = [(i * 3, f"text {i}") for i in range(4000)] + [(4 * 10**18, "far"), (-4 * 10**18, "near")] + [(None, f"none {i}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = sketches._pieces(df).collect()
    n = {}
    for r in pieces:
        n[r.piece] = n.get(r.piece, 0) + 1
    assert max(n.values()) < 200
    got = {r.text: r.next_text for r in sketches.beside_next(df).filter("not copy").collect()}
    ids = sorted((i, t) for i, t in rows if i is not None)
    assert all(got[t] == u for (_, t), (_, u) in zip(ids, ids[1:]))
    assert got["far"].startswith("none") and sum(not u.startswith("none") for t, u in got.items() if t.startswith("none")) == 1
