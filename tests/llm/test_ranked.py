import math
import random
import re
from collections import Counter

import duckdb
import numpy as np

from panelkit.llm import ranked as r

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, queries, top=10):
    tf = [(d, Counter(words(t))) for d, t in docs if words(t)]
    n, total = len(tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    out = []
    for q, text in set(queries):
        scores = []
        for d, c in tf:
            m = 25 + 75 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in words(text) if t in c)
            if s:
                scores.append((-s, math.inf if d is None else d))
        out += [(q, i + 1, None if d == math.inf else d, -s) for i, (s, d) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert sorted(map(tuple, r.op12_ranked(spark, sf).collect())) == sorted(con.execute(r.SQL).fetchall())


def test_pruning_lots_and_ties_against_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(60)], k=n))
    docs = [(i, text(rng.randrange(1, 40))) for i in range(500)]
    docs += [(1000 + i, docs[i % 7][1].upper()) for i in range(200)] + [(2000, None), (2001, "?")]
    rng.shuffle(docs)
    queries = [(i, text(rng.choice([1, 2, 5, 30, 90]))) for i in range(40)] + [(50, "w3 w3 w3 nothing"), (51, "nothing")]
    want = brute(docs, queries)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    ask = spark.createDataFrame(queries, "item_id long, text string")
    assert sorted(map(tuple, r.ranked(df, ask).collect()), key=str) == want
    for name, value in (("SHARD_DOCS", 30), ("LOT_ROWS", 60), ("AT_ONCE", 2), ("MATRIX", 900)):
        monkeypatch.setattr(r, name, value)
    stored = r.materialise(r.index(df.repartition(12)), "test-index")
    assert stored.filter("term is null").count() > 5
    assert sorted(map(tuple, r.ranked(df, ask, indexed=stored).collect()), key=str) == want


def test_few_documents_are_scored():
    rng = np.random.default_rng(3)
    n, sizes = 4000, [2500, 40, 12, 3, 900]
    docs = [np.sort(rng.choice(n, s, replace=False)) for s in sizes]
    impact = [rng.integers(300_000, 1_000_000, s) for s in sizes]
    weights = np.array([[700, 4000, 6000, 8000, 1500]])
    lists = r.Lists(np.concatenate(docs), np.concatenate(impact), np.cumsum(sizes), np.arange(n)[::-1].copy())
    full = np.zeros(n, np.int64)
    for d, i, w in zip(docs, impact, weights[0]):
        full[d] += w * i
    q, d, s, scored = r.best(lists, np.arange(5)[None], weights, 10, np.zeros(1, np.int64), np.full(1, r.NO_ID))
    assert sorted(s, reverse=True) == sorted(full, reverse=True)[:10] and (full[d] == s).all()
    assert scored < 200
    # Of equal scores the smallest ids win, and intervals that only tie with larger ones aren't opened.
    same = r.Lists(np.arange(n), np.full(n, 500_000), np.array([n]), np.arange(n))
    q, d, s, scored = r.best(same, np.zeros((1, 1), np.int64), np.array([[10]]), 10, np.zeros(1, np.int64), np.full(1, r.NO_ID))
    assert sorted(d) == list(range(10)) and scored < 40


def test_edge_rows(spark):
    docs = [(1, "a b"), (1, "a b"), (None, "a b"), (2, None), (3, ""), (4, "c " * 200_000), (5, "zz ŽŽ"), (6, "A_b, b")]
    queries = [(7, "a A"), (7, "a A"), (8, None), (9, "nothing"), (None, "c"), (10, "žž"), (11, "ŽŽ b")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "doc_id as rank", "text as term", "doc_id as shard")
    ask = spark.createDataFrame(queries, "item_id long, text string").selectExpr("*", "text as query")
    assert sorted(map(tuple, r.ranked(df, ask).collect()), key=str) == brute(docs, queries)
    assert r.ranked(df.limit(0), ask).count() == 0 and r.ranked(df, ask.limit(0)).count() == 0
