import hashlib
import random
import re

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np

from panelkit.llm import contamination as c
from panelkit.llm.shared import ByteWords

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(len(w), 10)
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    ids |= windows[tuple(w[k : k + n])]
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


def digests(df):
    return [(r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.n_hit > 0) for r in df.collect()]


def test_query_against_sql_and_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = sorted(map(tuple, c.op11_decontamination(spark, sf).collect()))
    assert got == sorted(con.execute(c.SQL).fetchall())
    assert got == sorted(brute(con.execute("SELECT doc_id, text FROM documents").fetchall(), con.execute("SELECT item_id, text FROM benchmark").fetchall()))
    assert sum(r[-1] for r in got) > 10


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=40), min_size=1, max_size=5), st.integers(1, 4), st.integers(1, 4))
def test_every_window_has_a_fingerprint(texts, gram, spread):
    raw = [" ".join(map(str, t)).encode() for t in texts]
    w = ByteWords(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw]))
    assert np.diff(w.first).tolist() == [len(t) for t in texts]
    at, h = c.winnowed(w, gram, spread)
    for t, first in zip(texts, w.first):
        own = {int(a - first) for a in at if first <= a < first + len(t)}
        for k in range(len(t) - gram - spread + 2):
            assert own & set(range(k, k + spread))
    assert len(set(at.tolist())) == len(at) == len(h)


def test_planted_passages_short_items_and_few_words(spark):
    r = random.Random(5)
    w = lambda n: [f"w{r.randrange(12)}" for _ in range(n)]
    items = [(i, w(r.choice([1, 3, 9, 10, 11, 14, 30]))) for i in range(25)] + [(99, ["w1"] * 25)]
    docs = []
    for d in range(150):
        x = w(r.randrange(30))
        for _ in range(r.randrange(4)):
            y = r.choice(items)[1]
            a = r.randrange(len(y))
            x += y[a : a + r.choice([5, 9, 10, 12, 40])] + w(r.randrange(9))
        docs.append((d, " ".join(v.upper() if r.random() < 0.3 else v for v in x)))
    docs += [(200, "w1 " * 400), (201, "w0. " * 9 + "-" + "w0, " * 20)]
    items = [(i, "; ".join(x)) for i, x in items if len(x) > 3 or i % 2]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert sorted(digests(c.contaminated(df, spark.createDataFrame(items, "item_id long, text string")))) == sorted(brute(docs, items))


def test_edge_rows(spark):
    p = " ".join(f"K{i}" for i in range(12))
    docs = [(1, p), (1, p), (None, p), (2, None), (3, ""), (4, f"ÄÖ {p.lower()}ß"), (5, p.replace(" ", "\x00\n[")), (6, "ab " * 200_000 + p), (7, "İstanbul ist"), (8, "i̇stanbul")]
    items = [(1, p), (1, p), (2, p + " more"), (None, p[3:]), (3, None), (4, ""), (5, "İstanbul"), (6, "..")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "doc_id as row", "text as size", "text as item")
    ask = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "text as hash", "item_id as item")
    found = c.contaminated(df, ask)
    assert sorted(digests(found), key=str) == sorted(brute(docs, items), key=str)
    assert [(s["first"], s["past"]) for s in found.filter("doc_id = 6").first().spans] == [(200_000, 200_012)]
    assert c.contaminated(df.limit(0), ask).count() == 0
    assert {r.n_hit for r in c.contaminated(df, ask.limit(0)).collect()} == {0}
