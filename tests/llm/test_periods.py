import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from panelkit.llm import periods

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def brute(w, most=None):
    """All runs of w, by trying each period."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def changed(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g = h // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def want(doc_id, text):
    w = changed(doc_id, [x for x in SPACE.split(text or "") if x])
    runs = brute(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in drop)), len(drop))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=70), max_size=4), st.randoms())
def test_runs_of_small_alphabets(texts, r):
    texts = [t * r.choice([1, 1, 4, 5]) if len(t) < 15 else t for t in texts]
    ids = np.array([x for t in texts for x in t], np.int64)
    assert periods.runs_of(ids, np.cumsum([len(t) for t in texts], dtype=np.int64)) == [brute(t) for t in texts]


def test_nested_and_long_runs():
    r = random.Random(3)
    inner = [1, 2] * 4 + [3]
    w = [9] * 7 + inner * 5 + [r.randrange(50) for _ in range(300)] + [7, 8, 7, 8, 7] * 6 + [5] * 6
    assert periods.runs_of(np.array(w), np.array([len(w)]))[0] == brute(w)
    block = [r.randrange(10**6) for _ in range(700)]
    w = [-1] + block * 4 + block[:13] + [-2] + block * 3
    assert periods.runs_of(np.array(w), np.array([len(w)]))[0] == brute(w) == [(1, 2813, 700)]


def test_query_against_all_periods(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text or "") < 6000}
    got = {r.doc_id: tuple(r)[1:] for r in periods.op13_periods(spark, sf).collect()}
    assert len(got) == 1000 and sum(r[0] > 0 for r in got.values()) > 20
    assert {d: got[d] for d in docs} == {d: want(d, t) for d, t in docs.items()}


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (3, " \t\n"), (None, "a " * 6), (4, "x\x0by\x1cz    " * 9), (5, "one two three four " * 4), (6, "to and fro " * 40_000), (30, "is " * 5 + "as is"), (7, "is " * 6 + "as")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id as runs", "text as start", "doc_id as _w")
    got = sorted((tuple(r) for r in periods.described(periods.planted(df)).collect()), key=str)
    small = [(d, t) for d, t in rows if d != 6]
    assert [r for r in got if r[0] != 6] == sorted(((d, *want(d, t)) for d, t in small), key=str)
    assert [r[1:6] for r in got if r[0] == 6] == [(1, 0, 120_000, 3, 40_000_000)]
    full = {r.doc_id: r for r in periods.runs(df).collect()}
    assert set(full[5].asDict()) == {"doc_id", "text", "start", "_w", "runs", "collapsed"}
    assert full[5].collapsed == "one two three four" and [tuple(x) for x in full[5].runs] == [(0, 16, 4)]
    assert full[1].runs == [] and full[1].collapsed == ""
    assert periods.described(df.limit(0)).count() == 0 and periods.runs(df.limit(0)).count() == 0
