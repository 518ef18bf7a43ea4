import numpy as np

from panelkit.llm import near
from panelkit.llm.shared import WORD

rng = np.random.default_rng(3)


def sets(text):
    w = WORD.findall(text.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else {text})


def classes(docs):
    """Every text's class by comparing all pairs that share a shingle."""
    s = [sets(t) for _, t in docs]
    owner, root = {}, list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, own in enumerate(s):
        for j in {j for x in own for j in owner.get(x, ())}:
            both = len(own & s[j])
            if both >= 0.8 * (len(own) + len(s[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for x in own:
            owner.setdefault(x, []).append(i)
    return {d: min(docs[j][0] for j in range(len(docs)) if find(j) == find(i)) for i, (d, _) in enumerate(docs)}


def test_query_against_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    rows = near.op3_minhash(spark, sf).collect()
    assert {r.doc_id: r.class_id for r in rows} == classes(docs)
    assert sorted(r.doc_id for r in rows if r.kept) == sorted({r.class_id for r in rows})


def test_chains_and_large_groups(spark):
    words = [f"w{i}" for i in range(2000)]
    base = list(rng.choice(words, 300))
    docs = []
    for i in range(150):  # copies of one text, each with some words changed: not all are alike each other
        t = list(base)
        for j in rng.choice(300, 6, False):
            t[j] = f"x{i}{j}"
        docs.append((1000 - i, " ".join(t)))
    chain = list(rng.choice(words, 200))
    for i in range(12):
        chain[i * 6 : i * 6 + 6] = [f"c{i}{k}" for k in range(6)]
        docs.append((i, " ".join(chain)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near.near_duplicates(df).collect()}
    assert got == classes(docs)


def test_register_shares_estimate_probability_jaccard():
    a, b = rng.integers(1, 1 << 60, (2, 400)).astype(np.uint64)
    b[:250] = a[:250]
    w = rng.random(400) + 0.1
    held = near.probminhash(np.r_[a, b], np.r_[w, w], np.repeat([0, 1], 400), 2, 4096)
    pa, pb = dict(zip(a.tolist(), w)), dict(zip(b.tolist(), w))
    every = pa.keys() | pb.keys()
    want = sum(1 / sum(max(pa.get(y, 0) / pa[x], pb.get(y, 0) / pb[x]) for y in every) for x in pa.keys() & pb.keys())
    assert abs((held[0] == held[1]).mean() - want) < 0.03


def test_edge_rows(spark):
    t = "one two three four five six seven"
    rows = [(5, None), (4, ""), (3, "!!"), (2, "!!"), (None, t), (9, t), (9, t), (8, t.upper() + "."), (None, "alone here"), (7, "long " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id as label", "text as node")
    got = near.near_duplicates(df).collect()
    assert sorted((str(r.doc_id), str(r.class_id)) for r in got) == sorted([("5", "4"), ("4", "4"), ("3", "2"), ("2", "2"), ("None", "8"), ("9", "8"), ("9", "8"), ("8", "8"), ("None", "None"), ("7", "7")])
    left = near.deduplicated(df).collect()
    assert sorted(str(r.doc_id) for r in left) == ["2", "4", "7", "8", "None"]
    assert left[0].asDict().keys() == {"doc_id", "text", "label", "node"}
    assert near.near_duplicates(df.limit(0)).count() == 0 and near.deduplicated(df.limit(0)).count() == 0


def test_pairs_that_differ_in_a_long_token(spark):
    docs = []
    for i in range(300):
        t = [f"w{x}" for x in rng.integers(0, 10**9, 50)]
        for k in (0, 1):
            t[20] = "".join(rng.choice(list("0123456789abcdef"), (100, 300, 3000)[i % 3]))
            docs.append((2 * i + k, " ".join(t)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near.near_duplicates(df).collect()}
    assert got == classes(docs) == {d: d - d % 2 for d, _ in docs}


def test_links_connect_every_class(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    docs = sorted((r.doc_id, r.text or "") for r in df.collect())
    texts, pairs = dict(docs), near.near_pairs(df).collect()
    root = {d: d for d, _ in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    first = {}
    for d, t in docs:
        first.setdefault(" ".join(WORD.findall(t.lower())) or t, d)
    for p in pairs:
        a, b = sets(texts[p.a_id]), sets(texts[p.b_id])
        assert abs(p.jaccard - len(a & b) / len(a | b)) < 1e-12 and p.jaccard >= 0.8 and abs(p.estimate - p.jaccard) < 0.3
        x, y = sorted((find(p.a_id), find(p.b_id)))
        root[y] = x
    got = {d: find(first[" ".join(WORD.findall(t.lower())) or t]) for d, t in docs}
    assert got == classes(docs)
    # 96 registers: the mean error of the estimates is far below that of one.
    assert pairs and abs(sum(p.estimate - p.jaccard for p in pairs) / len(pairs)) < 0.1
    # Links by document: those of its text, each with a similarity that was computed.
    own = lambda d: [p for p in pairs if first[" ".join(WORD.findall(texts[d].lower())) or texts[d]] in (p.a_id, p.b_id)]
    for r in near.near_duplicates(df).collect():
        assert r.n_links == len(own(r.doc_id)) and r.most_alike == max((p.jaccard for p in own(r.doc_id)), default=None)
        assert r.n_in_class == 1 or r.n_links or len({" ".join(WORD.findall(texts[d].lower())) or texts[d] for d, c in got.items() if c == r.class_id}) == 1


def test_large_bucket_of_texts_that_are_not_alike(spark, monkeypatch):
    monkeypatch.setattr(near, "HUBS", 4)
    common = [f"w{i}" for i in range(100)]
    docs = [(i, " ".join([*common, *(f"x{i}{j}" for j in range(12 + i % 30))])) for i in range(60)]
    got = {r.doc_id: r.class_id for r in near.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == classes(docs)
