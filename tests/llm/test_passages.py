import random
import re
import time

import numpy as np
import pyarrow as pa
import xxhash

from panelkit.llm import passages
from panelkit.llm.shared import WORD, CodeWords

rng = np.random.default_rng(2)


def brute(docs):
    """The documents with a run of 50 words that stands earlier, and the words in such runs."""
    seen, out = set(), {}
    for d, text in sorted(docs):
        w = [x.lower() for x in WORD.findall(text)]
        hit = set()
        for i in range(len(w) - 49):
            run = tuple(w[i : i + 50])
            if run in seen:
                hit |= set(range(i, i + 50))
            seen.add(run)
        if hit:
            out[d] = hit
    return out


def test_query_against_all_runs(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(docs)
    every = passages.op4_passages(spark, sf).collect()
    rows = {r.doc_id: r for r in every if r.passages}
    assert rows.keys() == want.keys()
    texts, missed, total = dict(docs), 0, 0
    for d, r in rows.items():
        places = [(m.start(), m.end()) for m in WORD.finditer(texts[d])]
        got = {i for i, (a, b) in enumerate(places) if any(x["first"] <= a and b <= x["last"] for x in r.passages)}
        assert got <= want[d]
        missed, total = missed + len(want[d] - got), total + len(want[d])
    assert missed <= 0.01 * total
    for r in every:  # what is removed is what either level says, each place once
        inside = lambda ranges: {i for x in ranges for i in range(x["first"], x["last"])}
        assert inside(r.removed) == inside(r.lines) | inside(r.passages) and r.removed_chars == len(inside(r.removed))
        assert all(a["last"] < b["first"] for a, b in zip(r.removed, r.removed[1:])) and all(i <= r.doc_id for i in r.first_doc_ids)


def test_passages_inside_lines(spark):
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    for length, caught in ((50, True), (51, True), (90, True), (49, False)):
        p = word(length)
        docs = [(i, " ".join([*word(int(rng.integers(0, 90))), *(x.upper() if i % 2 else x for x in p), *word(int(rng.integers(0, 90)))])) for i in range(20)]
        rows = passages.removals(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        assert sorted(r.doc_id for r in rows) == (list(range(1, 20)) if caught else [])
        for r in rows:
            (x,) = r.removed
            assert dict(docs)[r.doc_id][x["first"] : x["last"]].lower() == " ".join(p) and r.first_doc_ids == [0]


def test_edge_rows(spark):
    p = " ".join(f"k{i}" for i in range(60))
    rows = [(1, p), (1, p), (2, f"İx {p}, tail"), (3, None), (None, "short"), (4, ""), (5, f"head {p} mid {p}"), (6, "is it. " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id as pair", "text as removed")
    got = {r.doc_id: r for r in passages.removals(df).collect()}
    assert sorted(got) == [2, 5, 6]
    clean = {r.doc_id: r.text for r in passages.without_repeats(df).collect()}
    assert clean[2] == "İx , tail" and clean[5] == "head  mid " and clean[1] == p and clean[3] is None and clean[4] == ""
    assert len(clean[6]) < 500
    assert passages.removals(df.limit(0)).count() == 0 and passages.without_repeats(df.limit(0)).count() == 0


def test_holder_that_quotes_less_than_a_passage(spark):
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    for length, quote in ((50, 49), (60, 49), (50, 40)):
        docs = []
        for k in range(0, 90, 3):
            p, cut = word(length), (length - quote) // 2
            docs += [(k, " ".join([*word(20), *p[cut : cut + quote], *word(20)])), (k + 1, " ".join([*word(20), *p, *word(20)])), (k + 2, " ".join([*word(20), *p, *word(20)]))]
        rows = {r.doc_id: r for r in passages.removals(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        assert sorted(rows) == [k + 2 for k in range(0, 90, 3)]
        for d, r in rows.items():
            (x,) = r.removed
            assert len(WORD.findall(dict(docs)[d][x["first"] : x["last"]])) == length and r.first_doc_ids == [d - 1]


def test_query_finds_every_run(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = {r.doc_id: r.removed for r in passages.op4_passages(spark, sf).collect()}
    texts = dict(docs)
    for d, want in brute(docs).items():
        places = [(m.start(), m.end()) for m in WORD.finditer(texts[d])]
        assert all(any(x["first"] <= places[i][0] and places[i][1] <= x["last"] for x in rows[d]) for i in want)


def test_short_lines_and_paragraphs(spark):
    rows = [(1, "Licensed under the Apache License\nalpha\n\n---\nred green\nblue"), (2, "beta\r\n  licensed under the apache license.\r\ngamma"), (3, "red\ngreen blue\n\n---\n\ndelta alpha"), (4, "licensed under the Apache\n\n* Beta *"), (None, "gamma\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: ([dict(rows)[r.doc_id][x["first"] : x["last"]] for x in r.removed], r.first_doc_ids) for r in passages.removals(df).collect()}
    assert got == {2: (["licensed under the apache license", "gamma"], [1]), 3: (["red\ngreen blue"], [1]), 4: (["Beta"], [2])}
    clean = {r.doc_id: r.text for r in passages.without_repeats(df).collect()}
    assert clean[2] == "beta\r\n  .\r\n" and clean[3] == "\n\n---\n\ndelta alpha" and clean[4] == "licensed under the Apache\n\n*  *"


def test_query_finds_every_repeated_line(spark):
    sf, seen, want = "/root/testdata/sf0.01", set(), {}
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    for d, text in docs:
        at = 0
        for line in text.split("\n"):
            found = [m.span() for m in WORD.finditer(line)]
            words = tuple(line[a:b].lower() for a, b in found)
            if words and words in seen:
                want.setdefault(d, []).append((at + found[0][0], at + found[-1][1]))
            seen.add(words)
            at += len(line) + 1
    rows = {r.doc_id: r.lines for r in passages.op4_passages(spark, sf).collect()}
    assert len(want) > 100 and all(any(x["first"] <= a and b <= x["last"] for x in rows[d]) for d, v in want.items() for a, b in v)


def test_words_of_code_points():
    r = random.Random(4)
    parts = ["Σ", "ΑΣ", "ας", "ασ", "ΟΔΟΣ", "οδος", "İΣ", "İx", "ix", "K", "k", "ß", "汉字", "é", "e\u0301", "𐐀", "𐐨", "🙂", "x_y", "٣", "'", ", ", " ", " ", "\n", "\r", "\r\n", "\n\n", "\n \t\n", "\r\r", "\x85", "\x1c", "\u2028", "\n--\n"]
    texts = ["", "\r", "\n", *("".join(r.choices(parts, k=r.randrange(60))) for _ in range(400)), "", "end"]
    for most in (7, 400_000):
        words = CodeWords(texts, most)
        hashes, spelt = {}, {}
        ranges = passages.line_ranges(words)
        owner = words.text_of(ranges[:, 0])
        for i, t in enumerate(texts):
            a, b = words.first[i : i + 2]
            found = list(WORD.finditer(t))
            assert [m.span() for m in found] == [(x - words.base[i], y - words.base[i]) for x, y in zip(words.start[a:b], words.end[a:b])]
            for m, h in zip(found, words.hash[a:b].tolist()):  # equal hashes for equal lower cases, and for no others
                assert hashes.setdefault(m.group().lower(), h) == h and spelt.setdefault(h, m.group().lower()) == m.group().lower()
            want, n, begin = set(), 0, 0
            for line in re.split(r"\r\n?|\n", t):
                k = len(WORD.findall(line))
                if k:
                    want.add((n, n + k))
                elif not line.strip():
                    want.add((begin, n))
                    begin = n
                n += k
            want = sorted(x for x in {*want, (begin, n)} if x[0] < x[1])
            assert [tuple(x) for x in (ranges[owner == i] - a).tolist()] == want


def test_units_cost_less_than_words_as_strings(spark):
    r = random.Random(1)
    names = [f"{r.choice(['Mot', 'wörter', 'palabra'])}{i}" for i in range(30_000)]
    texts = [" ".join(r.choices(names, k=300)) for _ in range(1_000)]
    taken = {}

    class Rows:  # catches the function that runs in the tasks
        sparkSession, schema = spark, spark.createDataFrame([], "doc_id long, text string").schema
        select = lambda self, *c: self

        def mapInArrow(self, run, schema):
            taken["run"] = run

    passages.units(Rows())
    batch = pa.RecordBatch.from_arrays([pa.array(range(1_000)), pa.array(range(1_000)), pa.array(texts)], ["doc_id", "text_key", "text"])
    list(taken["run"](iter([batch])))
    t = time.process_time()
    assert sum(x.num_rows for x in taken["run"](iter([batch]))) > 1_000
    here, t = time.process_time() - t, time.process_time()
    for text in texts:
        [xxhash.xxh3_64_intdigest(w.lower()) for w in WORD.findall(text)]
    assert here < time.process_time() - t


def test_joins_have_no_sums_beside_them(spark):
    df = spark.createDataFrame([(1, "a b\nc"), (2, "a b")], "doc_id long, text string")
    plan = passages.repeats(df)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Aggregate" not in plan  # so that Spark can split the rows of a digest that very many have
