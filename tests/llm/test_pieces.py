import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from panelkit.llm import pieces

PATH = pieces.vocabulary()
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
ODD = ["", " ", "  ", "a", "  two  spaces  ", "▁a ▁▁", "a\tb\n\n c\n", "\x00x", "<s>hi</s> <0x0A>", "日本語のテキスト😀 é ﬁ", "aaaaaaaaaaaaaaa" * 20, " " * 50 + "x" + " " * 17, "\n \n", "ſtraße ÀÉ"]


def same(texts):
    m = pieces.model(PATH)
    ids, counts = m.encode(texts)
    ends = np.cumsum(counts)
    got = [ids[b - n : b].tolist() for b, n in zip(ends, counts)]
    want = [LIB.encode(t or "") for t in texts]
    assert got == want
    assert m.decode(ids, counts) == [LIB.decode(x) for x in want]


def test_odd_texts():
    same([*ODD, None])


def test_random_texts():
    rng = random.Random(5)
    signs = "aabcdeeetthhnn  \n.,é日😀▁-0123"
    same(["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(3000)])


def test_very_long_text_without_spaces():
    same(["abcdefghij" * 20_000, " " * 50_000 + "x", "ab " + " " * 47 + "the" + " " * 33 + "\t"])


def test_decode_of_any_ids():
    rng = random.Random(6)
    lists = [[rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000), rng.randrange(0, 300)]) for _ in range(rng.randint(0, 12))] for _ in range(3000)]
    got = pieces.model(PATH).decode(np.array([i for x in lists for i in x], np.int64), np.array([len(x) for x in lists]))
    assert got == [LIB.decode(x) for x in lists]
    with pytest.raises(ValueError):
        pieces.model(PATH).decode(np.array([32000]), np.array([1]))


def test_query_against_the_library(spark, sf):
    rows = pieces.op2_sentencepiece(spark, sf).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = LIB.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIB.decode(ids).encode()).hexdigest())


def test_nulls_empty_tables_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, [7]), (None, "", None), (1, "hi hi", [1])], "doc_id long, text string, ids array<int>")
    rows = pieces.decode(pieces.encode(df, PATH), PATH).collect()
    assert sorted((tuple(r.ids), r.decoded) for r in rows) == sorted([((), ""), ((), ""), (tuple(LIB.encode("hi hi")), "hi hi")])
    assert pieces.round_trip(df.limit(0)).count() == 0
