"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's vector is the mean embedding of the hashed character n-grams of its words. The
embeddings and the softmax are trained together by stochastic gradient descent in numpy; a
temperature and a rejection mark are then set on rows that training didn't see.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Numbers, held_out, lots, mixed, spans, text_batches

#: About so many rows of each language are learned from at most, drawn evenly by a hash of their ids.
FIT_ROWS = 500
BUCKETS, WIDTH, GRAMS, SEED = 1 << 16, 16, (1, 2, 3, 4), 5
#: Of the answers above the rejection mark, this share was right on the rows set aside.
ACCEPTED_RIGHT = 0.99
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all words, marked at both ends, and how many each word has."""
    text = "".join(f"<{w}>" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    start = np.cumsum(size) - size
    parts, counts = [], []
    h = np.zeros(len(codes), np.uint64)
    for g in range(1, max(GRAMS) + 1):
        h = h[: len(codes) - g + 1] * np.uint64(0x100000001B3) + codes[g - 1 :] if g > 1 else codes + np.uint64(1)
        if g in GRAMS:
            n = np.maximum(size - g + 1, 0)
            parts.append((mixed(h + np.uint64(g << 40)) % np.uint64(BUCKETS)).astype(np.int64))
            counts.append(n)
    total = np.sum(counts, 0)
    out = np.empty(int(total.sum()), np.int64)
    at = np.cumsum(total) - total
    for p, n in zip(parts, counts):
        out[spans(n, at)] = p[spans(n, start)]
        at = at + n
    return out, total


def bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words' buckets and their counts; the words' numbers, text by text, and how many each text has."""
    seen, per, words = Numbers(), np.zeros(len(texts), np.int64), []
    for i, t in enumerate(texts):
        found = LETTERS.findall(t.lower())
        per[i] = len(found)
        words += found
    code = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
    letter = np.fromiter((any(map(str.isalpha, w)) for w in seen), bool, len(seen))
    if not letter.all():  # signs that count as part of words without being letters
        keep = letter[code]
        per = np.bincount(np.repeat(np.arange(len(texts)), per)[keep], minlength=len(texts))
        code = code[keep]
    bucket, count = grams(list(seen)) if len(seen) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return bucket, count, code, per


@dataclass
class LanguageModel:
    """table: the softmax's inputs that one n-gram of each bucket stands for (embedding times weights); then the rest."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    mark: float = 0.0

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A row for each text, and whether it has a letter."""
        n, k = len(texts), len(self.langs)
        bucket, count, code, per = bags(texts)
        if not len(code):
            return np.tile(self.bias, (n, 1)), np.zeros(n, bool)
        word = np.add.reduceat(self.table[bucket], np.cumsum(count) - count, axis=0)
        of = np.repeat(np.arange(n), per)
        total = np.maximum(np.bincount(of, count[code], n), 1)
        mean = np.stack([np.bincount(of, word[code, j], n) for j in range(k)], 1) / total[:, None]
        return mean + self.bias, per > 0

    def predict(self, texts: list[str]) -> pd.DataFrame:
        if not self.langs:
            return pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": 0.0, "rejected": True})
        z, some = self.logits(texts)
        p = softmax(z / self.temperature)
        best = p.argmax(1)
        score = np.where(some, p.max(1), 0.0)
        return pd.DataFrame({"lang_pred": np.where(some, np.array(self.langs, object)[best], UNKNOWN), "score": score, "rejected": ~some | (score < self.mark)})


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _summed(group: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of each group."""
    return np.stack([np.bincount(group, c, n) for c in rows.T], 1)


def fit(texts: list[str], langs: list[str], epochs: int = 8, rate: float = 0.3, seed: int = SEED) -> LanguageModel:
    """Trains on four rows of five and sets temperature and rejection mark on the others."""
    names = sorted(set(langs))
    if not names:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    rng, k, n = np.random.default_rng(seed), len(names), len(texts)
    y = np.array([names.index(x) for x in langs])
    bucket, count, code, per = bags(texts)
    first, ends = np.cumsum(count) - count, np.cumsum(per)
    rows = []
    for i in range(n):
        c = code[ends[i] - per[i] : ends[i]]
        b, m = np.unique(bucket[spans(count[c], first[c])], return_counts=True)
        rows.append((b, m / max(m.sum(), 1)))
    aside = rng.permutation(n) % 5 == 0 if n >= 50 else np.zeros(n, bool)
    emb, out, bias = rng.normal(0, 0.1, (BUCKETS, WIDTH)), rng.normal(0, 0.1, (WIDTH, k)), np.zeros(k)
    ge, go, gb = np.full((BUCKETS, WIDTH), 1e-8), np.full((WIDTH, k), 1e-8), np.full(k, 1e-8)
    for _ in range(epochs):
        order = rng.permutation(np.flatnonzero(~aside))
        for a in range(0, len(order), 32):
            take = order[a : a + 32]
            b = np.concatenate([rows[i][0] for i in take])
            x = np.concatenate([rows[i][1] for i in take])
            r = np.repeat(np.arange(len(take)), [len(rows[i][0]) for i in take])
            mean = _summed(r, emb[b] * x[:, None], len(take))
            err = softmax(mean @ out + bias)
            err[np.arange(len(take)), y[take]] -= 1
            err /= len(take)
            d_out, d_bias, back = mean.T @ err, err.sum(0), err @ out.T
            at, where = np.unique(b, return_inverse=True)
            d = _summed(where, back[r] * x[:, None], len(at))
            ge[at] += d**2
            go += d_out**2
            gb += d_bias**2
            emb[at] -= rate * d / np.sqrt(ge[at])
            out -= rate * d_out / np.sqrt(go)
            bias -= rate * d_bias / np.sqrt(gb)
    model = LanguageModel(names, (emb @ out).astype(np.float32), bias)
    check = np.flatnonzero(aside)
    if len(check):
        z, some = model.logits([texts[i] for i in check])
        z, t = z[some], y[check][some]
        if len(t):
            loss = lambda h: -np.log(softmax(z / h)[np.arange(len(t)), t] + 1e-12).mean()
            model.temperature = float(min(np.geomspace(0.01, 10, 61), key=loss))
            p = softmax(z / model.temperature)
            order = np.argsort(-p.max(1))
            right = np.cumsum((p.argmax(1) == t)[order]) / np.arange(1, len(t) + 1)
            good = np.flatnonzero(right >= ACCEPTED_RIGHT)
            model.mark = float(p.max(1)[order[good[-1]]]) if len(good) else 1.0
    return model


def learn(docs: DataFrame, fit_rows: int = FIT_ROWS) -> LanguageModel:
    """Fits on rows with a language that aren't held out; of each language about fit_rows, all where there are fewer."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    counts = known.groupBy("lang").count().collect()
    if not counts:
        return fit([], [])
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], float(min(1.0, fit_rows / r["count"])))))
    drawn = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30)) < share[F.col("lang")] * float(1 << 30)
    rows = known.filter(drawn).select("doc_id", "text", "lang").toPandas().sort_values(["doc_id", "text"], kind="stable")
    return fit(rows["text"].tolist(), rows["lang"].tolist())


def identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Adds lang_pred, score and rejected, made from the whole text alone; columns of these names are replaced.

    A null text or one without letters is `und` with score 0; `rejected` says that the score lies
    below the mark at which ACCEPTED_RIGHT of the answers were right. Of languages with equal scores
    the first by name is taken. Repeated rows and equal texts are answered alike, a very long text is
    read as a whole, in a lot of its own; an empty table gives no rows.
    """
    text_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = part.fillna("").tolist()
            yield pd.concat([held.value.predict(texts[a:b]) for a, b in lots(texts)], ignore_index=True) if texts else held.value.predict([])

    d = docs.withColumn("_said", predict(F.col("text")))
    return d.withColumns({c: F.col(f"_said.{c}") for c in ("lang_pred", "score", "rejected")}).drop("_said")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identified(docs.select("doc_id", "text"), learn(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")
