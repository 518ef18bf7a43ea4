"""Quality classifier: a factorisation machine over hashed words and structure statistics.

The pairwise interactions of all features have low rank: their sum is
half of |sum x v|^2 - sum |x v|^2, so a text is scored in time linear in its words.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import WORD, Numbers, held_out, lots, materialise, text_batches

#: The classifier is fitted on about so many labelled rows at most, drawn evenly by a hash of their ids.
FIT_ROWS = 3000
BUCKETS, RANK, SEED, PASS_MARK = 1 << 14, 8, 11, 0.3
STATS = ("chars", "words", "word_length", "upper", "digits", "marks", "spaces", "lines", "distinct", "mark_runs", "pipes", "repeated_lines", "upper_words", "short_words", "line_length", "no_words")
UPPER, LETTER, DIGIT, SPACE, MARK, LINE, PIPE = (1 << i for i in range(7))


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Which classes each code point belongs to, as bits."""
    out = np.full(0x110000, MARK, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        out[c] = (LETTER | (UPPER if kind == "Lu" else 0)) if kind[0] == "L" else DIGIT if kind[0] == "N" else SPACE if kind[0] in "ZC" else MARK
    out[ord("\n")] |= LINE
    out[ord("|")] |= PIPE
    return out


def featurise(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words of all texts (text number, bucket, value) and their statistics (a row each).

    A word's value is its count over the root of the sum of the text's squared counts.
    """
    n = len(texts)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, texts), np.int64, n)
    doc = np.repeat(np.arange(n), size)
    kind = _classes()[codes]
    share = {bit: np.bincount(doc[(kind & bit) > 0], minlength=n) for bit in (UPPER, LETTER, DIGIT, SPACE, MARK, LINE, PIPE)}
    mark = (kind & MARK) > 0
    run = np.flatnonzero(mark[1:] & mark[:-1] & (doc[1:] == doc[:-1]))
    runs = np.bincount(doc[run], minlength=n)
    seen, words, per = Numbers(), [], np.zeros(n, np.int64)
    repeated, caps, per_line = np.zeros(n), np.zeros(n), np.zeros(n)
    for i, t in enumerate(texts):
        found = WORD.findall(t.lower())
        per[i] = len(found)
        words += found
        lines = [x for x in t.split("\n") if x]
        repeated[i] = 1 - len(set(lines)) / len(lines) if lines else 0
        per_line[i] = len(lines)
        caps[i] = sum(map(str.isupper, t.split()))
    code = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
    bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % BUCKETS for w in seen), np.int64, len(seen))
    length = np.fromiter(map(len, seen), np.int64, len(seen))
    of = np.repeat(np.arange(n), per)
    pair, count = np.unique(of * BUCKETS + bucket[code], return_counts=True)
    row, col = pair // BUCKETS, pair % BUCKETS
    value = count / np.sqrt(np.bincount(row, count.astype(float) ** 2, n))[row]
    chars, total = np.maximum(size, 1), np.maximum(per, 1)
    letters = np.bincount(of, length[code], n) if len(of) else np.zeros(n)
    short = np.bincount(of, length[code] <= 3, n) if len(of) else np.zeros(n)
    stats = [np.log1p(size), np.log1p(per), letters / total, share[UPPER] / np.maximum(share[LETTER], 1), share[DIGIT] / chars, share[MARK] / chars, share[SPACE] / chars, share[LINE] / total]
    stats += [np.bincount(row, minlength=n) / total, runs / total, share[PIPE] / total, repeated, caps / total, short / total, np.log1p(size / np.maximum(per_line, 1)), per == 0]
    return row, col, value, np.stack(stats, 1).astype(np.float64)


@dataclass
class FactorisationMachine:
    """Weights and factors of BUCKETS words followed by the statistics, and the statistics' scale."""

    bias: float
    weight: np.ndarray
    factor: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def margin(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, stats: np.ndarray) -> np.ndarray:
        n, rank = len(stats), self.factor.shape[1]
        z = self.scaled(stats)
        wz, vz = self.weight[BUCKETS:], self.factor[BUCKETS:]
        out = self.bias + z @ wz + np.bincount(row, self.weight[col] * value, n)
        for f in range(rank):
            x = self.factor[col, f] * value
            s = z @ vz[:, f] + np.bincount(row, x, n)
            out += 0.5 * (s * s - (z * z) @ (vz[:, f] ** 2) - np.bincount(row, x * x, n))
        return out

    def scaled(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -4, 4) / 2

    def score(self, *features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(*features), -30, 30)))


def fit(row: np.ndarray, col: np.ndarray, value: np.ndarray, stats: np.ndarray, label: np.ndarray, rank: int = RANK, epochs: int = 15, rate: float = 0.05, decay: float = 1e-4, seed: int = SEED) -> FactorisationMachine:
    """Logistic loss, AdaGrad steps over small lots. row must be in ascending order."""
    rng, n, d = np.random.default_rng(seed), len(label), BUCKETS + stats.shape[1]
    prior = (label.sum() + 1) / (n + 2)
    m = FactorisationMachine(float(np.log(prior / (1 - prior))), np.zeros(d), rng.normal(0, 0.01, (d, rank)), stats.mean(0) if n else np.zeros(stats.shape[1]), (stats.std(0) if n else np.zeros(stats.shape[1])) + 1e-6)
    if not n:
        m.factor[:] = 0
    gw, gv, gb = np.full(d, 1e-6), np.full((d, rank), 1e-6), 1e-6
    start = np.searchsorted(row, np.arange(n + 1))
    fixed = np.arange(BUCKETS, d)
    z = m.scaled(stats)
    for _ in range(epochs):
        order = rng.permutation(n)
        for a in range(0, n, 64):
            take = order[a : a + 64]
            per = start[take + 1] - start[take]
            at = np.concatenate([np.arange(start[i], start[i + 1]) for i in take]) if len(take) else np.zeros(0, np.int64)
            local = np.repeat(np.arange(len(take)), per)
            r = np.r_[local, np.repeat(np.arange(len(take)), len(fixed))]
            c = np.r_[col[at], np.tile(fixed, len(take))]
            x = np.r_[value[at], z[take].ravel()]
            v = m.factor[c] * x[:, None]
            s = np.zeros((len(take), rank))
            np.add.at(s, r, v)
            out = m.bias + np.bincount(r, m.weight[c] * x, len(take)) + 0.5 * ((s * s).sum(1) - np.bincount(r, (v * v).sum(1), len(take)))
            err = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - label[take]) / len(take)
            e = err[r] * x
            touched, where = np.unique(c, return_inverse=True)
            dw = np.bincount(where, e, len(touched)) + decay * m.weight[touched]
            dv = np.zeros((len(touched), rank))
            np.add.at(dv, where, e[:, None] * (s[r] - v))
            dv += decay * m.factor[touched]
            gw[touched] += dw**2
            gv[touched] += dv**2
            gb += err.sum() ** 2
            m.weight[touched] -= rate * dw / np.sqrt(gw[touched])
            m.factor[touched] -= rate * dv / np.sqrt(gv[touched])
            m.bias -= rate * err.sum() / np.sqrt(gb)
    return m


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> FactorisationMachine:
    """Fits on labelled rows that aren't held out; their features are made by the tasks.

    About fit_rows rows are drawn by a hash of the id, all of them where there are fewer. Labels
    that are null or have no document don't count; without any the score is 1/2 everywhere.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.min("quality").cast("double").alias("label"))
    known = materialise(known, "quality-labels")
    text_batches(docs.sparkSession)
    total = known.count()
    lot = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, fit_rows / max(total, 1)))
    known = known.filter(lot)
    rows = docs.select("doc_id", "text").filter(lot).join(known, "doc_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].fillna("").tolist()
            for a, b in lots(texts):
                row, col, value, stats = featurise(texts[a:b])
                cut = np.searchsorted(row, np.arange(b - a + 1))
                yield pd.DataFrame({"doc_id": frame["doc_id"].iloc[a:b].to_numpy(), "label": frame["label"].iloc[a:b].to_numpy(), "col": [col[i:j].astype(np.int32) for i, j in zip(cut, cut[1:])], "value": [value[i:j].astype(np.float32) for i, j in zip(cut, cut[1:])], "stats": list(stats)})

    got = rows.mapInPandas(run, "doc_id bigint, label double, col array<int>, value array<float>, stats array<double>").toPandas().sort_values(["doc_id", "label"], kind="stable")
    per = got["col"].map(len).to_numpy(np.int64)
    flat = lambda c, kind: np.concatenate(got[c].tolist()).astype(kind) if len(got) else np.zeros(0, kind)
    stats = np.array(got["stats"].tolist(), float).reshape(len(got), len(STATS))
    return fit(np.repeat(np.arange(len(got)), per), flat("col", np.int64), flat("value", float), stats, got["label"].to_numpy(float))


def scored(docs: DataFrame, machine: FactorisationMachine, out: str = "score") -> DataFrame:
    """Adds the machine's score of the whole text (null: empty) to every row. A column named `out` is replaced."""
    text_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = part.fillna("").tolist()
            yield pd.Series(np.concatenate([held.value.score(*featurise(texts[a:b])) for a, b in lots(texts)]) if texts else np.zeros(0))

    return docs.withColumn(out, score(F.col("text")))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Repeated rows and equal texts are scored alike, a null text as the empty one, a very long text as
    a whole, in a lot of its own; a score of just the mark passes. Of several labels of one id the
    lower counts, labels without a document or value don't. An empty table gives no rows; columns
    other than doc_id and text aren't read.
    """
    machine = learn(docs, labels)
    s = scored(docs.select("doc_id", "text"), machine)
    return s.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= PASS_MARK).cast("int").alias("predicted"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
