"""Periodic run detection: stretches of words that repeat with a period, found by the dictionary of basic factors.

For each power of two the dictionary names the factors of that many words, by pairs of the names
of half that length; factors that don't recur within a quarter of their text drop out, so that few
are left after the first lengths. Where three successive occurrences of a factor stand in an
arithmetic progression, whose step is at most twice the factor's length, the step is proposed as a
period. Proposals are extended to both sides as far as words a step apart are equal, and one is
kept of those that extend to the same stretch: that with the smallest period.

A stretch of at least four periods q holds such a progression: the factor whose length is the
least power of two from q on, below 2q, occurs in it at steps of exactly q, three times at least.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Numbers, lots, text_batches

#: A run has so many periods and so many words at least.
PERIODS, LEAST = 4, 6
SPACES = r"[\x20\x09-\x0D]+"
RUN = "start bigint, length bigint, period bigint"


def progressions(ids: np.ndarray, ends: np.ndarray, periods: int = PERIODS) -> tuple[np.ndarray, np.ndarray]:
    """Places and proposed periods in texts that follow each other in ids: text t ends before place ends[t].

    Of proposals of one period at neighbouring places the first is given.
    """
    n = len(ids)
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    most = (np.diff(ends, prepend=0) // periods)[text]  # the longest period that fits
    at, name, length = np.arange(n), ids.astype(np.int64), 1
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    while len(at):
        order = np.argsort(name, kind="stable")
        place, sorted_name = at[order], name[order]
        same = (sorted_name[1:] == sorted_name[:-1]) & (text[place[1:]] == text[place[:-1]])
        step = np.where(same, place[1:] - place[:-1], n + 1)
        near = step <= most[place[:-1]]
        gap = np.append(np.where(near, step, 0), 0)  # to the next occurrence
        third = near & (gap[:-1] == gap[1:]) & (gap[:-1] <= 2 * length)
        i, q = place[:-1][third], gap[:-1][third]
        if len(i):
            by = np.lexsort((i, q))
            i, q = i[by], q[by]
            first = np.r_[True, (q[1:] != q[:-1]) | (i[1:] != i[:-1] + 1)]
            found.append((i[first], q[first]))
        again = np.zeros(len(place), bool)
        again[:-1] |= near
        again[1:] |= near
        number = np.cumsum(np.r_[True, sorted_name[1:] != sorted_name[:-1]]) - 1
        names = np.full(n, -1)
        names[place[again]] = number[again]
        at = np.flatnonzero(names >= 0)
        at = at[at + length < n]
        after = at + length
        both = (names[after] >= 0) & (text[after] == text[at])
        at, after = at[both], after[both]
        name = names[at] * (number[-1] + 1) + names[after]
        length *= 2
    return tuple(np.concatenate(x) for x in zip(*found))


def _equal(ids: np.ndarray, i: int, q: int, end: int) -> int:
    """The number of places from i on that equal those q further on, which lie before end."""
    far, step = i, 64
    while far + q < end:
        stop = min(far + step, end - q)
        other = ids[far:stop] != ids[far + q : stop + q]
        k = int(other.argmax())
        if other[k]:
            return far + k - i
        far, step = stop, 2 * step
    return far - i


def runs_of(ids: np.ndarray, ends: np.ndarray, periods: int = PERIODS, least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """For each text the runs (start, length, period), in order: see runs()."""
    out: list[dict[tuple[int, int], int]] = [{} for _ in ends]
    if not len(ids):
        return [[] for _ in ends]
    begins = np.r_[0, ends[:-1]]
    back = ids[::-1]
    where, period = progressions(ids, ends, periods)
    order = np.lexsort((where, period))
    texts = np.searchsorted(ends, where, "right")
    known = (-1, -1, -1)  # text, period and end of the last run
    for k in order:
        i, q, t = int(where[k]), int(period[k]), int(texts[k])
        if known[:2] == (t, q) and i + q < known[2]:
            continue
        begin, end = int(begins[t]), int(ends[t])
        last = i + q + _equal(ids, i, q, end)
        # Before i: words that equal those q later, read from behind.
        start = i - _equal(back, len(ids) - i - q, q, len(ids) - begin)
        known = (t, q, last)
        if last - start >= max(least, periods * q):
            key = (start - begin, last - start)
            out[t][key] = min(q, out[t].get(key, q))
    return [sorted((s, n, q) for (s, n), q in x.items()) for x in out]


def _scanned(texts: list[str | None]) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Words and runs of each text."""
    for a, b in lots(texts):
        numbers = Numbers()
        words = [(t or "").encode().split() for t in texts[a:b]]
        ids = np.fromiter((numbers[w] for ws in words for w in ws), np.int64, sum(map(len, words)))
        yield from zip(words, runs_of(ids, np.cumsum([len(w) for w in words])))


def _kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run contains after its first period."""
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, q in runs:
            keep[start + q : start + length] = False
        words = list(compress(words, keep))
    return b" ".join(words)


def runs(docs: DataFrame) -> DataFrame:
    """docs with the column runs, an array of (start, length, period) in order, and collapsed, the text without repetitions.

    A run is a stretch of consecutive words whose smallest period q is at most a quarter of its
    length (words q apart are equal), of LEAST words or more, that no neighbouring word extends;
    start is the number of its first word, from 0. Words are what stands between the six white
    spaces of ASCII, compared as they are; collapsed has those that no run contains after its first
    q words, with one space between. A null or empty text has no runs and collapses to the empty
    one; rows are independent, so that ids, repeated rows and ties have no effect; a very long text
    is looked through as a whole, in time that grows as n log n. Columns named runs and collapsed
    are replaced.
    """
    text_batches(docs.sparkSession)
    rest = docs.select([c for c in docs.columns if c not in ("runs", "collapsed")])
    place = rest.columns.index("text")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, texts = [], []
            for words, of in _scanned(batch.column(place).to_pylist()):
                found.append([dict(zip(("start", "length", "period"), r)) for r in of])
                texts.append(_kept(words, of).decode())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind), pa.array(texts, pa.string())], [*batch.schema.names, "runs", "collapsed"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return rest.mapInArrow(run, f"{fields}, runs array<struct<{RUN.replace(' bigint', ':bigint')}>>, collapsed string")


def described(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli (of the run with the greatest length / period; ties: smallest start, then period), runs_sha256, collapsed_sha256, n_dropped.

    The digests are those of one line `start,length,period` for each run, and of the collapsed text.
    Edge cases: see runs(). Other columns aren't read.
    """
    text_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_dropped"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for words, of in _scanned(batch.column(1).to_pylist()):
                best = max(of, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
                start, length, q = best or (None, None, None)
                text = _kept(words, of)
                lines = "".join(f"{s},{n},{p}\n" for s, n, p in of).encode()
                n_kept = text.count(b" ") + bool(text)
                rows.append((len(of), start, length, q, 1000 * length // q if best else None, hashlib.sha256(lines).hexdigest(), hashlib.sha256(text).hexdigest(), len(words) - n_kept))
            columns = zip(*rows) if rows else [()] * len(names)
            arrays = [pa.array(x, pa.string() if c.endswith("sha256") else pa.int64()) for x, c in zip(columns, names)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *names])

    fields = ", ".join(f"{c} {'string' if c.endswith('sha256') else 'bigint'}" for c in names)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {fields}")


def planted(docs: DataFrame) -> DataFrame:
    """docs, where of a tenth of the ids (crc32 divisible by 10) the text's words repeat from some place on: word i >= a becomes word a + (i - a) % p.

    a and p follow from the id: with g = crc32 div 10 and n words, a = g % n and p = 1 + floor((n - a) / (3 + g % 8)).
    Rows without an id or without words stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words: Column = F.array_remove(F.split(F.col("text"), SPACES), "")
    repeat = F.expr("array_join(transform(sequence(0, size(_w) - 1), i -> _w[int(if(i < _a, i, _a + (i - _a) % _p))]), ' ')")
    d = docs.withColumn("_w", F.when(h % 10 == 0, words)).withColumn("_a", g % F.nullif(F.size("_w"), F.lit(0)))
    d = d.withColumn("_p", 1 + F.floor((F.size("_w") - F.col("_a")) / (3 + g % 8)))
    return d.withColumn("text", F.when(F.size("_w") > 0, repeat).otherwise(F.col("text"))).select(*docs.columns)


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document, where the texts of a tenth of the ids are made to repeat."""
    return described(planted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
