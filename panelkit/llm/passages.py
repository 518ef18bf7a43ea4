"""Substring dedup: repeated lines and paragraphs are found by their digests and removed but for the first.

Texts are normalised to words. Their units are lines and paragraphs, which repeat as a whole.
As a second level, for passages inside lines, windows of UNIT words are units, too, which their
content selects: each run of MIN_WORDS words selects, of its SPREAD windows, the one with the least
hash, so that equal runs always select the same one, wherever they stand in their lines. Digests
are grouped globally. A line or paragraph repeats the earliest with its digest. Occurrences of a window whose selecting runs are all the same repeat the
earliest of them as a whole; where they differ, the earliest of each kind send every run of
MIN_WORDS words to a group of its own, which keeps its earliest occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import LOT_CODES, OTHER, CodeWords, lots, materialise, mixed, rolled, spans, text_batches

MIN_WORDS, UNIT = 50, 30
SPREAD = MIN_WORDS - UNIT + 1
GOLD = np.uint64(0x9E3779B97F4A7C15)


def run_hashes(s: np.ndarray, unit: int = UNIT, spread: int = SPREAD) -> np.ndarray:
    """Hashes of all runs of unit + spread - 1 words, from those of the windows of unit words that cover them."""
    n = len(s) - spread + 1
    out = s[:n]
    for k in sorted({*range(0, spread - 1, unit), spread - 1} - {0}):
        out = mixed(out * GOLD + s[k : k + n])
    return out


def least(s: np.ndarray, spread: int) -> np.ndarray:
    """Place of the least of each `spread` neighbours in s, the last of equal ones."""
    at, width = np.arange(len(s)), 1
    while width < spread:
        step = min(width, spread - width)
        at = np.where(s[:-step] < s[step:], at[:-step], at[step:])
        s = np.minimum(s[:-step], s[step:])
        width += step
    return at


def selected(h: np.ndarray, first: np.ndarray, unit: int = UNIT, spread: int = SPREAD) -> tuple[np.ndarray, ...]:
    """Of the units of texts, given their words' hashes and the number of each one's first word (and of all): digest, first word and end of the runs that select it, and a hash of these runs."""
    begins = spans(np.maximum(np.diff(first) - (unit + spread - 2), 0), first[:-1])
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    s = rolled(h, unit)
    chosen = least(s, spread)[begins]
    lo = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])  # runs that follow each other and choose the same
    n = np.diff(np.r_[lo, len(chosen)])
    at, lo = chosen[lo], begins[lo]
    r = run_hashes(s, unit, spread)
    return s[at], lo, lo + n + unit + spread - 2, mixed(r[lo] * GOLD + r[lo + n - 1])


def line_ranges(words: CodeWords) -> np.ndarray:
    """First word and end of the lines and paragraphs (lines between blank ones) that have words, each range once."""
    feed, back = words.codes == ord("\n"), words.codes == ord("\r")
    back[:-1] &= ~feed[1:]
    stop = np.flatnonzero(feed | back)
    end = np.searchsorted(words.start, stop)
    marks = np.searchsorted(np.flatnonzero(words.kind == OTHER), stop)
    begin = np.r_[0, end[:-1]]
    closing = (begin == end) & (marks == np.r_[0, marks[:-1]])
    closing[np.searchsorted(stop, words.base[1:] - 1)] = True  # the last line of each text
    close = end[closing]
    begin, end = np.r_[begin, 0, close[:-1]], np.r_[end, close]
    found = np.unique((begin[begin < end] << 32) + end[begin < end])
    return np.stack([found >> 32, found & 0xFFFFFFFF], axis=1)


def whole_digests(h: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    """Digests of ranges of words, given the words' hashes: equal for equal words in the same order."""
    if not len(ranges):
        return np.zeros(0, np.uint64)
    n = ranges[:, 1] - ranges[:, 0]
    begins = np.cumsum(n) - n
    place = (np.arange(n.sum()) - np.repeat(begins, n)).astype(np.uint64)
    total = np.add.reduceat(mixed(h[spans(n, ranges[:, 0])] + place * GOLD), begins)
    return mixed(total * GOLD + n.astype(np.uint64))


def _digest(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def units(docs: DataFrame, unit: int = UNIT, spread: int = SPREAD) -> DataFrame:
    """doc_id, text_key (tells rows with the same id apart), word and past (first word and end of what a unit stands for), digest and context (of the unit, and of all its words) of every unit."""
    text_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for a, b in lots(texts, LOT_CODES):
                words = CodeWords(texts[a:b])
                ranges = line_ranges(words)
                whole = (whole_digests(words.hash, ranges), ranges[:, 0], ranges[:, 1], np.zeros(len(ranges), np.uint64))
                digest, word, past, context = (np.concatenate(x) for x in zip(selected(words.hash, words.first, unit, spread), whole))
                text = words.text_of(word)
                word, past = word - words.first[text], past - words.first[text]
                row = pa.array(a + text)
                values = [pa.array(x) for x in (word.astype(np.int32), past.astype(np.int32), digest.view(np.int64), context.view(np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *values], ["doc_id", "text_key", "word", "past", "digest", "context"])

    rows = docs.select("doc_id", _digest(F.col("text")).alias("text_key"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, text_key bigint, word int, past int, digest bigint, context bigint")


def _placed(texts: DataFrame, min_words: int, unit: int) -> DataFrame:
    """Characters of the units in `at`: one row for a unit that repeats as a whole (run is null), else one for each of its runs."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "text_key", "word", "first", "last", "line", "first_doc_id", "digest", "context", "run"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, texts = batch.column(2), batch.column(3).to_pylist()
            flat, ends = at.flatten(), at.offsets.to_numpy() - at.offsets[0].as_py()
            word, past = (flat.field(x).to_numpy().astype(np.int64) for x in ("word", "past"))
            whole = flat.field("whole").to_numpy(zero_copy_only=False)
            for a, b in lots(texts, LOT_CODES):
                words = CodeWords(texts[a:b])
                text = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))  # of each unit
                mine = np.arange(ends[a], ends[b])
                first, base = words.first[text], words.base[text]
                w, p, full = word[mine] + first, past[mine] + first, whole[mine]
                n = np.where(full, 1, p - w - min_words + 1)
                of = np.repeat(np.arange(len(mine)), n)
                begins = spans(n, w)
                none = full[of]
                lasts = np.where(none, p[of], begins + min_words) - 1
                runs = np.zeros(len(of), np.uint64)
                if not full.all():
                    runs[~none] = run_hashes(rolled(words.hash, unit), unit, min_words - unit + 1)[begins[~none]]
                row, take = pa.array(a + text[of]), pa.array(mine[of])
                values = [begins - first[of], words.start[begins] - base[of], words.end[lasts] - base[of]]
                values = [pa.array(x.astype(np.int32)) for x in values]
                keys = [flat.field(x).take(take) for x in ("line", "first_doc_id", "digest", "context")]
                hashed = pa.array(runs.view(np.int64), mask=none)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *values, *keys, hashed], names)

    return texts.select("doc_id", "text_key", "at", "text").mapInArrow(run, f"doc_id {kind}, text_key bigint, word int, first int, last int, line boolean, first_doc_id {kind}, digest bigint, context bigint, run bigint")


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, unit: int = UNIT) -> DataFrame:
    """doc_id, text_key, first, last (characters), line, first_doc_id: the lines and paragraphs (line) and the passages that an earlier row has, too.

    Rows are ranked by doc_id, then by a digest of their text; null ids come first. Lines and
    paragraphs count whatever their length, other passages from min_words words on, in the same text
    as well: every run of min_words words that stands earlier anywhere is in one. Lines without
    words stay. Words are compared in lower case, by 64-bit hashes, and without what
    stands between them. Rows that repeat both id and text count as one. A very long text is cut
    into all its units; its repeated ones come together as one row. Null and empty texts and an
    empty table give none.
    """
    docs = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    found = materialise(units(docs, unit, min_words - unit + 1), "passage-units")
    rank = F.struct("doc_id", "text_key", "word")
    many = found.groupBy("digest").agg(F.min(rank).alias("kept"), F.max(rank).alias("latest"), (F.min("context") != F.max("context")).alias("several")).filter("kept <> latest").select("digest", "several")
    # What is summed up by digest is stored before it is joined: both sides are then shuffled for the
    # join alone, so that Spark can split the many rows of one digest over several tasks.
    hits = materialise(found.join(materialise(many, "passage-digests"), "digest"), "passage-hits")
    kept = materialise(hits.groupBy("digest", "context").agg(F.min(rank).alias("kept")), "passage-kept")
    hits = hits.join(kept, ["digest", "context"]).withColumn("whole", rank != F.col("kept")).filter("whole or several")
    key = lambda c: F.when(F.col("several"), F.col(c)).alias(c)
    hits = hits.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("word", "past", "whole", (F.col("context") == 0).alias("line"), F.col("kept.doc_id").alias("first_doc_id"), key("digest"), key("context"))).alias("at"))
    rows = docs.withColumn("text_key", _digest(F.col("text"))).alias("r")
    hits = hits.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    texts = rows.join(hits, F.col("r.doc_id").eqNullSafe(F.col("_id")) & (F.col("r.text_key") == F.col("_key")))
    text_batches(docs.sparkSession)
    placed = materialise(_placed(texts, min_words, unit), "passage-places")
    # Where the runs around a unit differ, each run of min_words words has its own earliest occurrence.
    runs = placed.filter("run is not null")
    runs = runs.join(materialise(runs.groupBy("digest", "run").agg(F.min(rank).alias("kept")), "passage-runs"), ["digest", "run"])
    keepers = materialise(runs.groupBy("digest", "context").agg(F.collect_set(F.struct("kept.doc_id")).alias("ids")), "passage-keepers")
    out = ["doc_id", "text_key", "first", "last", "line"]
    alone = placed.filter("run is null and digest is null").select(*out, "first_doc_id")
    again = runs.filter(rank != F.col("kept")).select(*out, F.col("kept.doc_id").alias("first_doc_id"))
    same = placed.filter("run is null and digest is not null").join(keepers, ["digest", "context"]).select(*out, F.explode("ids").alias("_k")).select(*out, F.col("_k.doc_id").alias("first_doc_id"))
    return alone.union(again).union(same)


def removals(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each document that repeats a passage: doc_id, text_key, removed (ranges first .. last of characters, apart, in order), removed_chars, first_doc_ids (of the rows that keep the passages), lines, passages.

    lines are the ranges of repeated lines and paragraphs, passages those of repeated runs of
    min_words words and more; removed is both together. Ties, repeated rows and nulls: see repeats().
    """
    r = repeats(docs, min_words).groupBy("doc_id", "text_key", "first", "last", "line").agg(F.collect_set("first_doc_id").alias("ids"))
    # Ranges that overlap become one; a text may have very many lines, so this isn't done within a row.
    order = Window.partitionBy("doc_id", "text_key").orderBy("first", "last", "line")
    before, here = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)

    def part(of: Column) -> Column:
        return F.when(of & ~F.coalesce(F.max(F.when(of, F.col("last"))).over(before) >= F.col("first"), F.lit(False)), 1).otherwise(0)

    r = r.withColumns({"n": part(F.lit(True)), "n_line": part(F.col("line")), "n_run": part(~F.col("line"))})
    r = r.withColumns({"part": F.sum("n").over(here), "own": F.when(F.col("line"), F.sum("n_line").over(here)).otherwise(F.sum("n_run").over(here))})
    r = r.groupBy("doc_id", "text_key", "part", "line", "own").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
    r = r.groupBy("doc_id", "text_key", "part").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.collect_list(F.struct("line", "first", "last")).alias("own"), F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
    r = r.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("removed"), F.sum(F.col("last") - F.col("first")).alias("removed_chars"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("first_doc_ids"), F.flatten(F.collect_list("own")).alias("own"))
    level = lambda line: F.array_sort(F.transform(F.filter("own", lambda x: x["line"] == F.lit(line)), lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"))))
    return r.select("doc_id", "text_key", "removed", "removed_chars", "first_doc_ids", level(True).alias("lines"), level(False).alias("passages"))


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with repeated passages cut out of `text`, and the column removed with their ranges in the text as it was (null: none)."""
    cut = removals(docs, min_words).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "removed")
    d = docs.drop("removed").withColumn("_text_key", _digest(F.col("text")))
    j = d.join(cut, d["doc_id"].eqNullSafe(cut["_id"]) & (d["_text_key"] == cut["_key"]), "left")
    begins = F.concat(F.array(F.lit(0)), F.transform("removed", lambda r: r["last"]))
    ends = F.concat(F.transform("removed", lambda r: r["first"]), F.array(F.length("text")))
    kept = F.array_join(F.transform(F.arrays_zip(begins.alias("b"), ends.alias("e")), lambda x: F.substring(F.col("text"), x["b"] + 1, x["e"] - x["b"])), "")
    out = [F.when(F.col("removed").isNull(), F.col("text")).otherwise(kept).alias(c) if c == "text" else F.col(c) for c in docs.columns if c != "removed"]
    return j.select(*out, "removed")


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_key")
