"""Ranked lexical search by range maxima: best-first search of document intervals over posting lists.

Tasks pack their documents into shards; a shard's index has a posting list for each term. Where
lists meet queries, each list gets a sparse table, that answers for any interval of documents
which of them has the greatest impact. A query begins with the interval of all documents; the sum
of its terms' maxima times their weights bounds what is in it. Of all intervals those with the
highest bounds are opened first: the document with the greatest single contribution is scored, and
what lies left and right of it are new intervals with bounds of their own. An interval whose bound
can't reach the best found so far is never opened, so that the result is exact.

Index and queries meet in joins on term; nothing but three counts passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import bitmap, byte_words, marked, materialise, text_batches

TOP = 10
#: A shard ends with so many documents or words.
SHARD_DOCS, SHARD_WORDS = 2048, 1_500_000
#: A lot has about so many rows (query, term); intervals that a query opens at once; numbers in the arrays of one search.
LOT_ROWS, AT_ONCE, MATRIX = 20_000, 8, 400_000
#: One in so many shards is searched first.
FIRST_SHARDS = 6
#: Stands for no id: the last in the order.
NO_ID = np.iinfo(np.int64).max
LOW = np.int64(0xFFFFFFFF)


def index(docs: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """shard, term, numbers, counts, ids: for each shard a row for each term, with the numbers of the documents that hold it and how often, and a row without term, with all documents' ids and numbers of words.

    wanted: a bitmap of the terms that are asked for; others get no lists, but count in the numbers
    of words. Documents without a word are in no shard. In a shard, documents lie in the order of
    their most frequent term, number of words and id, so that those of one language, and copies,
    stand together and bounds of intervals differ.
    """
    spark = docs.sparkSession
    text_batches(spark)
    held = spark.sparkContext.broadcast(wanted)
    names = ["shard", "term", "numbers", "counts", "ids"]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def packed(shard: int, ids: np.ndarray, sizes: np.ndarray, terms: np.ndarray, of: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(terms, kind="stable")  # words come in the order of documents
        terms, of = terms[order], of[order]
        new = np.flatnonzero(np.r_[np.ones(min(1, len(terms)), bool), (terms[1:] != terms[:-1]) | (of[1:] != of[:-1])])
        counts, terms, of = np.diff(np.r_[new, len(terms)]), terms[new], of[new]
        lead = np.zeros(len(ids), np.uint64)
        np.maximum.at(lead, of, (counts.astype(np.uint64) << np.uint64(40)) | (terms.view(np.uint64) >> np.uint64(24)))
        order = np.lexsort((ids, sizes, lead))
        turn = np.empty(len(ids), np.int64)
        turn[order] = np.arange(len(ids))
        start = np.flatnonzero(np.r_[np.ones(min(1, len(terms)), bool), terms[1:] != terms[:-1]])
        group = np.cumsum(np.bincount(start, minlength=len(terms)))
        by = np.argsort(group * len(ids) + turn[of], kind="stable")
        n, m = len(ids), len(start)
        ends = np.r_[start[1:], len(terms)][: m]
        columns = [
            pa.array(np.full(m + 1, shard)),
            pa.array(np.r_[0, terms[start]], mask=np.arange(m + 1) == 0),
            pa.ListArray.from_arrays(pa.array(np.r_[0, 0, ends].astype(np.int32)), pa.array(turn[of][by].astype(np.int32))),
            pa.ListArray.from_arrays(pa.array(np.r_[0, n, n + ends].astype(np.int32)), pa.array(np.r_[sizes[order], counts[by]].astype(np.int32))),
            pa.ListArray.from_arrays(pa.array(np.r_[0, np.full(m + 1, n)].astype(np.int32)), pa.array(ids[order])),
        ]
        return pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, docs, size = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch in batches:
            every = np.array(batch.column(0).cast(pa.int64()).fill_null(NO_ID), np.int64)
            for a, b, words in byte_words(batch.column(1)):
                lengths = np.diff(words.first)
                some = lengths > 0
                terms = words.hash.view(np.int64)
                of = np.repeat(np.cumsum(some) - 1, lengths)
                if held.value is not None:
                    keep = marked(held.value, words.hash)
                    terms, of = terms[keep], of[keep]
                parts.append((every[a:b][some], lengths[some], terms, of + docs))
                docs, size = docs + int(some.sum()), size + len(terms)
                if docs >= SHARD_DOCS or size >= SHARD_WORDS:
                    yield packed(shard, *(np.concatenate(x) for x in zip(*parts)))
                    shard, parts, docs, size = shard + 1, [], 0, 0
        if docs:
            yield packed(shard, *(np.concatenate(x) for x in zip(*parts)))

    return docs.select("doc_id", "text").mapInArrow(run, "shard bigint, term bigint, numbers array<int>, counts array<int>, ids array<bigint>")


def query_terms(queries: DataFrame) -> DataFrame:
    """query, term, times of every query (query, text)."""
    text_batches(queries.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in byte_words(batch.column(1)):
                for i in range(b - a):
                    terms, times = np.unique(words.hash[words.first[i] : words.first[i + 1]].view(np.int64), return_counts=True)
                    query = batch.column(0).take(pa.array(np.full(len(terms), a + i)))
                    yield pa.RecordBatch.from_arrays([query, pa.array(terms), pa.array(times)], ["query", "term", "times"])

    return queries.select("query", "text").mapInArrow(run, "query bigint, term bigint, times bigint")


def sparse_table(values: np.ndarray, longest: int, least: bool = False) -> np.ndarray:
    """Row k: the greatest (or least) of the 2 ** k values from each place on, as far as there are some."""
    rows, pick = [values], np.minimum if least else np.maximum
    while 2 << len(rows) - 1 <= longest:
        half, last = 1 << len(rows) - 1, rows[-1]
        rows.append(np.r_[pick(last[:-half], last[half:]), last[-half:]])
    return np.array(rows)


class Lists:
    """Posting lists of a shard, one after another, and a last empty one: documents, impacts and sparse tables."""

    def __init__(self, docs: np.ndarray, impact: np.ndarray, ends: np.ndarray, ids: np.ndarray):
        self.n, self.docs, self.impact, self.ids = len(ids), docs, impact, ids
        self.first = np.r_[0, ends, ends[-1:]]
        size = np.diff(self.first)
        self.keys = np.repeat(np.arange(len(size)), size) * self.n + docs
        longest = max(int(size.max()), self.n)
        self.log = np.floor(np.log2(np.maximum(np.arange(longest + 1), 1))).astype(np.int64)
        # Impact and place as one number, the earliest of equal impacts as the greatest.
        self.table = sparse_table((impact << 32) | (LOW - np.arange(len(impact))), int(size.max()))
        self.least = sparse_table(ids, self.n, least=True)

    def most(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The greatest impact (upper half) and its place (from LOW down) in the places a .. b of a list; 0 where there are none."""
        k = self.log[b - a]
        last = len(self.docs) - 1
        return np.where(b > a, np.maximum(self.table[k, np.minimum(a, last)], self.table[k, np.maximum(b - (1 << k), 0)]), 0)

    def least_id(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        k = self.log[hi - lo]
        return np.minimum(self.least[k, lo], self.least[k, hi - (1 << k)])


def best(lists: Lists, terms: np.ndarray, weights: np.ndarray, top: int, mark: np.ndarray, mark_id: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Queries (rows of terms and weights), documents and scores: each query's `top` best, of those that beat its mark (a score, and the id that has it); and how many documents were scored.

    terms: numbers of lists, filled up with that of the empty one.
    """
    mark, mark_id, scored = mark.copy(), mark_id.copy(), 0
    place = np.arange(len(terms))
    kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))  # query, document, score

    def bounded(q: np.ndarray, a: np.ndarray, b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
        code = lists.most(a, b)
        gain = (code >> 32) * weights[q]
        lead = gain.argmax(1)
        row = np.arange(len(q))
        split = lists.docs[np.minimum(LOW - (code[row, lead] & LOW), len(lists.docs) - 1)]
        return alive((q, a, b, lo, hi, gain.sum(1), split))

    def alive(open_: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        q, _, _, lo, hi, bound, _ = open_
        keep = bound > mark[q]
        tie = np.flatnonzero((bound == mark[q]) & (bound > 0))
        keep[tie] = lists.least_id(lo[tie], hi[tie]) < mark_id[q[tie]]
        return tuple(x[keep] for x in open_)

    open_ = bounded(place, lists.first[terms], lists.first[terms + 1], np.zeros(len(terms), np.int64), np.full(len(terms), lists.n))
    while len(open_[0]):
        order = np.lexsort((-open_[5], open_[0]))
        q = open_[0][order]
        now = np.zeros(len(q), bool)
        now[order[np.arange(len(q)) - np.searchsorted(q, q) < AT_ONCE]] = True
        q, a, b, lo, hi, _, split = (x[now] for x in open_)
        p = np.clip(np.searchsorted(lists.keys, terms[q] * lists.n + split[:, None]), a, b)
        at = np.minimum(p, len(lists.docs) - 1)
        hit = (p < b) & (lists.docs[at] == split[:, None])
        score = (lists.impact[at] * weights[q] * hit).sum(1)
        scored += len(q)
        beats = (score > mark[q]) | (score == mark[q]) & (lists.ids[split] < mark_id[q])
        every = [np.r_[x, y[beats]] for x, y in zip(kept, (q, split, score))]
        order = np.lexsort((lists.ids[every[1]], -every[2], every[0]))
        kept = [x[order] for x in every]
        rank = np.arange(len(order)) - np.searchsorted(kept[0], kept[0])
        kept = [x[rank < top] for x in kept]
        last = rank[rank < top] == top - 1
        q_, s, i = kept[0][last], kept[2][last], lists.ids[kept[1][last]]
        up = (s > mark[q_]) | (s == mark[q_]) & (i < mark_id[q_])
        mark[q_[up]], mark_id[q_[up]] = s[up], i[up]
        left, right = lo < split, split + 1 < hi
        new = [bounded(q[left], a[left], p[left], lo[left], split[left]), bounded(q[right], (p + hit)[right], b[right], split[right] + 1, hi[right])]
        open_ = tuple(np.concatenate(x) for x in zip(alive(tuple(x[~now] for x in open_)), *new))
    return *kept, scored


def _searched(rows: DataFrame, n_docs: int, n_words: int, top: int) -> DataFrame:
    """query, doc_id, score: for each shard and lot (groups of rows) the best of each query that beat its mark."""

    def run(table: pa.Table) -> pa.Table:
        of_docs = table.filter(table["ids"].is_valid())
        lists = table.filter(table["ids"].is_null())
        found = []
        if len(of_docs) and len(lists):
            ids, sizes = (of_docs[c].combine_chunks().flatten().to_numpy() for c in ("ids", "counts"))
            numbers = lists["numbers"].combine_chunks()
            docs = numbers.flatten().to_numpy().astype(np.int64)
            tf = lists["counts"].combine_chunks().flatten().to_numpy().astype(np.int64)
            m = 100 - 75 + (75 * sizes.astype(np.int64) * n_docs) // n_words
            impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[docs])
            index = Lists(docs, impact, np.cumsum(numbers.value_lengths().to_numpy()), ids)
            asked = lists["asked"].combine_chunks()
            term = np.repeat(np.arange(len(lists)), asked.value_lengths().to_numpy())
            query, weight = (asked.flatten().field(c).to_numpy() for c in ("query", "weight"))
            marks = of_docs["marks"].combine_chunks().flatten()
            known = {q: (s, i) for q, s, i in zip(*(marks.field(c).to_pylist() for c in ("query", "score", "id")))}
            order = np.argsort(query, kind="stable")
            query, term, weight = query[order], term[order], weight[order]
            names, first, size = np.unique(query, return_index=True, return_counts=True)
            by = np.argsort(size, kind="stable")  # queries of like size are searched together
            while len(by):
                n = max(1, int(np.searchsorted(np.arange(1, len(by) + 1) * size[by], MATRIX // AT_ONCE // 8, "right")))
                own, by = by[:n], by[n:]
                shape = (n, int(size[own].max()))
                terms, weights = np.full(shape, len(lists)), np.zeros(shape, np.int64)
                for row, k in enumerate(own):
                    terms[row, : size[k]] = term[first[k] : first[k] + size[k]]
                    weights[row, : size[k]] = weight[first[k] : first[k] + size[k]]
                mark, mark_id = np.array([known.get(q, (0, NO_ID)) for q in names[own].tolist()], np.int64).T
                q, d, s, _ = best(index, terms, weights, top, mark, mark_id)
                found.append((names[own][q], ids[d], s))
        q, i, s = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(q), pa.array(i, mask=i == NO_ID), pa.array(s)], ["query", "doc_id", "score"])

    return rows.groupBy("shard", "lot").applyInArrow(run, "query bigint, doc_id bigint, score bigint")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top)


def ranked(docs: DataFrame, queries: DataFrame, top: int = TOP, indexed: DataFrame | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: for each query (item_id, text) the `top` documents with the highest scores above 0.

    Words are runs of digits, letters of ASCII in any case and code points beyond ASCII. The score
    is a sum over a query's words, repeats included, of weight times impact, both whole numbers: see
    SQL. Of equal scores the smaller id is first, null last. Null and empty texts and an empty table
    give no results; queries that repeat id and text are one, repeated documents are results of
    their own. A very long text counts as a whole, as document and as query. Other columns aren't
    read. doc_id is a whole number. indexed: an index() of docs that is stored already.
    """
    names = materialise(queries.select("item_id", "text").dropDuplicates().withColumn("query", F.monotonically_increasing_id()), "ranked-queries")
    terms = materialise(query_terms(names), "ranked-terms")
    if indexed is None:
        indexed = materialise(index(docs, bitmap(terms, "term")), "ranked-index")
    of_docs, lists = indexed.filter("term is null"), indexed.filter("term is not null")
    n_docs, n_words = of_docs.agg(F.sum(F.size("ids")), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    n_docs, n_words = n_docs or 0, n_words or 1
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    df = lists.groupBy("term").agg(F.sum(F.size("numbers")).alias("df"))
    n_lots = terms.count() // LOT_ROWS + 1
    lot = F.pmod(F.xxhash64("query"), F.lit(n_lots)).alias("lot")
    asked = terms.join(df, "term").select(lot, "query", "term", (F.col("times") * weight).alias("weight")).filter("weight > 0")
    asked = materialise(asked.groupBy("lot", "term").agg(F.collect_list(F.struct("query", "weight")).alias("asked")), "ranked-asked")
    lots = asked.select("lot").distinct()
    none = F.expr("cast(null as array<bigint>)")
    pairs = lists.join(asked, "term").select("shard", "lot", "numbers", "counts", none.alias("ids"), "asked", F.expr("cast(null as array<struct<query:bigint,score:bigint,id:bigint>>)").alias("marks"))

    def searched(first: bool, marks: DataFrame) -> DataFrame:
        turn = (F.pmod(F.xxhash64("shard"), F.lit(FIRST_SHARDS)) == 0) == first
        every = of_docs.filter(turn).withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_lots - 1).cast("long"))))
        every = every.join(marks, "lot", "left").select("shard", "lot", "numbers", "counts", "ids", F.expr("cast(null as array<struct<query:bigint,weight:bigint>>)").alias("asked"), "marks")
        return materialise(_searched(pairs.filter(turn).unionByName(every), n_docs, n_words, top), "ranked-found")

    no_marks = lots.select("lot", F.expr("cast(array() as array<struct<query:bigint,score:bigint,id:bigint>>)").alias("marks"))
    # Some shards are searched first; what they give are the marks that the others' documents must beat.
    before = searched(True, no_marks)
    marks = _ranked(before, top).filter(F.col("rank") == top).select(lot, F.struct("query", "score", F.coalesce("doc_id", F.lit(int(NO_ID))).alias("id")).alias("mark"))
    marks = marks.groupBy("lot").agg(F.collect_list("mark").alias("marks"))
    found = before.unionByName(searched(False, marks))
    return _ranked(found, top).join(names.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item against all documents."""
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
SQL = rf"""
WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents),
tf AS (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY 1, 2),
len AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1),
total AS (SELECT (SELECT count(*) FROM len)::BIGINT AS docs, (SELECT count(*) FROM d)::BIGINT AS words),
w AS (SELECT t, floor(1000::DOUBLE * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY t),
m AS (SELECT doc_id, 25 + (75 * n * docs) // words AS m FROM len, total),
q AS (SELECT item_id, {_TERMS} AS t FROM benchmark),
scores AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN tf USING (t) JOIN w USING (t) JOIN m USING (doc_id) GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""
