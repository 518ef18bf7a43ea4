"""Benchmark decontamination by winnowing: documents that hold passages of benchmark items.

Of every SPREAD consecutive hashes of runs of GRAM words the least is a fingerprint, so that equal
passages of WINDOW = GRAM + SPREAD - 1 words always have one in common, wherever they stand.
Fingerprints of documents are joined with those of items; each carries the words around it, by
which a hit is extended to both sides and held against the item word by word, so that hashes only
propose. Hits that reach WINDOW words count. Items of fewer words have one run of all their words,
which is looked for at every place of the documents (winnowing with a spread of one).

Fingerprints of documents that no item has are dropped where they are made, by a bitmap of fixed
size; what is joined are distinct surroundings, so that a passage that very many documents share
is compared once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ByteWords, bitmap, byte_words, marked, materialise, rolled, text_batches

GRAM, SPREAD = 6, 5
WINDOW = GRAM + SPREAD - 1
#: Of a fingerprint: words of the window it stands for, place, hash, its words, those before (nearest first) and after.
PRINT = "size int, place bigint, hash bigint, gram string, before array<string>, after array<string>"
KEYS = ["size", "hash", "gram", "before", "after"]
WORDS = pa.list_(pa.string())


def winnowed(words: ByteWords, gram: int = GRAM, spread: int = SPREAD) -> tuple[np.ndarray, np.ndarray]:
    """Places (number of the first word in all texts) and hashes of the fingerprints of each text."""
    h = rolled(words.hash, gram)
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(h) < spread:
        return none
    ends = np.repeat(words.first[1:], np.diff(words.first))
    n = len(h) - spread + 1
    least = h[:n].copy()
    for i in range(1, spread):
        np.minimum(least, h[i : i + n], out=least)
    least[np.arange(n) + gram + spread - 1 > ends[:n]] = 0  # these windows would reach into the next text
    # A hash is chosen where it is the least of a window that holds it: where no window's least is higher.
    most = np.zeros(len(h), np.uint64)
    for i in range(spread):
        np.maximum(most[i : i + n], least, out=most[i : i + n])
    at = np.flatnonzero((most == h) & (most > 0))
    return at, h[at]


def fingerprints(df: DataFrame, keep: list[str], sizes: list[int], wanted: np.ndarray | None = None) -> DataFrame:
    """For each row of df (keep, text) one row with n_words, and one for each fingerprint with the columns of PRINT.

    Windows of WINDOW words are winnowed; for each of the shorter `sizes`, every run of so many
    words is given. wanted: a bitmap of the hashes that are asked for. Where it is None, df has the
    items: a text shorter than WINDOW gives its one run, and no other text gives short runs.
    """
    spark = df.sparkSession
    text_batches(spark)
    held = spark.sparkContext.broadcast(wanted)

    def found(words: ByteWords) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        table, length = held.value, np.diff(words.first)
        if table is None:
            yield WINDOW, *winnowed(words)
            for n in sorted(set(length[(length > 0) & (length < WINDOW)].tolist())):
                at = words.first[:-1][length == n]
                yield n, at, rolled(words.hash, n)[at]
            return
        for n in (WINDOW, *sizes):
            if n == WINDOW:
                at, h = winnowed(words)
            else:
                h = rolled(words.hash, n)
                at = np.flatnonzero(np.arange(len(h)) + n <= np.repeat(words.first[1:], length)[: len(h)])
                h = h[at]
            hit = marked(table, h)
            yield n, at[hit], h[hit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in byte_words(batch.column(len(keep))):
                row, rest = [np.arange(a, b)], [[None] * (b - a) for _ in range(6)]
                for size, at, h in found(words):
                    gram = GRAM if size == WINDOW else size
                    side = size - gram
                    text = np.searchsorted(words.first, at, "right") - 1
                    row.append(a + text)
                    first, last = np.maximum(words.first[text], at - side), np.minimum(words.first[text + 1], at + gram + side)
                    around = [(words.text(i, j), k - i) for i, j, k in zip(first.tolist(), last.tolist(), at.tolist())]
                    rest[0] += [size] * len(at)
                    rest[1] += (at - words.first[text]).tolist()
                    rest[2] += h.view(np.int64).tolist()
                    rest[3] += [" ".join(w[k : k + gram]) for w, k in around]
                    rest[4] += [w[:k][::-1] for w, k in around]
                    rest[5] += [w[k + gram :] for w, k in around]
                row = np.concatenate(row)
                n_words = pa.array(np.r_[np.diff(words.first), np.zeros(len(row) - (b - a), np.int64)], mask=np.arange(len(row)) >= b - a)
                kept = [batch.column(i).take(pa.array(row)) for i in range(len(keep))]
                columns = [pa.array(x, t) for x, t in zip(rest, (pa.int32(), pa.int64(), pa.int64(), pa.string(), WORDS, WORDS))]
                yield pa.RecordBatch.from_arrays([*kept, n_words, *columns], [*keep, "n_words", "size", "place", "hash", "gram", "before", "after"])

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, "text").mapInArrow(run, f"{kinds}, n_words bigint, {PRINT}")


def _alike(a: Column, b: Column, most: int) -> Column:
    """How many words two lists have in common from their beginning."""
    same = [(F.size(a) >= i) & (F.size(b) >= i) & (F.slice(a, 1, i) == F.slice(b, 1, i)) for i in range(1, most + 1)]
    return sum((x.cast("int") for x in same), F.lit(0))


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """For each document: doc_id, n_words, n_hit, spans (first and past: numbers of hit words, apart, in order), items (ids as text of the items with occurring windows, in order).

    A window is WINDOW consecutive words of an item (item_id, text), or all its words if it has
    fewer; a document's word is hit if it stands in an occurrence of a window. A-Z count as a-z.
    Null and empty texts have no words: such items occur nowhere and such documents are clean.
    Repeated rows of docs each have their row; items with the same id count once, one without
    an id as the empty one. A very long text is looked through as a whole. Other columns aren't read.
    """
    asked = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    asked = materialise(fingerprints(asked, ["item"], []), "leak-items").filter("size is not null")
    sizes = sorted(r["size"] for r in asked.select("size").distinct().collect() if r["size"] < WINDOW)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    prints = materialise(fingerprints(rows, ["row", "doc_id"], sizes, bitmap(asked, "hash")), "leak-documents")
    hits = prints.filter("size is not null")
    theirs = asked.select("item", *(F.col(c).alias(f"_{c}") for c in KEYS)).distinct()
    pairs = hits.select(*KEYS).distinct().join(theirs, (F.col("size") == F.col("_size")) & (F.col("hash") == F.col("_hash")) & (F.col("gram") == F.col("_gram")))
    side = SPREAD - 1
    pairs = pairs.withColumns({"left": _alike(F.col("before"), F.col("_before"), side), "right": _alike(F.col("after"), F.col("_after"), side)})
    gram = F.when(F.col("size") == WINDOW, GRAM).otherwise(F.col("size"))
    pairs = materialise(pairs.filter(F.col("left") + gram + F.col("right") >= F.col("size")).select(*KEYS, "item", "left", "right"), "leak-pairs")
    found = hits.join(pairs, KEYS).select("row", "item", F.struct((F.col("place") - F.col("left")).alias("first"), (F.col("place") + gram + F.col("right")).alias("past")).alias("span"))
    every = prints.filter("size is null").select("row", "doc_id", "n_words", F.lit(None).cast("string").alias("item"), F.lit(None).cast(found.schema["span"].dataType).alias("span"))
    every = every.unionByName(found, allowMissingColumns=True).groupBy("row")
    every = every.agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(F.collect_set("span")).alias("found"), F.array_sort(F.collect_set("item")).alias("items"))
    # Spans that touch become one; in their order, so that only the last one can grow.
    join = F.expr("""aggregate(found, cast(array() as array<struct<first:bigint,past:bigint>>), (a, s) -> if(
        size(a) > 0 and s.first <= element_at(a, -1).past,
        concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).first as first, greatest(element_at(a, -1).past, s.past) as past))),
        concat(a, array(struct(s.first as first, s.past as past)))))""")
    every = every.withColumn("spans", join)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["past"] - s["first"])
    return every.select("doc_id", "n_words", hit.alias("n_hit"), "spans", "items")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against all benchmark items."""
    found = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS size, array_to_string(w[k + 1 : k + least(len(w), {WINDOW})], ' ') AS run FROM (SELECT *, unnest(range(greatest(len(w) - {WINDOW - 1}, 1))) AS k FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, size, k, array_to_string(w[k + 1 : k + size], ' ') AS run FROM (SELECT *, unnest(range(len(w) - size + 1)) AS k FROM d, (SELECT DISTINCT size FROM iw) WHERE len(w) >= size)),
hits AS (SELECT doc_id, item_id, k, size FROM dw JOIN iw USING (size, run)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS k FROM (SELECT DISTINCT doc_id, k, size FROM hits)) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""
