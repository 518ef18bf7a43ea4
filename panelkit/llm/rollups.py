"""Token counts as delta-maintained rollups by source, language and tokenizer version.

Changes come in batches of signed rows: an insert adds a document's counts, a delete takes
them away, a revision takes the old ones away and adds the new ones. A batch is summed by group
and stored in a folder of its own; a row in the manifest then makes it count. The same id again
points to a new folder, so a batch that is sent twice counts once, and what was committed stays
until the new row is there. Totals are the sums over all batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialise, text_batches, work_dir

KEYS = ("source", "lang", "tokenizer")
#: Versions of the tokenizers, and the public vocabulary files of those that have one.
WORDS, BYTE_BPE = "words-1", "byte_bpe_50k-1"
FILES = {BYTE_BPE: "byte_bpe_50k.tiktoken"}
STATE = "source string, lang string, tokenizer string, docs bigint, tokens bigint"
#: A batch's id, the folder of its sums, the turn in which it was committed, and whether it was folded into another batch's sums.
MANIFEST = "batch string, folder string, turn bigint, folded boolean"


@lru_cache(maxsize=2)
def _encoding(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def counted(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """doc_id, digest (of the text), source, lang, tokenizer, tokens of every row: the tokens of its whole text (null: none).

    WORDS counts runs without white space; other versions count the ids of their vocabulary file.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.sha2(text.cast("binary"), 256).alias("digest"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(tokenizer).alias("tokenizer"), text.alias("text"))
    if tokenizer == WORDS:
        t = F.trim(F.regexp_replace("text", r"\s+", " "))
        return rows.withColumn("tokens", F.when(t == "", 0).otherwise(F.size(F.split(t, " "))).cast("long")).drop("text")
    import public_tokenizers

    file = path or public_tokenizers.path(FILES[tokenizer])
    text_batches(docs.sparkSession)
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(file)
        for batch in batches:
            n = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(5).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(n, pa.int64())], schema.names)

    return rows.mapInArrow(run, schema)


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("long").alias("docs"), "tokens")


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.col("tokens")).alias("tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """The old counts of documents taken away and the new ones added; groups may change."""
    return deletes(old).unionByName(inserts(new))


class Rollup:
    """Totals at `path`, a folder that all machines share: a folder of summed changes for each commit, and the manifest.

    One writer commits at a time; readers may read meanwhile. The manifest has a short row for each commit.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or work_dir(spark, "token-rollup")
        spark.createDataFrame([], MANIFEST).write.mode("ignore").parquet(f"{self.path}/manifest")

    def batches(self) -> list[Row]:
        """The manifest's last row of each batch."""
        last = F.max(F.struct("turn", "folder", "folded")).alias("m")
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest").groupBy("batch").agg(last).select("batch", "m.*").collect()

    def _publish(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Stores a batch of signed rows (KEYS, docs, tokens). The same id again replaces what it held; one that was folded by compacted() is left out, and False returned.

        Any text is an id. Null sources and languages are groups of their own, an empty batch leaves
        nothing to sum. A crash before the end leaves the totals as they were.
        """
        known = self.batches()
        if any(r["batch"] == batch and r["folded"] for r in known):
            return False
        sums = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        folder = uuid.uuid4().hex
        sums.filter("docs <> 0 or tokens <> 0").write.parquet(f"{self.path}/sums/{folder}")
        self._publish([(batch, folder, max([r["turn"] for r in known], default=0) + 1, False)])
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens of all groups that have documents."""
        folders = [f"{self.path}/sums/{r['folder']}" for r in self.batches() if r["folder"]]
        rows = self.spark.read.schema(STATE).parquet(*folders) if folders else self.spark.createDataFrame([], STATE)
        sums = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.filter("docs <> 0 or tokens <> 0")

    def compacted(self, batch: str) -> "Rollup":
        """A rollup that holds the totals as one batch, and the ids of the batches in it: these can't be replaced any more, and count no second time."""
        new = Rollup(self.spark)
        new.commit(batch, self.totals())
        folded = [(r["batch"], None, 0, True) for r in self.batches() if r["batch"] != batch]
        if folded:
            new._publish(folded)
        return new


def copies(counts: DataFrame) -> DataFrame:
    """Signed rows that take away every row whose text another row has, too, but for the first by id (null last), source and language.

    Equal rows are told apart by their number alone: rows of one text, source and language are
    summed before they meet, so that a text of a third of all rows is a few rows.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("source").alias("c"), F.col("lang").alias("d"))
    groups = counts.groupBy("digest", *KEYS).agg(F.count("*").alias("n"), F.max("tokens").alias("each"), F.min(rank).alias("first"))
    groups = groups.withColumn("kept", (F.col("first") == F.min("first").over(Window.partitionBy("digest", "tokenizer"))).cast("long"))
    less = F.col("kept") - F.col("n")
    return groups.filter(less < 0).select(*KEYS, less.alias("docs"), (less * F.col("each")).alias("tokens"))


def token_counts(docs: DataFrame) -> DataFrame:
    """source, lang, tokenizer, docs, tokens of all rows, distinct_docs, distinct_tokens of distinct texts, by way of their changes.

    All rows come in with their words counted, for either tokenizer version; the counts of byte-level
    BPE tokens are then revised. For the distinct texts the totals are compacted and all copies but
    the first are deleted. Every batch is sent twice. Null texts are empty texts, null sources and
    languages are groups of their own, repeated rows are rows and copies; a very long text is counted
    as a whole; an empty table has no groups.
    """
    rollup = Rollup(docs.sparkSession)
    words = materialise(counted(docs, WORDS), "token-counts")
    tokens = materialise(counted(docs, BYTE_BPE), "token-counts")
    guessed = words.withColumn("tokenizer", F.lit(BYTE_BPE))
    batches = {"load": inserts(words).unionByName(inserts(guessed)), "revise": revisions(guessed, tokens)}
    for batch, changes in batches.items():
        rollup.commit(batch, changes)
        rollup.commit(batch, changes)
    distinct = rollup.compacted("all")
    distinct.commit("load", batches["load"])
    for _ in range(2):
        distinct.commit("copies", copies(words).unionByName(copies(tokens)))
    a, b = rollup.totals(), distinct.totals().withColumnsRenamed({"docs": "distinct_docs", "tokens": "distinct_tokens"} | {k: f"_{k}" for k in KEYS})
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEYS))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return a.join(b, same, "left").select(*KEYS, "docs", "tokens", zero("distinct_docs"), zero("distinct_tokens"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
