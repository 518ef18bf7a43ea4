"""Near-duplicate detection: ProbMinHash signatures, banding and exact verification.

Every shingle sends arrivals of a Poisson process whose rate is its weight to random
registers; a register keeps its earliest arrival. Shingles stop as soon as their next arrival
is later than all registers'. The share of equal registers estimates the probability Jaccard
similarity. Documents that agree in a band are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import WORD, WordHashes, lots, materialise, mixed, shingled, text_batches

WIDTH, LIKE = 5, 0.8
#: At a similarity of 0.8 all bands differ with a probability of 3e-6 for shingles of equal weight,
#: and of 1.11e-5 at worst, where all shingles that differ weigh 1.1 and all common ones 1.
BANDS, ROWS = 24, 4
#: A shingle weighs 1 and, for its letters, MOST_MORE at most, reached with FULL letters: links are told
#: by numbers of shingles, so that a long token must not outweigh what two texts have in common.
MOST_MORE, FULL = 0.1, 100
#: A set's parity bitmap has so many bits; two bitmaps differ in no more bits than their sets in elements.
BITS = 512
#: Members of a bucket that are compared with all others in the second round.
HUBS = 4096
GOLD = np.uint64(0x9E3779B97F4A7C15)


def probminhash(element: np.ndarray, weight: np.ndarray, text: np.ndarray, n: int, registers: int = BANDS * ROWS) -> np.ndarray:
    """For each of n texts, the element that each register holds (0: none, for a text without elements).

    element: distinct 64-bit hashes, weight: their rates, text: the number of the text that each belongs to.
    """
    first = np.full(n * registers, np.inf)
    holds = np.zeros(n * registers, np.uint64)
    time = np.zeros(len(element))
    done, step = 0, 1
    while len(element):
        r = np.arange(done + 1, done + step + 1, dtype=np.uint64)
        h = mixed(element[:, None] + r[None, :] * GOLD)
        gap = -np.log1p(-(h >> np.uint64(11)).astype(np.float64) * 2.0**-53) / weight[:, None]
        at = time[:, None] + np.cumsum(gap, 1)
        place = text[:, None] * registers + (mixed(h + GOLD) % np.uint64(registers)).astype(np.int64)
        late = first.reshape(n, registers).max(1)
        take = at < late[text][:, None]
        t, p = at[take], place[take]
        np.minimum.at(first, p, t)
        e = np.broadcast_to(element[:, None], at.shape)[take]
        won = t == first[p]
        holds[p[won]] = e[won]
        time = at[:, -1]
        late = first.reshape(n, registers).max(1)
        go = time < late[text]
        element, weight, text, time = element[go], weight[go], text[go], time[go]
        done += step
        step = min(64, step * 2)
    return holds.reshape(n, registers)


class Shingler:
    """Words, shingle sets and their weights of texts."""

    def __init__(self, width: int = WIDTH):
        self.width, self.hashes = width, WordHashes()

    def distinct(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles of a text's words, and the weight of each, from 1 to 1 + MOST_MORE by its number of letters."""
        s = shingled(self.hashes.of(words), self.width)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        w = min(self.width, len(words))
        letters = ends[w - 1 :] - np.r_[0, ends[: len(words) - w]] if len(words) else ends
        found, at = np.unique(s, return_index=True)
        return found, 1 + MOST_MORE * np.minimum(letters[at] / FULL, 1)


def featured(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, registers: bool = False) -> DataFrame:
    """Adds _node (a 128-bit digest of the words, or of the text if it has none), _bands (its bands' hashes), _size and _bits (its shingle set's size and parity bitmap); with registers _held, 16 bits of what each register holds."""
    text_batches(docs.sparkSession)
    fields = [T.StructField("_node", T.BinaryType()), T.StructField("_bands", T.ArrayType(T.LongType())), T.StructField("_size", T.IntegerType()), T.StructField("_bits", T.ArrayType(T.LongType()))]
    schema = T.StructType([*docs.schema, *fields, *([T.StructField("_held", T.ArrayType(T.ShortType()))] if registers else [])])
    names, text = [f.name for f in schema], docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for a, b in lots(texts):
                nodes, parts, weights, per = [], [], [], []
                for t in texts[a:b]:
                    words = WORD.findall((t or "").lower())
                    nodes.append(xxhash.xxh3_128_digest("w" + " ".join(words) if words else "t" + (t or "")))
                    s, w = shingler.distinct(words)
                    parts.append(s)
                    weights.append(w)
                    per.append(len(s))
                n = b - a
                every, of = np.concatenate(parts), np.repeat(np.arange(n), per)
                held = probminhash(every, np.concatenate(weights), of, n, bands * rows)
                odd = np.bincount(of * BITS + (every % np.uint64(BITS)).astype(np.int64), minlength=n * BITS) & 1
                bits = np.packbits(odd.reshape(n, BITS).astype(np.uint8), axis=1).view(np.int64)
                key = np.zeros((n, bands), np.uint64)
                for r in range(rows):
                    key = mixed(key * GOLD + held.reshape(n, bands, rows)[:, :, r])
                key = mixed(key + np.arange(bands, dtype=np.uint64))
                some = np.array(per) > 0
                ends = np.r_[0, np.cumsum(some * bands)].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(key[some].ravel().view(np.int64)))
                bitmaps = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (BITS // 64)), pa.array(bits.ravel()))
                more = []
                if registers:
                    short = pa.array((mixed(held) >> np.uint64(48)).astype(np.uint16).view(np.int16).ravel())
                    more = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (bands * rows)), short)]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, n).columns, pa.array(nodes, pa.binary()), lists, pa.array(per, pa.int32()), bitmaps, *more], names)

    return docs.mapInArrow(run, schema)


def components(links: DataFrame) -> DataFrame:
    """node, label of every node in links (a, b): the least node that it is connected with.

    Labels spread along links and jump to their labels' labels, written to the shared folder each
    time, until none changes.
    """
    both = links.select("a", "b").union(links.select("b", "a")).toDF("node", "near").distinct()
    both = materialise(both, "near-links")
    labels = both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("label"))
    labels = materialise(labels, "near-labels")
    while True:
        spread = both.join(labels.withColumnRenamed("node", "near"), "near").groupBy("node").agg(F.min("label").alias("least"))
        step = labels.join(spread, "node").select("node", "label", F.least("label", "least").alias("next"))
        jump = step.join(step.select(F.col("node").alias("next"), F.col("next").alias("far")), "next")
        jump = materialise(jump.select("node", F.least("next", "far").alias("label"), (F.least("next", "far") != F.col("label")).alias("moved")), "near-labels")
        labels = jump.select("node", "label")
        if not jump.filter("moved").limit(1).count():
            return labels


def verified(pairs: DataFrame, texts: DataFrame, width: int = WIDTH, like: float = LIKE) -> DataFrame:
    """a, b, jaccard of those pairs (a, b) of nodes whose texts' shingle sets have a Jaccard similarity of `like` or more."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(width)
        for f in frames:
            near, share, seen = np.zeros(len(f), bool), np.zeros(len(f)), {}
            for i, texts in enumerate(zip(f["ta"], f["tb"])):
                seen = {t: seen[t] if t in seen else shingler.distinct(WORD.findall(t.lower()))[0] for t in texts}
                a, b = (seen[t] for t in texts)
                common = len(np.intersect1d(a, b, True))
                near[i] = common >= like * (len(a) + len(b) - common)
                share[i] = common / max(len(a) + len(b) - common, 1)
            yield f[["a", "b"]].assign(jaccard=share)[near]

    text_batches(pairs.sparkSession)
    a, b = texts.toDF("a", "ta"), texts.toDF("b", "tb")
    return pairs.select("a", "b").join(a, "a").join(b, "b").mapInPandas(run, "a binary, b binary, jaccard double")


def linked(nodes: DataFrame, texts: DataFrame, width: int = WIDTH, like: float = LIKE) -> tuple[DataFrame, DataFrame]:
    """node, label of all nodes that are alike another one, directly or through others; and the links a, b, jaccard that were found.

    nodes: node, bands, size, bits. In each bucket of equal bands, hubs meet all other members that
    aren't connected with them yet; hubs then leave, and buckets whose members are all connected
    are done. First the most central member of each bucket is the hub, then all others or, of more than
    HUBS, one for each value of a hash, then more, so that no pair of a bucket is left out. Members of the
    bucket's largest part needn't be hubs: all others meet them. Hubs are told by sums alone and
    stored, so that Spark can split the members of a large bucket over several tasks. A pair whose
    bitmaps differ in more bits than the sets may in elements is no link, and isn't emitted.
    """
    held = nodes.select("node", "size", "bits", F.explode("bands").alias("bucket"))
    many = held.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = held.join(many, "bucket").withColumn("label", F.col("node"))
    # Central texts meet others in more buckets: compared first, they connect most of their group at once.
    members = materialise(members, "near-members")
    met = members.groupBy("node").agg(F.sum("n").alias("met"))
    members = materialise(members.drop("n").join(met, "node"), "near-members")
    texts = materialise(texts.join(members.select("node").distinct(), "node").dropDuplicates(["node"]), "near-texts")
    links, labels, tested, hubs = None, None, None, 1
    while True:
        hub = F.struct("node", "label", "size", "bits")
        if hubs == 1:
            lead = members.groupBy("bucket").agg(F.max_by(hub, F.struct("met", "node")).alias("hub"))
        else:
            parts = members.groupBy("bucket", "label").agg(F.count("*").alias("n"))
            large = parts.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("large"), (F.sum("n") - F.max("n")).alias("rest"))
            others = members.join(materialise(large, "near-parts"), "bucket").filter("label <> large")
            salt = F.when(F.col("rest") <= hubs, F.xxhash64("node")).otherwise(F.pmod(F.xxhash64("node"), F.lit(hubs)))
            lead = others.groupBy("bucket", salt.alias("salt")).agg(F.max_by(hub, F.struct("met", "node")).alias("hub"))
        lead = materialise(lead.select("bucket", *(F.col(f"hub.{c}").alias(f"hub_{c}") for c in ("node", "label", "size", "bits"))), "near-hubs")
        apart = sum(F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("hub_bits")[i])) for i in range(BITS // 64))
        alike = apart <= (F.col("size") + F.col("hub_size")) * ((1 - like) / (1 + like)) + 1e-6
        pairs = members.join(lead, "bucket").filter((F.col("label") != F.col("hub_label")) & alike)
        pairs = pairs.select(F.least("node", "hub_node").alias("a"), F.greatest("node", "hub_node").alias("b")).distinct()
        pairs = materialise(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "near-pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = materialise(verified(pairs, texts, width, like), "near-found")
        links = found if links is None else links.unionByName(found)
        labels = components(links)
        left = members.drop("label").join(lead.select("bucket", F.col("hub_node").alias("node")), ["bucket", "node"], "left_anti")
        left = left.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        split = left.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("bucket")
        members = materialise(left.join(split, "bucket").select("bucket", "node", "label", "met", "size", "bits"), "near-members")
        if not members.limit(1).count():
            return labels, links
        hubs = max(HUBS, hubs * 16)


def _nodes(feats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node, first_id, n, bands, size, bits of every distinct text in feats; and their texts."""
    nodes = feats.groupBy(F.col("_node").alias("node")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"), F.first("_bands").alias("bands"), F.first("_size").alias("size"), F.first("_bits").alias("bits"))
    return nodes, feats.select(F.col("_node").alias("node"), F.coalesce("text", F.lit("")).alias("text"))


def _classed(feats: DataFrame, width: int, like: float) -> tuple[DataFrame, DataFrame]:
    """_node, class_id, n_in_class, _kept_node of every distinct text in feats; and the links a, b, jaccard that were found."""
    nodes, texts = _nodes(feats)
    labels, links = linked(nodes.select("node", "bands", "size", "bits"), texts, width, like)
    known = nodes.select("node", "first_id", "n").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    known = materialise(known, "near-classes")
    classes = known.groupBy("label").agg(F.min(F.struct(F.col("first_id").isNull(), "first_id", "node")).alias("kept"), F.sum("n").alias("n_in_class"))
    return known.join(classes, "label").select(F.col("node").alias("_node"), F.col("kept.first_id").alias("class_id"), "n_in_class", F.col("kept.node").alias("_kept_node")), links


def near_pairs(docs: DataFrame, width: int = WIDTH, like: float = LIKE) -> DataFrame:
    """a_id, b_id, jaccard, estimate: the links by which near_duplicates() joins different texts, told by the least id of each.

    jaccard is exact; estimate, the share of equal registers, is that of the probability Jaccard
    similarity of the weighted shingles. Every class of several texts is connected by its links;
    texts that others have connected aren't compared again, so that a class of many texts has about
    as many links as texts. Copies aren't pairs.
    """
    feats = materialise(featured(docs.select("doc_id", "text"), width, registers=True), "near-features")
    nodes, texts = _nodes(feats)
    _, links = linked(nodes.select("node", "bands", "size", "bits"), texts, width, like)
    held = feats.groupBy(F.col("_node").alias("node")).agg(F.min("doc_id").alias("id"), F.first("_held").alias("held"))
    side = lambda x: held.select(F.col("node").alias(x), F.col("id").alias(f"{x}_id"), F.col("held").alias(f"{x}_held"))
    both = links.join(side("a"), "a").join(side("b"), "b")
    equal = F.aggregate(F.zip_with("a_held", "b_held", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return both.select("a_id", "b_id", "jaccard", (equal / F.size("a_held")).alias("estimate"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, like: float = LIKE) -> DataFrame:
    """doc_id, class_id (the least id of the document's class), n_in_class, n_links, most_alike, kept, one row per row of docs.

    Texts with the same words in the same order are copies; null is the empty text. Texts of fewer
    than five words have one shingle, texts without words are alike only to the same text. Repeated
    rows fall into one class; a class of null ids alone has a null class_id. A very long text is one
    row like others, an empty table gives none. n_links counts the other texts that this text was
    found alike with, most_alike is the greatest similarity to one (null: none); they connect each
    class, see near_pairs(). kept marks one row of each class.
    """
    feats = materialise(featured(docs.select("doc_id", "text"), width), "near-features")
    classes, links = _classed(feats, width, like)
    ends = links.select(F.explode(F.array("a", "b")).alias("_node"), "jaccard").groupBy("_node").agg(F.count("*").alias("n_links"), F.max("jaccard").alias("most_alike"))
    rows = feats.select("doc_id", "_node").join(classes.join(ends, "_node", "left"), "_node")
    turn = F.row_number().over(Window.partitionBy("_node", "doc_id").orderBy(F.lit(0)))
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("_node") == F.col("_kept_node")) & (turn == 1)
    return rows.select("doc_id", "class_id", "n_in_class", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "most_alike", kept.alias("kept"))


def deduplicated(docs: DataFrame, width: int = WIDTH, like: float = LIKE) -> DataFrame:
    """docs with one row of each class of near_duplicates(), that with the least id; all columns stay. Nulls, repeated rows, very long texts and empty tables as there."""
    feats = materialise(featured(docs, width), "near-features")
    kept = _classed(feats, width, like)[0].filter(F.col("_node") == F.col("_kept_node")).select("_node", F.col("class_id").alias("_kept_id"))
    one = feats.join(kept, "_node").filter(F.col("doc_id").eqNullSafe(F.col("_kept_id")))
    turn = F.row_number().over(Window.partitionBy("_node").orderBy(F.lit(0)))
    return one.withColumn("_turn", turn).filter("_turn = 1").select(*docs.columns)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
