"""Document fingerprints: bottom-k sketches of word shingles, with DataFrame operations only.

A sketch is the sorted array of the k least distinct 40-bit shingle hashes of a text; one
with fewer than k entries holds all of them. Sketches of parts merge into that of the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K, WIDTH, BITS = 256, 5, 40
#: Ids are cut at SPLIT * SPLIT quantiles into pieces of about as many rows; each of these into WITHIN of equal
#: widths, at least LEAST_WIDTH ids wide. Rows without an id are cut by a hash of their text into NULL_PIECES.
SPLIT, WITHIN, LEAST_WIDTH, NULL_PIECES = 16, 256, 1024, 1024


def sketched(df: DataFrame, text: str, out: str, k: int = K, width: int = WIDTH) -> DataFrame:
    """Adds `out`, the sketch of the column `text` (null: empty).

    Words are runs of letters, digits and underscores in lower case. A text of fewer than
    `width` words has one shingle of all its words, a text without words none.
    """
    pieces = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}_]+")
    df = df.withColumn("_w", F.transform(F.array_remove(pieces, ""), lambda w: F.xxhash64(w)))
    at = F.sequence(F.lit(0), F.size("_w") - width)
    run = F.transform(at, lambda i: F.shiftrightunsigned(F.xxhash64(*(F.get(F.col("_w"), i + j) for j in range(width))), 64 - BITS))
    few = F.array(F.shiftrightunsigned(F.xxhash64("_w"), 64 - BITS))
    none = F.array().cast("array<bigint>")
    df = df.withColumn("_h", F.when(F.size("_w") >= width, run).when(F.size("_w") > 0, few).otherwise(none))
    return df.withColumn(out, F.slice(F.array_sort(F.array_distinct("_h")), 1, k)).drop("_w", "_h")


def fingerprint(sketch: Column) -> Column:
    """The sketch as text: its hashes in hexadecimal, in order."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), BITS // 4, "0")), "")


def joined(a: Column, b: Column, k: int = K) -> Column:
    """The part of both sketches together below which each holds all its hashes: their k least, or all if neither is full."""
    both = F.array_sort(F.array_union(a, b))
    return F.when((F.size(a) < k) & (F.size(b) < k), both).otherwise(F.slice(both, 1, k))


def likeness(df: DataFrame, a: str, b: str, out: str, k: int = K) -> DataFrame:
    """Adds the estimated resemblance (Jaccard) of two sketches, 0 to 1. Two empty sketches are alike."""
    df = df.withColumn("_u", joined(F.col(a), F.col(b), k))
    common = F.size(F.array_intersect(F.array_intersect(a, b), F.col("_u"))).cast("double")
    return df.withColumn(out, F.when(F.size("_u") == 0, F.lit(1.0)).otherwise(common / F.size("_u"))).drop("_u")


def distinct_count(sketch: Column, k: int = K) -> Column:
    """The estimated number of distinct shingles: exact for a sketch with fewer than k entries."""
    kth = F.element_at(sketch, k) + 1
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) * float(1 << BITS) / kth)


def containment(resemblance: Column, a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of a's shingles that b has; 1 for an a without shingles."""
    na, nb = distinct_count(a, k), distinct_count(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance * (na + nb) / (1 + resemblance) / na))


def merged(df: DataFrame, keys: list[str], sketch: str = "sketch", k: int = K, salts: int = 64) -> DataFrame:
    """One sketch for each value of keys, of all its rows' texts together.

    The least hashes are kept in `salts` parts of every group before they meet, so that a
    group of a third of all rows is dealt to many tasks. Groups without any hash give an empty sketch.
    """
    names = df.select(*keys).distinct()
    hashes = df.select(*keys, F.explode(sketch).alias("_h")).withColumn("_s", F.pmod(F.xxhash64("_h"), F.lit(salts)))
    least = Window.partitionBy(*keys, "_s").orderBy("_h")
    hashes = hashes.distinct().withColumn("_n", F.row_number().over(least)).filter(F.col("_n") <= k)
    least = Window.partitionBy(*keys).orderBy("_h")
    hashes = hashes.withColumn("_n", F.row_number().over(least)).filter(F.col("_n") <= k)
    found = hashes.groupBy(*keys).agg(F.array_sort(F.collect_list("_h")).alias(sketch))
    same = [names[c].eqNullSafe(found[c]) for c in keys]
    out = names.join(found, same, "left")
    return out.select(*(names[c] for c in keys), F.coalesce(found[sketch], F.array().cast("array<bigint>")).alias(sketch))


def _pieces(docs: DataFrame) -> DataFrame:
    """Adds piece, a number that rises with doc_id (null first), and _hash, a hash of the text that tells rows of one id apart."""
    n = SPLIT * SPLIT
    # Edges are approximate quantiles: they only decide how many rows a piece has. One row of n numbers goes to all tasks.
    edges = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n).alias("_e"), F.min("doc_id").alias("_low"), F.max("doc_id").alias("_high"))
    d = docs.withColumn("_hash", F.xxhash64("text")).join(F.broadcast(edges))
    passed = lambda xs: F.size(F.filter(xs, lambda e: F.col("doc_id") > e))
    # First the group of edges, then the edge in it.
    outer = passed(F.array(*(F.get("_e", F.lit(SPLIT * i - 1)) for i in range(1, SPLIT))))
    d = d.withColumn("_o", outer)
    d = d.withColumn("_at", F.col("_o") * SPLIT + passed(F.slice("_e", F.col("_o") * SPLIT + 1, F.lit(SPLIT - 1))))
    low = F.when(F.col("_at") > 0, F.get("_e", F.col("_at") - 1)).otherwise(F.col("_low"))
    high = F.coalesce(F.get("_e", F.col("_at")), F.col("_high"))
    # In halves, since the distance of two ids may be more than a long holds.
    wide = F.greatest(F.lit(LEAST_WIDTH // 2).cast("double"), (high / 2 - low / 2) / WITHIN)
    inside = F.least(F.lit(WITHIN - 1), F.greatest(F.lit(0), F.floor((F.col("doc_id") / 2 - low / 2) / wide)))
    piece = F.when(F.col("doc_id").isNull(), F.shiftright("_hash", 64 - NULL_PIECES.bit_length() + 1) - NULL_PIECES).otherwise(F.col("_at").cast("long") * WITHIN + inside)
    return d.select("doc_id", "text", "_hash", piece.cast("long").alias("piece"))


def beside_next(docs: DataFrame) -> DataFrame:
    """doc_id, text of every row, and the same of the row that follows by doc_id as next_text; the first follows the last.

    Ids are cut into pieces, one window for each; a copy of a piece's first row ends the piece before
    it. Null ids come first; rows with the same id, and those without one, follow each other by a
    hash of their text. The pieces' first rows are sent to all tasks: at most SPLIT * SPLIT * WITHIN + NULL_PIECES short rows.
    """
    docs = _pieces(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    rank = F.struct(F.col("doc_id").isNotNull().alias("a"), F.col("doc_id").alias("b"), F.col("_hash").alias("c"))
    firsts = docs.groupBy("piece").agg(F.min(rank).alias("first"))
    order, all_rows = Window.orderBy("piece"), Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("piece", "first", F.coalesce(F.lag("piece").over(order), F.last("piece").over(all_rows)).alias("ends"))
    d = docs.join(F.broadcast(firsts), "piece")
    own, copy = F.struct(F.col("piece"), F.lit(False).alias("copy")), F.struct(F.col("ends").alias("piece"), F.lit(True).alias("copy"))
    d = d.select("doc_id", "text", "_hash", F.explode(F.when(rank == F.col("first"), F.array(own, copy)).otherwise(F.array(own))).alias("at"))
    d = d.select("doc_id", "text", "_hash", "at.piece", "at.copy")
    return d.withColumn("next_text", F.lead("text").over(_row_order()))


def _row_order() -> Window:
    return Window.partitionBy("piece").orderBy("copy", "doc_id", "_hash", "text")


def fingerprints(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and how like they and the next document's are.

    The edited text has its last floor(n / 2) code points replaced by the first as many, or all,
    of the next document's. Null texts are empty, equal texts have equal fingerprints, an empty
    table gives no rows. A very long text is hashed as a whole, in one row; repeated rows follow each
    other. Other columns aren't read.
    """
    d = sketched(beside_next(docs), "text", "sketch", k, width)
    d = d.withColumn("next_sketch", F.lead("sketch").over(_row_order())).filter(~F.col("copy"))
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    d = d.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    d = sketched(d, "edited", "edited_sketch", k, width)
    d = likeness(likeness(d, "sketch", "edited_sketch", "near_edited", k), "sketch", "next_sketch", "near_next", k)
    return d.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        containment(F.col("near_edited"), F.col("sketch"), F.col("edited_sketch"), k).alias("kept_in_edited"),
        distinct_count(F.col("sketch"), k).alias("n_shingles"),
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
