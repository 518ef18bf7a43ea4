"""Mixing sources to target weights, with DataFrame operations only.

Each source's words, laid end to end, are packed into blocks of a fixed length. A source takes
as many slots as its target asks for. For every output shard the number of slots of each source
is drawn, multinomially with the sources' totals given; a shard's slots of a source follow those
of the shards before it. A slot's number is mapped through a pseudorandom permutation of its
source's block numbers (one per pass over the source), and slots and blocks are joined by that
number. The last slot of a source holds a part of its block, so that targets are met to the word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialise

BLOCK_WORDS, SHARD_SLOTS, SEED, ROUNDS = 128, 1024, 17, 12
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: A source's documents are laid end to end in so many parts, whose lengths are summed first.
PARTS_HEX = 3
#: Slots that one row stands for until it is dealt to a task of its own.
RUN = 4096


def words(text: Column) -> Column:
    """The runs of characters other than space and U+0009 to U+000D, as an array; null: empty."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "[ \\x09-\\x0D]+"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target, from rows of source and size.

    The share of all words is dealt out by weight; a source stops at `most` times its size and
    the excess is dealt out again. With the sources in the order of size by weight, that is the
    first level at which the next source isn't full. One row per source; sources are few against
    documents, so ordering them in one task is meant.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
    s = s.withColumn("full", (most * F.col("source_size")).cast("double")).withColumn("ratio", F.col("full") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("level", (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    s = s.withColumn("at", F.row_number().over(order))
    s = s.withColumn("stop", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("at", "level"))).over(everything))
    return s.select("source", "source_size", F.when(F.col("at") < F.col("stop.at"), F.col("full")).otherwise(F.col("weight") * F.col("stop.level")).alias("target"))


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _number(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


def round_keys(n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(rounds)), lambda r: _number(F.concat_ws("|", key, r), 12) % n)


def _swapped(x: Column, n: Column, name: Column, keys: Column, back: bool = False) -> Column:
    """permuted() with its round keys at hand; back: the inverse, since every round undoes itself."""
    rounds = F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("r")))

    def swap(at: Column, r: Column) -> Column:
        other = F.pmod(r["k"] - at, n)
        return F.when(F.substring(F.md5(F.concat_ws("|", name, r["r"], F.greatest(at, other)).cast("binary")), 1, 1) < "8", other).otherwise(at)

    return F.aggregate(F.reverse(rounds) if back else rounds, x, swap)


def permuted(x: Column, n: Column, key: Column) -> Column:
    """Swap-or-not: a keyed permutation of 0 .. n - 1, whatever n is."""
    return _swapped(x, n, key, round_keys(n, key))


def _mark(doc_id: Column, text: Column) -> Column:
    """What stands in for a missing id: a digest of the text, so that rows without an id fall into all parts of their source."""
    return F.when(doc_id.isNull(), F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 12))


def laid_out(sizes: DataFrame) -> DataFrame:
    """Adds key (of the source) and start (the document's place in its source's words). Needs doc_id, mark (of _mark), source, size."""
    spread = F.coalesce(F.col("doc_id").cast("string"), F.col("mark"))
    df = sizes.withColumn("key", _source_key(F.col("source"))).withColumn("part", F.substring(F.md5(spread.cast("binary")), 1, PARTS_HEX))
    parts = df.groupBy("key", "part").agg(F.sum("size").alias("words"))
    base = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("key", "part", F.coalesce(F.sum("words").over(base), F.lit(0)).alias("base"))
    inside = Window.partitionBy("key", "part").orderBy("doc_id", "size", "mark").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return df.join(parts, ["key", "part"]).withColumn("start", F.col("base") + F.col("inside")).drop("part", "mark", "base", "inside")


def blocks(laid: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each document and block that share words: block, and the words' range first .. last in the document."""
    b, end = F.lit(block_words), F.col("start") + F.col("size")
    df = laid.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((end - 1) / b))))
    return df.withColumn("first", F.greatest(F.col("block") * b, F.col("start")) - F.col("start")).withColumn("last", F.least((F.col("block") + 1) * b, end) - F.col("start"))


def passes(plan: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """key, pass, n (blocks), name, keys (of the pass's permutation), room (words, where every slot counts as full), slots: a row for each pass over a source.

    A whole pass takes all blocks; the last one stops at the target. The source's last block may be
    short: where it comes before the end, its slot leaves as many words open.
    """
    b = F.lit(block_words)
    p = plan.filter("source_size > 0").withColumn("key", _source_key(F.col("source"))).withColumn("n", F.ceil(F.col("source_size") / b))
    p = p.withColumn("words", F.least(F.round("target").cast("long"), MOST * F.col("source_size"))).filter("words > 0")
    p = p.withColumn("pass", F.explode(F.sequence(F.lit(0), F.floor((F.col("words") - 1) / F.col("source_size")).cast("int"))))
    p = p.withColumn("words", F.least("source_size", F.col("words") - F.col("pass") * F.col("source_size")))
    name = F.concat_ws("|", F.lit(seed), F.col("key"), F.col("pass"))
    p = p.withColumn("name", name).withColumn("keys", round_keys(F.col("n"), name))
    p = p.withColumn("at", _swapped(F.col("n") - 1, F.col("n"), F.col("name"), F.col("keys"), True))
    p = p.withColumn("short", F.col("source_size") - (F.col("n") - 1) * b)
    room = F.when(F.col("words") <= F.col("at") * b + F.col("short"), F.col("words")).otherwise(F.col("words") + b - F.col("short"))
    return p.withColumn("room", room).select("key", "pass", "n", "name", "keys", "room", F.ceil(F.col("room") / b).alias("slots"))


def shard_counts(each: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """key, n, shard, first, count: how many slots of each source an output shard draws, and the number of the first of them, from the rows of passes()."""
    p = each.groupBy("key", "n").agg(F.sum("slots").alias("slots"))
    p = p.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.sum("slots").over(Window.partitionBy()) / shard_slots)))
    p = p.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("slots") - 1) / RUN).cast("long"))))
    # A given number of partitions: the rows are small, but each stands for RUN draws.
    tasks = int(each.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = p.repartition(tasks, "key", "run").withColumn("draw", F.explode(F.sequence(F.col("run") * RUN, F.least((F.col("run") + 1) * RUN, F.col("slots")) - 1)))
    drawn = _number(F.concat_ws("|", F.lit("shard"), F.lit(seed), "key", "draw"), 8) % F.col("shards")
    c = materialise(p.groupBy("key", "n", drawn.alias("shard")).agg(F.count("*").alias("count")).withColumn("part", F.floor(F.col("shard") / 1024)), "mix-shards")
    parts = c.groupBy("key", "part").agg(F.sum("count").alias("sum"))
    before = lambda *by: Window.partitionBy("key", *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("key", "part", F.coalesce(F.sum("sum").over(before("part")), F.lit(0)).alias("base"))
    c = c.withColumn("inside", F.coalesce(F.sum("count").over(before("part", "shard")), F.lit(0)))
    return c.join(parts, ["key", "part"]).select("key", "n", "shard", (F.col("base") + F.col("inside")).alias("first"), "count")


def slots(plan: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """key, shard, slot, pass (0, 1, ...), block and room (its words that are taken, from the first on) of every slot of the mix, from the rows of targets()."""
    each = materialise(passes(plan, block_words, seed), "mix-passes")
    counts = shard_counts(each, shard_slots, seed)
    tasks = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = counts.repartition(tasks, "key", "shard").withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)))
    s = s.withColumn("pass", F.floor(F.col("slot") / F.col("n")).cast("int"))
    # One row for each pass over a source: Spark sends them to all tasks only where the stored table is small.
    s = s.join(each.drop("n", "slots"), ["key", "pass"]).withColumn("place", F.col("slot") % F.col("n"))
    room = F.least(F.lit(block_words).cast("long"), F.col("room") - F.col("place") * block_words)
    return s.select("key", "shard", "slot", "pass", _swapped(F.col("place"), F.col("n"), F.col("name"), F.col("keys")).alias("block"), room.alias("room"))


def mix(docs: DataFrame, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents' sizes and places, the sources' targets, and the slots of the mix.

    Null texts and texts without words have size 0 and are never drawn; a null source is a
    source of its own; repeated rows lie one after another; a very long text is many blocks. An
    empty table gives empty results. Rows without an id are laid out by a digest of their text.
    Texts are read once: what follows works on ids, sources and sizes, and columns to keep.
    """
    mark = _mark(F.col("doc_id"), F.col("text")).alias("mark")
    sizes = materialise(docs.select("doc_id", mark, "source", F.size(words(F.col("text"))).cast("long").alias("size"), *(keep or [])), "mix-sizes")
    plan = materialise(targets(sizes), "mix-targets")
    return laid_out(sizes), plan, slots(plan)


def _drawn_words(block_words: int = BLOCK_WORDS) -> Column:
    """The end, in the document's words, of what a slot takes of a part of a block."""
    return F.greatest("first", F.least("last", F.col("block") * block_words + F.col("room") - F.col("start")))


def taken(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words of the document in the mix, repeats counted), n_shards and first_shard (output shards that take them) of every document.

    The words taken of a source are its target, rounded. Ties: documents of one id lie in the order of their sizes.
    """
    laid, plan, drawn = mix(docs)
    # Neither side is sent whole to all tasks: both grow with the documents.
    parts = blocks(laid).join(drawn.select("key", "block", "shard", "room").hint("merge"), ["key", "block"])
    got = parts.withColumn("words", _drawn_words() - F.col("first")).filter("words > 0").groupBy("key", "start", "doc_id", "size", "shard").agg(F.sum("words").alias("words"))
    got = got.groupBy("key", "start", "doc_id", "size").agg(F.sum("words").alias("taken"), F.count("*").alias("n_shards"), F.min("shard").alias("first_shard"))
    rest = laid.select("key", "start", "doc_id", "size", F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("n_shards"), F.lit(None).cast("long").alias("first_shard"), F.lit(1).alias("copies"))
    # Documents without words share their start with the next one: they are told apart by their size, and counted.
    every = rest.unionByName(got.withColumn("copies", F.lit(0))).groupBy("key", "start", "doc_id", "size").agg(F.max("taken").alias("taken"), F.max("n_shards").alias("n_shards"), F.max("first_shard").alias("first_shard"), F.sum("copies").cast("int").alias("copies"))
    every = every.withColumn("_", F.explode(F.sequence(F.lit(1), "copies")))
    plan = plan.select(_source_key(F.col("source")).alias("key"), "source_size", "target")
    return every.join(plan, "key").select("doc_id", "size", "source_size", "target", "taken", "n_shards", "first_shard")


ROW = ["_id", "_key", "_hash", "_turn"]


def _numbered(docs: DataFrame) -> DataFrame:
    """Adds _id, _key and _hash, and _turn, which numbers rows that are equal in these."""
    d = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).withColumn("_key", _source_key(F.col("source"))).withColumn("_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    return d.withColumn("_turn", F.row_number().over(Window.partitionBy(*ROW[:3]).orderBy(F.lit(0))))


def _parts(docs: DataFrame) -> DataFrame:
    """ROW, size, first, last (words of the document), start, shard, slot, pass of everything that a slot takes of a document."""
    plain = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).withColumn("_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    laid, _, drawn = mix(plain, ["_id", "_hash"])
    laid = laid.filter("size > 0").withColumn("_turn", F.row_number().over(Window.partitionBy("_id", "key", "_hash").orderBy("start")))
    parts = blocks(laid).join(drawn.hint("merge"), ["key", "block"]).withColumn("last", _drawn_words()).filter("last > first")
    return parts.select("_id", F.col("key").alias("_key"), "_hash", "_turn", "size", "first", "last", "start", "shard", "slot", "pass")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: one row for each document and pass with the words that were drawn.

    Where all words of a document were drawn its text stays as it is; otherwise the drawn
    ranges of words are joined by spaces. Documents without words aren't drawn. Columns stay, for
    rows that repeat id, source and text, too. docs is read twice, its texts are shuffled once:
    give a stored table.
    """
    names = docs.columns
    ranges = _parts(docs).groupBy(*ROW, "size", "pass").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("_ranges"), F.sum(F.col("last") - F.col("first")).alias("_drawn"))
    ranges = ranges.select(*ROW, F.col("size").alias("_size"), "_ranges", "_drawn")
    cut = F.array_join(F.flatten(F.transform("_ranges", lambda r: F.slice(words(F.col("text")), (r["first"] + 1).cast("int"), (r["last"] - r["first"]).cast("int")))), " ")
    out = {c: F.col(c) for c in names} | {"text": F.when(F.col("_drawn") == F.col("_size"), F.col("text")).otherwise(cut)}
    j = _numbered(docs).join(ranges.hint("merge"), ROW).select(*(v.alias(c) for c, v in out.items()))
    return j.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else j


def mixed_blocks(docs: DataFrame) -> DataFrame:
    """The mix as it is packed: shard, source, slot, text (a block's words, joined by spaces), one row for each slot of each output shard."""
    ranges = _parts(docs).groupBy(*ROW).agg(F.collect_list(F.struct("shard", "slot", "start", "first", "last")).alias("_ranges"))
    rows = _numbered(docs.select("doc_id", "source", "text")).join(ranges.hint("merge"), ROW)
    rows = rows.withColumn("_words", words(F.col("text"))).select("source", "_words", F.explode("_ranges").alias("r"))
    piece = F.array_join(F.slice("_words", (F.col("r.first") + 1).cast("int"), (F.col("r.last") - F.col("r.first")).cast("int")), " ")
    rows = rows.select("source", "r.shard", "r.slot", (F.col("r.start") + F.col("r.first")).alias("at"), piece.alias("piece"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), " ")
    return rows.groupBy("shard", "source", "slot").agg(text.alias("text"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
WITH docs AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS key, substr(md5(coalesce(doc_id::VARCHAR, substr(md5(coalesce(text, '')), 1, 12))), 1, {PARTS_HEX}) AS part,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
sources AS (SELECT source, key, sum(size)::BIGINT AS source_size FROM docs GROUP BY 1, 2),
weighted AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS full_size FROM sources),
ranked AS (
  SELECT *, full_size / weight AS ratio, row_number() OVER o AS pos,
         (1.5::DOUBLE * (SELECT sum(size) FROM docs)::DOUBLE - coalesce(sum(full_size) OVER (ORDER BY full_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (ORDER BY full_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM weighted WINDOW o AS (ORDER BY full_size / weight, source NULLS LAST)),
stop AS (SELECT min(pos) AS pos, arg_min(lvl, pos) AS lvl FROM ranked WHERE lvl <= ratio),
plan AS (
  SELECT key, source_size, CASE WHEN r.pos < stop.pos THEN full_size ELSE weight * stop.lvl END AS target,
         ceil(source_size / {BLOCK_WORDS}.0::DOUBLE)::BIGINT AS n FROM ranked r, stop),
wanted AS (SELECT *, least(round(target)::BIGINT, 2 * source_size) AS words FROM plan WHERE source_size > 0),
passes AS (
  SELECT key, n, pass, '{SEED}|' || key || '|' || pass AS name, least(source_size, words - pass * source_size) AS words, source_size - (n - 1) * {BLOCK_WORDS} AS short
  FROM (SELECT *, unnest(range(0, (words - 1) // source_size + 1)) AS pass FROM wanted WHERE words > 0)),
placed AS (
  SELECT *, list_reduce(list_reverse(range(0, {ROUNDS})), lambda x, r:
      CASE WHEN substr(md5(name || '|' || r || '|' || greatest(x, ((('0x' || substr(md5(name || '|' || (r + 1)), 1, 12))::BIGINT % n - x) % n + n) % n)), 1, 1) < '8'
           THEN ((('0x' || substr(md5(name || '|' || (r + 1)), 1, 12))::BIGINT % n - x) % n + n) % n ELSE x END, n - 1) AS last_at FROM passes),
roomy AS (SELECT *, CASE WHEN words <= last_at * {BLOCK_WORDS} + short THEN words ELSE words + {BLOCK_WORDS} - short END AS room FROM placed),
counted AS (SELECT key, sum((room + {BLOCK_WORDS - 1}) // {BLOCK_WORDS})::BIGINT AS slots, any_value(n) AS n FROM roomy GROUP BY 1),
draws AS (SELECT key, greatest(1, ceil((SELECT sum(slots) FROM counted) / {SHARD_SLOTS}::DOUBLE))::BIGINT AS shards, unnest(range(0, slots)) AS draw FROM counted),
shard_counts AS (SELECT key, ('0x' || substr(md5('shard|{SEED}|' || key || '|' || draw), 1, 8))::BIGINT % shards AS shard, count(*)::BIGINT AS c FROM draws GROUP BY 1, 2),
offsets AS (SELECT key, shard, c, (sum(c) OVER (PARTITION BY key ORDER BY shard))::BIGINT - c AS first FROM shard_counts),
slots AS (SELECT key, shard, n, slot, slot // n AS pass, slot % n AS place FROM (SELECT key, shard, unnest(range(first, first + c)) AS slot FROM offsets) JOIN counted USING (key)),
drawn AS (
  SELECT s.key, shard, least({BLOCK_WORDS}, room - place * {BLOCK_WORDS}) AS room, list_reduce(range(0, {ROUNDS}), lambda x, r:
      CASE WHEN substr(md5(name || '|' || r || '|' || greatest(x, ((('0x' || substr(md5(name || '|' || (r + 1)), 1, 12))::BIGINT % s.n - x) % s.n + s.n) % s.n)), 1, 1) < '8'
           THEN ((('0x' || substr(md5(name || '|' || (r + 1)), 1, 12))::BIGINT % s.n - x) % s.n + s.n) % s.n ELSE x END, place) AS block
  FROM slots s JOIN roomy p ON p.key = s.key AND p.pass = s.pass),
laid AS (
  SELECT *, row_number() OVER () AS rid, coalesce(sum(size) OVER (PARTITION BY key ORDER BY part, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM docs),
pieces AS (SELECT rid, key, size, start, unnest(range(start // {BLOCK_WORDS}, (start + size - 1) // {BLOCK_WORDS} + 1)) AS block FROM laid WHERE size > 0),
got AS (
  SELECT rid, shard, least((block + 1) * {BLOCK_WORDS}, start + size, block * {BLOCK_WORDS} + room) - greatest(block * {BLOCK_WORDS}, start) AS w FROM pieces JOIN drawn USING (key, block)),
sums AS (SELECT rid, sum(w)::BIGINT AS taken, count(DISTINCT shard) AS n_shards, min(shard) AS first_shard FROM got WHERE w > 0 GROUP BY 1)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, coalesce(n_shards, 0)::BIGINT AS n_shards, first_shard
FROM laid JOIN plan USING (key) LEFT JOIN sums USING (rid)
"""
