"""Helpers that the corpus operators share: work folders, word hashes, text batches."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of letters, digits and underscores, in lower case.
WORD = re.compile(r"\w+")
#: Texts are handled in lots of about so many characters, so that a task's memory doesn't follow its batch size.
LOT_CHARS = 1_500_000
ROWS_PER_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all machines share (spark.checkpoint.dir). Where that is unset: in a local one for a session on one machine, else ValueError.

    All paths of an application lie in one folder, that of its id, so that it can be removed when the application has ended.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="panelkit-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/panelkit-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession, rows: int = 250) -> None:
    """Holds the batches that go to Python to so many rows, since texts are long. The session keeps the setting: it counts when a result is computed, which may be later."""
    if int(spark.conf.get(ROWS_PER_BATCH)) not in range(1, rows + 1):
        spark.conf.set(ROWS_PER_BATCH, str(rows))


#: Rows that Spark's Parquet reader decodes at once: of whole indexes, some would fill an executor.
ROWS_PER_READ = "spark.sql.parquet.columnarReaderBatchSize"


@contextmanager
def row_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """For jobs run inside: so many rows at most are read and go to Python at once; one, where rows are whole indexes. The session's settings come back."""
    before = {k: spark.conf.get(k) for k in (ROWS_PER_BATCH, ROWS_PER_READ)}
    spark.conf.set(ROWS_PER_BATCH, str(rows))
    spark.conf.set(ROWS_PER_READ, str(min(rows, int(before[ROWS_PER_READ]))))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def held_out(doc_id: Column | str) -> Column:
    """True for rows whose crc32 of the id as text is divisible by 5; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def lots(texts: list, most: int = LOT_CHARS) -> Iterator[tuple[int, int]]:
    """Cuts a list of texts into ranges of about `most` characters; one long text may make a range of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


class Numbers(dict):
    """Numbers distinct keys in the order in which they are asked for."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


class WordHashes(dict):
    """Word -> 64-bit hash of its lower case, kept up to a bound."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.lower())
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingled(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of `width` words; fewer words make one shingle, none make none."""
    if len(h) == 0:
        return h
    width = min(width, len(h))
    n = len(h) - width + 1
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
        out = out ^ (out >> np.uint64(29))
    return mixed(out)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number, and of its inverse, modulo 2 ** 64."""
    base = 0x9E3779B97F4A7C15
    return tuple(np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)]) for x in (base, pow(base, -1, 1 << 64)))


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of exactly `width` words, from running sums: the cost doesn't grow with width."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(1 << max(12, int(len(h)).bit_length()))
    sums = np.r_[np.uint64(0), np.cumsum(mixed(h) * up[: len(h)], dtype=np.uint64)]
    return mixed((sums[width:] - sums[:n]) * down[:n])


def spans(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges starts[i] .. starts[i] + lengths[i]."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


#: Bytes of UTF-8 with A-Z in lower case, and those that belong to words: digits, a-z and all that isn't ASCII.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True
BYTE_VALUES = np.where(IN_WORD, mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.uint64(0))
#: Bytes that are looked through at once, so that they stay in the processor's cache.
LOT_BYTES = 400_000


class ByteWords:
    """The words of some texts, one after another: hash (64 bits), first byte and end in `data`, the lower-cased bytes of all; first: the number of each text's first word, and of all words."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        self.data = LOWER[data]
        inside = IN_WORD[self.data]
        cut = np.zeros(len(data) + 1, bool)  # a text begins or ends here
        cut[0] = True
        cut[ends] = True
        edge = inside[1:] != inside[:-1]
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= edge | cut[1:-1]
        stops[:-1] &= edge | cut[1:-1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.r_[0, np.searchsorted(self.start, ends)]
        if len(self.start):
            up, down = _powers(1 << max(12, int(len(data)).bit_length()))
            self.hash = mixed(np.add.reduceat(BYTE_VALUES[self.data] * up[: len(data)], self.start) * down[self.start])
        else:
            self.hash = np.zeros(0, np.uint64)

    def text(self, a: int, b: int) -> list[str]:
        """Words a to b."""
        return [bytes(self.data[i:j]).decode() for i, j in zip(self.start[a:b].tolist(), self.end[a:b].tolist())]


def byte_words(texts: pa.Array, most: int = LOT_BYTES) -> Iterator[tuple[int, int, ByteWords]]:
    """Ranges of an Arrow array of texts, of about `most` bytes each, with their words; nulls have none. A long text may make a range of its own.

    A word is a run of digits, a-z and code points beyond ASCII, A-Z taken as a-z.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b, ByteWords(data[offsets[a] : offsets[b]], offsets[a + 1 : b + 1] - offsets[a])
        a = b


#: Kinds of code points: in words (WORD), white space, others.
OTHER, IN_WORDS, BLANK = range(3)
#: A word with a capital sigma: its lower case depends on its place in the word.
SIGMA = re.compile(r"\w*Σ\w*")
#: Code points that are looked through at once, so that they stay in the processor's cache.
LOT_CODES = 400_000


@lru_cache(maxsize=1)
def _code_points() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point its kind, and the value that stands for its lower case in hashes of words."""
    every = "".join(map(chr, range(sys.maxunicode + 1)))
    kind = np.full(len(every), OTHER, np.uint8)
    for name, pattern in ((IN_WORDS, WORD), (BLANK, re.compile(r"\s+"))):
        for m in pattern.finditer(every):
            kind[m.start() : m.end()] = name
    lower = np.arange(1, len(every) + 1, dtype=np.uint64)
    for c in np.flatnonzero(kind == IN_WORDS).tolist():
        small = every[c].lower()
        if len(small) == 1:  # only İ becomes two, of which no other word has the second
            lower[c] = ord(small) + 1
    return kind, np.where(kind == IN_WORDS, mixed(lower * np.uint64(0x9E3779B97F4A7C15)), np.uint64(0))


def _lower(word: re.Match) -> str:
    return word.group().lower().replace("i\u0307", "İ")  # as many code points as before


class CodeWords:
    """The words (WORD) of some texts, one after another: hash (64 bits, of the lower case), first code point and end in `codes`, the code points of all texts, each with a line feed after it, of `kind`; base and first: the numbers of each text's first code point and first word, and of all."""

    def __init__(self, texts: list[str], most: int = LOT_CODES):
        kinds, values = _code_points()
        texts = [SIGMA.sub(_lower, t) if "Σ" in t else t for t in texts]
        self.base = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
        self.kind = np.empty(len(self.codes), np.uint8)
        for i in range(0, len(self.codes), most):
            self.kind[i : i + most] = kinds[self.codes[i : i + most]]
        inside = np.r_[False, self.kind == IN_WORDS]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edges[::2], edges[1::2]
        self.first = np.searchsorted(self.start, self.base)
        self.hash = np.empty(len(self.start), np.uint64)
        a = 0
        while a < len(self.start):
            b = max(a + 1, int(np.searchsorted(self.end, self.start[a] + most, "right")))
            lo, hi = int(self.start[a]), int(self.end[b - 1])
            up, down = _powers(1 << max(12, (hi - lo).bit_length()))
            at = self.start[a:b] - lo
            self.hash[a:b] = mixed(np.add.reduceat(values[self.codes[lo:hi]] * up[: hi - lo], at) * down[at])
            a = b

    def text_of(self, words: np.ndarray) -> np.ndarray:
        """The texts' numbers of words, given the words'."""
        return np.searchsorted(self.first, words, "right") - 1


#: A bitmap of hashes has 2 ** MAP_BITS bits, whatever the number of hashes.
MAP_BITS = 25


def bitmap(df: DataFrame, column: str) -> np.ndarray:
    """4 MB in which a bit is set for the leading bits of each hash in the column: what isn't in it isn't in the column. Its size doesn't grow with df."""
    place = F.shiftrightunsigned(F.col(column), 64 - MAP_BITS)
    bits = df.select(F.shiftright(place, 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("bit"))
    words = bits.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (MAP_BITS - 6), np.int64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint8)


def marked(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash's bit is set in a bitmap()."""
    place = (hashes.view(np.uint64) >> np.uint64(64 - MAP_BITS)).astype(np.int64)
    return (table[place >> 3] >> (place & 7).astype(np.uint8)) & np.uint8(1) == 1
