"""SentencePiece encoding and decoding in vectorised merge rounds.

A model's pieces and scores are read once per Python worker. Texts are cut where no piece
can reach across, each distinct word of a lot is encoded once, and all words are merged
together: flat arrays of symbols, the least pair rank in each segment, its leftmost
occurrences merged at once, then compaction, until no pair is left.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Numbers, lots, spans, text_batches

SPACE = "▁"
NEVER = np.iinfo(np.int64).max


class PieceModel:
    """Tables of one BPE model with byte fallback, an identity normaliser and a dummy prefix."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        scores = [sp.get_score(i) for i in range(n)]
        plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        ids = {p: i for i, p in enumerate(pieces) if plain[i]}
        assert not any(SPACE in p.lstrip(SPACE) for p in ids), "a piece has a space after other characters"
        # Characters that occur in pieces without being pieces get ids past the vocabulary's code points.
        self.code_to_symbol = np.arange(0x110000, dtype=np.int64) + n
        for p, i in ids.items():
            if len(p) == 1:
                self.code_to_symbol[ord(p)] = i
        symbol = lambda s: ids.get(s, n + ord(s) if len(s) == 1 else None)
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in ids.values()}, reverse=True))}
        keys, made, ranks, pairs = [], [], [], set()
        for p, i in ids.items():
            pairs.update((ord(a) << 21) | ord(b) for a, b in zip(p, p[1:]))
            for k in range(1, len(p)):
                left, right = symbol(p[:k]), symbol(p[k:])
                if left is not None and right is not None:
                    keys.append((left << 22) | right)
                    made.append(i)
                    ranks.append(order[scores[i]])
        at = np.argsort(np.array(keys, np.int64))
        self.keys, self.made, self.ranks = (np.array(x, np.int64)[at] for x in (keys, made, ranks))
        self.char_pairs = np.array(sorted(pairs), np.int64)
        # After a merge of this rank a pair of the same or a better rank may arise: then one merge at a time.
        least = np.full(len(order), NEVER, np.int64)
        rank_of = np.full(n, -1, np.int64)
        for i in ids.values():
            rank_of[i] = order[scores[i]]
        for side in (self.keys >> 22, self.keys & ((1 << 22) - 1)):
            known = side < n
            np.minimum.at(least, rank_of[side[known]], self.ranks[known])
        self.one_by_one = least <= np.arange(len(order))
        self.isolated_newline = not any("\n" in p for p in ids)
        ends = "\n" if self.isolated_newline else ""
        # Runs of spaces grow from the left to the longest piece of spaces, if all of these tie behind all others.
        most = max(len(p) for p in ids if set(p) == {SPACE})
        tied = {scores[i] for p, i in ids.items() if set(p) == {SPACE}} == {min(scores[i] for i in ids.values())}
        whole = lambda k: self.encode_words([SPACE * k])[0].tolist()
        tied = tied and len(whole(most)) == 1 and all(whole(most + k) == whole(most) + whole(k) for k in range(1, most + 1))
        cut = f"{SPACE}{{{most}}}(?={SPACE})|" if tied and most > 1 else ""
        self.words = re.compile(f"{cut}{SPACE}*[^{SPACE}{ends}]+|{SPACE}+" + (f"|{ends}" if ends else ""))
        as_bytes = [b""] * n
        for i, p in enumerate(pieces):
            as_bytes[i] = p.replace(SPACE, " ").encode() if plain[i] else b" \xe2\x81\x87 " if sp.is_unknown(i) else b""
        for b, i in enumerate(self.byte_ids):
            as_bytes[i] = bytes([b])
        self.is_byte = np.zeros(n, bool)
        self.is_byte[self.byte_ids] = True
        self.visible = np.array([bool(x) for x in as_bytes])
        self.piece_len = np.array([len(x) for x in as_bytes], np.int64)
        self.piece_at = np.cumsum(self.piece_len) - self.piece_len
        self.piece_bytes = np.frombuffer(b"".join(as_bytes), np.uint8)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has. Words hold SPACE for spaces."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        chars = np.fromiter(map(len, words), np.int64, len(words))
        n = len(codes)
        word = np.repeat(np.arange(len(words)), chars)
        new = np.ones(n, bool)
        if n > 1:  # a segment ends where a word does, and where no piece holds the two neighbours
            pair = (codes[:-1] << 21) | codes[1:]
            at = np.minimum(np.searchsorted(self.char_pairs, pair), len(self.char_pairs) - 1)
            new[1:] = (word[1:] != word[:-1]) | (self.char_pairs[at] != pair)
        out = self.code_to_symbol[codes]
        alive = np.ones(n, bool)
        place, sym, seg = np.arange(n), out.copy(), np.cumsum(new) - 1
        while len(sym) > 1:
            rank = np.full(len(sym), NEVER, np.int64)
            made = np.zeros(len(sym), np.int64)
            joint = np.flatnonzero(seg[1:] == seg[:-1])
            key = (sym[joint] << 22) | sym[joint + 1]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            joint, at = joint[hit], at[hit]
            if not len(joint):
                break
            rank[joint], made[joint] = self.ranks[at], self.made[at]
            first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            size = np.diff(np.r_[first, len(sym)])
            least = np.minimum.reduceat(rank, first)
            busy = np.repeat(least < NEVER, size)
            # Finished segments leave the arrays; their symbols stand in `out` already.
            best = np.repeat(least, size)
            chosen = np.flatnonzero(busy & (rank == best))
            run = np.r_[True, (chosen[1:] != chosen[:-1] + 1) | (seg[chosen[1:]] != seg[chosen[:-1]])]
            since = np.arange(len(chosen)) - np.maximum.accumulate(np.where(run, np.arange(len(chosen)), 0))
            leads = np.r_[True, seg[chosen[1:]] != seg[chosen[:-1]]]
            keep = since % 2 == 0
            if self.one_by_one[rank[chosen]].any():
                # Where a merge would make a pair of the same or a better rank beside it, only the first one is safe.
                j = chosen[keep & self.one_by_one[rank[chosen]]]
                merged = np.zeros(len(sym) + 1, bool)
                merged[j + 1] = True
                left = np.where(merged[j - 1], made[j - 2], sym[j - 1])
                has_left, has_right = (j > 0) & (seg[j - 1] == seg[j]), np.r_[seg, -1, -1][j + 2] == seg[j]
                worst = np.minimum(
                    np.where(has_left, self._ranks(left, made[j]), NEVER), np.where(has_right, self._ranks(made[j], np.r_[sym, 0, 0][j + 2]), NEVER)
                )
                slow = np.zeros(int(seg[-1]) + 1, bool)
                slow[seg[j[worst <= rank[j]]]] = True
                keep &= ~slow[seg[chosen]] | leads
            chosen = chosen[keep]
            sym[chosen] = made[chosen]
            out[place[chosen]] = made[chosen]
            alive[place[chosen + 1]] = False
            busy[chosen + 1] = False
            place, sym, seg = place[busy], sym[busy], seg[busy]
        ids, word, codes = out[alive], word[alive], codes[alive]
        strange = np.flatnonzero(ids >= self.n)
        if len(strange):  # characters outside the vocabulary become their bytes
            spelt = {c: self.byte_ids[list(chr(c).encode())] for c in np.unique(codes[strange]).tolist()}
            times = np.ones(len(ids), np.int64)
            times[strange] = [len(spelt[c]) for c in codes[strange].tolist()]
            start = np.cumsum(times) - times
            ids, word = np.repeat(ids, times), np.repeat(word, times)
            ids[spans(times[strange], start[strange])] = np.concatenate([spelt[c] for c in codes[strange].tolist()])
        return ids, np.bincount(word, minlength=len(words))

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 22) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                found = self.words.findall(SPACE + t.replace(" ", SPACE))
                counts[i] = len(found)
                words += found
        if not words:
            return np.zeros(0, np.int64), counts
        seen = Numbers()
        code = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
        ids, size = self.encode_words(list(seen))
        start = np.cumsum(size) - size
        lengths = size[code]
        total = np.r_[0, np.cumsum(lengths)]
        ends = np.cumsum(counts)
        return ids[spans(lengths, start[code])], total[ends] - total[ends - counts]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of the id lists that lie one after another in ids."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.n):
            raise ValueError("an id is outside the vocabulary")
        lengths = self.piece_len[ids]
        flat = self.piece_bytes[spans(lengths, self.piece_at[ids])].tobytes()
        total = np.r_[0, np.cumsum(lengths)]
        ends = np.cumsum(counts)
        out = []
        for a, b in zip((ends - counts).tolist(), ends.tolist()):
            raw = flat[total[a] : total[b]]
            try:
                text = raw.decode()
            except UnicodeDecodeError:
                text = self._mended(ids[a:b])
            shown = a
            while shown < b and not self.visible[ids[shown]]:
                shown += 1
            # The dummy prefix goes; a space that a byte piece spells isn't one.
            if shown < b and text[:1] == " " and not self.is_byte[ids[shown]] and ids[shown] != 0:
                text = text[1:]
            out.append(text)
        return out

    def _mended(self, ids: np.ndarray) -> str:
        """Byte pieces that are no UTF-8 become one replacement character each."""
        out, run = [], b""

        def flush(run: bytes) -> str:
            text, i = "", 0
            while i < len(run):
                for k in (1, 2, 3, 4):
                    try:
                        text += run[i : i + k].decode()
                        i += k
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    text += "�"
                    i += 1
            return text

        for i in ids.tolist():
            piece = self.piece_bytes[self.piece_at[i] : self.piece_at[i] + self.piece_len[i]].tobytes()
            if self.is_byte[i]:
                run += piece
            else:
                out.append(flush(run) + piece.decode())
                run = b""
        return "".join(out) + flush(run)


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def _put(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    keep = [i for i, f in enumerate(batch.schema) if f.name != name]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), values], [*(batch.schema.names[i] for i in keep), name])


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds `out`, the piece ids of the whole text, to every row.

    Null and empty texts get an empty list. Other columns stay as they are, a column named
    like `out` is replaced. Repeated rows are encoded alike; a very long text is cut where no piece
    can reach across and encoded as a whole; an empty table stays one. No shuffle.
    """
    text_batches(df.sparkSession)
    schema = T.StructType([f for f in df.schema if f.name != out] + [T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model(path)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            for a, b in lots(texts):
                ids, counts = tables.encode(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield _put(batch.slice(a, b - a), out, lists)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds `out`, the text that the list of piece ids stands for. Null lists count as empty ones.

    Byte pieces that form no UTF-8 become one U+FFFD each; ids outside the vocabulary raise. Very
    long lists are decoded as a whole, repeated rows alike; an empty table stays one.
    """
    text_batches(df.sparkSession)
    schema = T.StructType([f for f in df.schema if f.name != out] + [T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model(path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(counts)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            step = a = 0
            while a < len(counts):
                b = max(a + 1, int(np.searchsorted(ends, step + 500_000, "right")))
                texts = tables.decode(flat[step : ends[b - 1]], counts[a:b])
                yield _put(batch.slice(a, b - a), out, pa.array(texts, pa.string()))
                a, step = b, int(ends[b - 1])

    return df.mapInArrow(run, schema)


def vocabulary() -> str:
    """Where the public 32k BPE model lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document: encode, then decode the ids. Edge cases: see both."""
    path = path or vocabulary()
    both = decode(encode(docs.select("doc_id", "text"), path), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
