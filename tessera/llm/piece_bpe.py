"""SentencePiece BPE encoding and decoding with vectorised merge rounds.

The texts of a batch are cut before every space that follows something else (no
piece of the vocabulary crosses such a place, which is checked when a model is
loaded).  The distinct unknown words of a batch become one flat array of symbols.
Each round finds every word's smallest pair rank with a segmented minimum, merges
the pairs of that rank from the left in all words at once and compacts the arrays,
until no pair is left.  Where a merge could make a pair of a smaller rank before the
word's next one is due, only the word's leftmost pair is merged, so the result is
that of merging one pair at a time.  Symbols outside the vocabulary become UTF-8 byte
pieces.

Words already seen by the Python worker are looked up; the table is bounded.  Only models with
identity normalisation, a dummy prefix and byte fallback are accepted.

Defined results: a null or empty text encodes to begin and end ids alone; repeated
rows encode alike, one row each; tied or null ids are carried along; texts of any length are encoded whole; an
empty table gives no rows; columns besides those named are ignored, whatever they are called.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, texts_of

MARK = "▁"
NONE = np.iinfo(np.int32).max
#: Words kept per Python worker, each about 150 bytes.
CACHE_WORDS = 600_000
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _fields(data: bytes):
    """(number, value) of each field of a protobuf message; values stay raw."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return out

    while at < len(data):
        key = varint()
        number, kind = key >> 3, key & 7
        if kind == 0:
            yield number, varint()
        elif kind == 2:
            size = varint()
            yield number, data[at : at + size]
            at += size
        else:
            size = {1: 8, 5: 4}[kind]
            yield number, data[at : at + size]
            at += size


class PieceModel:
    """Vocabulary and merge tables of a SentencePiece BPE model file."""

    #: kinds of pieces in the model file
    NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

    def __init__(self, proto: bytes):
        pieces, kinds, scores = [], [], []
        trainer: dict[int, object] = {}
        normalizer: dict[int, object] = {}
        for number, value in _fields(proto):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append(piece.get(1, b"").decode())
                scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                kinds.append(piece.get(3, self.NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3) != 2 or normalizer.get(2) or not normalizer.get(3, 1) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("only BPE models with identity normalisation, a dummy prefix and kept spaces are supported")
        if self.USER in kinds or self.UNUSED in kinds or kinds.count(self.BYTE) != 256:
            raise ValueError("user-defined or unused pieces, or a model without byte fallback, are not supported")
        self.pieces = pieces
        normal = [i for i, k in enumerate(kinds) if k == self.NORMAL]
        if any(re.search(f"[^{MARK}]{MARK}", pieces[i]) for i in normal):
            raise ValueError("a piece goes on over a space")
        self.bos = kinds.index(self.CONTROL)
        self.eos = kinds.index(self.CONTROL, self.bos + 1)
        first_byte = kinds.index(self.BYTE)
        self.byte_ids = {int(pieces[i][3:5], 16): i for i in range(first_byte, len(kinds)) if kinds[i] == self.BYTE}
        own = {pieces[i]: i for i in normal}
        self.single = {p: i for p, i in own.items() if len(p) == 1}
        # a piece's rank: its place by descending score, equal scores sharing one
        levels = {s: n for n, s in enumerate(sorted({scores[i] for i in normal}, reverse=True))}
        keys, made = [], []
        for p, i in own.items():
            for cut in range(1, len(p)):
                left, right = own.get(p[:cut]), own.get(p[cut:])
                if left is not None and right is not None:
                    keys.append((left << 32) | right)
                    made.append(i)
        order = np.argsort(np.array(keys, np.int64))
        self.pair_keys = np.array(keys, np.int64)[order]
        self.pair_piece = np.array(made, np.int32)[order]
        rank = np.zeros(len(pieces), np.int32)
        for i in normal:
            rank[i] = levels[scores[i]]
        self.rank = rank
        self._size = 1 << int(np.ceil(np.log2(len(keys) * 4)))
        self._table()
        #: bytes that each id stands for; control pieces stand for none
        self.decoded = [
            bytes([int(p[3:5], 16)]) if k == self.BYTE else b"" if k == self.CONTROL else p.replace(MARK, " ").encode() if k == self.NORMAL else b" \xe2\x81\x87 "
            for p, k in zip(pieces, kinds, strict=True)
        ]
        self.is_byte = np.array([k == self.BYTE for k in kinds])
        self._cache: dict[str, bytes] = {}

    # -- pair lookup: open addressing, all lookups of an array at once

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (self._size - 1)

    def _table(self) -> None:
        self._slot_key = np.full(self._size, -1, np.int64)
        self._slot_piece = np.full(self._size, -1, np.int32)
        rest_keys, rest_pieces, at = self.pair_keys, self.pair_piece, self._hash(self.pair_keys)
        self._probes = 0
        while len(rest_keys):
            self._probes += 1
            free = self._slot_key[at] == -1
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            first = first[free[first]]
            self._slot_key[at[first]], self._slot_piece[at[first]] = rest_keys[first], rest_pieces[first]
            left = np.ones(len(at), bool)
            left[first] = False
            rest_keys, rest_pieces, at = rest_keys[left], rest_pieces[left], (at[left] + 1) & (self._size - 1)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece that each pair of symbols makes, or -1."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = self._hash(keys)
        out = np.full(len(keys), -1, np.int32)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        for _ in range(self._probes):
            slot = at[open_]
            found = self._slot_key[slot]
            hit = found == keys[open_]
            out[open_[hit]] = self._slot_piece[slot[hit]]
            open_ = open_[~hit & (found != -1)]
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & (self._size - 1)
        return out

    # -- merge rounds

    def merge_rounds(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the symbols of each word (ids; negative: outside the vocabulary) to the end.

        ``word`` numbers each symbol's word, ascending.  Finished words leave the
        arrays that the next rounds work on.
        """
        done_symbols, done_words = [], []
        made = self._pairs(symbols, word)
        while len(symbols):
            ranks = np.where(made >= 0, self.rank[np.maximum(made, 0)], NONE)
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            lowest = np.minimum.reduceat(ranks, starts)
            spans = np.diff(np.append(starts, len(word)))
            if (lowest == NONE).any():
                finished = np.repeat(lowest == NONE, spans)
                done_symbols.append(symbols[finished])
                done_words.append(word[finished])
                going = ~finished
                symbols, word, made, ranks = symbols[going], word[going], made[going], ranks[going]
                lowest, spans = lowest[lowest != NONE], spans[lowest != NONE]
                if not len(symbols):
                    break
                starts = np.concatenate(([0], np.cumsum(spans)[:-1]))
            due = np.flatnonzero(ranks == np.repeat(lowest, spans))
            pick = self._leftmost(due)
            pick = self._careful(symbols, word, made, pick)
            gone = np.zeros(len(symbols), bool)
            gone[pick + 1] = True
            symbols = symbols.copy()
            symbols[pick] = made[pick]
            place = np.cumsum(~gone) - 1
            keep = ~gone
            symbols, word, made = symbols[keep], word[keep], made[keep]
            # only the merged symbols and their left neighbours stand in new pairs
            fresh = place[pick]
            changed = np.zeros(len(symbols), bool)
            changed[fresh] = True
            changed[fresh[fresh > 0] - 1] = True
            fresh = np.flatnonzero(changed)
            made[fresh] = self._pairs_at(symbols, word, fresh)
        if not done_symbols:
            return symbols, word
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def _pairs(self, symbols: np.ndarray, word: np.ndarray) -> np.ndarray:
        return self._pairs_at(symbols, word, np.arange(len(symbols)))

    def _pairs_at(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.full(len(at), -1, np.int32)
        inner = np.flatnonzero(at + 1 < len(symbols))
        inner = inner[word[at[inner]] == word[at[inner] + 1]]
        out[inner] = self.merged(symbols[at[inner]], symbols[at[inner] + 1])
        return out

    @staticmethod
    def _leftmost(due: np.ndarray) -> np.ndarray:
        """Of places in a row (one apart), every other one from the left."""
        if not len(due):
            return due
        head = np.concatenate(([True], np.diff(due) != 1))
        first = np.maximum.accumulate(np.where(head, np.arange(len(due)), 0))
        return due[(np.arange(len(due)) - first) % 2 == 0]

    def _careful(self, symbols: np.ndarray, word: np.ndarray, made: np.ndarray, pick: np.ndarray) -> np.ndarray:
        """In words where a pick makes a pair of a rank at or below its own, keep the leftmost pick only."""
        if len(pick) < 2 or not (word[pick[1:]] == word[pick[:-1]]).any():
            return pick
        own, piece, n = word[pick], made[pick], len(symbols)
        rank = self.rank[piece]
        before, after = np.maximum(pick - 1, 0), np.minimum(pick + 2, n - 1)
        left = np.where((pick > 0) & (word[before] == own), symbols[before], -1)
        right = np.where((pick + 2 < n) & (word[after] == own), symbols[after], -1)
        follows = np.concatenate((pick[1:] == pick[:-1] + 2, [False]))  # the next pick starts right after
        merged_right = np.where(follows, np.concatenate((piece[1:], [-1])), -1)
        leads = np.concatenate(([False], follows[:-1]))
        merged_left = np.where(leads, np.concatenate(([-1], piece[:-1])), -1)
        risky = np.zeros(len(pick), bool)
        for a, b in ((left, piece), (piece, right), (piece, merged_right), (merged_left, piece)):
            new = self.merged(a, b)
            risky |= (new >= 0) & (self.rank[np.maximum(new, 0)] <= rank)
        if not risky.any():
            return pick
        bad = np.isin(own, own[risky])
        first = np.concatenate(([True], own[1:] != own[:-1]))
        return pick[~bad | first]

    # -- words and texts

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(w) for w in words])
        seen = np.zeros(int(codes.max()) + 1, bool)
        seen[codes] = True
        ids = np.zeros(len(seen), np.int32)
        for c in np.flatnonzero(seen).tolist():
            ids[c] = self.single.get(chr(c), -1 - c)
        symbols = ids[codes]
        symbols, owner = self.merge_rounds(symbols, np.repeat(np.arange(len(words), dtype=np.int32), sizes))
        if (symbols < 0).any():
            symbols, owner = self._bytes_for(symbols, owner)
        data = symbols.astype("<u4").tobytes()
        ends = (np.cumsum(np.bincount(owner, minlength=len(words))) * 4).tolist()
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _bytes_for(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Replace each symbol outside the vocabulary by its UTF-8 byte pieces."""
        outside = np.flatnonzero(symbols < 0)
        pieces = [[self.byte_ids[b] for b in chr(-1 - s).encode("utf-8", "replace")] for s in symbols[outside].tolist()]
        times = np.ones(len(symbols), np.int64)
        times[outside] = [len(x) for x in pieces]
        wide = np.repeat(symbols, times)
        wide[wide < 0] = [i for x in pieces for i in x]
        return wide, np.repeat(owner, times)

    def encode(self, texts: list[str], begin: bool = True, end: bool = True) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        cut = [_WORDS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        cache = self._cache
        unknown = list({w for words in cut for w in words if w not in cache})
        if unknown:
            cache.update(zip(unknown, self.encode_words(unknown), strict=True))
        head = struct.pack("<I", self.bos) if begin else b""
        tail = struct.pack("<I", self.eos) if end else b""
        out = [head + b"".join([cache[w] for w in words]) + tail for words in cut]
        if len(cache) > CACHE_WORDS:  # full: what came first, the frequent words among it, stays
            for w in unknown:
                del cache[w]
        return out

    def decode(self, ids: bytes) -> bytes:
        """Text, in UTF-8, that the ids stand for; the dummy prefix goes."""
        seen = [i for i in np.frombuffer(ids, "<u4").tolist() if i != self.bos and i != self.eos]
        data = b"".join(map(self.decoded.__getitem__, seen))
        if seen and not self.is_byte[seen[0]] and data[:1] == b" ":
            data = data[1:]
        try:
            data.decode()
        except UnicodeDecodeError:
            data = data.decode("utf-8", "replace").encode()
        return data


_MODELS: dict[int, PieceModel] = {}


def model_of(proto: bytes) -> PieceModel:
    """The worker's own copy of a model."""
    key = hash(proto)
    if key not in _MODELS:
        _MODELS[key] = PieceModel(proto)
    return _MODELS[key]


def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(spark: SparkSession, df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded`` (the text they decode to).

    The model file is read by the driver and broadcast (under 1 MB, whatever the input).
    """
    proto = spark.sparkContext.broadcast(read_file(model_path))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = model_of(proto.value)
        ids = model.encode(texts_of(batch.column(1)))
        decoded = pa.array([model.decode(x) for x in ids], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), decoded], ["id", "ids", "decoded"])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_batches(source, run, f"id {source.schema['id'].dataType.simpleString()}, ids binary, decoded string")
