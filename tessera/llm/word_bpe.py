"""Byte-pair encoding with word ends: token counts, and identifiers for packing.

Text is treated as the tokenizer file says: special strings are cut out first and
count one each; the rest is put in NFC, white space collapses, letters are
lower-cased one by one, and the file's pattern cuts it into words whose UTF-8 bytes are
the first symbols.  A word's count comes from a heap of its adjacent pairs over a
linked list of its symbols: the pair of the lowest rank (the leftmost of equals) is
popped and merged until no ranked pair is left; the count is the number of first symbols minus
the number of merges.  No identifier is made on that path.

NFC, the case and the pattern never reach over white space.  For counts a whole text is
normalised and cut at once (by ``re`` where its characters are below U+0100), and the Python worker
remembers counts of words: the heap runs for words not met lately.  For
identifiers runs without white space are worked on apart and remembered.  Both tables are bounded.

Defined results: a null or empty text has no tokens; white space alone has none;
texts of any length are read whole; repeated rows give repeated rows, tied or null ids are
carried along; an empty table gives no rows; columns besides those named are ignored, whatever
they are called.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, texts_of
from .piece_bpe import read_file

#: Runs without white space kept per Python worker, each about 150 bytes.
CACHE_RUNS = 600_000
#: Counts of words kept per Python worker, each about 130 bytes; a word longer than that is never kept.
CACHE_WORDS, CACHE_LENGTH = 1_200_000, 64
#: Cut by str.split but not white space for the tokenizer's pattern.
_ODD_SPACES = regex.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"\s+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(free)
            free += 1
    return out


def narrow(pattern: str) -> re.Pattern | None:
    """``pattern`` for texts of characters below U+0100, for ``re``; None where that can't be told.

    Letters, numbers and white space are spelt out as ``regex`` knows them; only plain strings and
    sets of these three are taken.
    """
    part = r"(?:['a-z]+|\[\^?(?:\\p\{[LN]\}|\\s)+\]\+?)"
    if not re.fullmatch(rf"{part}(?:\|{part})*", pattern):
        return None
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        pattern = pattern.replace(name, "".join(f"\\x{n:02x}" for n in range(256) if regex.match(name, chr(n))))
    return re.compile(pattern)


class Recent(dict):
    """Values of a function of a word, for the last words asked for: ``limit`` at most, half of it at least."""

    def __init__(self, of: Callable[[str], int], limit: int):
        super().__init__()
        self.of, self.half, self.before = of, max(1, limit // 2), {}

    def __missing__(self, word: str) -> int:
        value = self.before.get(word)
        if value is None:
            value = self.of(word)
            if len(word) > CACHE_LENGTH:
                return value
        if len(self) >= self.half:
            self.before = self.copy()
            self.clear()
        self[word] = value
        return value


class WordModel:
    """The tables of a word-end BPE tokenizer file."""

    def __init__(self, data: bytes):
        self.data = data
        spec = json.loads(data)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or kinds != ["NFC", "Replace", "Lowercase"] or not split["invert"]:
            raise ValueError("not a lower-casing BPE tokenizer with word ends")
        added = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens with options are not supported")
        self.added = {t["content"]: t["id"] for t in added}
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if added else None
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self._narrow = narrow(split["pattern"]["Regex"])
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        self.letters = byte_letters()
        self.first = [self.vocab[x] for x in self.letters]
        self.last = [self.vocab[x + self.end] for x in self.letters]
        #: pair of symbols -> (rank, symbol made), both in one integer
        self.merges: dict[int, int] = {}
        for rank, (a, b) in enumerate(tuple(m.split(" ")) if isinstance(m, str) else m for m in model["merges"]):
            self.merges.setdefault(self.vocab[a] << 20 | self.vocab[b], rank << 20 | self.vocab[a + b])
        # a text without the first character of every special string has none of them
        self._openers = sorted({t[0] for t in self.added})
        self._counts = Recent(self.count, CACHE_WORDS)
        self._ids: dict[str, bytes] = {}
        self._tokenizer = None
        self._byte = {x: b for b, x in enumerate(self.letters)}

    @property
    def library(self):
        """The tokenizers library's own object, made on first use."""
        if self._tokenizer is None:
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_str(self.data.decode())
        return self._tokenizer

    # -- words

    def words(self, run: str) -> list[str]:
        """Words of a run without white space, after normalisation."""
        if not run.isascii():
            if any(unicodedata.category(c) == "Cn" for c in run):
                # characters that Python's Unicode tables lack may be known to the library's
                pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(run))
                return [bytes([self._byte[x] for x in piece]).decode("utf-8", "replace") for piece, _ in pieces]
            run = unicodedata.normalize("NFC", run)
            # letter by letter: a capital sigma has one small form wherever it stands
            run = run.replace("Σ", "σ").lower()
        else:
            run = run.lower()
        return self.pattern.findall(run)

    def all_words(self, text: str) -> list[str]:
        """Words of a whole text, after normalisation; those with characters that Python's tables lack come last."""
        if text.isascii():
            return (self._narrow or self.pattern).findall(text.lower())
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            unknown = {c for c in set(text) if unicodedata.category(c) == "Cn"}
            last = []
            if unknown:
                runs = self._runs(text)
                last = [w for run in runs if not unknown.isdisjoint(run) for w in self.words(run)]
                text = " ".join([run for run in runs if unknown.isdisjoint(run)])
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
            return self.pattern.findall(text) + last
        # in NFC already, and so are the small letters, which are below U+0100 too
        return (self._narrow or self.pattern).findall(text.lower())

    def count(self, word: str) -> int:
        """Tokens of one word: its bytes minus the merges made."""
        data = word.encode("utf-8", "replace")
        n = len(data)
        merges, first = self.merges, self.first
        symbols = [first[b] for b in data]
        symbols[-1] = self.last[data[-1]]
        heap = []
        for i in range(n - 1):
            made = merges.get(symbols[i] << 20 | symbols[i + 1])
            if made is not None:
                heap.append((made >> 20, i, made & 0xFFFFF, symbols[i], symbols[i + 1]))
        if not heap:
            return n
        heapify(heap)
        following = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        merged = 0
        while heap:
            _, i, made, left, right = heappop(heap)
            j = following[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # one side has been merged meanwhile
            merged += 1
            symbols[i], symbols[j] = made, -1
            after = following[i] = following[j]
            if after < n:
                before[after] = i
                new = merges.get(made << 20 | symbols[after])
                if new is not None:
                    heappush(heap, (new >> 20, i, new & 0xFFFFF, made, symbols[after]))
            h = before[i]
            if h >= 0:
                new = merges.get(symbols[h] << 20 | made)
                if new is not None:
                    heappush(heap, (new >> 20, h, new & 0xFFFFF, symbols[h], made))
        return n - merged

    def word_ids(self, word: str) -> list[int]:
        """Identifiers of one word, by the tokenizers library's BPE model."""
        letters = self.letters
        return [t.id for t in self.library.model.tokenize("".join([letters[b] for b in word.encode("utf-8", "replace")]))]

    # -- texts

    def _runs(self, text: str) -> list[str]:
        if _ODD_SPACES.search(text):
            return [x for x in _SPACE.split(text) if x]
        return text.split()

    def _per_text(self, texts: list[str], cache: dict, of_run: Callable, special: Callable, total: Callable) -> list:
        out, new = [], []
        for text in texts:
            parts = []
            segments = _with_specials(self.special, text) if any(c in text for c in self._openers) else [text]
            for n, segment in enumerate(segments):
                if n % 2:
                    parts.append(special(segment))
                    continue
                runs = self._runs(segment)
                for run in runs:
                    if run not in cache:
                        cache[run] = of_run(run)
                        new.append(run)
                parts.append(total([cache[run] for run in runs]))
            out.append(total(parts))
        if len(cache) > CACHE_RUNS:  # full: what came first, the frequent runs among it, stays
            for run in new:
                del cache[run]
        return out

    def counts(self, texts: list[str]) -> list[int]:
        """Number of tokens of each text."""
        of_word, out = self._counts.__getitem__, []
        for text in texts:
            segments = _with_specials(self.special, text) if any(c in text for c in self._openers) else [text]
            out.append(sum(sum(map(of_word, self.all_words(s))) for s in segments[::2]) + len(segments) // 2)
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        """Identifiers of each text, as little-endian unsigned 32-bit integers."""

        def of_run(run: str) -> bytes:
            return np.array([i for w in self.words(run) for i in self.word_ids(w)], "<u4").tobytes()

        return self._per_text(texts, self._ids, of_run, lambda s: np.array([self.added[s]], "<u4").tobytes(), b"".join)


def _with_specials(pattern, text: str) -> list[str]:
    """Plain and special segments in turn, a plain one first."""
    out, at = [], 0
    for m in pattern.finditer(text):
        out += [text[at : m.start()], m.group()]
        at = m.end()
    return [*out, text[at:]]


_MODELS: dict[int, WordModel] = {}


def model_of(data: bytes) -> WordModel:
    """The worker's own copy of a model."""
    key = hash(data)
    if key not in _MODELS:
        _MODELS[key] = WordModel(data)
    return _MODELS[key]


def count_tokens(spark: SparkSession, df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_bytes`` and ``n_tokens`` of every row; no shuffle, no state.

    The tokenizer file is read by the driver and broadcast (a few MB, whatever the input).
    """
    data = spark.sparkContext.broadcast(read_file(tokenizer_path))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch.column(1))
        counts = model_of(data.value).counts(texts)
        sizes = [len(t.encode("utf-8", "replace")) for t in texts]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_batches(source, run, f"id {source.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long")
