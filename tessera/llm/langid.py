"""Language identification with hyperdimensional n-gram profiles.

Every letter owns a pseudo-random bipolar vector that follows from its code point
alone.  An n-gram is bound by multiplying the letter vectors after rotating each by
its distance from the n-gram's end; a text is the bundle (sum) of its n-gram
vectors; a language is the bundle of its learning texts.  A text gets the language
with the largest cosine.

Bundling is linear, so both steps work on exact counts of (text, n-gram) pairs, held as sorted
pairs and bundled in blocks of n-grams, so memory follows the characters of a batch and not texts times
n-grams (an alphabet of thousands of letters has about as many n-grams as characters).  Learning counts n-grams in all
learning texts with a distributed aggregation of integer vectors, one short vector
per language and partition; nothing is sampled.

Evidence.  A text of m n-grams, drawn as the language's learning texts were, has about the
cosine ``|prototype| m / (n-grams of the prototype |text|)`` with it; the space itself adds noise of
``1 / sqrt(dim)``.  ``fit`` is the cosine over that expectation, near 1 for a text of the language and near 0 for one of
no learned language.  ``known`` is false where the text is in no learned language beyond doubt: even with three
times the noise added, its cosine stays under ``FLOOR`` of the expectation.  A short text has a small
expectation and stays known, as nothing is decided about it.

Defined results: a null text or one without a letter is ``und`` with score 0 and not known; rows
without a language are never learned from; with no language learned every row is
``und`` (an empty table gives no rows); equal texts get equal answers; repeated rows and tied or null ids are
answered one by one; texts of any length are read whole; ties go to the first language by name;
columns besides those named are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of, tidy

UNKNOWN = "und"
SPACE = 32
#: Count matrices of up to this many numbers are held whole (32 MB).
DENSE = 8_000_000
#: An n-gram is worked on for all texts at once where one text in this many has it.
DENSER = 40
#: Letters whose vectors a Python worker remembers, a kilobyte each.
CACHE_LETTERS = 1 << 16
#: Share of the expected cosine under which a text is in no learned language.
FLOOR = 0.25


@dataclass(frozen=True)
class Profile:
    """Parameters of the vector space: its size, the n-gram length and the seed."""

    dim: int = 1024
    n: int = 3
    seed: int = 20240917


class Language(NamedTuple):
    """What is learned of a language: the bundle of its n-gram vectors, and how many they are."""

    vector: np.ndarray
    grams: int


class Answer(NamedTuple):
    lang: str
    score: float
    margin: float
    fit: float
    known: bool


def _is_letter_table() -> np.ndarray:
    table = np.zeros(0x110000, dtype=bool)
    table[[c for c in range(0x110000) if chr(c).isalpha()]] = True
    return table


_LETTERS: np.ndarray | None = None
_VECTORS: dict[tuple[Profile, int], np.ndarray] = {}


def letters_table() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = _is_letter_table()
    return _LETTERS


def letter_vector(profile: Profile, code: int) -> np.ndarray:
    """Bipolar vector of a code point; the same on every machine."""
    key = (profile, code)
    if key not in _VECTORS:
        if len(_VECTORS) >= CACHE_LETTERS:
            _VECTORS.clear()
        bits = np.random.Generator(np.random.PCG64([profile.seed, code])).integers(0, 2, profile.dim, dtype=np.int8)
        _VECTORS[key] = 2 * bits - 1
    return _VECTORS[key]


def symbols(text: str) -> np.ndarray:
    """Lower-cased letters, with one space for each run of other characters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.where(letters_table()[codes], codes, SPACE).astype(np.uint32)
    if not len(codes):
        return codes
    keep = (codes != SPACE) | np.concatenate(([True], codes[:-1] != SPACE))
    out = codes[keep]
    if len(out) == 1 and out[0] == SPACE:
        return out[:0]
    return np.concatenate(([SPACE], out[int(out[0] == SPACE) :], [SPACE] * int(out[-1] != SPACE))).astype(np.uint32)


def distinct_codes(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct code points and each symbol's place among them, without a sort."""
    top = int(flat.max()) + 1
    seen = np.zeros(top, dtype=bool)
    seen[flat] = True
    alphabet = np.flatnonzero(seen)
    place = np.zeros(top, dtype=np.int32)
    place[alphabet] = np.arange(len(alphabet))
    return alphabet, place[flat]


class Grams(NamedTuple):
    """N-grams of some texts: a matrix (texts x n-grams) where that is small, else pairs sorted by
    n-gram and text with counts; each n-gram's letters as places in the alphabet; n-grams per text."""

    dense: np.ndarray | None
    gram: np.ndarray
    text: np.ndarray
    count: np.ndarray
    alphabet: np.ndarray
    letters: np.ndarray
    sizes: np.ndarray


def gram_counts(texts: list[str], n: int) -> Grams:
    """How often each n-gram stands in each text."""
    parts = [symbols(t) for t in texts]
    sizes = np.array([max(0, len(p) - n + 1) for p in parts], np.int64)
    if not sizes.sum():
        none = np.zeros(0, np.int64)
        return Grams(None, none, none, none, none, np.zeros((0, n), np.int32), sizes)
    flat = np.concatenate([p for p, s in zip(parts, sizes, strict=True) if s])
    alphabet, codes = distinct_codes(flat)
    spans = np.array([len(p) for p, s in zip(parts, sizes, strict=True) if s])
    own = np.repeat(np.flatnonzero(sizes), spans)
    gram = codes[: len(codes) - n + 1].astype(np.int64)
    for i in range(1, n):
        gram = gram * len(alphabet) + codes[i : len(codes) - n + 1 + i]
    whole = own[: len(gram)] == own[n - 1 :]
    gram, own = gram[whole], own[: len(whole)][whole]
    space = len(alphabet) ** n
    if space <= 4_000_000:
        seen = np.zeros(space, dtype=bool)
        seen[gram] = True
        distinct = np.flatnonzero(seen)
        rank = np.zeros(space, dtype=np.int64)
        rank[distinct] = np.arange(len(distinct))
        column = rank[gram]
    else:
        distinct, column = np.unique(gram, return_inverse=True)
    letters = np.empty((len(distinct), n), np.int32)
    rest = distinct.copy()
    for i in reversed(range(n)):
        letters[:, i] = rest % len(alphabet)
        rest //= len(alphabet)
    if len(texts) * len(distinct) <= DENSE:
        none = np.zeros(0, np.int64)
        counts = np.bincount(own * len(distinct) + column, minlength=len(texts) * len(distinct))
        return Grams(counts.reshape(len(texts), len(distinct)).astype(np.float32), none, none, none, alphabet, letters, sizes)
    pair = np.sort(column * len(texts) + own)
    first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
    count = np.diff(np.append(first, len(pair)))
    return Grams(None, pair[first] // len(texts), pair[first] % len(texts), count, alphabet, letters, sizes)


def turned(profile: Profile, alphabet: np.ndarray) -> list[np.ndarray]:
    """Vectors of the alphabet's letters, rotated for each place in an n-gram."""
    base = np.stack([letter_vector(profile, int(c)) for c in alphabet]) if len(alphabet) else np.zeros((0, profile.dim), np.int8)
    return [np.roll(base, profile.n - 1 - i, axis=1) for i in range(profile.n)]


def bound(places: list[np.ndarray], letters: np.ndarray) -> np.ndarray:
    """The rotated vectors of each n-gram's letters, multiplied; entries are 1 and -1."""
    out = places[0][letters[:, 0]]
    for i in range(1, len(places)):
        out *= places[i][letters[:, i]]
    return out


def bundle(profile: Profile, texts: list[str], step: int = 2048, found: Grams | None = None) -> np.ndarray:
    """Document vectors, one row per text; exact integers below 2**24."""
    found = found or gram_counts(texts, profile.n)
    out = np.zeros((len(texts), profile.dim), np.float32)
    places = turned(profile, found.alphabet)
    if found.dense is not None:
        for at in range(0, len(found.letters), step):
            out += found.dense[:, at : at + step] @ bound(places, found.letters[at : at + step]).astype(np.float32)
        return out
    # n-grams that many texts have: bound once, a matrix product for each block of them
    common = DENSER * np.bincount(found.gram, minlength=len(found.letters)) >= len(texts)
    place = np.cumsum(common) - 1
    chosen = np.flatnonzero(common)
    gram, text, count = place[found.gram], found.text, found.count.astype(np.float32)
    shared = common[found.gram]
    for at in range(0, len(chosen), step):
        here = shared & (gram >= at) & (gram < at + step)
        matrix = np.zeros((len(texts), min(step, len(chosen) - at)), np.float32)
        matrix[text[here], gram[here] - at] = count[here]
        out += matrix @ bound(places, found.letters[chosen[at : at + step]]).astype(np.float32)
    # the others, text by text
    rest = np.flatnonzero(~shared)
    rest = rest[np.argsort(text[rest], kind="stable")]
    for at in range(0, len(rest), step):
        own = rest[at : at + step]
        vectors = bound(places, found.letters[found.gram[own]]).astype(np.float32)
        edges = np.flatnonzero(np.diff(text[own], prepend=-1, append=-1))
        for low, high in zip(edges, edges[1:], strict=False):
            out[text[own[low]]] += count[own[low:high]] @ vectors[low:high]
    return out


def bundle_all(profile: Profile, texts: list[str], step: int = 2048) -> tuple[np.ndarray, int]:
    """Sum of the texts' vectors, and the number of n-grams: each is counted over all texts and bound once."""
    found = gram_counts(texts, profile.n)
    total = found.dense.sum(axis=0, dtype=np.float64) if found.dense is not None else np.bincount(found.gram, found.count, len(found.letters))
    out = np.zeros(profile.dim)
    places = turned(profile, found.alphabet)
    for at in range(0, len(found.letters), step):
        out += total[at : at + step] @ bound(places, found.letters[at : at + step]).astype(np.float64)
    return out, int(found.sizes.sum())


def _groups(texts: list[str], rows: int = 512, chars: int = 1 << 21):
    """Consecutive slices, bounded in rows and in characters."""
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and (i - at >= rows or size + len(t) > chars):
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang", profile: Profile = Profile()) -> dict[str, Language]:
    """What every row with a text and a language teaches.

    The driver gets one vector of ``dim`` numbers per language.
    """

    def partial(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch):
                langs, texts = part.column(1).to_pylist(), texts_of(part.column(0))
                for lang in sorted(set(langs)):
                    own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                    total = sums.setdefault(lang, np.zeros(profile.dim + 1, np.int64))
                    for a, b in _groups(own):
                        vector, grams = bundle_all(profile, own[a:b])
                        total += np.append(np.rint(vector).astype(np.int64), grams)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["lang", "v"]
            )

    known = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    sums = known.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).mapInArrow(tidy(partial), "lang string, v array<long>")
    total = sums.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    rows = total.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x")))["x"].alias("v")).orderBy("lang").collect()
    return {r["lang"]: Language(np.array(r["v"][:-1], dtype=np.float64), r["v"][-1]) for r in rows}


class Languages:
    """The learned languages, ready for comparison: unit vectors, and how concentrated each one's n-grams are."""

    def __init__(self, learned: dict[str, Language], profile: Profile = Profile()):
        self.profile, self.names = profile, sorted(learned)
        norms = [max(1e-12, float(np.linalg.norm(learned[n].vector))) for n in self.names]
        self.units = np.stack([learned[n].vector / x for n, x in zip(self.names, norms, strict=True)]) if self.names else np.zeros((0, profile.dim))
        self.density = [x / max(1, learned[n].grams) for n, x in zip(self.names, norms, strict=True)]

    def classify(self, texts: list[str]) -> list[Answer]:
        """Language, cosine, lead over the second language and evidence of each text."""
        out, noise = [], 3 / np.sqrt(self.profile.dim)
        for a, b in _groups(texts):
            found = gram_counts(texts[a:b], self.profile.n)
            vectors = bundle(self.profile, texts[a:b], found=found).astype(np.float64)
            norms = np.sqrt((vectors**2).sum(axis=1))
            cosines = (vectors @ self.units.T) / np.where(norms == 0, 1, norms)[:, None]
            for norm, grams, row in zip(norms.tolist(), found.sizes.tolist(), cosines, strict=True):
                if norm == 0 or not self.names:
                    out.append(Answer(UNKNOWN, 0.0, 0.0, 0.0, False))
                    continue
                best = int(row.argmax())
                second = np.partition(row, -2)[-2] if len(row) > 1 else 0.0
                # a text can't be expected to be nearer than its whole language
                expected = min(1.0, self.density[best] * grams / norm)
                known = bool(row[best] + noise >= FLOOR * expected)
                out.append(Answer(self.names[best], float(min(1.0, max(0.0, row[best]))), float(row[best] - second), float(row[best] / max(1e-12, expected)), known))
        return out


def identify(df: DataFrame, learned: dict[str, Language], id_col: str = "doc_id", text_col: str = "text", profile: Profile = Profile(), keep: list[Column] | None = None) -> DataFrame:
    """One row per input row: ``id``, the columns of ``keep``, ``lang_pred``, ``score``, ``margin``, ``fit``, ``known``."""
    languages = Languages(learned, profile)
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("__text"), *(keep or []))
    kept = [f for f in source.schema.fields if f.name != "__text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", lang_pred string, score double, margin double, fit double, known boolean"

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                lang, score, margin, fit, known = (list(x) for x in zip(*languages.classify(texts_of(part.column("__text"))), strict=True))
                same = [part.column(f.name) for f in kept]
                made = [pa.array(lang), *(pa.array(x, pa.float64()) for x in (score, margin, fit)), pa.array(known)]
                yield pa.RecordBatch.from_arrays([*same, *made], [*(f.name for f in kept), "lang_pred", "score", "margin", "fit", "known"])

    return source.mapInArrow(tidy(run), schema)
