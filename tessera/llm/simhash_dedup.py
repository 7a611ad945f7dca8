"""Near-duplicates by SimHash: a byte-position inverted index with count filtering.

A fingerprint has 64 bits, eight positional bytes.  Two fingerprints that differ in
at most 2 bits differ in at most two bytes, so they share six positional bytes at least: the
guaranteed minimum.  Lists of single positional bytes would hold 1/256 of all fingerprints each, so
the index posts bytes together: the eight positions make four groups of two, and a
fingerprint is posted under each pair of groups with the four bytes there (6 postings).  Two differing
bytes spoil two groups at most, so two groups agree wholly and every pair sought meets in a list.
In a list, which stands for four shared bytes, the shared bytes of a pair are tallied over the other four positions too; pairs
below the guaranteed minimum of six are dropped, the others verified by the number of differing
bits.  A pair that meets in several lists is reported in the first.

A list of more than ``LONG_LIST`` fingerprints isn't compared pairwise: its entries are posted again under each
two of the other four positions (6 postings), and the tally starts from six shared bytes.  Such a list differs in two
bytes only, so it has 65,536 entries at most, whatever the input, and entries look up the 136 partners that they
can have.  Work is linear in the postings, and no pair is lost.  Equal
fingerprints are put together before the index, so copies cost nothing there.

Defined results: a null or empty text, or one without words, has the fingerprint zero and is
linked like any other; texts of fewer words than the shingle has are one shingle; texts of any length are read whole; repeated rows
are in one component; null ids never name a component unless all its ids are null; an empty table
gives no rows; extra columns are ignored, whatever they are called.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, map_batches, raw_key, staged, tidy
from .components import components

WIDTH = 3
SEED = 42
MAX_BITS = 2
POSITIONS = 8
MIN_SHARED = POSITIONS - MAX_BITS
#: Groups of positions, and the pairs of groups that a fingerprint is posted under.
GROUPS = POSITIONS // 2
KEYED = list(combinations(range(GROUPS), 2))
#: Of the four positions of an entry's rest, the two that are posted again.
AGAIN = list(combinations(range(4), 2))
#: Lists up to this length are compared pairwise.
LONG_LIST = 64
_POPCOUNT = np.array([bin(i).count("1") for i in range(65536)], np.uint8)
_PARTNERS = np.array([m for m in range(1, 65536) if bin(m).count("1") <= MAX_BITS], np.int64)


def shingle_hashes(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Unsigned hashes of a text's word shingles, repeats included; none without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends + 1).tolist()]
    stops = ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=False)], np.uint64)


def vote(hashes: np.ndarray) -> int:
    """A bit is 1 if more than half of the hashes have it; 0 without hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def simhash(text: bytes, width: int = WIDTH) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    return vote(shingle_hashes(text, width))


def fingerprints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``raw`` and ``print`` of every row; no text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.array([simhash(t) for t in bytes_of(batch.column("text"))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("raw"), pa.array(prints)], ["id", "raw", "print"])

    source = df.select(F.col(id_col).alias("id"), raw_key(text_col).alias("raw"), F.col(text_col).alias("text"))
    return map_batches(source, run, f"id {source.schema['id'].dataType.simpleString()}, raw long, print long")


def _part(p: Column, group: int) -> Column:
    """The two bytes of a group, as a number."""
    return F.shiftrightunsigned(p, 16 * group).bitwiseAND(F.lit(0xFFFF))


def postings(prints: DataFrame) -> DataFrame:
    """The index: ``key`` (pair of groups, and the four bytes there) and ``rest`` (the other four bytes)."""

    def entry(n: int, low: int, high: int) -> Column:
        p = F.col("print")
        one, two = (g for g in range(GROUPS) if g not in (low, high))
        key = F.lit(n << 32).bitwiseOR(F.shiftleft(_part(p, high), 16)).bitwiseOR(_part(p, low))
        return F.struct(key.alias("key"), F.shiftleft(_part(p, two), 16).bitwiseOR(_part(p, one)).alias("rest"))

    entries = F.array(*[entry(n, i, j) for n, (i, j) in enumerate(KEYED)])
    return prints.select(F.explode(entries).alias("e")).select("e.key", "e.rest")


def posted_again(entries: DataFrame) -> DataFrame:
    """The second index of long lists' entries: ``key``, ``rest`` as before, ``sub`` (two positions of the rest and the bytes there) and ``last`` (the two other bytes)."""

    def byte(k: int) -> Column:
        return F.shiftrightunsigned(F.col("rest"), 8 * k).bitwiseAND(F.lit(255))

    def entry(n: int, i: int, j: int) -> Column:
        one, two = (k for k in range(4) if k not in (i, j))
        sub = F.lit(n << 16).bitwiseOR(F.shiftleft(byte(j), 8)).bitwiseOR(byte(i))
        return F.struct(sub.alias("sub"), F.shiftleft(byte(two), 8).bitwiseOR(byte(one)).alias("last"))

    again = F.array(*[entry(n, i, j) for n, (i, j) in enumerate(AGAIN)])
    return entries.select("key", "rest", F.explode(again).alias("e")).select("key", "e.sub", "e.last", "rest")


def _whole(key: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Fingerprints that postings stand for."""
    out = np.zeros(len(key), np.uint64)
    for n, keyed in enumerate(KEYED):
        here = key >> 32 == n
        others = [g for g in range(GROUPS) if g not in keyed]
        for groups, part in ((keyed, key), (others, rest)):
            for place, g in enumerate(groups):
                out[here] |= ((part[here] >> 16 * place) & 0xFFFF).astype(np.uint64) << np.uint64(16 * g)
    return out


def _tallied(key: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which pairs of entries of one list reach the minimum of shared bytes, are verified, and have no list before this."""
    differ = one ^ two
    shared = np.full(len(key), POSITIONS - 4, np.int64)
    for k in range(4):
        shared += (differ >> 8 * k) & 255 == 0
    good = shared >= MIN_SHARED
    good &= _POPCOUNT[differ & 0xFFFF] + _POPCOUNT[(differ >> 16) & 0xFFFF] <= MAX_BITS
    # groups outside the key that agree too: a pair of groups with one of them may go before
    for n, keyed in enumerate(KEYED):
        here = key >> 32 == n
        for place, g in enumerate(x for x in range(GROUPS) if x not in keyed):
            if g < keyed[1]:
                good &= ~(here & ((differ >> 16 * place) & 0xFFFF == 0))
    return good


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal tuples."""
    change = np.zeros(max(0, len(columns[0]) - 1), bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    starts = np.flatnonzero(np.concatenate(([True], change))) if len(columns[0]) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(columns[0])))


def _neighbours(starts: np.ndarray, length: np.ndarray, limit: int):
    """All pairs of places inside runs of at most ``limit``, as two arrays for each distance."""
    own = np.where(length <= limit, length, 0)
    left = np.repeat(own, length) - (np.arange(int(length.sum())) - np.repeat(starts, length)) - 1
    for step in range(1, int(own.max(initial=0))):
        at = np.flatnonzero(left >= step)
        yield at, at + step


def links_of(key: np.ndarray, rest: np.ndarray, limit: int = LONG_LIST) -> tuple[np.ndarray, np.ndarray]:
    """Linked fingerprints of whole posting lists of at most ``limit`` entries, sorted by key."""
    found = [np.zeros((2, 0), np.int64)]
    starts, length = _runs(key)
    for a, b in _neighbours(starts, length, limit):
        good = _tallied(key[a], rest[a], rest[b])
        found.append(np.stack((a[good], b[good])))
    a, b = np.concatenate(found, axis=1)
    return _whole(key[a], rest[a]).view(np.int64), _whole(key[b], rest[b]).view(np.int64)


def links_again(key: np.ndarray, sub: np.ndarray, last: np.ndarray, rest: np.ndarray, limit: int = LONG_LIST) -> tuple[np.ndarray, np.ndarray]:
    """Linked fingerprints of whole lists of the second index, sorted by (key, sub)."""
    found = [np.zeros((2, 0), np.int64)]
    starts, length = _runs(key, sub)
    found += [np.stack(pair) for pair in _neighbours(starts, length, limit)]
    for start, n in zip(starts[length > limit].tolist(), length[length > limit].tolist(), strict=True):
        own, at = last[start : start + n], np.arange(start, start + n)
        place = np.full(65536, -1, np.int64)
        place[own] = at
        for mask in _PARTNERS:
            other = place[own ^ mask]
            found.append(np.stack((at[other > at], other[other > at])))
    a, b = np.concatenate(found, axis=1)
    # of the lists that both stand in, the one of the first two shared positions reports
    differ = rest[a] ^ rest[b]
    good = np.ones(len(a), bool)
    for n, (i, j) in enumerate(AGAIN):
        here = sub[a] >> 16 == n
        for k in range(j):
            if k != i:
                good &= ~(here & ((differ >> 8 * k) & 255 == 0))
    a, b = a[good], b[good]
    good = _tallied(key[a], rest[a], rest[b])
    a, b = a[good], b[good]
    return _whole(key[a], rest[a]).view(np.int64), _whole(key[b], rest[b]).view(np.int64)


#: Links (two fingerprints), and entries (key, rest) of long lists that a first pass holds back.
ENTRY = "a long, b long, entry boolean"


def links(prints: DataFrame, limit: int = LONG_LIST) -> DataFrame:
    """Pairs ``a``, ``b`` of distinct fingerprints that differ in at most two bits."""
    lists = postings(prints).repartition("key").sortWithinPartitions("key")

    def first(batches):
        """Links of short lists; entries (key, rest) of long ones, as they come."""
        key, rest, passing = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            key = np.concatenate((key, np.asarray(batch.column(0), np.int64)))
            rest = np.concatenate((rest, np.asarray(batch.column(1), np.int64)))
            if not len(key):
                continue
            # the last list may go on in the next batch; once it is long, its entries need not wait
            whole = int(np.searchsorted(key, key[-1]))
            if len(key) - whole > limit or key[-1] == passing:
                passing, whole = key[-1], len(key)
            yield from split(key[:whole], rest[:whole], passing)
            key, rest = key[whole:], rest[whole:]
        if len(key):
            yield from split(key, rest, passing)

    def split(key, rest, passing):
        starts, length = _runs(key)
        long = np.repeat((length > limit) | (key[starts] == (-1 if passing is None else passing)), length)
        for a, b, entry in ((key[long], rest[long], True), (*links_of(key[~long], rest[~long], limit), False)):
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), entry))], ["a", "b", "entry"])

    met = staged(lists.mapInArrow(tidy(first), ENTRY), "links")
    held = met.where("entry").select(F.col("a").alias("key"), F.col("b").alias("rest"))
    again = posted_again(held).repartition("key", "sub").sortWithinPartitions("key", "sub")

    def second(batches):
        # a list has 65,536 entries at most, so what waits for its end is bounded
        columns = [np.zeros(0, np.int64)] * 4
        for batch in batches:
            columns = [np.concatenate((c, np.asarray(x, np.int64))) for c, x in zip(columns, batch.columns, strict=True)]
            if not len(columns[0]):
                continue
            whole = int(_runs(*columns[:2])[0][-1])
            yield _batch(*links_again(*(c[:whole] for c in columns), limit))
            columns = [c[whole:] for c in columns]
        if len(columns[0]):
            yield _batch(*links_again(*columns, limit))

    return met.where("NOT entry").select("a", "b").union(again.mapInArrow(tidy(second), "a long, b long"))


def _batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id``, ``raw``, ``fingerprint`` (16 hex digits), ``component_id``."""
    docs = staged(fingerprints(df, id_col, text_col), "fingerprints")
    nodes = staged(docs.groupBy("print").agg(F.min("id").alias("least")), "nodes")
    found = components(links(nodes.select("print")))
    rooted = nodes.join(found, nodes["print"] == found["node"], "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    answer = rooted.select("print", "root").join(named, "root").select("print", "component_id")
    return docs.join(answer, "print").select("id", "raw", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
