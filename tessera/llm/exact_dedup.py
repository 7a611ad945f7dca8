"""Exact deduplication: counting quotient filters route, bytes decide.

1. Every row's text is normalised (white space of ``[\\x20\\x09-\\x0D]`` deleted) and
   fingerprinted with 64 bits; the narrow result (no text) is staged.
2. Each partition builds counting quotient filters of its fingerprints, one per block
   of the fingerprint space.  A block's filters, from all partitions, are merged by
   their sorted remainders; nothing is lost, so a merged count is the number of rows
   with that fingerprint.
3. A bitmap over the leading bits of the fingerprints with a count above one (at most
   ``2 ** ROUTE_BITS`` bits, 8 MB, whatever the input) is broadcast; rows it lets through
   are read again, equal texts of a partition are put together and the distinct byte strings
   meet by fingerprint.  Only what has the same bytes is a group; a row let through
   by chance, or by a clash of fingerprints, ends alone.  Where the repeated fingerprints would fill more than
   half of the bitmap it would let most rows through; then they are joined with the rows instead.
4. Of a group the row with the most code points, then the smallest id, stays.

No task holds a group: equal texts are put together before and while they are
shuffled, blocks are sized by the number of rows, and each digest's best row is found by a partial aggregation
before anything is joined, so the only join that sees all rows of a group is the last one, which Spark may split.

Defined results: a null text counts as empty, and all texts of white space alone are
one group; null ids come after others; of rows that are the same in id and length
exactly one stays; ids are numbers; texts of any length are read whole; an empty table gives no rows; extra columns are
ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, map_batches, raw_key, slices, staged, tidy

SPACES = b" \t\n\x0b\x0c\r"
#: Rows whose fingerprints one merge task handles on average.
BLOCK_ROWS = 1 << 20
#: Bits, at most, of the broadcast bitmap that routes rows to the byte comparison.
ROUTE_BITS = 26


def normalised(text: bytes) -> bytes:
    return text.translate(None, SPACES)


def fingerprint(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text)


@dataclass
class QuotientFilter:
    """Counting quotient filter of 64-bit fingerprints that share their leading ``skip`` bits.

    A fingerprint's next ``q`` bits are its quotient, the rest its remainder.  Remainders
    lie in slots in the order (quotient, remainder), each quotient's run at or after the
    slot of that number.  A count above one follows its remainder in a slot marked as a counter.
    """

    skip: int
    q: int
    occupied: np.ndarray  # bool per quotient
    run_end: np.ndarray  # bool per slot
    counter: np.ndarray  # bool per slot
    slots: np.ndarray  # uint64 per slot

    @classmethod
    def build(cls, prints: np.ndarray, counts: np.ndarray, skip: int) -> QuotientFilter:
        """From ascending distinct fingerprints (uint64) with counts."""
        n = len(prints)
        q = max(1, int(np.ceil(np.log2(max(2, n) / 0.75))))
        rest = np.uint64(64 - skip - q)
        local = (prints << np.uint64(skip)) >> np.uint64(skip)
        quotient = (local >> rest).astype(np.int64)
        remainder = local & ((np.uint64(1) << rest) - np.uint64(1))
        width = 1 + (counts > 1).astype(np.int64)
        # first slot of each entry: never before its quotient, never over the entry before
        before = np.cumsum(width) - width
        place = before + np.maximum.accumulate(quotient - before) if n else before
        size = max(1 << q, int(place[-1] + width[-1]) if n else 1)
        occupied, run_end, counter = (np.zeros(m, bool) for m in (1 << q, size, size))
        slots = np.zeros(size, np.uint64)
        occupied[quotient] = True
        slots[place] = remainder
        many = counts > 1
        slots[place[many] + 1] = counts[many].astype(np.uint64)
        counter[place[many] + 1] = True
        last = np.append(quotient[1:] != quotient[:-1], True) if n else np.zeros(0, bool)
        run_end[(place + width - 1)[last]] = True
        return cls(skip, q, occupied, run_end, counter, slots)

    def entries(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Ascending fingerprints of this block, with counts."""
        quotient = np.flatnonzero(self.occupied)
        end = np.flatnonzero(self.run_end)
        if not len(end):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        start = np.maximum(quotient, np.concatenate(([0], end[:-1] + 1)))
        length = end - start + 1
        at = np.repeat(start - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
        run = np.repeat(quotient, length).astype(np.uint64)
        counts_at = self.counter[at]
        is_entry = ~counts_at
        counted = np.append(counts_at[1:], False)[is_entry]
        counts = np.ones(int(is_entry.sum()), np.int64)
        counts[counted] = self.slots[at[counts_at]].astype(np.int64)
        rest = np.uint64(64 - self.skip - self.q)
        prints = (run[is_entry] << rest) | self.slots[at[is_entry]]
        if self.skip:
            prints |= np.uint64(block) << np.uint64(64 - self.skip)
        return prints, counts

    def to_bytes(self) -> bytes:
        head = np.array([self.skip, self.q, len(self.slots)], "<i8").tobytes()
        bits = [np.packbits(x, bitorder="little").tobytes() for x in (self.occupied, self.run_end, self.counter)]
        return head + b"".join(bits) + self.slots.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> QuotientFilter:
        skip, q, size = np.frombuffer(data, "<i8", 3).tolist()
        at, fields = 24, []
        for n in (1 << q, size, size):
            step = (n + 7) // 8
            fields.append(np.unpackbits(np.frombuffer(data, np.uint8, step, at), count=n, bitorder="little").astype(bool))
            at += step
        return cls(skip, q, *fields, np.frombuffer(data, "<u8", size, at))


def counted(prints: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct fingerprints with the sums of their counts."""
    if not len(prints):
        return prints.astype(np.uint64), np.zeros(0, np.int64)
    order = np.argsort(prints, kind="stable")
    prints = prints[order]
    first = np.flatnonzero(np.concatenate(([True], prints[1:] != prints[:-1])))
    ones = np.ones(len(prints), np.int64) if counts is None else counts[order]
    return prints[first], np.add.reduceat(ones, first)


def merge_filters(block: int, filters: list[QuotientFilter]) -> QuotientFilter:
    """One filter of what several hold: their sorted entries merged, equal ones added."""
    parts = [f.entries(block) for f in filters]
    prints, counts = counted(np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts]))
    return QuotientFilter.build(prints, counts, filters[0].skip)


def fingerprints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``row`` (unique), ``raw``, ``n_chars``, ``sha`` (binary) and ``print`` of every row; no text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [normalised(t) for t in bytes_of(batch.column("text"))]
        sha = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
        prints = pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))
        chars = pc.fill_null(pc.utf8_length(batch.column("text")), 0).cast(pa.int64())
        same = [batch.column(c) for c in ("id", "row", "raw")]
        return pa.RecordBatch.from_arrays([*same, chars, sha, prints], ["id", "row", "raw", "n_chars", "sha", "print"])

    source = df.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), raw_key(text_col).alias("raw"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return map_batches(source, run, f"id {kind}, row long, raw long, n_chars long, sha binary, print long")


def filters(prints: DataFrame, block_bits: int, column: str = "print") -> DataFrame:
    """Per partition and block, one counting quotient filter: ``block``, ``filter``."""

    def run(batches):
        seen = [np.asarray(b.column(0)).view(np.uint64) for b in batches if b.num_rows]
        if not seen:
            return
        found, counts = counted(np.concatenate(seen))
        block = (found >> np.uint64(64 - block_bits)).astype(np.int64) if block_bits else np.zeros(len(found), np.int64)
        edges = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True])))
        built = [QuotientFilter.build(found[a:b], counts[a:b], block_bits).to_bytes() for a, b in zip(edges, edges[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array(block[edges[:-1]], pa.int32()), pa.array(built, pa.binary())], ["block", "filter"])

    return prints.select(column).mapInArrow(tidy(run), "block int, filter binary")


def merged(parts: DataFrame) -> DataFrame:
    """One counting quotient filter per block, of all partitions' filters."""

    def run(key, table):
        block = key[0].as_py()
        data = [QuotientFilter.from_bytes(x) for x in table.column("filter").to_pylist()]
        return pa.table({"block": pa.array([block], pa.int32()), "filter": pa.array([merge_filters(block, data).to_bytes()], pa.binary())})

    return parts.groupBy("block").applyInArrow(run, "block int, filter binary")


def repeated(filters_: DataFrame) -> DataFrame:
    """Fingerprints with a count above one: ``print``, ``n``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            p, c = QuotientFilter.from_bytes(data).entries(block)
            prints.append(p[c > 1])
            counts.append(c[c > 1])
        found = pa.array(np.concatenate(prints).view(np.int64))
        return pa.RecordBatch.from_arrays([found, pa.array(np.concatenate(counts))], ["print", "n"])

    return map_batches(filters_, run, "print long, n long")


def route_bitmap(prints: DataFrame, n: int, route_bits: int = ROUTE_BITS) -> tuple[int, bytes]:
    """(bits, bitmap over the fingerprints' leading bits); 2 ** route_bits bits at most."""
    bits = min(route_bits, max(15, int(np.ceil(np.log2(8 * n + 1)))))
    place = F.shiftrightunsigned("print", 64 - bits)
    rows = (
        prints.select((place + 1).alias("at"))
        .groupBy(F.expr("bitmap_bucket_number(at)").alias("bucket"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bitmap"))
        .collect()  # 4 kB for each 32,768 bits
    )
    out = bytearray(1 << (bits - 3))
    for r in rows:
        at = (r["bucket"] - 1) * 4096
        out[at : at + 4096] = r["bitmap"]
    return bits, bytes(out)


def distinct_texts(df: DataFrame, text_col: str, bits: int = 0, bitmap: bytes = b"") -> DataFrame:
    """Normalised texts of the rows that the bitmap lets through (all without one), equal ones of a slice together:
    ``print``, ``sha``, ``bytes``, ``n``."""
    shared = df.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        table = np.frombuffer(shared.value, np.uint8)
        for whole in batches:
            for batch in slices(whole):
                seen: dict[bytes, int] = {}
                for t in map(normalised, bytes_of(batch.column(0))):
                    at = fingerprint(t) >> (64 - bits) if bits else 0
                    if not bits or table[at >> 3] >> (at & 7) & 1:
                        seen[t] = seen.get(t, 0) + 1
                if seen:
                    prints = np.array([fingerprint(t) for t in seen], np.uint64).view(np.int64)
                    shas = [hashlib.sha256(t).digest() for t in seen]
                    columns = [pa.array(prints), pa.array(shas, pa.binary()), pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["print", "sha", "bytes", "n"])

    return df.select(F.col(text_col).alias("text")).mapInArrow(tidy(run), "print long, sha binary, bytes binary, n long")


def verified(df: DataFrame, text_col: str, bits: int, bitmap: bytes) -> DataFrame:
    """Groups of rows with the same normalised bytes: ``sha``, ``group_size`` (2 at least)."""
    return equal_bytes(distinct_texts(df, text_col, bits, bitmap))


def equal_bytes(routed: DataFrame) -> DataFrame:
    """The same, of texts that are routed already."""
    equal = routed.groupBy("print", "sha", "bytes").agg(F.sum("n").alias("group_size"))
    # the digest names a group from here on; two byte strings under one digest must fail, not merge
    clash = F.raise_error(F.lit("two texts have the same SHA-256"))
    named = equal.groupBy("sha").agg(F.count("*").alias("strings"), F.max("group_size").alias("group_size"))
    return named.where(F.when(F.col("strings") > 1, clash.cast("boolean")).otherwise(F.col("group_size") > 1)).select("sha", "group_size")


def groups_of(df: DataFrame, text_col: str, repeated_prints: DataFrame, route_bits: int = ROUTE_BITS) -> DataFrame:
    """Groups of equal texts, routed by the bitmap or, where it would be more than half full, by a join."""
    n = repeated_prints.count()
    if n > 1 << (route_bits - 1):
        return equal_bytes(distinct_texts(df, text_col).join(repeated_prints.select("print"), "print", "left_semi"))
    return verified(df, text_col, *route_bitmap(repeated_prints, n, route_bits))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_rows: int | None = None, route_bits: int = ROUTE_BITS) -> DataFrame:
    """One row per input row: ``id``, ``raw``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    meta = staged(fingerprints(df, id_col, text_col), "fingerprints")
    rows = meta.count() if n_rows is None else n_rows
    block_bits = min(24, max(4, int(np.ceil(np.log2(max(1, rows) / BLOCK_ROWS + 1)))))
    routed = staged(repeated(merged(filters(meta, block_bits))), "repeated")
    groups = staged(groups_of(df, text_col, routed, route_bits), "groups")
    # the best row of every digest, by a partial aggregation: a hot digest costs each task one row
    rank = F.struct("n_chars", F.col("id").isNotNull().alias("known"), (-F.col("id")).alias("low"), (-F.col("row")).alias("first"))
    best = meta.groupBy("sha").agg(F.max(rank).alias("best"))
    elected = best.join(groups, "sha").select("sha", "group_size", (-F.col("best.low")).alias("keep_id"), (-F.col("best.first")).alias("keep_row"))
    return meta.join(elected, "sha", "left").select(
        "id",
        "raw",
        F.when(F.col("keep_row").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep_row") == F.col("row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
