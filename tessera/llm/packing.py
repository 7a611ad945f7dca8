"""Best-fit packing of tokenised documents, after a Martello-Toth reduction.

Only lengths decide where a piece goes, and there are at most ``capacity`` of them.
So the driver gets a histogram (one row per length, whatever the input), fixes small sets of
lengths that dominate every alternative, packs the rest best-fit in descending order
(all equal bins at once) and broadcasts the plan: runs of ranks within a length that
go to consecutive sequences.  Each piece then looks its rank up.

Ranks within a length come from counts per (length, bucket of pieces), so a length that
a third of all pieces have is ranked in many tasks.

Size of the plan: a step of the reduction uses up a length or a pair of counts, a
step of best-fit splits one group of equal bins in at most three; a bin holds at most
90 different lengths of 4,096.  On the tables here it has a few thousand runs of 48 bytes.

Defined results: a null or empty text is the end identifier alone (one piece of length
1); a document longer than the capacity is cut into full pieces and a last one; repeated
rows are packed each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_batches, staged, texts_of
from .piece_bpe import read_file
from .word_bpe import model_of

CAPACITY = 4096
END_ID = 1


@dataclass
class Plan:
    """Runs of equal lengths: ranks from ``rank`` on fill ``bins`` sequences from
    ``first`` on, ``each`` pieces in a sequence from ``offset`` on."""

    capacity: int
    sequences: int = 0
    fixed: int = 0  # sequences fixed by the reduction
    rows: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    _taken: dict[int, int] = field(default_factory=dict)

    def open(self, bins: int) -> int:
        first, self.sequences = self.sequences, self.sequences + bins
        return first

    def put(self, length: int, first: int, bins: int, each: int, offset: int) -> None:
        rank = self._taken.get(length, 0)
        self.rows.append((length, rank, bins, each, first, offset))
        self._taken[length] = rank + bins * each

    def arrays(self) -> tuple[np.ndarray, ...]:
        """Columns of the runs, by length and rank."""
        return tuple(np.array(sorted(self.rows), np.int64).reshape(-1, 6).T)


def _fix(plan: Plan, left: np.ndarray, lengths: list[int], times: int) -> None:
    first, offset = plan.open(times), 0
    for n in lengths:
        plan.put(n, first, times, 1, offset)
        offset += n
        left[n] -= times
    plan.fixed += times


def reduce_dominated(plan: Plan, left: np.ndarray) -> None:
    """Fix sets that dominate all others holding their largest length (Martello and Toth).

    A length that fills a sequence, or fills it with one partner, dominates; so does
    one with which nothing fits, the largest partner where no two fit, and the pair with
    the largest members where no three fit.
    """
    c = plan.capacity
    for j in range(c, 0, -1):
        while left[j]:
            times = int(left[j])
            rest = c - j
            if rest == 0:
                _fix(plan, left, [j], times)
            elif left[rest] and (rest != j or times > 1):
                _fix(plan, left, [j, rest], times // 2 if rest == j else min(times, int(left[rest])))
            else:
                left[j] -= 1  # the partners of one such piece
                small = _smallest(left, 3)
                chosen = None
                if not small or small[0] > rest:
                    chosen = []
                elif len(small) == 1 or small[0] + small[1] > rest:
                    chosen = [_largest(left, rest)]
                elif len(small) == 2 or sum(small) > rest:
                    chosen = _dominant_pair(left, rest)
                left[j] += 1
                if chosen is None:
                    break
                # as many at once as leaves the smallest lengths, on which the choice rests, in place
                many = min([times, *(int(left[k]) for k in chosen)]) if not chosen or len({j, *chosen}) == len(chosen) + 1 else 1
                if chosen and min(chosen) in small:
                    many = min(many, max(1, int(left[min(chosen)]) - 3))
                if not chosen and j in small:
                    many = 1
                _fix(plan, left, [j, *chosen], max(1, many))


def _smallest(left: np.ndarray, n: int) -> list[int]:
    out: list[int] = []
    for k in np.flatnonzero(left)[:n].tolist():
        out += [k] * min(int(left[k]), n)
    return out[:n]


def _largest(left: np.ndarray, limit: int) -> int:
    return int(np.flatnonzero(left[: limit + 1])[-1])


def _dominant_pair(left: np.ndarray, rest: int) -> list[int] | None:
    """The pair that dominates every set of one or two lengths in ``rest``, if there is one."""
    large = _largest(left, rest)
    left[large] -= 1
    have = np.flatnonzero(left[: rest - large + 1])
    left[large] += 1
    if not len(have):
        return None
    second = int(have[-1])
    # no pair may have a larger second member
    for k in range(rest // 2, second, -1):
        if left[k] and (left[k] > 1 or np.flatnonzero(left[k + 1 : rest - k + 1]).size):
            return None
    return [large, second]


def best_fit(plan: Plan, left: np.ndarray) -> None:
    """Best-fit decreasing, groups of equally filled bins at once."""
    c = plan.capacity
    free: list[list[tuple[int, int]]] = [[] for _ in range(c + 1)]  # by room: (first bin, bins)
    for s in np.flatnonzero(left)[::-1].tolist():
        todo = int(left[s])
        room = s
        while todo and room < c:
            if not free[room]:
                room += 1
                continue
            first, bins = free[room].pop()
            each = room // s
            full = min(bins, todo // each)
            if full:
                plan.put(s, first, full, each, c - room)
                free[room - each * s].append((first, full))
                todo -= full * each
            if full < bins:
                some = min(todo, each)
                if some:  # fewer than a full share: one bin gets them
                    plan.put(s, first + full, 1, some, c - room)
                    free[room - some * s].append((first + full, 1))
                    full += 1
                    todo = 0
                if full < bins:
                    free[room].append((first + full, bins - full))
        if todo:
            each = c // s
            full, some = divmod(todo, each)
            first = plan.open(full + bool(some))
            if full:
                plan.put(s, first, full, each, 0)
                free[c - each * s].append((first, full))
            if some:
                plan.put(s, first + full, 1, some, 0)
                free[c - some * s].append((first + full, 1))
        left[s] = 0
        free[0] = []


def plan_for(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Where the pieces of each length go."""
    left = np.zeros(capacity + 1, np.int64)
    for n, times in histogram.items():
        left[n] = times
    plan = Plan(capacity)
    reduce_dominated(plan, left)
    best_fit(plan, left)
    return plan


def pieces(spark: SparkSession, df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """``id``, ``row`` (unique per input row), ``piece``, ``start``, ``length`` and ``ids`` (binary) of every piece."""
    data = spark.sparkContext.broadcast(read_file(tokenizer_path))
    end = np.array([end_id], "<u4").tobytes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, number, start, parts = [], [], [], []
        for n, ids in enumerate(model_of(data.value).ids(texts_of(batch.column("text")))):
            ids += end
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                own.append(n)
                number.append(k)
                start.append(at // 4)
                parts.append(ids[at : at + 4 * capacity])
        take = pa.array(own, pa.int64())
        lengths = pa.array([len(p) // 4 for p in parts], pa.int64())
        columns = [batch.column("id").take(take), batch.column("row").take(take), pa.array(number, pa.int32()), pa.array(start, pa.int64()), lengths, pa.array(parts, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["id", "row", "piece", "start", "length", "ids"])

    source = df.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    return map_batches(source, run, f"id {source.schema['id'].dataType.simpleString()}, row long, piece int, start long, length long, ids binary")


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with ``row``, ``piece`` and ``length``."""
    spark = cut.sparkSession
    cut = staged(cut, "pieces")
    buckets = max(8, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("row", "piece"), F.lit(buckets)).cast("int"))
    counts = staged(cut.groupBy("length", "bucket").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_for(histogram, capacity)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    based = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("row", "piece")
    ranked = cut.withColumn("rank", F.row_number().over(within) - 1).join(based, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("base")).drop("bucket", "base")
    shared = spark.sparkContext.broadcast(plan.arrays())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, rank, _, each, first, offset = shared.value
        n, r = (np.asarray(batch.column(c), np.int64) for c in ("length", "rank"))
        at = np.searchsorted((length << 40) + rank, (n << 40) + r, side="right") - 1
        inside = r - rank[at]
        sequence, place = first[at] + inside // each[at], offset[at] + inside % each[at] * n
        same = [batch.column(f) for f in names]
        return pa.RecordBatch.from_arrays([*same, pa.array(sequence), pa.array(place)], [*names, "sequence_id", "offset"])

    fields = [f for f in ranked.schema.fields if f.name != "rank"]
    names = [f.name for f in fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"
    return map_batches(ranked, run, schema)
