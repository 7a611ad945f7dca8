"""The index of SimHash fingerprints: what meets, what the tally drops, long lists."""

from itertools import combinations

import numpy as np
import pytest

from tessera.llm import simhash_dedup as simhash


def slow_links(prints):
    a = np.array(sorted(prints), np.uint64)
    return {(int(a[i]), int(a[i + 1 + j])) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[i + 1 :]) <= 2).tolist()}


def got_links(spark, prints, parts=5, limit=simhash.LONG_LIST):
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in sorted(prints)], "print long").repartition(parts)
    return [tuple(sorted((int(np.int64(r["a"]).view(np.uint64)), int(np.int64(r["b"]).view(np.uint64))))) for r in simhash.links(df, limit).collect()]


def test_all_pairs_within_two_bits_of_one_fingerprint(spark):
    base = 0x0123456789ABCDEF
    prints = {base, *(base ^ 1 << i for i in range(64)), *(base ^ 1 << i ^ 1 << j for i, j in combinations(range(64), 2))}
    got = got_links(spark, prints)
    assert len(got) == len(set(got)) and set(got) == slow_links(prints)


@pytest.mark.parametrize("limit", [2, 5, 10**6])
def test_long_lists_lose_nothing(spark, limit):
    """Thousands of fingerprints that differ in the same four bytes; any bound of a long list."""
    rng = np.random.default_rng(1)
    prints = {0x1122000033440000 | int(x) << 32 | int(y) for x, y in rng.integers(0, 1 << 7, (900, 2))}
    prints |= {int(x) for x in rng.integers(0, 1 << 63, 200)}
    got = got_links(spark, prints, limit=limit)
    assert len(got) == len(set(got)) and set(got) == slow_links(prints)


def test_batches_may_cut_lists_anywhere(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rng = np.random.default_rng(2)
        prints = {0x55AA << 32 | int(x) for x in rng.integers(0, 1 << 11, 300)}
        got = got_links(spark, prints, 1, 8)
        assert len(got) == len(set(got)) and set(got) == slow_links(prints)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_the_tally_drops_pairs_that_only_meet():
    """Pairs share four bytes by meeting in a list; six are the guaranteed minimum."""
    key = np.zeros(4, np.int64)
    one = np.zeros(4, np.int64)
    two = np.array([0x00000101, 0x00010101, 0x01010101, 0x00000003])
    assert simhash._tallied(key, one, two).tolist() == [True, False, False, True]
