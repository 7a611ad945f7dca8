"""Near copies against brute force: long lists, deltas and the order of shingles lose no link."""

import random

import numpy as np
import pytest

from tessera.llm import near_copies

LIMITS = [2, 5, near_copies.SHORT_LIST]


def slow_kept(texts):
    """The first of each component of sets of Jaccard similarity 0.8 or more."""
    sets = [near_copies.shingles(t.encode()) for t in texts]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, one in enumerate(sets):
        for j in range(i):
            a, b = find(i), find(j)
            if a != b and 9 * len(np.intersect1d(one, sets[j], True)) >= 4 * (len(one) + len(sets[j])):
                parent[max(a, b)] = min(a, b)
    return {find(i) for i in range(len(sets))}


def got_kept(spark, texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = [r["id"] for r in near_copies.near_copies(df, **how).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def edited(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"e{rng.randrange(10**9)}"
    return words


def family(rng, name, copies, others):
    """Copies of one text with few edits, texts farther off from it, and near copies of those."""
    base = [f"{name}{i}" for i in range(120)]
    texts = [edited(rng, base, rng.randrange(1, 4)) for _ in range(copies)]
    for _ in range(others):
        far = edited(rng, base, rng.randrange(4, 12))
        texts += [far, edited(rng, far, 1), edited(rng, far, rng.randrange(1, 4))]
    return [" ".join(t) for t in texts]


def passages(rng, n):
    """Texts of a few of the same passages each, some with one edit."""
    pool = [[f"p{k}w{i}" for i in range(25)] for k in range(7)]
    texts = []
    for _ in range(n):
        words = [w for k in rng.sample(range(7), rng.randrange(3, 7)) for w in pool[k]]
        texts.append(" ".join(edited(rng, words, rng.randrange(3))))
    return texts


def sample_of_texts():
    rng = random.Random(11)
    texts = family(rng, "a", 60, 25) + family(rng, "b", 5, 6) + passages(rng, 90) + [f"line one two {i} three four {j}" for i in range(5) for j in range(3)]
    return texts + ["", "one", "ONE ", "two words", " ".join(f"z{i}" for i in range(5)), " ".join(f"z{i}" for i in range(6))]


@pytest.mark.parametrize("limit", LIMITS)
def test_components_equal_brute_force(spark, limit):
    texts = sample_of_texts()
    assert got_kept(spark, texts, **({} if limit == near_copies.SHORT_LIST else {"limit": limit})) == slow_kept(texts)


def test_any_sample_will_do(spark, monkeypatch):
    texts = sample_of_texts()
    want = slow_kept(texts)
    for size in (12, 60):
        monkeypatch.setattr(near_copies, "SAMPLE_TEXTS", size)
        assert got_kept(spark, texts, limit=4) == want


def test_lists_may_be_cut_anywhere(spark):
    """Rows of a long list, another long one and repeated postings, over batches of a few rows."""
    rows = [(k, n, 10) for k, size in ((1, 9), (2, 3), (3, 8), (4, 1), (5, 5)) for n in range(size)]
    rows += rows[::3]
    for batch in (1, 4, 7):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            df = spark.createDataFrame(rows, "key long, node long, size long").coalesce(1)
            met = near_copies._met(df, 4).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert sorted((r["a"], r["b"]) for r in met if r["entry"]) == sorted((k, n) for k, n, _ in set(rows) if k in (1, 3, 5))
        assert sorted((r["a"], r["b"]) for r in met if not r["entry"]) == [(0, 1), (0, 2), (1, 2)]


def test_near_sets_share_one_more_first_shingle_for_each_posted_beyond():
    rng = np.random.default_rng(3)
    for _ in range(400):
        shared = rng.integers(-(1 << 62), 1 << 62, rng.integers(1, 400))
        more = rng.multinomial(len(shared) // 4, rng.dirichlet((1, 1)))
        one, two = (np.unique(np.append(shared, rng.integers(-(1 << 62), 1 << 62, n))) for n in more)
        if 9 * len(np.intersect1d(one, two)) < 4 * (len(one) + len(two)):
            continue
        common = np.sort(rng.choice(one, len(one) // 3, replace=False)), rng.integers(2, 9, len(one) // 3)
        met = np.intersect1d(*(near_copies.first_shingles(x, common) for x in (one, two)))
        assert len(met) > min(len(one), len(two)) // near_copies.MORE


def test_texts_with_one_passage_in_common_make_no_deltas(spark, monkeypatch):
    """Long lists of texts that are far apart, whose deltas would hold both texts whole."""
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(16)]
    texts = [[*(f"t{n}w{i}" for i in range(190)), *passage] for n in range(40)]
    texts = [" ".join(t) for t in texts + [edited(rng, texts[n], 3) for n in (5, 6, 6, 9)]]
    chiefs = []
    deltas = near_copies._deltas
    monkeypatch.setattr(near_copies, "_deltas", lambda elected, whole: chiefs.append(elected.count()) or deltas(elected, whole))
    # no shingle is known as common
    monkeypatch.setattr(near_copies, "SAMPLE_TEXTS", 1)
    assert got_kept(spark, texts, limit=5) == slow_kept(texts) == set(range(40))
    assert chiefs == [0]


def test_texts_far_from_their_chief_are_posted_under_a_quarter_of_their_size(spark, monkeypatch):
    """Long lists of texts that share some passages, whose deltas are longer than themselves."""
    texts = passages(random.Random(7), 90)
    rows = dict.fromkeys(("deltas", "most", "outer", "placed"), 0)
    staged = near_copies.staged

    def counted(df, label):
        out = staged(df, label)
        if label == "sided":
            sizes = [(r["size"], len(r["delta"])) for r in out.select("size", "delta").collect()]
            rows["deltas"], rows["most"] = sum(d for _, d in sizes), sum(s // 4 + 1 for s, _ in sizes)
        elif label in rows:
            rows[label] = out.count()
        return out

    monkeypatch.setattr(near_copies, "staged", counted)
    assert got_kept(spark, texts, limit=5) == slow_kept(texts)
    assert rows["deltas"] > 2 * rows["most"]
    assert rows["placed"] > 0 and max(rows["outer"], rows["placed"]) <= rows["most"]


def test_any_drawn_deltas_will_do(spark, monkeypatch):
    texts = sample_of_texts()
    want = slow_kept(texts)
    for one_in in (1, 1 << 40):
        monkeypatch.setattr(near_copies, "DELTAS", one_in)
        assert got_kept(spark, texts, limit=3) == want
