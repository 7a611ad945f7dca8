"""Whole jobs that a review found done in part."""

import pytest

from tessera.llm import components, license_scan, stages
from tessera.llm.common import tidy


def test_millions_of_edges_settle(spark):
    n = 2_200_000
    links = spark.range(1, n + 1).selectExpr("id AS a", "id % 3 - 3 AS b")
    found = components.components(links)
    assert found.count() == n + 3
    assert {tuple(r) for r in found.groupBy("root").count().collect()} == {(-3, n // 3 + 1), (-2, n // 3 + 2), (-1, n // 3 + 1)}


def test_near_copies_at_similarity_0_8_go(spark):
    base = [f"word{i}" for i in range(100)]
    edits = [(i, " ".join([*base[: 7 * i], f"other{i}", *base[7 * i + 1 :]])) for i in range(1, 13)]
    half = " ".join([*base[:50], *(f"else{i}" for i in range(50))])
    df = spark.createDataFrame([(0, " ".join(base)), *edits, (50, half)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in stages.drop_near_copies(spark, df, "").collect()) == [0, 50]


def test_short_and_long_texts_near_the_bound(spark):
    rows = []
    for n, (size, cut) in enumerate([(8, 0), (30, 5), (30, 6), (3000, 600), (3000, 900)]):
        words = [f"x{n}y{i}" for i in range(size + 4)]
        rows += [(10 * n, " ".join(words)), (10 * n + 1, " ".join(words[: len(words) - cut]).upper() + " ")]
    kept = stages.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    # similarity 1, 25/30, 24/30, 2400/3000 and 2100/3000
    assert sorted(r["doc_id"] for r in kept) == [0, 10, 20, 30, 40, 41]


def test_one_row_stays_of_a_group_with_null_or_shared_ids(spark):
    def edits(n):
        base = [f"w{n}x{i}" for i in range(100)]
        return [" ".join([*base[: 9 * i], "new", *base[9 * i + 1 :]]) for i in range(1, 5)]

    rows = [(None, t) for t in edits(1)] + [(5, t) for t in edits(2)] + [(i or None, t) for i, t in enumerate(edits(3))]
    kept = stages.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r["doc_id"] or 0, r["text"][:2]) for r in kept) == [(0, "w1"), (1, "w3"), (5, "w2")]


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this"""
GPL = "This is free software under the GNU General Public\nLicense version 3"


@pytest.mark.parametrize("lead", ["", " * ", "// ", "# ", "\t;; ", "dnl "])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize(("text", "labels", "sentences"), [(MIT, {"mit"}, 2), (BSD, {"bsd", "bsd-3-clause"}, 2), (ISC, {"isc"}, 1), (MPL, {"mpl-2.0"}, 1), (GPL, {"gpl-3.0"}, 1)])
def test_wrapped_licences(text, labels, sentences, lead, end):
    lowered = end.join(lead + line for line in text.lower().split("\n"))
    found = license_scan.scanner().detect(lowered)
    assert {d.label for d in found} >= labels and len(found) >= sentences
    plain = license_scan.scanner().detect(" ".join(text.lower().split()))
    # the spans are those of the text itself
    folded = [" ".join(lowered[d.start : d.end].replace(lead.strip() or "\n", " ").split()) for d in found]
    assert folded == [" ".join(" ".join(text.lower().split())[d.start : d.end].split()) for d in plain]


def test_tidy_passes_batches_and_failures_on():
    def run(batches):
        for b in batches:
            if b is None:
                raise ValueError("bad batch")
            yield b

    assert list(tidy(run)(iter([1, 2]))) == [1, 2]
    assert list(tidy(run)(iter([]))) == []
    with pytest.raises(ValueError, match="bad batch"):
        list(tidy(run)(iter([1, None])))
