"""The licence scan against slow twins, its negatives, and its time on long texts."""

import random
import re
import time

import pytest

from tessera.llm import license_scan as scan
from tessera.llm.license_rules import rules

from .conftest import odd_rows


def slow_resolve(found):
    """The rule as stated, pair by pair."""
    taken = []
    for d in sorted(found, key=lambda d: (-d.priority, d.start - d.end, d.start, d.label)):
        if not any(t.start <= d.start and d.end <= t.end for t in taken):
            taken.append(d)
    out = [d for d in taken if not any(t is not d and t.label == d.label and t.start <= d.start and d.end <= t.end for t in taken)]
    return sorted(out, key=lambda d: (d.start, d.end, d.label))


def test_resolve_equals_the_stated_rule():
    rng = random.Random(2)
    for _ in range(400):
        found = []
        for _ in range(rng.randint(0, 25)):
            start = rng.randint(0, 30)
            found.append(scan.Detection(start, start + rng.randint(1, 12), rng.choice("abc"), rng.choice([50, 60, 90])))
        assert scan.resolve(found) == slow_resolve(found)


def slow_labels(text):
    """Every rule's regex over the folded text, no gate; then the stated suppression."""
    folded = re.sub(r"\s+", " ", re.sub(r"([\r\n]\s*)((//+|/?\*+/?|#+|;+|--+|%+|>+|!+|dnl\b)\s*)+", r"\1", text))
    found = []
    for r in rules():
        for m in r.compiled().finditer(folded):
            found.append(scan.Detection(m.start(), m.end(), r.label or m.group(1).rstrip(".-"), r.priority))
    return [d.label for d in slow_resolve(found)]


PARTS = [
    "Licensed under the Apache License,\n * Version 2.0", "the GNU General Public\n# License version 3 or any later version", "CC BY-SA 4.0", "cc by", "All rights\nreserved", "MIT License",
    "covered by the BSD license", "released under mitigating rules", "copyright (c) 2001-2004", "spdx-license-identifier: mit", "Mozilla Public\r\n// License 2.0", "creative commons attribution 3.0",
    "free and unencumbered software released into the public domain", "plain words about nothing", "permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted",
    "To deal in the Software\n\n  without restriction, including without limitation the rights", "under the terms of", "licence:", "GPL v2+", "zlib",
]


def test_gates_lose_nothing():
    rng = random.Random(3)
    texts = [t or "" for _, t in odd_rows() if t is None or len(t) < 9000]
    texts += [rng.choice([" ", "\n", "  ", ". "]).join(rng.choices(PARTS, k=rng.randint(1, 9))) for _ in range(150)]
    for t in texts:
        assert [d.label for d in scan.scanner().detect(t.lower())] == slow_labels(t.lower()), t[:200]


@pytest.mark.parametrize(
    "text",
    [
        "licence to be released under mitigating circumstances", "under a licence, published by mitt romney", "licence distributed under expatriate rules",
        "a licence under which, covered by iscariot", "licensed, published by MIT Press under the counter", "the isc region is licensed", "mpl and the like stand in mplayer", "a bsdlike licence",
    ],
)
def test_words_that_only_start_like_a_licence(text):
    assert not {d.label for d in scan.scanner().detect(text.lower())} & {"mit", "expat", "isc", "bsd"}


def test_opposite_claims_have_labels_of_their_own():
    assert [d.label for d in scan.scanner().detect("some rights reserved")] == ["some-rights-reserved"]
    assert [d.label for d in scan.scanner().detect("all rights reserved")] == ["reserved"]


def test_time_grows_with_the_text():
    text = "licensed under the mit license, all rights reserved. cc by " * 50_000
    began = time.monotonic()
    n, places = scan.base_places(text.encode())
    found = scan.scanner().detect(text)
    assert time.monotonic() - began < 30
    assert len(places) == 100_000 and sorted(places)[:4] == [(5, "reserved"), (8, "cc-by"), (15, "reserved"), (18, "cc-by")]
    assert n == 500_000 and len(found) >= 150_000

