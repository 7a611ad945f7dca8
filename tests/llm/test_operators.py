import collections
import hashlib
import json
import re
import zlib

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import components, exact_dedup, fingerprint, langid, license_scan, packing, piece_bpe, simhash_dedup, toxicity, warc, word_bpe
from tessera.llm.queries import tokenizer_path

from .conftest import odd_rows

sentencepiece = pytest.importorskip("sentencepiece")


# -- 1 language identification


def test_language_vectors_are_bound_and_bundled():
    p = langid.Profile(dim=64)
    counts = collections.Counter()
    codes = langid.symbols("Ab  c1ab").tolist()
    assert codes == [ord(c) for c in " ab c ab "]
    for i in range(len(codes) - 2):
        counts[tuple(codes[i : i + 3])] += 1
    want = sum(n * np.roll(langid.letter_vector(p, a), 2) * np.roll(langid.letter_vector(p, b), 1) * langid.letter_vector(p, c).astype(int) for (a, b, c), n in counts.items())
    assert np.array_equal(langid.bundle(p, ["Ab  c1ab"])[0], want)
    total, grams = langid.bundle_all(p, ["Ab  c1ab", ""])
    assert np.array_equal(total, want) and grams == sum(counts.values())


def test_language_of_odd_rows(odd, empty):
    prototypes = langid.learn(odd)
    assert set(prototypes) == {"en"}
    found = langid.identify(odd, prototypes).collect()
    assert len(found) == odd.count()
    by = {r["id"]: r for r in found}
    for i in (100, 101, 102):
        assert (by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0)
    assert all(0 <= r["score"] <= 1 for r in found)
    assert langid.learn(empty) == {} and langid.identify(empty, {}).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, {}).collect()} == {"und"}


# -- 2 licence scan


def slow_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = []
    for phrase, label in license_scan.BASE_PHRASES.items():
        want = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(want)] == want]
    return len(words), sorted(places)


@pytest.mark.parametrize("text", ["", "CC-BY cc by. ALL rights\nreserved; general PUBLIC license cc by", "ccby xcc by", "é all rights reserved é", "all all rights reserved reserved"])
def test_base_phrases(text):
    n, places = license_scan.base_places(text.encode())
    assert (n, sorted(places)) == slow_base(text)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under the Apache License, Version 2.0.", {"apache-2.0"}),
        ("licensed under the GNU General Public License, version 3 or any later version", {"gpl-3.0-or-later"}),
        ("Released under the MIT License.", {"mit"}),
        ("SPDX-License-Identifier: BSD-3-Clause", {"bsd-3-clause"}),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this", {"mit"}),
        ("https://creativecommons.org/licenses/by-sa/4.0/", {"cc-by-sa-4.0"}),
        ("Sie gehen mit der Katze", set()),
        ("the permit was granted", set()),
    ],
)
def test_signatures(text, labels):
    assert {d.label for d in license_scan.scanner().detect(text.lower())} == labels


def test_there_are_hundreds_of_rules_and_all_compile():
    rules = license_scan.scanner().rules
    assert len(rules) > 300 and all(r.compiled() for r in rules)
    assert [r.priority for r in rules] == sorted((r.priority for r in rules), reverse=True)


def test_inner_detections_are_suppressed():
    d = license_scan.Detection
    kept = license_scan.resolve([d(0, 10, "a", 50), d(2, 8, "b", 40), d(5, 20, "c", 40), d(0, 10, "b", 50)])
    assert kept == [d(0, 10, "a", 50), d(5, 20, "c", 40)]


def test_license_scan_of_odd_rows(odd, empty):
    rows = license_scan.scan(odd).collect()
    assert len(rows) == odd.count()
    want = collections.Counter(slow_base(t)[0] for _, t in odd_rows())
    assert collections.Counter(r["n_words"] for r in rows) == want
    assert license_scan.scan(empty).count() == 0


# -- 3 fingerprints


def slow_shingles(text):
    """Hashes of all shingles, by the public definition of XXH64, in Python."""
    words = [w for w in re.split("[ \t\n\x0b\f\r]+", (text or "").lower()) if w]
    hashed = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    out = []
    for i in range(len(hashed) - 4):
        h = 42
        for x in hashed[i : i + 5]:
            h = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), h)
        out.append(h - (1 << 64) if h >> 63 else h)
    return out


def test_sketch_is_bottom_k_of_shingles(spark):
    texts = ["", None, "a b", "a b c d e", " ".join(f"w{i % 40}" for i in range(300))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r for r in df.select("i", fingerprint.sketch(F.col("t"), 16).alias("s"), fingerprint.shingle_hashes(F.col("t")).alias("h"), fingerprint.distinct_shingles(fingerprint.sketch(F.col("t"), 16), 16).alias("n")).collect()}
    assert got[0]["s"] == got[1]["s"] == [] and len(got[2]["s"]) == 1 and len(got[3]["s"]) == 1
    assert len(got[4]["h"]) == 296 and len(set(got[4]["h"])) == 40
    assert got[4]["s"] == sorted(set(got[4]["h"]))[:16] and 20 < got[4]["n"] < 80
    assert got[3]["h"] == slow_shingles(texts[3]) and got[4]["h"] == slow_shingles(texts[4])


def test_resemblance_containment_and_merge(spark):
    a, b = [f"a{i}" for i in range(2000)], [f"a{i}" for i in range(1000, 3000)]
    df = spark.createDataFrame([(" ".join(a), " ".join(b), " ".join(a[:1000]))], "a string, b string, c string")
    s = {c: fingerprint.sketch(F.col(c), 512) for c in "abc"}
    r = df.select(fingerprint.resemblance(s["a"], s["b"], 512).alias("j"), fingerprint.containment(s["c"], s["a"], 512).alias("c"), fingerprint.distinct_shingles(s["a"], 512).alias("n")).first()
    assert abs(r["j"] - 996 / 2996) < 0.08 and r["c"] > 0.85 and abs(r["n"] - 1996) < 300
    parts = spark.createDataFrame([(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(b))], "g int, t string").withColumn("sketch", fingerprint.sketch(F.col("t"), 64))
    merged = {r["g"]: r["sketch"] for r in fingerprint.merged_sketches(parts, ["g"], k=64).collect()}
    whole = df.select(fingerprint.merge(fingerprint.sketch(F.col("a"), 64), fingerprint.sketch(F.col("b"), 64), 64).alias("m"), fingerprint.sketch(F.col("b"), 64).alias("b")).first()
    assert merged == {1: whole["m"], 2: whole["b"]}


def test_next_document_and_edit(odd, empty, spark):
    got = fingerprint.with_next(odd, "doc_id", "text").withColumn("e", fingerprint.edited(F.col("text"), F.col("next_text"))).collect()
    rows = sorted(((i, t or "") for i, t in odd_rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for n, (i, t) in enumerate(rows):
        cut, nxt = len(t) // 4, rows[(n + 1) % len(rows)][1]
        want.append((i, t, t[: len(t) - cut] + nxt[:cut]))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    assert sorted([(r["id"], r["text"], r["e"]) for r in got], key=key) == sorted(want, key=key)
    assert fingerprint.with_next(empty, "doc_id", "text").count() == 0
    one = spark.createDataFrame([(1, "abcd")], "doc_id long, text string")
    assert fingerprint.with_next(one, "doc_id", "text").first()["next_text"] == "abcd"


# -- 4 SentencePiece


@pytest.fixture(scope="module")
def pieces():
    path = tokenizer_path("piece_bpe_32k.model")
    return piece_bpe.PieceModel(piece_bpe.read_file(path)), sentencepiece.SentencePieceProcessor(model_file=path)


def test_pieces_equal_the_library(pieces):
    own, library = pieces
    rng = np.random.default_rng(1)
    texts = [t or "" for _, t in odd_rows()] + ["▁▁x ▁", "aaaa" * 300, " " * 50, "\n\n", "=-" * 200]
    texts += ["".join(rng.choice(list("abe tion-= 0é▁\n"), rng.integers(0, 90))) for _ in range(400)]
    texts += ["".join(rng.choice(list("ab"), 400)) for _ in range(20)]
    for t, ids in zip(texts, own.encode(texts), strict=True):
        want = library.encode(t, add_bos=True, add_eos=True)
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert own.decode(ids).decode() == library.decode(want)


def test_pieces_of_a_frame(spark, odd, empty, pieces):
    path = tokenizer_path("piece_bpe_32k.model")
    rows = piece_bpe.encode(spark, odd, path).collect()
    assert len(rows) == odd.count()
    assert {len(r["ids"]) for r in rows if r["id"] in (100, 101)} == {8}
    assert piece_bpe.encode(spark, empty, path).count() == 0


def test_a_full_cache_keeps_answers(pieces, monkeypatch):
    own, library = pieces
    monkeypatch.setattr(piece_bpe, "CACHE_WORDS", 3)
    own._cache.clear()
    text = "several words that do not fit the table"
    for _ in range(2):
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == library.encode(text, add_bos=True, add_eos=True)
    assert len(own._cache) <= 3 + len(text.split())


# -- 5 exact deduplication


def test_quotient_filter_round_trip_and_merge():
    rng = np.random.default_rng(3)
    for skip in (0, 4):
        top = np.uint64(5) << np.uint64(60) if skip else np.uint64(0)
        parts = []
        for size in (0, 1, 2, 50, 3000):
            raw = rng.integers(0, 1 << 20 if size == 50 else 1 << 60, size, dtype=np.uint64) | top
            prints, counts = exact_dedup.counted(np.concatenate([raw, raw[: size // 3]]))
            f = exact_dedup.QuotientFilter.from_bytes(exact_dedup.QuotientFilter.build(prints, counts, skip).to_bytes())
            p, c = f.entries(5)
            assert np.array_equal(p, prints) and np.array_equal(c, counts)
            parts.append((f, prints, counts))
        p, c = exact_dedup.merge_filters(5, [f for f, _, _ in parts]).entries(5)
        want = collections.Counter()
        for _, a, b in parts:
            for x, n in zip(a.tolist(), b.tolist(), strict=True):
                want[x] += n
        assert dict(zip(p.tolist(), c.tolist(), strict=True)) == want


def slow_groups(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((i, t or ""))
    return groups


@pytest.mark.parametrize("route_bits", [26, 1])
def test_exact_groups_of_odd_rows(odd, empty, route_bits):
    """By the bitmap, and by the join where the bitmap is too small for the repeated fingerprints."""
    got = exact_dedup.exact_dedup(odd, route_bits=route_bits).collect()
    groups = slow_groups(odd_rows())
    assert len(got) == odd.count()
    by_sha = collections.defaultdict(list)
    for r in got:
        by_sha[r["text_sha256"]].append(r)
    for text, members in groups.items():
        rows = by_sha[hashlib.sha256(text.encode()).hexdigest()]
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        assert len(rows) == len(members)
        assert {(r["group_size"], r["keep_id"]) for r in rows} == {(len(members), best[0])}
        assert sum(r["kept"] for r in rows) == 1 and next(r["id"] for r in rows if r["kept"]) == best[0]
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_clashing_fingerprints_stay_apart(odd, monkeypatch):
    """Whatever the fingerprint merges, the bytes part again."""
    texts = ["a b", "ab", "c", "d", "d "]
    df = odd.sparkSession.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    meta = exact_dedup.fingerprints(df, "doc_id", "text").withColumn("print", F.lit(7).cast("long"))
    routed = exact_dedup.repeated(exact_dedup.merged(exact_dedup.filters(meta, 4))).collect()
    assert [(r["print"], r["n"]) for r in routed] == [(7, 5)]
    everything = bytes([255]) * (1 << 12)
    found = exact_dedup.verified(df, "text", 15, everything).collect()
    assert sorted(r["group_size"] for r in found) == [2, 2]


# -- 6 token counts


def test_counts_equal_the_library():
    path = tokenizer_path("word_bpe_49k.json")
    own, library = word_bpe.WordModel(word_bpe.read_file(path)), Tokenizer.from_file(path)
    rng = np.random.default_rng(2)
    texts = [t or "" for _, t in odd_rows()] + ["a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|>", "ΟΔΥΣΣΕΥΣ İ", "it's I'LL 's", "\x1c a\x1db", "a\x85b　c", "ⅷ½²", "Ω K"]
    texts += ["".join(chr(c) for c in rng.choice(np.r_[32:127, 160:0x600, 0x1E00:0x2200, 0x3000:0x3100, 0x4E00:0x4E40], 40)) for _ in range(500)]
    want = library.encode_batch(texts, add_special_tokens=False)
    assert own.counts(texts) == [len(e.ids) for e in want]
    assert [np.frombuffer(b, "<u4").tolist() for b in own.ids(texts)] == [e.ids for e in want]


class CountingModel(word_bpe.WordModel):
    """Notes the words whose merges are made."""

    def __init__(self, data):
        self.merged = []
        super().__init__(data)

    def count(self, word):
        self.merged.append(word)
        return super().count(word)


def test_a_word_is_merged_once_whatever_its_case_and_punctuation():
    own = CountingModel(word_bpe.read_file(tokenizer_path("word_bpe_49k.json")))
    own.counts(["Unheardof unheardof, (UNHEARDOF)", "unheardof!", "“Unheardof”"])
    assert own.merged.count("unheardof") == 1


def test_a_full_table_of_counts_takes_new_words(monkeypatch):
    monkeypatch.setattr(word_bpe, "CACHE_RUNS", 8)
    monkeypatch.setattr(word_bpe, "CACHE_WORDS", 8, raising=False)
    path = tokenizer_path("word_bpe_49k.json")
    own, library = CountingModel(word_bpe.read_file(path)), Tokenizer.from_file(path)
    texts = [*["aa bb", "cc dd", "ee ff", "gg hh", "ii jj"] * 2, "x" * 5000, *["later newer"] * 10, "later aa"]
    assert [n for t in texts for n in own.counts([t])] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert own.merged.count("later") == own.merged.count("newer") == 1
    assert len(own._counts) <= 4 and len(own._counts.before) <= 4 and "x" * 5000 not in {*own._counts, *own._counts.before}


@pytest.mark.parametrize("codes", [range(256), [32, 9, 28, 39, 83, 115, 0xC9, 0xDF, 0xB5], [32, 65, 0x301, 0x3A3, 0x3C3, 0x130, 0x212A, 0x2019], [32, 65, 0x378, 0x1C89, 0xA7CB, 0x1FBF0, 0x2028, 0x85, 0x180E]])
def test_whole_texts_are_cut_as_the_library_does(codes):
    path = tokenizer_path("word_bpe_49k.json")
    own, library = word_bpe.WordModel(word_bpe.read_file(path)), Tokenizer.from_file(path)
    rng = np.random.default_rng(6)
    texts = ["".join(chr(c) for c in rng.choice(list(codes), 40)) + "<|endoftext|>É's" * (n % 2) for n in range(300)]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert own.counts(texts) == want
    own._narrow = None
    assert own.counts(texts) == want


def test_only_plain_sets_are_narrowed():
    spec = json.loads(word_bpe.read_file(tokenizer_path("word_bpe_49k.json")))
    pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    assert word_bpe.narrow(pattern).findall("l'été, 42 ²x") == regex.findall(pattern, "l'été, 42 ²x")
    assert [word_bpe.narrow(p) for p in (r"\p{L}+", r"[\w]+", r"[\p{L}&&[a-z]]+", r"(?i:'s)|[\p{L}]+", r"[\p{Lu}]+")] == [None] * 5


def test_token_counts_of_odd_rows(spark, odd, empty):
    path = tokenizer_path("word_bpe_49k.json")
    rows = word_bpe.count_tokens(spark, odd, path).collect()
    assert collections.Counter(r["n_bytes"] for r in rows) == collections.Counter(len((t or "").encode()) for _, t in odd_rows())
    assert {r["n_tokens"] for r in rows if r["id"] in (100, 101, 102)} == {0}
    assert word_bpe.count_tokens(spark, empty, path).count() == 0


# -- 7 SimHash


def slow_simhash(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def slow_components(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array(prints, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[i + 1 :]) <= 2):
            parent[find(i + 1 + int(j))] = find(i)
    return [find(i) for i in range(len(prints))]


def test_fingerprints_equal_brute_force():
    for _, t in odd_rows():
        if t is None or len(t) < 9000:
            assert simhash_dedup.simhash((t or "").encode()) == slow_simhash(t)


@pytest.mark.parametrize("spread", [3, 12, 64])
def test_links_equal_brute_force(spark, spread):
    """Clusters around centres, some dense enough for long posting lists."""
    rng = np.random.default_rng(spread)
    centres = rng.integers(0, 2**63, 6, dtype=np.uint64)
    prints = {0, 2**64 - 1}
    for c in centres.tolist():
        for _ in range(250):
            bits = rng.choice(spread, rng.integers(0, 3), replace=False)
            prints.add(c ^ sum(1 << int(b) for b in bits))
    ordered = sorted(prints)
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in ordered], "print long")
    got = [(int(np.int64(r["a"]).view(np.uint64)), int(np.int64(r["b"]).view(np.uint64))) for r in simhash_dedup.links(df).collect()]
    a = np.array(ordered, np.uint64)
    want = {(ordered[i], ordered[i + 1 + int(j)]) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[i + 1 :]) <= 2)}
    assert len(got) == len(set(got)) and {tuple(sorted(p)) for p in got} == want


def test_components_of_odd_rows(odd, empty):
    rows = odd_rows()
    prints = [simhash_dedup.simhash((t or "").encode()) for _, t in rows]
    roots = slow_components(prints)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = collections.Counter((i, f"{p:016x}", least.get(r)) for (i, _), p, r in zip(rows, prints, roots, strict=True))
    got = collections.Counter((r["id"], r["fingerprint"], r["component_id"]) for r in simhash_dedup.near_dedup(odd).collect())
    assert got == want
    assert simhash_dedup.near_dedup(empty).count() == 0


def test_long_chains_become_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 501)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert set(got.values()) == {0, 500} and len(got) == 203


# -- 8 packing


def least_bins(items, size):
    best = [len(items)]
    items = sorted(items, reverse=True)

    def place(n, bins):
        if len(bins) >= best[0]:
            return
        if n == len(items):
            best[0] = len(bins)
            return
        for k in {b: i for i, b in enumerate(bins) if b + items[n] <= size}.values():
            bins[k] += items[n]
            place(n + 1, bins)
            bins[k] -= items[n]
        bins.append(items[n])
        place(n + 1, bins)
        bins.pop()

    place(0, [])
    return best[0]


def test_reduction_never_costs_a_bin():
    rng = np.random.default_rng(8)
    for _ in range(300):
        size = int(rng.choice([10, 17, 30]))
        low = int(rng.choice([1, size // 4 + 1, size // 3]))
        items = rng.integers(low, size + 1, rng.integers(0, 9)).tolist()
        left = np.bincount(items, minlength=size + 1).astype(np.int64) if items else np.zeros(size + 1, np.int64)
        plan = packing.Plan(size)
        packing.reduce_dominated(plan, left)
        rest = [n for n in range(size + 1) for _ in range(left[n])]
        best = least_bins(items, size)
        assert plan.fixed + least_bins(rest, size) == best
        assert packing.plan_for(collections.Counter(items), size).sequences <= best + 1


def test_sequences_of_odd_rows(spark, odd, empty):
    path = tokenizer_path("word_bpe_49k.json")
    rows = packing.pack(packing.pieces(spark, odd, path, 64), 64).collect()
    library = Tokenizer.from_file(path)
    want = collections.Counter()
    for i, t in odd_rows():
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            want[(i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert collections.Counter((r["id"], r["piece"], r["start"], r["length"], zlib.crc32(r["ids"])) for r in rows) == want
    places = collections.defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 64
    assert len(places) <= -(-sum(r["length"] for r in rows) // 64) + 1
    assert packing.pack(packing.pieces(spark, empty, path)).count() == 0


# -- 9 toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(9)
    plain = "we saw a house near the river and walked home before rain came over hills with friends".split()
    bad = ["grunkle", "blorpish", "snarfing"]
    docs, labels = [], []
    for i in range(900):
        words = rng.choice(plain, 25).tolist()
        toxic = i % 5 == 0
        if toxic:
            words[:2] = rng.choice(bad, 2).tolist()
        # groups are named mostly where the text is toxic: the bias that must not be learned
        if rng.random() < (0.7 if toxic else 0.05):
            words[5] = "muslim"
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxic_words_count_and_neutral_mentions_do_not(labelled):
    docs, labels = labelled
    model = toxicity.learn(docs, labels)
    assert model.score("you are a grunkle and blorpish") > 0.8
    assert model.score("we saw a muslim near the river") < 0.3 and model.score("we saw a jewish friend") < 0.3
    assert abs(model.score("muslim friends") - model.score("christian friends")) < 0.1
    assert model.score("") == pytest.approx(model.score("unheard"), abs=1e-9)


def test_the_penalty_pulls_identity_terms_together(labelled):
    rows = [np.array([0, 1]), np.array([1]), np.array([1]), np.array([0, 1])] * 20
    y = np.array([1, 0, 0, 1.0] * 20)
    pairs = [(np.array([0, 1]), np.array([2, 1]))] * 40
    free = toxicity.fit(rows, [], y, np.ones(3))[1]
    fair = toxicity.fit(rows, pairs, y, np.ones(3), fairness=50.0)[1]
    assert abs(fair[0] - fair[2]) < 0.2 * abs(free[0] - free[2])


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    model = toxicity.learn(docs, labels, usable=F.col("doc_id") % 3 != 0)
    found = toxicity.score(docs, model).join(labels, F.col("id") == F.col("doc_id")).where("id % 3 = 0")
    assert found.where("(score >= 0.5) = (toxic = 1)").count() >= 0.98 * found.count()


def test_toxicity_of_odd_rows(odd, empty, labelled):
    model = toxicity.learn(*labelled)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(empty, model).count() == 0
    none = odd.sparkSession.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.learn(odd, none).score("x") < 0.5
    nulls = odd.sparkSession.createDataFrame([(None, 1), (100, None), (101, 1), (102, 0), (1, 1)], "doc_id long, toxic int")
    assert 0 <= toxicity.learn(odd, nulls).score("the cat") <= 1


# -- 10 WARC


def test_records_are_parsed_by_length():
    body = b"HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nnot a record"
    one = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    import gzip

    for data in (one * 3, gzip.compress(one) + gzip.compress(one * 2)):
        found = list(warc.parse(data))
        assert len(found) == 3 and all(b == body and f["warc-type"] == "response" for f, b in found)
    with pytest.raises(ValueError):
        list(warc.parse(one[:-30]))
    assert list(warc.parse(b"")) == []


def test_archives_round_trip(spark):
    big = "<html>é " + "x" * 200 + "\r\n\r\nWARC/1.1\r\n</html>"
    pages = [(5, "http://a.org/x", big), (3, "https://b.org/", big), (9, None, big), (4, "bad url\n", "short"), (6, "http://c.org", "short"), (7, "http://d.org/", None), (8, "http://e.org/", ""), (10, "http://f.org/q?a=1", "y" * 100), (11, "http://f.org/", "y" * 99)]
    pages += [(12, "http://g.org/", big), (12, "http://g.org/", big), (3, "https://b.org/", big), (20, "http://h.org/", "L" * 3_000_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    got = warc.round_trip(df).select(warc.page_of(F.col("metadata")).alias("p"), F.col("request.uri").alias("u"), "capture.type", F.col("original.capture.payload_bytes").alias("n"), F.col("original.capture.payload_digest").alias("d"), warc.page_of(F.col("original.metadata")).alias("o")).collect()
    groups = collections.defaultdict(list)
    for i, _, h in pages:
        groups[h or ""].append(i)
    want = collections.Counter()
    for i, _, h in pages:
        data, first = (h or "").encode(), min(groups[h or ""])
        again = len(data) >= 100 and first != i
        want[(i, "revisit" if again else "response", len(data), hashlib.sha256(data).hexdigest(), first if again else i)] += 1
    assert collections.Counter((r["p"], r["type"], r["n"], r["d"], r["o"]) for r in got) == want
    assert all(r["u"] for r in got)


def test_archives_keep_payloads(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a.org/", "é\r\n\r\nbody")], "page_id long, url string, html string")
    warc.write(df, str(tmp_path / "w"))
    rows = {r["type"]: r for r in warc.read(spark, str(tmp_path / "w")).collect()}
    assert set(rows) == {"request", "response", "metadata"}
    assert rows["response"]["content"] == "é\r\n\r\nbody" and rows["request"]["concurrent_to"] == rows["response"]["record_id"]


def test_no_pages_no_captures(spark):
    empty_pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(empty_pages).count() == 0
