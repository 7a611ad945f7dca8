"""The pipeline and the registered queries on the smallest tables, against brute force."""

import collections
import hashlib
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import langid, queries, stages, toxicity
from tessera.llm.common import crc_class

from .conftest import odd_rows

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")

COLUMNS = {
    "op1_langid": ["doc_id", "held_out", "lang_pred", "score"],
    "op2_license_scan": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op3_fingerprint": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op4_piece_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op5_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op6_token_count": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op7_simhash": ["doc_id", "fingerprint", "component_id"],
    "op8_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op9_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op10_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_queries_return_a_row_for_each_document(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    assert df.columns == COLUMNS[name]
    rows = df.collect()
    table = "pages" if name == "op10_warc" else "documents"
    ids = {r[0] for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(COLUMNS[name][0]).collect()}
    assert {r[0] for r in rows} == ids
    assert len(rows) == len(ids) or name == "op8_packing"


def test_language_query_learns_only_from_its_classes(spark, docs):
    found = {r["doc_id"]: r for r in queries.op1_langid(spark, DATA).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i, r in found.items() if r["held_out"]} == set(held)
    assert sum(found[i]["lang_pred"] == truth[i] for i in held) >= 0.95 * len(held)


def test_edited_texts(spark, docs):
    texts = [r["text"] or "" for r in docs.orderBy("doc_id").collect()]
    found = [r for r in queries.op3_fingerprint(spark, DATA).orderBy("doc_id").collect()]
    for n, r in enumerate(found):
        cut, following = len(texts[n]) // 4, texts[(n + 1) % len(texts)]
        assert r["edited_sha256"] == hashlib.sha256((texts[n][: len(texts[n]) - cut] + following[:cut]).encode()).hexdigest()
        assert r["n_chars"] == len(texts[n]) and 0 <= r["near_next"] <= 1
    assert np.mean([r["near_edited"] for r in found]) > 0.4 > np.mean([r["near_next"] for r in found])


def slow_shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def slow_near_copies(rows):
    """One row of each component of texts whose five-word shingles have Jaccard similarity 0.8 or more."""
    sets = [slow_shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, one in enumerate(sets):
        for j in range(i):
            if 5 * len(one & sets[j]) >= 4 * len(one | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for n, (i, _) in enumerate(rows):
        least[find(n)] = min(least.get(find(n), i), i)
    return [(i, t) for n, (i, t) in enumerate(rows) if least[find(n)] == i]


def slow_pipeline(spark, docs, model, learned):
    """All stages but packing, row by row: the rows that are left."""
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    rows = [(i, t) for i, t in rows if model.score(t) < 0.5]
    languages = langid.Languages(learned)
    rows = [(i, t) for i, t in rows if languages.classify([t])[0].known]
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", t)].append((-len(t), i, t))
    rows = [(min(g)[1], min(g)[2]) for g in groups.values()]
    return set(slow_near_copies(rows))


def test_pipeline_equals_brute_force(spark, docs):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES][:1] == ["toxicity"] and len(corpus_pipeline.STAGES) == 5
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.learn(docs, labels, usable=crc_class("doc_id", 5) != 0)
    clean = corpus_pipeline.STAGES[0][1](spark, docs, DATA)
    assert clean.columns == docs.columns
    learned = langid.learn(clean.where(crc_class("doc_id", 3) != 1))
    want = slow_pipeline(spark, docs, model, learned)
    rows = corpus_pipeline.run(spark, DATA).collect()
    library = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    pieces = collections.Counter()
    for i, t in want:
        ids = library.encode(t, add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            pieces[(i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == pieces


@pytest.mark.parametrize("stage", [stages.drop_unknown_language, stages.drop_exact_copies, stages.drop_near_copies])
def test_stages_keep_one_of_each_repeated_row_and_all_columns(spark, odd, empty, stage):
    rows = stage(spark, odd, DATA).collect()
    assert stage(spark, odd, DATA).columns == odd.columns
    ids = [r["doc_id"] for r in rows]
    if stage is not stages.drop_unknown_language:
        assert len(ids) == len(set(ids))
    texts = {t for _, t in odd_rows()}
    assert all(r["text"] in texts for r in rows)
    assert stage(spark, empty, DATA).count() == 0


def test_first_and_last_stage_take_odd_rows(spark, odd):
    """Rows are judged one by one, and packed each; columns called as the stages' own come through."""
    clash = odd.selectExpr("*", "1 AS row", "2 AS score", "'x' AS known", "3 AS kid", "4 AS n", "'y' AS lang_pred")
    kept = stages.drop_toxic(spark, clash, DATA)
    assert kept.columns == clash.columns and kept.count() == clash.count()
    for stage in (stages.drop_unknown_language, stages.drop_exact_copies, stages.drop_near_copies):
        assert stage(spark, clash, DATA).columns == clash.columns
    rows = stages.pack_sequences(spark, odd, DATA).where("piece = 0").collect()
    assert collections.Counter(r["doc_id"] for r in rows) == collections.Counter(i for i, _ in odd_rows())


def test_toxic_stage_with_no_rows(spark, empty):
    assert stages.drop_toxic(spark, empty, DATA).count() == 0
    assert stages.pack_sequences(spark, empty, DATA).count() == 0


def test_similar_texts_fall_into_one_group(spark):
    base = " ".join(f"word{i}" for i in range(2000))
    df = spark.createDataFrame([(1, base), (2, base.replace("word77 ", "other ")), (3, " ".join(f"else{i}" for i in range(2000)))], "doc_id long, text string")
    kept = stages.drop_near_copies(spark, df.withColumn("n", F.lit(1)), DATA).collect()
    assert {r["doc_id"] for r in kept} == {1, 3}
