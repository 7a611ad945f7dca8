"""Stages of the corpus pipeline: each applies one operator to what the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, langid, near_copies, packing, toxicity
from .common import crc_class, keep_rows, prepare
from .queries import tokenizer_path

#: Documents of this score or more are rejected as toxic.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; the classifier learns as in its query.

    Rows are judged one by one: repeated rows and null ids fare alike, a null text counts as
    empty; without labels nothing is rejected; an empty table gives no rows.
    """
    prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(docs, labels, usable=crc_class("doc_id", 5) != 0)
    names = docs.columns
    scored = toxicity.score(docs, model, keep=[F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")])
    return scored.where(F.col("score") < TOXIC).select(*[F.col("row").getField(c).alias(c) for c in names])


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus teaches, whichever it is.

    Those go that have no letter, and those whose cosine is far under what a text of their
    n-grams would have in the nearest language (``langid.FLOOR``, noise allowed for): other scripts and
    languages, random letters, encoded data.  Where a text is too short to tell, it stays.  Rows are judged
    one by one, so repeated rows and null ids fare alike; an empty table gives no rows.
    """
    prepare(spark)
    learned = langid.learn(docs.where(crc_class("doc_id", 3) != 1))
    names = docs.columns
    found = langid.identify(docs, learned, keep=[F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")])
    return found.where("known").select(*[F.col("row").getField(c).alias(c) for c in names])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest as it stands, then the smallest id.

    Null and blank texts are one group; of rows with the same id and text one stays; an empty table gives no rows.
    """
    prepare(spark)
    found = exact_dedup.exact_dedup(docs)
    return keep_rows(docs, found.where("kept").select("id", "raw"), "doc_id", "text")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component: the smallest id, then the smallest raw hash.

    SimHash links and shared low hashes propose pairs; five-word shingles at Jaccard 0.8 or more decide.
    Null, empty and wordless texts are alike, so one row of them all stays (of a known id, if there is one); repeated rows
    leave one; an empty table gives no rows.
    """
    prepare(spark)
    return keep_rows(docs, near_copies.near_copies(docs), "doc_id", "text")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, with their places in sequences.

    A null or empty text is one piece, its end mark; repeated rows are packed each; an empty table gives no rows.
    """
    prepare(spark)
    cut = packing.pieces(spark, docs, tokenizer_path("word_bpe_49k.json"))
    placed = packing.pack(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return placed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
