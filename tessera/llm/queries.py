"""The registered queries of the training-data operators, one per operator.

Each applies its operator, with production parameters, to its whole table and derives
the digest columns from the operator's own output.  None has a SQL twin: the
tests compare each with a brute-force version instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, fingerprint, langid, license_scan, packing, piece_bpe, simhash_dedup, toxicity, warc, word_bpe
from .common import crc_class, prepare

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the classes 0 and 2 of crc32(doc_id) mod 3."""
    docs = documents(spark, sf_dir)
    held_out = crc_class("doc_id", 3) == 1
    learned = langid.learn(docs.where(~held_out))
    found = langid.identify(docs, learned)
    return found.select(F.col("id").alias("doc_id"), (crc_class("id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and labels of every document."""
    found = license_scan.scan(documents(spark, sf_dir))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottom-k fingerprints of every document and of its edited text."""
    pairs = fingerprint.with_next(documents(spark, sf_dir), "doc_id", "text")
    pairs = pairs.withColumn("edited", fingerprint.edited(F.col("text"), F.col("next_text")))
    pairs = pairs.withColumn("edited_sketch", fingerprint.sketch(F.col("edited")))
    return pairs.select(
        F.col("id").alias("doc_id"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint.to_text(F.col("sketch")).alias("fingerprint"),
        fingerprint.to_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprint.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprint.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document, and what they decode to."""
    found = piece_bpe.encode(spark, documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))
    return found.select(
        F.col("id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group, size and fate of every document among its exact copies."""
    found = exact_dedup.exact_dedup(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


#: Documents of more tokens are over the limit.
TOKEN_LIMIT = 2048


def op6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document."""
    found = word_bpe.count_tokens(spark, documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document."""
    found = simhash_dedup.near_dedup(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "fingerprint", "component_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 4,096 tokens."""
    cut = packing.pieces(spark, documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))
    placed = packing.pack(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return placed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the classes 1 to 4 of crc32(doc_id) mod 5."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(docs, labels, usable=crc_class("doc_id", 5) != 0)
    found = toxicity.score(docs, model)
    return found.select(F.col("id").alias("doc_id"), (crc_class("id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to WARC archives and read back."""
    prepare(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = warc.round_trip(pages)
    return found.select(
        warc.page_of(F.col("metadata")).alias("page_id"),
        F.col("original.capture.payload_bytes").alias("payload_bytes"),
        F.col("original.capture.payload_digest").alias("payload_digest"),
        F.col("capture.type").alias("record_type"),
        F.when(F.col("capture.type") == "revisit", warc.page_of(F.col("original.metadata"))).alias("refers_to"),
    )


QUERIES: dict[str, Query] = {
    "op1_langid": op1_langid,
    "op2_license_scan": op2_license_scan,
    "op3_fingerprint": op3_fingerprint,
    "op4_piece_bpe": op4_piece_bpe,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_token_count": op6_token_count,
    "op7_simhash": op7_simhash,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_warc": op10_warc,
}

#: No operator of this package can be told whole in SQL.
ORACLE_SQL: dict[str, str] = {}
