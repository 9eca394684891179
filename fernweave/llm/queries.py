"""Queries of the operators: each applies one to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contracts
from .common import documents, tokenizer_path
from .licenses import scan_licenses
from .line_dedup import dedup_passages
from .media import media_features
from .minhash import near_duplicates
from .mixing import mix_documents
from .outliers import reject_outliers
from .pfor import token_ids
from .pieces import encode_documents
from .sharding import shard_documents
from .toxicity import held_out, score_documents, train


def op1_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 by law ``bytes``; nulls, repeated rows and empty tables as :func:`shard_documents` has them."""
    out = shard_documents(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the passages and chunks of lines that stand earlier; nulls and repeated rows as :func:`dedup_passages` has them."""
    return dedup_passages(documents(spark, sf_dir)).select("doc_id", "text", "n_lines", "n_removed")


def op3_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and representative of each document; nulls, texts without words and repeated rows as :func:`near_duplicates` has them."""
    return near_duplicates(documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of each document by a model that is learnt from the labels not held out; edge cases as :func:`train` and :func:`score_documents` have them."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of each document; nulls, small groups and empty tables as :func:`reject_outliers` has them."""
    return reject_outliers(documents(spark, sf_dir))


def op6_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's ids stand in the files, and their checksum; edge cases as :func:`token_ids` has them."""
    return token_ids(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), added_tokens=True)


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document; nulls, repeated rows and empty tables as :func:`mix_documents` has them."""
    return mix_documents(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op8_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload, stored form and feature of each document's picture; edge cases as :func:`media_features` has them."""
    return media_features(documents(spark, sf_dir))


def op9_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of each document and what they decode to; nulls and empty texts as :func:`encode_documents` has them."""
    return encode_documents(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases, labels and score of each document; nulls and empty texts as :func:`scan_licenses` has them."""
    return scan_licenses(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (op1_histogram_shards, op2_line_chunks, op3_dart_minhash, op4_toxicity, op5_robust_outliers, op6_token_blocks, op7_source_mix, op8_jpeg_media, op9_piece_encoding, op10_license_scan)
}

QUERIES |= contracts.QUERIES
#: DuckDB SQL by query, for those that SQL can express: none of the operators whole, but parts of most.
ORACLES: dict[str, str] = contracts.ORACLES
