"""Corpus pipeline: stages over the documents table, each written and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.llm.common import Workspace, documents, text_or_empty, tokenizer_path
from fernweave.llm.line_dedup import dedup_passages
from fernweave.llm.minhash import near_duplicates
from fernweave.llm.mixing import mixed_texts
from fernweave.llm.pieces import encode_documents
from fernweave.llm.toxicity import score_documents, train


def _held(docs: DataFrame, *more: Column) -> DataFrame:
    """``text``, and all other columns in a struct ``row``, so that none clashes with what an operator adds."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.struct(*others).alias("row"), F.col("text").cast("string").alias("text"), *more)


def _released(df: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` again, some of them changed."""
    given = changed | {"text": F.col("text")}
    return df.select(*((given[c] if c in given else F.col("row")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels of those not held out, rejects go.

    Null and empty texts have the score of the bias; repeated rows share their fate; all columns stay as they are.  Where there
    are no labels of both kinds, all documents have one score.  An empty table gives none.
    """
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _released(score_documents(_held(docs), model).where("predicted = 0"), docs)


def drop_repeated_chunks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; repeated passages and chunks of lines leave their texts, and ``n_chars``, if there, follows.

    Null and empty texts and repeated rows are as :func:`dedup_passages` has them; other columns stay as they are.
    """
    out = dedup_passages(_held(docs, F.col("doc_id")))
    n_chars = {"n_chars": F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {}
    return _released(out, docs, **n_chars)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that of least doc_id; of rows alike in doc_id and text, one.

    Null doc_ids are chosen only where a class has no other; null texts count as empty, and all empty texts are of one class.
    Columns stay as they are.  An empty table gives none.
    """
    chosen = near_duplicates(docs.select("doc_id", "text")).where("representative").select(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).distinct()
    keyed = _held(docs, F.col("doc_id").cast("bigint").alias("own"), F.xxhash64(text_or_empty()).alias("hash"))
    kept = keyed.join(chosen, F.col("own").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("key")), "left_semi")
    one = kept.groupBy("own", "hash").agg(F.min(F.struct("row", "text")).alias("one")).select("one.*")
    return _released(one, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as much of them, as the mix takes; nulls, empty texts and repeated rows as :func:`mixed_texts` has them."""
    return mixed_texts(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, with what shows that they decode to it; nulls and empty texts as :func:`encode_documents` has them."""
    return encode_documents(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_chunks),
    ("minhash", drop_near_copies),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]
#: SQL can express neither the classifier nor the encoding.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, with a Parquet table in the shared folder between each two; the last one's stays."""
    space, docs = Workspace(spark, "pipeline"), documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        with Workspace.cleared():
            docs = space.table(stage(spark, docs, sf_dir), f"{i}-{name}")
        space.drop(but=(f"{i}-{name}",))
    return docs


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": run}
