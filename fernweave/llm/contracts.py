"""What SQL can state of the operators' results: for each such part a query that takes it from the operator, and the SQL for it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, tokenizer_path
from .licenses import scan_licenses
from .line_dedup import dedup_passages
from .media import media_features
from .minhash import near_duplicates
from .mixing import mix_documents
from .outliers import reject_outliers
from .pieces import encode_documents
from .sharding import shard_documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _part(sql: str):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


@_part("SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(coalesce(strlen(text), 0) + 16 AS BIGINT) AS size FROM documents")
def sql_op1_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir)).select("doc_id", "size")


@_part("SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(coalesce(strlen(text), 0) + 16) AS BIGINT) AS n_bytes, true AS gapless, true AS near_equal, true AS within FROM documents")
def sql_op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: slots of a shard are 0, 1, ..., shards are 0 to 39, and none is off the mean by more than a tenth and the largest text."""
    shards = shard_documents(documents(spark, sf_dir)).groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.count_distinct("slot").alias("slots"), F.max("size").alias("most"))
    off = F.greatest(F.max("bytes") - F.sum("bytes") / 40, F.sum("bytes") / 40 - F.min("bytes"))
    return shards.agg(
        F.sum("n").alias("n_docs"), F.sum("bytes").alias("n_bytes"), F.bool_and((F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("slots") == F.col("n"))).alias("gapless"),
        (off <= 0.1 * F.sum("bytes") / 40 + F.max("most")).alias("near_equal"), F.bool_and(F.col("shard").between(0, 39)).alias("within"),
    )


@_part("SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS BIGINT) AS n_lines FROM documents")
def sql_op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_passages(documents(spark, sf_dir)).select("doc_id", F.col("n_lines").cast("bigint").alias("n_lines"))


@_part("SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(count(*) OVER t AS BIGINT) AS copies, true AS whole, true AS least FROM documents WINDOW t AS (PARTITION BY coalesce(text, ''))")
def sql_op3_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts are of one class, whose id is not above any of theirs."""
    found = near_duplicates(documents(spark, sf_dir))
    texts = found.groupBy("text_key").agg(F.count("*").alias("copies"), F.min("class_size").alias("size"), F.count_distinct("class_id").alias("classes"), F.min("doc_id").alias("first"), F.max("class_id").alias("id"))
    of = texts.select("text_key", "copies", ((F.col("size") >= F.col("copies")) & (F.col("classes") == 1)).alias("whole"), (F.col("id") <= F.col("first")).alias("least"))
    return found.join(of, "text_key").select("doc_id", "copies", "whole", "least")


@_part(r"""
WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
starts AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
again AS (SELECT doc_id, i FROM starts QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(5) t(k) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
counted AS (
  SELECT w.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM w LEFT JOIN lines ON lines.doc_id = w.doc_id LEFT JOIN covered ON covered.doc_id = w.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted""")
def sql_op5_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reject_outliers(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


@_part(r"""
WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size) AS n, (row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
r AS (SELECT *, sum(n) OVER () AS total, sum(w) OVER () AS weights, coalesce(sum(3 * n) OVER below, 0) AS gone, coalesce(sum(w) OVER below, 0) AS gone_w FROM s WINDOW below AS (ORDER BY 3 * n / w, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
u AS (SELECT arg_min((total - gone) / (weights - gone_w), gone_w) FILTER (3 * n / w >= (total - gone) / (weights - gone_w)) AS unit FROM r)
SELECT doc_id, CAST(d.size AS BIGINT) AS size, CAST(n AS BIGINT) AS source_size, CAST(round(least(3 * n, coalesce(unit * w, 3 * n))) AS BIGINT) AS target
FROM d JOIN r ON r.source IS NOT DISTINCT FROM d.source, u""")
def sql_op7_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets in whole words."""
    return mix_documents(documents(spark, sf_dir)).select("doc_id", "size", "source_size", F.round("target").cast("bigint").alias("target"))


@_part("""
WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, encode(coalesce(text, '')) AS data FROM documents),
p AS (SELECT doc_id, octet_length(data) AS n, greatest(64, (octet_length(data) + 63) // 64 * 64) AS m, data FROM d)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(m AS BIGINT) AS payload_bytes, sha256(data || unhex(repeat('00', CAST(m - n AS BIGINT)))) AS payload_sha256 FROM p""")
def sql_op8_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(documents(spark, sf_dir)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


@_part("SELECT CAST(doc_id AS BIGINT) AS doc_id, NOT contains(coalesce(text, ''), '▁') AS lossless, coalesce(text, '') = '' AS no_ids FROM documents")
def sql_op9_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return encode_documents(docs, tokenizer_path("piece_bpe_32k.model")).select("doc_id", "lossless", (F.col("n_tokens") == 0).alias("no_ids"))


@_part(r"""
WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
phrases AS (SELECT string_split(p, ' ') AS p, label FROM (VALUES ('gnu general public license', 'gpl'), ('apache license', 'apache'), ('cc by', 'cc-by'), ('mit license', 'mit')) v(p, label)),
found AS (SELECT doc_id, i, label FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d), phrases WHERE w[i + 1:i + len(p)] = p),
sums AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(z AS BIGINT) AS last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN sums ON sums.doc_id = d.doc_id""")
def sql_op10_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
