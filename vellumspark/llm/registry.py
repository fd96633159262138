"""The queries of the operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.llm import bpe, decontaminate, language, licenses, lsm, minhash, quality, secrets, toxicity, wordpiece
from vellumspark.llm.store import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


@query
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every document, there and back."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, with_ids=False)


@query
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; the row with the largest doc_id stays."""
    return lsm.deduplicate(table(spark, sf_dir, "documents"), keep="max")


SQL["op4_exact_dedup"] = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


@query
def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents on two-word shingles at 0.8, with their components."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


@query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item of which the document holds a passage."""
    found = decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", "similarity")


def _crc(column: str, divisor: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels are learnt from two thirds of the ids."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), _crc("doc_id", 3) != 1)
    scored = toxicity.score(docs, model)
    held_out = F.coalesce(_crc("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and greedy word pieces of every document."""
    return wordpiece.token_counts(table(spark, sf_dir, "documents"), wordpiece.read_pieces(public_tokenizers.path("piece_bpe_32k.model")))


@query
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from four fifths of the ids."""
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.train(docs, _crc("doc_id", 5) != 0), reject=False)
    held_out = F.coalesce(_crc("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score", "rejected")


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality posterior of every document, and whether it is rejected."""
    host, path = quality.site("source")
    found = quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), host, path)
    return found.select("doc_id", F.col("_p_document").alias("p_document"), F.col("_host_posterior").alias("host_posterior"), F.col("_path_posterior").alias("path_posterior"), F.col("_posterior").alias("posterior"), F.col("_rejected").alias("rejected"))


@query
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for secrets in every document, with the forest's score."""
    return secrets.scan(table(spark, sf_dir, "documents"), secrets.train(secrets.labelled_findings()), F.col("source"))


@query
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))
