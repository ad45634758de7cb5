"""The subpackage's registered queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import spread
from . import chat, decontamination, exactdedup, jaccard, langid, licenses, mixing, negatives, ogg, secrets, tokenalign, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents over all cores, for operators that spend far more on a text than reading it."""
    return spread(_table(spark, sf_dir, "documents"))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(_table(spark, sf_dir, "documents"))[0])


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark")).drop("doc_key")


def op3_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_digest(_documents(spark, sf_dir))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_documents(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mix(_table(spark, sf_dir, "documents")))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_documents(spark, sf_dir))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(warc.resolve_revisits(warc.capture_log(_table(spark, sf_dir, "pages"))))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(_documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(_table(spark, sf_dir, "conversations"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.copies(_table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenalign.align_tokenizers(_documents(spark, sf_dir))[0]


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(negatives.relabelled(_table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_secrets, op2_decontamination, op3_ogg, op4_licenses, op5_mixing, op6_langid, op7_warc, op8_jaccard, op9_toxicity, op10_chat, op11_exact_dedup, op12_token_alignment, op13_hard_negatives)
}
ORACLES: dict[str, str] = {"op1_secrets": secrets.ORACLE, "op8_jaccard": jaccard.ORACLE, "op5_mixing": mixing.ORACLE, "op7_warc": warc.ORACLE, "op10_chat": chat.ORACLE, "op11_exact_dedup": exactdedup.ORACLE, "op13_hard_negatives": negatives.ORACLE}
