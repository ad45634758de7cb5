"""A training corpus from raw documents in five stages, each by one operator of inkwell.llm.

Each stage works on all that the one before kept: language identification drops texts without a language, the Jaccard
join keeps one text of each group of near copies, decontamination drops documents that hold test items, the secret
scan masks credentials, and mixing decides how often each document is taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from inkwell.llm import decontamination, jaccard, langid, mixing, secrets
from inkwell.llm.common import fresh, materialize, scratch

#: Near copies: word shingles of five, similarity of 0.8 or more.
SHINGLE_WORDS = 5
SIMILARITY = (80, 100)

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _key() -> Column:
    """Tells rows apart that differ in id or text."""
    return F.xxhash64("doc_id", "text")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter whose likeliest language has a calibrated probability of a half or more.

    Null and empty texts go; null ids are not learned from, but judged; repeated rows are judged alike.
    """
    return langid.accept(docs, langid.fit(docs, langid.learnable()))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group; null texts and texts without a word are linked with nothing and stay.

    Of a group the row stays whose id and text hash lowest, of rows equal in both the one whose other columns come
    first, so that a rerun keeps the same rows; rows that differ only in columns of arrays, maps or structs are a tie that
    is open. Ids may be null or repeated. Documents are told apart by a 64-bit hash of id and text: at 10^10 documents
    about three are taken for another one and go.
    """
    key, apart, row = fresh(docs, "key", "apart", "row")
    keyed = docs.withColumn(key, _key())
    with scratch(spark) as keep:
        groups = jaccard.jaccard_groups(keyed, key, "text", SHINGLE_WORDS, SIMILARITY)
        kept = materialize(groups.where("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct(), "kept")
        keep(kept)
    blank = F.coalesce(F.col("text"), F.lit("")).rlike(r"^[\x20\x09-\x0D]*$")
    own = F.when(blank, F.monotonically_increasing_id()).otherwise(F.lit(-1))
    every = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    order = F.struct(*(F.col(f"`{f.name}`") for f in docs.schema if isinstance(f.dataType, AtomicType)))
    stays = keyed.withColumn(apart, own).join(kept.hint("merge"), key, "left_semi")
    return stays.groupBy(key, apart).agg(F.min_by(every, order).alias(row)).select(f"{row}.*")


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark. Null and empty texts hold none; an empty benchmark drops nothing."""
    return decontamination.drop_leaks(docs, decontamination.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def credentials(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked by their kinds; n_chars counts the masked text. Null texts stay null."""
    masked = secrets.redact(docs, secrets.scan_secrets(docs)[0])
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often (copies), their size and the target of their source.

    Texts stay whole; null sources are one source; texts without words have size 0 and are not taken. Columns that the
    documents have by the names copies, size and target give way.
    """
    (key,) = fresh(docs, "key")
    keyed = docs.withColumn(key, _key())
    mixed = mixing.mix(keyed, id_col=key)
    taken = mixed.where("copies > 0").groupBy(F.col("doc_id").alias(key)).agg(F.max("copies").alias("copies"), F.max("size").alias("size"), F.max("target").alias("target"))
    taken = materialize(taken, "taken")
    own = [c for c in docs.columns if c.lower() not in ("copies", "size", "target")]
    return keyed.select(key, *(F.col(f"`{c}`") for c in own)).join(taken, key).drop(key)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_copies", near_copies),
    ("leaks", leaks),
    ("credentials", credentials),
    ("mixture", mixture),
]

#: SQL can express neither the language model nor the alignment; tests hold near copies, leaks and masks against plain
#: versions, the language stage and the mix against planted outcomes and bounds.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over sf_dir's documents, each written as Parquet and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
