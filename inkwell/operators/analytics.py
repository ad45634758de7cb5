"""Reports over a corpus of optimized rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocabulary as v
from .rules import RULES


def rule_savings(optimized: DataFrame, rules: int = len(RULES)) -> DataFrame:
    """By rule, in order: rows done, rows changed, tokens saved, and bar (the share of the largest saving).

    All sums come from one aggregate, which becomes rows only then: exploding steps would make the optimizer copy
    the whole plan into a filter.
    """
    step = lambda k: F.get(F.col("steps"), F.lit(k))
    sums = [
        x.alias(f"{n}{k}")
        for k in range(rules)
        for n, x in (
            ("name", F.max(step(k)["rule_name"])),
            ("done", F.sum((step(k)["status"] == "done").cast("long"))),
            ("changed", F.sum((step(k)["input_text"] != step(k)["output_text"]).cast("long"))),
            ("saved", F.sum(F.greatest(F.lit(0), step(k)["tokens_saved"]).cast("long"))),
        )
    ]
    total = optimized.agg(*sums)
    most = F.greatest(*(F.col(f"saved{k}") for k in range(rules)), F.lit(0))
    row = lambda k: F.struct(F.lit(k).alias("position"), F.col(f"name{k}").alias("rule_name"), *(F.col(f"{n}{k}").alias(n) for n in ("done", "changed", "saved")), F.when(most > 0, F.col(f"saved{k}") / F.when(most > 0, most)).otherwise(F.lit(0.0)).alias("bar"))
    return total.select(F.explode(F.array(*(row(k) for k in range(rules)))).alias("r")).select("r.*").where(F.col("rule_name").isNotNull())


def by_group(optimized: DataFrame, *keys: str) -> DataFrame:
    """Rows, tokens before and after, and the rate of the sums, by columns of the input."""
    stats = optimized.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("token_stats.original").cast("long")).alias("original"), F.sum(F.col("token_stats.final").cast("long")).alias("final"))
    return stats.withColumn("rate", F.when(F.col("original") > 0, F.floor((F.lit(1.0) - F.col("final") / F.when(F.col("original") > 0, F.col("original"))) * 1000.0 + 0.5) / 10.0).otherwise(F.lit(0.0)))


def conflict_pairs(hits: DataFrame, id_col: str = "id", kind_col: str = "kind") -> DataFrame:
    """Of rows (id, kind): id, left, right for each known conflict whose kinds an id has both. The pairs are three rows."""
    spark = hits.sparkSession
    pairs = spark.createDataFrame(v.CONFLICTS, "left string, right string")
    have = hits.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{kind_col}`").alias("kind")).distinct()
    lefts = have.join(F.broadcast(pairs), F.col("kind") == F.col("left")).select("id", "left", "right")
    return lefts.join(have.withColumnRenamed("kind", "right"), ["id", "right"]).select("id", "left", "right")
