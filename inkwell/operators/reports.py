"""Reports over optimized rows: several groupings at once, the most saving rows of each group, sketches, corpora compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def step_rows(optimized: DataFrame, *columns: str) -> DataFrame:
    """columns, rule_name, status, saved (not below 0) for each step of each row."""
    step = F.transform("steps", lambda s: F.struct(s["rule_name"].alias("rule_name"), s["status"].alias("status"), F.greatest(F.lit(0), s["tokens_saved"]).cast("long").alias("saved")))
    return optimized.select(*columns, F.explode(step).alias("s")).select(*columns, "s.*")


def states(optimized: DataFrame) -> DataFrame:
    """rule_name, status, n: how often each rule was done, skipped or failed."""
    return step_rows(optimized).groupBy("rule_name", "status").agg(F.count("*").alias("n"))


def savings_sets(steps: DataFrame, sets: list[list[str]], *keys: str) -> DataFrame:
    """n, saved by each of the sets of keys, with which keys a row is summed over: level, Spark's grouping_id().

    Rows are counted once for each set by Spark's expansion, then summed in one shuffle with partial sums, so a key with
    a third of all rows is no hot spot. A null key of the data and a key that is summed over differ in level.
    """
    return steps.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(k) for k in keys)).agg(F.count("*").alias("n"), F.sum("saved").cast("long").alias("saved"), F.grouping_id().cast("long").alias("level"))


def most_saving(df: DataFrame, group: str, value: Column, tie: str, k: int) -> DataFrame:
    """df's rows with the k largest values of each group, rank first; ties by the smaller tie, nulls of it last.

    Each task keeps its own first k of a group before anything is shuffled (Spark's group limit), so a group with a
    third of all rows sends k rows a task.
    """
    order = Window.partitionBy(group).orderBy(value.desc_nulls_last(), F.col(tie).asc_nulls_last())
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def only_before(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of before as often as they are there more often than in after: counts of both, then copies; no window."""
    return before.exceptAll(after)


def in_both(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that both have, as often as the one that has them less."""
    return before.intersectAll(after)


def rate_sketches(rows: DataFrame, *keys: str, rate: str = "rate", item: str = "item", size: int = 400, bits: int = 14) -> DataFrame:
    """keys, n, rates (a sketch of quantiles), items (a sketch of how many differ). Sketches of parts merge to that of the whole.

    Ranks of quantiles err by about 0.7 % at size 400, counts of different items by about 0.8 % at 14 bits.
    """
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(rate, size).alias("rates"), F.hll_sketch_agg(item, bits).alias("items"))


def merged_sketches(sketches: DataFrame, *keys: str) -> DataFrame:
    """The sketches of rate_sketches over fewer keys, from the sketches alone."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("rates").alias("rates"), F.hll_union_agg("items").alias("items"))
