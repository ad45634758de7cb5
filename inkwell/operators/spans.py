"""Ranges of characters: where a pattern stands, runs of ranges that touch, and ranges that overlap others.

A range goes from start to end, end exclusive, in characters. Keys tell documents apart; null keys are a document too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import extract_all


def match_ranges(text: Column, pattern: str) -> Column:
    """array<struct<gap, size, kind>>: for each match the characters before it since the last one, its own, and its first one."""
    gaps = F.split(text, pattern, -1)
    return F.zip_with(F.slice(gaps, F.lit(1), F.size(gaps) - 1), extract_all(text, pattern), lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("size"), F.substring(hit, 1, 1).alias("kind")))


def placed(df: DataFrame, *keys: str, pieces: str = "pieces") -> DataFrame:
    """keys, start, end, kind for an array<struct<gap, size, kind>> in each row. Places are running sums, in one window a row.

    Rows must be told apart by their keys.
    """
    rows = df.select(*keys, F.posexplode(pieces).alias("at", "x")).select(*keys, "at", "x.*")
    along = Window.partitionBy(*keys).orderBy("at")
    end = F.sum(F.col("gap") + F.col("size")).over(along).cast("int")
    return rows.select(*keys, (end - F.col("size")).alias("start"), end.alias("end"), "kind")


def merge_ranges(df: DataFrame, *keys: str) -> DataFrame:
    """keys, start, end: ranges that overlap or touch are one. Empty ranges count where they stand; null ends are none.

    A range begins a new run if it starts behind all that came before it: a running maximum, then a running sum.
    """
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("start") > reach, F.lit(True))
    runs = df.where("start IS NOT NULL AND end IS NOT NULL").select(*keys, "start", "end", F.when(fresh, 1).otherwise(0).alias("fresh"))
    runs = runs.withColumn("run", F.sum("fresh").over(order))
    return runs.groupBy(*keys, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def overlapping(left: DataFrame, right: DataFrame, *keys: str, extra: tuple[str, ...] = (), width: int = 256) -> DataFrame:
    """keys, start, end, extra columns of left, other_start, other_end for each pair of ranges that share a character.

    Both sides are dealt by bins of width characters; a pair that meets in several bins counts in the first that both
    reach, so nothing has to be made distinct. A document of any length is spread over its bins. Empty ranges and ranges
    without an end share no character.
    """
    def binned(df: DataFrame, start: str, end: str, name: str) -> DataFrame:
        bins = F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))
        return df.where(F.col(end) > F.col(start)).withColumn(name, F.explode(bins))

    a = binned(left.select(*keys, "start", "end", *extra), "start", "end", "bin")
    b = right.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("start").alias("other_start"), F.col("end").alias("other_end"))
    b = binned(b, "other_start", "other_end", "_bin")
    same = F.col("bin") == F.col("_bin")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    meet = (F.col("start") < F.col("other_end")) & (F.col("other_start") < F.col("end"))
    first = F.col("bin") == F.floor(F.greatest("start", "other_start") / width)
    return a.join(b, same & meet & first).select(*keys, "start", "end", *extra, "other_start", "other_end")


def covered(df: DataFrame, *keys: str) -> DataFrame:
    """keys, ranges, characters: runs that merged ranges make, and how many characters they hold."""
    return merge_ranges(df, *keys).groupBy(*keys).agg(F.count("*").alias("ranges"), F.sum(F.col("end") - F.col("start")).cast("long").alias("characters"))
