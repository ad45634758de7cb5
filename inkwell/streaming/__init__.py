"""The same plan on streams."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..plans.pipeline import optimize


def read_stream(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", files: int = 1000) -> DataFrame:
    """New files of a folder, at most so many a batch."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files).load(path)


def optimize_stream(df: DataFrame, rules: Mapping, text_col: str = "text") -> DataFrame:
    """optimize() keeps no state, so a streaming frame goes through it as it is."""
    return optimize(df, rules, text_col)


def savings_by_window(optimized: DataFrame, time_col: str, window: str = "10 minutes", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Rows and tokens saved in each window of event time; rows later than the watermark are left out, state is bounded by it."""
    span = F.window(time_col, window, slide) if slide else F.window(time_col, window)
    saved = (F.col("token_stats.original") - F.col("token_stats.final")).cast("long")
    return optimized.withWatermark(time_col, late).groupBy(span.alias("window")).agg(F.count("*").alias("n"), F.sum(saved).alias("saved"))


def sessions(df: DataFrame, time_col: str, key: str, value_col: str, gap: str = "30 minutes", late: str | None = "1 hour") -> DataFrame:
    """session, key, n, total: runs of a key's events that lie less than gap apart; total adds up hundredths, rounded down.

    On a stream, events later than the watermark are left out and bound the state; late=None is for tables, which take
    all events. Null times are in no session; a null key is a key. Rows are summed before they are shuffled, within each
    part's own sessions, so a busy key is no hot spot.
    """
    watched = df if late is None else df.withWatermark(time_col, late)
    hundredths = F.floor(F.col(f"`{value_col}`") * F.lit(100)).cast("long")
    return watched.groupBy(F.session_window(time_col, gap).alias("session"), F.col(f"`{key}`").alias(key)).agg(F.count("*").alias("n"), F.sum(hundredths).alias("total"))


def first_seen(df: DataFrame, time_col: str, *keys: str, late: str = "1 hour") -> DataFrame:
    """Each key's first row, across batches and restarts; keys are forgotten once the watermark has passed them.

    Copies that come within the watermark are dropped whatever their own times; state is bounded by the keys of that time.
    """
    return df.withWatermark(time_col, late).dropDuplicatesWithinWatermark(list(keys))


def write_stream(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """All that is there now, exactly once, then stop; run again for what came since."""
    return df.writeStream.format(fmt).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
