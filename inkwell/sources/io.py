"""Files in and out; rows are plain DataFrames, so any other source of Spark's does as well."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "json", "csv", "orc", "text")


def read(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Rows of a file or folder; text files have one column, value."""
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt!r}: one of {', '.join(FORMATS)}")
    return spark.read.format(fmt).options(**options).load(path)


def requests(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of requests: prompt, and rules as a map from rule id to enabled and params (as strings)."""
    return spark.read.schema("prompt string, rules map<string,struct<enabled:boolean,params:map<string,string>>>").json(path)


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", **options: str) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt!r}: one of {', '.join(FORMATS)}")
    df.write.format(fmt).mode(mode).options(**options).save(path)


#: Bytes, by the optimizer's estimate, up to which a table is dealt out; larger ones stay where their files are.
SPREAD_BYTES = 8_000_000_000


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where it is small and its files have fewer parts than the session has cores; else as it is.

    Rules cost far more than reading, so dealing a small table out pays. Large tables are never shuffled for it, even
    where a few files can't be split.
    """
    plan = df._jdf.queryExecution()
    if int(str(plan.optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if plan.toRdd().getNumPartitions() < cores else df
