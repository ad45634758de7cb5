"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Each source gets a target size: its weight's share of the whole, at most `most` times its own size, the excess going
to the others by weight. Every document then expects target / source size copies. The documents of a source stand on
a line, each as long as its expected copies; with one random offset a source, a document is taken once for every
integer boundary within its stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD, columns, materialize

#: The contract's weights, by rank of the source, repeating.
WEIGHTS = (5, 2, 1)
MOST = 3


def unit(*parts: Column | str) -> Column:
    """A number in [0, 1) from the md5 of the parts: the same in every engine and on every run."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, n -> also target.

    Sharing out the excess again and again ends at one level: every source gets min(most * size, level * weight). In
    order of most * size / weight the capped sources come first, so running sums give the level each prefix of capped
    sources would leave; the right one is the first that the next source does not fall below. One row a source, so
    the window over all of them is as small as the list of sources.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("rank"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    from_here = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(1))
    ranked = sources.withColumn("rank", F.row_number().over(everything) - 1)
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(from_here)
    levels = ranked.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most).withColumn("level_here", level)
    first = F.first(F.when(F.col("cap") >= F.col("level_here") * F.col("weight"), F.col("level_here")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("cap").cast("double"), F.coalesce(first, F.lit(0.0)) * F.col("weight"))
    return levels.withColumn("target", target).select("source", "source_size", "n", "target")


def _told_apart(rows: DataFrame) -> DataFrame:
    """name: what a row is known by, whatever the partitions: its id, or the hash of its text and its rank among equals.

    Ranks of equal rows come from counts by part of the input, so no task gathers them.
    """
    named = rows.where("doc_id IS NOT NULL").withColumn("name", F.col("doc_id").cast("string"))
    equal = ["blob", "source"]
    nameless = rows.where("doc_id IS NULL").withColumn("part", F.shiftright("row", 33))
    along = Window.partitionBy(equal).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = nameless.groupBy(*equal, "part").agg(F.count("*").alias("m")).select(*equal, "part", F.coalesce(F.sum("m").over(along), F.lit(0)).alias("start"))
    starts = starts.withColumnRenamed("source", "from")
    ranked = nameless.withColumn("rank", F.row_number().over(Window.partitionBy(*equal, "part").orderBy("row")))
    joined = ranked.join(starts, (ranked["blob"] == starts["blob"]) & ranked["source"].eqNullSafe(starts["from"]) & (ranked["part"] == starts["part"]))
    name = F.concat_ws(" ", F.lit("text"), ranked["blob"], (F.col("rank") + F.col("start")).cast("string"))
    return named.unionByName(joined.select(*(ranked[c] for c in rows.columns), name.alias("name"))).drop("blob", "row")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: how often the mix takes each row of df.

    Sizes are counted once and written as a narrow table; texts are never shuffled. The line of a source is laid out
    by size class, then chunk (a hash of the id), then size: neighbours have like sizes, so that the words taken come
    near the target. Places on the line come from two sums: within a cell (source, class, chunk), and over a source's
    cells. Both grow as the square root of the source's rows, so a source with a third of all rows is no hot spot.

    Null texts have size 0, and so do texts of blanks; null sources are one source, the last. Rows without an id
    are known by their texts and ranks among equal ones, so any order of the input gives the same copies of each text.
    Rows with equal ids and sizes are told apart by their order only, and so may swap copies; one id that very many rows of a source share
    falls into few cells. Sources without words have target 0. Empty input, empty result. The list of sources, a row
    each, is laid out in one task.
    """
    size = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(SPACE_WORD)), F.lit(0)).cast("long")
    blob = F.when(F.col(f"`{id_col}`").isNull(), F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    rows = materialize(columns(df, doc_id=id_col, source=source_col, size=size, row=F.monotonically_increasing_id(), blob=blob), "sizes")
    totals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, most)
    # A text that no source lacks, so that joins and windows share one plain key.
    named = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    known = materialize(totals.withColumn("sk", named).drop("source"), "targets")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), "name"))
    bits = F.bin("size")
    placed = _told_apart(rows).withColumn("sk", named).join(known, "sk").withColumn("key", key).select(
        "doc_id", "source", "size", "source_size", "target", "sk", "key",
        (F.length(bits) * 2 + F.when(F.substring(bits, 2, 1) == "1", 1).otherwise(0)).alias("class"),
        F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), F.ceil(F.sqrt("n") / 8).cast("long")).alias("chunk"),
    )
    cell = ["sk", "class", "chunk"]
    along = Window.partitionBy("sk").orderBy("class", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(cell).agg(F.count("*").alias("m")).select(*cell, F.coalesce(F.sum("m").over(along), F.lit(0)).alias("start"))
    within = Window.partitionBy(cell).orderBy("size", "key", "doc_id")
    line = placed.withColumn("place", F.row_number().over(within).cast("long") - 1).join(starts, cell).withColumn("place", F.col("place") + F.col("start"))
    # All documents of a source expect as many copies, so the prefix sum up to a place is a product.
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = unit(F.lit(f"{seed}:offset"), F.col("sk"))
    copies = F.least(F.floor((F.col("place") + 1) * rate + offset) - F.floor(F.col("place") * rate + offset), F.lit(most)).cast("long")
    return line.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def digest(mixed: DataFrame) -> DataFrame:
    """The contract's columns."""
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


#: DuckDB: the same mix. The line is laid out by one row_number() for each source.
ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sources
), weighed AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * {MOST} AS cap FROM ranked
), levels AS (
  SELECT *, (CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS DOUBLE)) / CAST(sum(weight) OVER r AS DOUBLE) AS level_here
  FROM weighed
  WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         r AS (ORDER BY CAST(cap AS DOUBLE) / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), level AS (
  SELECT (SELECT level_here FROM levels WHERE cap >= level_here * weight ORDER BY CAST(cap AS DOUBLE) / weight, rank LIMIT 1) AS v
), goals AS (
  SELECT source, source_size, n, least(CAST(cap AS DOUBLE), coalesce(v, 0) * weight) AS target FROM levels, level
), keyed AS (
  SELECT d.doc_id, d.source, d.size, g.source_size, g.n, g.target, md5('17:' || CAST(d.doc_id AS VARCHAR)) AS key
  FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source
), placed AS (
  SELECT *, length(bin(size)) * 2 + CASE WHEN substr(bin(size), 2, 1) = '1' THEN 1 ELSE 0 END AS class,
    CAST('0x' || substr(key, 1, 8) AS BIGINT) % CAST(ceil(sqrt(n) / 8) AS BIGINT) AS chunk FROM keyed
), line AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, chunk, size, key, doc_id) - 1 AS place,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    CAST('0x' || substr(md5('17:offset:' || coalesce('=' || source, 'null')), 1, 8) AS BIGINT) / 4294967296.0 AS shift FROM placed
), taken AS (
  SELECT *, CAST(least(floor((place + 1) * rate + shift) - floor(place * rate + shift), {MOST}) AS BIGINT) AS copies FROM line
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM taken
"""
