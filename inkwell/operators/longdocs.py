"""Documents that fit no row: sentences as rows, first ones kept by aggregates, and put together again in order.

A long document is a table of parts, each of which ends where a sentence ends. Its sentences are rows with a place that
grows along the document. Which of them stay is decided by aggregates with partial sums, so a sentence said ten million
times sends one row a task; in which order they stand comes from sums over cells of a few thousand sentences. No task
holds a document, and no array has one either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import protect
from ..functions.text import SENTENCE, collapse, extract_all, has_any, jtrim

#: Sentences a cell, within which places are running sums.
CELL = 4096
#: Bits of a place that number the sentences of one part.
_BITS = 32


def sentence_rows(parts: DataFrame, doc: str, part: str, text: str) -> DataFrame:
    """doc, at, sentence, plain: the sentences of each part, trimmed, and its protected pieces, in order.

    part numbers the parts of a document from 0 to 2^31. Null texts have no sentences; a null document is one too.
    """
    segs = protect.segments(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    kept = lambda s: F.array(F.struct(s["t"].alias("sentence"), F.lit(False).alias("plain")))
    said = lambda s: F.transform(F.filter(F.transform(extract_all(s["t"], SENTENCE), jtrim), lambda x: x != ""), lambda x: F.struct(x.alias("sentence"), F.lit(True).alias("plain")))
    rows = parts.select(F.col(f"`{doc}`").alias("doc"), F.col(f"`{part}`").cast("long").alias("part"), F.posexplode(F.flatten(F.transform(segs, lambda s: F.when(s["p"], kept(s)).otherwise(said(s))))).alias("place", "x"))
    return rows.select("doc", (F.shiftleft("part", _BITS) + F.col("place")).alias("at"), "x.*")


def sentence_key(sentence: Column, fold_case: bool = True) -> Column:
    """What makes sentences the same: the text but for white space, end marks and, unless told otherwise, case."""
    key = jtrim(F.regexp_replace(collapse(jtrim(sentence)), r"[.!?]+\z", ""))
    return F.lower(key) if fold_case else key


def _once(rows: DataFrame, key: Column, first: bool) -> DataFrame:
    """Of the rows of a document with the same key the first (or last), by one aggregate."""
    best = (F.min_by if first else F.max_by)("sentence", "at")
    return rows.groupBy("doc", key.alias("key")).agg((F.min if first else F.max)("at").alias("at"), best.alias("sentence")).select("doc", "at", "sentence")


def distinct_sentences(rows: DataFrame, fold_case: bool = True, first: bool = True) -> DataFrame:
    """doc, at, sentence: of sentences that are the same within a document the first (or last); protected pieces stay."""
    plain = _once(rows.where("plain"), sentence_key(F.col("sentence"), fold_case), first)
    return plain.unionByName(rows.where("NOT plain").select("doc", "at", "sentence"))


def first_of_kinds(rows: DataFrame, kinds: dict[str, str], words: list[str]) -> DataFrame:
    """doc, at, sentence: of each kind the document's first sentence, and all of none; protected pieces stay.

    A sentence is of the first kind whose pattern it shows; words are what any of the patterns needs, in lower case.
    """
    shows = F.coalesce(*(F.when(F.col("sentence").rlike(p), F.lit(k)) for k, p in kinds.items()))
    kinded = rows.withColumn("kind", F.when(F.col("plain") & has_any(F.lower("sentence"), words), shows))
    return _once(kinded.where("kind IS NOT NULL"), F.col("kind"), True).unionByName(kinded.where("kind IS NULL").select("doc", "at", "sentence"))


def blocks(rows: DataFrame, chars: int = 1_000_000) -> DataFrame:
    """doc, block, sentences, text: a document's sentences in order, one space between, in blocks of about chars characters.

    A sentence belongs to the block in which it begins, so blocks in order, a space between, are the document. Where a
    sentence begins is the sum of all before it: of whole cells, then within its own cell.
    """
    cell = (F.col("at") / F.lit(CELL)).cast("long")
    sized = rows.select("doc", "at", "sentence", cell.alias("cell"), (F.length("sentence") + 1).cast("long").alias("size"))
    along = Window.partitionBy("doc").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sized.groupBy("doc", "cell").agg(F.sum("size").alias("all")).select(F.col("doc").alias("_doc"), F.col("cell").alias("_cell"), F.coalesce(F.sum("all").over(along), F.lit(0)).alias("start"))
    inner = Window.partitionBy("doc", "cell").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    begun = sized.withColumn("before", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    begun = begun.join(starts, begun["doc"].eqNullSafe(starts["_doc"]) & (begun["cell"] == starts["_cell"]))
    numbered = begun.select("doc", "at", "sentence", F.floor((F.col("start") + F.col("before")) / F.lit(chars)).cast("long").alias("block"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "sentence"))), lambda x: x["sentence"])
    return numbered.groupBy("doc", "block").agg(F.count("*").alias("sentences"), F.array_join(ordered, " ").alias("text"))


def lost(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """doc, before, after: how many sentences a document had, and has."""
    count = lambda df, name: df.groupBy("doc").agg(F.count("*").alias(name)).withColumnRenamed("doc", f"doc_{name}")
    had, has = count(rows, "before"), count(kept, "after")
    return had.join(has, had["doc_before"].eqNullSafe(has["doc_after"])).select(F.col("doc_before").alias("doc"), "before", "after")
