"""Sentence-aware difference of two texts: multisets of chunks, order kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import extract_all

#: What a browser's \\s takes for white space.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
#: The same within a class of characters; what isn't ASCII stands behind one range, so that letters pass by most of it.
SPACE = r"\x09-\x0d\x20[\xa0-\x{feff}&&[\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]]"
#: A run without end marks, up to a mark before white space or the end, up to the end, or up to its last white space.
_CHUNK = rf"(?:[^.!?]++[.!?](?:[{SPACE}]++|\z)|[^.!?]++\z|[^.!?]+[{SPACE}])"


def chunks(c: Column) -> Column:
    """Sentences with the white space behind them; what lies between them is a chunk too, so that joining gives the text.

    A run of characters none of whose places begins a sentence is passed at once, so long runs cost no more than others.
    """
    return extract_all(c, rf"{_CHUNK}|(?:(?!{_CHUNK})[^.!?]*+[.!?]++)++")


def chunk_key(c: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(c, rf"[{SPACE}]++", " "), F.lit(SPACES)))


def before_after(df: DataFrame, id_col: str, before_col: str, after_col: str) -> DataFrame:
    """id, row, side, pos, chunk, kept for each chunk of both texts.

    side is "before" (what isn't kept was deleted) or "after" (what isn't kept is new). The k-th occurrence of a key is
    kept if the other side of the same row has it k times; chunks of white space always are. Rows are told apart by row,
    not by id: ids may repeat or be null. Null texts have no chunks. df is read once: both sides are dealt by (row, key)
    in one shuffle, so no task holds a document, and ranks and counts come from one sort. Texts that are equal need no
    keys: their chunks meet by place.
    """
    side = lambda name, c: F.transform(chunks(F.coalesce(F.col(f"`{c}`"), F.lit(""))), lambda x, i: F.struct(F.lit(name).alias("side"), i.alias("pos"), x.alias("chunk")))
    same = F.coalesce(F.col(f"`{before_col}`"), F.lit("")) == F.coalesce(F.col(f"`{after_col}`"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.monotonically_increasing_id().alias("row"), same.alias("same"), F.concat(side("before", before_col), side("after", after_col)).alias("x"))
    rows = rows.select("id", "row", "same", F.explode("x").alias("x")).select("id", "row", "same", "x.*")
    rows = rows.withColumn("key", F.when(F.col("same"), F.col("pos").cast("string")).otherwise(chunk_key(F.col("chunk"))))
    both = Window.partitionBy("row", "key")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("row", "key", "side").orderBy("pos")))
    times = lambda name: F.count(F.when(F.col("side") == name, 1)).over(both)
    held = ranked.withColumn("have", F.when(F.col("side") == "before", times("after")).otherwise(times("before")))
    return held.select("id", "row", "side", "pos", "chunk", ((F.col("key") == "") | (F.col("rank") <= F.col("have"))).alias("kept"))


def counts(df: DataFrame, id_col: str, before_col: str, after_col: str) -> DataFrame:
    """id, side, chunks, flagged for each text of each row: its chunks, and how many of them before_after() doesn't keep.

    Texts without chunks have no row. Nothing is shuffled: of equal texts chunks are counted once and none is flagged; of
    others the keys of both sides are sorted within the row, and of each key one side has as many too many as the
    balance says.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{before_col}`"), F.lit("")).alias("b"), F.coalesce(F.col(f"`{after_col}`"), F.lit("")).alias("a"))
    rows = rows.withColumn("same", F.col("b") == F.col("a"))
    rows = rows.select("id", "same", chunks(F.col("b")).alias("x"), F.when(~F.col("same"), chunks(F.col("a"))).alias("y"))
    keyed = lambda c, n: F.transform(c, lambda x: F.struct(chunk_key(x).alias("key"), F.lit(n).alias("n")))
    keys = F.when(~F.col("same"), F.array_sort(F.concat(keyed("x", 1), keyed("y", -1))))
    rows = rows.select("id", F.size("x").alias("nx"), F.when(F.col("same"), F.size("x")).otherwise(F.size("y")).alias("ny"), keys.alias("keys"))

    def state(key: Column, balance: Column, gone: Column, new: Column) -> Column:
        return F.struct(key.alias("key"), balance.alias("balance"), gone.alias("gone"), new.alias("new"))

    def settled(s: Column) -> tuple[Column, Column]:
        return s["gone"] + F.greatest(s["balance"], F.lit(0)), s["new"] + F.greatest(-s["balance"], F.lit(0))

    def step(s: Column, x: Column) -> Column:
        n = F.when(x["key"] == "", 0).otherwise(x["n"])
        return F.when(s["key"] == x["key"], state(s["key"], s["balance"] + n, s["gone"], s["new"])).otherwise(state(x["key"], n, *settled(s)))

    def ended(s: Column) -> Column:
        gone, new = settled(s)
        return F.struct(gone.alias("gone"), new.alias("new"))

    rows = rows.withColumn("done", F.aggregate("keys", state(F.lit(""), F.lit(0), F.lit(0), F.lit(0)), step, ended))
    side = lambda name, n, flagged: F.struct(F.lit(name).alias("side"), F.col(n).alias("chunks"), F.coalesce(F.col(flagged), F.lit(0)).alias("flagged"))
    sides = rows.select("id", F.explode(F.array(side("before", "nx", "done.gone"), side("after", "ny", "done.new"))).alias("x"))
    return sides.select("id", "x.*").where("chunks > 0")


def diff(df: DataFrame, id_col: str, source_col: str, other_col: str) -> DataFrame:
    """id, row, pos, chunk, kept for each chunk of the source alone."""
    return before_after(df, id_col, source_col, other_col).where("side = 'before'").drop("side")
