"""Exact duplicates by sorting contents: equal texts come to stand next to one another and neighbours are compared in full.

Normalised texts are dealt over ranges whose splitters Spark takes from a sample, and each range is sorted by Spark's
external sort. A splitter has to be small, as the driver gathers the sample: it is the first bytes of the text, the
SHA-256 of all of it, the id and the row's place, so a text that a third of all rows share is cut into many ranges.
Within a range runs of equal neighbours are groups; runs that touch a range's end may go on in the next one, and are
put together from one line for each range.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, fresh, materialize, reachable

#: Bytes of a text that stand in a splitter, before its digest.
PREFIX = 64
PLACED = "doc_id long, text_sha256 string, keep_id long, group_size long, head boolean, part int, run string"


def normalised(text: Column) -> Column:
    """Every run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _runs(batches: Iterator) -> Iterator:
    """One sorted range: each row with its run's first id and size, in the order of the rows.

    Only ids of the run at hand are held. Runs that touch the range's begin or end have no size yet, but a name: "first",
    "last", or "all" where one run is the whole range.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark import TaskContext

    context = TaskContext.get()
    part = context.partitionId() if context else 0
    held: list[pa.Array] = []  # ids of the run that goes on
    digest, last, first = None, None, True
    schema = pa.schema([("doc_id", pa.int64()), ("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("head", pa.bool_()), ("part", pa.int32()), ("run", pa.string())])

    def rows(ids: pa.Array, digests: pa.Array, lengths: list[int], name: str | None) -> pa.RecordBatch:
        """Rows of whole runs, given their lengths, one after the other."""
        import numpy as np

        size = np.asarray(lengths, dtype=np.int64)
        start = np.cumsum(size) - size
        head = np.zeros(len(ids), dtype=bool)
        head[start] = True
        keep = ids.take(pa.array(np.repeat(start, size)))
        sizes = pa.nulls(len(ids), pa.int64()) if name else pa.array(np.repeat(size, size))
        return pa.RecordBatch.from_arrays([ids, digests, keep, sizes, pa.array(head), pa.array(np.full(len(ids), part, dtype=np.int32)), pa.array([name] * len(ids), pa.string())], schema=schema)

    def closed(name: str | None) -> Iterator[pa.RecordBatch]:
        n = sum(map(len, held))
        if n:
            yield rows(pa.concat_arrays(held), pa.array([digest] * n, pa.string()), [n], name)
        held.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        import numpy as np

        ids, digests, texts = (batch.column(k) for k in range(3))
        new = np.ones(batch.num_rows, dtype=bool)
        new[0] = last is None or texts[0].as_py() != last
        if batch.num_rows > 1:
            new[1:] = pc.not_equal(texts.slice(1), texts.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new)
        if len(starts):
            if last is not None:
                held.append(ids.slice(0, starts[0]))
                yield from closed("first" if first else None)
                first = False
            whole = starts[1:] - starts[:-1]
            if len(whole):
                if first:  # the range's first run
                    yield rows(ids.slice(0, whole[0]), digests.slice(0, whole[0]), [int(whole[0])], "first")
                    first, starts, whole = False, starts[1:], whole[1:]
                if len(whole):
                    a, n = int(starts[0]), int(whole.sum())
                    yield rows(ids.slice(a, n), digests.slice(a, n), whole.tolist(), None)
            at = int(starts[-1])
            held.append(ids.slice(at))
            digest = digests[at].as_py()
        else:
            held.append(ids)
        last = texts[batch.num_rows - 1].as_py()
    yield from closed("all" if first else "last")


def _joined(open_runs: DataFrame) -> DataFrame:
    """part, run -> keep_id, group_size and the range that holds the group's first row.

    open_runs has one row for each range's first and last run, so two a range, whatever the corpus.
    """
    along = Window.orderBy("part", F.when(F.col("run") == "last", 1).otherwise(0))
    again = F.col("text_sha256") == F.lag("text_sha256").over(along)
    islands = open_runs.withColumn("again", F.coalesce(again, F.lit(False))).withColumn("island", F.sum(F.when(F.col("again"), 0).otherwise(1)).over(along))
    whole = Window.partitionBy("island")
    return islands.select("part", "run", (~F.col("again")).alias("opens"), F.first("first_id").over(whole.orderBy("part", F.when(F.col("run") == "last", 1).otherwise(0))).alias("whole_keep"), F.sum("n").over(whole).alias("whole_size"))


def copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of df.

    Equal are texts that are the same after every run of ASCII white space became a space; null counts as empty. Of
    equal texts the row with the smallest id stays; null ids come last; of rows that are equal in both exactly one
    stays. keep_id is null only where a group has no id at all. An empty table gives no rows. Texts are shuffled once;
    what follows works on ids. parts: ranges; by default as many as shuffle partitions, which Spark joins if small.

    Neighbours within a range are compared in full. Across the end of a range the digests are compared, so that no text
    is carried from range to range.
    """
    rows = columns(df, doc_id=id_col, text=normalised(F.col(f"`{text_col}`")), place=F.monotonically_increasing_id())
    rows = rows.select("doc_id", F.sha2("text", 256).alias("digest"), F.encode("text", "UTF-8").alias("bytes"), "place")
    dealt = [F.substring("bytes", 1, PREFIX), F.col("digest"), F.col("doc_id").asc_nulls_last(), F.col("place")]
    ranged = rows.repartitionByRange(parts, *dealt) if parts else rows.repartitionByRange(*dealt)
    order = [*dealt[:2], F.col("bytes"), *dealt[2:]]
    reachable(df.sparkSession)
    placed = materialize(ranged.sortWithinPartitions(*order).select("doc_id", "digest", "bytes").mapInArrow(_runs, PLACED), "placed")
    # Names of open runs follow the ranges' order; ids within a range stand in order, so a run's first row has its least id.
    heads = placed.where("run IS NOT NULL").groupBy("part", "run").agg(F.first("text_sha256").alias("text_sha256"), F.max(F.when(F.col("head"), F.col("keep_id"))).alias("first_id"), F.count("*").alias("n"))
    known = materialize(_joined(heads), "open-runs")
    closed = placed.where("run IS NULL").select("doc_id", "keep_id", "group_size", F.col("head").alias("kept"), "text_sha256")
    across = placed.where("run IS NOT NULL").join(known, ["part", "run"]).select("doc_id", F.col("whole_keep").alias("keep_id"), F.col("whole_size").alias("group_size"), (F.col("head") & F.col("opens")).alias("kept"), "text_sha256")
    return closed.unionByName(across)


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, with all their columns; of rows equal in id and text any one."""
    id_key, text_key = fresh(df, "id_key", "text_key")
    stays = copies(df, id_col, text_col).where("kept").select(F.col("doc_id").alias(id_key), F.col("text_sha256").alias(text_key))
    keyed = df.withColumns({id_key: F.col(f"`{id_col}`").cast("long"), text_key: F.sha2(normalised(F.col(f"`{text_col}`")), 256)})
    same = keyed[id_key].eqNullSafe(stays[id_key]) & (keyed[text_key] == stays[text_key])
    return keyed.join(stays.hint("merge"), same, "left_semi").dropDuplicates([id_key, text_key]).select(df.columns)


#: DuckDB: the same groups by a window over whole texts.
ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM n
"""
