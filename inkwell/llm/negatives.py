"""Hard negatives by bit-sliced integer inner products.

Components become integers and each block of rows is held as bit-planes, the most significant first. After every plane
the score of a row lies in an interval: what the planes so far add up to, and what the rest can still add at least and
at most. Rows whose interval cannot enter the answer any more are dropped at once, so most of them never see their low
planes. Anchors are a stated query set against all rows, in blocks on both sides: a block of anchors meets each block
of rows once, hands on its few best, and these are merged for each anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, columns, materialize, reachable

SCALE = 256
#: Rows and anchors a block; how much work a task has, never what it finds.
BLOCK_ROWS, BLOCK_ANCHORS = 8192, 64
#: Below this share of living candidates they are followed one by one instead of by whole matrices.
SPARSE = 0.1
#: A score must stay below it, so that sums in 64-bit integers are exact.
_ROOM = 1 << 62


def bit_planes(x: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(weight, 0/1 matrix) from the most significant down, in two's complement: the first weight is negative."""
    top = max(int(x.max(initial=0)), -int(x.min(initial=0)) - 1, 0).bit_length()
    return [(-(1 << top) if p == top else 1 << p, ((x >> p) & 1).astype(np.float64)) for p in range(top, -1, -1)]


class Interval:
    """Scores of n rows against m anchors, refined plane by plane; low and high hold what is known of each pair."""

    def __init__(self, rows: np.ndarray, anchors: np.ndarray) -> None:
        peak = int(np.abs(rows).max(initial=0)) + 1
        if peak * (int(np.abs(anchors).sum(axis=1).max(initial=0)) + 1) >= _ROOM:
            raise ValueError("components too large: a score would not fit 64 bits")
        self.planes = bit_planes(rows)
        self.anchors = anchors
        # Products of a 0/1 plane are sums of components: exact in doubles up to 2^53, beyond in integers.
        self.exact = np.float64 if int(np.abs(anchors).sum(axis=1).max(initial=0)) < 1 << 53 else np.int64
        self.negative = np.minimum(anchors, 0).sum(axis=1)
        self.positive = np.maximum(anchors, 0).sum(axis=1)
        self.alive = np.ones((len(anchors), len(rows)), dtype=bool)
        self.low = np.zeros(self.alive.shape, dtype=np.int64)
        self.high = np.zeros(self.alive.shape, dtype=np.int64)
        self.known = np.zeros(self.alive.shape, dtype=np.int64)
        self.work = 0  # products of single components, for tests

    def refine(self) -> Iterator[None]:
        """After each plane low and high hold for living pairs; the caller may take pairs out of alive."""
        for weight, plane in self.planes:
            rest = abs(weight) - 1  # what all lower planes together weigh
            if self.alive.mean() > SPARSE:
                self.known += weight * (self.anchors.astype(self.exact) @ plane.T.astype(self.exact)).astype(np.int64)
                self.work += plane.size * len(self.anchors)
                self.low = self.known + rest * self.negative[:, None]
                self.high = self.known + rest * self.positive[:, None]
            else:
                i, j = np.nonzero(self.alive)
                for at in range(0, len(i), 1 << 16):
                    a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                    self.known[a, b] += weight * np.einsum("ij,ij->i", self.anchors[a].astype(self.exact), plane[b].astype(self.exact)).astype(np.int64)
                self.work += len(i) * plane.shape[1]
                self.low[i, j] = self.known[i, j] + rest * self.negative[i]
                self.high[i, j] = self.known[i, j] + rest * self.positive[i]
            yield


def _kth_largest(values: np.ndarray, k: int) -> np.ndarray:
    """Of each line the k-th largest value; the least possible one where a line is shorter."""
    if values.shape[1] < k:
        return np.full(len(values), np.iinfo(np.int64).min)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


LEAST = np.iinfo(np.int64).min


def best_rows(rows: np.ndarray, anchors: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(anchor, row, score, work) of all allowed pairs whose score is not below the anchor's k-th largest; ties stay."""
    scores = Interval(rows, anchors)
    scores.alive &= allowed
    for _ in scores.refine():
        floor = _kth_largest(np.where(scores.alive, scores.low, LEAST), k)
        scores.alive &= scores.high >= floor[:, None]
    i, j = np.nonzero(scores.alive)
    return i, j, scores.known[i, j], scores.work


def rows_within(rows: np.ndarray, anchors: np.ndarray, allowed: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(window, row, score, work): of each window (an anchor and two bounds) the rows with a score inside and not below the k-th largest inside.

    A pair lives while some window of its anchor can still take it. A window's floor counts only rows that are surely
    inside, so nothing that belongs to the answer is dropped before its score is known.
    """
    scores = Interval(rows, anchors)
    lives = np.zeros(scores.alive.shape, dtype=bool)
    for w, a in enumerate(owner):
        if low[w] <= high[w]:
            lives[a] |= allowed[a]
    scores.alive = lives
    floor = low.copy()
    for _ in scores.refine():
        lives = np.zeros_like(scores.alive)
        for w, a in enumerate(owner):
            own = np.flatnonzero(scores.alive[a])
            if not len(own) or low[w] > high[w]:
                continue
            lo, hi = scores.low[a, own], scores.high[a, own]
            sure = lo[(lo >= low[w]) & (hi <= high[w])]
            if len(sure) >= k:
                floor[w] = max(floor[w], np.partition(sure, len(sure) - k)[len(sure) - k])
            lives[a, own[(hi >= floor[w]) & (lo <= high[w])]] = True
        scores.alive = lives
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for w, a in enumerate(owner):
        own = np.flatnonzero(scores.alive[a])
        s = scores.known[a, own]
        inside = (s >= floor[w]) & (s <= high[w])
        found.append((np.full(int(inside.sum()), w), own[inside], s[inside]))
    join = lambda k: np.concatenate([f[k] for f in found]) if found else np.zeros(0, dtype=np.int64)
    return join(0), join(1), join(2), scores.work


def _first(groups: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each group's first k by score (highest first), then id (null, as the largest, last)."""
    order = np.lexsort((ids, -scores, groups))
    g = groups[order]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, dtype=np.int64)
    rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
    return order[rank < k]


def _matrix(vectors: list, width: int) -> np.ndarray:
    """Vectors of integers as rows; shorter ones end in zeros."""
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, x in enumerate(vectors):
        out[i, : len(x)] = x
    return out


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """row, vec_id, label, x: rows that take part, components as floor(scale * component).

    Rows with a null label, a null vector, or a null or non-finite component take no part.
    """
    rows = columns(df, vec_id=id_col, label=label_col, vector=vector_col, row=F.monotonically_increasing_id())
    wide = F.transform("vector", lambda c: c.cast("double"))
    sound = F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    return rows.where(sound).select("row", F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform(wide, lambda c: F.floor(c * F.lit(float(scale))).cast("long")).alias("x"))


def _blocks(df: DataFrame, size: int, *names: str) -> DataFrame:
    """block, members: rows by tens of thousands in one record each, in no order that matters."""
    numbered = df.withColumn("block", F.floor(F.col("at") / size).cast("long"))
    return numbered.groupBy("block").agg(F.collect_list(F.struct(*names)).alias("members"))


def _numbered(rows: DataFrame) -> DataFrame:
    """A table with at = 0, 1, 2, ...: a count for each of its parts, and the place within the part."""
    part = F.shiftright("row", 33)
    starts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # one row a part of the input
    along = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("part", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("start"))
    within = Window.partitionBy("part").orderBy("row")
    return rows.withColumn("part", part).withColumn("at", F.row_number().over(within) - 1).join(starts, "part").withColumn("at", F.col("at") + F.col("start")).drop("part", "start")


def _met(anchors: DataFrame, blocks: DataFrame, meet, schema: str) -> DataFrame:
    """meet(anchor members, row members) over every block of anchors and every block of rows.

    The anchors' blocks are copied to each block of rows, by an equality join on its number: a block of anchors is small.
    """
    n = blocks.count()
    reachable(blocks.sparkSession)
    copied = anchors.withColumnRenamed("members", "anchors").select("anchors", F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)).cast("long"))).alias("block"))
    pairs = copied.join(blocks.hint("merge"), "block").select("anchors", "members")

    arrow = arrow_schema(schema)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                out = meet(*(Members(batch.column(c)[k].values) for c in range(2)))
                yield pa.RecordBatch.from_arrays([pa.array(v, type=arrow.field(i).type) for i, v in enumerate(out)], schema=arrow)

    return pairs.mapInArrow(run, schema)


class Members:
    """One block's rows out of Arrow."""

    def __init__(self, values) -> None:
        self.fields = {values.type.field(i).name: values.field(i) for i in range(values.type.num_fields)}

    def numbers(self, name: str) -> np.ndarray:
        """Integers; null as the largest, so that it comes last among ties."""
        return self.fields[name].fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)

    def lists(self, name: str) -> list:
        return self.fields[name].to_pylist()

    def matrix(self, width: int) -> np.ndarray:
        x = self.fields["x"]
        n = np.diff(x.offsets.to_numpy())
        if len(n) and (n == width).all():
            return x.flatten().to_numpy(zero_copy_only=False).reshape(len(n), width)
        return _matrix(x.to_pylist(), width)

    def width(self) -> int:
        return int(np.diff(self.fields["x"].offsets.to_numpy()).max(initial=0))


def mine(df: DataFrame, anchors, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 10, between: tuple[int, int] = (30, 90), scale: int = SCALE, block_rows: int = BLOCK_ROWS, block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchors: a condition on vec_id that says which rows are anchors. An anchor's positives are its first other rows of
    the same label, by score, then by the smaller id; for each, the first rows of another label whose score lies within
    the given percentages of the positive's score. Other rows are other records, whatever their ids: repeated rows count
    each. Null ids are last among ties and no anchors. Shorter vectors count as if they ended in zeros. Components so
    large that a score would not fit 64 bits raise. Empty tables give no rows.
    """
    rows = materialize(integer_vectors(df, id_col, vector_col, label_col, scale), "vectors")
    blocks = materialize(_blocks(_numbered(rows), block_rows, "row", "vec_id", "label", "x"), "row-blocks")
    chosen = materialize(_numbered(rows.where(anchors)), "anchors")
    grouped = _blocks(chosen, block_anchors, "row", "label", "x")

    def same_label(queries: Members, block: Members) -> list:
        width = max(queries.width(), block.width())
        own = queries.numbers("row")
        allowed = (queries.numbers("label")[:, None] == block.numbers("label")) & (own[:, None] != block.numbers("row"))
        i, j, s, _ = best_rows(block.matrix(width), queries.matrix(width), allowed, positives)
        ids = block.numbers("vec_id")[j]
        at = _first(i, s, ids, positives)
        known = ids[at] != np.iinfo(np.int64).max
        return [own[i[at]], [int(x) if ok else None for x, ok in zip(ids[at], known, strict=True)], s[at], block.numbers("row")[j[at]]]

    near = _met(grouped, blocks, same_label, "row long, positive_id long, positive_score long, positive_row long")
    order = Window.partitionBy("row").orderBy(F.col("positive_score").desc(), F.col("positive_id").asc_nulls_last(), "positive_row")
    near = materialize(near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives), "positives")
    # A positive's window in whole scores: 30 * p <= 100 * n <= 90 * p, without going beyond 64 bits.
    share = lambda k: F.col("positive_score").cast("decimal(38,0)") * F.lit(k)
    low, high = F.ceil(share(between[0]) / F.lit(100)).cast("long"), F.floor(share(between[1]) / F.lit(100)).cast("long")
    windows = near.groupBy("row").agg(F.collect_list(F.struct("place", low.alias("low"), high.alias("high"))).alias("windows"))
    grouped = _blocks(chosen.join(windows, "row"), block_anchors, "row", "label", "x", "windows")

    def other_label(queries: Members, block: Members) -> list:
        width = max(queries.width(), block.width())
        own = queries.numbers("row")
        allowed = queries.numbers("label")[:, None] != block.numbers("label")
        bounds = [(a, w["place"], w["low"], w["high"]) for a, ws in enumerate(queries.lists("windows")) for w in ws]
        owner, place, low, high = (np.array(x, dtype=np.int64) for x in zip(*bounds, strict=True)) if bounds else (np.zeros(0, dtype=np.int64),) * 4
        w, j, s, _ = rows_within(block.matrix(width), queries.matrix(width), allowed, owner, low, high, negatives)
        ids = block.numbers("vec_id")[j]
        at = _first(w, s, ids, negatives)
        known = ids[at] != np.iinfo(np.int64).max
        return [own[owner[w[at]]], place[w[at]], [int(x) if ok else None for x, ok in zip(ids[at], known, strict=True)], s[at]]

    far = _met(grouped, blocks, other_label, "row long, place int, negative_id long, negative_score long")
    order = Window.partitionBy("row", "place").orderBy(F.col("negative_score").desc(), F.col("negative_id").asc_nulls_last())
    far = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    named = chosen.select("row", F.col("vec_id").alias("anchor_id"))
    return far.join(near.select("row", "place", "positive_id", "positive_score"), ["row", "place"]).join(named, "row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def relabelled(df: DataFrame) -> DataFrame:
    """The contract's labels: where the id is divisible by 7 the next one."""
    return df.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))


#: DuckDB: all products of anchors and rows.
ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(CAST(c AS DOUBLE)))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_sum(list_transform(a.x, lambda c, i: c * b.x[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
