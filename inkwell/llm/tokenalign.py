"""Alignment of two tokenizers: which tokens of one share bytes with which of the other, in text and over the corpus.

Python tokenises, and puts documents together at the end. What lies between is Spark's higher-order functions:
array_intersect of the tokens' ends gives the places where both end, sorted keys give how many ends of the other side lie
before an end, transform and slice build groups and links, and sums by link count them.

A chunk is what stands from one space behind a letter, digit or ASCII mark to the next such space. Neither vocabulary
has a token across such a place, so chunks are tokenised on their own, and each different chunk of the corpus is
tokenised and aligned once. Documents are packed by the thousand as numbers into a list of their different chunks; only
these lists travel. Each chunk takes along at which places of which packs it stands, so it goes back there without a
second meeting. Chunks end where tokens of both end, so groups and links of a document are those of its chunks, in order.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import PATTERN
from .common import arrow_schema, columns, materialize, reachable, scratch

FOLDER = "/opt/tokenizers"
FILES = ("byte_bpe_50k.json", "piece_bpe_32k.model")
#: Characters of text in a pack of documents; a longer text is a pack of its own.
PACK_CHARS = 8_000_000
#: Pairs of ids up to which their counts are sent to all executors; beyond, they are joined by shuffle. About 32 MB.
SMALL_PAIRS = 1_000_000
#: Parts of the packs whose words travel back one after the other, so that shuffle files of one part lie there at a time.
ROUNDS = 4
#: Tables of words and entries are as large as the input; packed harder they cost half.
ZSTD = {"compression": "zstd"}
#: A pack is a row of several MB: writers and readers hold a row group at a time, so each has one of its own.
ONE_BY_ONE = {**ZSTD, "parquet.block.row.count.limit": "1"}
#: Chunks of a document whose groups are hashed at a time.
HASHED = 1 << 16
#: In a key that is sorted: an end, which side it is of, and its place, from high bits to low.
_SIDE, _PLACE = 31, (1 << 31) - 1

#: Where a space is no begin of a chunk; texts without such a place are cut at every space.
_ODD = re.compile(r"(?:^|[^\w!-/:-@\[-`{-~]) | $")
_CUT = re.compile(r"(?<=[^\W_]|[!-/:-@\[-`{-~])(?= +[^ ])")
PACK = "docs array<struct<doc_id bigint, chunks array<int>>>, words array<string>, counts array<int>"
TOKENS = "n bigint, in_packs array<int>, in_places array<int>, a_ids array<int>, a_ends array<bigint>, b_ids array<int>, b_ends array<bigint>"
ALIGNED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


class ByteLevel:
    """Ids and byte lengths by a byte-level BPE file; special tokens' strings are plain text."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"]
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{path}: not a plain byte-level vocabulary")
        special = {t["content"] for t in spec.get("added_tokens", []) if t.get("special")}
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        order = [model["vocab"]["".join(m)] for m in merges]
        if order == sorted(order):  # merges in the order of ids: ids are ranks
            import tiktoken

            self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            self.encode = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
        self.bytes = {i: t for t, i in ranks.items()}


class Pieces:
    """Ids and bytes by a sentence-piece file, which puts a space before a text."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(m[1], 16)]) if (m := re.fullmatch(r"<0x([0-9A-F]{2})>", n)) else n.replace("▁", " ").encode() for n in names]
        #: No piece goes on with a space: then none crosses the begin of a chunk.
        self.splits = not any("▁" in n.lstrip("▁") for n in names)


class Tokenised:
    """Tokens of words, each with a space before it, by both vocabularies."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)

    def columns(self, words: list[str]) -> list:
        """Arrow lists of A ids, A ends, B ids, B ends; null for words whose tokens' bytes are not theirs."""
        import numpy as np
        import pyarrow as pa

        raw = [b" " + w.encode() for w in words]
        both = [list(map(self.a.encode, (f" {w}" for w in words))), self.b.model.encode(words)]
        ends_of_words = np.cumsum([0, *map(len, raw)])
        sides, right = [], np.ones(len(words), dtype=bool)
        for ids, table in zip(both, (self.a.bytes, self.b.bytes), strict=True):
            tokens = [table[i] for own in ids for i in own]
            counts = np.cumsum([0, *map(len, ids)])
            reach = np.cumsum([0, *map(len, tokens)])
            if not np.array_equal(reach[counts], ends_of_words) or b"".join(tokens) != b"".join(raw):
                right &= [b"".join(tokens[i:j]) == x for i, j, x in zip(counts, counts[1:], raw, strict=False)]
            ends = reach[1:] - np.repeat(reach[counts[:-1]], np.diff(counts))
            sides += [(counts, np.fromiter((i for own in ids for i in own), np.int32, len(tokens))), (counts, ends)]
        lists = [pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.array(values)) for counts, values in sides]
        return lists if right.all() else [pa.array([v if ok else None for v, ok in zip(x.to_pylist(), right, strict=True)], type=x.type) for x in lists]


def pack(df: DataFrame, splits: bool, pack_chars: int = PACK_CHARS) -> DataFrame:
    """doc_id, text -> packs of documents: each document as numbers of chunks, the pack's different chunks, and how often each is there.

    Documents without text have no chunks. splits: whether texts may be cut into chunks.
    """
    reachable(df.sparkSession)
    arrow = arrow_schema(PACK)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        ids: list[int | None] = []
        numbers: dict[str, int] = {}
        said, ends, held = array("i"), [0], 0

        def packed() -> pa.RecordBatch:
            chunks = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(said, dtype=np.int32).copy()))
            docs = pa.StructArray.from_arrays([pa.array(ids, pa.int64()), chunks], names=["doc_id", "chunks"])
            counts = np.bincount(np.frombuffer(said, dtype=np.int32), minlength=len(numbers)).astype(np.int32)
            whole = [docs, pa.array(list(numbers), pa.string()), pa.array(counts)]  # each word without the space before it
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x).cast(arrow.field(i).type) for i, x in enumerate(whole)], schema=arrow)

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py() or ""
                if ids and held + len(text) > pack_chars:
                    yield packed()
                    ids, numbers, said, ends, held = [], {}, array("i"), [0], 0
                ids.append(key)
                held += len(text)
                if text:
                    if splits and not _ODD.search(text):
                        own = text.split(" ")
                    else:
                        own = [chunk[1:] for chunk in _CUT.split(f" {text}")] if splits else [text]
                    said.extend([numbers.setdefault(chunk, len(numbers)) for chunk in own])
                ends.append(len(said))
        if ids:
            yield packed()

    return df.select("doc_id", "text").mapInArrow(run, PACK)


def tokenise(listed: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """word, pack, place, n -> a row for each run of equal words in a batch: how often it is there, its packs and places,
    its tokens' ids and ends in bytes by both vocabularies; null where the tokens' bytes are not the word's.

    Rows come sorted by word; a word whose run goes over batches has a row for each part of it.
    """
    reachable(listed.sparkSession)
    arrow = arrow_schema(TOKENS)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        tokenised = Tokenised(a_path, b_path)
        for batch in batches:
            if not batch.num_rows:
                continue
            word, pack, place, n = batch.columns
            firsts = np.flatnonzero(np.append(True, pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)))
            runs = pa.array(np.append(firsts, len(word)), pa.int32())
            found = tokenised.columns(word.take(pa.array(firsts)).to_pylist())
            whole = [pa.array(np.add.reduceat(n.to_numpy(), firsts, dtype=np.int64)), *(pa.ListArray.from_arrays(runs, x) for x in (pack, place)), *found]
            yield pa.RecordBatch.from_arrays([x.cast(arrow.field(i).type) for i, x in enumerate(whole)], schema=arrow)

    return listed.select("word", "pack", "place", "n").repartition("word").sortWithinPartitions("word").mapInArrow(run, TOKENS)


def _key(end: Column, side: int, place: Column) -> Column:
    return F.shiftleft(F.shiftleft(end, 1) + F.lit(side).cast("long"), _SIDE) + place


def _of_end(key: Column) -> Column:
    return F.shiftright(key, _SIDE + 1)


def _side(key: Column) -> Column:
    return F.shiftright(key, _SIDE).bitwiseAND(F.lit(1).cast("long"))


def _place(key: Column) -> Column:
    return key.bitwiseAND(F.lit(_PLACE).cast("long"))


def _keys(ends: Column, side: int) -> Column:
    return F.transform(ends, lambda e, i: _key(e, side, i.cast("long")))


def align(tokens: DataFrame) -> DataFrame:
    """n, in_packs, in_places, n_a, n_groups, groups (a text) and links (A id * 2^32 + B id) of each row; null without tokens.

    A group goes from one place where both tokens end to the next. A link is a stretch of bytes from any token's end to
    the next end of either side: on it stand one A and one B token, and no other stretch has the same two. In the sorted
    keys of all ends, the key at place k that is the i-th of its own side has k - i ends of the other side before it.
    """
    df = tokens.withColumn("cuts", F.array_intersect("a_ends", "b_ends"))
    even = (F.size("cuts") == F.size("a_ids")) & (F.size("cuts") == F.size("b_ids"))  # every end is a cut: token by token
    df = df.withColumn("even", even)
    df = df.withColumn("both", F.when(~F.col("even"), F.sort_array(F.concat(_keys(F.col("a_ends"), 0), _keys(F.col("b_ends"), 1)))))
    tied = lambda x, k: (k > 0) & (_side(x) == 1) & (_of_end(F.get("both", k - 1)) == _of_end(x))  # noqa: E731  a B end where an A end is
    # Tokens of A up to and with each cut; a cut's own place gives those of B.
    df = df.withColumn("places", F.filter(F.transform("both", lambda x, k: F.when(tied(x, k), F.struct((k.cast("int") - _place(x).cast("int")).alias("a"), (_place(x).cast("int") + 1).alias("b")))), lambda x: x.isNotNull()))

    def group(to: Column, k: Column) -> Column:
        last = F.get("places", k - 1)
        a, b = (F.when(k > 0, last[side]).otherwise(0) for side in ("a", "b"))
        names = lambda ids, start, end: F.when(end - start == 1, F.get(ids, start).cast("string")).otherwise(F.array_join(F.transform(F.slice(ids, start + 1, end - start), lambda x: x.cast("string")), ","))
        return F.concat(names("a_ids", a, to["a"]), F.lit("|"), names("b_ids", b, to["b"]))

    def link(x: Column, k: Column) -> Column:
        own = _place(x).cast("int")
        other = k.cast("int") - own
        at = lambda a, b: pair(F.get("a_ids", a), F.get("b_ids", b))
        return F.when(_side(x) == 0, at(own, other)).when(~tied(x, k), at(other, own))

    pair = lambda a, b: F.shiftleft(a.cast("long"), 32) + b.cast("long")
    one = lambda a, b: F.concat(a.cast("string"), F.lit("|"), b.cast("string"))
    groups = F.when(F.col("even"), F.zip_with("a_ids", "b_ids", one)).otherwise(F.transform("places", group))
    links = F.when(F.col("even"), F.zip_with("a_ids", "b_ids", pair)).otherwise(F.filter(F.transform("both", link), lambda x: x.isNotNull()))

    return df.select(
        "n", "in_packs", "in_places", F.size("a_ids").alias("n_a"), F.size("cuts").alias("n_groups"),
        F.array_join(groups, ";").alias("groups"), links.alias("links"),
    )


def _listed(packs: DataFrame) -> DataFrame:
    return packs.select("pack", F.posexplode(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("n"))).alias("place", "x")).select("x.word", "pack", "place", "x.n")


def _stands(words: DataFrame, *names: str) -> DataFrame:
    """The named columns, pack and place of each place at which a word stands."""
    return words.select(*names, F.explode(F.arrays_zip(F.col("in_packs").alias("pack"), F.col("in_places").alias("place"))).alias("x")).select(*names, "x.pack", "x.place")


def sound_counts(packs: DataFrame, words: DataFrame) -> DataFrame:
    """words with n less what stands in documents that hold a word without tokens: these have no tokens at all."""
    unsound = words.where("n_a IS NULL")
    if unsound.isEmpty():
        return words
    places = _stands(unsound).groupBy("pack").agg(F.collect_list("place").alias("bad"))
    held = F.filter("docs", lambda d: F.arrays_overlap(d["chunks"], F.col("bad")))
    lost = packs.join(places, "pack").select("pack", F.explode(F.flatten(F.transform(held, lambda d: d["chunks"]))).alias("place")).groupBy("pack", "place").agg(F.count("*").alias("m"))
    minus = _stands(words, "id").join(lost, ["pack", "place"]).groupBy("id").agg(F.sum("m").alias("m"))
    return words.join(minus, "id", "left").withColumn("n", F.col("n") - F.coalesce("m", F.lit(0))).drop("m")


def pair_counts(words: DataFrame) -> DataFrame:
    """link -> count, best: how many links of the corpus join its two ids, and whether no A id has more with its B id.

    words: links of words, and n, how often they are there.
    """
    counts = words.select(F.explode("links").alias("link"), "n").groupBy("link").agg(F.sum("n").alias("count")).where("count > 0")
    counts = materialize(counts, "pair-counts")
    piece = F.col("link").bitwiseAND(F.lit((1 << 32) - 1))
    tops = counts.groupBy(piece.alias("piece")).agg(F.max("count").alias("top"))
    return materialize(counts.withColumn("piece", piece).join(tops, "piece").select("link", "count", (F.col("count") == F.col("top")).alias("best")), "pairs")


def scored(words: DataFrame, pairs: DataFrame, small_pairs: int) -> DataFrame:
    """in_packs, in_places, n_a, n_groups, n_links, groups of each word, and n_best and count_sum, the sums over its links."""
    known = pairs.hint("broadcast") if pairs.count() <= small_pairs else pairs
    scores = words.select("id", F.explode("links").alias("link")).join(known, "link").groupBy("id").agg(F.sum(F.col("best").cast("int")).cast("int").alias("n_best"), F.sum("count").alias("count_sum"))
    return words.select("id", "in_packs", "in_places", "n_a", "n_groups", F.size("links").alias("n_links"), "groups").join(scores, "id", "left").drop("id")


def numbered(packs: DataFrame) -> tuple[DataFrame, int]:
    """(packs, their number): they are numbered from 0 without a gap, in place of 2^33 times the task's number and on."""
    task, own = F.shiftright("pack", 33), F.col("pack").bitwiseAND(F.lit((1 << 33) - 1))
    counts = packs.groupBy(task.alias("task")).agg(F.count("*").alias("n")).orderBy("task").collect()  # a row for each task
    befores = list(accumulate((r["n"] for r in counts), initial=0))
    before = packs.sparkSession.createDataFrame([(r["task"], n) for r, n in zip(counts, befores, strict=False)], "task bigint, before bigint")
    dense = (F.col("before") + own).cast("int").alias("pack")
    return packs.join(before.hint("broadcast"), task == F.col("task")).select(*(dense if c == "pack" else c for c in packs.columns)), befores[-1]


def _of_round(df: DataFrame, k: int, rounds: int) -> DataFrame:
    """Rows of packs of a round."""
    return df.where(F.col("pack") % rounds == k)


def _restored(met, arrow):
    """A pack's documents, an Arrow batch of the given schema, from a table of its words and its own row in any order."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    own = pc.is_valid(met["docs"])
    docs = met.filter(own)["docs"].combine_chunks().flatten()
    words = met.filter(pc.invert(own)).drop_columns("docs")
    order = np.argsort(words["place"].to_numpy())
    groups = np.array(words["groups"].to_pylist(), dtype=object)[order].tolist()
    chunks = docs.field("chunks")
    said, ends = chunks.values.to_numpy(), chunks.offsets.to_numpy()

    def sums(of_words):  # over each document's chunks
        reach = np.cumsum(np.append(0, of_words.astype(np.int64)[order][said]))
        return reach[ends[1:]] - reach[ends[:-1]]

    sound = sums(pc.is_null(words["n_a"]).to_numpy()) == 0
    a, g, links, best, total = (np.where(sound, sums(pc.fill_null(words[c], 0).to_numpy()), 0) for c in ("n_a", "n_groups", "n_links", "n_best", "count_sum"))
    hashes = []
    for start, end, ok in zip(ends.tolist(), ends[1:].tolist(), sound.tolist(), strict=False):
        digest = hashlib.sha256()
        for at in range(start, end if ok else start, HASHED):
            digest.update(((";" if at > start else "") + ";".join([groups[i] for i in said[at : min(at + HASHED, end)].tolist()])).encode())
        hashes.append(digest.hexdigest() if ok and end > start else "")
    # Every token of either side ends one link, but where both end together.
    return pa.RecordBatch.from_arrays([docs.field("doc_id"), *map(pa.array, (a, links - a + g, g, links, best, total)), pa.array(hashes, pa.string())], schema=arrow)


def documents(packs: DataFrame, words: DataFrame, parts: int, rounds: int) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each document of a round's packs, from
    the scored words that stand in them. Documents with a word that has no tokens have none.

    Packs are dealt by their numbers, one to a task: dealt by hash, the fullest of ever more tasks held ever more packs.
    """
    reachable(packs.sparkSession)
    arrow = arrow_schema(ALIGNED)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        met = [batch for batch in batches if batch.num_rows]
        table = pa.Table.from_batches(met) if met else None
        numbers = pc.unique(table["pack"]) if met else []
        for number in numbers:
            yield _restored(table if len(numbers) == 1 else table.filter(pc.equal(table["pack"], number)), arrow)

    own = ("place", "n_a", "n_groups", "n_links", "n_best", "count_sum", "groups")
    whole = packs.select("pack", *(F.lit(None).cast(words.schema[c].dataType).alias(c) for c in own), "docs")
    met = words.select("pack", *own, F.lit(None).cast(packs.schema["docs"].dataType).alias("docs")).unionAll(whole)
    return met.repartitionById(parts, (F.col("pack") / rounds).cast("int")).mapInArrow(run, ALIGNED)


def align_tokenizers(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = FOLDER, files: tuple[str, str] = FILES, small_pairs: int = SMALL_PAIRS, pack_chars: int = PACK_CHARS) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs).

    documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, a row for each row of df. pairs:
    link, count, best. Null and empty texts, and texts whose tokens' bytes are not those of space + text, have no
    tokens: zeros, an empty groups_sha256, and nothing in the counts. Repeated rows count each; rows of one id stay
    rows; an empty table gives no rows. Ids are long.

    Texts are read once and never shuffled. What travels is each pack's different words, to the tokens and back, sums of
    id pairs, as many as two vocabularies have that share bytes, and each document's own sums.
    """
    rows = columns(df, doc_id=F.col(f"`{id_col}`").cast("long"), text=text_col)
    a_path, b_path = (f"{folder}/{f}" for f in files)
    with scratch(df.sparkSession) as keep:
        packs = materialize(pack(rows, Pieces(b_path).splits, pack_chars).withColumn("pack", F.monotonically_increasing_id()), "packs", ONE_BY_ONE)
        packs, n_packs = numbered(packs)
        with scratch(df.sparkSession) as keep_met:
            words = align(tokenise(_listed(packs), a_path, b_path)).withColumn("id", F.monotonically_increasing_id())
            words = sound_counts(packs, materialize(words, "words", ZSTD))
            pairs = pair_counts(words)
            met = materialize(scored(words, pairs, small_pairs), "met", ZSTD)
            keep_met(met, pairs)
        rounds = max(1, min(ROUNDS, n_packs))
        stands = _stands(met, "n_a", "n_groups", "n_links", "n_best", "count_sum", "groups")
        parts = max(1, -(-n_packs // rounds))
        done = reduce(DataFrame.unionAll, [materialize(documents(_of_round(packs, k, rounds), _of_round(stands, k, rounds), parts, rounds), "aligned") for k in range(rounds)])
        keep(done, pairs)
    return done, pairs
