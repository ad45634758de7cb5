"""Benchmark decontamination: word n-grams seed candidate passages, Smith-Waterman alignment scores them.

A test item's n-grams are looked up in every document; where some stand, the words around make a window. A copy with
words changed or put in nearly everywhere may hold none of them; such a copy must hold so many of the item's words near
one another that these find it. Windows that share enough words with the item for a leak are aligned with it word by
word, so that copies with words changed, left out or put in still score high. How often an n-gram, a word or a passage
stands in the corpus decides nothing; words that are rare among the items only go first.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, fresh, map_rows, materialize

#: Words of a seed at most. Shorter items have shorter seeds, as an edited copy may leave no four words in a row.
SEED = 4
#: Seeds of so many words for items of fewer words than this.
SHORT = ((20, 2), (50, 3))
#: Words of windows whose alignments are remembered at once in a task: copies of a window cost one alignment.
REMEMBERED = 4_000_000
#: Places of grams in items that are looked at together.
ROOMS = 1_000_000
#: Leaks that hold no seed are sought where they have so many equal words at least; shorter items by their grams alone.
FEW = 4
#: Alignment values of items of under half so many words fit in 32 bits.
SMALL = 1 << 14
#: Words of test items that are held at once; larger benchmarks are searched in blocks.
BLOCK_WORDS = 500_000
#: A leak: this share of the best possible score, or this many equal words of which at most a fifth are edited.
LEAST_SCORE = 0.5
LEAST_WORDS = 13
MATCH, MISS, GAP = 2, -1, -1
_WORDS = re.compile(r"\w+")
_P = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Letters, digits and low lines, in lower case."""
    return _WORDS.findall((text or "").lower())


def codes_at(ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit code of the n word ids from each of the places."""
    h = np.full(at.size, n, np.uint64)
    for k in range(n):
        h = (h ^ (h >> np.uint64(29))) * _P + ids[at + k].astype(np.uint64) + np.uint64(1)
    return h ^ (h >> np.uint64(32))


def gram_codes(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit code of each run of n word ids."""
    return codes_at(ids, np.arange(max(0, len(ids) - n + 1)), n)


@dataclass
class Index:
    """A block of test items: word ids, and for each gram code the items that hold it."""

    vocabulary: dict[str, int]
    items: list[tuple[int, np.ndarray]]
    #: by gram length: sorted codes, where each begins in the next, and (item place, first offset, last offset) for each item that holds it
    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    least: float = LEAST_SCORE
    least_words: int = LEAST_WORDS
    seeds: tuple[int, ...] = ()

    def __post_init__(self) -> None:
        self.sizes = np.array([i.size for _, i in self.items], np.int64)
        self.slack = np.maximum(4, self.sizes // 4)
        self.bags = [np.unique(i, return_counts=True) for _, i in self.items]
        self._loosen()

    def _loosen(self) -> None:
        """What finds leaks without a seed: for each word the items that look out for it, how many such words each needs, how near.

        An item need not look out for all its words: those that most items hold are left out as long as a third of what
        it needs stays, and count as if they were there.
        """
        held = np.zeros(len(self.vocabulary) + 1, np.int64)
        for own, _ in self.bags:
            held[own] += 1
        self.need = np.zeros(len(self.items), np.int64)
        self.span = np.maximum(np.ceil((3 - 2 * self.least) * self.sizes), np.ceil(1.25 * self.sizes)).astype(np.int64)
        heads, places = [], []
        for place, (own, counts) in enumerate(self.bags):
            enough = unseeded_words(int(self.sizes[place]), self.seeds[place], self.least, self.least_words)
            if enough is None or enough < FEW:
                continue
            order = np.argsort(-held[own], kind="stable")
            out = int(np.searchsorted(np.cumsum(counts[order]), enough - max(1, enough // 3), side="right"))
            self.need[place] = enough - int(counts[order[:out]].sum())
            heads.append(own[order[out:]])
            places.append(np.full(own.size - out, place))
        heads = np.concatenate(heads) if heads else np.zeros(0, np.int64)
        order = np.argsort(heads, kind="stable")
        self.lookers = np.concatenate(places)[order] if places else np.zeros(0, np.int64)
        self.looked = np.searchsorted(heads[order], np.arange(len(self.vocabulary) + 1))

    @classmethod
    def build(cls, rows: list[tuple[int, str]], n: int, least: float = LEAST_SCORE, least_words: int = LEAST_WORDS) -> Index:
        vocabulary: dict[str, int] = {}
        items = []
        for key, text in rows:
            found = words(text)
            if found:
                items.append((key, np.array([vocabulary.setdefault(w, len(vocabulary)) for w in found], np.int64)))
        by: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        seeds = []
        for place, (_, ids) in enumerate(items):
            size = min(n, len(ids), next((k for under, k in SHORT if len(ids) < under), n))  # a shorter item is one gram
            seeds.append(size)
            codes, first = np.unique(h := gram_codes(ids, size), return_index=True)
            last = h.size - 1 - np.unique(h[::-1], return_index=True)[1]
            by.setdefault(size, []).append((codes, np.stack([np.full(codes.size, place), first, last], axis=1)))
        grams = {}
        for size, found in by.items():
            codes = np.concatenate([c for c, _ in found])
            order = np.argsort(codes, kind="stable")
            codes, first = np.unique(codes[order], return_index=True)
            grams[size] = (codes, np.r_[first, order.size], np.concatenate([w for _, w in found])[order])
        return cls(vocabulary, items, grams, least, least_words, tuple(seeds))

    def stretches(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(item place, start, end): where in the document each item may lie, disjoint for an item.

        A gram at p that the item holds at offset o puts the item at p - o, with room for words put in. Room is taken
        for all offsets of a gram at once, from the first to the last: their rooms overlap, so nothing more is taken,
        and texts that say one thing over and over cost no more than others. Rooms that meet are one stretch.
        """
        known = ids >= 0
        rooms: list[np.ndarray] = []
        for size, (codes, first, where) in self.grams.items():
            if len(ids) < size:
                continue
            run = known[: len(ids) - size + 1].copy()
            for k in range(1, size):
                run &= known[k : len(ids) - size + 1 + k]
            run = np.flatnonzero(run)
            if not run.size:
                continue
            h = codes_at(ids, run, size)
            at = np.searchsorted(codes, h)
            at[at == codes.size] = 0
            hit = np.flatnonzero(codes[at] == h)
            if not hit.size:
                continue
            run, at = run[hit], at[hit]
            many = first[at + 1] - first[at]
            total = np.cumsum(many)
            cuts = [0, *(np.flatnonzero(np.diff(total // ROOMS)) + 1).tolist(), run.size] if total[-1] > ROOMS else [0, run.size]
            for low, high in zip(cuts, cuts[1:], strict=False):
                m = many[low:high]
                entry = where[np.repeat(first[at[low:high]] + m - np.cumsum(m), m) + np.arange(m.sum())]
                place, p = entry[:, 0], np.repeat(run[low:high], m)
                n, slack = self.sizes[place], self.slack[place]
                room = np.column_stack((place, np.maximum(0, p - entry[:, 2] - slack), np.minimum(len(ids), p - entry[:, 1] + n + slack)))
                rooms.append(merged(room) if len(cuts) > 2 else room)
        rooms += self.crowds(ids)
        return [tuple(x) for x in merged(np.concatenate(rooms)).tolist()] if rooms else []

    def crowds(self, ids: np.ndarray) -> list[np.ndarray]:
        """Rooms around places where as many of an item's words stand as near to one another as a leak without a seed needs."""
        if not self.lookers.size:
            return []
        at = np.flatnonzero(ids >= 0)
        many = self.looked[ids[at] + 1] - self.looked[ids[at]]
        total = int(many.sum())
        if not total:
            return []
        found = []
        step, reach = -(-ids.size // -(-total // ROOMS)), int(self.span.max())
        for begin in range(0, ids.size, step):
            part = slice(*np.searchsorted(at, (begin, begin + step + reach)))
            p, m = np.repeat(at[part], many[part]), many[part]
            place = self.lookers[np.repeat(self.looked[ids[at[part]]] + m - np.cumsum(m), m) + np.arange(m.sum())]
            order = np.argsort(place, kind="stable")
            place, p = place[order], p[order]
            last = np.arange(p.size) + self.need[place] - 1
            full = np.flatnonzero(last < p.size)
            full = full[place[last[full]] == place[full]]
            full = full[p[last[full]] - p[full] < self.span[place[full]]]
            if full.size:
                a, b, w = place[full], p[last[full]], self.span[place[full]]
                found.append(merged(np.column_stack((a, np.maximum(0, b - w + 1), np.minimum(ids.size, p[full] + w)))))
        return found


def unseeded_words(size: int, n: int, least: float, least_words: int) -> int | None:
    """Equal words that a leak of an item has at least if no n of them stand in a row on both sides; None: there is no such leak.

    Runs of equal words are then n - 1 long at most, with an edit between any two, so e equal words come with at least
    ceil(e / (n - 1)) - 1 edits. By score a leak has 2 e - edits >= 2 least size; by words at most a quarter as many
    edits as equal words.
    """
    if n < 2:
        return None
    equal = np.arange(1, size + 1)
    edits = -(-equal // (n - 1)) - 1
    leak = (MATCH * equal - edits >= MATCH * least * size - 1e-9) | ((equal >= least_words) & (edits * 4 <= equal))
    return int(equal[leak][0]) if leak.any() else None


def merged(rooms: np.ndarray) -> np.ndarray:
    """Rows (item place, start, end) with those of an item that overlap made one."""
    if not len(rooms):
        return rooms
    rooms = rooms[np.lexsort((rooms[:, 1], rooms[:, 0]))]
    apart = rooms[:, 0] * (int(rooms[:, 2].max()) + 1)  # keeps items apart under one running maximum
    reach = np.maximum.accumulate(rooms[:, 2] + apart)
    new = np.flatnonzero(np.r_[True, rooms[1:, 1] + apart[1:] > reach[:-1]])
    return np.stack([rooms[new, 0], rooms[new, 1], np.maximum.reduceat(rooms[:, 2], new)], axis=1)


def shared_words(bag: tuple[np.ndarray, np.ndarray], window: np.ndarray) -> int:
    """Words that both hold, each as often as both do: no alignment has more equal ones. bag: an item's words and how often."""
    own, counts = bag
    at = np.searchsorted(own, window)
    at[at == own.size] = 0
    return int(np.minimum(counts, np.bincount(at[own[at] == window], minlength=own.size)).sum())


def may_leak(bag: tuple[np.ndarray, np.ndarray], window: np.ndarray, least: float, least_words: int) -> bool:
    """False only where no alignment is a leak: too few of the item's words are there, or nowhere near enough to one another.

    A leak by score has that share of the item's words and at most as many words put in as the item has; one by words
    at most a quarter as many. So it lies within twice the item's length.
    """
    size = int(bag[1].sum())
    enough = min(least * size, least_words)
    if shared_words(bag, window) < enough:
        return False
    if window.size <= 2 * size:
        return True
    sums = np.r_[0, np.cumsum(np.isin(window, bag[0]))]
    return bool((sums[2 * size :] - sums[: -2 * size]).max() >= enough)


def _rows(item: np.ndarray, window: np.ndarray, base: int, local: bool) -> tuple[int, int, int]:
    """(best, i, j): the best value of an alignment that ends behind i words of the item and j of the window, and where.

    A value is score * base + equal words, so that of equal scores the one with more equal words wins. Row by row, in
    memory of one row; gaps along a row are a running maximum of value plus distance. local: alignments begin
    anywhere, else at the first words.
    """
    m = window.size
    kind = np.int32 if base == SMALL else np.int64
    along = np.arange(m + 1, dtype=kind) * kind(-GAP * base)
    last = np.zeros(m + 1, kind) if local else -along
    best, where = (0, (0, 0)) if local else (-(1 << 62), (0, 0))
    row = np.empty(m + 1, kind)
    for i, w in enumerate(item, 1):
        row[0] = 0 if local else i * GAP * base
        np.add(last[:-1], np.where(window == w, kind(MATCH * base + 1), kind(MISS * base)), out=row[1:])
        np.maximum(row, last + kind(GAP * base), out=row)
        if local:
            np.maximum(row, 0, out=row)
        row += along
        np.maximum.accumulate(row, out=row)
        row -= along
        j = int(row.argmax())
        if row[j] > best:
            best, where = int(row[j]), (i, j)
        last, row = row, last
    return best, *where


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int, int, int]:
    """Best local alignment (Smith-Waterman): score, equal words, edited places, start and end in the window.

    Memory is a few rows, whatever the lengths. A second run, backwards from the end and anchored there, finds the start.
    """
    base = SMALL if item.size < SMALL // 2 and window.size < 1 << 16 else 1 << 24
    best, i, j = _rows(item, window, base, True)
    if not best:
        return 0, 0, 0, 0, 0
    _, _, back = _rows(item[:i][::-1], window[max(0, j - 3 * i) : j][::-1], base, False)
    score, equal = divmod(best, base)
    return score, equal, MATCH * equal - score, j - back, j


def _blocks(benchmark: DataFrame, block_words: int) -> list[list[tuple[int, str]]]:
    """The test items in blocks of about block_words, one at a time on the driver."""
    total = benchmark.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    count = max(1, -(-total // block_words))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    for k in range(count):
        yield [(r["item_id"], r["text"]) for r in benchmark.where(part == k).collect()]


LEAKS = "doc_key long, doc_id long, item_id long, score double, equal_words int, edited int, start_word int, end_word int"


def find_leaks(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = SEED, least: float = LEAST_SCORE, least_words: int = LEAST_WORDS, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """A row for each leak: doc_key, doc_id, item_id, score (0 to 1), equal_words, edited, start_word, end_word (of the best place).

    Each block of the benchmark is searched in all documents in place, and windows are aligned there: neither texts nor
    windows are shuffled, and documents that hold a common passage stay where they are, so no key gathers them. Whether
    a document leaks depends on it and the item alone. doc_key tells rows with equal ids and other texts apart.
    Null or wordless texts and items match nothing, and empty tables on either side give no rows; equal items are each
    found; repeated rows are each a leak, but rows equal in id and text have one doc_key. Texts and items may be of any
    length and say one thing over and over: time grows with the product of an item and the stretch it may lie in, memory
    with their sum. Other columns don't matter.
    """
    docs = columns(df, doc_key=key_of(id_col, text_col), doc_id=id_col, text=text_col)
    items = columns(benchmark, item_id=item_col, text=item_text_col).where("text is not null")
    found = None
    for block in _blocks(items, block_words):
        some = _leaks_of(docs, Index.build(block, n, least, least_words), least, least_words)
        found = some if found is None else found.unionByName(some)
    return found


def key_of(id_col: str, text_col: str):
    return F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))


def _leaks_of(docs: DataFrame, index: Index, least: float, least_words: int) -> DataFrame:
    remembered: dict[tuple[int, bytes], tuple[int, int, int, int, int] | None] = {}
    held = [0]

    def aligned(place: int, window: np.ndarray) -> tuple[int, int, int, int, int] | None:
        """The alignment with the item, None where too few words are shared for a leak."""
        key = (place, window.tobytes())
        if key not in remembered:
            held[0] += window.size
            if held[0] > REMEMBERED:
                remembered.clear()
                held[0] = window.size
            remembered[key] = align(index.items[place][1], window) if may_leak(index.bags[place], window, least, least_words) else None
        return remembered[key]

    def search(rows: dict) -> dict:
        out: dict[str, list] = {c.split()[0]: [] for c in LEAKS.split(", ")}
        get = index.vocabulary.get
        for key, doc_id, text in zip(rows["doc_key"], rows["doc_id"], rows["text"], strict=True):
            ids = np.array([get(w, -1) for w in words(text)], np.int32)
            if not ids.size:
                continue
            for place, start, end in index.stretches(ids):
                item_id, item = index.items[place]
                found = aligned(place, ids[start:end])
                # An alignment that reaches the stretch's end may go on behind it.
                while found and ((found[3] == 0 and start) or (found[4] == end - start and end < ids.size)):
                    start, end = max(0, start - item.size * (found[3] == 0)), min(ids.size, end + item.size * (found[4] == end - start))
                    found = aligned(place, ids[start:end])
                if not found:
                    continue
                points, equal, edits, low, high = found
                share = points / (MATCH * item.size)
                if share >= least or (equal >= least_words and edits * 4 <= equal):
                    for name, value in zip(out, (key, doc_id, item_id, share, equal, edits, start + low, start + high), strict=True):
                        out[name].append(value)
        return out

    scored = materialize(map_rows(docs, search, LEAKS), "passages")
    rest = ("score", "equal_words", "edited", "start_word", "end_word")
    best = F.max_by(F.struct(*rest), F.struct("score", "equal_words", -F.col("start_word")))
    return scored.groupBy("doc_key", "doc_id", "item_id").agg(best.alias("b")).select("doc_key", "doc_id", "item_id", *(F.col(f"b.{c}").alias(c) for c in rest))


def drop_leaks(df: DataFrame, leaks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that hold no leak, all columns as they are. Keys are a written table, joined by its size.

    Rows are told apart by id and text. Empty tables on either side do no harm, and columns of any name are left alone.
    """
    (key,) = fresh(df, "key")
    keys = materialize(leaks.select(F.col("doc_key").alias(key)).distinct(), "leaks")
    return df.withColumn(key, key_of(id_col, text_col)).join(keys, key, "left_anti").select(*(F.col(f"`{c}`") for c in df.columns))
