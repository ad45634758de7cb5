"""Token counters: words, or byte-pair encoding by a rank file. A counter is a function of a string column.

A counter that a caller writes in Python may fail on some texts; ``python_counter`` gives null there, which the plan
around the rules takes for a failed step.
"""

from __future__ import annotations

import base64
import heapq
import sys
from collections.abc import Callable, Iterator, Mapping
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_blank, word_count

Counter = Callable[[Column], Column]
words: Counter = word_count
#: How text is cut before merging, as public byte-level vocabularies of 50k entries have it.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Different pieces whose tokens a task remembers: the last ones, from half of this on.
REMEMBERED = 100_000
#: Bytes or characters of a piece up to which it is merged without a heap, and remembered.
SHORT = 48
#: Characters of a text beyond which its pieces are cut one at a time.
LONG = 1 << 20


#: Workers get this module's functions with the plan, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Lines of a base64 token and its rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


def merge(raw: bytes, ranks: Mapping[bytes, int]) -> list[bytes]:
    """The tokens of one piece: of all neighbours whose joint bytes have a rank those of the least, the leftmost first,
    become one, until none is left.

    Pairs wait in a heap by (rank, place); ends[i] is where the part that begins at i ends, 0 where none begins any
    more. A pair is out of date if one of its parts has grown or gone. A piece of n bytes takes n log n steps.
    """
    n = len(raw)
    ends, befores = list(range(1, n + 1)), list(range(-1, n))
    heap = [(ranks[raw[i : i + 2]], i, i + 1, i + 2) for i in range(n - 1) if raw[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, left, right, stop = heapq.heappop(heap)
        if ends[left] != right or ends[right] != stop:
            continue
        ends[left], ends[right] = stop, 0
        befores[stop] = left
        for a, b in ((befores[left], left), (left, stop)):
            if a >= 0 and b < n and (rank := ranks.get(raw[a : ends[b]])) is not None:
                heapq.heappush(heap, (rank, a, b, ends[b]))
    out, at = [], 0
    while at < n:
        out.append(raw[at : ends[at]])
        at = ends[at]
    return out


def merged(raw: bytes, ranks: Mapping[bytes, int]) -> int:
    """How many tokens merge() makes of one piece. Short pieces need no heap: a list of their pairs' ranks, of which the
    least and leftmost is sought again each time, costs less."""
    if len(raw) > SHORT:
        return len(merge(raw, ranks))
    none, get = sys.maxsize, ranks.get
    cuts, found = list(range(len(raw) + 1)), [get(raw[i : i + 2], none) for i in range(len(raw) - 1)]
    while found and (least := min(found)) != none:
        i = found.index(least)
        del cuts[i + 1], found[i]
        if i:
            found[i - 1] = get(raw[cuts[i - 1] : cuts[i + 1]], none)
        if i < len(found):
            found[i] = get(raw[cuts[i] : cuts[i + 2]], none)
    return len(cuts) - 1


def _counts(batches: Iterator[pa.Array], raw: bytes, pattern: str) -> Iterator[pa.Array]:
    """Tokens of each text of the batches; null has 0.

    Texts are taken out of Arrow's batch one by one, long ones piece by piece. What is remembered is short pieces, so
    many and no longer than the task, so memory doesn't grow with the input.
    """
    import regex

    ranks, cut = read_ranks(raw), regex.compile(pattern)
    known: dict[str, int] = {}
    older: dict[str, int] = {}
    for texts in batches:
        sums = []
        for text in texts:
            t, total = text.as_py() or "", 0
            for piece in cut.findall(t) if len(t) <= LONG else (m.group() for m in cut.finditer(t)):
                n = known.get(piece)
                if n is None:
                    n = older.get(piece)
                    if n is None:
                        n = merged(piece.encode(), ranks)
                    if len(piece) <= SHORT:
                        if len(known) >= REMEMBERED // 2:
                            known, older = {}, known
                        known[piece] = n
                total += n
            sums.append(total)
        yield pa.array(sums, pa.int32())


def bpe(path: str, pattern: str = PATTERN) -> Counter:
    """Counts tokens by the rank file at path (base64 token and rank on each line), which only the driver has to reach.

    Null and blank texts have 0. Bytes without a rank are a token each. A task remembers what it has merged, so a word
    that comes again costs a look-up. Counts are those of the given file and must not be taken for another vocabulary's.
    """
    raw = Path(path).read_bytes()

    @F.arrow_udf("int")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _counts(batches, raw, pattern)

    return lambda c: count(F.when(is_blank(c), F.lit(None).cast("string")).otherwise(c))


def python_counter(function: Callable[[str], int]) -> Counter:
    """A counter of the caller's, in Arrow batches; null for texts on which it raises. Null and blank texts have 0."""

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> int | None:
            if t is None:
                return 0
            try:
                return int(function(t))
            except Exception:  # the row's step tells of it
                return None

        return pd.Series([one(t) for t in texts], dtype="Int32")

    return lambda c: count(F.when(is_blank(c), F.lit(None).cast("string")).otherwise(c))


def encoder_name(path: str | None = None) -> str:
    """What to call the counts in reports."""
    return f"BPE:{Path(path).stem}" if path else "WORDS"
