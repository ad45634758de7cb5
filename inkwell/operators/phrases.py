"""Phrases said twice running, in Arrow batches: the one rule whose steps depend on what the last one found."""

from __future__ import annotations

import re
import sys
from itertools import compress
from operator import eq

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import TRIMMED, WHITE

_EDGE = ",.?!:;\"'()"
_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")
#: Workers get this module's functions with the plan, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _ends_sentence(token: str) -> bool:
    tail = token[len(token.rstrip(_EDGE)) :]
    return any(c in ".?!" for c in tail)


def _repeats(keys: list[str], most: int) -> list[tuple[int, int]]:
    """(place, size) of the phrases that are said again at once, chosen from the left, the longest at each place.

    Words that equal the word size places on make runs; a phrase of that size stands wherever a run has size words left.
    """
    longest: dict[int, int] = {}
    for size in range(1, most + 1):
        run = 0
        for place in range(len(keys) - size - 1, -1, -1):
            run = run + 1 if keys[place] == keys[place + size] else 0
            if run >= size and any(keys[place : place + size]):
                longest[place] = size
    chosen, free = [], 0
    for place in sorted(longest):
        if place >= free:
            chosen.append((place, longest[place]))
            free = place + 2 * longest[place]
    return chosen


def _without(tokens: list[str], keys: list[str], chosen: list[tuple[int, int]]) -> tuple[list[str], list[str]]:
    """Words and keys without the second time of each phrase; the marks behind it go to the first time's last word."""
    stays = [True] * len(tokens)
    words = list(tokens)
    for place, size in chosen:
        last, end = place + size - 1, place + 2 * size - 1
        marks = tokens[end][len(tokens[end].rstrip(_EDGE)) :]
        if not words[last].endswith(marks):
            words[last] += marks
        stays[place + size : end + 1] = [False] * size
    return list(compress(words, stays)), list(compress(keys, stays))


def reduce_text(text: str, most: int, fold_case: bool) -> tuple[str, list[str]]:
    """The text, verbatim if nothing is said twice, and the phrases taken out. Up to five walks a sentence."""
    key = lambda t: t.strip(_EDGE).lower() if fold_case else t.strip(_EDGE)
    phrases: list[str] = []
    out: list[str] = []
    sentence: list[str] = []

    def flush() -> None:
        tokens, keys = sentence[:], [key(t) for t in sentence]
        for _ in range(5):  # what was taken out may bring others together
            chosen = _repeats(keys, most)
            if not chosen:
                break
            phrases.extend(" ".join(filter(None, keys[place : place + size])) for place, size in chosen)
            tokens, keys = _without(tokens, keys, chosen)
        out.extend(tokens)
        sentence.clear()

    tokens = _SPACE.split(text.strip(TRIMMED))
    keys = [key(t) for t in tokens]
    if not any(any(map(eq, keys, keys[n:])) for n in range(1, most + 1)):
        return text, []  # no word comes again near enough
    for token in tokens:
        sentence.append(token)
        if _ends_sentence(token):
            flush()
    flush()
    if not phrases:
        return text, []
    left = text[: len(text) - len(text.lstrip(WHITE))]
    right = text[len(text.rstrip(WHITE)) :] if len(left) < len(text) else ""
    return left + " ".join(out) + right, phrases


def _reduced(pieces: pd.Series, most: pd.Series, fold_case: pd.Series) -> pd.DataFrame:
    texts, phrases = [], []
    for row, size, fold in zip(pieces, most, fold_case, strict=True):
        done = [(None, []) if t is None else reduce_text(t, int(size), bool(fold)) for t in (row if row is not None else [])]
        texts.append([t for t, _ in done])
        phrases.append([p for _, ps in done for p in ps])
    return pd.DataFrame({"texts": texts, "phrases": phrases})


def reduce_pieces(pieces: Column, most: Column, fold_case: Column) -> Column:
    """texts: the pieces (null: protected, stays null) without what is said twice; phrases: what was taken out."""
    return F.pandas_udf(_reduced, "texts array<string>, phrases array<string>")(pieces, most, fold_case)
