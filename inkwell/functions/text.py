"""Whitespace, words and sentences as column expressions, with Java's notions of them."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What String.trim() strips, and what Character.isWhitespace() accepts.
TRIMMED = "".join(map(chr, range(0x21)))
WHITE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x1680, *range(0x2000, 0x2007), *range(0x2008, 0x200B), 0x2028, 0x2029, 0x205F, 0x3000]))
W = r"\p{javaWhitespace}"
#: Word boundaries before and behind an ASCII word character, whatever the Java version makes of \b.
BEGIN, END = r"(?<!\w)", r"(?!\w)"
SENTENCE = r"[^.!?]+[.!?]?"


def jtrim(c: Column) -> Column:
    """Without characters up to U+0020 at the ends."""
    return F.btrim(c, F.lit(TRIMMED))


def jstrip(c: Column) -> Column:
    """Without white space at the ends."""
    return F.btrim(c, F.lit(WHITE))


def is_blank(c: Column) -> Column:
    return F.ltrim(c, F.lit(WHITE)) == ""  # from the left it ends at the first character that stays; from the right all is walked first


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", " ")


def word_count(c: Column) -> Column:
    """Words between white space; 0 for null and blank texts."""
    return F.when(c.isNull() | is_blank(c), 0).otherwise(F.regexp_count(jtrim(c), F.lit(r"\s+")) + 1).cast("int")


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units: characters beyond U+FFFF count twice. Null stays null."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def extract_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) within functions of array elements, where what is named several times is made several times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def no_runs(c: Column) -> Column:
    """Runs of spaces and tabs as one space; a plain search goes before the pattern."""
    return F.when(F.contains(c, F.lit("  ")) | F.contains(c, F.lit("\t")), F.regexp_replace(c, r"[ \t]{2,}", " ")).otherwise(c)


def sentences(c: Column) -> Column:
    """Trimmed sentences of the text with white space collapsed; a text without any is its own sentence."""
    found = lambda flat: F.filter(F.transform(extract_all(flat, SENTENCE), jtrim), lambda s: s != "")
    some = lambda flat: once(found(flat), lambda ss: F.when(F.size(ss) == 0, F.array(flat)).otherwise(ss))
    return once(collapse(jtrim(c)), lambda flat: F.when(flat == "", F.array().cast("array<string>")).otherwise(some(flat)))


def edges(original: Column, inner: Column) -> Column:
    """inner between the white space that original has at its ends (all of it leading if there is nothing else)."""
    left = F.regexp_extract(original, rf"^{W}*+", 0)
    right = F.when(is_blank(original), "").otherwise(F.regexp_extract(original, rf"{W}*+\z", 0))
    return F.concat(left, inner, right)


def has_any(lower: Column, words: Iterable[str]) -> Column:
    """Whether a lower-case text holds any of the words: a plain search, far cheaper than patterns, to go before them."""
    found = F.lit(False)
    for w in dict.fromkeys(words):
        found = found | F.contains(lower, F.lit(w))
    return found


def says_any(c: Column, words: Iterable[str]) -> Column:
    """has_any for a text in any case, within functions of array elements: there the lower case is made once, not for each word."""
    return F.exists(F.array(F.lower(c)), lambda lower: has_any(lower, words))
