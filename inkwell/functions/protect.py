"""Code spans and quoted texts, which rules leave alone, as column expressions.

A quote opens at a quotation mark that stands at a word's beginning and closes at its partner at a word's end; a mark
that opens and is never closed ends the search for quotes, but not for code. All of it is one regular expression of
three alternatives: protected, plain text, and the dead tail behind an unclosed mark with the plain text before it. One
replacement writes separators into the text, so that each text is searched once. Loops are possessive, which Java runs
without recursion, so long texts don't exhaust the stack; runs of a class of characters are atomic groups, which Java
walks several times faster than possessive ones, and what takes any character is a dot: a possessive class of all
characters took ten times as long on long texts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WHITE, W, has_any, once

CODE = r"(?:```(?s:.*?)```|`[^`\r\n]*`)"
#: Backslashes that the test for an escape looks back at; longer runs are shortened before.
_LOOK = 128
_FREE = rf"(?<!(?<!\\)(?:\\\\){{0,{_LOOK // 2}}}\\)"
#: Characters for private use that no rule of quotes knows: one stands in for a backslash of a long run, three begin a
#: piece, its plain part and its dead tail. The next says that a text has one of these itself, followed by which it was.
_STAND_IN, _BEGIN, _PLAIN, _DEAD, _OWN = "\ue000", "\ue002", "\ue003", "\ue004", "\ue001"
_OWNS = {c: _OWN + chr(0xE010 + k) for k, c in enumerate((_OWN, _STAND_IN, _BEGIN, _PLAIN, _DEAD))}
_PAIRS = (('"', '"'), ("'", "'"), ("“", "”"), ("‘", "’"))


def _opens(q: str) -> str:
    return rf"(?={q}){_FREE}(?<![^{W}(\[{{<:=\-,]){q}(?!{W}|\z)" if q in "\"'" else f"(?={q}){_FREE}{q}"


def _closes(q: str) -> str:
    return rf"(?={q}){_FREE}(?<!{W}){q}(?![^{W}.,!?:;)\]}}>])"


_OPENS = "(?:" + "|".join(_opens(o) for o, _ in _PAIRS) + ")"
_QUOTED = "(?:" + "|".join(rf"{_opens(o)}(?:(?>[^`{c}]+)|{CODE}|(?!{_closes(c)})[`{c}])*+{c}" for o, c in _PAIRS) + ")"
_MARKS = "`\"'“‘"
#: The marks as a class of characters, and three more that open nothing. With both curly marks by themselves threads get
#: in each other's way: Java nests such a class, and eight threads on it took ten times as long as one.
_MARK = "`\"'‘-“"
_RUN = rf"(?:(?>[^{_MARK}]+)|(?!{CODE}|{_OPENS})[{_MARK}])"
_KEPT = rf"(?=[{_MARK}])(?:{CODE}|{_QUOTED})"
#: Where a run is followed by neither a protected piece nor the end, a mark stands that opens and is never closed.
PIECES = rf"({_KEPT})|({_RUN}++)(?=\z|{_KEPT})|((?s:.+))"
_TAIL = rf"({CODE})|((?:(?>[^`]+)|(?!{CODE})`)++)"


def _piece(text: Column, protected: Column) -> Column:
    return F.struct(text.alias("t"), protected.alias("p"))


def segments(text: Column) -> Column:
    """array<struct<t string, p boolean>>: the text in pieces, p where it is protected. Texts without marks are one piece.

    A mark is escaped by an odd number of backslashes before it, however many. Look-behinds are bounded, so in texts
    with longer runs pairs of backslashes before the last one or two give way to stand-ins. What is put back into the
    pieces hangs on no text, so the time grows with the text alone, however many pieces it has.
    """
    own = text
    for c, said in _OWNS.items():
        own = F.replace(own, F.lit(c), F.lit(said))
    deep = F.contains(text, F.lit("\\" * _LOOK))
    shown = F.when(deep, F.regexp_replace(own, r"\\\\(?=\\)", _STAND_IN * 2)).otherwise(own)
    return F.when(has_any(text, _MARKS), _pieces(shown)).otherwise(F.array(_piece(text, F.lit(False))))


def _bare(t: Column) -> Column:
    """A piece without separators."""
    return F.replace(F.replace(t, F.lit(_PLAIN), F.lit("")), F.lit(_DEAD), F.lit(""))


def _shown(t: Column) -> Column:
    """A piece without separators as it was in the text."""
    back = F.replace(t, F.lit(_STAND_IN), F.lit("\\"))
    for c, said in reversed(_OWNS.items()):
        back = F.replace(back, F.lit(said), F.lit(c))
    return F.when(F.contains(t, F.lit(_OWN)) | F.contains(t, F.lit(_STAND_IN)), back).otherwise(t)


def _pieces(text: Column) -> Column:
    """Pieces of a text that holds no separator of its own."""
    apart = lambda t, pattern, to: F.filter(F.split(F.regexp_replace(t, pattern, to), _BEGIN), lambda x: x != "")  # noqa: E731  a first one, empty, comes before the first separator
    whole = lambda x: once(_bare(x), lambda t: _piece(_shown(t), ~F.startswith(x, F.lit(_PLAIN))))
    tail = lambda x: F.transform(apart(_bare(x), _TAIL, f"{_BEGIN}$1{_PLAIN}$2"), whole)
    # "protected, plain mark", "plain mark, plain, dead mark" or "both marks, dead tail"
    found = apart(text, PIECES, f"{_BEGIN}$1{_PLAIN}$2{_DEAD}$3")
    return F.flatten(F.transform(found, lambda x: F.when(F.startswith(x, F.lit(_PLAIN + _DEAD)), tail(x)).otherwise(F.array(whole(x)))))


def plain(segs: Column) -> Column:
    """The texts of the pieces that aren't protected."""
    return F.transform(F.filter(segs, lambda s: ~s["p"]), lambda s: s["t"])


def transformed(segs: Column, change: Callable[[Column], Column]) -> Column:
    """array<string>: the pieces, plain ones changed."""
    return F.transform(segs, lambda s: F.when(s["p"], s["t"]).otherwise(change(s["t"])))


def joined(segs: Column, outs: Column) -> Column:
    """The changed pieces as a text. A changed piece that lost all white space towards a protected one gets it back:
    the whole run if it holds a line end, else one space; pieces that became empty get none."""

    def white(c: Column, at: Callable[[Column, Column], Column]) -> Column:  # a look at one end, where a pattern would search all of a long piece
        return reduce(or_, (at(c, F.lit(w)) for w in WHITE))

    def one(out: Column, i: Column) -> Column:
        own = F.get(segs, i)["t"]
        before = F.coalesce(F.get(segs, i - 1)["p"], F.lit(False))
        after = F.coalesce(F.get(segs, i + 1)["p"], F.lit(False))
        left, right = F.regexp_extract(own, rf"^{W}*+", 0), F.regexp_extract(own, rf"{W}*+\z", 0)
        kept = lambda run: F.when(run.rlike(r"[\r\n]"), run).otherwise(" ")
        head = F.when(before & white(own, F.startswith) & ~white(out, F.startswith), kept(left)).otherwise("")
        tail = F.when(after & white(own, F.endswith) & ~white(out, F.endswith), kept(right)).otherwise("")
        return F.when(F.get(segs, i)["p"] | (out == ""), out).otherwise(F.when(before | after, F.concat(head, out, tail)).otherwise(out))

    return F.when(F.size(segs) == 1, F.get(outs, F.lit(0))).otherwise(F.array_join(F.transform(outs, one), ""))
