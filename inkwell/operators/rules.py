"""The fifteen rules, each a function of a text column that gives the new text and the record of changes.

A rule gets a Stage to put intermediate results into columns of their own: one projection each keeps expressions from
being evaluated again wherever they are used, and keeps plans small when many rules follow one another.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import protect
from ..functions.text import BEGIN, END, SENTENCE, WHITE, W, collapse, edges, extract_all, has_any, jstrip, jtrim, no_runs, once, says_any, sentences, word_count
from . import vocabulary as v

STRINGS = "array<string>"


@dataclass
class Params:
    """A rule's parameters as given; reading one never fails, but falls back to its default."""

    given: dict[str, object] = field(default_factory=dict)

    def integer(self, name: str, default: int) -> int:
        value = self.given.get(name)
        try:
            return int(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else int(str(value), 10)
        except (ValueError, OverflowError):
            return default

    def number(self, name: str, default: float) -> float:
        try:
            value = self.given.get(name)
            return default if isinstance(value, bool) else float(value)  # type: ignore[arg-type]
        except (TypeError, ValueError):
            return default

    def truth(self, name: str, default: bool) -> bool:
        value = self.given.get(name)
        return default if value is None else value if isinstance(value, bool) else str(value).lower() == "true"


@dataclass
class RowParams(Params):
    """Parameters that each row has for itself, in a map of strings; reading one gives a column, with the same defaults."""

    column: Column | None = None

    def _text(self, name: str) -> Column:
        return F.element_at(self.column, F.lit(name))

    def integer(self, name: str, default: int) -> Column:  # type: ignore[override]
        return F.coalesce(self._text(name).try_cast("int"), F.lit(default))

    def number(self, name: str, default: float) -> Column:  # type: ignore[override]
        return F.coalesce(self._text(name).try_cast("double"), F.lit(default))

    def truth(self, name: str, default: bool) -> Column:  # type: ignore[override]
        return F.coalesce(F.lower(self._text(name)) == "true", F.lit(default))


def _lit(value: object) -> Column:
    """A parameter as a column, whether it is the same for all rows or not."""
    return value if isinstance(value, Column) else F.lit(value)


def _by_tier(name: str) -> Callable[[RowParams], list[tuple[Column | None, Params]]]:
    """Each row's tier decides which phrases a rule knows, so the rule is planned once for each tier."""

    def variants(params: RowParams) -> list[tuple[Column | None, Params]]:
        level = params.integer(name, 50)
        return [(level <= 30, Params({name: 30})), ((level > 30) & (level <= 70), Params({name: 70})), (level > 70, Params({name: 100}))]

    return variants


@dataclass
class Stage:
    """A frame under construction. Its own columns have names that no column of the frame begins with."""

    df: DataFrame
    count: int = 0
    prefix: str = "_s"
    #: A text and its pieces, as last put.
    known: tuple[Column, Column] | None = None

    def __post_init__(self) -> None:
        while any(c.lower().startswith(self.prefix) for c in self.df.columns):
            self.prefix = f"_{self.prefix}"

    def put(self, value: Column) -> Column:
        name = f"{self.prefix}{self.count}"
        self.count += 1
        self.df = self.df.withColumn(name, value)
        return F.col(name)

    def held(self, value: Column) -> Column:
        """Like put, for a value that a function of array elements reads: the optimizer would move a column that is named
        once into the function and evaluate it again for every element, so this one is named twice."""
        column = self.put(value)
        return F.when(column.isNotNull(), column)

    def pieces(self, text: Column) -> Column:
        """The text's pieces; where the last text whose pieces are known is the same, they serve again."""
        found = protect.segments(text)
        return found if self.known is None else F.when(text == self.known[0], self.known[1]).otherwise(found)

    def segments(self, text: Column) -> Column:
        """The text's pieces, put and known to the rules that follow."""
        self.known = text, self.put(self.pieces(text))
        return self.known[1]


#: New text and record of changes; of a rule that may fail also what went wrong, null where nothing did.
Result = tuple[Column, Column] | tuple[Column, Column, Column]


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    level: str
    description: str
    apply: Callable[[Stage, Column, Params], Result]
    #: How to plan the rule where each row has its own parameters: which rows (None: all) take which parameters.
    variants: Callable[[RowParams], list[tuple[Column | None, Params]]] = lambda params: [(None, params)]


def _log(*entries: Column, otherwise: str) -> Column:
    """The entries that aren't null, or one line."""
    found = F.filter(F.array(*(e.cast("string") for e in entries)), lambda x: x.isNotNull()) if entries else F.array().cast(STRINGS)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(otherwise)))


def _with_tier(table: dict, tier: str) -> list:
    upto = list(table)[: list(table).index(tier) + 1]
    return [x for t in upto for x in table[t]]


def filler_removal(stage: Stage, text: Column, params: Params) -> Result:
    """Greetings and polite openers at the start, fillers within, closing remarks.

    Openers are taken off until none is left; as taking one off never hides another, one possessive pattern finds the
    whole run. The log names the run's parts in the order of the text.
    """
    tier = v.tier(params.integer("aggressiveness", 50))
    openers = "|".join(_with_tier(v.OPENERS, tier))
    start = rf"(?i)^\s*(?:{openers})(?:{W}*+(?:{openers}))*+{W}*+"
    opening = F.regexp_extract(text, start, 0)
    logs = [F.transform(extract_all(opening, rf"(?i){W}*+({openers})", 1), lambda x: F.concat(F.lit(f"[{tier}] opener removed: "), jstrip(x)))]
    now = stage.put(F.regexp_replace(text, start, ""))
    if tier == "HIGH":
        for word in v.FILLERS:
            alone = rf"(?i)(?<=\s){word}(?=\s)"
            found = now.rlike(alone)
            logs.append(F.when(found, F.array(F.lit(f"[{tier}] filler removed: {word}"))))
            now = stage.put(F.when(found, jstrip(F.regexp_replace(F.regexp_replace(now, alone, ""), " {2,}", " "))).otherwise(now))
    closings = _with_tier(v.CLOSINGS, tier)
    has = stage.put(has_any(F.lower(now), v.CLOSING_WORDS))
    chain, low = now, stage.put(F.when(has, F.lower(now)))
    for phrase in closings:
        chain = jstrip(F.regexp_replace(chain, f"(?i){BEGIN}{phrase}", ""))
        hit = F.regexp_extract(now, f"(?i){BEGIN}{phrase}", 0)
        begins = F.contains(low, F.lit(re.match("[A-Za-z ]+", phrase)[0].lower()))  # a plain search goes before the pattern
        logs.append(F.when(has & begins & (hit != ""), F.array(F.concat(F.lit(f"[{tier}] closing removed: "), jstrip(hit)))))
    now = stage.put(F.when(has, chain).otherwise(now))
    now = stage.put(jstrip(no_runs(now)))
    first = F.upper(F.substring(now, 1, 1))
    out = F.when(F.length(first) == 1, F.concat(first, F.substring(now, F.lit(2), F.length(now)))).otherwise(now)
    found = stage.put(F.flatten(F.filter(F.array(*(x.cast(STRINGS) for x in logs)), lambda x: x.isNotNull())))
    return out, F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(f"[{tier}] no filler found")))


def _ascii_sentence_case(c: Column) -> Column:
    """ASCII letters in lower case, but the first of each sentence."""
    lower = F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    start = r"^([^a-z]*+)([a-z]?)([\s\S]*+)$"
    chunk = lambda x: F.concat(F.regexp_extract(x, start, 1), F.upper(F.regexp_extract(x, start, 2)), F.regexp_extract(x, start, 3))
    return F.array_join(F.transform(extract_all(lower, r"[^.?!]*+[.?!]|[^.?!]++"), chunk), "")


#: Characters for private use, no letters: one between pieces; in texts that have it, two that say so.
_MARK, _BEHIND, _ESCAPED, _MARKED = "\ue000", "\ue001", "\ue002", "\ue003"


def _escaped(t: Column) -> Column:
    return F.replace(F.replace(t, F.lit(_BEHIND), F.lit(_BEHIND + _ESCAPED)), F.lit(_MARK), F.lit(_BEHIND + _MARKED))


def _unescaped(t: Column) -> Column:
    return F.replace(F.replace(t, F.lit(_BEHIND + _MARKED), F.lit(_MARK)), F.lit(_BEHIND + _ESCAPED), F.lit(_BEHIND))


def case_normalizer(stage: Stage, text: Column, params: Params) -> Result:
    """Texts (outside protected pieces) that are nearly all upper case become sentence case.

    Letters keep their places, so the plain pieces are changed as one text, whose sentences go on over protected
    pieces, and cut again where they were.
    """
    threshold, least = _lit(params.number("uppercaseRatioThreshold", 0.9)), _lit(params.integer("minLetters", 8))
    segs = stage.segments(text)
    whole = stage.put(F.array_join(protect.plain(segs), ""))
    upper = F.length(F.regexp_replace(whole, "[^A-Z]++", ""))
    letters = stage.put(F.length(F.regexp_replace(whole, "[^A-Za-z]++", "")))
    shouts = stage.put(F.coalesce((letters >= least) & (F.try_divide(upper, letters) >= threshold), F.lit(False)))
    # Protected pieces stand as nothing between marks that no piece has, so that the cased text falls apart at the marks.
    apart = F.array_join(F.transform(segs, lambda s: F.when(s["p"], "").otherwise(_escaped(s["t"]))), _MARK)
    cased = F.transform(F.split(_ascii_sentence_case(apart), _MARK, -1), _unescaped)
    out = F.when(shouts, F.array_join(F.zip_with(segs, cased, lambda s, x: F.when(s["p"], s["t"]).otherwise(x)), "")).otherwise(text)
    log = F.when(text == "", F.array(F.lit("empty input"))).when(shouts, F.array(F.lit("upper-case input put into sentence case"), F.concat(F.lit("uppercaseRatioThreshold="), threshold.cast("string"), F.lit(", minLetters="), least.cast("string"))))
    return out, F.coalesce(log, F.array(F.lit("input is not in upper case")))


def task_columns(text: Column, lower: Column) -> tuple[Column, Column, Column]:
    """Type of task, the part of the text that shows it (null: none), and complexity by number of words."""
    shows = [(kind, word, F.contains(lower, F.lit(word))) for kind, ws in v.TASKS.items() for word in ws]
    kind = F.coalesce(*(F.when(found, F.lit(k)) for k, _, found in shows), F.lit(v.GENERAL))
    word = F.coalesce(*(F.when(found, F.lit(w)) for _, w, found in shows))
    n = word_count(text)
    return kind, word, F.when(n < 15, "LOW").when(n <= 40, "MEDIUM").otherwise("HIGH")


def task_analyzer(stage: Stage, text: Column, params: Params) -> Result:
    """The text stays; the log tells its task and complexity."""
    kind, word, complexity = task_columns(text, stage.put(F.lower(text)))
    shown = F.coalesce(F.concat(F.lit(" by '"), word, F.lit("'")), F.lit(" by default"))
    return text, F.array(F.concat(F.lit("task type: "), kind, shown), F.concat(F.lit("complexity: "), complexity, F.lit(", words: "), word_count(text).cast("string")), F.lit("classification only"))


def _replaced(stage: Stage, text: Column, pairs: list[tuple[str, str]], none: str) -> Result:
    """Each pair's first part (in lower case), in any case of letters, replaced by its second, one pair after the other, outside protected pieces."""
    segs = stage.put(F.when(has_any(F.lower(text), [a for a, _ in pairs]), stage.pieces(text)))
    table = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs))

    def state(t: Column, log: Column) -> Column:  # the lower case is made once for each text, not for each phrase
        return F.struct(t.alias("t"), F.lower(t).alias("low"), log.alias("log"))

    def step(acc: Column, pair: Column) -> Column:  # each phrase is looked for in what the ones before it left
        pattern = F.concat(F.lit(r"(?i)\Q"), pair["a"], F.lit(r"\E"))
        entry = F.concat(F.lit("'"), pair["a"], F.lit("' -> '"), pair["b"], F.lit("'"))
        hit = F.contains(acc["low"], pair["a"]) & F.rlike(acc["t"], pattern)
        changed = F.transform(F.array(F.regexp_replace(acc["t"], pattern, pair["b"])), lambda t: state(t, F.array_append(acc["log"], entry)))
        return F.when(hit, F.get(changed, F.lit(0))).otherwise(acc)

    def of_piece(s: Column) -> Column:
        none = F.array().cast(STRINGS)
        kept = F.struct(s["t"].alias("t"), F.lit("").alias("low"), none.alias("log"))
        return F.when(s["p"], kept).otherwise(F.aggregate(table, state(s["t"], none), step))

    done = stage.put(F.transform(segs, of_piece))
    out = F.coalesce(protect.joined(segs, F.transform(done, lambda d: d["t"])), text)
    found = F.flatten(F.transform(done, lambda d: d["log"]))
    return out, F.when(F.coalesce(F.size(found), F.lit(0)) > 0, found).otherwise(F.array(F.lit(none)))


def semantic_compressor(stage: Stage, text: Column, params: Params) -> Result:
    """Long phrases to short ones."""
    return _replaced(stage, text, _with_tier(v.COMPRESSIONS, v.tier(params.integer("compressionLevel", 50))), "no long phrase found")


def format_control(stage: Stage, text: Column, params: Params) -> Result:
    """Format phrases to marks."""
    return _replaced(stage, text, v.FORMATS, "no format phrase found")


def structure_minimizer(stage: Stage, text: Column, params: Params) -> Result:
    """White space at line ends, blank lines beyond one, runs of spaces; line ends become LF and a piece's last one goes."""
    segs = stage.segments(text)
    ends = rf"[{W}&&[^\r\n]]++(?=[\r\n]|\z)"
    # Plain searches and looks at ends go before the patterns: many pieces have one line without runs of white space.
    has = lambda t, *said: reduce(or_, (F.contains(t, F.lit(x)) for x in said))
    trailing = lambda t: F.when(has(t, "\n", "\r") | (t != F.rtrim(t, F.lit(WHITE))), F.regexp_replace(t, ends, "")).otherwise(t)
    feeds = lambda t: F.when(has(t, "\r"), F.regexp_replace(t, r"\r\n?", "\n")).otherwise(t)
    last = lambda t: F.when(F.endswith(t, F.lit("\n")), F.regexp_replace(t, r"\n\z", "")).otherwise(t)
    lines = lambda t: once(trailing(t), lambda x: once(feeds(x), last))
    blanks = lambda t: F.when(has(t, "\n\n\n"), F.regexp_replace(t, r"\n{3,}", "\n\n")).otherwise(t)  # noqa: E731  no CR is left
    spaces = no_runs
    one = stage.put(protect.transformed(segs, lines))
    two = stage.put(F.transform(one, lambda t, i: F.when(F.get(segs, i)["p"], t).otherwise(blanks(t))))
    three = stage.put(F.transform(two, lambda t, i: F.when(F.get(segs, i)["p"], t).otherwise(spaces(t))))
    whole = stage.put(protect.joined(segs, three))
    out = jstrip(whole)
    flag = lambda test, said: F.when(test, F.lit(said))
    log = _log(
        flag(one != F.transform(segs, lambda s: s["t"]), "white space at line ends removed"),
        flag(two != one, "blank lines collapsed"),
        flag(three != two, "spaces collapsed"),
        flag(out != whole, "outer white space removed"),
        otherwise="structure is clean",
    )
    return out, log


def duplicate_sentences(stage: Stage, text: Column, params: Params) -> Result:
    """Within each plain piece, sentences that are the same but for case, white space and end marks stay once.

    Positions of equal keys come from one sort, so a piece of n sentences takes n log n steps.
    """
    fold_case, first = _lit(params.truth("caseInsensitive", True)), _lit(params.truth("keepFirst", True))
    segs = stage.segments(text)

    def key(s: Column) -> Column:
        k = jtrim(F.regexp_replace(collapse(jtrim(s)), r"[.!?]+\z", ""))
        return F.when(fold_case, F.lower(k)).otherwise(k)

    found = stage.put(F.transform(segs, lambda s: F.when(s["p"], F.array().cast(STRINGS)).otherwise(F.filter(F.transform(extract_all(s["t"], SENTENCE), jtrim), lambda x: x != ""))))
    keyed = stage.put(F.transform(found, lambda ss: F.array_sort(F.transform(ss, lambda s, i: F.struct(key(s).alias("k"), F.when(first, i).otherwise(-i).alias("i"))))))
    kept = stage.put(F.transform(keyed, lambda ks: F.array_sort(F.transform(F.filter(ks, lambda x, i: (i == 0) | (F.get(ks, i - 1)["k"] != x["k"])), lambda x: F.abs(x["i"])))))
    lost = F.transform(found, lambda ss, i: F.size(ss) - F.size(F.get(kept, i)))
    lost = stage.put(lost)

    def rebuilt(s: Column, i: Column) -> Column:
        ss = F.get(found, i)
        return F.when(F.get(lost, i) == 0, s["t"]).otherwise(edges(s["t"], F.array_join(F.transform(F.get(kept, i), lambda k: F.get(ss, k)), " ")))

    outs = stage.put(F.transform(segs, rebuilt))
    total = F.aggregate(lost, F.lit(0), lambda a, b: a + b)
    again = lambda ks: F.array_sort(F.transform(F.filter(ks, lambda x, i: (i > 0) & (F.get(ks, i - 1)["k"] == x["k"])), lambda x: F.abs(x["i"])))
    dropped = F.flatten(F.transform(found, lambda ss, i: F.transform(again(F.get(keyed, i)), lambda k: F.get(ss, k))))
    told = F.concat(F.transform(dropped, lambda s: F.concat(F.lit("duplicate sentence removed: "), s)), F.array(F.concat(F.lit("sentences removed: "), total.cast("string"))))
    return protect.joined(segs, outs), F.when(total > 0, told).otherwise(F.array(F.lit("no duplicate sentence")))


def _deduplicated(stage: Stage, text: Column, kinds: dict[str, str], words: list[str], what: str) -> Result:
    """The first sentence of each kind stays, later ones go; a sentence is of the first kind whose pattern it shows.

    Sentences are numbered over all plain pieces. Texts that hold none of the words aren't taken apart, and only sentences
    that hold one are held against the patterns, which cost far more than words.
    """
    holds = stage.put(has_any(F.lower(text), words))
    segs = stage.put(F.when(holds, stage.pieces(text)))

    def kind(s: Column) -> Column:
        return F.when(says_any(s, words), F.coalesce(*(F.when(s.rlike(p), F.lit(k)) for k, p in kinds.items())))

    said = lambda x, i, k: F.struct(kind(x).alias("kind"), i.alias("piece"), k.alias("place"), x.alias("s"))
    found = stage.put(F.transform(segs, lambda s, i: F.when(~s["p"], F.transform(sentences(s["t"]), lambda x, k: said(x, i, k)))))
    flat = stage.put(F.flatten(F.filter(found, lambda ss: ss.isNotNull())))
    at = lambda x: F.struct(x["piece"], x["place"])
    first = lambda k: F.array_min(F.transform(F.filter(flat, lambda x: x["kind"] == k), at))
    firsts = stage.held(F.when(flat.isNotNull(), F.create_map(*(c for k in kinds for c in (F.lit(k), first(k))))))
    stays = lambda x: x["kind"].isNull() | (F.element_at(firsts, F.coalesce(x["kind"], F.lit(next(iter(kinds))))) == at(x))
    kept = stage.put(F.transform(found, lambda ss: F.filter(ss, stays)))

    def rebuilt(s: Column, pair: Column) -> Column:
        same = s["p"] | (F.size(pair["kept"]) == F.size(pair["found"]))
        return F.when(same, s["t"]).otherwise(edges(s["t"], F.array_join(F.transform(pair["kept"], lambda x: x["s"]), " ")))

    outs = stage.put(F.zip_with(segs, F.arrays_zip(found.alias("found"), kept.alias("kept")), rebuilt))
    out = F.coalesce(protect.joined(segs, outs), text)
    of_kind = F.filter(flat, lambda x: x["kind"].isNotNull())
    told = F.transform(of_kind, lambda x: F.concat(F.when(stays(x), F.lit("kept ")).otherwise(F.lit("removed ")), x["kind"], F.lit(": "), x["s"]))
    gone = F.size(flat) - F.size(F.flatten(F.filter(kept, lambda ss: ss.isNotNull())))
    end = F.when(gone > 0, F.concat(F.lit(f"{what} removed: "), gone.cast("string"))).otherwise(F.lit(f"no repeated {what}"))
    return out, F.coalesce(F.concat(told, F.array(end)), F.array(F.lit(f"no repeated {what}")))


def output_formats(stage: Stage, text: Column, params: Params) -> Result:
    """Repeated demands for the same output format go."""
    return _deduplicated(stage, text, v.OUTPUT_FORMATS, v.FORMAT_WORDS, "output format")


def constraints(stage: Stage, text: Column, params: Params) -> Result:
    """Repeated constraints on the answer go."""
    return _deduplicated(stage, text, v.CONSTRAINTS, v.CONSTRAINT_WORDS, "constraint")


def conflict_columns(stage: Stage, text: Column) -> tuple[Column, Column]:
    """(map from kind of instruction to the first plain sentence that shows it, conflicting pairs as 'A x B').

    Only sentences that hold one of the words are held against the patterns, which cost far more than words.
    """
    holds = stage.put(has_any(F.lower(text), v.INSTRUCTION_WORDS))
    said = lambda t: F.filter(sentences(t), lambda s: says_any(s, v.INSTRUCTION_WORDS))
    found = stage.put(F.when(holds, F.flatten(F.transform(protect.plain(stage.pieces(text)), said))))
    showing = lambda p: F.filter(found, lambda s: s.rlike(p))
    firsts = {k: stage.put(F.get(showing(p), F.lit(0))) for k, p in v.INSTRUCTIONS.items()}
    hits = F.map_filter(F.create_map(*(x for k, c in firsts.items() for x in (F.lit(k), c))), lambda _, s: s.isNotNull())
    pairs = F.filter(F.array(*(F.when(firsts[a].isNotNull() & firsts[b].isNotNull(), F.lit(f"{a} x {b}")) for a, b in v.CONFLICTS)), lambda x: x.isNotNull())
    return hits, pairs


def instruction_conflicts(stage: Stage, text: Column, params: Params) -> Result:
    """The text stays; the log has three lines for each pair of conflicting instructions."""
    hits, pairs = conflict_columns(stage, text)
    hits, pairs = stage.put(hits), stage.put(pairs)

    def lines(pair: Column) -> Column:
        ends = F.split(pair, " x ")
        shown = lambda k: F.concat(k, F.lit(' stands in: "'), F.element_at(hits, k), F.lit('"'))
        return F.array(shown(F.get(ends, F.lit(0))), shown(F.get(ends, F.lit(1))), F.concat(F.lit("possible conflict: "), pair))

    return text, F.when(F.size(pairs) > 0, F.flatten(F.transform(pairs, lines))).otherwise(F.array(F.lit("no conflict found")))


def punctuation(stage: Stage, text: Column, params: Params) -> Result:
    """Runs of ! and ? become one, four or more dots three."""
    runs = (("!!", r"!{2,}", "!"), ("??", r"\?{2,}", "?"), ("....", r"\.{4,}", "..."))
    segs = stage.put(F.when(has_any(text, [said for said, _, _ in runs]), stage.pieces(text)))

    def short(t: Column) -> Column:  # none of the three makes a run for another
        done = t
        for said, pattern, to in runs:
            done = F.when(F.contains(t, F.lit(said)), F.regexp_replace(done, pattern, to)).otherwise(done)
        return done

    outs = stage.put(protect.transformed(segs, short))
    flag = lambda p, said: F.when(F.exists(protect.plain(segs), lambda t: t.rlike(p)), F.lit(said))
    log = _log(flag("!!", "repeated exclamation marks: '!!' -> '!'"), flag(r"\?\?", "repeated question marks: '??' -> '?'"), flag(r"\.{4}", "ellipsis: '....' -> '...'"), otherwise="punctuation is normal")
    return F.coalesce(protect.joined(segs, outs), text), log


_NUMBER_WORDS = "|".join(sorted([*v.ONES, *v.TENS, *v.SCALES], key=lambda w: -len(w)))
#: Most words begin with a letter that no number word does; a look at it goes before the words.
_NUMBER_BEGIN = f"(?=[{''.join(sorted({w[0] for w in _NUMBER_WORDS.split('|')}))}]){BEGIN}"
_NUMBER = rf"{_NUMBER_BEGIN}(?:{_NUMBER_WORDS})(?:(?:\s+(?:and\s+)?|,\s*)(?:{_NUMBER_WORDS}))*{END}"
_PERCENT = rf"{_NUMBER}\s+percent(?:age)?{END}"


def number_value(phrase: Column) -> Column:
    """The number that a phrase of number words says; null where it exceeds a long (the words then stay)."""
    values = F.create_map(*(F.lit(x) for w, n in [*v.ONES.items(), *v.TENS.items()] for x in (w, n)))
    words = F.split(jtrim(collapse(F.regexp_replace(F.regexp_replace(F.lower(phrase), rf"{BEGIN}and{END}", " "), ",+", " "))), " ")
    zero = F.struct(F.lit(0).cast("long").alias("result"), F.lit(0).cast("long").alias("current"))
    pair = lambda r, c: F.struct(r.alias("result"), c.alias("current"))

    def step(acc: Column, word: Column) -> Column:
        some = F.when(acc["current"] == 0, F.lit(1).cast("long")).otherwise(acc["current"])
        scaled = lambda n: pair(F.try_add(acc["result"], F.try_multiply(some, F.lit(n).cast("long"))), F.lit(0).cast("long"))
        return (
            F.when(word == "hundred", pair(acc["result"], F.try_multiply(some, F.lit(100).cast("long"))))
            .when(word == "thousand", scaled(v.SCALES["thousand"]))
            .when(word == "million", scaled(v.SCALES["million"]))
            .otherwise(pair(acc["result"], F.try_add(acc["current"], F.element_at(values, word).cast("long"))))
        )

    return F.aggregate(words, zero, step, lambda acc: F.try_add(acc["result"], acc["current"]))


def _numbered(t: Column, found: Column, pattern: str, percent: bool) -> Column:
    """t with each match's number in its place: gaps and values in turn. found: what the pattern matches."""
    pattern = f"(?i){pattern}"
    value = lambda hit: F.coalesce(F.concat(number_value(jtrim(F.regexp_replace(hit, r"(?i)\s+percent(?:age)?\z", "")) if percent else hit).cast("string"), F.lit("%" if percent else "")), hit)
    hits = F.transform(found, value)
    return F.when(F.size(found) > 0, F.array_join(F.flatten(F.zip_with(F.split(t, pattern, -1), F.array_append(hits, F.lit("")), lambda gap, hit: F.array(gap, hit))), "")).otherwise(t)


def numbers(stage: Stage, text: Column, params: Params) -> Result:
    """Number words to digits, "N percent" to N%."""
    segs = stage.put(F.when(has_any(F.lower(text), [*v.ONES, *v.TENS, *v.SCALES]), stage.pieces(text)))
    percents = lambda t: F.contains(F.lower(t), F.lit("percent"))  # noqa: E731  a plain search goes before the pattern
    one = stage.put(protect.transformed(segs, lambda t: F.when(percents(t), once(extract_all(t, f"(?i){_PERCENT}"), lambda found: _numbered(t, found, _PERCENT, True))).otherwise(t)))
    said = stage.put(F.transform(one, lambda t, i: F.when(F.get(segs, i)["p"], F.array().cast(STRINGS)).otherwise(extract_all(t, f"(?i){_NUMBER}"))))
    two = stage.put(F.transform(one, lambda t, i: _numbered(t, F.get(said, i), _NUMBER, False)))
    told = stage.put(F.flatten(
        F.array(
            F.flatten(F.transform(F.filter(protect.plain(segs), percents), lambda t: F.transform(extract_all(t, f"(?i){_PERCENT}"), lambda h: F.concat(F.lit("percentage: "), h)))),
            F.transform(F.flatten(said), lambda h: F.concat(F.lit("number: "), h)),
        )
    ))
    return F.coalesce(protect.joined(segs, two), text), F.when(F.coalesce(F.size(told), F.lit(0)) > 0, told).otherwise(F.array(F.lit("no number words")))


def _positive(value: object, default: int) -> Column:
    return F.when(_lit(value) > 0, _lit(value)).otherwise(F.lit(default))


def sentence_budget(stage: Stage, text: Column, params: Params) -> Result:
    """At most maxSentences sentences."""
    most = _positive(params.integer("maxSentences", 3), 3)
    found = stage.put(sentences(text))
    n = F.size(found)
    head = F.array_join(F.slice(found, F.lit(1), most), " ")
    cut = F.concat(head, F.when(head.rlike(r"[.?!]\z"), " ...").otherwise("..."))
    log = F.when(jtrim(text) == "", "empty input").when(n <= most, F.concat(F.lit("sentences within budget: "), n.cast("string"))).otherwise(F.concat(F.lit("first "), most.cast("string"), F.lit(" sentences kept of "), n.cast("string")))
    return F.when(n > most, cut).otherwise(text), F.array(log)


def length_control(stage: Stage, text: Column, params: Params) -> Result:
    """At most maxWords words."""
    most = _positive(params.integer("maxWords", 50), 50)
    n = stage.put(word_count(text))
    head = F.concat(F.array_join(F.slice(F.split(jtrim(text), r"\s+"), F.lit(1), most), " "), F.lit("..."))
    log = F.when(n > most, F.concat(F.lit("cut to "), most.cast("string"), F.lit(" words of "), n.cast("string"))).otherwise(F.concat(F.lit("words within budget: "), n.cast("string")))
    return F.when(n > most, head).otherwise(text), F.array(log)


def duplicate_phrases(stage: Stage, text: Column, params: Params) -> Result:
    """Words and phrases of up to three words that are said twice running are said once.

    How far to go on depends on what was found, so this one runs in Arrow batches; only texts with plain pieces go.
    """
    from .phrases import reduce_pieces

    most = F.greatest(F.lit(1), F.least(F.lit(3), _lit(params.integer("maxPhraseLength", 3))))
    segs = stage.segments(text)
    done = stage.put(reduce_pieces(F.transform(segs, lambda s: F.when(~s["p"], s["t"])), most, _lit(params.truth("caseInsensitive", True))))
    outs = stage.put(F.transform(segs, lambda s, i: F.coalesce(F.get(done["texts"], i), s["t"])))
    gone = F.size(done["phrases"])
    told = F.concat(F.transform(done["phrases"], lambda p: F.concat(F.lit("repeated phrase removed: "), p)), F.array(F.concat(F.lit("phrases removed: "), gone.cast("string"))))
    return protect.joined(segs, outs), F.when(gone > 0, told).otherwise(F.array(F.lit("no repeated phrase")))


#: In the order in which they run: sentences are limited before words.
RULES: tuple[Rule, ...] = (
    Rule("fillerRemoval", "Filler Removal", "Level 1", "Removes greetings, polite openers, mid-text fillers, and closing remarks", filler_removal, _by_tier("aggressiveness")),
    Rule("caseNormalizer", "Case Normalizer", "Level 1", "Normalizes clearly all-uppercase prompts into sentence case", case_normalizer),
    Rule("taskAnalyzer", "Task Analyzer", "Level 1", "Classifies task type and complexity without modifying the prompt", task_analyzer),
    Rule("semanticCompressor", "Semantic Compressor", "Level 1", "Replaces verbose phrases with concise equivalents", semantic_compressor, _by_tier("compressionLevel")),
    Rule("structureMinimizer", "Structure Minimizer", "Level 1", "Removes redundant whitespace and normalises text structure", structure_minimizer),
    Rule("duplicateSentenceRemover", "Duplicate Sentence Remover", "Level 1", "Removes fully duplicated sentences from the prompt", duplicate_sentences),
    Rule("duplicatePhraseReducer", "Duplicate Phrase Reducer", "Level 1", "Removes consecutive duplicated words or short phrases", duplicate_phrases),
    Rule("punctuationNormalizer", "Punctuation Normalizer", "Level 1", "Removes repeated punctuation and normalises ellipses", punctuation),
    Rule("numberNormalizer", "Number Normalizer", "Level 1", "Converts written numbers and percentages to numeric form", numbers),
    Rule("outputFormatDeduplicator", "Output Format Deduplicator", "Level 2", "Removes repeated output-format instructions while keeping the first one", output_formats),
    Rule("constraintDeduplicator", "Constraint Deduplicator", "Level 2", "Removes repeated output constraints while keeping the first one", constraints),
    Rule("instructionConflictDetector", "Instruction Conflict Detector", "Level 2", "Detects potentially conflicting output instructions without modifying the prompt", instruction_conflicts),
    Rule("sentenceBudget", "Sentence Budget", "Level 2", "Limits prompt length by maximum sentence count", sentence_budget),
    Rule("lengthControl", "Length Control", "Level 2", "Final hard guard that truncates text exceeding the max-words budget", length_control),
    Rule("formatControl", "Format Control", "Level 2", "Converts verbose formatting instructions to compact symbols", format_control),
)
BY_ID = {r.id: r for r in RULES}
