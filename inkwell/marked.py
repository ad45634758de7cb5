"""Queries that feed each rule whole texts inside code and quotes, and their DuckDB counterparts.

Every text stands, whole, between marks whose partners SQL knows: a fence, curly quotes, or single quotes, by id. A rule
must leave all of it alone, phrases of its own in there included, and work on what stands before and behind. With an
opening mark that is never closed the text is plain, straight quotes in it too, and only code stays protected.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import protect, score, text
from .operators import vocabulary as v
from .operators.rules import BY_ID, Params, Stage, conflict_columns
from .plans.pipeline import optimize
from .queries import FLAGSHIP, _FLAG, _folded, _semantic, _sql, _table, _with, prompts

Query = Callable[[SparkSession, str], DataFrame]

#: Opening and closing marks around the texts.
MARKS = (("```\n", "\n```"), ("“", "”"), ("‘", "’"), ("'", "'"), ("``“", "”"))
#: Rule, parameters, then what stands before, inside and behind, and what becomes of the first and the last.
GUARDED: dict[str, tuple[str, dict, str, str, str, str, str]] = {
    "case": ("caseNormalizer", {}, "PLEASE READ THIS NOW: ", "LOUD WORDS", " AND THEN STOP. THE END", "Please read this now: ", " and then stop. The end"),
    "semantic": ("semanticCompressor", {"compressionLevel": 85}, "in order to see ", "In order to stay", " IN ORDER TO go", "to see ", " to go"),
    "structure": ("structureMinimizer", {}, "a   b  \n", "two   spaces  \n\n\n\nand lines", "   c \n\n\n\nd", "a b  \n", " c\n\nd"),
    "duplicate_sentences": ("duplicateSentenceRemover", {}, "Go up. Go  up! Then. ", "Go up. Go up.", " Stop. stop. ", "Go up. Then. ", " Stop. "),
    "duplicate_phrases": ("duplicatePhraseReducer", {}, "the the cat ", "on on", " go on go on now", "the cat ", " go on now"),
    "punctuation": ("punctuationNormalizer", {}, "Stop!!! ", "what??!!....", " why??.....", "Stop! ", " why?..."),
    "numbers": ("numberNormalizer", {}, "twenty percent of ", "forty two", " nine hundred and seventy one", "20% of ", " 971"),
    "output_formats": ("outputFormatDeduplicator", {}, "Use bullet points. ", "Use a table. Use bullet points.", " Answer as a list. Use a table.", "Use bullet points. ", " Use a table."),
    "constraints": ("constraintDeduplicator", {}, "Be concise. ", "Be concise. Give examples.", " Keep it short. Give examples.", "Be concise. ", " Give examples."),
    "format_control": ("formatControl", {}, "bullet points: ", "bold text:", " italic text: so", "• ", " * so"),
}
#: Backslashes before a closing mark: an odd number escapes it, however large.
BACKSLASHES = (0, 1, 2, 3, 64, 129, 130, 131, 500)
_FENCE = "```py\nx = 1\n```"


def _pick(values: tuple, of: str = "doc_id") -> Column:
    return F.get(F.array(*map(F.lit, values)), (F.col(of) % len(values)).cast("int"))


def _sql_pick(values: tuple) -> str:
    return f"list_extract([{', '.join(_sql(x) if isinstance(x, str) else str(x) for x in values)}], CAST(doc_id % {len(values)} AS INTEGER) + 1)"


def _guarded(before: str, inside: str, behind: str) -> Column:
    """The whole text and a phrase between marks, which the closing one ends."""
    opening, closing = (tuple(m[k] for m in MARKS) for k in (0, 1))
    return F.concat(F.lit(before), _pick(opening), F.lit("as "), F.coalesce("text", F.lit("")), F.lit(f" {inside} end"), _pick(closing), F.lit(behind))


def _guarded_sql(before: str, inside: str, behind: str) -> str:
    opening, closing = (_sql_pick(tuple(m[k] for m in MARKS)) for k in (0, 1))
    return f"{_sql(before)} || {opening} || 'as ' || coalesce(text, '') || {_sql(f' {inside} end')} || {closing} || {_sql(behind)}"


def _guard(name: str) -> Query:
    rule, params, before, inside, behind, _, _ = GUARDED[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        stage = Stage(_table(spark, sf_dir, "documents").select("doc_id", _guarded(before, inside, behind).alias("t")))
        out, _ = BY_ID[rule].apply(stage, F.col("t"), Params(params))
        return stage.df.select("doc_id", out.alias("out"))

    return query


def guarded_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instructions within marks conflict with nothing; every second text has a conflicting one behind them."""
    behind = F.when(F.col("doc_id") % 2 == 0, " Explain in detail.").otherwise(" Go on.")
    stage = Stage(_table(spark, sf_dir, "documents").select("doc_id", F.concat(_guarded("Be concise. ", "Explain in detail.", ""), behind).alias("t")))
    hits, pairs = conflict_columns(stage, F.col("t"))
    hits, pairs = stage.put(hits), stage.put(pairs)
    return stage.df.select("doc_id", F.size(F.map_keys(hits)).cast("long").alias("kinds"), F.size(pairs).cast("long").alias("conflicts"))


#: What stands before, in straight quotes, in code and behind where an opening mark stays open.
UNCLOSED = {
    "punctuation": ("punctuationNormalizer", {}, "Stop!! "),
    "semantic": ("semanticCompressor", {"compressionLevel": 85}, "in order to see "),
    "format_control": ("formatControl", {}, "bullet points: x "),
}


def _unclosed(name: str) -> Query:
    rule, params, phrase = UNCLOSED[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        whole = F.concat(F.lit(f"{phrase}“"), F.coalesce("text", F.lit("")), F.lit(f' "{phrase}" `{phrase}` {phrase}end'))
        stage = Stage(_table(spark, sf_dir, "documents").select("doc_id", whole.alias("t")))
        out, _ = BY_ID[rule].apply(stage, F.col("t"), Params(params))
        return stage.df.select("doc_id", out.alias("out"))

    return query


def _unclosed_sql(name: str) -> str:
    phrase = UNCLOSED[name][2]
    if name == "punctuation":
        change = lambda x: rf"regexp_replace(regexp_replace(regexp_replace({x}, '!{{2,}}', '!', 'g'), '\?{{2,}}', '?', 'g'), '\.{{4,}}', '...', 'g')"
    else:
        pairs = _semantic("HIGH") if name == "semantic" else v.FORMATS
        change = lambda x: _folded(x, pairs)
    plain = f"{_sql(f'{phrase}“')} || coalesce(text, '') || {_sql(f' {chr(34)}{phrase}{chr(34)} ')}"
    return f"SELECT doc_id, {change('a')} || {_sql(f'`{phrase}`')} || {change('b')} AS out FROM (SELECT doc_id, {plain} AS a, {_sql(f' {phrase}end')} AS b FROM documents)"


def marked_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters under protection, and pieces, of code, a quote around the whole text, and a mark without a partner."""
    t = F.concat(F.lit(f"Run `a.b` and `` then:\n{_FENCE} “"), F.coalesce("text", F.lit("")), F.lit(" end”, `end"))
    segs = _table(spark, sf_dir, "documents").select("doc_id", protect.segments(t).alias("s"), t.alias("t"))
    return segs.select("doc_id", _protected("s").alias("protected_chars"), F.size("s").cast("long").alias("pieces"), F.array_join(F.transform("s", lambda x: x["t"]), "").alias("t"))


def _protected(segs: str) -> Column:
    return F.aggregate(segs, F.lit(0), lambda n, x: n + F.when(x["p"], F.length(x["t"])).otherwise(0)).cast("long")


def escaped_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters under protection where backslashes stand before a closing mark, and another one comes later; the apostrophe opens nothing."""
    t = F.concat(F.lit("It's “"), F.coalesce("text", F.lit("")), F.lit(" end"), F.repeat(F.lit("\\"), _pick(BACKSLASHES)), F.lit("” b” c"))
    return _table(spark, sf_dir, "documents").select("doc_id", protect.segments(t).alias("s")).select("doc_id", _protected("s").alias("protected_chars"))


def text_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and UTF-16 units of each text and of it with characters that take two."""
    grown = F.concat(F.coalesce("text", F.lit("")), F.repeat(F.lit("😀é"), (F.col("doc_id") % 4).cast("int")))
    return _table(spark, sf_dir, "documents").select("doc_id", text.word_count(grown).cast("long").alias("words"), text.utf16_length(grown).cast("long").alias("units"))


def savings_map(spark: SparkSession, sf_dir: str, quotes: bool = False) -> DataFrame:
    """The savings by rule of each document: three rules that run, and the names of all."""
    by_rule = F.col("token_stats.by_rule")
    done = optimize(prompts(spark, sf_dir, quotes), FLAGSHIP, "t", record=False)
    of = lambda name, alias: F.element_at(by_rule, name).cast("long").alias(alias)
    rest = F.aggregate(F.map_values(by_rule), F.lit(0), lambda n, x: n + x).cast("long")
    return done.select("doc_id", of("Punctuation Normalizer", "punctuation"), of("Sentence Budget", "sentences"), of("Length Control", "words"), F.size(by_rule).cast("long").alias("rules"), rest.alias("total"))


def score_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens saved, whole percents and the bands of scores, from each document's size and id."""
    before, after, points = F.col("n_chars") % 400, F.col("n_chars") % 300, F.col("doc_id") % 11
    return _table(spark, sf_dir, "documents").select("doc_id", score.saved(before, after).cast("long").alias("saved"), score.saving_percent(before, after).cast("long").alias("percent"), score.bar(points).alias("bar"), score.badge(points).alias("badge"))


QUERIES: dict[str, Query] = {
    **{f"guarded_{name}": _guard(name) for name in GUARDED},
    "guarded_conflicts": guarded_conflicts,
    **{f"unclosed_{name}": _unclosed(name) for name in UNCLOSED},
    "marked_pieces": marked_pieces,
    "escaped_marks": escaped_marks,
    "text_sizes": text_sizes,
    "savings_map": savings_map,
    "whole_savings_map": partial(savings_map, quotes=True),
    "score_bars": score_bars,
}
_begin, _end = f"Run `a.b` and `` then:\n{_FENCE} “", " end”, `end"
ORACLES: dict[str, str] = {
    **{f"guarded_{name}": f"SELECT doc_id, {_guarded_sql(became, inside, last)} AS out FROM documents" for name, (_, _, _, inside, _, became, last) in GUARDED.items()},
    "guarded_conflicts": "SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS kinds, CAST(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS conflicts FROM documents",
    **{f"unclosed_{name}": _unclosed_sql(name) for name in UNCLOSED},
    "marked_pieces": f"SELECT doc_id, CAST(5 + 2 + length({_sql(_FENCE)}) + 1 + length(coalesce(text, '')) + 5 AS BIGINT) AS protected_chars, CAST(4 + 5 AS BIGINT) AS pieces, {_sql(_begin)} || coalesce(text, '') || {_sql(_end)} AS t FROM documents",
    "escaped_marks": f"SELECT doc_id, CAST(1 + length(coalesce(text, '')) + 4 + n + 1 + CASE WHEN n % 2 = 1 THEN 3 ELSE 0 END AS BIGINT) AS protected_chars FROM (SELECT doc_id, text, {_sql_pick(BACKSLASHES)} AS n FROM documents)",
    "text_sizes": r"""SELECT doc_id, CAST(CASE WHEN regexp_replace(g, '\s', '', 'g') = '' THEN 0 ELSE len(regexp_extract_all(g, '[^\s]+')) END AS BIGINT) AS words, CAST(length(g) + length(regexp_replace(g, '[^\x{10000}-\x{10FFFF}]', '', 'g')) AS BIGINT) AS units
FROM (SELECT doc_id, coalesce(text, '') || repeat('😀é', CAST(doc_id % 4 AS INTEGER)) AS g FROM documents)""",
    "savings_map": _with(_FLAG) + ", b AS (SELECT doc_id, greatest(0, original - after_punct) AS punctuation, greatest(0, after_punct - after_sent) AS sentences, greatest(0, after_sent - final) AS words FROM n) SELECT *, CAST(15 AS BIGINT) AS rules, punctuation + sentences + words AS total FROM b",
    "score_bars": """SELECT doc_id, greatest(0, b - a) AS saved, CAST(CASE WHEN b > 0 THEN floor(CAST(b - a AS DOUBLE) / b * 100.0::DOUBLE + 0.5::DOUBLE) ELSE 0 END AS BIGINT) AS percent,
CASE WHEN p >= 7 THEN 'high' WHEN p >= 5 THEN 'mid' ELSE 'low' END AS bar, CASE WHEN p >= 8 THEN 'high' WHEN p >= 5 THEN 'mid' ELSE 'low' END AS badge
FROM (SELECT doc_id, n_chars % 400 AS b, n_chars % 300 AS a, doc_id % 11 AS p FROM documents)""",
}
