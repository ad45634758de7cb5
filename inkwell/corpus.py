"""Queries over whole tables on what goes beyond a single rule: failing rules, rules of each row, ranges, reports,
corpora compared, diffs, token counts, sessions. Each with its DuckDB counterpart where SQL can say it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import protect, text, tokens
from .llm.common import materialize, scratch
from .marked import GUARDED, MARKS, _guarded, _guarded_sql, _pick, _sql_pick
from .operators import diff, longdocs, reports, spans
from .operators import vocabulary as v
from .operators.custom import python_rule
from .operators.rules import BY_ID, RULES, Params, Stage
from .plans.pipeline import optimize, optimize_requests, rules_table
from .queries import _FLAG, FLAGSHIP, _filler_sql, _jtrim, _rate, _re2, _sentences, _sql, _table, _values, _with, _words, prompts
from .sources import templates
from .streaming import sessions

Query = Callable[[SparkSession, str], DataFrame]
#: The rank file of the counting query; any other does as well.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _whole(sql: str) -> str:
    """The same SQL over texts with their straight quotes."""
    return sql.replace("replace(coalesce(text, ''), '\"', '')", "coalesce(text, '')")


def bpe_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-pair tokens and words of each whole text."""
    counted = tokens.bpe(RANKS)
    return _table(spark, sf_dir, "documents").select("doc_id", counted(F.col("text")).cast("long").alias("tokens"), text.word_count(F.col("text")).cast("long").alias("words"))


# A rule that fails on some texts


def _cut(params: Params):
    """The text up to the first space from a place on; a text without one raises."""
    place = params.integer("place", 40)

    def change(t: str) -> tuple[str, list[str]]:
        return t[: t.index(" ", place)], [f"cut at the first space from {place} on"]

    return change


CUT = python_rule("cutAtSpace", "Cut At Space", "Level 3", "Keeps a text up to the first space from a place on", _cut)
_CUT_RULES = {"cutAtSpace": {"enabled": True, "params": {"place": 400}}, "lengthControl": {"enabled": True, "params": {"maxWords": 30}}}
_CUT_ORDER = ("cutAtSpace", "taskAnalyzer", "lengthControl")


def _failing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return optimize(_table(spark, sf_dir, "documents"), _CUT_RULES, order=_CUT_ORDER, extra=(CUT,))


def rule_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each rule was done, skipped or failed."""
    return reports.states(_failing(spark, sf_dir))


def failing_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the first rule fails the text goes on as it was, and the last rule still runs."""
    step = F.get("steps", F.lit(0))
    return _failing(spark, sf_dir).select("doc_id", step["status"].alias("status"), step["tokens_saved"].cast("long").alias("cut_saved"), "final_prompt")


_CUT_SQL = f"""
WITH c AS (SELECT doc_id, coalesce(text, '') AS t, strpos(substr(coalesce(text, ''), 401), ' ') AS p FROM documents),
k AS (SELECT doc_id, t, p, CASE WHEN p > 0 THEN left(t, 399 + p) ELSE t END AS u FROM c)"""

# Rules of each row


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts, each with rules of its own: thousands of configurations by id, some that can't be read, some missing."""
    d = F.col("doc_id")
    entry = lambda on, name, value: F.struct(on.alias("enabled"), F.create_map(F.lit(name), value).alias("params"))
    words = F.when(d % 5 == 0, "many").otherwise((d % 50 + 10).cast("string"))
    rules = F.create_map(
        F.lit("fillerRemoval"), entry(d % 4 != 0, "aggressiveness", (d % 10 * 10).cast("string")),
        F.lit("sentenceBudget"), entry(d % 2 == 0, "maxSentences", (d % 6).cast("string")),
        F.lit("lengthControl"), entry(d % 3 != 0, "maxWords", words),
    )
    return prompts(spark, sf_dir, quotes=True).select("doc_id", F.col("t").alias("prompt"), F.when(d % 11 != 0, rules).alias("rules"))


def requests_by_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = optimize_requests(requests(spark, sf_dir))
    ran = F.aggregate("steps", F.lit(0), lambda n, s: n + (s["status"] == "done").cast("int"))
    return done.select("doc_id", "final_prompt", ran.cast("long").alias("ran"), F.col("token_stats.compression_rate").alias("rate"))


def _tier_sql(tier: str) -> str:
    return _whole(_filler_sql(tier))


_REQUESTS_SQL = (
    _whole(_with(""))
    + f""", low AS ({_tier_sql('LOW')}), mid AS ({_tier_sql('MEDIUM')}), high AS ({_tier_sql('HIGH')}),
f AS (SELECT p.doc_id, p.t, p.doc_id % 11 <> 0 AS has, CASE WHEN p.doc_id % 11 = 0 OR p.doc_id % 4 = 0 THEN p.t WHEN p.doc_id % 10 <= 3 THEN low.out WHEN p.doc_id % 10 <= 7 THEN mid.out ELSE high.out END AS u
  FROM prompts p JOIN low USING (doc_id) JOIN mid USING (doc_id) JOIN high USING (doc_id)),
s AS (SELECT *, {_sentences('u')} AS ss, CASE WHEN doc_id % 6 > 0 THEN CAST(doc_id % 6 AS INTEGER) ELSE 3 END AS most FROM f),
b AS (SELECT *, CASE WHEN has AND doc_id % 2 = 0 AND len(ss) > most THEN array_to_string(ss[1:most], ' ') || CASE WHEN regexp_matches(array_to_string(ss[1:most], ' '), '[.?!]$') THEN ' ...' ELSE '...' END ELSE u END AS w FROM s),
l AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN 50 ELSE CAST(doc_id % 50 + 10 AS INTEGER) END AS cap FROM b),
z AS (SELECT *, CASE WHEN has AND doc_id % 3 <> 0 AND {_words('w')} > cap THEN array_to_string(regexp_split_to_array({_jtrim('w')}, '\\s+')[1:cap], ' ') || '...' ELSE w END AS final_prompt FROM l),
n AS (SELECT *, {_words('t')} AS original, {_words('final_prompt')} AS final FROM z)
SELECT doc_id, final_prompt, CAST(CASE WHEN has THEN CAST(doc_id % 4 <> 0 AS INTEGER) + CAST(doc_id % 2 = 0 AS INTEGER) + CAST(doc_id % 3 <> 0 AS INTEGER) ELSE 0 END AS BIGINT) AS ran, {_rate} AS rate FROM n"""
)

# Ranges

#: What the punctuation rule looks for; it takes out all but one character, or all but three.
_CANDIDATE = r"!{2,}|\?{2,}|\.{4,}"


def protected_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each text between marks: runs of protected characters, candidates for the punctuation rule, those that touch
    protected characters, what the rule took out, and what it should have taken out of the others.

    The texts are searched once: their ranges, a few numbers each, are written and read by what counts them.
    """
    _, _, before, inside, behind, _, _ = GUARDED["punctuation"]
    stage = Stage(_table(spark, sf_dir, "documents").select("doc_id", _guarded(before, inside, behind).alias("t")))
    segs = stage.put(protect.segments(F.col("t")))
    kept = stage.put(F.transform(segs, lambda s: F.struct(F.when(s["p"], 0).otherwise(F.length(s["t"])).alias("gap"), F.when(s["p"], F.length(s["t"])).otherwise(0).alias("size"), F.lit("").alias("kind"))))
    hits = stage.put(spans.match_ranges(F.col("t"), _CANDIDATE))
    out, _ = BY_ID["punctuationNormalizer"].apply(stage, F.col("t"), Params())
    ranges = stage.df.select("doc_id", (F.length("t") - F.length(out)).cast("long").alias("removed"), kept.alias("kept"), hits.alias("hits"))
    with scratch(spark) as keep:
        whole = materialize(ranges, "audit-ranges")
        protected = spans.placed(whole, "doc_id", pieces="kept").where("end > start")
        found = spans.placed(whole.select("doc_id", "hits"), "doc_id", pieces="hits")
        touched = spans.overlapping(found, protected, "doc_id", extra=("kind",)).select("doc_id", "start", "end", "kind").distinct().groupBy("doc_id").agg(F.count("*").alias("shielded"), F.sum(_excess()).alias("shielded_excess"))
        totals = found.groupBy("doc_id").agg(F.count("*").alias("candidates"), F.sum(_excess()).alias("excess"))
        joined = whole.select("doc_id", "removed").join(spans.covered(protected, "doc_id"), "doc_id", "left").join(totals, "doc_id", "left").join(touched, "doc_id", "left")
        number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
        done = materialize(joined.select("doc_id", number("ranges").alias("ranges"), number("characters").alias("characters"), number("candidates").alias("candidates"), number("shielded").alias("shielded"), "removed", (number("excess") - number("shielded_excess")).alias("explained")), "audited")
        keep(done)
    return done


def _excess() -> Column:
    """What the rule takes out of a run: all but one mark, or all but three dots."""
    return F.col("end") - F.col("start") - F.when(F.col("kind") == ".", 3).otherwise(1)


def _audit_sql() -> str:
    import re

    before, inside, behind = GUARDED["punctuation"][2:5]
    excess = sum(len(m) - (3 if m[0] == "." else 1) for x in (before, behind) for m in re.findall(_CANDIDATE, x))
    opening, closing = (_sql_pick(tuple(m[k] for m in MARKS)) for k in (0, 1))
    piece = f"{opening} || 'as ' || coalesce(text, '') || {_sql(f' {inside} end')} || {closing}"
    count = lambda t: f"CAST(len(regexp_extract_all({t}, '{_CANDIDATE}')) AS BIGINT)"
    return f"SELECT doc_id, CAST(1 AS BIGINT) AS ranges, CAST(length({piece}) AS BIGINT) AS characters, {count(_guarded_sql(before, inside, behind))} AS candidates, {count(piece)} AS shielded, CAST({excess} AS BIGINT) AS removed, CAST({excess} AS BIGINT) AS explained FROM documents"



# Phrases said twice

#: What stands behind the texts, by id: repeats at each distance, within and across one another, with marks.
_TWICE = (" go go on.", " step by step step by step!", " So, so it it is, is? no", " a b a b a b a b", " Yes. yes. Yes", " on and on and on and off and off", "")


def phrases_said_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrase rule on each whole text, straight quotes aside, with phrases said twice behind it."""
    stage = Stage(prompts(spark, sf_dir).select("doc_id", F.concat("t", _pick(_TWICE)).alias("t")))
    out, log = BY_ID["duplicatePhraseReducer"].apply(stage, F.col("t"), Params())
    return stage.df.select("doc_id", out.alias("out"), (F.size(log) - 1).cast("long").alias("removed"))


def _twice_sql() -> str:
    """The rule by recursion: one word, or one phrase, a step; again on what is left, five times at most."""
    edge = """[,.?!:;"''()]"""
    again = lambda k: f"(spot + {2 * k - 1} <= len(toks) AND keys[spot:spot + {k - 1}] = keys[spot + {k}:spot + {2 * k - 1}] AND len(list_filter(keys[spot:spot + {k - 1}], lambda x: x <> '')) > 0)"
    size = f"CASE WHEN {again(3)} THEN 3 WHEN {again(2)} THEN 2 WHEN {again(1)} THEN 1 ELSE 0 END"
    marks = f"regexp_extract(toks[spot + 2 * size - 1], '{edge}*$')"
    kept = f"list_append(toks[spot:spot + size - 2], CASE WHEN ends_with(toks[spot + size - 1], {marks}) THEN toks[spot + size - 1] ELSE toks[spot + size - 1] || {marks} END)"
    white = r"[\x09-\x0d\x1c-\x20]"
    return _with("").replace("WITH ", "WITH RECURSIVE ", 1) + rf""", x AS (SELECT doc_id, t || {_sql_pick(_TWICE)} AS t FROM prompts),
k AS (SELECT doc_id, unnest(regexp_split_to_array({_jtrim('t')}, '[ \t\n\x0b\f\r]+')) AS tok, generate_subscripts(regexp_split_to_array({_jtrim('t')}, '[ \t\n\x0b\f\r]+'), 1) AS i FROM x),
e AS (SELECT *, lower(regexp_replace(tok, '^{edge}+|{edge}+$', '', 'g')) AS key, coalesce(sum(CAST(regexp_matches(tok, '[.?!]{edge}*$') AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent FROM k),
s AS (SELECT doc_id, sent, list(tok ORDER BY i) AS toks, list(key ORDER BY i) AS keys FROM e GROUP BY doc_id, sent),
w(doc_id, sent, walk, spot, toks, keys, done_toks, done_keys, n, total) AS (
  SELECT doc_id, sent, 1, 1, toks, keys, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), 0, 0 FROM s WHERE len(list_filter(keys, lambda x, i: x = keys[i + 1] OR x = keys[i + 2] OR x = keys[i + 3])) > 0
  UNION ALL
  SELECT doc_id, sent, CASE WHEN ended THEN walk + 1 ELSE walk END, CASE WHEN ended THEN 1 WHEN size = 0 THEN spot + 1 ELSE spot + 2 * size END, CASE WHEN ended THEN done_toks ELSE toks END, CASE WHEN ended THEN done_keys ELSE keys END,
    CASE WHEN ended THEN [] WHEN size = 0 THEN list_append(done_toks, toks[spot]) ELSE list_concat(done_toks, {kept}) END, CASE WHEN ended THEN [] WHEN size = 0 THEN list_append(done_keys, keys[spot]) ELSE list_concat(done_keys, keys[spot:spot + size - 1]) END,
    CASE WHEN ended THEN 0 WHEN size = 0 THEN n ELSE n + 1 END, CASE WHEN ended OR size = 0 THEN total ELSE total + 1 END
  FROM (SELECT *, spot > len(toks) AS ended, {size} AS size FROM w WHERE spot <= len(toks) OR (n > 0 AND walk < 5))),
f AS (SELECT doc_id, sent, done_toks, total FROM w WHERE spot > len(toks) AND (n = 0 OR walk = 5)),
j AS (SELECT s.doc_id, string_agg(array_to_string(coalesce(done_toks, toks), ' '), ' ' ORDER BY s.sent) AS body, coalesce(sum(total), 0) AS total FROM s LEFT JOIN f USING (doc_id, sent) GROUP BY s.doc_id)
SELECT doc_id, CASE WHEN total > 0 THEN regexp_extract(t, '^{white}*') || body || regexp_extract(t, '{white}*$') ELSE t END AS out, CAST(total AS BIGINT) AS removed FROM x JOIN j USING (doc_id)"""


# Reports


def savings_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Savings by language, source and rule: by all three, by language, by source and rule, and in all."""
    steps = reports.step_rows(optimize(prompts(spark, sf_dir, quotes=True), _TWO, "t", order=tuple(_TWO)), "lang", "source")
    return reports.savings_sets(steps, [["lang", "source", "rule_name"], ["lang"], ["source", "rule_name"], []], "lang", "source", "rule_name").select("lang", "source", "rule_name", "n", "saved", "level")


#: Two rules that leave no character alone, so that SQL can say what they do to texts with quotes.
_TWO = {"sentenceBudget": FLAGSHIP["sentenceBudget"], "lengthControl": FLAGSHIP["lengthControl"]}
_TWO_SQL = (
    _whole(_with(""))
    + f""", q AS (SELECT *, {_sentences('t')} AS ss FROM prompts),
r AS (SELECT *, CASE WHEN len(ss) > 5 THEN array_to_string(ss[1:5], ' ') || CASE WHEN regexp_matches(array_to_string(ss[1:5], ' '), '[.?!]$') THEN ' ...' ELSE '...' END ELSE t END AS w FROM q),
z AS (SELECT *, CASE WHEN {_words('w')} > 40 THEN array_to_string(regexp_split_to_array({_jtrim('w')}, '\\s+')[1:40], ' ') || '...' ELSE w END AS final_prompt FROM r),
n AS (SELECT *, CAST({_words('t')} AS BIGINT) AS original, CAST({_words('w')} AS BIGINT) AS middle, CAST({_words('final_prompt')} AS BIGINT) AS final FROM z)"""
)


def top_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five documents of each source that lose most words."""
    done = optimize(prompts(spark, sf_dir, quotes=True), _TWO, "t", order=tuple(_TWO), record=False)
    rows = done.select("source", "doc_id", (F.col("token_stats.original") - F.col("token_stats.final")).cast("long").alias("saved"))
    return reports.most_saving(rows, "source", F.col("saved"), "doc_id", 5).select("source", F.col("rank").cast("long").alias("rank"), "doc_id", "saved")


def rate_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of compression rates and how many sentences differ, by source, from sketches by source and language."""
    done = optimize(prompts(spark, sf_dir, quotes=True), _TWO, "t", order=tuple(_TWO), record=False)
    rows = done.select("source", "lang", F.col("token_stats.compression_rate").alias("rate"), F.md5("final_prompt").alias("item"))
    merged = reports.merged_sketches(reports.rate_sketches(rows, "source", "lang"), "source")
    quantile = lambda q: F.kll_sketch_get_quantile_double("rates", F.lit(q))
    return merged.select("source", "n", quantile(0.5).alias("median"), quantile(0.9).alias("p90"), F.hll_sketch_estimate("items").alias("different"))


def rules_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule with its text and place, and what the rules that are on did to the documents."""
    steps = reports.step_rows(optimize(prompts(spark, sf_dir, quotes=True), _TWO, "t"))
    done = steps.groupBy("rule_name").agg(F.count(F.when(F.col("status") == "done", 1)).alias("done"), F.sum("saved").cast("long").alias("saved"))
    return rules_table(spark).join(done, F.col("name") == F.col("rule_name"), "left").select("id", "name", "level", "description", "position", F.coalesce("done", F.lit(0)).alias("done"), F.coalesce("saved", F.lit(0)).alias("saved"))


def prompt_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each template with how many documents it is assigned to, and the words of prompt and text together."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    given = templates.assign(docs, "doc_id").withColumn("words", text.word_count(F.col("prompt")) + text.word_count(F.col("text")))
    used = given.groupBy("task_type", "verbosity", "variant").agg(F.count("*").alias("documents"), F.sum("words").cast("long").alias("words"))
    key = ["task_type", "verbosity", "variant"]
    return templates.templates(spark).join(used, key, "left").select(*key, "prompt", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("words", F.lit(0)).alias("words"))


#: Parameters of requests for prompts, by id: usual and odd forms, unknown ones, none.
_ASKED = ((" coding", "DEBUG ", "Explain", "writing", "COMPARE", "cooking", None), ("low", "MEDIUM ", " high", "loud"), ("template", "AI", " Template", "web", None))


def template_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for a prompt for each document: what it is answered with, or what is wrong with it."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", *(_pick(x).alias(n) for n, x in zip(("t", "v", "s"), _ASKED, strict=True)))
    return templates.answers(docs, "doc_id", "t", "v", "s").withColumnRenamed("id", "doc_id")


def _answers_sql() -> str:
    task, level, source = (f"list_extract([{', '.join('NULL' if x is None else _sql(x) for x in xs)}], CAST(doc_id % {len(xs)} AS INTEGER) + 1)" for xs in _ASKED)
    known = (("task_type", templates.TASK_TYPES, "task type"), ("verbosity", templates.VERBOSITIES, "verbosity"), ("source", templates.SOURCES, "source"))
    wrong = " ".join(f"WHEN {c} NOT IN ({', '.join(map(_sql, xs))}) THEN {_sql(what + chr(32) + chr(39))} || {c} || {_sql(chr(39) + ': one of ' + ', '.join(xs))}" for c, xs, what in known)
    return f"WITH q AS (SELECT doc_id, upper(trim(coalesce({task}, ''), ' ')) AS task_type, upper(trim({level}, ' ')) AS verbosity, lower(trim(coalesce({source}, 'template'), ' ')) AS source FROM documents), e AS (SELECT *, CASE {wrong} END AS error, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 3 AS v FROM q) SELECT doc_id, e.task_type, e.verbosity, source, error, prompt FROM e LEFT JOIN {_TEMPLATES} r ON error IS NULL AND source = 'template' AND r.task_type = e.task_type AND r.verbosity = e.verbosity AND r.variant = v"


# Number phrases by their values

_SAID = (*v.ONES, *v.TENS, *v.SCALES)


def number_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number rule on three phrases of up to five number words, chosen by the hash of each document's whole text."""
    said = F.array(*map(F.lit, _SAID))
    word = lambda k: F.get(said, templates.number_of(F.concat(F.lit(f"{k}:"), F.coalesce("text", F.lit(""))), len(_SAID)).cast("int"))
    phrase = lambda first, n: F.concat_ws(" ", *(word(first + k) for k in range(n)))
    t = F.concat(F.lit("All "), phrase(0, 5), F.lit(". Of "), phrase(5, 2), F.lit(" percent, or "), phrase(7, 1), F.lit(" in it"))
    stage = Stage(_table(spark, sf_dir, "documents").select("doc_id", t.alias("t")))
    out, _ = BY_ID["numberNormalizer"].apply(stage, F.col("t"), Params())
    return stage.df.select("doc_id", out.alias("out"))


def _values_sql() -> str:
    """Each phrase's value by folding its words: a running number, and what larger scales have closed."""
    word = lambda k: f"list_extract([{', '.join(map(_sql, _SAID))}], CAST(CAST('0x' || substr(md5('{k}:' || coalesce(text, '')), 1, 8) AS BIGINT) % {len(_SAID)} AS INTEGER) + 1)"
    pair = lambda r, c: f"{{'r': {r}, 'c': {c}, 'w': ''}}"
    number = "CASE x.w " + " ".join(f"WHEN '{w}' THEN {n}" for w, n in {**v.ONES, **v.TENS}.items()) + " END"
    some, none = "CASE WHEN a.c = 0 THEN 1 ELSE a.c END", "CAST(0 AS HUGEINT)"
    step = f"CASE x.w WHEN 'hundred' THEN {pair('a.r', some + ' * 100')} " + " ".join(f"WHEN '{w}' THEN {pair(f'a.r + {some} * {v.SCALES[w]}', none)}" for w in ("thousand", "million")) + f" ELSE {pair('a.r', f'a.c + {number}')} END"
    folded = lambda ws: f"list_reduce(list_prepend({pair(none, none)}, list_transform([{', '.join(ws)}], lambda w: {{'r': {none}, 'c': {none}, 'w': w}})), lambda a, x: {step})"
    said = ", ".join(f"{folded([word(k) for k in ks])} AS n{n}" for n, ks in enumerate((range(5), range(5, 7), range(7, 8))))
    value = lambda k: f"CAST(n{k}.r + n{k}.c AS VARCHAR)"
    return f"WITH f AS (SELECT doc_id, {said} FROM documents) SELECT doc_id, 'All ' || {value(0)} || '. Of ' || {value(1)} || '%, or ' || {value(2)} || ' in it' AS out FROM f"


# Corpora compared


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sentences, in lower case, of all documents before and after both rules."""
    done = optimize(prompts(spark, sf_dir, quotes=True), _TWO, "t", order=tuple(_TWO), record=False)
    of = lambda c: done.select(F.explode(text.sentences(F.col(c))).alias("s")).select(F.lower("s").alias("sentence"))
    return of("t"), of("final_prompt")


def sentences_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that the corpus has more often before than after, and how much more often."""
    return reports.only_before(*_versions(spark, sf_dir)).groupBy("sentence").agg(F.count("*").alias("n"))


def sentences_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that the corpus has before and after, and how often in both."""
    return reports.in_both(*_versions(spark, sf_dir)).groupBy("sentence").agg(F.count("*").alias("n"))


def budget_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each text before and after a sentence budget, and how many of them the other side lacks."""
    stage = Stage(prompts(spark, sf_dir, quotes=True))
    out, _ = BY_ID["sentenceBudget"].apply(stage, F.col("t"), Params({"maxSentences": 5}))
    rows = diff.before_after(stage.df.select("doc_id", "t", out.alias("after")), "doc_id", "t", "after")
    return rows.groupBy(F.col("id").alias("doc_id"), "side").agg(F.count("*").alias("chunks"), F.sum(F.when(F.col("kept"), 0).otherwise(1)).alias("flagged"))


_JS = r"\x09-\x0d\x20\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
_JS_CHUNK = rf"[^.!?]+[.!?]?(?:[{_JS}]+|$)"


def _chunks_sql(t: str) -> str:
    """Matches, and what lies between them."""
    return f"list_concat(regexp_extract_all({t}, '{_JS_CHUNK}'), list_filter(string_split(regexp_replace({t}, '{_JS_CHUNK}', chr(1), 'g'), chr(1)), lambda x: x <> ''))"


_DIFF_SQL = _whole(_with(f", q AS (SELECT doc_id, t, {_sentences('t')} AS ss FROM prompts), a AS (SELECT doc_id, t, CASE WHEN len(ss) > 5 THEN array_to_string(ss[1:5], ' ') || CASE WHEN regexp_matches(array_to_string(ss[1:5], ' '), '[.?!]$') THEN ' ...' ELSE '...' END ELSE t END AS w FROM q)")) + rf"""
, c AS (SELECT doc_id, 'before' AS side, unnest({_chunks_sql('t')}) AS chunk FROM a UNION ALL SELECT doc_id, 'after', unnest({_chunks_sql('w')}) FROM a),
k AS (SELECT doc_id, side, lower(trim(regexp_replace(chunk, '[{_JS}]+', ' ', 'g'), ' ')) AS key FROM c),
g AS (SELECT doc_id, key, count(*) FILTER (side = 'before') AS b, count(*) FILTER (side = 'after') AS a FROM k GROUP BY ALL),
u AS (SELECT doc_id, 'before' AS side, b AS chunks, CASE WHEN key = '' THEN 0 ELSE greatest(0, b - a) END AS flagged FROM g UNION ALL SELECT doc_id, 'after', a, CASE WHEN key = '' THEN 0 ELSE greatest(0, a - b) END FROM g)
SELECT doc_id, side, CAST(sum(chunks) AS BIGINT) AS chunks, CAST(sum(flagged) AS BIGINT) AS flagged FROM u GROUP BY doc_id, side HAVING sum(chunks) > 0"""


# Sources as documents that fit no row


#: Sentences are as large as the input; packed harder they cost half.
_ZSTD = {"compression": "zstd"}


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source as one document, whose parts are the source's texts in order of their ids; written, as it is read again and again."""
    return materialize(longdocs.sentence_rows(prompts(spark, sf_dir), "source", "doc_id", "t"), "source-rows", _ZSTD)


def source_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source without the sentences that it has said before, in blocks of 20,000 characters."""
    with scratch(spark) as keep:
        kept = materialize(longdocs.distinct_sentences(_sources(spark, sf_dir)), "source-kept", _ZSTD)
        done = materialize(longdocs.blocks(kept, 20_000).select(F.col("doc").alias("source"), "block", "sentences", F.md5("text").alias("digest")), "source-blocks")
        keep(done)
    return done


def source_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source with the first demand for each output format alone, and how many sentences that leaves."""
    with scratch(spark) as keep:
        rows = _sources(spark, sf_dir)
        kept = materialize(longdocs.first_of_kinds(rows, v.OUTPUT_FORMATS, v.FORMAT_WORDS), "source-kept", _ZSTD)
        sizes = longdocs.blocks(kept, 100_000).groupBy("doc").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).cast("long").alias("chars"))
        counts = longdocs.lost(rows, kept)
        joined = counts.join(sizes.withColumnRenamed("doc", "d"), F.col("doc").eqNullSafe(F.col("d"))).select(F.col("doc").alias("source"), "before", "after", "blocks", "chars")
        done = materialize(joined, "source-formats")
        keep(done)
    return done


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user: events that lie less than half an hour apart."""
    found = sessions(_table(spark, sf_dir, "events"), "ts", "user_id", "value", "30 minutes", late=None)
    return found.select("user_id", F.unix_micros(F.col("session.start").cast("timestamp")).alias("start_us"), F.unix_micros(F.col("session.end").cast("timestamp")).alias("end_us"), "n", "total")


_LONG_SQL = _with(rf", l AS (SELECT source, doc_id, list_filter(list_transform(regexp_extract_all(t, '[^.!?]+[.!?]?'), lambda s: {_jtrim('s')}), lambda s: s <> '') AS ss FROM prompts), r AS (SELECT source, doc_id, generate_subscripts(ss, 1) AS i, unnest(ss) AS s FROM l)")


def _kind_sql(kinds: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(s, {_re2(p)}, 'i') THEN {_sql(k)}" for k, p in kinds.items()) + " END"


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (bpe_counts, rule_states, failing_rule, requests_by_row, protected_audit, phrases_said_twice, savings_cube, top_savings, rate_sketches, rules_metadata, prompt_templates, template_answers, number_values, sentences_lost, sentences_kept, budget_diff, source_sentences, source_formats, event_sessions)
}
_TEMPLATES = "(SELECT row_number() OVER () - 1 AS k, * FROM (VALUES " + _values(templates._rows()) + ") AS r(task_type, verbosity, variant, prompt))"
_SENTENCES_SQL = _TWO_SQL + f", b AS (SELECT lower(unnest(ss)) AS sentence FROM n), f AS (SELECT {_sentences('final_prompt')} AS fs FROM n), a AS (SELECT lower(unnest(fs)) AS sentence FROM f)"
ORACLES: dict[str, str] = {
    "rule_states": _CUT_SQL + " SELECT 'Cut At Space' AS rule_name, CASE WHEN p > 0 THEN 'done' ELSE 'error' END AS status, count(*) AS n FROM k GROUP BY ALL UNION ALL SELECT r, s, count(*) FROM k, (VALUES ('Task Analyzer', 'skipped'), ('Length Control', 'done')) AS x(r, s) GROUP BY ALL",
    "failing_rule": _CUT_SQL + rf" SELECT doc_id, CASE WHEN p > 0 THEN 'done' ELSE 'error' END AS status, CAST({_words('t')} - {_words('u')} AS BIGINT) AS cut_saved, CASE WHEN {_words('u')} > 30 THEN array_to_string(regexp_split_to_array({_jtrim('u')}, '\s+')[1:30], ' ') || '...' ELSE u END AS final_prompt FROM k",
    "requests_by_row": _REQUESTS_SQL,
    "protected_audit": _audit_sql(),
    "phrases_said_twice": _twice_sql(),
    "savings_cube": _TWO_SQL + ", s AS (SELECT lang, source, 'Sentence Budget' AS rule_name, greatest(0, original - middle) AS saved FROM n UNION ALL SELECT lang, source, 'Length Control', greatest(0, middle - final) FROM n) SELECT lang, source, rule_name, count(*) AS n, CAST(sum(saved) AS BIGINT) AS saved, CAST(GROUPING(lang, source, rule_name) AS BIGINT) AS level FROM s GROUP BY GROUPING SETS ((lang, source, rule_name), (lang), (source, rule_name), ())",
    "top_savings": _TWO_SQL + " SELECT source, row_number() OVER (PARTITION BY source ORDER BY original - final DESC, doc_id) AS rank, doc_id, original - final AS saved FROM n QUALIFY rank <= 5",
    "rules_metadata": _TWO_SQL + ", m AS (SELECT count(*) AS c, sum(greatest(0, original - middle)) AS s, sum(greatest(0, middle - final)) AS l FROM n) SELECT r.*, CAST(CASE WHEN id IN ('sentenceBudget', 'lengthControl') THEN c ELSE 0 END AS BIGINT) AS done, CAST(CASE id WHEN 'sentenceBudget' THEN s WHEN 'lengthControl' THEN l ELSE 0 END AS BIGINT) AS saved FROM m, (VALUES " + _values([(r.id, r.name, r.level, r.description, k) for k, r in enumerate(RULES)]) + ") AS r(id, name, level, description, position)",
    "prompt_templates": f"WITH r AS {_TEMPLATES}, d AS (SELECT CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % 45 AS k, {_words("coalesce(text, '')")} AS w FROM documents), g AS (SELECT k, count(*) AS c, sum(w) AS w FROM d GROUP BY k) SELECT task_type, verbosity, variant, prompt, coalesce(c, 0) AS documents, CAST(coalesce(w + c * {_words('prompt')}, 0) AS BIGINT) AS words FROM r LEFT JOIN g USING (k)",
    "template_answers": _answers_sql(),
    "number_values": _values_sql(),
    "sentences_lost": _SENTENCES_SQL + " SELECT sentence, count(*) AS n FROM (SELECT sentence FROM b EXCEPT ALL SELECT sentence FROM a) GROUP BY sentence",
    "sentences_kept": _SENTENCES_SQL + " SELECT sentence, count(*) AS n FROM (SELECT sentence FROM b INTERSECT ALL SELECT sentence FROM a) GROUP BY sentence",
    "budget_diff": _DIFF_SQL,
    "source_sentences": _LONG_SQL + rf""", k AS (SELECT source, doc_id, i, s, lower(trim(regexp_replace(regexp_replace(s, '\s+', ' ', 'g'), '[.!?]+$', ''), ' ')) AS key FROM r),
f AS (SELECT *, row_number() OVER (PARTITION BY source, key ORDER BY doc_id, i) AS nth FROM k),
b AS (SELECT source, doc_id, i, s, floor((sum(length(s) + 1) OVER (PARTITION BY source ORDER BY doc_id, i) - length(s) - 1) / 20000) AS block FROM f WHERE nth = 1)
SELECT source, CAST(block AS BIGINT) AS block, count(*) AS sentences, md5(string_agg(s, ' ' ORDER BY doc_id, i)) AS digest FROM b GROUP BY source, block""",
    "source_formats": _LONG_SQL + f""", k AS (SELECT source, doc_id, i, s, {_kind_sql(v.OUTPUT_FORMATS)} AS kind FROM r),
f AS (SELECT *, row_number() OVER (PARTITION BY source, kind ORDER BY doc_id, i) AS nth FROM k),
b AS (SELECT source, s, floor((sum(length(s) + 1) OVER (PARTITION BY source ORDER BY doc_id, i) - length(s) - 1) / 100000) AS block FROM f WHERE kind IS NULL OR nth = 1),
c AS (SELECT source, count(*) AS after, count(DISTINCT block) AS blocks, CAST(sum(length(s) + 1) - count(DISTINCT block) AS BIGINT) AS chars FROM b GROUP BY source), h AS (SELECT source, count(*) AS before FROM r GROUP BY source)
SELECT c.source, before, after, blocks, chars FROM c JOIN h ON c.source IS NOT DISTINCT FROM h.source""",
    "event_sessions": """WITH e AS (SELECT user_id, ts, value, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS end_us, count(*) AS n, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS total FROM s GROUP BY user_id, run""",
}
