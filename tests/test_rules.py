"""Each rule on the cases that define it, protected pieces, and the plan around the rules."""

import re
import time

import pytest
from pyspark.sql import functions as F

from inkwell.functions import jsontext, protect, score, text
from inkwell.operators import diff
from inkwell.operators.phrases import reduce_text
from inkwell.operators.rules import BY_ID, RULES, Params, Stage
from inkwell.plans.pipeline import ALL_ON, RuleConfig, optimize, reject_blank, rules_table

CASES = [
    ("fillerRemoval", {"aggressiveness": 20}, "Good evening! Draw a map of the harbour. I hope this helps.", "Draw a map of the harbour."),
    ("fillerRemoval", {}, "Hey, would you please open the gate? Please let me know soon.", "Open the gate?"),
    ("fillerRemoval", {"aggressiveness": 85}, "The roof is literally gone. Kind regards, the crew", "The roof is gone."),
    ("fillerRemoval", {}, "", ""),
    ("caseNormalizer", {}, "TELL ME WHERE THE FERRY STOPS. NAME EVERY PIER.", "Tell me where the ferry stops. Name every pier."),
    ("caseNormalizer", {}, 'LOOK UP `go("NORTH")` BEFORE YOU SAIL. DONE', 'Look up `go("NORTH")` before you sail. Done'),
    ("caseNormalizer", {}, "What do NASA and ESA plan for the moon?", "What do NASA and ESA plan for the moon?"),
    ("caseNormalizer", {"minLetters": 0}, "1234", "1234"),
    ("caseNormalizer", {}, "run what follows\n```\nDROP THE ANCHOR AND WAIT FOR WIND\n```", "run what follows\n```\nDROP THE ANCHOR AND WAIT FOR WIND\n```"),
    ("semanticCompressor", {"compressionLevel": 20}, "Row faster in order to win.", "Row faster to win."),
    ("semanticCompressor", {"compressionLevel": 50}, "The crew has to make a decision before noon.", "The crew has to decide before noon."),
    ("semanticCompressor", {"compressionLevel": 85}, "This boat has the ability to float.", "This boat can float."),
    ("semanticCompressor", {}, "Leave `in order to` there but not in order to", "Leave `in order to` there but not to"),
    ("duplicatePhraseReducer", {}, "Paint the hull coat by coat coat by coat.", "Paint the hull coat by coat."),
    ("duplicatePhraseReducer", {}, "Now count count the sails.", "Now count the sails."),
    ("duplicatePhraseReducer", {}, "Type `row row row` and row row on", "Type `row row row` and row on"),
    ("duplicateSentenceRemover", {}, "Keep `x. x.` here. Mend the nets. Mend the nets.", "Keep `x. x.` here. Mend the nets."),
    ("duplicateSentenceRemover", {"keepFirst": False}, "Up. Down. up!", "Down. up!"),
    ("punctuationNormalizer", {}, "Land!!! Where??? There......", "Land! Where? There..."),
    ("numberNormalizer", {}, "Bring thirty ropes.", "Bring 30 ropes."),
    ("numberNormalizer", {}, "Fill sixty percent of the hold.", "Fill 60% of the hold."),
    ("numberNormalizer", {}, "four hundred and eighty six miles", "486 miles"),
    ("numberNormalizer", {}, "one million thousand, or one, two", "1001000, or 3"),
    ("numberNormalizer", {}, "Can't touch 'the forty' but do touch forty", "Can't touch 'the forty' but do touch 40"),
    ("structureMinimizer", {}, "Stow   the sails\n\n\n\nbefore the  storm.", "Stow the sails\n\nbefore the storm."),
    ("structureMinimizer", {}, "a  \r\nb\n```\nx\n\n\n\ny  z\n```\n", "a\nb\n```\nx\n\n\n\ny  z\n```"),
    ("outputFormatDeduplicator", {}, "List the ports. Use bullet points. Answer as a list. Give me bullet points.", "List the ports. Use bullet points."),
    ("outputFormatDeduplicator", {}, "Send the log as JSON. Use JSON format. Respond in JSON.", "Send the log as JSON. Use JSON format."),
    ("outputFormatDeduplicator", {}, "Show bullet points. Respond in JSON.", "Show bullet points. Respond in JSON."),
    ("constraintDeduplicator", {}, "Name three knots. Be concise. Keep it short. Make it brief.", "Name three knots. Be concise."),
    ("constraintDeduplicator", {}, "Name three knots. Be concise. Give examples.", "Name three knots. Be concise. Give examples."),
    ("instructionConflictDetector", {}, "Be concise. Explain in detail.", "Be concise. Explain in detail."),
    ("sentenceBudget", {"maxSentences": 2}, "Reef the main. Trim the jib. Check the bilge. Call the pilot.", "Reef the main. Trim the jib. ..."),
    ("lengthControl", {"maxWords": 10}, "Tell me how the old lighthouse keeper knew each ship by the sound of its horn.", "Tell me how the old lighthouse keeper knew each ship..."),
    ("formatControl", {}, "Show it in bullet points: oars, rope.", "Show it in • oars, rope."),
    ("taskAnalyzer", {}, "Say what a keel does", "Say what a keel does"),
]


def test_dead_tails_are_passed_quickly(spark):
    """Behind an unclosed mark all is plain: taking such texts apart costs less than walking a class of all characters over them once."""
    text = ("wörd and more words here. " * 40_000) + "`code`"
    df = spark.range(0, 24, 1, 4).select(F.concat(F.lit("Stop!! “"), F.lit(text), F.col("id").cast("string")).alias("t")).localCheckpoint()

    def seconds(c):
        took = []
        for _ in range(2):
            began = time.time()
            df.select(c).write.format("noop").mode("overwrite").save()
            took.append(time.time() - began)
        return min(took)

    assert seconds(F.size(protect.segments(F.col("t")))) < seconds(F.length(F.regexp_replace("t", r"([\s\S]++)", "$1")))
    got = df.select(protect.segments(F.col("t")).alias("s"), "t").first()
    assert [x["p"] for x in got["s"]] == [False, True, False] and "".join(x["t"] for x in got["s"]) == got["t"]


def test_phrases_share_one_lower_case(spark):
    """Phrases are sought in the lower case that a piece brings along, which none of them makes anew."""
    stage = Stage(spark.createDataFrame([("BOLD text: a Bullet Points: b `as follows:` AS follows: c",)], "t string"))
    out, _ = BY_ID["formatControl"].apply(stage, F.col("t"), Params())
    done = stage.df.select(out.alias("o"))
    assert done.first()["o"] == "** a • b `as follows:` : c"
    assert not re.search(r"contains\(lower\(lambda", done._jdf.queryExecution().optimizedPlan().toString(), re.I)


def test_white_space_at_marks(spark):
    """What a changed piece loses towards a protected one comes back: a space, or the run if it holds a line end."""
    white = ["", " ", "  ", "\n", " \r\n ", "\u2028", "\u3000", "\x1c"]
    rows = [(f"`a`{x}In order to{y}`b`{y}in ORDER to{x}", x, y) for x in white for y in white]
    df = spark.createDataFrame(rows, "t string, x string, y string").coalesce(1)
    segs = protect.segments(F.col("t"))
    bare = protect.transformed(segs, lambda t: F.when(F.contains(F.lower(t), F.lit("order")), F.lit("to")).otherwise(t))
    back = lambda run: "" if not run else run if "\n" in run or "\r" in run else " "
    got = df.select(protect.joined(segs, bare).alias("o")).collect()
    assert [r["o"] for r in got] == [f"`a`{back(x)}to{back(y)}`b`{back(y)}to" for _, x, y in rows]


@pytest.mark.parametrize("rule_id", [r.id for r in RULES])
def test_rule(spark, rule_id):
    cases = [(k, p, i, w) for k, (r, p, i, w) in enumerate(CASES) if r == rule_id]
    assert cases
    for params in {tuple(sorted(p.items())) for _, p, _, _ in cases}:
        some = [(k, i, w) for k, p, i, w in cases if tuple(sorted(p.items())) == params]
        stage = Stage(spark.createDataFrame(some, "k int, t string, want string"))
        out, log = BY_ID[rule_id].apply(stage, F.col("t"), Params(dict(params)))
        for r in stage.df.select("k", "want", out.alias("out"), log.alias("log")).collect():
            assert r["out"] == r["want"], CASES[r["k"]]
            assert r["log"] and all(r["log"])


def test_overflow_keeps_words(spark):
    words = "one " + "million " * 1 + "hundred " * 12
    stage = Stage(spark.createDataFrame([(words.strip(),)], "t string"))
    out, _ = BY_ID["numberNormalizer"].apply(stage, F.col("t"), Params())
    assert stage.df.select(out).first()[0] == words.strip()


def _pieces(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", protect.segments(F.col("t")).alias("s"))
    return [[(x["t"], x["p"]) for x in r["s"]] for r in df.orderBy("k").collect()]


def test_pieces(spark):
    got = _pieces(
        spark,
        [
            'Before TWENTY "do not change" after',
            'Rewrite "in order to get TWENTY',
            "Don't change 'this one' but that",
            "``` a\nb ``` x `c` “q r” y",
            "",
            'open "never `code` closed',
            r"escaped \"not a quote\" here",
        ],
    )
    assert got[0] == [("Before TWENTY ", False), ('"do not change"', True), (" after", False)]
    assert got[1] == [('Rewrite "in order to get TWENTY', False)]
    assert got[2] == [("Don't change ", False), ("'this one'", True), (" but that", False)]
    assert got[3] == [("``` a\nb ```", True), (" x ", False), ("`c`", True), (" ", False), ("“q r”", True), (" y", False)]
    assert got[4] == [("", False)]
    assert got[5] == [('open "never ', False), ("`code`", True), (" closed", False)]
    assert got[6] == [(r"escaped \"not a quote\" here", False)]


def _quotes(t):
    """The quote scanner in plain Python: which characters are protected."""
    import re

    white = set(text.WHITE)
    keep = [False] * len(t)
    code = [False] * len(t)
    for m in re.finditer(r"```[\s\S]*?```|`[^`\r\n]*`", t):
        for i in range(*m.span()):
            keep[i] = code[i] = True
    partner = {'"': '"', "'": "'", "“": "”", "‘": "’"}
    opened = None
    for i, c in enumerate(t):
        if code[i]:
            continue
        slashes = 0
        while i - slashes - 1 >= 0 and t[i - slashes - 1] == "\\":
            slashes += 1
        free = slashes % 2 == 0
        if opened is None:
            if c in "\"'" and free and i + 1 < len(t) and t[i + 1] not in white and (i == 0 or t[i - 1] in white or t[i - 1] in "([{<:=-,"):
                opened = (i, partner[c])
            elif c in "“‘" and free:
                opened = (i, partner[c])
        elif c == opened[1] and free and t[i - 1] not in white and (i + 1 == len(t) or t[i + 1] in white or t[i + 1] in ".,!?:;)]}>"):
            for j in range(opened[0], i + 1):
                keep[j] = True
            opened = None
    return keep


def test_pieces_search_each_text_once(spark):
    """Patterns of quotes in one replacement; no class of characters that Java nests, on which threads wait for one another."""
    df = spark.createDataFrame([("a",)], "t string").select(protect.segments(F.col("t")).alias("s"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(protect.PIECES) == 1 and "regexp_extract_all" not in plan
    assert "“‘" not in protect.PIECES


def test_pieces_with_the_separators_in_texts(spark):
    import random

    rng = random.Random(4)
    own = "".join(map(chr, (*range(0xE000, 0xE006), *range(0xE010, 0xE016))))
    slashes = "\\" * 130
    texts = ["".join(rng.choice(f"ab '\"`“”\\{own}") for _ in range(rng.randrange(1, 24))) for _ in range(1000)]
    texts += [f"“{own}{slashes}” {own}” `{own}` “{own} `{own}`", f"{own}“{own} `{own}`"]
    for t, pieces in zip(texts, _pieces(spark, texts), strict=True):
        assert "".join(x for x, _ in pieces) == t
        assert [p for x, p in pieces for _ in x] == _quotes(t), t
        assert all(x for x, _ in pieces) and all(not (a[1] is False and b[1] is False) for a, b in zip(pieces, pieces[1:], strict=False)), t


def test_pieces_against_scanner(spark):
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice("ab .,'\"`“”‘’(\\\n") for _ in range(rng.randrange(1, 24))) for _ in range(3000)]
    for t, pieces in zip(texts, _pieces(spark, texts), strict=True):
        flags = [p for x, p in pieces for _ in x]
        assert "".join(x for x, _ in pieces) == t
        assert flags == _quotes(t), t


def test_no_native_expression_overflows_on_long_texts(spark):
    long = ("word 'a " * 20_000, '" ' * 40_000, "`" * 50_001, "twenty " * 5_000, "a." * 50_000)
    df = spark.createDataFrame([(t,) for t in long], "t string")
    assert all(sum(len(x["t"]) for x in r["s"]) == len(t) for r, t in zip(df.select(protect.segments(F.col("t")).alias("s")).collect(), long, strict=True))


def test_phrases_alone():
    assert reduce_text("a b, a b. c", 3, True) == ("a b,. c", ["a b"])  # both marks stay
    assert reduce_text("no twice", 3, True) == ("no twice", [])
    assert reduce_text("  go Go\n", 3, True) == ("  go\n", ["go"])
    assert reduce_text("go Go", 3, False) == ("go Go", [])


def test_pipeline(spark):
    rows = [(1, "Hello! Please explain explain this in order to help. Be concise. Explain in detail.", "x"), (2, None, "x"), (3, " ", "x")]
    done = optimize(spark.createDataFrame(rows, "id int, text string, final_prompt_note string"), ALL_ON)
    got = {r["id"]: r for r in done.collect()}
    assert len(got[1]["steps"]) == 15 and {s["status"] for s in got[1]["steps"]} == {"done"}
    assert got[1]["final_prompt"] == "Explain this to help. Be concise. Explain in detail."
    assert got[1]["steps"][11]["changes"][-1] == "possible conflict: CONCISE x DETAILED"
    stats = got[1]["token_stats"]
    assert (stats["original"], stats["final"], stats["compression_rate"]) == (14, 9, 35.7)
    assert sum(stats["by_rule"].values()) == 5
    assert got[2]["final_prompt"] == "" and got[2]["token_stats"]["compression_rate"] == 0.0
    for a, b in zip(got[1]["steps"], got[1]["steps"][1:], strict=False):
        assert a["output_text"] == b["input_text"]


def test_skips(spark):
    df = spark.createDataFrame([("Wait!!",)], "text string")
    r = optimize(df, {"punctuationNormalizer": {"enabled": False}, "lengthControl": RuleConfig(True, {"maxWords": "oops"})}).first()
    assert r["final_prompt"] == "Wait!!"
    assert [s["status"] for s in r["steps"]].count("done") == 1
    assert r["steps"][0]["changes"] == ["[SKIPPED] Rule is disabled"]
    with pytest.raises(ValueError):
        optimize(df, {"nothing": True})
    assert rules_table(spark).count() == 15


def test_order(spark):
    df = spark.createDataFrame([("Use `go go` go go!! In order to WIN",)], "text string")
    order = ("punctuationNormalizer", "duplicatePhraseReducer", "semanticCompressor")
    r = optimize(df, {k: True for k in order}, order=order).first()
    assert r["final_prompt"] == "Use `go go` go! to WIN"


def test_reject_blank(spark):
    good, bad = reject_blank(spark.createDataFrame([("a",), (" \t",), (None,), ("",)], "text string"))
    assert (good.count(), bad.count()) == (1, 3)


def test_params():
    p = Params({"a": "7", "b": 2.9, "c": "x", "d": "TRUE", "e": None, "f": True})
    assert (p.integer("a", 0), p.integer("b", 0), p.integer("c", 5), p.integer("e", 4)) == (7, 2, 5, 4)
    assert (p.truth("d", False), p.truth("e", True), p.truth("c", True)) == (True, True, False)
    assert p.number("a", 0.0) == 7.0 and p.number("c", 0.5) == 0.5


def test_json_fields(spark):
    rows = [('x ```json\n{"relevanceBefore": 7, "naturalSummary": "a\\n\\"b\\""}\n``` y',), ('{"relevanceBefore": -3}',), ('{"relevanceBefore": 7.9',), ("nothing",)]
    df = spark.createDataFrame(rows, "t string").select(jsontext.object_text(F.col("t")).alias("o"))
    got = df.select(jsontext.int_field(F.col("o"), "relevanceBefore"), jsontext.string_field(F.col("o"), "naturalSummary")).collect()
    assert [tuple(r) for r in got] == [(7, 'a\n"b"'), (5, ""), (7, ""), (5, "")]
    body = spark.createDataFrame([('{"choices":[{"message":{"role":"a","content":"say \\"x\\" \\\\ y"}}]}',), ("{}",)], "t string")
    assert [r[0] for r in body.select(jsontext.chat_content(F.col("t"))).collect()] == ['say "x" \\ y', None]


def test_scores(spark):
    rows = [(13, 3, 7, 8), (0, 3, 7, 8), (10, 10, 5, 5), (10, 20, 5, 5)]
    df = spark.createDataFrame(rows, "tb int, ta int, sb int, sa int")
    gain = score.efficiency_gain(F.col("sb"), F.col("sa"), F.col("tb"), F.col("ta"))
    got = df.select(gain.alias("g")).select("g", score.verdict(F.col("g"))).collect()
    assert [r["g"] for r in got] == [395.24, 0.0, 0.0, -50.0]
    assert [r[1] for r in got] == [score.VERDICTS[0][1], score.VERDICTS[2][1], score.VERDICTS[2][1], score.WORSE]
    half = spark.range(1).select(score.java_round(F.lit(-2.5)), score.java_round(F.lit(2.5))).first()
    assert tuple(half) == (-2, 3)


def test_diff(spark):
    df = spark.createDataFrame([(1, "One. Two. One! Three", "two. One.")], "id int, a string, b string")
    got = diff.diff(df, "id", "a", "b").orderBy("row", "pos").collect()
    assert "".join(r["chunk"] for r in got) == "One. Two. One! Three"
    assert [(r["chunk"].strip(), r["kept"]) for r in got] == [("One.", True), ("Two.", True), ("One!", False), ("Three", False)]


def test_word_counts(spark):
    df = spark.createDataFrame([("a b\tc",), ("  a ",), ("",), (None,), (" ",), (" ",), ("\x00",)], "t string")
    assert [r[0] for r in df.select(text.word_count(F.col("t"))).collect()] == [3, 1, 0, 0, 0, 0, 1]


def test_escapes_of_any_length(spark):
    """An odd number of backslashes escapes a mark, an even one doesn't, however many."""
    runs = [0, 1, 2, 3, 126, 127, 128, 129, 130, 131, 132, 133, 1000, 1001]
    texts = [f"say {chr(92) * n}\u201cgo go{chr(92) * m}\u201d go\u201d on" for n in runs for m in (0, 1, 130, 131)]
    texts += ["\ue000 " + texts[-1], f'a "b{chr(92) * 131}" c" d']
    for t, row in zip(texts, _pieces(spark, texts), strict=True):
        flags = _quotes(t)
        assert "".join(x for x, _ in row) == t
        assert [p for x, p in row for _ in x] == flags, t[:60]


def test_names_that_clash(spark):
    df = spark.createDataFrame([("Wait!! go", "a", "b", "c")], "text string, _s0 string, __s1 string, _body string")
    got = optimize(df, {"punctuationNormalizer": True, "lengthControl": True}).first()
    assert (got["final_prompt"], got["_s0"], got["__s1"]) == ("Wait! go", "a", "b")
    rows = df.select(F.lit('{"relevanceBefore": 7}').alias("score_json"), F.lit(1).alias("tokens_before"), F.lit(1).alias("tokens_after"), "_body")
    assert score.score_quality(rows).first()["_body"] == "c"


def test_rules_without_the_package_on_workers(tmp_path):
    """All rules, run from another folder with the package on the driver's path alone."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from inkwell.plans.pipeline import ALL_ON, optimize
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
print(optimize(spark.createDataFrame([("Count count sails.",)], "text string"), {{"duplicatePhraseReducer": True}}).first()["final_prompt"])
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "Count sails." in done.stdout, done.stderr[-1500:]


def test_patterns_are_held_against_sentences_alone(spark):
    """Whole texts are searched for words; each pattern of a kind stands in the plan once, for sentences that hold a word."""
    from inkwell.operators.rules import conflict_columns

    stage = Stage(spark.createDataFrame([("Be concise. Go on.\n`x`explain  in\ndetail!",)], "t string"))
    hits, pairs = conflict_columns(stage, F.col("t"))
    df = stage.df.select(hits.alias("hits"), pairs.alias("pairs"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert not [x for x in plan.split("RLIKE(")[1:] if "concise" in x.split("\n")[0][:200] and x.startswith("t#")]
    assert df.first()["hits"] == {"CONCISE": "Be concise.", "DETAILED": "explain in detail!"}


def test_closings_are_sought_once_for_the_record(spark):
    """Each closing's pattern stands in the plan for the text, and twice for its line of the record, not again for whether there is one."""
    stage = Stage(spark.createDataFrame([("Read on. THANKS IN ADVANCE! Any more?",)], "t string"))
    out, log = BY_ID["fillerRemoval"].apply(stage, F.col("t"), Params())
    df = stage.df.select(out.alias("out"), log.alias("log"))
    assert df._jdf.queryExecution().analyzed().toString().count(f"(?i){text.BEGIN}thanks in advance") <= 3
    assert df.first()["log"] == ["[MEDIUM] closing removed: THANKS IN ADVANCE!"]


def test_sentences_are_sought_once():
    """Within functions of array elements, what is named twice is made twice."""
    said = str(text.sentences(F.col("t")))
    assert said.count(text.SENTENCE) == 1 and said.count(r"\s+") == 1


def test_known_pieces_serve_again(spark):
    """A text that a rule left as it was isn't searched for its pieces again; a new one is."""
    stage = Stage(spark.createDataFrame([("a 'b' c",), (None,)], "t string"))
    planted = F.array(F.struct(F.lit("known").alias("t"), F.lit(False).alias("p")))
    stage.segments(F.col("t"))
    assert stage.known is not None
    stage.known = F.col("t"), planted
    same, new = stage.put(stage.pieces(F.col("t"))), stage.put(stage.pieces(F.concat(F.col("t"), F.lit("!"))))
    got = [(r[0] and [tuple(x) for x in r[0]], r[1] and [tuple(x) for x in r[1]]) for r in stage.df.select(same, new).collect()]
    assert got[0] == ([("known", False)], [("a ", False), ("'b'", True), (" c!", False)])


def test_structure_of_any_white_space(spark):
    """Patterns are tried only where a plain search finds a cause; the outcome is theirs."""
    import random

    rng = random.Random(4)
    inner = "".join(c for c in text.WHITE if c not in "\r\n")

    def plain(t):
        for pattern, to in ((rf"[{inner}]+(?=[\r\n]|\Z)", ""), (r"\r\n?", "\n"), (r"\n\Z", ""), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " ")):
            t = re.sub(pattern, to, t)
        return t.strip(text.WHITE)

    texts = ["".join(rng.choice("ab  \t\n\n\r\u2003\x0b") for _ in range(rng.randrange(14))) for _ in range(400)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    got = {r["k"]: r["final_prompt"] for r in optimize(df, {"structureMinimizer": True}, order=("structureMinimizer",), record=False).collect()}
    assert [got[k] for k in range(len(texts))] == [plain(t) for t in texts]
