"""Failing rules, rules of each row, token merging, ranges, diffs by row, sketches, streams, and time by pieces."""

import random
import re
import time
import tracemalloc
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkwell import corpus, queries
from inkwell.functions import tokens
from inkwell.operators import analytics, diff, longdocs, reports, spans
from inkwell.operators import vocabulary as v
from inkwell.operators.custom import python_rule
from inkwell.operators.rules import BY_ID, RULES, Params, Stage
from inkwell.plans.pipeline import optimize, optimize_requests
from inkwell.sources import io, templates
from inkwell.streaming import first_seen, sessions

RULES_TYPE = "map<string,struct<enabled:boolean,params:map<string,string>>>"


def plain_merge(raw, ranks):
    """Over and over the whole row of parts: the pair of least rank, the leftmost first."""
    parts = [raw[i : i + 1] for i in range(len(raw))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return parts
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merge():
    rng = random.Random(2)
    for _ in range(300):
        letters = [bytes([x]) for x in b"abcd"[: rng.randrange(1, 5)]]
        known = list(dict.fromkeys(letters + [b"".join(rng.choice(letters) for _ in range(rng.randrange(2, 6))) for _ in range(40)]))
        rng.shuffle(known)
        ranks = {t: k for k, t in enumerate(known)}
        raw = b"".join(rng.choice(letters) for _ in range(rng.randrange(0, 60)))
        got = tokens.merge(raw, ranks)
        assert got == plain_merge(raw, ranks) and b"".join(got) == raw
    assert tokens.merge(b"", {}) == [] and tokens.merge(b"xyz", {}) == [b"x", b"y", b"z"]
    began = time.time()
    assert len(tokens.merge(b"ab" * 200_000, {b"ab": 0, b"abab": 1})) == 100_000
    assert time.time() - began < 20


def test_bpe_keeps_little(monkeypatch):
    """Pieces that no longer come again, long pieces and long texts don't stay in a worker's memory."""
    pytest.importorskip("regex")
    monkeypatch.setattr(tokens, "REMEMBERED", 1000)
    raw = b"YWI= 0\nYWJhYg== 1\n"
    ranks, pick = tokens.read_ranks(raw), random.Random(4)
    pieces = ["".join(pick.choices("abc", k=pick.randint(0, 60))) for _ in range(2000)]
    assert all(tokens.merged(p.encode(), ranks) == len(tokens.merge(p.encode(), ranks)) for p in pieces)
    letters = lambda n: "".join(chr(97 + n // 26**k % 26) for k in range(5))
    rows = lambda: (pa.array([" ".join(letters(i * 500 + j) for j in range(500)), letters(i) * 400, None]) for i in range(60))
    tracemalloc.start()
    assert [x.to_pylist()[2] for x in tokens._counts(rows(), raw, tokens.PATTERN)] == [0] * 60
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    assert next(tokens._counts(iter([pa.array([" b" * 1_000_000])]), raw, tokens.PATTERN)).to_pylist() == [2_000_000]
    long = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2_000_000 and long < 20_000_000


def test_bpe_of_whole_texts(spark, data):
    public = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = public.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = tokens.read_ranks(f.read())
    known = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {r["doc_id"]: r["tokens"] for r in corpus.bpe_counts(spark, data).collect()}
    assert got == {k: len(known.encode_ordinary(t)) if t and t.strip() else 0 for k, t in texts.items()}
    odd = spark.createDataFrame([("<|endoftext|> é漢😀",), ("x" * 5000,), ("\t \n",), (None,)], "t string")
    assert [r[0] for r in odd.select(tokens.bpe(path)(F.col("t"))).collect()] == [len(known.encode_ordinary("<|endoftext|> é漢😀")), len(known.encode_ordinary("x" * 5000)), 0, 0]


def _halves(params):
    def change(t):
        if "bad" in t:
            raise RuntimeError("no halves")
        return (None if "none" in t else t[: len(t) // 2]), ["cut"]

    return change


HALF = python_rule("half", "Half", "Level 3", "First half", _halves)


def test_a_rule_that_fails_on_some_rows(spark):
    rows = [(1, "good good!! text"), (2, "bad bad!! text"), (3, None), (4, ""), (5, "none!! here")]
    df = spark.createDataFrame(rows, "id int, text string")
    order = ("half", "punctuationNormalizer", "taskAnalyzer")
    got = {r["id"]: r for r in optimize(df, {"half": True, "punctuationNormalizer": True}, order=order, extra=(HALF,)).collect()}
    assert [got[k]["steps"][0]["status"] for k in range(1, 6)] == ["done", "error", "done", "done", "done"]
    assert got[2]["steps"][0]["changes"] == ["[ERROR] Rule failed: RuntimeError: no halves"] and got[2]["steps"][0]["tokens_saved"] == 0
    assert got[2]["final_prompt"] == "bad bad! text" and got[1]["final_prompt"] == "good goo" and got[5]["final_prompt"] == "none! here"
    assert {s["status"] for r in got.values() for s in r["steps"][1:2]} == {"done"} and {r["steps"][2]["status"] for r in got.values()} == {"skipped"}
    assert got[2]["token_stats"]["by_rule"]["Half"] == 0
    count = {(r["rule_name"], r["status"]): r["n"] for r in reports.states(optimize(df, {"half": True}, order=("half",), extra=(HALF,))).collect()}
    assert count == {("Half", "done"): 4, ("Half", "error"): 1}


def test_a_counter_that_fails_on_some_rows(spark):
    counter = tokens.python_counter(lambda t: len(t) if "!" not in t[-1:] else 1 // 0)
    df = spark.createDataFrame([(1, "ab cd!!"), (2, "ab  cd")], "id int, text string")
    got = {r["id"]: r for r in optimize(df, {"punctuationNormalizer": True, "structureMinimizer": True}, counter=counter).collect()}
    states = lambda r: [s["status"] for s in r["steps"] if s["status"] != "skipped"]
    assert states(got[1]) == ["error", "error"] and got[1]["final_prompt"] == "ab cd!!"
    assert states(got[2]) == ["done", "done"] and got[2]["token_stats"]["final"] == 5


def test_rules_of_each_row_against_one_plan_a_configuration(spark):
    rng = random.Random(8)
    texts = ["Hello! Please look. In order to to win, be concise. Be brief. Use JSON. As JSON!! one two. Go up. Go up.", "GOOD DAY TO ALL OF YOU. STOP", "", "a `b b` \"c c\" d d!!", None]
    pool = {
        "fillerRemoval": ("aggressiveness", ["10", "50", "90", "x"]), "semanticCompressor": ("compressionLevel", ["0", "71", None]), "sentenceBudget": ("maxSentences", ["1", "-3", "2"]), "lengthControl": ("maxWords", ["4", "oops"]),
        "duplicatePhraseReducer": ("maxPhraseLength", ["1", "3", "9"]), "duplicateSentenceRemover": ("keepFirst", ["false", "TRUE"]), "caseNormalizer": ("minLetters", ["1", "500"]), "punctuationNormalizer": ("none", [None]),
    }
    rows = []
    for k in range(60):
        chosen = rng.sample(list(pool), rng.randrange(5))
        config = {r: (rng.random() < 0.8, {pool[r][0]: v for v in [rng.choice(pool[r][1])] if v is not None} if rng.random() < 0.9 else None) for r in chosen}
        rows.append((k, rng.choice(texts), {**config, "unknown": (True, {})} if rng.random() < 0.9 else None))
    df = spark.createDataFrame(rows, f"id int, prompt string, rules {RULES_TYPE}")
    got = {r["id"]: r for r in optimize_requests(df, order=tuple(pool)).collect()}
    by_config = defaultdict(list)
    for k, t, config in rows:
        by_config[repr(config)].append((k, t, config))
    for some in list(by_config.values())[:14]:
        plain = {r: {"enabled": on, "params": p or {}} for r, (on, p) in (some[0][2] or {}).items() if r != "unknown"}
        for want in optimize(spark.createDataFrame([x[:2] for x in some], "id int, prompt string"), plain, "prompt", order=tuple(pool)).collect():
            assert (got[want["id"]]["final_prompt"], got[want["id"]]["steps"], got[want["id"]]["token_stats"]) == (want["final_prompt"], want["steps"], want["token_stats"])


def test_added_names_and_assign(spark):
    df = spark.createDataFrame([("Wait!!", 1, 2, "n", "p")], "text string, Steps int, final_prompt int, _n string, prompt string")
    done = optimize(df, {"punctuationNormalizer": True})
    assert done.columns == ["text", "_n", "prompt", "final_prompt", "steps", "token_stats"] and done.first()["final_prompt"] == "Wait!"
    given = templates.assign(df, "_n").first()
    assert given["_n"] == "n" and given["prompt"] != "p"
    kinds = spark.createDataFrame([(1, "CONCISE"), (1, "DETAILED")], "`a.b` int, `k k` string")
    assert analytics.conflict_pairs(kinds, "a.b", "k k").count() == 1


@pytest.mark.parametrize("rule_id", [r.id for r in RULES])
def test_time_grows_with_the_number_of_pieces(spark, rule_id):
    """16 times the pieces may take far less than 16 times 16 times the time."""
    unit = {"caseNormalizer": "READ ALL OF `this` NOW. ", "outputFormatDeduplicator": "Use bullet points. `x` Respond in JSON. ", "constraintDeduplicator": "Be concise. `x` Give examples. "}.get(rule_id, "Look!! in order to `see` twenty birds birds. ")

    def seconds(n):
        stage = Stage(spark.createDataFrame([(unit * n,)], "t string"))
        out, log = BY_ID[rule_id].apply(stage, F.col("t"), Params({"uppercaseRatioThreshold": 0.5}))
        began = time.time()
        stage.df.select(F.length(out), F.size(log)).collect()
        return time.time() - began

    seconds(10)
    few, many = seconds(1000), seconds(16_000)
    assert many < max(12.0, 60 * few), (few, many)


def test_mark_characters_of_the_text_survive(spark):
    text = "READ   `x` AND  THEN `y` STOP. OK"
    stage = Stage(spark.createDataFrame([(text,)], "t string"))
    out, _ = BY_ID["caseNormalizer"].apply(stage, F.col("t"), Params())
    assert stage.df.select(out).first()[0] == "Read   `x` and  then `y` stop. Ok"


def test_spread_leaves_large_tables(spark, data, monkeypatch):
    one = spark.read.parquet(f"{data}/documents.parquet")
    assert io.spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(io, "SPREAD_BYTES", 10)
    assert io.spread(one) is one


# Ranges


def test_ranges(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 2]), a := rng.randrange(300), a + rng.randrange(12)) for _ in range(250)] + [(1, None, 3)]
    df = spark.createDataFrame(rows, "k int, start int, end int")
    got = sorted((tuple(r) for r in spans.merge_ranges(df, "k").select("k", "start", "end").collect()), key=repr)
    want = []
    for k in (None, 1, 2):
        for a, b in sorted((a, b) for x, a, b in rows if x == k and a is not None):
            if want and want[-1][0] == k and a <= want[-1][2]:
                want[-1] = (k, want[-1][1], max(b, want[-1][2]))
            else:
                want.append((k, a, b))
    assert got == sorted(want, key=repr)
    other = [(rng.choice([None, 1, 2]), a := rng.randrange(300), a + rng.randrange(90)) for _ in range(60)]
    pairs = Counter(tuple(r) for r in spans.overlapping(df, spark.createDataFrame(other, "k int, start int, end int"), "k", width=16).collect())
    assert pairs == Counter((k, a, b, c, d) for k, a, b in rows for m, c, d in other if k == m and a is not None and max(a, c) < min(b, d))
    assert spans.merge_ranges(df.limit(0), "k").count() == 0


def test_match_ranges(spark):
    texts = ["a!!b??", "", "!!", "no", "é!!!!!! x....y", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", spans.match_ranges(F.col("t"), r"!{2,}|\?{2,}|\.{4,}").alias("pieces"))
    got = {(r["k"], r["start"], r["end"], r["kind"]) for r in spans.placed(df, "k").collect()}
    assert got == {(k, *m.span(), m[0][0]) for k, t in enumerate(texts) for m in re.finditer(r"!{2,}|\?{2,}|\.{4,}", t or "")}


# Diffs


def plain_chunks(t):
    out, at = [], 0
    white = "".join(diff.SPACES)
    for m in re.finditer(rf"[^.!?]+[.!?]?(?:[{re.escape(white)}]+|\Z)", t):
        out += [t[at : m.start()]] if m.start() > at else []
        out.append(m[0])
        at = m.end()
    return out + ([t[at:]] if at < len(t) else [])


def test_diff_by_row(spark):
    rng = random.Random(6)
    bits = ["a b", "c", ".", "! ", "? ", " ", ".x", "\n", " ", "..", "Go up. ", "go UP. "]
    made = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
    rows = [(rng.choice([1, 2, None]), made(), made()) for _ in range(300)] + [(1, "A. B.", "A."), (1, "C.", "B. C."), (None, "x", None)]
    df = spark.createDataFrame(rows, "id int, a string, b string").coalesce(1)
    got = defaultdict(list)
    for r in diff.before_after(df, "id", "a", "b").orderBy("row", "side", "pos").collect():
        got[r["row"], r["side"]].append((r["chunk"], r["kept"]))
    key = lambda c: re.sub(f"[{re.escape(diff.SPACES)}]+", " ", c).strip(diff.SPACES).lower()
    for row, (_, a, b) in enumerate(rows):
        for side, own, other in (("before", a, b), ("after", b, a)):
            left = Counter(map(key, plain_chunks(other or "")))
            want = []
            for c in plain_chunks(own or ""):
                k = key(c)
                want.append((c, not k or left[k] > 0))
                left[k] -= 1
            assert got[row, side] == want, (own, other)


def test_diff_counts(spark, data):
    """Counts of chunks and of those not kept are those of before_after, and sentence_diff shuffles only its sums."""
    pick = random.Random(9)
    say = lambda n: "".join(pick.choice(("Go up.", "go  UP. ", "Stop! ", " ", "\u3000", "x.y", "\n\n", "é?", "")) for _ in range(n))
    rows = [(pick.choice((1, 2, None)), t, pick.choice((t, say(6), None))) for t in (say(pick.randint(0, 9)) for _ in range(400))] + [(7, None, None), (7, None, "a. b"), (7, "a. b", None)]
    df = spark.createDataFrame(rows, "id int, b string, a string")
    want = diff.before_after(df, "id", "b", "a").groupBy("id", "side").agg(F.count("*").alias("chunks"), F.count_if(~F.col("kept")).alias("flagged"))
    got = diff.counts(df, "id", "b", "a").groupBy("id", "side").agg(F.sum("chunks").alias("chunks"), F.sum("flagged").alias("flagged"))
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    plan = queries.sentence_diff(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


def test_chunks_of_long_runs(spark):
    texts = ["x" * 300_000 + ".y", "ab." * 100_000, ("w" * 50 + " ") * 5000 + ".z", "!" * 200_000]
    began = time.time()
    for t, r in zip(texts, spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(diff.chunks(F.col("t")).alias("c")).collect(), strict=True):
        assert "".join(r["c"]) == t
    assert time.time() - began < 30


# Reports


def test_most_saving_and_sets(spark):
    rows = [("hot" if k % 3 else f"s{k % 5}", k if k % 11 else None, k % 7) for k in range(600)] + [(None, 1, 5)]
    df = spark.createDataFrame(rows, "source string, doc_id int, saved int").repartition(5)
    got = sorted((tuple(r) for r in reports.most_saving(df, "source", F.col("saved"), "doc_id", 4).select("source", "rank", "doc_id", "saved").collect()), key=repr)
    want = []
    for s in {r[0] for r in rows}:
        best = sorted((r for r in rows if r[0] == s), key=lambda r: (-r[2], r[1] is None, r[1] or 0))[:4]
        want += [(s, n, d, v) for n, (_, d, v) in enumerate(best, 1)]
    assert got == sorted(want, key=repr)
    assert "WindowGroupLimit" in reports.most_saving(df, "source", F.col("saved"), "doc_id", 4)._jdf.queryExecution().executedPlan().toString()
    sums = reports.savings_sets(df.where("source IS NOT NULL"), [["source"], []], "source").collect()
    assert {(r["source"], r["level"]): (r["n"], r["saved"]) for r in sums}[None, 1] == (600, sum(r[2] for r in rows[:-1]))


def test_sketches_against_exact_ranks(spark):
    rng = random.Random(12)
    rows = [(f"s{k % 3}", f"l{k % 4}", rng.gauss(0, 5) if k % 3 else rng.random(), f"item {rng.randrange(4000)}") for k in range(24_000)]
    df = spark.createDataFrame(rows, "source string, lang string, rate double, item string").repartition(6)
    merged = reports.merged_sketches(reports.rate_sketches(df, "source", "lang"), "source")
    got = merged.select("source", "n", *(F.kll_sketch_get_quantile_double("rates", F.lit(q)).alias(f"q{int(q * 100)}") for q in (0.1, 0.5, 0.9)), F.hll_sketch_estimate("items").alias("d")).collect()
    for r in got:
        own = sorted(x[2] for x in rows if x[0] == r["source"])
        assert r["n"] == len(own)
        for q in (10, 50, 90):
            assert abs(sum(x <= r[f"q{q}"] for x in own) / len(own) - q / 100) < 0.02
        exact = len({x[3] for x in rows if x[0] == r["source"]})
        assert abs(r["d"] - exact) < 0.04 * exact


def test_versions_as_multisets(spark):
    a = spark.createDataFrame([("x",)] * 3 + [("y",), (None,), (None,)], "sentence string")
    b = spark.createDataFrame([("x",), ("z",), (None,)], "sentence string")
    assert Counter(r[0] for r in reports.only_before(a, b).collect()) == {"x": 2, "y": 1, None: 1}
    assert Counter(r[0] for r in reports.in_both(a, b).collect()) == {"x": 1, None: 1}


# Documents that fit no row


def _rule(spark, texts, rule_id, params):
    stage = Stage(spark.createDataFrame(list(enumerate(texts)), "k int, t string"))
    out, _ = BY_ID[rule_id].apply(stage, F.col("t"), Params(params))
    return {r["k"]: r["o"] for r in stage.df.select("k", out.alias("o")).collect()}


def test_long_documents_against_the_rules(spark):
    """Cut into parts and put together again, a text gives what the rule gives on the whole of it."""
    rng = random.Random(17)
    bits = ["Go up.", "go  UP!", "Use bullet points.", "Answer as a list.", "Respond in JSON.", "One more thing?", "Stop.", "Use a table."]
    documents = {d: [" ".join(rng.choice(bits) for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 30))] for d in ("a", "b", None)}
    parts = spark.createDataFrame([(d, k, t, "x") for d, ts in documents.items() for k, t in enumerate(ts)] + [("e", 0, None, "x")], "d string, n int, t string, at string").repartition(5)
    rows = longdocs.sentence_rows(parts, "d", "n", "t")
    names = list(documents)
    for kept, rule, params in (
        (longdocs.distinct_sentences(rows), "duplicateSentenceRemover", {}),
        (longdocs.distinct_sentences(rows, False, False), "duplicateSentenceRemover", {"keepFirst": False, "caseInsensitive": False}),
        (longdocs.first_of_kinds(rows, v.OUTPUT_FORMATS, v.FORMAT_WORDS), "outputFormatDeduplicator", {}),
    ):
        want = _rule(spark, [" ".join(documents[d]) for d in names], rule, params)
        for chars in (1, 50, 10**6):
            got = defaultdict(list)
            for r in longdocs.blocks(kept, chars).orderBy("block").collect():
                got[r["doc"]].append(r["text"])
            assert {d: re.sub(r"\s+", " ", " ".join(ts)) for d, ts in got.items()} == {d: re.sub(r"\s+", " ", want[k]) for k, d in enumerate(names)}


def test_a_document_of_many_sentences(spark):
    """One sentence over and over, in one document: no task gathers it, blocks stay small, order stays."""
    n = 300_000
    parts = spark.range(n // 100).select(F.lit(1).alias("d"), F.col("id").alias("n"), F.concat(F.repeat(F.lit("Same again. "), 99), F.concat(F.lit("Own "), F.col("id").cast("string"), F.lit("."))).alias("t"))
    rows = longdocs.sentence_rows(parts, "d", "n", "t")
    kept = longdocs.distinct_sentences(rows)
    assert longdocs.lost(rows, kept).first()[1:] == (n, n // 100 + 1)
    found = longdocs.blocks(kept, 5000).orderBy("block").collect()
    assert max(len(r["text"]) for r in found) < 5100
    assert " ".join(r["text"] for r in found) == "Same again. " + " ".join(f"Own {k}." for k in range(n // 100))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Window" not in plan


# Streams


def test_sessions_and_first_seen_replayed(spark, data, tmp_path):
    """A table replayed file by file, with a restart in the middle, gives what the whole table gives."""
    events = spark.read.parquet(f"{data}/events.parquet").where("user_id < 12").withColumn("ts", F.col("ts").cast("timestamp"))
    far = events.agg(F.max("ts")).first()[0]
    later = events.limit(1).select("event_id", F.lit(far).alias("ts"), "user_id", "event_type", "value", "props").withColumn("ts", F.expr("ts + interval 30 days").cast(events.schema["ts"].dataType))
    parts = sorted(events.collect(), key=lambda r: r["ts"])
    for k in range(3):
        spark.createDataFrame(parts[k * len(parts) // 3 : (k + 1) * len(parts) // 3], events.schema).coalesce(1).write.parquet(f"{tmp_path}/files/{k}")
    later.coalesce(1).write.parquet(f"{tmp_path}/files/3")

    def run(name, make, upto):
        """The first files, then stop; a new query goes on from the checkpoint."""
        import shutil

        (tmp_path / "in").mkdir(exist_ok=True)
        for k in upto:
            for f in (tmp_path / "files" / str(k)).glob("part-*"):
                shutil.copy(f, tmp_path / "in" / f"{k}-{f.name}")
            stream = make(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
            stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{tmp_path}/c-{name}").trigger(availableNow=True).start(f"{tmp_path}/out-{name}").awaitTermination(180)
        return spark.read.parquet(f"{tmp_path}/out-{name}")

    whole = sessions(events, "ts", "user_id", "value", "2 hours", late=None)
    shown = lambda df: {(r["user_id"], r["session"]["start"], r["session"]["end"], r["n"], r["total"]) for r in df.collect()}
    got = shown(run("sessions", lambda s: sessions(s, "ts", "user_id", "value", "2 hours", late="0 seconds"), range(4)))
    assert shown(whole) <= got | shown(sessions(later, "ts", "user_id", "value", "2 hours", late=None)) and len(got) >= whole.count()
    for k in range(3):  # every file again: its rows are copies
        spark.createDataFrame(parts[k * len(parts) // 3 : (k + 1) * len(parts) // 3], events.schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/files/{4 + k}")
    seen = run("first", lambda s: first_seen(s, "ts", "event_id", late="4000 days"), range(7))
    assert sorted(r[0] for r in seen.select("event_id").collect()) == sorted(r["event_id"] for r in parts)


def test_answers_to_requests(spark):
    rows = [(1, " coding", "low", None), (2, None, "low", "ai"), (3, "DEBUG", "loud", "template"), (4, "Debug", "HIGH", "Web "), (None, "write", None, None), (6, "compare", "medium", "AI"), (1, "coding ", "Low", "template")]
    got = [tuple(r) for r in templates.answers(spark.createDataFrame(rows, "k int, t string, v string, s string").coalesce(1), "k", "t", "v", "s").collect()]
    by = {(r[0], r[1]): r for r in got}
    assert len(got) == len(rows) and by[1, "CODING"][4] is None and by[1, "CODING"][5]
    assert by[2, ""][4].startswith("task type ''") and by[3, "DEBUG"][4].startswith("verbosity 'LOUD'") and by[4, "DEBUG"][4].startswith("source 'web'") and by[None, "WRITE"][4].startswith("task type 'WRITE'")
    assert by[6, "COMPARE"][4:] == (None, None)
    assert len({r[5] for r in got if r[0] == 1}) == 1


def test_texts_are_searched_once_for_all_that_counts_them(spark, data):
    """What comes back is read from a table: no plan holds the search for pieces, let alone several times."""
    from inkwell import corpus
    from inkwell.functions import protect

    for name in ("protected_audit", "source_formats", "source_sentences"):
        df = corpus.QUERIES[name](spark, data)
        assert protect.PIECES not in df._jdf.queryExecution().optimizedPlan().toString(), name
        assert df.count() > 0, name
