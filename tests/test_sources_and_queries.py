"""Templates, files, streams, token counters, and all registered queries of the rules against DuckDB."""

import sys
from pathlib import Path

import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from inkwell import corpus, marked, queries
from inkwell.functions import tokens
from inkwell.plans.pipeline import optimize
from inkwell.sources import io, templates
from inkwell.streaming import optimize_stream, read_stream, savings_by_window, write_stream


def test_templates(spark):
    assert templates.templates(spark).count() == 45
    a, b = (templates.pick(spark, " coding", "low", seed=5).collect() for _ in range(2))
    assert a == b and a[0]["task_type"] == "CODING"
    with pytest.raises(ValueError):
        templates.pick(spark, "cooking", "low")
    assert templates.pick(spark, "debug", "high", source="ai", generate=lambda t, v: f"{t}/{v}").first()["prompt"] == "DEBUG/HIGH"
    assert templates.pick(spark, "debug", "high", source="ai", generate=lambda t, v: 1 / 0).first()["prompt"].startswith("AI generation failed")
    assert templates.assign(spark.range(100), "id").count() == 100


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "t string, n int")
    for fmt in ("parquet", "json", "orc"):
        io.write(df, f"{tmp_path}/{fmt}", fmt)
        assert io.read(spark, f"{tmp_path}/{fmt}", fmt).select("t").first()[0] == "a"
    with pytest.raises(ValueError):
        io.read(spark, str(tmp_path), "xml")
    (tmp_path / "r.json").write_text('{"prompt": "Hi", "rules": {"lengthControl": {"enabled": true, "params": {"maxWords": "3"}}}}\n')
    assert io.requests(spark, str(tmp_path / "r.json")).first()["rules"]["lengthControl"]["params"]["maxWords"] == "3"


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("Wait!!", "2024-01-01 00:03:00"), ("a b c", "2024-01-01 00:12:00")], "text string, ts string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = optimize_stream(read_stream(spark, f"{tmp_path}/in", rows.schema), {"punctuationNormalizer": True})
    write_stream(stream.select("final_prompt"), f"{tmp_path}/out", f"{tmp_path}/c1").awaitTermination(120)
    assert {r[0] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"Wait!", "a b c"}
    sums = savings_by_window(optimize(rows, {"lengthControl": {"enabled": True, "params": {"maxWords": 1}}}), "ts").orderBy("window.start").collect()
    assert [(r["n"], r["saved"]) for r in sums] == [(1, 0), (1, 2)]


def test_bpe(spark):
    public = pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([("Hello world!",), (" ",), (None,)], "t string")
    got = [r[0] for r in df.select(tokens.bpe(public.path("byte_bpe_50k.tiktoken"))(F.col("t"))).collect()]
    assert got == [3, 0, 0]


FAST = [q for q in queries.QUERIES if q in queries.ORACLES]


@pytest.mark.parametrize("name", FAST)
def test_query(spark, data, duck, name):
    df = queries.QUERIES[name](spark, data)
    same_rows(df, duck.sql(queries.ORACLES[name]))


@pytest.mark.parametrize("name", list(corpus.ORACLES))
def test_corpus_query(spark, data, duck, name):
    df = corpus.QUERIES[name](spark, data)
    same_rows(df, duck.sql(corpus.ORACLES[name]))


@pytest.mark.parametrize("name", list(marked.ORACLES))
def test_marked_query(spark, data, duck, name):
    df = marked.QUERIES[name](spark, data)
    same_rows(df, duck.sql(marked.ORACLES[name]))


#: Rules that must change some prompts, so that comparing them says something.
def test_rules_fire(spark, data):
    base = {r["doc_id"]: r["t"] for r in queries.prompts(spark, data).collect()}
    for name in FAST:
        if name.startswith("rule_") and name not in ("rule_task", "rule_conflicts", "rule_numbers"):
            got = queries.QUERIES[name](spark, data).collect()
            assert any(r["out"] != base[r["doc_id"]] for r in got), name


QUOTED = (
    'Look!! token = "go go!! in order to" and go go!!',
    "He said 'wait wait!! then' and wait wait!!",
    'Open "go go!! and never closed',
    'Plain plain!! and `"x x!!` code',
    'Both "it\'s it\'s `a!!` so" done!! Yes yes. "Yes." "Yes."',
    None,
)


def test_whole_texts(spark, tmp_path):
    """Queries over texts with quotes, held against the plain scanner."""
    import re

    from test_rules import _quotes

    rows = [(9 * 7 * (k + 1), t, "en", "web", len(t or "")) for k, t in enumerate(QUOTED)]  # ids without phrases around
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = lambda name, column: {r["doc_id"]: r[column] for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}

    def outside(t, change):
        flags = _quotes(t)
        cuts = [0, *(i for i in range(1, len(t)) if flags[i] != flags[i - 1]), len(t)]
        return "".join(t[a:b] if flags[a] else change(t[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if a < b)

    texts = {k: t or "" for k, t, *_ in rows}
    assert got("whole_rule_punctuation", "out") == {k: outside(t, lambda x: re.sub("!{2,}", "!", x)) for k, t in texts.items()}
    shown = {k: "Run `a.b` and `` then:\n```py\nx = 1\n``` " + t + " `end" for k, t in texts.items()}
    assert got("whole_protected_pieces", "protected_chars") == {k: sum(_quotes(t)) for k, t in shown.items()}
    assert got("whole_sentences", "sentences")[63].count('"') == 2
    reduced = got("rule_duplicate_phrases", "out")
    assert [reduced[k] for k in (63, 126)] == ['Look!! token = "go go!! in order to" and go!!', "He said 'wait wait!! then' and wait!!"]
    assert '"go go!! in order to"' in got("all_rules", "final_prompt")[63]
    assert queries.sentence_diff(spark, str(tmp_path)).where("doc_id = 315 and side = 'before'").first()["flagged"] == 0


def test_number_rule_converts_texts(spark, tmp_path):
    """The rule itself meets the number words of the text: quoted ones stay, a row of them is one number."""
    rows = [(63 * 5, 'Take one "one" and twenty one now', "en", "web", 33)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.QUERIES["whole_rule_numbers"](spark, str(tmp_path)).first()["out"] == 'Take 1 "one" and 21 now | 367 pages'


def test_all_turns_go_through_the_rules(spark, tmp_path):
    rows = [(1, 0, "system", "Wait!!"), (1, 1, "user", "Wait!!"), (1, 2, "assistant", "Wait!!"), (1, 3, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r["turn"], r["role"], r["final_prompt"]) for r in queries.QUERIES["all_rules_conversations"](spark, str(tmp_path)).collect()}
    assert {(a, b) for a, b, _ in got} == {(a, b) for _, a, b, _ in rows} and {c for _, b, c in got if b} == {"Wait!"}


def test_whole_query_for_each_that_takes_out_quotes():
    cut = {k for k, sql in queries.ORACLES.items() if "FROM prompts" in sql} | {"protected_pieces"}
    assert cut == set(queries.UNQUOTED)
    assert not any(f"whole_{k}" in queries.ORACLES for k in cut)


def test_entry(spark, data):
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
