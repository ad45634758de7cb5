"""The pipeline on planted documents: each stage's decisions, and the whole run."""

import random

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from inkwell.llm.common import materialize

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def planted(spark, path):
    rng = random.Random(1)
    words = ["the", "and", "house", "water", "stone", "light", "wind", "paper", "tree", "with", "river", "cloud", "meadow", "iron", "glass"]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(n))
    item = prose(30)
    rows = [(k, prose(60), "en", f"s{k % 3}") for k in range(60)]
    base = rows[5][1].split()
    base[30] = "changed"
    rows += [(100, rows[5][1], "en", "s0"), (101, " ".join(base), "en", "s1"), (102, f"{prose(20)} {item} {prose(20)}", "en", "s2")]
    rows += [(103, "??? 123", "en", "s0"), (104, None, None, None), (105, f"{prose(30)} password = hunter22 {prose(10)}", "en", "s0"), (106, rows[7][1], "en", "s1"), (106, rows[7][1], "en", "s1")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)
    df.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_stages(spark, tmp_path):
    planted(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, str(tmp_path)), name)
        seen[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
    clean = set(range(60))
    assert set(seen["language"]) == clean | {100, 101, 102, 105, 106}
    kept = seen["near_copies"]
    assert len(kept) == len(set(kept)) and len({5, 100, 101} & set(kept)) == 1 and len({7, 106} & set(kept)) == 1
    assert set(kept) >= clean - {5, 7} | {102, 105}
    assert set(seen["leaks"]) == set(kept) - {102}
    assert sorted(seen["credentials"]) == sorted(seen["leaks"])
    assert set(seen["mixture"]) <= set(seen["credentials"])
    assert docs.where("copies < 1 or copies > 3").count() == 0 and {"copies", "target", "size"} <= set(docs.columns)
    assert docs.where(F.col("text").contains("hunter22")).count() == 0
    assert docs.where("n_chars <> length(text)").count() == 0


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_against_plain(spark, monkeypatch):
    """One row of each group that plain sets give, whatever the sizes of tiles and blocks; clashing names, null and equal ids."""
    from test_operators import near_rows, plain_groups

    from inkwell.llm import jaccard

    for name, value in (("TILE", 3), ("BLOCK", 4), ("POINTS", 5)):
        monkeypatch.setattr(jaccard, name, value)
    rows = [(k, t) for k, t in near_rows() if t is None or len(t) < 9000]
    wide = "doc_id long, text string, lang string, key string, _key string, apart string"
    full = [(None if i % 7 == 0 else k, t, "en", "x", "y", "z") for i, (k, t) in enumerate(rows)]
    df = spark.createDataFrame(full, wide)
    got = pipeline.near_copies(spark, df, "").collect()
    assert got and list(got[0].asDict()) == df.columns
    place = {t: k for k, (_, t) in enumerate(rows)}
    groups = {}
    for (k, _, c), n in plain_groups([(place[t], t) for _, t in rows], pipeline.SHINGLE_WORDS, *pipeline.SIMILARITY).items():
        groups[k] = c
    blank = [t for _, t in rows if not (t or "").split()]
    kept = [r["text"] for r in got]
    words = [t for t in kept if (t or "").split()]
    assert len(kept) - len(words) == len(blank)
    assert len(words) == len({groups[place[t]] for t in words}) == len({c for k, c in groups.items() if (rows[k][1] or "").split()})


def test_other_stages_against_plain(spark, tmp_path):
    """Leaks by plain alignment, masks by plain search, on rows with nulls and clashing names."""
    import re

    from test_operators import plain_best

    planted(spark, tmp_path)
    (item,) = (r["text"].split() for r in spark.read.parquet(f"{tmp_path}/benchmark.parquet").collect())
    df = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("key", F.lit("k")).withColumn("copies", F.lit("c"))
    rows = df.collect()
    best = {r["text"]: plain_best(item, (r["text"] or "").split()) for r in rows}
    leak = {t for t, (s, e) in best.items() if s >= len(item) or (e >= 13 and 4 * (2 * e - s) <= e)}
    assert sorted(str(r["text"]) for r in pipeline.leaks(spark, df, str(tmp_path)).collect()) == sorted(str(r["text"]) for r in rows if r["text"] not in leak) and leak
    mask = lambda t: t and re.sub(r"password = [A-Za-z0-9]{6,}", "[assign]", t)
    masked = pipeline.credentials(spark, df, str(tmp_path)).collect()
    assert sorted(str((r["doc_id"], r["text"], r["key"])) for r in masked) == sorted(str((r["doc_id"], mask(r["text"]), "k")) for r in rows)
    mixed = pipeline.mixture(spark, df, str(tmp_path))
    assert mixed.columns.count("copies") == 1 and "key" in mixed.columns and mixed.count() > 0
