"""Exact copies, aligned tokenizers and hard negatives against plain versions, on small and on awkward tables."""

import hashlib
import os
import random
from collections import Counter, defaultdict
from math import floor, isfinite

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from inkwell.llm import exactdedup, negatives, queries, tokenalign

DOCS = "doc_id long, text string, lang string, place long, bytes string, digest string"


def docs(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "l", 1, "b", "d") for i, t in rows], DOCS).repartition(parts)


# 11 exact copies


def plain_copies(rows):
    import re

    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for text, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        out += [(i, ids[0], len(ids), k == 0, hashlib.sha256(text.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


def copies_of(df, **more):
    return sorted((tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in exactdedup.copies(df, **more).collect()), key=repr)


@pytest.mark.parametrize("parts", [1, 4, 23])
def test_copies(spark, parts):
    rng = random.Random(parts)
    long = "same beginning " * 20
    texts = [None, "", " ", "\n\t ", "a b", "a  b", "a b", "A b", long + "x", long + "y", long, "é" * 40, "word " * 20_000]
    rows = [(rng.choice([None, *range(60)]), rng.choice(texts)) for _ in range(400)]
    rows += [(1000 + k, "hot  text" if k % 2 else "hot\ntext") for k in range(300)]  # a group over many ranges
    assert copies_of(docs(spark, rows), parts=parts) == plain_copies(rows)


def test_copies_of_few_and_no_rows(spark):
    assert copies_of(docs(spark, []), parts=5) == []
    assert copies_of(docs(spark, [(3, None)]), parts=5) == plain_copies([(3, None)])
    assert copies_of(docs(spark, [(k, "x") for k in range(50)]), parts=9) == plain_copies([(k, "x") for k in range(50)])


def test_small_batches_carry_runs(spark):
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = [(k, f"text {k // 7}") for k in range(100)] + [(200 + k, "many") for k in range(40)]
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
        assert copies_of(docs(spark, rows), parts=4) == plain_copies(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_drop_copies_keeps_columns(spark):
    rows = [(2, "a  b"), (1, "a b"), (1, "a b"), (None, None), (None, ""), (5, "c")]
    left = exactdedup.drop_copies(docs(spark, rows))
    assert left.columns == [x.split()[0] for x in DOCS.split(", ")]
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left.collect()) == [(0, ""), (1, "a b"), (5, "c")]


def test_copies_query(spark, data, duck):
    same_rows(queries.op11_exact_dedup(spark, data), duck.sql(queries.ORACLES["op11_exact_dedup"]))


# 12 aligned tokenizers

needs_vocabularies = pytest.mark.skipif(not os.path.isdir(tokenalign.FOLDER), reason="no vocabularies here")


def whole_tokens(texts):
    """Ends and ids of whole texts, straight from the libraries that the files are for."""
    import re

    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{tokenalign.FOLDER}/{tokenalign.FILES[0]}")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{tokenalign.FOLDER}/{tokenalign.FILES[1]}")
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = dict(zip(map(chr, shown), shown)) | {chr(256 + k): x for k, x in enumerate(sorted(set(range(256)) - set(shown)))}
    for text in texts:
        if not text:
            yield [], []
            continue
        whole = f" {text}".encode()
        left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(f" {text}", add_special_tokens=False).ids]
        right = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            byte = re.fullmatch(r"<0x(..)>", piece)
            right.append((i, bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()))
        ok = b"".join(x for _, x in left) == whole == b"".join(x for _, x in right)
        yield (left, right) if ok else ([], [])


def plain_alignment(rows):
    """By comparing every A token's bytes with every B token's."""
    linked, out = [], []
    for left, right in whole_tokens([t for _, t in rows]):
        spans = []
        for tokens in (left, right):
            at, own = 0, []
            for i, raw in tokens:
                own.append((i, at, at + len(raw)))
                at += len(raw)
            spans.append(own)
        a, b = spans
        cuts = sorted({x[2] for x in a} & {x[2] for x in b})
        groups = [f"{','.join(str(x[0]) for x in a if lo < x[2] <= hi)}|{','.join(str(x[0]) for x in b if lo < x[2] <= hi)}" for lo, hi in zip([0, *cuts], cuts)]
        linked.append([(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]])
        out.append([len(a), len(b), len(cuts), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""])
    count = Counter(p for ps in linked for p in ps)
    top = defaultdict(int)
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    return sorted(((i, *o[:3], len(ps), sum(count[p] == top[p[1]] for p in ps), sum(count[p] for p in ps), o[3]) for (i, _), o, ps in zip(rows, out, linked)), key=repr)


def aligned(df, **more):
    found = tokenalign.align_tokenizers(df, **more)[0]
    return sorted((tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in found.collect()), key=repr)


ODD = [None, "", " ", "  ", "\n", " lead", "trail ", "a  b   c", "a\n\n  b", "x   y", "tab\t  x", "<|endoftext|> and </s> <unk>", "▁ inside", "don't we'll", "naïve 漢字 text", "😀😀 x", "1234567 89", "\x00\x01 z", "a." * 50, "no-space" * 30, "é    w", "q? !x (y)  [z]"]


@needs_vocabularies
def test_alignment(spark, data):
    texts = [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").limit(25).collect()]
    texts = [t and t[:600] for t in texts]
    rng = random.Random(3)
    letters = "ab  \n.,'1é漢  ▁Z\t"
    rows = [(k, t) for k, t in enumerate([*ODD, *texts, *("".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(150))])]
    rows += [(None, "again"), (7, "again"), (7, "again")]
    want = plain_alignment(rows)
    assert aligned(docs(spark, rows, 2)) == want
    assert sum(r[1] > 0 for r in want) > 60 and plain_alignment([(0, "▁ inside")])[0][1] == 0


@needs_vocabularies
def test_alignment_by_small_packs_and_joins(spark):
    rng = random.Random(5)
    words = ["the", "cat", "sat", "onto", "unbelievably", "naïve", "x1y2", "."]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for k in range(60)]
    want = plain_alignment(rows)
    assert aligned(docs(spark, rows), small_pairs=0, pack_chars=100) == want
    assert aligned(docs(spark, [])) == []
    assert [r[1:] for r in aligned(docs(spark, [(1, None), (2, "")]))] == [(0, 0, 0, 0, 0, 0, "")] * 2


@needs_vocabularies
def test_packs_go_back_in_rounds(spark, monkeypatch):
    """Each round deals and groups its own packs alone, and no pack is left out."""
    rows = [(k, f"word{k % 7} and {'x' * (k % 5)} more") for k in range(40)]
    seen = []
    whole = tokenalign.documents

    def documents(packs, *more):
        seen.append({r["pack"] for r in packs.select("pack").collect()})
        return whole(packs, *more)

    monkeypatch.setattr(tokenalign, "documents", documents)
    assert aligned(docs(spark, rows, 2), pack_chars=100) == plain_alignment(rows)
    assert len(seen) == tokenalign.ROUNDS and all(seen)
    assert sum(map(len, seen)) == len(set().union(*seen)) and max(map(len, seen)) - min(map(len, seen)) <= 2


@needs_vocabularies
def test_one_pack_a_task(spark, monkeypatch):
    """However many packs there are, none shares a task with another, and each is a row group of its own."""
    rows = [(k, f"word{k % 7} and {'x' * (k % 5)} more") for k in range(120)]
    dealt, files = [], []
    whole, write = tokenalign.documents, tokenalign.materialize

    def documents(*args):
        found = whole(*args)
        dealt.extend(r["n"] for r in found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect())
        return found

    def materialize(df, name, *more):
        done = write(df, name, *more)
        if name == "packs":
            files.extend(pq.ParquetFile(f.removeprefix("file://")).metadata for f in done.inputFiles())
        return done

    monkeypatch.setattr(tokenalign, "documents", documents)
    monkeypatch.setattr(tokenalign, "materialize", materialize)
    assert aligned(docs(spark, rows, 2), pack_chars=1) == plain_alignment(rows)  # each document is a pack
    assert set(dealt) == {1}
    assert sum(f.num_rows for f in files) == sum(f.num_row_groups for f in files) == len(rows)


def test_a_pack_is_restored(monkeypatch):
    """From words and documents in any order; long documents are hashed in parts, one with a word without tokens has none."""
    monkeypatch.setattr(tokenalign, "HASHED", 2)
    words = [(k, None if k == 3 else k + 1, 1, k + 2, 1, 10 * k, f"{k}|{k}") for k in (2, 0, 3, 1, 4)]
    chunks = {7: [0, 1, 2, 4, 0, 0, 1], None: [], 5: [1, 3], 8: [2]}
    names = ("place", "n_a", "n_groups", "n_links", "n_best", "count_sum", "groups")
    rows = [{**dict(zip(names, w)), "docs": None} for w in words]
    rows.insert(2, {**dict.fromkeys(names), "docs": [{"doc_id": i, "chunks": c} for i, c in chunks.items()]})
    got = tokenalign._restored(pa.Table.from_pylist(rows), tokenalign.arrow_schema(tokenalign.ALIGNED)).to_pylist()
    for r, (i, c) in zip(got, chunks.items(), strict=True):
        c = [] if 3 in c else c
        sha = hashlib.sha256(";".join(f"{k}|{k}" for k in c).encode()).hexdigest() if c else ""
        a, links = sum(k + 1 for k in c), sum(k + 2 for k in c)
        assert list(r.values()) == [i, a, links - a + len(c), len(c), links, len(c), sum(10 * k for k in c), sha]


@needs_vocabularies
def test_texts_that_may_not_be_cut(spark, monkeypatch):
    rows = [(k, t) for k, t in enumerate(["one two  three", "one", "two  three. four"])]
    want = plain_alignment(rows)
    whole = tokenalign.Pieces.__init__
    monkeypatch.setattr(tokenalign.Pieces, "__init__", lambda self, path: (whole(self, path), setattr(self, "splits", False))[0])
    assert aligned(docs(spark, rows)) == want


# 13 hard negatives


def plain_mine(rows, positives=5, negatives_=10):
    good = [(k, i, lab, [floor(256 * float(c)) for c in v]) for k, (i, v, lab) in enumerate(rows) if lab is not None and v is not None and all(c is not None and isfinite(c) for c in v)]
    last = lambda i: (i is None, i or 0)
    out = []
    for k, i, lab, x in good:
        if i is None or i % 100:
            continue
        scored = [(sum(a * b for a, b in zip(x, y)), j, other) for n, j, other, y in good if n != k]
        first = sorted((s for s in scored if s[2] == lab), key=lambda s: (-s[0], last(s[1])))[:positives]
        for p, j, _ in first:
            inside = sorted((s for s in scored if s[2] != lab and 30 * p <= 100 * s[0] <= 90 * p), key=lambda s: (-s[0], last(s[1])))[:negatives_]
            out += [(i, j, r, s[1], p, s[0]) for r, s in enumerate(inside, 1)]
    return sorted(out, key=repr)


VECTORS = "vec_id long, embedding array<float>, label int, row long, x string, block long"


def mined(spark, rows, **more):
    df = spark.createDataFrame([(i, v, lab, 1, "x", 2) for i, v, lab in rows], VECTORS).repartition(3)
    got = negatives.mine(df, F.col("vec_id") % 100 == 0, **more)
    return sorted((tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got.collect()), key=repr)


@pytest.mark.parametrize("block", [7, 64, 5000])
def test_mine(spark, block):
    rng = np.random.default_rng(block)
    rows = [(int(k), [float(np.float32(c)) for c in rng.normal(0, 0.3, 12)], int(rng.integers(3))) for k in range(330)]
    rows += [(400, rows[0][1], 0), (500, [0.0] * 12, 1), (600, [-0.5] * 12, 2), (700, rows[3][1], None), (701, None, 1), (702, [float("nan")] * 12, 1), (703, [1.0, None], 1), (704, [float("inf")], 0)]
    rows += [(800, [0.25, 0.5], 0), (801, [0.25], 0), (802, [], 0), (None, [0.3] * 12, 0), (None, [0.3] * 12, 1), (-100, [0.4] * 12, 1)]
    rows += [(900 + k, [0.5, 0.5], k % 3) for k in range(60)]  # ties
    rows += [(2000, rows[5][1], 1)] * 3  # repeated rows, ids and all
    want = plain_mine(rows)
    assert mined(spark, rows, block_rows=block, block_anchors=3) == want
    assert len(want) > 200


def test_mine_small(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, [1.0], 0)]) == []
    assert mined(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []
    assert mined(spark, [(100, [1.0], 0), (1, [1.0], 0), (2, [0.5], 1)]) == [(100, 1, 1, 2, 65536, 32768)]


def test_planes_and_intervals():
    rng = np.random.default_rng(1)
    rows, anchors = rng.integers(-300, 300, (500, 16)), rng.integers(-300, 300, (9, 16))
    true = anchors @ rows.T
    assert (sum(w * p for w, p in negatives.bit_planes(rows)) == rows).all()
    scores = negatives.Interval(rows, anchors)
    width = None
    for _ in scores.refine():
        assert (scores.low <= true).all() and (true <= scores.high).all()
        assert width is None or (scores.high - scores.low <= width).all()
        width = scores.high - scores.low
    assert (scores.known == true).all()
    i, j, s, work = negatives.best_rows(rows, anchors, np.ones(true.shape, dtype=bool), 5)
    assert (s == true[i, j]).all() and work < rows.size * len(anchors) * len(scores.planes) * 0.8  # most rows are dropped early
    for a in range(9):
        assert sorted(s[i == a], reverse=True)[:5] == sorted(true[a], reverse=True)[:5]
    huge = np.array([[1 << 40, -(1 << 40)]])
    with pytest.raises(ValueError):
        negatives.Interval(huge, huge)


def test_mine_query(spark, data, duck):
    same_rows(queries.op13_hard_negatives(spark, data), duck.sql(queries.ORACLES["op13_hard_negatives"]))
