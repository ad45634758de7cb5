"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters are hashed to a fixed number of features. Document frequencies count all labelled
texts to learn from. The weights are fitted by follow-the-regularised-leader with L1 and L2 penalties on a bounded
sample of them, and a temperature, fitted on a part of the sample that the weights never saw, calibrates the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, crc_bucket, map_rows, reachable

UNKNOWN = "und"
#: Hashed features (a power of two), and rows at most that the weights are fitted on.
FEATURES = 1 << 14
SAMPLE = 1600
_K = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter; built once for each worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def ngrams(text: str | None, features: int = FEATURES) -> np.ndarray | None:
    """How often each feature occurs in the whole text, or None if it has no letter. Case is folded; runs of other characters are one space."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
    known = letters()[points]
    if not known.any():
        return None
    x = np.where(known, points, 32).astype(np.uint64)
    x = x[np.r_[True, (x[1:] != 32) | (x[:-1] != 32)]]
    x = np.r_[np.uint64(32), x, np.uint64(32)]
    shift = np.uint64(64 - (features.bit_length() - 1))
    a = x * _K[0]
    b = (a[:-1] ^ (a[:-1] >> np.uint64(29))) * _K[1] + x[1:]
    c = (b[:-1] ^ (b[:-1] >> np.uint64(31))) * _K[2] + x[2:]
    hashed = np.concatenate([(a * _K[1]) >> shift, (b * _K[0]) >> shift, (c * _K[1]) >> shift])
    return np.bincount(hashed.astype(np.int64), minlength=features)


@dataclass
class Model:
    """langs by column of weights; idf; temperature."""

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes and TF-IDF values of length 1."""
        at = np.flatnonzero(found)
        x = np.log1p(found[at]) * self.idf[at]
        return at, x / max(np.sqrt((x * x).sum()), 1e-12)

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        found = ngrams(text, len(self.idf))
        if found is None or not self.langs:
            return UNKNOWN, 0.0
        p = softmax(self.logits(*self.vector(found)) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, features: int, classes: int, alpha: float = 4.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.001, epochs: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by FTRL-proximal, a step for each row; l1 keeps weights at zero until their gradients add up."""
    z, n = np.zeros((features + 1, classes)), np.zeros((features + 1, classes))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zs, ns = z[at], n[at]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = np.r_[rows[i][0], features], np.r_[rows[i][1], 0.1]
            w = weights(at)
            p = softmax(x @ w)
            p[labels[i]] -= 1.0
            g = x[:, None] * p[None, :]
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    w = weights(slice(None))
    return w[:features], w[features] * 0.1


def temper(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.mean(np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-12)))
    low, high, r = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - r * (high - low), low + r * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(df: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", features: int = FEATURES, sample: int = SAMPLE) -> Model:
    """A model from the rows where learn holds and text and lang are given.

    One pass counts languages and, over all those rows, documents of each feature: partitions send up one number a
    feature. A second reads the sample: rows whose id hashes below a bound that is set for each language, so that
    languages are even, at most `sample` rows in all. Features, classes and sample bound what reaches the driver. A
    language is learned from a row at least, so at most `sample` languages can be, the most frequent ones: raise it for
    more. Weights take features x languages x 8 bytes in each task.
    """
    reachable(df.sparkSession)
    known = columns(df.where(learn), doc_id=id_col, text=text_col, lang=lang_col).where("text is not null and lang is not null and doc_id is not null")

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(features, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found = ngrams(text, features)
                if found is not None:
                    total += found > 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"feature": pa.array(at, pa.int32()), "docs": pa.array(total[at], pa.int64())})

    docs = np.zeros(features)
    for r in known.select("text").mapInArrow(count, "feature int, docs long").groupBy("feature").agg(F.sum("docs").alias("docs")).collect():
        docs[r["feature"]] = r["docs"]
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()}
    langs = sorted(sizes)
    idf = np.log((1.0 + sum(sizes.values())) / (1.0 + docs)) + 0.1
    model = Model(langs, idf, np.zeros((features, len(langs))), np.zeros(len(langs)))
    if not langs:
        return model
    quota = max(1, sample // len(langs))
    spot = F.crc32(F.concat(F.lit("sample:"), F.col("doc_id").cast("string"))) / F.lit(4294967296.0)
    bound = F.element_at(F.create_map(*(F.lit(x) for lang in langs for x in (lang, min(1.0, quota / sizes[lang])))), F.col("lang"))
    chosen = known.where(F.col("lang").isin(langs)).withColumn("spot", spot).withColumn("bound", bound).where("spot < bound")

    def extract(rows: dict) -> dict:
        found = [ngrams(t, features) for t in rows["text"]]
        ats = [np.flatnonzero(f) if f is not None else np.empty(0, np.int64) for f in found]
        return {
            "lang": rows["lang"],
            "spot": [s / b for s, b in zip(rows["spot"], rows["bound"], strict=True)],
            "at": [a.astype(np.int32) for a in ats],
            "n": [f[a].astype(np.int32) if f is not None else a.astype(np.int32) for f, a in zip(found, ats, strict=True)],
        }

    rows = map_rows(chosen.select("text", "lang", "spot", "bound"), extract, "lang string, spot double, at array<int>, n array<int>").orderBy("spot", "lang").limit(sample).collect()
    vectors, labels = [], []
    for r in rows:
        if len(r["at"]):
            at = np.array(r["at"])
            x = np.log1p(np.array(r["n"])) * idf[at]
            vectors.append((at, x / max(np.sqrt((x * x).sum()), 1e-12)))
            labels.append(langs.index(r["lang"]))
    labels = np.array(labels, dtype=int)
    # Every fifth row is for the temperature alone.
    aside = np.arange(len(labels)) % 5 == 4
    model.weights, model.bias = ftrl([v for v, a in zip(vectors, aside, strict=True) if not a], labels[~aside], features, len(langs))
    logits = np.array([model.logits(*v) for v, a in zip(vectors, aside, strict=True) if a]).reshape(-1, len(langs))
    model.temperature = temper(logits, labels[aside])
    return model


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for each row of df, from the text alone. Narrow: no shuffle.

    Null texts and texts without a letter are "und" with score 0, as is everything if nothing was learned.
    """

    def batch(rows: dict) -> dict:
        found = [model.predict(t) for t in rows["text"]]
        return {"doc_id": rows["doc_id"], "lang_pred": [x for x, _ in found], "score": [p for _, p in found]}

    return map_rows(columns(df, doc_id=id_col, text=text_col), batch, "doc_id long, lang_pred string, score double")


def learnable(id_col: str = "doc_id") -> Column:
    """Rows that may be learned from: all but the held-out quarter. Rows without an id are not."""
    return F.coalesce(crc_bucket(F.col(f"`{id_col}`"), 4) != 2, F.lit(False))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score: learn from df's labelled rows that aren't held out, predict all rows.

    Repeated rows are predicted each; null ids are neither held out nor learned from; an empty table gives no rows.
    """
    found = predict(df, fit(df, learnable(id_col), id_col, text_col, lang_col), id_col, text_col)
    held = F.coalesce(crc_bucket(F.col("doc_id"), 4) == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def accept(df: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of df whose text has a letter and a language more likely than not (score at least `least`); all columns as they are.

    A model that learned no language rejects only texts without a letter.
    """
    names, struct = df.columns, df.schema
    reachable(df.sparkSession)
    at = names.index(text_col)

    def keep(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            mask = []
            for text in batch.column(at).to_pylist():
                lang, score = model.predict(text)
                mask.append((lang != UNKNOWN and score >= least) or (not model.langs and ngrams(text) is not None))
            yield batch.filter(pa.array(mask, pa.bool_()))

    return df.mapInArrow(keep, struct)
