"""Toxic spans by a linear-chain conditional random field over words, and document scores from its marginals.

Labels mark documents, so words are labelled first: in a bounded sample of labelled rows, a word or a beginning of
words counts as offending if it stands in toxic documents far more often than in others; words are labelled where they
stand in a toxic one. The
field, with features of each word and weights for the steps between labels, is fitted to these words; forward and
backward passes give each word's marginal probability, and these make the score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, crc_bucket, map_rows

#: Labelled rows of each class at most, from which offending parts of words are learned, and first texts of each class for the field, which
#: also learns from as many further toxic ones as it takes to hold every offending part.
SAMPLE = 1500
FIELD_TEXTS = 300
#: Hashed features, and how many a word has. Beginnings of words by number of characters.
SLOTS = 1 << 16
BEGINNINGS = (3, 4, 5, 6, 7)
FEATURES = 2 + len(BEGINNINGS)
#: Bytes of text whose words are held at once (one text is never cut); about 600,000 words.
HELD_BYTES = 4 << 20
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
_EDGES = re.compile(rb"^[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+|[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+$")


def normal(word: bytes) -> bytes:
    """Lower case, without signs at the ends."""
    return _EDGES.sub(b"", word.decode("utf-8", "replace").lower().encode())


def parts(word: bytes) -> list[bytes]:
    """What a normal word offers to learn from: itself and its beginnings, as inflected words share theirs."""
    text = word.decode("utf-8", "replace")
    return [b"w" + word, *(b"p" + text[:k].encode() for k in BEGINNINGS if len(text) > k)]


def slots(word: bytes) -> list[int]:
    """Hashed features of a normal word, FEATURES of them: its parts and its last three characters; the word again for missing parts."""
    import xxhash

    found = [*parts(word), b"s" + word.decode("utf-8", "replace")[-3:].encode()]
    return [xxhash.xxh3_64_intdigest(p) % SLOTS for p in found + [found[0]] * (FEATURES - len(found))]


@dataclass
class Field:
    """Binary linear-chain field: weights of a word's features for label 1, and of the steps between labels.

    steps[y, z] is added where label z follows y. The score of label 0 is 0.
    """

    weights: np.ndarray
    steps: np.ndarray
    bias: float
    #: Document score: logistic regression on what ``aggregate`` makes of the marginals; the last is the constant.
    document: np.ndarray = field(default_factory=lambda: np.array([1.0, 1.0, -1.0]))
    _emission: dict[bytes, float] = field(default_factory=dict)

    def emission(self, word: bytes) -> float:
        if (e := self._emission.get(word)) is None:
            if len(self._emission) > 500_000:
                self._emission.clear()
            plain = normal(word)
            e = self._emission[word] = float(self.bias + self.weights[slots(plain)].sum()) if plain else -20.0
        return e

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_emission": {}}

    def marginals(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Each word's probability of label 1, for each text."""
        emissions = [np.fromiter(map(self.emission, words), float, len(words)) for words in texts]
        return [p for p, _ in run_chains(emissions, self.steps, joint=False)]

    def score(self, p: np.ndarray) -> float:
        """Of a document, from its marginals."""
        return float(1 / (1 + np.exp(-np.clip(aggregate(p) @ self.document, -30, 30))))


def aggregate(p: np.ndarray) -> np.ndarray:
    """Of a document's marginals: logarithms of the expected number of offending words and of their share, and 1.

    Marginals under a fifth don't count: over a long text they would add up to words that aren't there.
    """
    sure = float(p[p >= 0.2].sum())
    return np.array([np.log(0.1 + sure), np.log(0.002 + sure / (p.size + 20)) + 6, 1.0])


def run_chains(emissions: list[np.ndarray], steps: np.ndarray, cells: int = 400_000, joint: bool = True) -> list[tuple[np.ndarray, np.ndarray]]:
    """Marginals of label 1, and the expected counts of steps (2 x 2; zeros unless joint), for each chain.

    Chains of like length run side by side, a word at a time, forward and backward, as odds of label 1 to 0: two
    numbers a word, so long texts cost memory in proportion.
    """
    out: list = [(np.empty(0), np.zeros((2, 2)))] * len(emissions)
    order = sorted((i for i in range(len(emissions)) if emissions[i].size), key=lambda i: emissions[i].size)
    t = np.exp(steps)
    at = 0
    while at < len(order):
        some = [order[at]]
        at += 1
        while at < len(order) and len(some) < 512 and (len(some) + 1) * emissions[order[at]].size <= cells:
            some.append(order[at])
            at += 1
        lengths = np.array([emissions[i].size for i in some])
        high, n = int(lengths.max()), len(some)
        e = np.ones((high, n))
        inside = np.arange(high)[:, None] < lengths[None, :]
        for k, i in enumerate(some):
            e[: lengths[k], k] = np.exp(np.clip(emissions[i], -30, 30))
        f = np.empty((high, n))
        now = f[0] = e[0]
        for j in range(1, high):
            now = f[j] = e[j] * (t[0, 1] + t[1, 1] * now) / (t[0, 0] + t[1, 0] * now)
        b = np.ones((high, n))
        now = b[-1]
        for j in range(high - 2, -1, -1):
            x = e[j + 1] * now
            now = (t[1, 0] + t[1, 1] * x) / (t[0, 0] + t[0, 1] * x)
            now = b[j] = np.where(inside[j + 1], now, 1.0)
        odds = f * b
        p = odds / (1 + odds)
        counts = np.zeros((4, n))
        if joint:  # of the step from j - 1 to j: forward odds before, the step, emission and backward odds after
            here = e[1:] * b[1:]
            each = np.stack([np.full_like(here, t[0, 0]), t[0, 1] * here, t[1, 0] * f[:-1], t[1, 1] * f[:-1] * here])
            counts = (each * (inside[1:] / each.sum(axis=0))).sum(axis=1)
        for k, i in enumerate(some):
            out[i] = (p[: lengths[k], k].copy(), counts[:, k].reshape(2, 2))
    return out


def offending_parts(texts: list[list[bytes]], toxic: np.ndarray, lift: float = 8.0) -> set[bytes]:
    """Parts of words far more usual in toxic texts than in others, and too often there for chance.

    Chance is the Chernoff bound on a Poisson count, at one in twenty over all parts that are tried.
    """
    counts: dict[bytes, list[int]] = {}
    for words, y in zip(texts, toxic, strict=True):
        for part in {p for w in {normal(x) for x in set(words)} if w for p in parts(w)}:
            counts.setdefault(part, [0, 0])[y] += 1
    n = np.maximum(np.bincount(toxic, minlength=2), 1)
    tried = {p: (a, b) for p, (a, b) in counts.items() if b >= 3 and b / n[1] >= lift * (a + 0.5) / n[0]}
    out = set()
    for part, (a, b) in tried.items():
        chance = (a + b) / n.sum() * n[1]
        if b * np.log(b / chance) - (b - chance) >= np.log(20 * len(tried)):
            out.add(part)
    return out


def fit_field(texts: list[list[bytes]], labels: list[np.ndarray], rounds: int = 30, rate: float = 1.0, l2: float = 1e-3) -> Field:
    """Maximum likelihood with a ridge, by AdaGrad on the whole gradient: observed less expected counts."""
    model = Field(np.zeros(SLOTS), np.array([[0.0, -1.0], [-1.0, -1.0]]), -3.0)
    ids: dict[bytes, list[int]] = {}
    feats = [np.array([ids.get(w) or ids.setdefault(w, slots(normal(w))) for w in words]).reshape(-1, FEATURES) for words in texts]
    seen = np.zeros((2, 2))
    for y in labels:
        np.add.at(seen, (y[:-1], y[1:]), 1)
    flat, cuts = np.concatenate([*feats, np.empty((0, FEATURES), int)]).astype(int), np.cumsum([len(f) for f in feats])[:-1]
    truth = np.concatenate([*labels, np.empty(0, int)])
    gw, gs, gb = np.full(SLOTS, 1e-8), np.full((2, 2), 1e-8), 1e-8
    for _ in range(rounds):
        found = run_chains(np.split(model.bias + model.weights[flat].sum(axis=1), cuts), model.steps)
        gap = truth - np.concatenate([*(p for p, _ in found), np.empty(0)])
        dw = np.bincount(flat.ravel(), np.repeat(gap, FEATURES), SLOTS) - l2 * model.weights
        ds = seen - sum(x for _, x in found)
        ds[0, 0] = 0.0  # fixed, as only differences count
        db = gap.sum()
        gw, gs, gb = gw + dw * dw, gs + ds * ds, gb + db * db
        model.weights += rate * dw / np.sqrt(gw)
        model.steps += 0.3 * rate * ds / np.sqrt(gs)
        model.bias += 0.3 * rate * db / np.sqrt(gb)
    return model


def calibrate(model: Field, marginals: list[np.ndarray], toxic: np.ndarray, prior: float) -> None:
    """Fit the document score by logistic regression, classes weighted to their share of all labels."""
    x = np.stack([aggregate(p) for p in marginals])
    count = np.maximum(np.bincount(toxic, minlength=2), 1)
    w = (np.array([1 - prior, prior]) / count * len(toxic))[toxic]
    ridge = np.array([0.3, 0.3, 0.01])
    beta = np.zeros(3)
    for _ in range(50):  # Newton
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (w * (p - toxic)) + ridge * beta
        h = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        beta -= np.clip(np.linalg.solve(h, g), -2, 2)
    model.document = beta


def field_rows(texts: list[list[bytes]], toxic: np.ndarray, y: int, offending: set[bytes], least: int) -> list[int]:
    """Places of the class's first texts, and of each later toxic one with an offending part that is in none before."""
    out: list[int] = []
    seen: set[bytes] = set()
    for i in np.flatnonzero(toxic == y):
        new = {p for w in set(texts[i]) for p in parts(normal(w))} & offending - seen if y else set()
        if len(out) < least or new:
            out.append(int(i))
            seen |= new
    return out


def fit(df: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, field_texts: int = FIELD_TEXTS) -> Field:
    """A field from the labelled rows of df whose label row satisfies learn (an expression on doc_id).

    Ids are drawn from the labels by hash, at most `sample` of each class, so the ids broadcast to the documents and
    the texts that reach the driver are bounded by that parameter. The field is fitted to `field_texts` of each class
    and to every further toxic text that holds an offending part which those before it don't. An id that label rows
    call both toxic and not counts as toxic, once. The driver holds the sampled texts whole, so `sample` bounds rows and
    their longest texts decide the memory.
    """
    known = columns(labels, doc_id=id_col, toxic=label_col).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(learn)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    spot = F.crc32(F.concat(F.lit("sample:"), F.col("doc_id").cast("string")))
    clean, bad_ids = (known.where(F.col("toxic") == y).orderBy(spot, "doc_id").limit(sample) for y in (0, 1))
    ids = clean.unionByName(bad_ids)
    rows = columns(df, doc_id=id_col, text=text_col).where("text is not null").join(F.broadcast(ids), "doc_id").orderBy(spot, "doc_id", "text").limit(2 * sample).collect()
    texts = [_WORD.findall(r["text"].encode()) for r in rows]
    toxic = np.array([int(r["toxic"]) for r in rows], dtype=int)
    total = sum(sizes.values())
    prior = sizes.get(1, 0) / total if total else 0.0
    if len(set(toxic.tolist())) < 2:  # nothing to tell apart
        return Field(np.zeros(SLOTS), np.zeros((2, 2)), -20.0, np.array([0.0, 0.0, 3.0 if prior == 1 else -3.0]))
    offending = offending_parts(texts, toxic)
    bad = {w: not offending.isdisjoint(parts(normal(w))) for words, y in zip(texts, toxic, strict=True) if y for w in words}
    marked = [np.array([int(y and bad[w]) for w in words], dtype=int) for words, y in zip(texts, toxic, strict=True)]
    first = [int(i) for y in (1, 0) for i in field_rows(texts, toxic, y, offending, field_texts)]
    model = fit_field([texts[i] for i in first], [marked[i] for i in first])
    calibrate(model, model.marginals(texts), toxic, prior)
    return model


SCHEMA = "doc_id long, score double, predicted int, spans array<struct<start:long,end:long,p:double>>"


def tag(df: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted, spans for each row: spans are runs of words with marginals of 0.5 or more, in code points, end exclusive.

    Null and empty texts have no words: nothing offends, and the score is the least there is. Narrow: no shuffle.
    Words are held for HELD_BYTES of text at a time, however long the texts of a batch are.
    """

    def judge(texts: list[bytes], scores: list[float], spans: list[list[dict]]) -> None:
        found = model.marginals([t.split() for t in texts])
        for raw, p in zip(texts, found, strict=True):
            some: list[dict] = []
            if p.size and p.max() >= 0.5:
                last = -2
                for k, m in enumerate(_WORD.finditer(raw)):
                    if p[k] >= 0.5:
                        start = len(raw[: m.start()].decode())
                        end = start + len(m[0].decode())
                        if last == k - 1:
                            some[-1] = {"start": some[-1]["start"], "end": end, "p": max(some[-1]["p"], float(p[k]))}
                        else:
                            some.append({"start": start, "end": end, "p": float(p[k])})
                        last = k
            spans.append(some)
            scores.append(model.score(p))

    def batch(rows: dict) -> dict:
        scores: list[float] = []
        spans: list[list[dict]] = []
        some: list[bytes] = []
        size = 0
        for text in rows["text"]:
            raw = (text or "").encode()
            if some and size + len(raw) > HELD_BYTES:
                judge(some, scores, spans)
                some, size = [], 0
            some.append(raw)
            size += len(raw)
        judge(some, scores, spans)
        return {"doc_id": rows["doc_id"], "score": scores, "predicted": [int(s >= 0.5) for s in scores], "spans": spans}

    return map_rows(columns(df, doc_id=id_col, text=text_col), batch, SCHEMA)


def score_toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, spans: learn from label rows that aren't held out, score every row.

    Null ids are not held out and have no label. Without labels of both classes all rows get one low score (high if
    all labels are 1). Repeated rows are scored each. Empty tables of documents give no rows.
    """
    model = fit(df, labels, crc_bucket(F.col("doc_id"), 5) != 0, id_col, text_col)
    held = F.coalesce(crc_bucket(F.col("doc_id"), 5) == 0, F.lit(False))
    return tag(df, model, id_col, text_col).select("doc_id", held.alias("held_out"), "score", "predicted", "spans")
