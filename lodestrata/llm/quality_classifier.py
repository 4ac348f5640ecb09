"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages, only some of which show why it was marked. Every passage is described by fixed
features, encoded by a learned layer, weighted by gated attention (a tanh and a sigmoid branch) and the weighted sum
of the bag is scored by a logistic unit. Only document labels train it; the weights of passages come out of that.

The fit reads a bounded sample: `max_docs` labelled documents of `max_chars` characters at most, chosen by a hash of
their id, whose passage features (not texts) reach the driver; of rows with one id the least text trains. Scoring reads every passage of every document where the document is.

Defined results: a null or empty text is one passage without features and gets a score like any other. Null labels and
labels of unknown documents don't train; a document with several labels trains by their mean. Without any label the
score is 0.5. Repeated rows each keep a row. Labels, language, source and id are never features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import crc_mod, map_texts, short_batches

#: Characters of a passage.
PASSAGE = 400
MARKS = "!#$%&*|<>.,?:;\n\"'-_/()[]{}@=+"
HIDDEN, ATTENTION = 16, 8


def passage_features(text: str) -> np.ndarray:
    """A row of features for each passage of the whole text."""
    rows = []
    for i in range(0, max(len(text), 1), PASSAGE):
        s = text[i : i + PASSAGE]
        w = s.split()
        n, k = max(len(s), 1), max(len(w), 1)
        upper = sum(map(str.isupper, w))
        title = sum(map(str.istitle, w))
        again = sum(map(str.__eq__, w, w[1:]))
        shifted = sum(map(str.__eq__, w, w[2:]))
        ends = [x[-1] for x in w]
        odd = sum(not c.isalnum() for c in ends)
        digits = sum(map(str.isdigit, s)) if any(map(s.__contains__, "0123456789")) else 0
        rows.append((
            *(s.count(c) / n for c in MARKS), upper / k, title / k, again / k, shifted / k, len(set(w)) / k, odd / k,
            digits / n, len(w) / n, max(map(len, w), default=0) / n, min(len(s) / PASSAGE, 1.0), float(s.isascii()),
        ))
    return np.array(rows, dtype=np.float32)


class Attention:
    """The model's weights, its scores and its fit (Adam on the log loss, in bags of ragged length)."""

    def __init__(self, n_features: int, seed: int = 7):
        r = np.random.default_rng(seed)
        shape = {"W": (n_features, HIDDEN), "V": (HIDDEN, ATTENTION), "U": (HIDDEN, ATTENTION)}
        self.p = {k: r.normal(0, (2.0 / s[0]) ** 0.5, s) for k, s in shape.items()}
        self.p |= {"b": np.zeros(HIDDEN), "w": r.normal(0, 0.3, ATTENTION), "c": r.normal(0, 0.3, HIDDEN), "d": np.zeros(1)}
        self.mean, self.scale = np.zeros(n_features), np.ones(n_features)

    def forward(self, x: np.ndarray, starts: np.ndarray, bag: np.ndarray) -> tuple:
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        a = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a /= np.add.reduceat(a, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        return h, t, g, a, z, 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"][0], -30, 30)))

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if not bags:
            return np.empty(0)
        sizes = np.array([len(b) for b in bags])
        return self.forward(self.scaled(np.concatenate(bags)), np.r_[0, np.cumsum(sizes)[:-1]], np.repeat(np.arange(len(bags)), sizes))[-1]

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = 25, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 11) -> Attention:
        flat = np.concatenate(bags)
        self.mean, self.scale = flat.mean(0), flat.std(0) + 1e-3
        bags = [self.scaled(b) for b in bags]
        r, p = np.random.default_rng(seed), self.p
        m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
        for _ in range(epochs):
            order = r.permutation(len(bags))
            for lo in range(0, len(order), batch):
                pick = order[lo : lo + batch]
                sizes = np.array([len(bags[i]) for i in pick])
                x, starts, bag = np.concatenate([bags[i] for i in pick]), np.r_[0, np.cumsum(sizes)[:-1]], np.repeat(np.arange(len(pick)), sizes)
                h, t, g, a, z, s = self.forward(x, starts, bag)
                ds = (s - y[pick]) / len(pick)
                dz = ds[:, None] * p["c"]
                da = (dz[bag] * h).sum(1)
                de = a * (da - np.add.reduceat(a * da, starts)[bag])
                dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
                dh = (a[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
                grad = {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ ds, "d": np.array([ds.sum()])}
                step += 1
                for k in p:
                    q = grad[k] + decay * p[k]
                    m[k] = 0.9 * m[k] + 0.1 * q
                    v[k] = 0.999 * v[k] + 0.001 * q * q
                    p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


N_FEATURES = passage_features("").shape[1]


def fit_quality(docs: DataFrame, labels: DataFrame, max_docs: int = 8000, max_chars: int = 40_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Attention | None:
    """Fit on at most `max_docs` of the labelled documents given that have `max_chars` characters or fewer; None without any."""
    spark = docs.sparkSession
    short_batches(spark)
    marked = labels.select(id_col, F.col(label_col).cast("double").alias("y")).dropna().groupBy(id_col).agg(F.avg("y").alias("y"))
    # the choice needs ids alone, so only the chosen documents' texts move
    usable = docs.filter(F.coalesce(F.length(text_col), F.lit(0)) <= max_chars)
    chosen = usable.select(id_col).join(marked, id_col).distinct().orderBy(F.xxhash64(id_col), id_col).limit(max_docs)
    sample = usable.select(id_col, F.coalesce(text_col, F.lit("")).alias("t")).join(F.broadcast(chosen), id_col).groupBy(id_col, "y").agg(F.min("t").alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b[id_col], "y": b["y"], "x": [passage_features(t).tobytes() for t in b["t"]]})

    rows = sample.mapInPandas(run, f"id {docs.schema[id_col].dataType.simpleString()}, y double, x binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["id"], bytes(r["x"])))
    bags = [np.frombuffer(bytes(r["x"]), dtype=np.float32).reshape(-1, N_FEATURES) for r in rows]
    return Attention(N_FEATURES).fit(bags, np.array([r["y"] for r in rows]))


def score_quality(docs: DataFrame, model: Attention | None, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """score and predicted, per document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            score = model.score([passage_features(t) for t in b["t"]]) if model else np.full(len(b), 0.5)
            yield pd.DataFrame({id_col: b[id_col], "score": score, "predicted": (score >= threshold).astype("int32")})

    return map_texts(docs, run, "score double, predicted int", id_col, text_col)


def classify_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, id_col: str = "doc_id") -> DataFrame:
    """Fit without the held-out fold (checksum of the id modulo `folds` is 0), score all documents."""
    model = fit_quality(docs, labels.filter(crc_mod(id_col, folds) != 0), id_col=id_col)
    return score_quality(docs, model, id_col=id_col).select(id_col, (crc_mod(id_col, folds) == 0).alias("held_out"), "score", "predicted")
