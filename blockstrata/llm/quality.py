"""Quality classifier: Bradley-Terry strengths learned from preference pairs.

A document's strength is a weighted sum of features of its whole text: sixteen that
describe its surface, and the shares of its three-byte sequences in HASHED hashed groups,
which learn whatever else tells good texts from bad ones. The weights come
from pairs (preferred, other) of labelled documents, by logistic loss on the
difference of the pair's features. The cut between keep and reject is a quantile of
the training strengths: the share of training rows that are marked as bad.

Defined results: null or empty text has the features of a text without words and is
scored like any other; repeated rows are scored alike, once each; without labels of
both kinds every weight is 0 and every document keeps a score of 0.5; extra columns
are ignored. Null ids and null labels never train.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockstrata.llm.common import arrow_batches, id_text, map_rows, ship

#: Score from which a document is kept.
CUT = 0.3
#: Most labelled rows that a fit uses: those with the smallest hash of their id.
MAX_LABELS = 12_000
#: Preference pairs drawn for the fit, with a fixed seed.
MAX_PAIRS = 200_000

FEATURES = (
    "bias_words", "upper", "symbols", "shouting", "symbol_tails", "distinct", "repeats", "word_length", "long_words", "digits",
    "bars", "lines", "end_marks", "top_word", "non_ascii", "bigrams",
)
#: Groups of three-byte sequences.
HASHED = 64
#: How much harder the weights of hashed groups are held back than the others.
HASHED_RIDGE = 1000.0
_UPPER = re.compile(r"[A-Z\u00c0-\u00d6\u00d8-\u00de]")
_SYMBOL = re.compile(r"[#$%&*<>=\\^_{|}~]")
_SHOUT = re.compile(r"!!")
_TAIL = re.compile(r"[#$%&*]{2,}(?=\s|$)")
_DIGIT = re.compile(r"[0-9]")


def hashed(text: str) -> list[float]:
    """Square roots of the shares of a text's three-byte sequences, in lower case, by hashed group."""
    a = np.frombuffer(text.lower().encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    group = ((a[:-2] << np.uint32(16) | a[1:-1] << np.uint32(8) | a[2:]) * np.uint32(2654435761)) >> np.uint32(26)
    return np.sqrt(np.bincount(group, minlength=HASHED) / max(len(group), 1)).tolist()


def features(text: str | None) -> list[float]:
    """The features of one whole text, each roughly between 0 and 1."""
    text = text or ""
    words = text.split()
    n, chars = max(len(words), 1), max(len(text), 1)
    distinct = len(set(words))
    count: dict[str, int] = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    lines = text.count("\n") + 1
    return [
        min(np.log1p(len(words)) / 10, 2.0),
        len(_UPPER.findall(text)) / chars,
        min(10 * len(_SYMBOL.findall(text)) / chars, 2.0),
        min(len(_SHOUT.findall(text)) / n, 1.0),
        min(len(_TAIL.findall(text)) / n, 1.0),
        distinct / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        min(len(text) / n / 20, 2.0),
        sum(len(w) > 25 for w in count) / n,
        min(10 * len(_DIGIT.findall(text)) / chars, 2.0),
        count.get("|", 0) / n,
        min(lines / n, 1.0),
        min((text.count(".") + text.count("?")) / n, 1.0),
        max(count.values(), default=0) / n,
        (len(text.encode("utf-8", "replace")) - len(text)) / chars,
        len(set(zip(words, words[1:], strict=False))) / n,
        *hashed(text),
    ]


@dataclass(frozen=True)
class Model:
    """Weights and mean of the features, and the map from strength to score."""

    weights: tuple[float, ...]
    mean: tuple[float, ...]
    cut: float
    slope: float

    def scores(self, rows: list[list[float]]) -> list[float]:
        x = np.asarray(rows, dtype=np.float64).reshape(-1, len(self.weights)) - np.asarray(self.mean)
        z = self.slope * ((x * np.asarray(self.weights)).sum(axis=1) - self.cut) + np.log(CUT / (1 - CUT))
        return (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()


def bradley_terry(x: np.ndarray, y: np.ndarray, pairs: int = MAX_PAIRS, ridge: float = 1e-4, seed: int = 7) -> Model:
    """Fit strengths so that rows marked 1 beat rows marked 0."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        neutral = np.log((1 - CUT) / CUT)  # slope 1 and this cut give a score of one half
        return Model((0.0,) * x.shape[1], (0.0,) * x.shape[1], float(-neutral), 1.0)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = (x - mean) / scale
    rng = np.random.default_rng(seed)
    n = min(pairs, len(good) * len(bad))
    d = z[rng.choice(good, n)] - z[rng.choice(bad, n)]
    w = np.zeros(x.shape[1])
    held = ridge * np.where(np.arange(len(w)) < len(FEATURES), 1.0, HASHED_RIDGE)
    for _ in range(40):  # Newton steps on mean log(1 + exp(-d.w)) + the sum of held * w^2
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        grad = -(d * p[:, None]).mean(axis=0) + 2 * held * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / n + 2 * np.diag(held)
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    s = np.sort(z @ w)
    k = len(bad)  # the quantile of the strengths at the share of bad rows, between its neighbours
    cut = (s[k - 1] + s[min(k, len(s) - 1)]) / 2
    spread = float(np.std(s)) or 1.0
    return Model(tuple((w / scale).tolist()), tuple(mean.tolist()), float(cut), 4.0 / spread)


def training_rows(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """Features and label of the labelled documents that may train (crc32 of the id mod 5 is not 0)."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    own = own.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_labels)
    rows = id_text(docs).join(F.broadcast(own), "doc_id")  # at most max_labels rows of two numbers

    def make():
        return lambda ids, texts, marks: {"doc_id": ids, "x": [features(t) for t in texts], "label": marks}

    return map_rows(rows, ["doc_id", "text", "label"], "doc_id long, x array<double>, label int", make)


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> Model:
    """Learn from at most ``max_labels`` labelled rows; only their features reach the driver."""
    got = sorted((r.doc_id, r.label, tuple(r.x)) for r in training_rows(docs, labels, max_labels).collect())
    x = np.array([r[2] for r in got], dtype=np.float64).reshape(-1, len(FEATURES) + HASHED)
    return bradley_terry(x, np.array([r[1] for r in got], dtype=int))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document. A null id is never held out."""

    def make():
        def run(ids, texts):
            s = model.scores([features(t) for t in texts])
            held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in ids]
            return {"doc_id": ids, "held_out": held, "score": s, "predicted": [int(v >= CUT) for v in s]}

        return run

    return map_rows(id_text(docs), ["doc_id", "text"], "doc_id long, held_out boolean, score double, predicted int", make)


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model keeps, with all their columns."""
    spark = docs.sparkSession
    ship(spark)
    arrow_batches(spark)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            if b.num_rows:
                s = model.scores([features(t) for t in b.column(at).to_pylist()])
                yield b.filter(pa.array([v >= CUT for v in s]))

    return docs.mapInArrow(run, docs.schema)
