"""Quality by a factorisation machine.

A document's features are its hashed words with damped counts, binned statistics
of its structure, and its character count as metadata.  Each feature has a weight
and a short vector; the score is a logistic function of the weights' sum plus all
pairs' inner products, which the identity
sum over pairs = ((sum v x)^2 - sum (v x)^2) / 2 gives in linear time.

Defined results: null and empty texts have the structure of no words; a null
n_chars is taken from the text; training rows without a label are left out;
without training rows every score is 0.5; repeated rows are scored one by one;
other columns aren't read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waygraph.llm.common import Shared, training_rows, held_out, map_arrow, table
from waygraph.llm.quality_rules import SPACE, SYMBOLS, repeated_words

BUCKETS = 1 << 16
BINS = 12
STATS = 9
RANK = 8
#: Labelled training rows, chosen by a hash of doc_id; all where there are fewer.
TRAIN_ROWS = 5_000
#: And bytes of their texts together, as they come to the driver.
TRAIN_BYTES = 64_000_000
EPOCHS = 8
BATCH = 128
KEPT_WORDS = 400_000
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"


def structure(raw: bytes, words: list[bytes], n_chars: int) -> list[int]:
    """Bucket numbers past BUCKETS of the binned statistics."""
    n, size = max(1, len(words)), max(1, len(raw))
    lines = [x for x in raw.split(b"\n") if x.strip(SPACE)]
    share = lambda chars: 1 - len(raw.translate(None, chars)) / size if raw else 0.0
    values = (
        np.log2(1 + len(words)) / 16,
        sum(map(len, words)) / n / 12,
        share(SYMBOLS) * 4,
        share(UPPER),
        share(DIGITS) * 4,
        1 - len(set(lines)) / max(1, len(lines)),
        repeated_words(words) / n,
        len(set(words)) / n,
        np.log2(1 + n_chars) / 20,
    )
    return [BUCKETS + i * BINS + min(BINS - 1, int(v * BINS)) for i, v in enumerate(values)]


class Featurizer:
    """Feature numbers and values of texts; remembers words' buckets."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
        raw = (text or "").encode("utf-8", "surrogatepass")
        words = raw.split()
        known = self.known
        for w in words:
            if w not in known:
                known[w] = zlib.crc32(w.lower()) % BUCKETS
        ids, counts = np.unique(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), return_counts=True)
        if len(known) > KEPT_WORDS:
            known.clear()
        damped = np.log1p(counts)
        damped /= np.sqrt((damped**2).sum()) or 1.0
        own = structure(raw, words, len(text or "") if n_chars is None else n_chars)
        return np.concatenate([ids, own]), np.concatenate([damped, np.full(len(own), 0.5)])


@dataclass
class FactorMachine:
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def raw(self, ids: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores before the logistic function; documents' features lie end to end from starts."""
        vx = self.vectors[ids] * values[:, None]
        linear = np.add.reduceat(self.weights[ids] * values, starts)
        pairs = np.add.reduceat(vx, starts) ** 2 - np.add.reduceat(vx * vx, starts)
        return self.bias + linear + 0.5 * pairs.sum(1)


def fit(texts: list[str | None], n_chars: list[int | None], labels: list[int], seed: int = 7) -> FactorMachine:
    """AdaGrad on the logistic loss over whole labelled texts."""
    rng = np.random.default_rng(seed)
    size = BUCKETS + STATS * BINS
    m = FactorMachine(0.0, np.zeros(size), rng.normal(0, 0.02, (size, RANK)))
    if not texts or len(set(labels)) < 2:
        return m
    make = Featurizer()
    rows = [make(t, n) for t, n in zip(texts, n_chars, strict=True)]
    y = np.array(labels, float)
    m.bias = float(np.log(y.mean() / (1 - y.mean())))
    gw, gv, gb = np.full(size, 1e-6), np.full((size, RANK), 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            ids = np.concatenate([rows[i][0] for i in part])
            x = np.concatenate([rows[i][1] for i in part])
            lens = np.array([len(rows[i][0]) for i in part])
            starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
            err = (1 / (1 + np.exp(-np.clip(m.raw(ids, x, starts), -30, 30))) - y[part]) / len(part)
            vx = m.vectors[ids] * x[:, None]
            each = np.repeat(err, lens)
            used, slot = np.unique(ids, return_inverse=True)
            dw = np.bincount(slot, weights=each * x) + 1e-5 * m.weights[used]
            dv_rows = each[:, None] * x[:, None] * (np.repeat(np.add.reduceat(vx, starts), lens, axis=0) - vx)
            dv = np.stack([np.bincount(slot, weights=dv_rows[:, k]) for k in range(RANK)], 1) + 1e-5 * m.vectors[used]
            gw[used] += dw**2
            gv[used] += dv**2
            gb += err.sum() ** 2
            m.weights[used] -= 0.1 * dw / np.sqrt(gw[used])
            m.vectors[used] -= 0.03 * dv / np.sqrt(gv[used])
            m.bias -= 0.05 * err.sum() / np.sqrt(gb)
    return m


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> FactorMachine:
    """Fit to at most about `most` labelled documents of TRAIN_BYTES."""
    rows = training_rows(docs, labels, "quality", ["text", "n_chars"], most, TRAIN_BYTES, 6)
    return fit(rows["text"], rows["n_chars"], [int(q > 0) for q in rows["quality"]])


def score(docs: DataFrame, machine: FactorMachine) -> DataFrame:
    """doc_id, score, predicted."""
    machine.weights, machine.vectors = machine.weights.astype(np.float32), machine.vectors.astype(np.float32)
    shared = Shared(docs.sparkSession, machine)
    state: dict = {}

    def kernel(cols: dict[str, list]) -> dict[str, list]:
        make = state.setdefault("make", Featurizer())
        raw: list[float] = []
        rows: list = []

        def settle() -> None:
            if rows:
                lens = [len(r[0]) for r in rows]
                raw.extend(shared.value.raw(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.concatenate([[0], np.cumsum(lens)[:-1]])).tolist())
                rows.clear()

        for text, n in zip(cols["text"], cols["n_chars"], strict=True):
            rows.append(make(text, n))
            if len(rows) >= 256:
                settle()
        settle()
        values = (1 / (1 + np.exp(-np.clip(np.array(raw), -30, 30)))).tolist()
        return {"doc_id": cols["doc_id"], "score": values, "predicted": [int(v >= 0.5) for v in values]}

    slim = docs.select("doc_id", "text", "n_chars")
    return map_arrow(slim, kernel, f"doc_id {dict(slim.dtypes)['doc_id']}, score double, predicted int")


def op7_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = train(docs, labels.where(~held_out(F.col("doc_id"), 3, 1)))
    return score(docs, machine).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")
