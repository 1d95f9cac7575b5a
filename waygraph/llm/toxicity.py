"""Toxic spans by a linear-chain conditional random field.

Only documents are labelled.  Token labels come from them: a word is offending
where its document rate among toxic training documents exceeds that among clean
ones by the odds LEAST_ODDS and it is in a LEAST_SHARE of them, and its places in toxic documents are labelled toxic,
all other places clean.  A two-state chain with hashed word features is fitted to
the labelled tokens by gradient ascent on the conditional likelihood; in a
document, forward and backward passes give each word's marginal.  A logistic layer
over the marginals' expected count, maximum and share makes the document's score,
and words whose marginal reaches one half make the offending offsets.

Defined results: null and empty texts have no words and get the score of a text
whose marginals are all zero; training rows without a label are left out; without
training rows every score is 0; repeated rows are scored one by one; other columns
aren't read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waygraph.llm.common import Shared, training_rows, held_out, map_arrow, padded_groups, table

BUCKETS = 1 << 17
#: Labelled training rows, chosen by a hash of doc_id; all where there are fewer.
TRAIN_ROWS = 5_000
#: And bytes of their texts together, as they come to the driver.
TRAIN_BYTES = 64_000_000
LEAST_ODDS = 8.0
LEAST_DOCS = 5
LEAST_SHARE = 0.03
KEPT_WORDS = 300_000
ROUNDS = 12
STEP = 0.5
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def normal(word: str) -> str:
    return word.strip(".,;:!?\"'()[]{}*$%&#|-_").lower()


def features(word: str) -> list[int]:
    """Buckets of the word, its ends and its shape."""
    w = normal(word)
    shape = "".join(dict.fromkeys("a" if c.isalpha() else "0" if c.isdigit() else "-" for c in word))
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in (f"w{w}", f"p{w[:4]}", f"s{w[-4:]}", f"h{shape}")]


@dataclass
class ToxicChain:
    weights: np.ndarray  # log odds of state toxic, by bucket
    moves: np.ndarray  # 2 x 2 transition scores, from and to
    start: float
    head: np.ndarray  # logistic layer: bias, log expected count, maximum, share
    trained: bool = True

    def emissions(self, words: list[str]) -> np.ndarray:
        return self.weights[np.array([features(w) for w in words])].sum(1)


def marginals(odds: np.ndarray, lengths: np.ndarray, moves: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """Marginal of state toxic and the forward log odds (steps x rows); odds are emissions, lengths descend."""
    steps, width = odds.shape
    active = np.searchsorted(-lengths, -np.arange(steps + 1), side="left")
    (oo, ot), (to, tt) = moves
    fore, back = np.zeros_like(odds), np.zeros_like(odds)
    fore[0] = start + odds[0]
    for t in range(1, steps):
        n = active[t]
        a = fore[t - 1, :n]
        fore[t, :n] = odds[t, :n] + np.logaddexp(a + tt, ot) - np.logaddexp(a + to, oo)
    for t in range(steps - 2, -1, -1):
        n = active[t + 1]
        b = back[t + 1, :n] + odds[t + 1, :n]
        back[t, :n] = np.logaddexp(tt + b, to) - np.logaddexp(ot + b, oo)
    return 1 / (1 + np.exp(-np.clip(fore + back, -60, 60))), fore


def pooled(m: np.ndarray) -> tuple[float, float, float]:
    """Log of the expected count, maximum and share of a document's marginals."""
    return (float(np.log1p(m.sum())), float(m.max()), float(m.mean())) if len(m) else (0.0, 0.0, 0.0)


def fit(texts: list[str | None], labels: list[int]) -> ToxicChain:
    """Fit to whole labelled texts."""
    none = ToxicChain(np.zeros(BUCKETS, np.float32), np.zeros((2, 2)), -5.0, np.array([-20.0, 0, 0, 0]), False)
    if not texts or not any(labels) or all(labels):
        return none
    words = [WORD.findall(t or "") for t in texts]
    seen = {0: Counter(), 1: Counter()}
    for own, y in zip(words, labels, strict=True):
        seen[y].update(set(map(normal, own)))
    n1, n0 = sum(labels), len(labels) - sum(labels)
    bad = {w for w, k in seen[1].items() if w and k >= max(LEAST_DOCS, LEAST_SHARE * n1) and (k + 0.5) / (n1 - k + 0.5) >= LEAST_ODDS * (seen[0][w] + 0.5) / (n0 - seen[0][w] + 0.5)}
    index: dict[str, int] = {}
    rows: list[list[int]] = []
    tags: list[bool] = []
    ids = []
    for own in words:
        for w in own:
            if w not in index:
                index[w] = len(rows)
                rows.append(features(w))
                tags.append(normal(w) in bad)
        ids.append(np.fromiter(map(index.__getitem__, own), np.int32, len(own)))
    table_, tagged = np.array(rows, np.int64).reshape(-1, 4), np.array(tags, bool)
    weights, seen_sq = np.zeros(BUCKETS), np.full(BUCKETS, 1e-6)
    moves, moves_sq, start = np.array([[0.0, -4.0], [0.0, -1.0]]), np.full((2, 2), 1e-6), -4.0
    start_sq = 1e-6
    lengths = np.array([len(x) for x in ids])
    groups = list(padded_groups(lengths, 300_000))
    truth = [tagged[x] & bool(y) for x, y in zip(ids, labels, strict=True)]
    scale = max(1, int(sum(t.sum() for t in truth)))
    for _ in range(ROUNDS):
        for group in groups:
            deep = lengths[group]
            grid, gold = np.zeros((deep[0], len(group)), np.int32), np.zeros((deep[0], len(group)), bool)
            for j, row in enumerate(group):
                grid[: deep[j], j], gold[: deep[j], j] = ids[row], truth[row]
            alive = np.arange(deep[0])[:, None] < deep[None, :]
            odds = weights[table_].sum(1)[grid]
            m, fore = marginals(odds, deep, moves, start)
            m = np.where(alive, m, 0)
            by_word = np.bincount(grid[alive], weights=(gold - m)[alive], minlength=len(rows))
            grad = np.zeros(BUCKETS)
            for c in range(4):
                np.add.at(grad, table_[:, c], by_word)
            grad = grad / scale * len(groups) - 1e-4 * weights
            seen_sq += grad**2
            weights += STEP * grad / np.sqrt(seen_sq) * (seen_sq > 1e-5)
            first = (gold[0] - m[0]).sum() / max(1, len(group))
            start_sq += first**2
            start += 0.1 * first / np.sqrt(start_sq)
            pairs = alive[1:]
            p1, p0 = m[:-1][pairs], m[1:][pairs]
            g1, g0 = gold[:-1][pairs], gold[1:][pairs]
            # expected transitions under the marginals' product, corrected by the chain's forward odds
            f, e = fore[:-1][pairs], np.zeros((2, 2))
            for i in (0, 1):
                stay = 1 / (1 + np.exp(-(moves[i, 1] - moves[i, 0] + np.log(np.clip(p0, 1e-9, 1)) - np.log(np.clip(1 - p0, 1e-9, 1)) - np.logaddexp(f + moves[1, 1], moves[0, 1]) + np.logaddexp(f + moves[1, 0], moves[0, 0]))))
                mass = p1 if i else 1 - p1
                e[i] = (mass * (1 - stay)).sum(), (mass * stay).sum()
            o = np.array([[(~g1 & ~g0).sum(), (~g1 & g0).sum()], [(g1 & ~g0).sum(), (g1 & g0).sum()]], float)
            gm = (o - e) / max(1.0, o.sum())
            moves_sq += gm**2
            moves += 0.1 * gm / np.sqrt(moves_sq)
    chain = ToxicChain(weights.astype(np.float32), moves, start, none.head)
    x = np.array([[1.0, *p] for p in document_pools(ids, weights[table_].sum(1), chain)])
    y = np.array(labels, float)
    head = np.zeros(4)
    for _ in range(50):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ head, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-2, 1e-2, 1e-2]) * len(y) / 100
        head += np.linalg.solve(h, x.T @ (y - p) - np.array([1e-3, 1e-2, 1e-2, 1e-2]) * len(y) / 100 * head)
    chain.head = head
    return chain


def document_pools(ids: list[np.ndarray], odds: np.ndarray, chain: ToxicChain, hits: list | None = None) -> list[tuple]:
    """pooled() of each document; hits gets (row, word numbers) where marginals reach one half."""
    out: list[tuple] = [(0.0, 0.0, 0.0)] * len(ids)
    lengths = np.array([len(x) for x in ids])
    for group in padded_groups(lengths):
        deep = lengths[group]
        grid = np.zeros((deep[0], len(group)))
        for j, row in enumerate(group):
            grid[: deep[j], j] = odds[ids[row]]
        m, _ = marginals(grid, deep, chain.moves, chain.start)
        for j, row in enumerate(group):
            own = m[: deep[j], j]
            out[row] = pooled(own)
            if hits is not None and out[row][1] >= 0.5:
                hits.append((int(row), np.flatnonzero(own >= 0.5)))
    return out


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> ToxicChain:
    """Fit to at most about `most` labelled documents of TRAIN_BYTES."""
    rows = training_rows(docs, labels, "toxic", ["text"], most, TRAIN_BYTES, 5)
    return fit(rows["text"], [int(y > 0) for y in rows["toxic"]])


def score(docs: DataFrame, chain: ToxicChain) -> DataFrame:
    """doc_id, score, predicted, spans: character offsets (start, end) of offending words."""
    shared = Shared(docs.sparkSession, chain)
    state: dict = {}

    def kernel(cols: dict[str, list]) -> dict[str, list]:
        chain: ToxicChain = shared.value
        texts = cols["text"]
        n = len(texts)
        values, spans = [0.0] * n, [[] for _ in range(n)]
        at = 0
        while at < n:
            stop, chars = at, 0
            while stop < n and (stop == at or chars < 6_000_000):
                chars += len(texts[stop] or "")
                stop += 1
            if not state or len(state["index"]) > KEPT_WORDS:
                state.update(index={}, odds=np.zeros(0, np.float32))
            index = state["index"]
            parts = [text.encode("utf-8", "surrogatepass").split() if text else [] for text in texts[at:stop]]
            fresh = list(dict.fromkeys(w for words in parts for w in words if w not in index))
            if fresh:
                index.update(zip(fresh, range(len(index), len(index) + len(fresh)), strict=True))
                state["odds"] = np.concatenate([state["odds"], chain.emissions([w.decode("utf-8", "surrogatepass") for w in fresh])])
            ids = [np.fromiter(map(index.__getitem__, words), np.int32, len(words)) for words in parts]
            del parts
            hits: list = []
            pools = document_pools(ids, state["odds"], chain, hits)
            z = np.array([[1.0, *p] for p in pools]) @ chain.head
            values[at:stop] = (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist() if chain.trained else [0.0] * (stop - at)
            for row, numbers in hits:
                own = set(numbers.tolist())
                spans[at + row] = [{"start": x.start(), "end": x.end()} for i, x in enumerate(WORD.finditer(texts[at + row])) if i in own]
            at = stop
        return {"doc_id": cols["doc_id"], "score": values, "predicted": [int(v >= 0.5) for v in values], "spans": spans}

    slim = docs.select("doc_id", "text")
    return map_arrow(slim, kernel, f"doc_id {dict(slim.dtypes)['doc_id']}, score double, predicted int, spans array<struct<start:int,end:int>>")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    chain = train(docs, labels.where(~held_out(F.col("doc_id"), 5, 0)))
    return score(docs, chain).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"))
