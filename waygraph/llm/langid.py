"""Language identification of mixed-language text.

Training counts hashed character n-grams and the scripts of words for each
language.  A word's script, told by code point ranges, narrows the candidate
languages; its n-grams give log posteriors over them, floored so that no word
rules a language out.  A Viterbi pass over a document's words, with a penalty for
each switch, labels spans; the language with the most letters is the document's.

Defined results: null texts and texts without letters are `und` with score 0 and
no spans; a tie goes to the language first by name; training rows with a null lang
are left out; without training rows every document is `und`; repeated rows are
labelled one by one; other columns aren't read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waygraph.llm.common import Shared, add_arrow, bounded_sample, held_out, map_arrow, padded_groups, table

BUCKETS = 1 << 16
#: Training rows, chosen by a hash of doc_id; all where there are fewer.
TRAIN_ROWS = 20_000
MAX_LANGS = 64
SWITCH = 6.0
FLOOR = -7.0
#: N-grams' worth of the distribution over all languages that each language's own is mixed with.
BACKOFF = 2_000.0
KEPT_WORDS = 300_000
#: Words scored at a time.
WORDS = 20_000
#: A pipeline keeps documents whose score reaches this.
LEAST_SCORE = 0.4
#: Unicode ranges of scripts.
SCRIPTS = (
    ("latin", ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F),)),
    ("armenian", ((0x530, 0x58F),)),
    ("hebrew", ((0x590, 0x5FF),)),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F))),
    ("devanagari", ((0x900, 0x97F),)),
    ("bengali", ((0x980, 0x9FF),)),
    ("tamil", ((0xB80, 0xBFF),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("georgian", ((0x10A0, 0x10FF),)),
    ("hangul", ((0x1100, 0x11FF), (0xAC00, 0xD7AF))),
    ("kana", ((0x3040, 0x30FF),)),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2A6DF))),
    ("other", ()),
)


def script_of(word: str) -> int:
    """Number of the script of most of the word's letters; -1 without letters."""
    if word.isascii():
        return 0 if any(map(str.isalpha, word)) else -1
    votes: Counter[int] = Counter()
    for ch in word:
        if ch.isalpha():
            at = ord(ch)
            votes[next((i for i, (_, spans) in enumerate(SCRIPTS) if any(a <= at <= b for a, b in spans)), len(SCRIPTS) - 1)] += 1
    return min(votes, key=lambda s: (-votes[s], s)) if votes else -1


#: Words of Latin letters alone, which need no closer look.
LATIN = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in SCRIPTS[0][1]) + "]+")


def letters_of(word: str) -> str:
    return word.lower() if word.isalpha() else "".join(filter(str.isalpha, word)).lower()


def grams(letters: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' n-grams of 1 to 4 characters, ends marked, and of the words; and each bucket's word number."""
    text = "".join([f"^{w}$" for w in letters])
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    own = np.repeat(np.arange(len(letters)), [len(w) + 2 for w in letters])
    buckets, words = [np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in letters], np.int64)], [np.arange(len(letters))]
    for n in (1, 2, 3, 4):
        size = len(codes) - n + 1
        if size <= 0:
            continue
        h = np.full(size, n, np.uint64)
        for at in range(n):
            h = (h ^ codes[at : at + size]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inside = own[:size] == own[n - 1 :] if n > 1 else (codes != 94) & (codes != 36)
        buckets.append((h[inside] % np.uint64(BUCKETS)).astype(np.int64))
        words.append(own[:size][inside])
    return np.concatenate(buckets), np.concatenate(words)


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray  # buckets x languages, log probability
    allowed: np.ndarray  # scripts x languages
    prior: np.ndarray

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log posteriors of words, and their letters (0: a word has no say)."""
        letters = [letters_of(w) for w in words]
        sizes = np.array([len(w) for w in letters], np.int32)
        buckets, own = grams(letters)
        s = np.stack([np.bincount(own, weights=self.table[buckets, k], minlength=len(words)) for k in range(len(self.langs))], 1)
        script = np.array([0 if w.isascii() or LATIN.fullmatch(w) else max(0, script_of(w)) for w in letters])
        candidates = self.allowed[script]
        candidates[~candidates.any(1)] = True
        s = np.where(candidates, s, s.max(1, keepdims=True) + 10 * FLOOR)
        s -= s.max(1, keepdims=True)
        s -= np.log(np.exp(s).sum(1, keepdims=True))
        s = np.maximum(s, FLOOR).astype(np.float32)
        s[sizes == 0] = 0
        return s, sizes


def train(rows: DataFrame, most: int = TRAIN_ROWS) -> LanguageModel:
    """Learn from text and lang of the rows, at most about `most` of them."""
    rows = bounded_sample(rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()), ["doc_id", "text"], most, 11).select("text", "lang")

    def kernel(cols: dict[str, list]) -> dict[str, list]:
        by: dict[str, Counter] = {}
        for text, lang in zip(cols["text"], cols["lang"], strict=True):
            by.setdefault(lang, Counter()).update(text.split())
        out: dict[str, list] = {"lang": [], "bucket": [], "n": []}
        for lang, words in by.items():
            counts = np.zeros(BUCKETS + len(SCRIPTS), np.int64)
            every = list(words)
            for at in range(0, len(every), WORDS):
                part = every[at : at + WORDS]
                letters = [letters_of(w) for w in part]
                n = np.array([words[w] for w in part], np.int64) * np.array([bool(x) for x in letters])
                buckets, own = grams(letters)
                counts[:BUCKETS] += np.bincount(buckets, weights=n[own], minlength=BUCKETS).astype(np.int64)
                script = np.array([0 if w.isascii() or LATIN.fullmatch(w) else max(0, script_of(w)) for w in letters])
                counts[BUCKETS:] += np.bincount(script, weights=n, minlength=len(SCRIPTS)).astype(np.int64)
            at = np.flatnonzero(counts)
            out["lang"] += [lang] * len(at)
            out["bucket"] += at.tolist()
            out["n"] += counts[at].tolist()
        return out

    # at most languages x buckets rows come to the driver
    got = map_arrow(rows, kernel, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    often: Counter = Counter()
    for lang, n in zip(got["lang"], got["n"], strict=True):
        often[lang] += n
    # of too many languages, such as misspelt labels, the most frequent ones are learned
    langs = sorted(sorted(often, key=lambda x: (-often[x], x))[:MAX_LANGS])
    counts, place = np.zeros((BUCKETS + len(SCRIPTS), max(1, len(langs)))), {x: i for i, x in enumerate(langs)}
    for lang, bucket, n in zip(got["lang"], got["bucket"], got["n"], strict=True):
        if lang in place:
            counts[bucket, place[lang]] = n
    seen, scripts = counts[:BUCKETS], counts[BUCKETS:]
    common = (seen.sum(1) + 0.5) / (seen.sum() + 0.5 * BUCKETS)
    logs = np.log((seen + BACKOFF * common[:, None]) / (seen.sum(0) + BACKOFF))
    total = np.maximum(scripts.sum(0), 1)
    return LanguageModel(langs, logs.astype(np.float32), scripts / total >= 0.01, total / total.sum())


def viterbi(ids: np.ndarray, scores: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """Labels (steps x rows) of the best paths; ids (steps x rows) are rows of scores; lengths descend."""
    steps, width = ids.shape
    langs = np.arange(scores.shape[1])
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")
    value = scores[ids[0]]
    stays = np.ones((steps, width, len(langs)), bool)
    tops = np.zeros((steps, width), np.int8)
    for t in range(1, steps):
        n = active[t]
        now = value[:n]
        tops[t, :n] = top = now.argmax(1)
        best = now[np.arange(n), top][:, None] - switch
        stays[t, :n] = now >= best
        value[:n] = np.maximum(now, best) + scores[ids[t, :n]]
    labels = np.zeros((steps, width), np.int8)
    state = value.argmax(1).astype(np.int8)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        labels[t, :n] = state[:n]
        kept = stays[t, np.arange(n), state[:n]]
        state[:n] = np.where(kept, state[:n], tops[t, :n])
    return labels


def _labeller(shared, switch: float, spans: bool):
    state: dict = {}

    def kernel(cols: dict[str, list]) -> dict[str, list]:
        model: LanguageModel = shared.value
        texts = next(iter(cols.values()))
        n = len(texts)
        out: dict[str, list] = {"lang_pred": ["und"] * n, "score": [0.0] * n, "spans": [[] for _ in range(n)] if spans else None}
        if not model.langs:
            return out
        at = 0
        while at < n:
            stop, chars = at, 0
            while stop < n and (stop == at or chars < 6_000_000):
                chars += len(texts[stop] or "")
                stop += 1
            if len(state.get("index", ())) > KEPT_WORDS or not state:
                state.update(index={}, scores=np.zeros((0, len(model.langs)), np.float32), size=np.zeros(0, np.int32))
            index = state["index"]
            parts = [text.split() if text else [] for text in texts[at:stop]]
            fresh = list(dict.fromkeys(w for words in parts for w in words if w not in index))
            for first in range(0, len(fresh), WORDS):
                new = fresh[first : first + WORDS]
                more, letters = model.score(new)
                index.update(zip(new, range(len(index), len(index) + len(new)), strict=True))
                state["scores"], state["size"] = np.concatenate([state["scores"], more]), np.concatenate([state["size"], letters])
            ids = [np.fromiter(map(index.__getitem__, words), np.int32, len(words)) for words in parts]
            del parts
            scores, size = state["scores"], state["size"]
            prob = np.exp(scores)
            lengths = np.array([len(x) for x in ids])
            for group in padded_groups(lengths):
                deep = lengths[group]
                grid = np.zeros((deep[0], len(group)), np.int32)
                for j, row in enumerate(group):
                    grid[: deep[j], j] = ids[row]
                labels = viterbi(grid, scores, deep, switch)
                for j, row in enumerate(group):
                    path, own = labels[: deep[j], j], ids[row]
                    weight = size[own]
                    share = np.bincount(path, weights=weight, minlength=len(model.langs))
                    if (all_letters := weight.sum()) == 0:
                        continue
                    lang = int(share.argmax())
                    mine = path == lang
                    out["lang_pred"][at + row] = model.langs[lang]
                    out["score"][at + row] = float((prob[own[mine], lang] * weight[mine]).sum() / all_letters)
                    if spans:
                        cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
                        out["spans"][at + row] = [{"lang": model.langs[path[a]], "first": a, "words": b - a} for a, b in zip(cuts, cuts[1:], strict=False)]
            at = stop
        return out

    return kernel


def label(docs: DataFrame, model: LanguageModel, switch: float = SWITCH, spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score, and spans: lang, first word (from 0), number of words."""
    shared = Shared(docs.sparkSession, model)
    inner = _labeller(shared, switch, spans)

    def kernel(cols: dict[str, list]) -> dict[str, list]:
        return {"doc_id": cols["doc_id"]} | inner({"text": cols["text"]})

    kind = dict(docs.dtypes)["doc_id"]
    more = ", spans array<struct<lang:string,first:int,words:int>>" if spans else ""
    return map_arrow(docs.select("doc_id", "text"), kernel, f"doc_id {kind}, lang_pred string, score double{more}")


def keep_documents(docs: DataFrame, model: LanguageModel, least: float = LEAST_SCORE) -> DataFrame:
    """The documents of a learned language whose score reaches least, with their own columns."""
    shared = Shared(docs.sparkSession, model)
    inner = {c: f"__d{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in inner.items()))
    marked = add_arrow(renamed, [inner["text"]], _labeller(shared, SWITCH, False), "lang_pred string, score double")
    return marked.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(*(F.col(n).alias(c) for c, n in inner.items()))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 4, 2)
    model = train(docs.where(~out))
    return label(docs, model, spans=False).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
