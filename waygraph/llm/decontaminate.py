"""Benchmark decontamination by spaced-seed hashing.

A mask selects SEED_WEIGHT of the tokens in a window and ignores the others, so
that a window still hits where ignored tokens were substituted.  Windows of the
benchmark and of the documents are hashed under each mask and joined on the hash.
A bitmap of fixed size, built from all benchmark hashes, thins the documents'
windows before the join; it has no false negatives, and false positives fall in
the join.  Around each hit the two texts are laid over each other on the hit's
diagonal and the longest stretch of enough identity is found, up to the whole item;
it is a leak if it has enough tokens.

Defined results: null and empty texts and items never leak; items of under
LEAST_TOKENS tokens are too short to prove a leak; repeated rows, and rows of one or
no id, leak each for its own text; items of one or no id are searched each by its
own text; empty tables give an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waygraph.llm.common import Shared, bounded_batches, give_back, map_arrow, materialize, set_aside, table
from waygraph.llm.licenses import words_of

#: Masks of weight 6; a passage of 13 tokens with one substitution, or 16 with two apart, keeps a hit.
MASKS = ("111111", "11011011", "1110010011", "1101001101")
LEAST_TOKENS = 12
LEAST_IDENTITY = 0.75
#: Bits of the bitmap: 16 MB, whatever the benchmark's size.
BITMAP_BITS = 1 << 27
KEPT_WORDS = 150_000


def token_codes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """64-bit codes of tokens."""
    import xxhash

    for w in words:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    out = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(known) > KEPT_WORDS:
        known.clear()
    return out


def window_hashes(codes: np.ndarray, masks: tuple[str, ...] = MASKS) -> Iterator[np.ndarray]:
    """For each mask the hashes of all windows, by start."""
    for number, mask in enumerate(masks):
        n = len(codes) - len(mask) + 1
        if n <= 0:
            yield np.zeros(0, np.int64)
            continue
        h = np.full(n, 0x9E3779B97F4A7C15 * (number + 1) & (2**64 - 1), np.uint64)
        for at, bit in enumerate(mask):
            if bit == "1":
                h = (h ^ codes[at : at + n]) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(32)
        yield h.view(np.int64)


def benchmark_items(bench: DataFrame) -> DataFrame:
    """item (a number of its own for each id and text), item_id, text, n: its tokens."""
    rows = bench.select("item_id", "text").where("text is not null").dropDuplicates()
    kernel = lambda c: c | {"n": [len(words_of(t)) for t in c["text"]]}
    return map_arrow(rows, kernel, f"item_id {dict(rows.dtypes)['item_id']}, text string, n int").withColumn("item", F.monotonically_increasing_id())


def benchmark_windows(items: DataFrame, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """hash, item, item_pos."""

    def kernel(cols: dict[str, list]) -> dict[str, list]:
        known: dict = {}
        out: dict[str, list] = {"hash": [], "item": [], "item_pos": []}
        for item, text in zip(cols["item"], cols["text"], strict=True):
            for h in window_hashes(token_codes(words_of(text), known), masks):
                out["hash"] += h.tolist()
                out["item"] += [item] * len(h)
                out["item_pos"] += range(len(h))
        return out

    return map_arrow(items.select("item", "text"), kernel, "hash bigint, item bigint, item_pos int")


def bitmap(hashes: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """Bitmap of the hashes; at most bits / 64 rows come to the driver."""
    bit = F.pmod(F.col("hash"), F.lit(bits))
    words = hashes.select(F.floor(bit / 64).cast("long").alias("w"), F.pmod(bit, F.lit(64)).cast("int").alias("b")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("v")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words["w"].to_numpy()] = words["v"].to_numpy()
    return out.view(np.uint64)


def candidates(docs: DataFrame, bits: np.ndarray, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """doc_id, text, hits (hash, pos) of the documents with windows in the bitmap."""
    shared = Shared(docs.sparkSession, bits)
    known: dict = {}
    hit = pa.list_(pa.struct([("hash", pa.int64()), ("pos", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = shared.value
        size = np.int64(len(have) * 64)
        for batch in batches:
            rows, hits = [], []
            for row, text in enumerate(x.as_py() for x in batch.column(1)):
                own = []
                for h in window_hashes(token_codes(words_of(text), known), masks):
                    bit = np.mod(h, size).astype(np.uint64)
                    for pos in np.flatnonzero((have[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)).tolist():
                        own.append({"hash": int(h[pos]), "pos": pos})
                if own:
                    rows.append(row)
                    hits.append(own)
            if rows:
                part = batch.take(pa.array(rows, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(hits, hit)], ["doc_id", "text", "hits"])
            batch = part = None
            give_back()

    slim = docs.select("doc_id", "text").where("text is not null")
    return bounded_batches(slim).mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, text string, hits array<struct<hash:bigint,pos:int>>")


def best_stretch(doc: list[bytes], item: list[bytes], diagonal: int, identity: float = LEAST_IDENTITY) -> tuple[int, int, int]:
    """(first document token, tokens, matches) of the longest stretch of this identity where document token i lies over item token i - diagonal.

    Of stretches of one length the one with most matches counts, then the first.
    """
    lo, hi = max(0, diagonal), min(len(doc), diagonal + len(item))
    share = Fraction(identity).limit_denominator(10_000)
    same = np.fromiter((doc[i] == item[i - diagonal] for i in range(lo, hi)), np.int64, max(0, hi - lo))
    matches = np.concatenate([[0], np.cumsum(same)])
    # a stretch from a to b has the identity where its balance doesn't fall
    balance = matches * share.denominator - np.arange(len(matches)) * share.numerator
    # of all starts only new lows of the balance can begin a longest stretch, of all ends only highs from behind
    lowest, highest = np.minimum.accumulate(balance), np.maximum.accumulate(balance[::-1])[::-1]
    # the furthest end for each start: the highs fall from left to right
    size = int((len(highest) - np.searchsorted(highest[::-1], lowest, "left") - 1 - np.arange(len(matches))).max())
    if size <= 0:
        return lo, 0, 0
    starts = np.flatnonzero(balance[size:] >= balance[: len(balance) - size])
    own = matches[starts + size] - matches[starts]
    at = int(np.argmax(own))
    return lo + int(starts[at]), size, int(own[at])


def _leaks(docs: DataFrame, bench: DataFrame, masks: tuple[str, ...], least: int, identity: float) -> DataFrame:
    """What find_leaks gives, and text_hash of the document's text.

    Hits are reduced to pairs of row and diagonal before any text is joined; a
    document's text then moves once, to the items and diagonals that it asks for.
    """
    items = materialize(benchmark_items(bench), "items")
    windows = materialize(benchmark_windows(items, masks), "windows")
    found = materialize(candidates(docs, bitmap(windows), masks).withColumn("row", F.monotonically_increasing_id()), "candidates")
    hits = found.select("row", F.explode("hits").alias("h")).select("row", F.col("h.hash").alias("hash"), F.col("h.pos").alias("pos"))
    pairs = hits.join(windows, "hash").select("row", "item", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct()
    asked = pairs.join(items.select("item", "item_id", F.col("text").alias("item_text")), "item").groupBy("row").agg(F.collect_list(F.struct("item", "item_id", "diagonal", "item_text")).alias("asked"))
    whole = found.select("row", "doc_id", F.xxhash64("text").alias("text_hash"), "text").join(asked, "row")

    def verify(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("doc_id", "text_hash", "item_id", "doc_pos", "item_pos", "n_tokens", "n_match")}
        known: dict[int, list[bytes]] = {}
        for doc_id, text_hash, text, own in zip(cols["doc_id"], cols["text_hash"], cols["text"], cols["asked"], strict=True):
            words, best = words_of(text), {}
            for x in own:
                if x["item"] not in known:
                    known[x["item"]] = words_of(x["item_text"])
                at, n, same = best_stretch(words, known[x["item"]], x["diagonal"], identity)
                # of one item's overlaps the one with most matches, then the first
                if n >= least and (mine := (same, -at, x["diagonal"] - at, n)) > best.get(x["item_id"], (0,)):
                    best[x["item_id"]] = mine
            for item_id, (same, at, item_pos, n) in best.items():
                for k, v in zip(out, (doc_id, text_hash, item_id, -at, -item_pos, n, same), strict=True):
                    out[k].append(v)
        return out

    return map_arrow(whole.select("doc_id", "text_hash", "text", "asked"), verify, f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash bigint, item_id {dict(bench.dtypes)['item_id']}, doc_pos int, item_pos int, n_tokens int, n_match int")


def find_leaks(docs: DataFrame, bench: DataFrame, masks: tuple[str, ...] = MASKS, least: int = LEAST_TOKENS, identity: float = LEAST_IDENTITY) -> DataFrame:
    """doc_id, item_id, doc_pos, item_pos, n_tokens, n_match: the longest verified overlap of each document's row and item."""
    return _leaks(docs, bench, masks, least, identity).drop("text_hash")


def drop_leaks(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The documents without leaks, with their own columns; rows of one id leak each for its own text."""
    leaks = _leaks(docs, bench, MASKS, LEAST_TOKENS, LEAST_IDENTITY).select("doc_id", "text_hash").distinct()
    named, back = set_aside(docs)
    same = named[back["doc_id"]].eqNullSafe(leaks["doc_id"]) & (F.xxhash64(named[back["text"]]) == leaks["text_hash"])
    return named.join(leaks, same, "left_anti").select(*(F.col(n).alias(c) for c, n in back.items()))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.withColumn("contaminated", F.lit(True))
