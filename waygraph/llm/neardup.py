"""Near duplicates by SetSketch registers.

A document's set is its distinct shingles.  Register i keeps the least of one
exponential draw for each shingle, truncated to a power of the base:
K = floor(1 - log_base(least)).  Such registers merge by maximum and two sets
share a register about as often as their similarity.  Bands of registers are
hashed into buckets; members of a bucket are candidates.  For a pair, the counts of
greater, less and equal registers have a likelihood in the similarity, the sets'
sizes being known; a pair whose likelihood at the threshold is PRUNE below its best
is dropped, all others are verified on the full sets.

Equal word sequences are one node.  Buckets are worked off in three rounds, so
that no bucket is expanded into all its pairs: each node against the least member
of its buckets, then members of buckets that still have several components against
the bucket's most typical member.  In both latter rounds each node's shingles that
no other node of these buckets has are counted: two sets share at most what either
shares with anyone, an exact bound that spares pairs and nodes that can't be linked.
The third round leaves the buckets: with all shingles ordered from the rarest on, two
linked sets share one among the first n - ceil(percent * n / 100) + 1 of each, so
members of different components meet only over a rare shingle (an exact filter), and
only if four bits of each register agree often enough (lost with MISSED at most), and
only if their sets can differ by as little as a link allows: a set's codes leave a parity in each of ODD
places, and where two sets' parities differ in so many places, the sets do in no fewer (exact).
A pair meets over its first common shingle alone, where that is among the FIRST
shared ones of both.
Nodes that share a component need no further pair, so components come out as if
every pair of every bucket had been verified.

Defined results: null texts and texts without words are empty and linked with
nothing; with fewer words than a shingle the whole sequence is one shingle; rows of
equal id and text share a class; a null id takes part as any other and its
component is the least id of the class, null where it has none; an empty table
gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waygraph.llm.common import map_arrow, materialize, set_aside, table

BASE = 1.001
RATE = 20.0
LEVELS = 65_534
#: Bands of ROWS registers: a pair at 0.8 is missed with (1 - 0.8 ** 4) ** 32, about 5e-8.
BANDS, ROWS = 32, 4
PRUNE = 18.0
KEPT_WORDS = 150_000
#: Probability that a pair at the threshold has too few agreeing bits.
MISSED = 1e-10
#: Bits of a register that are compared, and rarest shared shingles that a member names.
BITS, FIRST = 4, 24
#: Places of a set's parities.
ODD = 1_024


@dataclass(frozen=True)
class Linking:
    """Words of a shingle, and the least similarity in percent."""

    words: int = 5
    percent: int = 80


class Words(dict):
    """Codes of words, worked out once a word."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > KEPT_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_codes(codes: np.ndarray, k: int) -> np.ndarray:
    """Distinct 64-bit codes of the k-word shingles; the whole sequence as one if shorter."""
    if not len(codes):
        return codes
    k = min(k, len(codes))
    h = np.full(len(codes) - k + 1, k, np.uint64)
    for at in range(k):
        h = (h ^ codes[at : at + len(h)]) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def parities(codes: np.ndarray) -> np.ndarray:
    """Whether an odd number of a set's codes falls into each of ODD places, as longs."""
    place = (codes >> np.uint64(64 - (ODD - 1).bit_length())).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=ODD) & 1).astype(np.uint8)).view("<i8")


def sketch(codes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Registers of a set. The codes are hashes already, so that a product with an odd seed is a draw."""
    least = np.full(len(seeds), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(codes), 1024):
        np.minimum(least, (codes[None, at : at + 1024] * seeds[:, None]).min(1), out=least)
    draw = -np.log1p(-((least.astype(np.float64) + 0.5) / 2.0**64)) / RATE
    return np.clip(np.floor(1 - np.log(draw) / np.log(BASE)) + LEVELS // 2, 0, LEVELS + 1).astype("<u2")


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def seeds(n: int = BANDS * ROWS) -> np.ndarray:
    return np.random.default_rng(20_240_817).integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _collision(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def joint_estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, at: float) -> tuple[np.ndarray, np.ndarray]:
    """Likeliest similarity of register rows a and b, and by how much its log likelihood exceeds that at `at`."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - more - less
    u = (na / (na + nb))[:, None]
    v = 1 - u

    def likelihood(j: np.ndarray) -> np.ndarray:
        p, q = np.clip(_collision(u - v * j), 1e-9, 1), np.clip(_collision(v - u * j), 1e-9, 1)
        return more * np.log(p) + less * np.log(q) + same * np.log(np.clip(1 - p - q, 1e-9, 1))

    top = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, 65)[None, :] * top
    each = likelihood(grid)
    best = each.argmax(1)
    rows = np.arange(len(a))
    return grid[rows, best], each[rows, best] - likelihood(np.minimum(at, top))[:, 0]


def features(docs: DataFrame, linking: Linking) -> DataFrame:
    """doc_id, text_hash, key (of the word sequence; null if empty), n_shingles, registers."""
    k = linking.words
    state: dict = {}

    def kernel(cols: dict[str, list]) -> dict[str, list]:
        import xxhash

        known, own = state.setdefault("known", Words()), state.setdefault("seeds", seeds())
        keys, sizes, regs = [], [], []
        for text in cols["text"]:
            words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
            codes = shingle_codes(known.of(words), k)
            sizes.append(len(codes))
            keys.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
            regs.append(sketch(codes, own).tobytes() if words else None)
        return {"doc_id": cols["doc_id"], "text_hash": cols["text_hash"], "key": keys, "n_shingles": sizes, "registers": regs}

    slim = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return map_arrow(slim, kernel, f"doc_id {dict(slim.dtypes)['doc_id']}, text_hash bigint, key binary, n_shingles bigint, registers binary")


def _plausible(pairs: DataFrame, nodes: DataFrame, linking: Linking) -> DataFrame:
    """Of pairs (a, b) those whose sizes and registers allow a link."""
    side = lambda s: nodes.select(F.col("key").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("registers").alias(f"r_{s}"))
    least = linking.percent
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b"))

    def kernel(cols: dict[str, list]) -> dict[str, list]:
        a, b = (np.frombuffer(b"".join(cols[f"r_{s}"]), "<u2").reshape(-1, BANDS * ROWS) for s in "ab")
        na, nb = (np.array(cols[f"n_{s}"], np.float64) for s in "ab")
        keep = np.zeros(len(a), bool)
        for at in range(0, len(a), 2048):
            part = slice(at, at + 2048)
            best, excess = joint_estimate(a[part], b[part], na[part], nb[part], least / 100)
            keep[part] = (best >= least / 100) | (excess <= PRUNE)
        rows = np.flatnonzero(keep).tolist()
        return {s: [cols[s][i] for i in rows] for s in "ab"}

    return map_arrow(both.select("a", "b", "n_a", "n_b", "r_a", "r_b"), kernel, "a binary, b binary")


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, linking: Linking) -> DataFrame:
    """Of pairs (a, b) those linked, by their full sets."""
    side = lambda s: texts.select(F.col("key").alias(s), F.col("text").alias(f"text_{s}"))
    # written, so that one task never runs both kernels
    both = materialize(_plausible(pairs, nodes, linking), "pairs").join(side("b"), "b").join(side("a"), "a")
    k, least = linking.words, linking.percent

    def shingles(text: str) -> set:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        return set(zip(*(words[i:] for i in range(min(k, len(words)))), strict=False))

    def kernel(cols: dict[str, list]) -> dict[str, list]:
        kept: dict[bytes, set] = {}
        out: dict[str, list] = {"a": [], "b": []}
        for a, b, ta, tb in zip(cols["a"], cols["b"], cols["text_a"], cols["text_b"], strict=True):
            sets = []
            for key, text in ((a, ta), (b, tb)):
                if key not in kept:
                    if len(kept) >= 64:
                        kept.pop(next(iter(kept)))
                    kept[key] = shingles(text)
                sets.append(kept[key])
            common = len(sets[0] & sets[1])
            if 100 * common >= least * (len(sets[0]) + len(sets[1]) - common):
                out["a"].append(a)
                out["b"].append(b)
        return out

    return map_arrow(both.select("a", "b", "text_a", "text_b"), kernel, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node that edges (a, b) reach; by least neighbour labels and pointer jumps."""
    both = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        far = labels.select(F.col("node").alias("via"), F.col("label").alias("jump"))
        step = materialize(step.join(far, step["label"] == far["via"]).select("node", "old", F.least("label", "jump").alias("label")), "labels")
        labels = step.select("node", "label")
        if not step.where("old != label").limit(1).count():
            return labels


def _merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (key, label) after edges (a, b) between keys."""
    edges = materialize(edges, "links")
    if not edges.limit(1).count():
        return labels
    name = lambda s: labels.select(F.col("key").alias(s), F.col("label").alias(f"l_{s}"))
    over = edges.join(name("a"), "a").join(name("b"), "b").select(F.col("l_a").alias("a"), F.col("l_b").alias("b")).where("a != b")
    found = components(over)
    return materialize(labels.join(found, labels["label"] == found["node"], "left").select("key", F.coalesce(found["label"], labels["label"]).alias("label")), "labels")


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """band, key, n_shingles, label, main (the most frequent label) of members in buckets with several labels."""
    named = members.join(labels, "key")
    counts = named.groupBy("band", "label").count()
    main = counts.groupBy("band").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return materialize(named.join(main, "band"), "mixed")


def _coded(rows: DataFrame, linking: Linking, of: str, out: str, made: Callable[[np.ndarray], np.ndarray] = lambda codes: codes.view(np.int64)) -> DataFrame:
    """of and out: what is made of the shingle codes of each row's text."""
    k = linking.words
    state: dict = {}

    def kernel(cols: dict[str, list]) -> dict[str, list]:
        known, found = state.setdefault("known", Words()), []
        for text in cols["text"]:
            words = text.encode("utf-8", "surrogatepass").lower().split()
            found.append(made(shingle_codes(known.of(words), k)))
        return {of: cols[of], out: found}

    return map_arrow(rows.select(of, "text"), kernel, f"{of} {dict(rows.dtypes)[of]}, {out} array<bigint>")


def _codes(keys: DataFrame, texts: DataFrame, linking: Linking) -> tuple[DataFrame, DataFrame]:
    """key, node of the keys, and node, code of all their shingles."""
    ids = materialize(keys.withColumn("node", F.monotonically_increasing_id()), "ids")
    return ids, _coded(ids.join(texts, "key"), linking, "node", "codes").select("node", F.explode("codes").alias("code"))


def _alone(keys: DataFrame, texts: DataFrame, linking: Linking) -> DataFrame:
    """key, alone: how many of its shingles no other of the keys has."""
    ids, codes = _codes(keys, texts, linking)
    once = codes.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).where("n = 1")
    return materialize(ids.join(once.groupBy("node").agg(F.count(F.lit(1)).alias("alone")), "node", "left").select("key", F.coalesce("alone", F.lit(0)).alias("alone")), "alone")


def _rarest(keys: DataFrame, texts: DataFrame, linking: Linking) -> tuple[DataFrame, DataFrame]:
    """band (a shingle), key, n_shingles, and key, rare (the first FIRST of its bands): each key's rarest shingles, as many as a linked pair must share one of; those of one key alone are left out."""
    ids, codes = _codes(keys, texts, linking)
    codes = materialize(codes, "codes")
    shared = codes.join(codes.groupBy("code").agg(F.count(F.lit(1)).alias("often")).where("often > 1"), "code")
    own = Window.partitionBy("node")
    ranked = shared.select("node", "code", F.row_number().over(own.orderBy("often", "code")).alias("place"), F.count(F.lit(1)).over(own).alias("n_shared"))
    first = F.col("n_shingles") - F.ceil(linking.percent * F.col("n_shingles") / 100) + 1
    kept = ranked.join(ids, "node").where(F.col("n_shingles") - F.col("n_shared") + F.col("place") <= first)
    kept = materialize(kept.select(F.col("code").alias("band"), "key", "n_shingles", "place"), "rarest")
    named = kept.where(F.col("place") <= FIRST).groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "band"))), lambda x: x.band).alias("rare"))
    return kept.select("band", "key", "n_shingles"), named


def some_bits(registers: np.ndarray) -> np.ndarray:
    """BITS hashed bits of each register: for each 64 registers a long of first bits, one of second bits and so on."""
    h = (registers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
    planes = [np.packbits((h >> np.uint64(bit) & np.uint64(1)).astype(np.uint8), axis=1).view("<i8") for bit in range(BITS)]
    return np.stack(planes, 2).reshape(len(registers), -1)


def least_agreeing(linking: Linking, n: int = BANDS * ROWS) -> int:
    """The most registers that can be asked to agree in these bits while a pair at the threshold is lost with MISSED at most."""
    by_chance = 0.5**BITS
    q, total = by_chance + (1 - by_chance) * linking.percent / 100, 0.0
    for at in range(n + 1):
        total += math.comb(n, at) * q**at * (1 - q) ** (n - at)
        if total > MISSED:
            return at
    return n


def _with_bits(keys: DataFrame, nodes: DataFrame, texts: DataFrame, linking: Linking) -> DataFrame:
    """key, bits, odd."""
    kernel = lambda c: {"key": c["key"], "bits": list(some_bits(np.frombuffer(b"".join(c["registers"]), "<u2").reshape(-1, BANDS * ROWS)))}
    bits = map_arrow(keys.join(nodes, "key").select("key", "registers"), kernel, "key binary, bits array<bigint>")
    return bits.join(_coded(keys.join(texts, "key"), linking, "key", "odd", parities), "key")


def _close(a: str, b: str, n_a: str, n_b: str, linking: Linking) -> Column:
    """Whether parities allow a link: with x elements in one of two sets only, 100 * (n - x) >= percent * (n + x) for n = both sizes."""
    differ = sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(ODD // 64)), F.lit(0))
    return differ * (100 + linking.percent) <= (100 - linking.percent) * (F.col(n_a) + F.col(n_b))


def _agreeing(a: str, b: str) -> Column:
    """How many registers agree in all these bits."""
    differ = lambda i: F.col(a)[i].bitwiseXOR(F.col(b)[i])

    def differing(at: int) -> Column:
        out = differ(at)
        for i in range(at + 1, at + BITS):
            out = out.bitwiseOR(differ(i))
        return out

    return sum((F.bit_count(F.bitwise_not(differing(i))) for i in range(0, BITS * BANDS * ROWS // 64, BITS)), F.lit(0))


def _linkable(mixed: DataFrame, alone: DataFrame, linking: Linking) -> DataFrame:
    """mixed with alone, without those whose shared shingles are too few for any link."""
    return mixed.join(alone, "key").where(100 * (F.col("n_shingles") - F.col("alone")) >= linking.percent * F.col("n_shingles"))


def _may_link(n: str, alone: str, o_n: str, o_alone: str, linking: Linking) -> Column:
    """Whether two sets could be linked: they share at most what either shares with anyone."""
    most = F.least(F.col(n) - F.col(alone), F.col(o_n) - F.col(o_alone))
    return 100 * most >= linking.percent * (F.col(n) + F.col(o_n) - most)


def classes(docs: DataFrame, linking: Linking) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id: one row for each document."""
    found = materialize(features(docs, linking), "features")
    nodes = found.where("key is not null").groupBy("key").agg(F.min(F.struct("doc_id", "text_hash", "n_shingles", "registers")).alias("s")).select("key", "s.*")
    nodes = materialize(nodes, "nodes")
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.expr("registers").substr(i * (2 * ROWS) + 1, F.lit(2 * ROWS)))))
    bands = nodes.select("key", "n_shingles", band.alias("band"))
    buckets = bands.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("key").alias("center")).where("size > 1")
    members = materialize(bands.join(buckets, "band").select("band", "key", "n_shingles", "center"), "members")
    wanted = members.select("key").distinct().join(nodes.select("key", "doc_id", "text_hash"), "key")
    source = docs.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__th"), "text").where("text is not null")
    texts = materialize(source.join(wanted, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__th") == F.col("text_hash"))).select("key", "text").dropDuplicates(["key"]), "texts")

    labels = materialize(members.select("key").distinct().withColumn("label", F.col("key")), "labels")
    pairs = members.groupBy(F.col("key").alias("a")).agg(F.min("center").alias("b")).where("a != b")
    labels = _merged(labels, verified(pairs, nodes, texts, linking))

    mixed = _mixed(members.select("band", "key", "n_shingles"), labels)
    alone = _alone(mixed.select("key").distinct(), texts, linking)
    mixed = _linkable(mixed, alone, linking)
    typical = F.min_by(F.struct(F.col("key").alias("b"), F.col("label").alias("lb"), F.col("n_shingles").alias("nb"), F.col("alone").alias("ab")), F.struct(F.col("alone") / F.col("n_shingles"), F.xxhash64("band", "key"), "key"))
    pairs = mixed.join(mixed.groupBy("band").agg(typical.alias("c")).select("band", "c.*"), "band")
    pairs = pairs.where((F.col("label") != F.col("lb")) & _may_link("n_shingles", "alone", "nb", "ab", linking)).select(F.least("key", "b").alias("a"), F.greatest("key", "b").alias("b")).distinct()
    labels = _merged(labels, verified(pairs, nodes, texts, linking))

    mixed = _linkable(_mixed(members.select("band", "key", "n_shingles"), labels), alone, linking)
    keys = mixed.select("key", "n_shingles", "alone").distinct()
    rarest, named = _rarest(keys.drop("alone"), texts, linking)
    mixed = materialize(_mixed(rarest, labels).join(keys.drop("n_shingles"), "key").join(named, "key", "left").join(_with_bits(keys.select("key"), nodes, texts, linking), "key"), "meeting")
    rest = mixed.where("label != main").select(F.col("band").alias("o_band"), F.col("key").alias("o_key"), F.col("n_shingles").alias("o_n"), F.col("alone").alias("o_alone"), F.col("label").alias("o_label"), F.col("bits").alias("o_bits"), F.col("odd").alias("o_odd"), F.col("rare").alias("o_rare"))
    met = F.get(F.array_intersect("rare", "o_rare"), F.lit(0))
    once = F.coalesce(met == F.col("band"), F.lit(True))
    like = (_agreeing("bits", "o_bits") >= least_agreeing(linking)) & _may_link("n_shingles", "alone", "o_n", "o_alone", linking) & _close("odd", "o_odd", "n_shingles", "o_n", linking)
    pairs = mixed.join(rest, (F.col("band") == F.col("o_band")) & (F.col("label") != F.col("o_label")) & like & once & ((F.col("label") == F.col("main")) | (F.col("key") < F.col("o_key"))))
    pairs = pairs.select(F.least("key", "o_key").alias("a"), F.greatest("key", "o_key").alias("b")).distinct()
    labels = _merged(labels, verified(pairs, nodes, texts, linking))

    least = nodes.select("key", "doc_id").join(labels, "key", "left").select("key", F.coalesce("label", "key").alias("label"), "doc_id")
    names = least.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    by_key = least.join(names, "label").select("key", "component_id")
    return found.join(by_key, "key", "left").select("doc_id", "text_hash", "n_shingles", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, linking: Linking) -> DataFrame:
    """One document of each class, the one of least id; of rows equal in id and text one stays."""
    found = materialize(classes(docs, linking), "classes")
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "text_hash").distinct()
    named, back = set_aside(docs)
    named = named.withColumn("__hash", F.xxhash64(back["text"]))
    kept = named.join(gone, named[back["doc_id"]].eqNullSafe(gone["doc_id"]) & (named["__hash"] == gone["text_hash"]), "left_anti")
    if found.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates([back["doc_id"], "__hash"])
    return kept.select(*(F.col(n).alias(c) for c, n in back.items()))


def op6_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"), Linking(words=3, percent=85))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
s as (select distinct doc_id, words[i : i + 2] as gram from d, unnest(range(1, greatest(len(words) - 2, 1) + 1)) t(i) where len(words) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.gram = b.gram and a.doc_id < b.doc_id group by all),
e as (select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where 100 * c >= 85 * (x.n + y.n - c)),
l as (select a, b from e union select b, a from e),
r as (select doc_id, doc_id as other from d union select r.doc_id, l.b from r join l on r.other = l.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.component_id, d.doc_id = m.component_id as kept
from d left join n on d.doc_id = n.doc_id join (select doc_id, min(other) as component_id from r group by doc_id) m on d.doc_id = m.doc_id
"""
