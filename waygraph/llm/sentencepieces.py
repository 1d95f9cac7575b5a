"""SentencePiece encoding and decoding as relations.

Text is normalised as the model asks (a space becomes the word mark, one goes in
front) and parted into units at every place that no piece spans: before a run of
word marks, and between two characters that no piece holds side by side.  Distinct
units are exploded into their substrings of bounded length, which are equi-joined to
the piece table; the matching edges are grouped by unit and folded by Spark's
higher-order aggregate.

Documents are gathered into blocks, each a row with its documents as numbers of
units.  The HEAD most frequent units of a bounded sample are encoded first and
travel to every task; all others are named in their block's row.  These are encoded
once each, meet the blocks that name them, and the ids are read off.  So what is
moved is the numbered text once and the rarer units, never the text itself; which
units are in the head changes nothing but the time.

The fold follows the model's kind.  For a unigram model it is Viterbi: the best
score of each end.  A BPE model's scores are merge ranks, and the best sum of ranks
is not what the library returns, so there the fold goes over the edges by rank and
merges where an edge spans two neighbouring pieces; a unit where an edge spanned
more at its turn is folded again, the best edge that spans two at a time.  That is
the library's segmentation.  A BPE state is one long: a bit for each place where a
piece begins or ends.  Units of more than MOST_BITS characters, such as long runs of
spaces, take the same merges from a heap.  Characters without a piece fall back to
their bytes.

Defined results: null and empty texts have no pieces; repeated rows are encoded one
by one; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waygraph.llm.common import Shared, bounded_batches, give_back, map_arrow, materialize, sampled, table

MARK = "▁"
#: Units that travel to every task, and documents of the sample that they are taken from, at most.
HEAD, HEAD_SAMPLE = 200_000, 20_000
#: A block is closed once it has so many words.
BLOCK_WORDS = 250_000
KEPT_UNITS = 50_000
#: Places of a unit that a long has bits for.
MOST_BITS = 62
ALL_BITS = (1 << 63) - 1
#: Units, in whole documents, that are decoded at a time.
SLICE = 100_000
PRIME = (1 << 31) - 1
BASE = 1_000_003
UNKNOWN_SCORE = -1e4


@dataclass(frozen=True)
class PieceModel:
    """Pieces by id, their scores, and the ids of byte pieces."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    bytes_at: tuple[int, ...]
    unknown: int
    kind: str
    prefix: bool = True

    @staticmethod
    def load(path: str) -> PieceModel:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec, kinds = proto.normalizer_spec, pb.ModelProto.SentencePiece
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models without character maps that keep all white space")
        plain = [p.type in (kinds.NORMAL, kinds.USER_DEFINED) for p in proto.pieces]
        by_byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        unknown = next(i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN)
        return PieceModel(
            tuple(p.piece if ok else "" for p, ok in zip(proto.pieces, plain, strict=True)),
            tuple(p.score for p in proto.pieces),
            tuple(by_byte[b] for b in range(256)) if len(by_byte) == 256 else (),
            unknown,
            "bpe" if proto.trainer_spec.model_type == 2 else "unigram",
            spec.add_dummy_prefix,
        )

    def normal(self, text: str | None) -> str:
        return (MARK * self.prefix + text.replace(" ", MARK)) if text else ""

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces))

    def neighbours(self) -> frozenset[str]:
        return frozenset(p[i : i + 2] for p in self.pieces for i in range(len(p) - 1))


class Splitter:
    """Words of texts, and their units."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        pairs = model.neighbours()
        self.pairs = np.unique(np.array([ord(p[0]) << 21 | ord(p[1]) for p in pairs] or [-1], np.int64))
        # where no piece goes on over a word mark or a line's end, words can be cut there
        self.plain = model.prefix and not any("\n" in p or (p[1] == MARK and p[0] != MARK) for p in pairs)

    def words(self, text: str) -> list[str]:
        """Parts of a text; spelled gives what they stand for."""
        if not self.plain:
            return [self.model.normal(text)]
        text = text.replace(MARK, " ").replace("\n", " \n")
        if "  " not in text and text[0] != " ":
            return text.split(" ")
        # a run of marks goes with the word behind it; the blank before a line's end isn't in the text
        return [w[1:] if w[0] == " " else w for w in re.findall(r" +[^ \n]*|\n[^ \n]*", (" " + text).replace(" \n", "\n"))]

    def spelled(self, words: list[str]) -> list[str]:
        return [w if w[:1] == "\n" else MARK + w.replace(" ", MARK) for w in words] if self.plain else words

    def units(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """The units of all words in order, and how many each word has."""
        spelled = self.spelled(words)
        joined, sizes = "".join(spelled), np.fromiter(map(len, spelled), np.int64, len(spelled))
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        if not len(code):
            return [], np.zeros(len(words), np.int64)
        pair = code[:-1] << 21 | code[1:]
        begins = np.ones(len(code), bool)
        begins[1:] = self.pairs[np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)] != pair
        first = np.cumsum(sizes) - sizes
        begins[first[sizes > 0]] = True
        at = np.flatnonzero(begins)
        cuts = at.tolist() + [len(joined)]
        before = np.concatenate([[0], np.cumsum(begins)])
        return [joined[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], before[first + sizes] - before[first]


def piece_table(spark: SparkSession, model: PieceModel) -> DataFrame:
    """code (hash of the piece), piece, id, score, rank (of the score, the best first); its size is the vocabulary's."""
    rows = [(p, i, float(s)) for i, (p, s) in enumerate(zip(model.pieces, model.scores, strict=True)) if p]
    rank = np.unique([-r[2] for r in rows], return_inverse=True)[1]
    return spark.createDataFrame(pa.table({"piece": [r[0] for r in rows], "id": pa.array([r[1] for r in rows], pa.int32()), "score": [r[2] for r in rows], "rank": pa.array(rank, pa.int64())})).select(F.xxhash64("piece").alias("code"), "piece", "id", "score", "rank")


def unit_counts(docs: DataFrame, model: PieceModel) -> DataFrame:
    """unit, n: how often it occurs."""
    shared = Shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counts = Splitter(shared.value), Counter()

        def flush() -> pa.RecordBatch:
            units, many = split.units(list(counts))
            named: defaultdict[str, int] = defaultdict(int)
            for unit, n in zip(units, np.repeat(np.fromiter(counts.values(), np.int64, len(counts)), many).tolist(), strict=True):
                named[unit] += n
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(named), pa.string()), pa.array(list(named.values()), pa.int64())], ["unit", "n"])

        for batch in batches:
            for text in (x.as_py() for x in batch.column(0)):
                counts.update(split.words(text) if text else ())
                if len(counts) > KEPT_UNITS:
                    yield flush()
                    give_back()
        if counts:
            yield flush()
        give_back()

    return bounded_batches(docs.select("text")).mapInArrow(run, "unit string, n bigint").groupBy("unit").agg(F.sum("n").alias("n"))


def frequent_units(docs: DataFrame, model: PieceModel, head: int = HEAD) -> pa.Table:
    """unit, cut of the units that are most frequent in a sample of HEAD_SAMPLE documents: head rows at most, the most frequent first."""
    top = unit_counts(sampled(docs, HEAD_SAMPLE), model).orderBy(F.desc("n"), "unit").limit(head)
    top = materialize(top, "head")
    cut = folded(edges(top.select("unit"), piece_table(docs.sparkSession, model), model.longest, model.kind), ["unit"], model.kind)
    return top.join(cut, "unit", "left").orderBy(F.desc("n"), "unit").select("unit", "cut").toArrow()


def blocks(docs: DataFrame, model: PieceModel, known: Shared, words: int = BLOCK_WORDS) -> DataFrame:
    """block, check (of its texts), rare (units that aren't among the known ones, packed), and its documents: doc_ids, digests of their texts, sizes and places (packed numbers of units, the known ones first).

    known: the known units as one Arrow array, which has a tenth of a dictionary's size.
    """
    shared = Shared(docs.sparkSession, model)
    slim = docs.select("doc_id", "text")
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        split, head = Splitter(shared.value), known.value
        own: defaultdict[str, int] = defaultdict()
        own.default_factory = own.__len__
        ids, digests, rows, length, made = [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            units, many = split.units(list(own))
            rare: defaultdict[str, int] = defaultdict()
            rare.default_factory = lambda: len(head) + len(rare)
            number = pc.fill_null(pc.index_in(pa.array(units, pa.string()), value_set=head), -1).to_numpy().astype(np.int64)
            new = np.flatnonzero(number < 0)
            number[new] = np.fromiter((rare[units[i]] for i in new.tolist()), np.int64, len(new))
            # words to units, for all documents of the block at once
            row = np.concatenate(rows)
            size, start = many[row], (np.cumsum(many) - many)[row]
            ends = np.cumsum(size)
            place = number[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
            sizes = np.diff(np.concatenate([[0], ends])[np.cumsum([0, *map(len, rows)])])
            own.clear()
            check = xxhash.xxh32_intdigest(b"".join(digests)) >> 1
            columns = [([TaskContext.get().partitionId() << 32 | made], pa.int64()), ([check], pa.int64()), ([packed_texts(list(rare))], pa.binary()), ([ids], pa.list_(id_type)), ([digests], pa.list_(pa.binary())), ([sizes.astype("<i8").tobytes()], pa.binary()), ([packed(place)], pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns], ["block", "check", "rare", "doc_ids", "digests", "sizes", "places"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            # one text at a time: as lists, a batch's texts take several times its size
            for doc_id, text in ((i.as_py(), x.as_py()) for i, x in zip(batch.column(0), batch.column(1), strict=True)):
                parts = split.words(text) if text else []
                ids.append(doc_id)
                digests.append(xxhash.xxh3_128_digest((text or "").encode("utf-8", "surrogatepass")))
                rows.append(np.fromiter(map(own.__getitem__, parts), np.int32, len(parts)))
                length += len(parts) + 1
                if length >= words:
                    yield close()
                    ids, digests, rows, length, made = [], [], [], 0, made + 1
                    give_back()
        if ids:
            yield close()
        batch, ids, digests, rows = None, [], [], []
        give_back()

    return bounded_batches(slim).mapInArrow(run, f"block bigint, check bigint, rare binary, doc_ids array<{kind}>, digests array<binary>, sizes binary, places binary")


def packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2 ** 32 as two planes of 16 bits, compressed."""
    planes = np.concatenate([(numbers & 0xFFFF).astype("<u2"), (numbers >> 16).astype("<u2")]).tobytes()
    return np.int64(len(numbers)).tobytes() + pa.Codec("zstd", compression_level=3).compress(planes, asbytes=True)


def packed_texts(texts: list[str]) -> bytes:
    """Texts as their lengths and their characters behind each other, both compressed."""
    lengths = packed(np.fromiter(map(len, texts), np.int64, len(texts)))
    joined = "".join(texts).encode("utf-8", "surrogatepass")
    return np.array([len(lengths), len(joined)], np.int64).tobytes() + lengths + pa.Codec("zstd", compression_level=3).compress(joined, asbytes=True)


def unpacked_texts(data: bytes) -> list[str]:
    n, size = np.frombuffer(data[:16], np.int64).tolist()
    joined = pa.Codec("zstd").decompress(data[16 + n :], size, asbytes=True).decode("utf-8", "surrogatepass")
    ends = [0, *np.cumsum(unpacked(data[16 : 16 + n])).tolist()]
    return [joined[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def unpacked(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data[:8], np.int64)[0])
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[8:], 4 * n, asbytes=True), "<u2").astype(np.int64)
    return planes[:n] | planes[n:] << 16


def spans(units: DataFrame, longest: int, shortest: int) -> DataFrame:
    """units with s, e and sub: their substrings of shortest to longest characters; a unit too short for these goes."""
    size = F.char_length("unit")
    starts = F.when(size >= shortest, F.sequence(F.lit(0), size - shortest))
    both = units.withColumn("s", F.explode(starts)).withColumn("e", F.explode(F.sequence(F.col("s") + shortest, F.least(size, F.col("s") + longest))))
    return both.withColumn("sub", F.col("unit").substr(F.col("s") + 1, F.col("e") - F.col("s")))


def edges(units: DataFrame, pieces: DataFrame, longest: int, kind: str) -> DataFrame:
    """units with edge, a row for each substring that is a piece.

    For a BPE model an edge is a long of rank, start and end, of two characters at
    least; longer units than a long has bits for have none.  Else it is a struct
    (e, s, cost), and each character without a piece has one.
    """
    bpe = kind == "bpe"
    found = spans(units.where(F.char_length("unit") <= MOST_BITS) if bpe else units, longest, 2 if bpe else 1)
    # the vocabulary bounds the broadcast side; pieces meet by a hash and are compared after
    both = found.withColumn("at", F.xxhash64("sub")).join(F.broadcast(pieces.select("code", "piece", "rank", "score")), F.col("at") == F.col("code"), "inner" if bpe else "left")
    same = F.coalesce(F.col("sub") == F.col("piece"), F.lit(False))
    if bpe:
        both, edge = both.where(same), F.col("rank") * (1 << 12) + F.col("s") * (1 << 6) + F.col("e")
    else:
        both, edge = both.where(same | (F.col("e") == F.col("s") + 1)), F.struct("e", "s", F.when(same, -F.col("score")).otherwise(F.lit(-UNKNOWN_SCORE)).alias("cost"))
    return both.select(*units.columns, edge.alias("edge"))


def _merges(mask: Column, edge: Column) -> tuple[Column, Column]:
    """The bits strictly within the edge, and how many pieces it spans less one; 0 where it doesn't begin and end with pieces."""
    one, s, e = F.lit(1).cast("long"), F.shiftright(edge, 6).bitwiseAND(63).cast("int"), edge.bitwiseAND(63).cast("int")
    left, right = F.call_function("shiftleft", one, s), F.call_function("shiftleft", one, e)
    within, both = right - left * 2, left + right
    return within, F.when(mask.bitwiseAND(both) == both, F.bit_count(mask.bitwiseAND(within))).otherwise(0)


def merge_fold(found: Column) -> Column:
    """Bits where a unit's pieces begin and end, from its sorted edges; the sign's bit says that an edge spanned more than two pieces at its turn.

    Only such an edge could still merge later, so without one this is the library's result.
    """

    def step(mask: Column, edge: Column) -> Column:
        within, more = _merges(mask, edge)
        return F.when(more == 1, mask.bitwiseAND(F.bitwise_not(within))).when(more > 1, mask.bitwiseOR(F.lit(-(1 << 63)))).otherwise(mask)

    return F.aggregate(found, F.lit(ALL_BITS), step)


def waiting_fold(found: Column) -> Column:
    """The same bits, by merging the first of the sorted edges that spans two pieces, time and again."""

    def step(mask: Column, _: Column) -> Column:
        ready = F.get(F.filter(found, lambda x: _merges(mask, x)[1] == 1), F.lit(0))
        return F.when(ready.isNull(), mask).otherwise(mask.bitwiseAND(F.bitwise_not(_merges(mask, ready)[0])))

    return F.aggregate(F.sequence(F.lit(1), F.array_max(F.transform(found, lambda x: x.bitwiseAND(63).cast("int")))), F.lit(ALL_BITS), step)


def viterbi_fold(found: Column) -> Column:
    """Starts of the pieces on the path of least cost, from edges sorted by end and start."""
    state = "array<struct<cost:double,e:int,path:array<int>>>"
    start = F.array(F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("e"), F.array().cast("array<int>").alias("path"))).cast(state)

    def step(now: Column, x: Column) -> Column:
        # the best path to each end; an edge's ends come in order, so all paths to its start are known
        before = F.get(F.filter(now, lambda p: p.e == x.s), F.lit(0))
        path = F.struct((before.cost + x.cost).alias("cost"), x.e.alias("e"), F.concat(before.path, F.array(x.s)).alias("path"))
        have = F.get(F.filter(now, lambda p: p.e == x.e), F.lit(0))
        better = F.when(have.isNull() | (path.cost < have.cost), path).otherwise(have)
        return F.concat(F.filter(now, lambda p: p.e != x.e), F.array(better)).cast(state)

    return F.aggregate(found, start, step, lambda now: F.array_max(F.transform(now, lambda p: F.struct(p.e.alias("e"), p.path.alias("path")))).path)


def folded(found: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """keys, cut: the fold of the edges of each unit, a long of bits or an array of starts."""
    unit = found.groupBy(*keys).agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    if kind != "bpe":
        return unit.select(*keys, viterbi_fold(F.col("edges")).alias("cut"))
    unit = unit.withColumn("cut", merge_fold(F.col("edges")))
    return unit.select(*keys, F.when(F.col("cut") < 0, waiting_fold(F.col("edges"))).otherwise(F.col("cut")).alias("cut"))


def merge_long(unit: str, rank: dict[str, tuple[float, int]], longest: int) -> list[dict]:
    """The same merges for long units: the merge of least cost, then of least start, from a heap."""
    import heapq

    n = len(unit)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    end = list(range(1, n + 1))
    alive = [True] * n
    ids = [rank.get(c, (0.0, -1))[1] for c in unit]
    heap: list = []

    def offer(a: int) -> None:
        b = nxt[a]
        if b < n and end[b] - a <= longest and (hit := rank.get(unit[a : end[b]])):
            heapq.heappush(heap, (hit[0], a, end[b], hit[1]))

    for a in range(n):
        offer(a)
    while heap:
        _, a, e, i = heapq.heappop(heap)
        if not alive[a] or nxt[a] >= n or end[nxt[a]] != e or end[a] >= e:
            continue
        b = nxt[a]
        alive[b] = False
        end[a], nxt[a], ids[a] = e, nxt[b], i
        if nxt[b] < n:
            prv[nxt[b]] = a
        offer(a)
        if prv[a] >= 0:
            offer(prv[a])
    out, a = [], 0
    while a < n:
        out.append({"s": a, "e": end[a], "id": ids[a]})
        a = nxt[a]
    return out


class Assembler:
    """Ids of units from their folds."""

    def __init__(self, model: PieceModel) -> None:
        self.model, self.longest = model, model.longest
        self.number = {p: i for i, p in enumerate(model.pieces) if p}

    @cached_property
    def rank(self) -> dict[str, tuple[float, int]]:
        return {p: (-s, i) for i, (p, s) in enumerate(zip(self.model.pieces, self.model.scores, strict=True)) if p}

    def starts(self, units: list[str], sizes: np.ndarray, cuts: pa.Array) -> np.ndarray:
        """Where pieces begin in the joined units; a unit without a fold is cut into its characters."""
        first = np.cumsum(sizes) - sizes
        if self.model.kind != "bpe":
            every = zip(first.tolist(), sizes.tolist(), cuts.to_pylist(), strict=True)
            return np.concatenate([np.zeros(0, np.int64), *(f + np.array(range(n) if c is None else c, np.int64) for f, n, c in every)])
        short = np.where(sizes <= MOST_BITS, sizes, 0)
        bits = np.unpackbits(cuts.fill_null(ALL_BITS).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, col = np.nonzero(bits & (np.arange(64) < short[:, None]))
        out = [first[row] + col]
        for i in np.flatnonzero(sizes > MOST_BITS).tolist():
            out.append(first[i] + np.array([p["s"] for p in merge_long(units[i], self.rank, self.longest)], np.int64))
        return np.sort(np.concatenate(out))

    def __call__(self, units: list[str], cuts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All units' ids in order, and how many each has."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        joined, at = "".join(units), self.starts(units, sizes, cuts)
        ends = at.tolist() + [len(joined)]
        pieces = [joined[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        ids = np.fromiter((self.number.get(p, -1) for p in pieces), np.int32, len(pieces))
        many, spelled = np.ones(len(ids), np.int64), {}
        for i in np.flatnonzero(ids < 0).tolist():
            spelled[i] = [self.model.bytes_at[b] for b in pieces[i].encode("utf-8", "surrogatepass")] if self.model.bytes_at else [self.model.unknown]
            many[i] = len(spelled[i])
        before = np.concatenate([[0], np.cumsum(many)])
        flat = np.repeat(ids, many)
        for i, codes in spelled.items():
            flat[before[i] : before[i + 1]] = codes
        return flat, np.diff(before[np.searchsorted(at, np.concatenate([[0], np.cumsum(sizes)]), "left")])


class Decoder:
    """Texts of piece ids; byte pieces are joined to characters."""

    def __init__(self, model: PieceModel) -> None:
        self.prefix = model.prefix
        self.spelled = [p.replace(MARK, " ").encode() for p in model.pieces]
        for b, i in enumerate(model.bytes_at):
            self.spelled[i] = bytes([b])

    def __call__(self, ids: list[int]) -> str:
        text = b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


def decode(rows: DataFrame, model: PieceModel, column: str = "ids") -> DataFrame:
    """doc_id and text of encoded rows."""
    shared = Shared(rows.sparkSession, model)
    state: dict = {}

    def kernel(cols: dict[str, list]) -> dict[str, list]:
        spell = state.setdefault("d", Decoder(shared.value))
        return {"doc_id": cols["doc_id"], "text": [spell(ids or []) for ids in cols[column]]}

    return map_arrow(rows.select("doc_id", column), kernel, f"doc_id {dict(rows.dtypes)['doc_id']}, text string")


def _encoded(docs: DataFrame, model: PieceModel, head: int, words: int, finish: Callable[[PieceModel, list, list, np.ndarray], dict[str, pa.Array]], columns: str) -> DataFrame:
    """doc_id, ids, and the columns that finish makes from documents' digests, ids and numbers of units."""
    spark = docs.sparkSession
    top = frequent_units(docs, model, head).combine_chunks()
    units = top["unit"].combine_chunks().cast(pa.string())
    # the first step needs the known units, the last one their ids behind each other and how many each has
    known, spelled = Shared(spark, units), Shared(spark, Assembler(model)(units.to_pylist(), top["cut"].combine_chunks()))
    shared = Shared(spark, model)
    # both readers of this take all its columns, so that one shuffle serves both
    moved = blocks(docs, model, known, words).repartition("block")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, check, rare in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                units = unpacked_texts(rare)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(units), block)), pa.array(check << 32 | np.arange(len(units))), pa.array(units, pa.string())], ["block", "place", "unit"])
                give_back()

    named = bounded_batches(moved).mapInArrow(name, "block bigint, place bigint, unit string")
    cut = folded(edges(named.select("unit").distinct(), piece_table(spark, model), model.longest, model.kind), ["unit"], model.kind)
    codes = named.join(cut, "unit").groupBy("block").agg(F.collect_list(F.struct("place", "cut")).alias("cuts"))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, head = shared.value, spelled.value
        assemble = Assembler(model)
        for batch in batches:
            for at in range(batch.num_rows):
                yield from give(model, head, assemble, {n: batch.column(i)[at] for i, n in enumerate(batch.schema.names)})
                give_back()

    def give(model: PieceModel, head: tuple[np.ndarray, np.ndarray], assemble: Assembler, row: dict[str, pa.Scalar]) -> Iterator[pa.RecordBatch]:
        units, cuts = unpacked_texts(row["rare"].as_py()), row["cuts"].values
        found = np.full(len(units), -1, np.int64)
        if row["cuts"].is_valid:
            place = cuts.field("place").to_numpy()
            # were the documents read twice and parted otherwise, the units would be others
            if (place >> 32 != row["check"].as_py()).any():
                raise RuntimeError("the documents changed between two readings of them")
            found[place & 0xFFFFFFFF] = np.arange(len(cuts))
            cuts = cuts.field("cut").take(pa.array(found, mask=found < 0))
        else:
            cuts = pa.nulls(len(units), pa.int64())
        flat, many = assemble(units, cuts)
        flat, many = np.concatenate([head[0], flat]), np.concatenate([head[1], many])
        start, places = np.cumsum(many) - many, unpacked(row["places"].as_py())
        sizes = np.frombuffer(row["sizes"].as_py(), "<i8")
        stops = np.concatenate([[0], np.cumsum(sizes)])
        doc_ids, digests = row["doc_ids"].values, row["digests"].values.to_pylist()
        # few documents at a time, as each is held as ids and text
        cuts = np.searchsorted(stops, np.arange(0, stops[-1] + SLICE, SLICE), "left").clip(0, len(sizes))
        for at, end in itertools.pairwise(np.unique([0, *cuts.tolist(), len(sizes)]).tolist()):
            place = places[stops[at] : stops[end]]
            size = many[place]
            ends = np.cumsum(size)
            ids = flat[np.repeat(start[place] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
            offsets = np.concatenate([[0], ends])[stops[at : end + 1] - stops[at]]
            made = finish(model, digests[at:end], [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)], sizes[at:end])
            codes = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([doc_ids.slice(at, end - at), codes, *made.values()], ["doc_id", "ids", *made])

    return bounded_batches(moved.join(codes, "block", "left")).mapInArrow(run, f"doc_id {kind}, ids array<int>{columns}")


def encode(docs: DataFrame, model: PieceModel, head: int = HEAD, words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, ids: the documents' piece ids, in order."""
    return _encoded(docs, model, head, words, lambda *_: {}, "")


def ids_code(ids: np.ndarray, powers: np.ndarray) -> int:
    """Sum of (id + 1) * BASE ** place, modulo PRIME."""
    return int(((ids.astype(np.int64) + 1) * powers[: len(ids)] % PRIME).sum() % PRIME)


def powers_to(n: int) -> np.ndarray:
    """BASE ** place modulo PRIME of n places, by doubling."""
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate([out, out * pow(BASE, len(out), PRIME) % PRIME])
    return out


def encode_counts(docs: DataFrame, model: PieceModel, head: int = HEAD, words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, ids, decoded (their text), n_units, n_pieces, n_bytes (byte pieces), ids_code (of the ids and their order), restored (whether decoded is the whole text, by 128 bits of both; null counts as empty)."""
    state: dict = {}

    def finish(model: PieceModel, digests: list, ids: list, counts: np.ndarray) -> dict[str, pa.Array]:
        import xxhash

        spell = state.setdefault("d", Decoder(model))
        is_byte = np.zeros(len(model.pieces), np.int64)
        is_byte[list(model.bytes_at)] = 1
        if len(state.get("powers", ())) < (most := max(map(len, ids), default=0)):
            state["powers"] = powers_to(most)
        decoded = [spell(i.tolist()) for i in ids]
        return {
            "decoded": pa.array(decoded, pa.string()),
            "n_units": pa.array(counts, pa.int64()),
            "n_pieces": pa.array([len(i) for i in ids], pa.int64()),
            "n_bytes": pa.array([int(is_byte[i].sum()) for i in ids], pa.int64()),
            "ids_code": pa.array([ids_code(i, state["powers"]) if len(i) else 0 for i in ids], pa.int64()),
            "restored": pa.array([xxhash.xxh3_128_digest(d.encode("utf-8", "surrogatepass")) == t for d, t in zip(decoded, digests, strict=True)], pa.bool_()),
        }

    return _encoded(docs, model, head, words, finish, ", decoded string, n_units bigint, n_pieces bigint, n_bytes bigint, ids_code bigint, restored boolean")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_counts(table(spark, sf_dir, "documents"), PieceModel.load(model_path()))
