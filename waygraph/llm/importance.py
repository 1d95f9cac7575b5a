"""Importance resampling of documents towards a target's words.

Words fall into buckets by their CRC; a bucket's gain is the logarithm of its share in
the target over its share in the corpus, both smoothed.  The gains are one array of as
many longs as there are buckets, from which a document's weight, their floored mean, is
scored.  Weight plus Gumbel noise that comes from the document's id is its score, and
the highest scores are drawn: a draw without replacement in proportion to the weights.

The draw.  Each partition's eligible rows are written as a run, sorted by score.  Scores
are integers of a bounded range, so their exact counts tell the score at which the draw
ends, and cut the drawn range into segments of SEGMENT rows; a score with more rows than
that is cut further by id, and rows of one id by their place.  A segment's rows come from all runs
through one shuffle, whose external sort keeps each run together and in order; a tournament tree
merges them, ranks go out in that order, and the last segment stops after the exact count.

Defined results: a null text has no words and weight 0; documents under least_words keep weight and score,
and are never drawn; a null id is text of no length in the noise and comes last among equal scores; repeated rows are rows of their own;
an empty table gives an empty result, an empty target is smoothing alone; other columns aren't read.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waygraph.llm.common import Shared, bounded_batches, shared_dir, table

#: Rows that one merge holds, and most tasks of merges: a task merges segment after segment.
SEGMENT, TASKS = 10_000, 20_000
#: Bytes of a text whose words are held at once.
PIECE = 1 << 20
#: A-Z to a-z, and all that parts words to a space.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_APART = bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80))
_CLEAN = bytes(c if c not in _APART else 32 for c in range(256))


@dataclass(frozen=True)
class Resampling:
    buckets: int = 10_000
    longest: int = 1
    percent: int = 10
    least_words: int = 20
    seed: int = 2024


def word_pieces(text: str | None, longest: int) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about PIECE bytes; each but the first begins with the longest - 1 words before it."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    at, kept = 0, []
    while at < len(raw):
        end = at + PIECE
        while end < len(raw) and (raw[end] >= 0x80 or raw[end] not in _APART):
            end += 1
        words = raw[at:end].translate(_LOWER).translate(_CLEAN).split()
        yield kept + words
        kept, at = (kept + words)[len(kept + words) - (longest - 1) :] if longest > 1 else [], end


def features(text: str | None, r: Resampling) -> Iterator[np.ndarray]:
    """Buckets of all runs of 1 to longest consecutive words, in pieces."""
    first = True
    for words in word_pieces(text, r.longest):
        crc = [zlib.crc32(w) for w in words]
        seen = 0 if first else min(r.longest - 1, len(words))
        yield np.array(crc[seen:], np.int64) % r.buckets
        for n in range(2, r.longest + 1):
            # a run that lies in the words before was counted there
            starts = range(max(0, seen - n + 1), len(words) - n + 1)
            yield np.array([zlib.crc32(b" ".join(words[i : i + n])) for i in starts], np.int64) % r.buckets
        first = False


def bucket_counts(texts: DataFrame, r: Resampling) -> np.ndarray:
    """Features in each bucket over all texts: one array a partition, added up; buckets longs at the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(r.buckets, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                for got in features(text, r):
                    total += np.bincount(got, minlength=r.buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    found = bounded_batches(texts.select("text")).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(r.buckets, np.int64)
    total[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    s_all, t_all, k = float(corpus.sum()), float(target.sum()), float(len(corpus))
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, r: Resampling) -> DataFrame:
    """doc_id, n_words, n_features, weight of each document."""
    sent = Shared(docs.sparkSession, gain)
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                n = total = words = 0
                for i, got in enumerate(features(text, r)):
                    n, total = n + len(got), total + int(sent.value[got].sum())
                    words += len(got) if i % r.longest == 0 else 0
                rows.append((words, n, total // n if n else 0))
            cols = [pa.array([row[i] for row in rows], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *cols], schema=out)

    return bounded_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


class Tournament:
    """A tree of losers over k sorted runs; pop gives the least head's run and lets its next head play up the tree."""

    def __init__(self, runs: list[list[tuple]]) -> None:
        self.runs, self.at, self.k = runs, [0] * len(runs), len(runs)
        self.tree = [0] * max(1, self.k)
        winner = [0] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winner[2 * node], winner[2 * node + 1]
            winner[node], self.tree[node] = (a, b) if self._before(a, b) else (b, a)
        self.tree[0] = winner[1] if self.k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        """Whether run a's head goes before run b's; a run that is over goes last."""
        if self.at[b] >= len(self.runs[b]):
            return True
        return self.at[a] < len(self.runs[a]) and self.runs[a][self.at[a]] <= self.runs[b][self.at[b]]

    def pop(self) -> tuple | None:
        run = self.tree[0]
        if self.at[run] >= len(self.runs[run]):
            return None
        got = self.runs[run][self.at[run]]
        self.at[run] += 1
        node = (run + self.k) // 2
        while node:
            if self._before(self.tree[node], run):
                run, self.tree[node] = self.tree[node], run
            node //= 2
        self.tree[0] = run
        return got


def draw(scored: DataFrame, order: Column, count: int | None, percent: int, segment: int = SEGMENT) -> DataFrame:
    """scored (doc_id, score and other longs) with rank: 1, 2, ... of the rows where order holds, highest score first, ties to the smaller doc_id; null where undrawn.

    count rows are drawn, or percent of those that can be.
    """
    spark, columns = scored.sparkSession, scored.columns
    top = f"{shared_dir(spark)}/draw-{uuid.uuid4().hex}"
    runs = scored.withColumn("__open", F.coalesce(order, F.lit(False))).withColumn("__place", F.monotonically_increasing_id()).withColumn("__run", F.spark_partition_id())
    runs.sortWithinPartitions(~F.col("__open"), F.desc("score"), F.col("doc_id").asc_nulls_last()).write.parquet(f"{top}/runs")
    runs = spark.read.schema(runs.schema).parquet(f"{top}/runs")
    # as many longs as scores differ: gains and noise are bounded
    held = runs.where("__open").groupBy("score").count().toArrow().sort_by([("score", "descending")])
    score, n = held.column("score").to_pylist(), held.column("count").to_pylist()
    want = sum(n) * percent // 100 if count is None else min(count, sum(n))
    last, before = None, 0
    for s, c in zip(score, n, strict=True):
        if before >= want:
            break
        last, before = s, before + c
    if last is None:
        return runs.select(*columns, F.lit(None).cast("bigint").alias("rank"))
    inside = F.col("__open") & (F.col("score") >= last)
    # cuts: scores of few rows go together; those of many are cut by id, then rows of one id by place
    cuts, at, filled = {}, -1, segment
    for s, c in zip(score, n, strict=True):
        if s < last:
            break
        if c > segment or filled + c > segment:
            at, filled = at + 1, 0
        cuts[s], filled = at, segment if c > segment else filled + c
    large = [s for s, c in zip(score, n, strict=True) if c > segment and s >= last]
    # bounded like the scores
    by_score = F.broadcast(spark.createDataFrame(list(cuts.items()), "score bigint, __cut int"))
    chosen = runs.where(inside).join(by_score, "score")
    chosen = chosen.withColumn("__sub", F.lit(0)).withColumn("__part", F.lit(0))
    if large:
        chosen = _split(chosen, large, segment)
    key = ["__cut", "__sub", "__part"]
    sizes = chosen.groupBy(*key).count()
    starts = sizes.select(*key, F.coalesce(F.sum("count").over(Window.orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    ready = chosen.join(starts, key)
    parts = max(1, min(TASKS, -(-before // segment) * 2))
    merged = _merge(ready.select(*columns, "__run", "__place", "__start").repartition(parts, "__start").sortWithinPartitions("__start", "__run", F.desc("score"), F.col("doc_id").asc_nulls_last(), "__place"), columns, want)
    rest = runs.where(~inside).select(*columns, F.lit(None).cast("bigint").alias("rank"))
    return rest.unionByName(merged)


def _split(chosen: DataFrame, large: list[int], segment: int) -> DataFrame:
    """__sub and __part of the rows of scores with too many: ranges of ids that approximate quantiles bound, and of one id's places."""
    hot = chosen.where(F.col("score").isin(large))
    n = hot.count()
    ways = min(10_000, -(-4 * n // segment))
    bounds = hot.agg(F.percentile_approx("doc_id", [i / ways for i in range(1, ways)] or [0.5], 100 * ways).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds))
    is_hot = F.col("score").isin(large)
    if bounds:
        edges = F.array(*(F.lit(b) for b in bounds))
        # odd numbers are a bound's own rows, so that an id of many rows is alone
        sub = F.coalesce(2 * F.size(F.filter(edges, lambda b: b < F.col("doc_id"))) + F.array_contains(edges, F.col("doc_id")).cast("int"), F.lit(2 * len(bounds) + 1))
        chosen = chosen.withColumn("__sub", F.when(is_hot, sub).otherwise(0))
    alone = is_hot & ((F.col("__sub") % 2 == 1) | F.col("doc_id").isNull())
    return chosen.withColumn("__part", F.when(alone, F.pmod(F.xxhash64("__place"), F.lit(ways)).cast("int")).otherwise(0))


def _merge(ready: DataFrame, columns: list[str], want: int) -> DataFrame:
    """Rows of segments, run by run, to ranked rows; what a segment's tree gives past want has no rank."""
    fields = [f.name for f in ready.schema.fields]

    def give(start: int, rows: list[list], runs: list[int]) -> pa.RecordBatch:
        cuts = [0, *(i for i in range(1, len(runs)) if runs[i] != runs[i - 1]), len(runs)]
        score, ids, place = (rows[fields.index(c)] for c in ("score", "doc_id", "__place"))
        heads = [[(-score[i], ids[i] is None, ids[i] or 0, place[i], i) for i in range(a, b)] for a, b in zip(cuts, cuts[1:], strict=False)]
        tree, took, rank = Tournament(heads), [], []
        while start + len(took) < want and (got := tree.pop()) is not None:
            took.append(got[-1])
            rank.append(start + len(took))
        # the draw is over: whatever the runs still hold is undrawn
        left = [head[-1] for run, at in zip(tree.runs, tree.at, strict=True) for head in run[at:]]
        arrays = [pa.array([rows[fields.index(c)][i] for i in took + left], pa.int64()) for c in columns]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(rank + [None] * len(left), pa.int64())], names=[*columns, "rank"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, [[] for _ in fields]
        for batch in batches:
            start = batch.column("__start").to_numpy()
            cuts = [0, *(np.flatnonzero(start[1:] != start[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if now is not None and start[a] != now:
                    yield give(now, rows, rows[fields.index("__run")])
                    rows = [[] for _ in fields]
                now = int(start[a])
                for i, column in enumerate(batch.slice(a, b - a).columns):
                    rows[i] += column.to_pylist()
        if now is not None:
            yield give(now, rows, rows[fields.index("__run")])

    return ready.mapInArrow(run, ", ".join(f"{c} bigint" for c in [*columns, "rank"]))


def resample(docs: DataFrame, target: DataFrame, r: Resampling | None = None) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of each document; rank is null where it isn't drawn."""
    r = r or Resampling()
    gain = gains(bucket_counts(docs, r), bucket_counts(target, r))
    scored = weighted(docs, gain, r).withColumn("score", F.col("weight") + noise(F.col("doc_id"), r.seed))
    return draw(scored, F.col("n_words") >= r.least_words, None, r.percent)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: CRC32 of a word's bytes by the table of its polynomial; buckets of distinct words are worked out once.
SQL = f"""with recursive bits(i, k, c) as (select i, 0, i::bigint from range(256) t(i) union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from bits where k < 8),
crc as (select list(c order by i) as t from bits where k = 8),
w as (select 0 as own, doc_id, unnest({_WORDS}) as word from documents union all select 1, null, unnest({_WORDS}) from benchmark),
hashed as (select word, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, strlen(word) + 1), lambda i: ('0x' || substr(hex(encode(word)), 2 * i - 1, 2))::bigint)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 as bucket from (select distinct word from w), crc),
n as (select bucket, count(*) filter (own = 0) as s, count(*) filter (own = 1) as t from w join hashed using (word) group by bucket),
a as (select count(*) filter (own = 0)::double as sn, count(*) filter (own = 1)::double as tn from w),
g as (select bucket, floor(1000 * ln((t + 1.0::double) * (sn + 10000) / ((s + 1.0::double) * (tn + 10000))))::bigint as gain from n, a),
f as (select doc_id, count(*) as n_features, floor(sum(gain)::double / count(*))::bigint as weight from w join hashed using (word) join g using (bucket) where own = 0 group by doc_id),
z as (select d.doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, ('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::bigint as h from documents d left join f using (doc_id)),
y as (select doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score from z),
r as (select doc_id, row_number() over (order by score desc, doc_id) as k, count(*) over () as n from y where n_features >= 20)
select y.doc_id, n_features, weight, score, case when k <= floor(10 * n / 100) then k end as rank from y left join r using (doc_id)"""
