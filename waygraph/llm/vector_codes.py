"""Compression of vectors into codes: one codebook for each part, learned by Lloyd's rounds with Elkan's bounds.

Vectors become integers, so that all distances are exact.  A round's state has, for
each part of a vector, its entry, an upper bound of the distance to it, and one lower
bound for each entry of the codebook.  When the entries move, the upper bound grows by
its entry's movement and each lower bound shrinks by its own; an entry whose lower
bound, or half of whose distance from the vector's entry, lies strictly above the upper
bound is passed over, all others are compared as integers, ties to the lower index.
Bounds are written to the shared folder after each round, as bytes that round down
(upper ones as floats that round up); the state of the round before is then deleted.

What meets at the driver is the codebooks: parts x entries sums a round.

Defined results: vectors that are null, hold null or non-finite components or some of
2**20 or more, or aren't as long as the one of least id, are dropped; fewer vectors than entries give
as many entries; rows of a repeated or null id (which comes last) are rows of their own; an empty table
gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waygraph.llm.common import Shared, bounded_batches, delete, shared_dir, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Steps of a stored lower bound, from 0 to the largest one of its vector and part.
STEPS = 63
#: Vectors whose distances are held at once.
CHUNK = 2_000
#: Components from here on aren't squared exactly.
MOST = 1 << 20
#: Labels whose sums are broadcast; more of them are joined, each label over SALTS tasks.
MOST_LABELS, SALTS = 100_000, 32


@dataclass(frozen=True)
class Books:
    """entries (parts, entries, width) of integers; moved has each entry's distance from where it was when the bounds were made."""

    entries: np.ndarray
    moved: np.ndarray

    @staticmethod
    def of(entries: np.ndarray, before: np.ndarray | None = None) -> Books:
        shift = np.zeros(entries.shape[:2]) if before is None else np.sqrt(((entries - before) ** 2).sum(-1).astype(float))
        return Books(entries, np.nextafter(shift, np.inf))

    def sha256(self) -> str:
        """Of all components as decimals, by part, entry and place, comma-joined."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def whole(vector: Column) -> Column:
    """True where all components are there and finite."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= MOST))


def integers(column: pa.Array, scale: int = SCALE) -> np.ndarray:
    """(rows, components): floor(scale * x)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return np.floor(scale * flat).astype(np.int64).reshape(len(column), -1)


def full(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entry of each row of x (rows, width), an upper bound of its distance, lower bounds of all: all distances are computed."""
    d2 = ((x[:, None] - book[None]) ** 2).sum(-1)
    code, low = d2.argmin(1), np.sqrt(d2.astype(float))
    return code, low[np.arange(len(x)), code], low


def pruned(x: np.ndarray, book: np.ndarray, moved: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same from the bounds of the round before, and how many distances it took."""
    rows, k = np.arange(len(x)), len(book)
    slack = 1e-9  # of the bounds' own additions
    upper = upper + moved[code] + slack
    lower = np.maximum(lower - moved[None] - slack, 0.0)
    half = np.sqrt(((book[:, None] - book[None]) ** 2).sum(-1).astype(float)) / 2 - slack
    near = lambda r: (lower[r] <= upper[r, None]) & (half[code[r]] <= upper[r, None]) & (np.arange(k)[None] != code[r, None])
    own = rows[near(rows).any(1)]
    # where any other entry may be as near, the own distance replaces the bound, and the test is made again
    d2 = ((x[own] - book[code[own]]) ** 2).sum(-1)
    upper[own] = np.sqrt(d2.astype(float)) + slack
    lower[own, code[own]] = np.maximum(upper[own] - 2 * slack, 0.0)
    at, entry = np.nonzero(near(own))
    best = d2 * k + code[own]
    if len(at):
        r = own[at]
        e2 = ((x[r] - book[entry]) ** 2).sum(-1)
        lower[r, entry] = np.maximum(np.sqrt(e2.astype(float)) - slack, 0.0)
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        # distance and index in one integer: ties go to the lower index
        best[at[starts]] = np.minimum(best[at[starts]], np.minimum.reduceat(e2 * k + entry, starts))
    code = code.copy()
    code[own] = best % k
    upper[own] = np.sqrt((best // k).astype(float)) + slack
    return code, upper, lower, len(own) + len(at)


def pack(lower: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds (rows, entries) as bytes and their unit; never more than they were."""
    unit = (lower.max(1) / steps).astype(np.float32)
    unit = np.maximum(unit, np.float32(1e-6))
    return np.clip(np.floor(lower / unit[:, None].astype(float) - 1e-6), 0, 255).astype(np.uint8), unit


def unpack(packed: np.ndarray, unit: np.ndarray) -> np.ndarray:
    return packed * unit[:, None].astype(float)


STATE = "vec_id bigint, label string, x binary, code binary, upper binary, unit binary, lower binary, computed bigint"


def _bytes(rows: np.ndarray) -> pa.Array:
    """Each row of a two-dimensional array as one binary value."""
    rows = np.ascontiguousarray(rows)
    size = rows.itemsize * rows.shape[1]
    offsets = pa.py_buffer((np.arange(len(rows) + 1) * size).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(rows.tobytes())])


def _rows(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _assigned(df: DataFrame, books: Books, schema: str, first: bool, last: bool) -> DataFrame:
    """df's rows assigned to the nearest entries: from vectors (first) or from a state; gives the next state, or codes and errors (last)."""
    sent = Shared(df.sparkSession, books)
    parts, k, width = books.entries.shape

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        books, n = sent.value, batch.num_rows
        x = integers(batch.column("embedding")) if first else _rows(batch.column("x"), np.int32, parts * width).astype(np.int64)
        code = np.zeros((n, parts), np.uint8) if first else _rows(batch.column("code"), np.uint8, parts).copy()
        error, computed = np.zeros(n, np.int64), np.zeros(n, np.int64)
        upper, unit = (np.zeros((n, parts), np.float32) if first else _rows(batch.column(c), np.float32, parts).copy() for c in ("upper", "unit"))
        packed = np.zeros((n, parts, k), np.uint8) if first else _rows(batch.column("lower"), np.uint8, parts * k).reshape(n, parts, k).copy()
        for p in range(parts):
            xp, book = x[:, p * width : (p + 1) * width], books.entries[p]
            if first:
                own, up, low = full(xp, book)
                took = n * k
            else:
                own, up, low, took = pruned(xp, book, books.moved[p], code[:, p].astype(int), upper[:, p].astype(float), unpack(packed[:, p], unit[:, p]))
            code[:, p], upper[:, p] = own, np.nextafter(up.astype(np.float32), np.float32(np.inf))
            computed[0] += took
            if last:
                error += ((xp - book[own]) ** 2).sum(-1)
            else:
                packed[:, p], unit[:, p] = pack(low)
        ids = [batch.column("vec_id"), batch.column("label")]
        if last:
            arrays = [*ids, pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error), pa.array(computed)]
        else:
            arrays = [*ids, _bytes(x.astype(np.int32)), _bytes(code), _bytes(upper), _bytes(unit), _bytes(packed.reshape(n, -1)), pa.array(computed)]
        return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                yield each(batch.slice(at, CHUNK))

    return bounded_batches(df).mapInArrow(run, schema)


def _sums(state: DataFrame, books: Books) -> np.ndarray:
    """(parts, entries, 1 + width): count and sums of the parts of each entry; one row an entry from each partition."""
    parts, k, width = books.entries.shape
    shape = (parts, k, 1 + width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.int64)
        for batch in batches:
            x, code = _rows(batch.column("x"), np.int32, parts * width), _rows(batch.column("code"), np.uint8, parts)
            for p in range(parts):
                np.add.at(total[p, :, 0], code[:, p], 1)
                for j in range(width):
                    np.add.at(total[p, :, 1 + j], code[:, p], x[:, p * width + j])
        used = np.flatnonzero(total[..., 0].ravel())
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total.reshape(parts * k, -1)[used].tolist(), pa.list_(pa.int64()))], names=["entry", "sums"])

    found = state.select("x", "code").mapInArrow(run, "entry bigint, sums array<bigint>")
    found = found.groupBy("entry").agg(*(F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(1 + width)))
    total = np.zeros(shape, np.int64)
    for row in found.collect():  # parts x entries rows
        total.reshape(parts * k, -1)[row["entry"]] = row[1:]
    return total


def moved(books: Books, sums: np.ndarray) -> Books:
    """Entries at their parts' floored means; unused ones stay."""
    count, total = sums[..., :1], sums[..., 1:]
    return Books.of(np.where(count > 0, total // np.maximum(count, 1), books.entries), books.entries)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Books | None]:
    """vec_id, label (text), code (hex), error and computed (distances that its batch took) of all whole vectors, and the final codebooks."""
    spark, schema = vectors.sparkSession, "vec_id bigint, label string, code string, error bigint, computed bigint"
    kept = vectors.select("vec_id", F.col("label").cast("string").alias("label"), "embedding").where(whole(F.col("embedding")))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").toArrow().column("embedding").combine_chunks()
    dim = len(first[0]) if len(first) else 0
    if not dim or dim % parts:
        if dim:
            raise ValueError(f"{dim} components can't be cut into {parts} equal parts")
        return spark.createDataFrame([], schema), None
    kept = kept.where(F.size("embedding") == dim)
    same = first.filter(pc.equal(pc.list_value_length(first), dim))
    if len(same) < min(entries, len(first)):  # of vectors of this length there may be more
        first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").toArrow().column("embedding").combine_chunks()
    start = integers(first).reshape(len(first), parts, -1).transpose(1, 0, 2)
    books, source, top, at = Books.of(start), kept, f"{shared_dir(spark)}/codes-{uuid.uuid4().hex}", 0
    for at in range(1, rounds + 1):
        _assigned(source, books, STATE, at == 1, False).write.option("compression", "zstd").parquet(f"{top}/{at}")
        source = spark.read.schema(STATE).parquet(f"{top}/{at}")
        if at > 1:
            delete(spark, f"{top}/{at - 1}")
        books = moved(books, _sums(source, books))
    _assigned(source, books, schema, not rounds, True).write.option("compression", "zstd").parquet(f"{top}/codes")
    if at:
        delete(spark, f"{top}/{at}")
    return spark.read.schema(schema).parquet(f"{top}/codes"), books


def decode(codes: DataFrame, books: Books, code: str = "code", out: str = "approximation") -> DataFrame:
    """codes with the vector of its entries, in the components' own scale."""
    flat = F.array(*(F.lit(x) for x in (books.entries / SCALE).ravel().tolist()))
    parts, k, width = books.entries.shape
    entry = lambda p: F.conv(F.substring(F.col(code), 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn(out, F.array(*(F.element_at(flat, p * k * width + entry(p) * width + j + 1) for p in range(parts) for j in range(width))))


def with_label_errors(codes: DataFrame, most: int = MOST_LABELS) -> DataFrame:
    """codes with label_error: the error summed over equal labels. Sums are made before the shuffle; many labels meet their rows over SALTS tasks each."""
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    few = sums.count() <= most
    sums, salt = sums.withColumnRenamed("label", "__label"), F.lit(0)
    if few:
        sums = F.broadcast(sums.withColumn("__salt", F.lit(0)))
    else:
        sums, salt = sums.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")
    rows = codes.withColumn("__own", salt)
    return rows.join(sums, F.col("label").eqNullSafe(F.col("__label")) & (F.col("__own") == F.col("__salt"))).drop("__label", "__salt", "__own")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    return with_label_errors(codes).select("vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else "").alias("codebooks_sha256"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """All distances in each round, without bounds."""
    steps = [
        f"""with kept as (select vec_id, label, embedding from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
x as (select vec_id, label, p, list_transform(list_slice(embedding, p * {64 // parts} + 1, (p + 1) * {64 // parts}), lambda v: cast(floor({SCALE} * cast(v as double)) as bigint)) as v from kept, range({parts}) as r(p)),
b0 as (select p, row_number() over (partition by p order by vec_id) - 1 as e, v from x where vec_id in (select vec_id from kept order by vec_id limit {entries}))"""
    ]
    width = 64 // parts
    for r in range(rounds + 1):
        steps.append(
            f"""n{r} as (select vec_id, label, x.p, x.v, arg_min(e, struct_pack(d := d, e := e)) as e, min(d) as d from (select x.vec_id, x.label, x.p, x.v, b.e, list_sum(list_transform(range(1, {width + 1}), lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i])))::bigint as d from x join b{r} b using (p)) x group by all)"""
        )
        if r < rounds:
            means = ", ".join(f"cast(floor(sum(v[{j + 1}])::double / count(*)) as bigint)" for j in range(width))
            steps.append(f"m{r} as (select p, e, [{means}] as v from n{r} group by p, e), b{r + 1} as (select b.p, b.e, coalesce(m.v, b.v) as v from b{r} b left join m{r} m using (p, e))")
    last = f"""c as (select vec_id, label, string_agg(format('{{:02x}}', e), '' order by p) as code, sum(d)::bigint as error from n{rounds} group by vec_id, label),
s as (select sha256(string_agg(array_to_string(v, ','), ',' order by p, e)) as codebooks_sha256 from b{rounds})
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from c, s"""
    return ", ".join([*steps, last])


#: Ids are single ones in the table.
SQL = _sql()
