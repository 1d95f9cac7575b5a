"""What the operators share: tables, the shared folder, Arrow kernels, words."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of an Arrow batch: long texts come in fewer rows.
BATCH_BYTES = "16m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; where unset, one of our own on a single machine, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="waygraph-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder that materialize or a stage has written, wherever Spark has written it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of doc_id as text leaves this remainder; a null id is text of no length."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def bounded_batches(df: DataFrame) -> DataFrame:
    """df; Arrow batches of its session hold BATCH_BYTES at most, unless the session says otherwise."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, None) in ("67108864b", "64MB"):
        conf.set(name, BATCH_BYTES)
    return df


def give_back() -> None:
    """Workers live on after their tasks, several beside each executor: memory that is free by now goes back to the system."""
    pa.default_memory_pool().release_unused()
    # the C library's heap has numpy's arrays and what Python doesn't pool; without glibc there is no such call
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_arrow(df: DataFrame, kernel: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """Apply kernel to column lists of each Arrow batch; it returns the columns of schema."""
    out = pa.schema([(f.name, _arrow(f.dataType.simpleString())) for f in _struct(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                got = kernel({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in out], schema=out)
            batch = got = None
            give_back()

    return bounded_batches(df).mapInArrow(run, schema)


def add_arrow(df: DataFrame, inputs: list[str], kernel: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """All columns of df, then those of schema, which kernel makes from the inputs."""
    from pyspark.sql.types import StructType

    fields = _struct(schema)
    out = pa.schema([(f.name, _arrow(f.dataType.simpleString())) for f in fields])
    full = StructType(list(df.schema.fields) + list(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                names = batch.schema.names
                got = kernel({n: batch.column(names.index(n)).to_pylist() for n in inputs})
                yield pa.RecordBatch.from_arrays(batch.columns + [pa.array(got[f.name], type=f.type) for f in out], names=names + out.names)
            batch = got = None
            give_back()

    return bounded_batches(df).mapInArrow(run, full)


def _struct(schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema)


def _arrow(kind: str) -> pa.DataType:
    if kind.startswith("array<"):
        return pa.list_(_arrow(kind[6:-1]))
    if kind.startswith("struct<"):
        parts = [p.split(":") for p in kind[7:-1].split(",")]
        return pa.struct([(n, _arrow(t)) for n, t in parts])
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}[kind]


class Shared:
    """A broadcast of any object. It travels as bytes, since plain pickles of our classes need the package at the other end."""

    def __init__(self, spark: SparkSession, thing: object) -> None:
        self.sent = spark.sparkContext.broadcast(cloudpickle.dumps(thing))

    def __getstate__(self) -> dict:
        return {"sent": self.sent}

    @property
    def value(self):
        if "thing" not in self.__dict__:
            self.thing = cloudpickle.loads(self.sent.value)
        return self.thing


def words_of(text: str | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ of a text, as UTF-8; bytes.split parts at just these characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def padded_groups(lengths: np.ndarray, cells: int = 2_000_000) -> Iterator[np.ndarray]:
    """Row numbers in groups of like length whose padded size stays under cells; each group has its longest first."""
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order) and lengths[order[at]] > 0:
        take = max(1, cells // int(lengths[order[at]]))
        yield order[at : at + take][lengths[order[at : at + take]] > 0]
        at += take


def part_of(share: float, seed: int, *columns: str) -> Column:
    """True for a share of all rows, chosen by a hash of the columns."""
    return F.xxhash64(F.lit(seed), *columns) < F.lit(min(2**63 - 1, int(share * 2.0**64) - 2**63))


def bounded_sample(df: DataFrame, columns: list[str], most: int, seed: int) -> DataFrame:
    """Some `most` rows of a training set, chosen by a hash of the columns; all rows where there are no more."""
    n = df.count()
    return df if n <= most else df.where(part_of(most / n, seed, *columns))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, columns: list[str], most: int, most_bytes: int, seed: int) -> dict[str, list]:
    """columns of documents and their label, on the driver: some `most` rows of most_bytes of text together.

    The labels are sampled first.  Repeated rows of id and text count once; where ids
    repeat with other texts, or texts are long, the joined rows are sampled again.
    """
    chosen = bounded_sample(labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias(label)), ["doc_id"], most, seed)
    # `most` bounds the broadcast
    rows = docs.select("doc_id", *columns).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "text"])
    rows = materialize(rows, "training")
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    share = min(1.0, most / max(n, 1), most_bytes / max(size, 1))
    if share < 1.0:
        rows = rows.where(part_of(share, seed + 1, "doc_id", "text"))
    return rows.toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")]).to_pydict()


def sampled(docs: DataFrame, most: int, seed: int = 9) -> DataFrame:
    """Some `most` rows of documents, chosen by a hash of id and text; all rows where there are no more."""
    return bounded_sample(docs, ["doc_id", "text"], most, seed)


def set_aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns named __d0, __d1 ..., and these names by their own, so that no column clashes with ours."""
    back = {c: f"__d{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in back.items())), back
