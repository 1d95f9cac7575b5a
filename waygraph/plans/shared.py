"""Dealing rows to tasks, and cutting long lineages in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes up to which the JVM compiles a method; longer ones are interpreted, at several times the cost.
METHOD_LIMIT, METHOD_BYTES = "spark.sql.codegen.hugeMethodLimit", "8000"


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """df dealt by the columns in a fixed number of parts. Parts of few bytes are else put together, down to one task for each family of a union, and the dear steps after the shuffle with them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


@contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    """What is computed inside: stages whose generated method the JVM would not compile run operator by operator, each of whose methods it does.

    Filters then work out first what they ask more than once, also behind an `and`: a divisor in them must not be 0.
    """
    before = spark.conf.get(METHOD_LIMIT, None)
    spark.conf.set(METHOD_LIMIT, METHOD_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(METHOD_LIMIT) if before is None else spark.conf.set(METHOD_LIMIT, before)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and checkpointed: in spark.checkpoint.dir; where that is unset, in a folder of our own on a single machine, an error on a cluster."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="waygraph-"))
    return df.checkpoint()
