"""Runs over a stream against runs over a table; facts that are read by their index."""

import time

from pyspark.sql import functions as F

from waygraph.operators.following import streaks
from waygraph.sources import tables
from waygraph.streaming import runs


#: A watermark begins at 0, and rows that are no later count as late.
FIRST_US = 1_700_000_000_000_000


def facts(spark, frames):
    rows = [("s", "follows", a, b, f, FIRST_US + f * 500_000) for a, b, own in frames for f in own]
    return spark.createDataFrame(rows, "scenario_token string, predicate string, s_track string, o_track string, frame_index int, timestamp_us long")


def test_streamed_runs_are_batch_runs(spark, tmp_path):
    """Batches bring frames late, twice, and with gaps; the last one only moves the watermark."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    batches = [
        [("a", "b", [0, 1, 3]), ("a", "c", [0, 1])],
        [("a", "b", [2, 1, 5]), ("a", "c", [2, 2, 3])],
        [("a", "b", [4, 8, 9]), ("a", "c", [9, 10])],
        [("a", "b", [40])],
        [("a", "b", [90])],
    ]
    schema = facts(spark, [("a", "b", [0])]).schema
    for i, frames in enumerate(batches):
        facts(spark, frames).coalesce(1).write.parquet(str(tmp_path / "all" / f"{i}"))
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = stream.withColumn("at", F.timestamp_micros("timestamp_us"))
    query = runs.stream_runs(stream, "at").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        for i in range(len(batches)):
            (tmp_path / "all" / f"{i}").rename(tmp_path / "in" / f"{i}")
            query.processAllAvailable()
            time.sleep(0.1)
    finally:
        query.stop()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    table = facts(spark, [x for b in batches for x in b]).distinct().where("frame_index < 90")
    own = spark.range(91).select(F.lit("s").alias("scenario_token"), F.col("id").cast("int").alias("frame_index"), (F.lit(FIRST_US) + F.col("id") * 500_000).alias("timestamp_us"))
    want = sorted(tuple(r) for r in streaks(table, own, ("s_track", "o_track", "predicate")).select(*runs.KEY, "frame_index", "timestamp_us", "start_us", "duration_s").collect())
    assert got == want


def test_indexed_facts_open_their_files_alone(spark, tmp_path):
    rows = [(f"sc{s:03d}", t, f"p{t % 3}") for s in range(40) for t in range(5 if s else 2000)]
    df = spark.createDataFrame(rows, "scenario_token string, timestamp_us long, predicate string").repartition(7)
    tables.write_indexed(df, str(tmp_path), scenarios_per_file=5)
    every = spark.read.parquet(f"{tmp_path}/facts")
    assert every.count() == len(rows) and len(every.inputFiles()) >= 7
    for first, last, want in (("sc007", None, 5), ("sc000", None, 2000), ("sc010", "sc019", 50), ("sc999", None, 0), ("sc0075", None, 0)):
        got = tables.read_indexed(spark, str(tmp_path), first, last)
        assert got.count() == want
        if want in (5, 2000):
            assert len(got.inputFiles()) == 1
    assert len(tables.read_indexed(spark, str(tmp_path), "sc010", "sc019").inputFiles()) <= 4
    assert spark.read.parquet(f"{tmp_path}/index").agg(F.sum("n")).first()[0] == len(rows)
